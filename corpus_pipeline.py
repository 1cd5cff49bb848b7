"""The corpus pipeline: documents rated, deduplicated, mixed and encoded, each stage on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import exact_dedup, jaccard_join, mixing, rule_quality, sentencepieces
from pulsegrid.llm.queries import PIECES, vocabulary
from pulsegrid.llm.shared import Tables, read_table
from pulsegrid.session import prepare


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels of the given documents."""
    prepare(spark)
    return rule_quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts stays."""
    prepare(spark)
    return exact_dedup.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar five-word shingles the one with the smallest id stays."""
    prepare(spark)
    return jaccard_join.keep_one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice."""
    prepare(spark)
    return mixing.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and what they say: doc_id, source, n_tokens, ids, decoded."""
    prepare(spark)
    coded = sentencepieces.encode_documents(docs, vocabulary(PIECES), carry=["source"])
    return coded.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_duplicates),
    ("ngram_jaccard_join", near_duplicates),
    ("source_mixing", source_mixing),
    ("sentencepiece", encoding),
]

# The classifier, the draws of the mix and the encoding are beyond SQL; tests/llm compares run() stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    tables = Tables(spark, "corpus-pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = tables.write(stage(spark, docs, sf_dir), name)
    return docs
