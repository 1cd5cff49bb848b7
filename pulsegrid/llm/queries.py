"""One registered query per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import (
    chat_format, exact_dedup, jaccard_join, mixing, page_text, periodic_runs, robust_rules, rule_quality, sentencepieces,
    suffix_dedup, token_counts, token_files, vector_codes,
)
from pulsegrid.llm.shared import Tables, read_table
from pulsegrid.session import prepare

# Where the vocabulary files lie; every executor has them installed.
PIECES = "piece_bpe_32k.model"
WORD_PIECES = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(prepare(spark), sf_dir)
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


@query(jaccard_join.SQL)
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(read_table(spark, sf_dir, "documents"))


@query()
def op2_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, "token-files")
    blocks = token_files.write_documents(read_table(spark, sf_dir, "documents"), vocabulary(WORD_PIECES), tables)
    return token_files.read_documents(blocks).drop("ids")


@query()
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.taken_words(read_table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


@query(exact_dedup.SQL)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query(chat_format.SQL)
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit(chat_format.HOSTILE)
    added = spark.range(2).select(
        F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), said)
    return chat_format.digests(chat_format.format_conversations(turns.union(added)))


@query()
def op6_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_quality.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query()
def op7_robust_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = robust_rules.quality_rules(read_table(spark, sf_dir, "documents"))
    return rated.drop("lang", "source")


@query()
def op8_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    said = page_text.extract(pages, page_text.learn(pages))
    return said.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query()
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    share = F.when(F.col("n_bytes") > 0, F.col("n_removed") / F.col("n_bytes")).otherwise(0.0)
    # A cut may fall inside a character; what is left of it becomes the replacement character.
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", share.alias("removed_share"), text.alias("kept_text"))


@query()
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepieces.encode_documents(read_table(spark, sf_dir, "documents"), vocabulary(PIECES))
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(vector_codes.SQL)
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(read_table(spark, sf_dir, "embeddings"))


@query()
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), vocabulary(PIECES))


@query()
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.periodic_runs(read_table(spark, sf_dir, "documents"), planted=True))
