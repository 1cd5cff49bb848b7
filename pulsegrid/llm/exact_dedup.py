"""Exact dedup: one document stays of those whose texts are equal but for white space."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import no_space, whole_text
from pulsegrid.session import materialize

# An id lies within +-MID, and a rank is length * SPAN + (MID - id); 10 + 20 digits fit in 38.
MID = Decimal(10**19)
SPAN = Decimal(10**20)
WIDE = "decimal(38,0)"


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """Class of equal texts of every row, and whether the row stays.

    Rows are grouped by a 128-bit hash of the text without white space. Inside a group the texts themselves are part of
    the grouping key, so rows that only share the hash fall apart. The row with the most code points in its original
    text stays, of these the one with the smallest id.

    One shuffle carries each different text once per map task (copies are merged before it); a second, of 100 bytes a
    row, gives every row its class, and Spark splits its hot partitions.

    Returns doc_id, keep_id, group_size, kept, text_sha256; other columns of the input are not read. A null text is
    empty, and all empty texts form one class. A null id loses to every other; rows repeated with one id count each in
    group_size and stay or go together. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    normal = rows.select("doc_id", F.length("text").alias("n"), no_space(F.col("text")).alias("normal"))
    keyed = normal.withColumn("hash", digest(F.col("normal")))
    rank = F.col("n").cast("decimal(10,0)") * F.lit(SPAN) + F.coalesce(
        F.lit(MID).cast(WIDE) - F.col("doc_id").cast(WIDE), F.lit(0).cast(WIDE))
    texts = keyed.groupBy("hash", "normal").agg(
        F.max(rank.cast(WIDE)).alias("rank"), F.count(F.lit(1)).alias("group_size"))
    place = F.col("rank") % F.lit(SPAN).cast(WIDE)
    classes = texts.select("hash", F.sha2("normal", 256).alias("text_sha256"), "group_size", place.alias("place"))
    # Different texts of one hash are told apart by their SHA-256; should even that agree, the run stops.
    classes = classes.groupBy("hash", "text_sha256").agg(
        F.max("place").alias("place"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts"))
    classes = materialize(classes.select(
        "hash", "text_sha256", "group_size",
        F.when(F.col("texts") > 1, F.raise_error(F.lit("different texts share both hashes"))
               ).when(F.col("place") > 0, (F.lit(MID).cast(WIDE) - F.col("place")).cast("long")).alias("keep_id"),
    ), "exact-classes")
    members = keyed.select("doc_id", "hash", F.sha2("normal", 256).alias("text_sha256"))
    return members.join(classes, ["hash", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(F.col("__kept_id")), "left_semi")


SQL = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS kept,
       sha256(t) AS text_sha256
FROM n
"""
