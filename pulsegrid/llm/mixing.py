"""Mixing sources to target weights.

Words of every source, in order of its documents, are packed into blocks of fixed length. Every source has a quota of
slots; multinomial draws deal the quota out to the output shards, so each shard holds a multinomial draw of sources
while each source's total stays at its quota. Slot t of a source is filled by block p(t), p a pseudorandom permutation
of the source's block indexes (a new one each time all blocks were used), and slots and blocks are joined by index.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import in_order, whole_text, words_of
from pulsegrid.llm.shingles import mixed
from pulsegrid.session import materialize


@dataclass
class MixParams:
    block: int = 32  # words
    shard_slots: int = 4096  # slots of an output shard, in the mean
    seed: int = 20240131
    weights: tuple[float, ...] = (5, 2, 1)  # of the sources in order of their names, again and again; null comes last
    share: float = 1.5  # of all words
    most: float = 2.0  # times a source's words


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Image of every index under a permutation of range(n) chosen by `key`: a four-round Feistel network on the least
    even number of bits that holds n, walked until the image is below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        x, h, m, k = out[todo], half[todo], low[todo], key[todo]
        left, right = x >> h, x & m
        for r in range(4):
            left, right = right, left ^ (mixed(right + mixed(k + np.uint64(r))) & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def targets(sources: DataFrame, p: MixParams) -> DataFrame:
    """Adds target: `share` of all words by weight, but at most `most` times a source's own; the excess goes to the
    others by weight. Only sums come to the driver, a few times."""
    cap, weight = F.col("words") * p.most, F.col("weight")
    total = sources.agg(F.sum("words")).first()[0] or 0
    level, filled = 0.0, -1
    while True:
        # At this level so many sources are full; the rest share what those leave.
        full = cap <= level * weight
        taken, open_weight, count = sources.agg(
            F.sum(F.when(full, cap)), F.sum(F.when(~full, weight)), F.count(F.when(full, 1))).first()
        if count == filled or not open_weight:
            break
        level, filled = (p.share * total - (taken or 0.0)) / open_weight, count
    return sources.withColumn("target", F.least(cap, level * weight).cast("double"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", p: MixParams = MixParams()):
    """The plan of the mix, as three tables:

    documents: doc_id, source, size, source_size, target, number (of the source), start (of the document's words among
    its source's); slots: number, shard, slot, block; pieces: number, start, block, words (of the document in the block).
    Slot order within a shard is pseudorandom too. All depends on the rows and the seed only.

    A null source is a source; null and empty texts have no words and fill no block; documents repeated under one id
    are documents of their own; an empty table gives empty tables.
    """
    sized = materialize(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.size(words_of(whole_text(text_col))).cast("long").alias("size")), "sizes")
    named = sized.groupBy("source").agg(F.sum("size").alias("words"))
    named = in_order(named, [F.col("source").asc_nulls_last()], F.lit(1), "number").drop("shard")
    cycle = F.element_at(F.array(*(F.lit(float(w)) for w in p.weights)), (F.col("number") % len(p.weights) + 1).cast("int"))
    sources = materialize(targets(materialize(named.withColumn("weight", cycle), "sources"), p), "targets")
    many = F.ceil(F.col("words") / p.block)
    quota = F.coalesce(F.round(F.col("target") * many / F.nullif("words", F.lit(0))), F.lit(0))
    sources = sources.select("source", "number", F.col("words").alias("source_size"), "target",
                             many.alias("blocks"), quota.cast("long").alias("quota"))
    known = sized.join(sources, sized.source.eqNullSafe(sources.source)).select(
        "doc_id", sized.source, "size", "source_size", "target", "number")
    placed = in_order(known, [F.col("number"), F.xxhash64("doc_id", F.lit(p.seed)), F.col("doc_id"), F.col("size")],
                      F.col("size"), "total").drop("shard")
    first = in_order(sources.select("number", "source_size"), [F.col("number")], F.col("source_size"), "first")
    placed = placed.join(first.select("number", "first"), "number").withColumn("start", F.col("total") - F.col("first"))
    placed = materialize(placed.drop("total", "first"), "placed")
    slots = materialize(_slots(sources, p), "slots")  # its size can't be told from the sources it is made from
    blocks = F.sequence(F.floor(F.col("start") / p.block), F.floor((F.col("start") + F.col("size") - 1) / p.block))
    pieces = placed.where("size > 0").select("number", "start", "size", F.explode(blocks).alias("block"))
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * p.block)
    pieces = pieces.select("number", "start", "block", (end - F.greatest("start", F.col("block") * p.block)).alias("words"))
    return placed, slots, pieces


def _slots(sources: DataFrame, p: MixParams) -> DataFrame:
    total = sources.agg(F.sum("quota")).first()[0] or 0
    shards = max(1, -(-total // p.shard_slots))

    def deal(batches):
        for batch in batches:
            for number, blocks, quota in batch.itertuples(index=False):
                rng = np.random.Generator(np.random.PCG64([p.seed, number]))
                counts = rng.multinomial(quota, np.full(shards, 1 / shards))
                hit = np.flatnonzero(counts)
                yield pd.DataFrame({"number": number, "blocks": blocks, "shard": hit, "count": counts[hit],
                                    "first": (np.cumsum(counts) - counts)[hit]})

    def fill(batches):
        for batch in batches:
            for number, blocks, shard, count, first in batch.itertuples(index=False):
                t = np.arange(first, first + count)
                key = mixed(np.full(count, p.seed, np.uint64) + mixed(np.uint64(number) + (t // blocks).astype(np.uint64) * np.uint64(1 << 40)))
                place = mixed(mixed(t.astype(np.uint64) + np.uint64(shard << 32)) + np.uint64(number))
                yield pd.DataFrame({"number": number, "shard": shard, "slot": place.view(np.int64),
                                    "block": permuted(t % blocks, np.full(count, blocks), key)})

    dealt = sources.where("quota > 0").select("number", "blocks", "quota").mapInPandas(
        deal, "number long, blocks long, shard long, count long, first long")
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "shard", "number").mapInPandas(fill, "number long, shard long, slot long, block long")


def taken_words(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", p: MixParams = MixParams()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document: slots joined with blocks, summed."""
    placed, slots, pieces = mix(docs, id_col, source_col, text_col, p)
    used = pieces.hint("merge").join(slots, ["number", "block"]).groupBy("number", "start").agg(F.sum("words").alias("taken"))
    used = used.withColumnRenamed("number", "in_number").withColumnRenamed("start", "at")
    same = (F.col("number") == F.col("in_number")) & (F.col("start") == F.col("at")) & (F.col("size") > 0)
    return placed.join(used, same, "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def times(id_col: str, taken: Column, size: Column, seed: int) -> Column:
    """How often a whole document stands for its taken words: their ratio, rounded up with the chance of its fraction."""
    ratio = taken / F.greatest(size, F.lit(1))
    chance = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    return (F.floor(ratio) + (chance < ratio - F.floor(ratio)).cast("int")).cast("int")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", p: MixParams = MixParams()) -> DataFrame:
    """The rows of `docs` as often as the mix takes them whole (0 to 2 times), with all columns.

    Rows that repeat one id in one source are taken as often as the first of them. Documents without words are in no
    block and leave.
    """
    taken = taken_words(docs, id_col, source_col, text_col, p).where("taken > 0")
    often = taken.select("doc_id", "source", times("doc_id", F.col("taken"), F.col("size"), p.seed).alias("times"))
    often = often.groupBy("doc_id", "source").agg(F.max("times").alias("__times")).where("__times > 0")
    often = often.withColumnsRenamed({"doc_id": "__doc", "source": "__source"})
    same = docs[id_col].eqNullSafe(F.col("__doc")) & docs[source_col].cast("string").eqNullSafe(F.col("__source"))
    full = docs.join(often, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return full.select(*(docs[c] for c in docs.columns))
