"""Vectors as short codes: one codebook per part position, fitted over a trie of the distinct parts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import Tables

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
# Leaves of the trie are worked so many at a time.
LEAVES = 16_384
_SHIFT = 1 << 31


def parts_of(vectors: np.ndarray) -> Iterator[np.ndarray]:
    """The parts of whole-number vectors, position by position."""
    return iter(np.split(vectors, PARTS, axis=1))


def keys_of(parts: np.ndarray) -> np.ndarray:
    """Bytes that sort as the parts do, component by component."""
    shifted = np.ascontiguousarray((parts + _SHIFT).astype(">u4"))
    return shifted.view(f"V{4 * parts.shape[1]}").ravel()


def parts_in(keys: pa.Array, width: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(keys.to_pylist()), dtype=">u4")
    return flat.reshape(-1, width).astype(np.int64) - _SHIFT


class Walk:
    """A depth-first walk over the trie of one position's distinct parts.

    A trie node is a prefix of components and holds its squared distances to the same prefix of all entries; a child
    adds one component's squares to them, and all parts below a node share what it holds. Leaves come in lexicographic
    order, some at a time; the path to the last leaf stays open from one call to the next.
    """

    def __init__(self, book: np.ndarray):
        self.book = book
        self.path = self.last = None

    def distances(self, leaves: np.ndarray) -> np.ndarray:
        """Squared distances of sorted, different parts to all entries."""
        n, width = leaves.shape
        before = leaves[:1] if self.last is None else self.last[None]
        fresh = np.logical_or.accumulate(leaves != np.concatenate([before, leaves[:-1]]), axis=1)
        if self.last is None:
            fresh[0] = True
            self.path = [None] * width
        held, node = np.zeros((1, len(self.book)), dtype=np.int64), np.zeros(n, dtype=np.int64)
        for d in range(width):
            at = np.flatnonzero(fresh[:, d])
            grown = held[node[at]] + np.square(leaves[at, d, None] - self.book[None, :, d])
            if not fresh[0, d]:  # the first leaves still lie below a node of the open path
                grown = np.concatenate([self.path[d][None], grown])
            node = np.cumsum(fresh[:, d]) - bool(fresh[0, d])
            held = grown
            self.path[d] = held[node[-1]]
        self.last = leaves[-1]
        return held[node]


def nearest(distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, the lower of equals, and its distance."""
    entry = distances.argmin(axis=1)
    return entry, np.take_along_axis(distances, entry[:, None], axis=1)[:, 0]


def usable(vector: str, width: int | None = None):
    """Vectors that are coded: whole, finite, and of a length that the parts divide.

    An error fits a long as long as components stay below sqrt(2^63 / length) / 8192; vectors beyond are left out too.
    """
    size = F.size(vector)
    bound = F.sqrt(F.lit(2.0**63) / size) / F.lit(2.0 * SCALE)
    fits = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < bound, F.lit(False)))
    length = (size > 0) & (size % PARTS == 0) if width is None else size == PARTS * width
    return F.coalesce(F.col(vector).isNotNull() & length & fits, F.lit(False))


def _whole(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat.reshape(-1, PARTS * width) * SCALE).astype(np.int64)


def distinct_parts(rows: DataFrame, width: int, tables: Tables) -> DataFrame:
    """Every distinct part of `vector` once: part, key, n; sorted by part and key over the written files.

    Equal parts of a batch become one row before the shuffle, so a vector that is very common is no load on one task.
    """

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                for position, parts in enumerate(parts_of(_whole(batch.column(0), width))):
                    keys, n = np.unique(keys_of(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(keys), position, np.int32)), pa.array([k.tobytes() for k in keys], pa.binary()),
                        pa.array(n)], names=["part", "key", "n"])

    cut = rows.select("vector").mapInArrow(work, "part int, key binary, n bigint")
    ranged = cut.repartitionByRange("part", "key").groupBy("part", "key").agg(F.sum("n").alias("n"))
    return tables.write(ranged.sortWithinPartitions("part", "key"), "parts")


def fitted_sums(parts: DataFrame, books: np.ndarray) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Of every used (part, entry): how many parts it is nearest to, and their components' sums."""
    width = books.shape[2]

    def work(batches):
        sums = np.zeros(books.shape, dtype=np.int64)
        counts = np.zeros(books.shape[:2], dtype=np.int64)
        at, walk = None, None
        for batch in batches:
            position = batch.column(0).to_numpy()
            n = batch.column(2).to_numpy()
            for start, end in _stretches(position):
                if position[start] != at:
                    at, walk = int(position[start]), Walk(books[position[start]])
                leaves = parts_in(batch.column(1).slice(start, end - start), width)
                entry, _ = nearest(walk.distances(leaves))
                np.add.at(sums[at], entry, leaves * n[start:end, None])
                np.add.at(counts[at], entry, n[start:end])
        used = np.argwhere(counts)
        yield pa.RecordBatch.from_arrays([
            pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()), pa.array(counts[counts > 0], pa.int64()),
            pa.array(sums[counts > 0].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    summed = parts.mapInArrow(work, "part int, entry int, n bigint, sums array<bigint>").groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    # At most one row per entry, however many vectors there are.
    return {(r.part, r.entry): (r.n, r.sums) for r in summed.collect()}


def _stretches(position: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows of one part position, at most LEAVES at a time."""
    cuts = np.flatnonzero(np.append(True, position[1:] != position[:-1])).tolist() if len(position) else []
    for a, b in zip(cuts, [*cuts[1:], len(position)]):
        for start in range(a, b, LEAVES):
            yield start, min(b, start + LEAVES)


def fit(parts: DataFrame, first: np.ndarray) -> np.ndarray:
    """Codebooks (part, entry, component) after all rounds; `first` are the vectors whose parts they start from."""
    books = np.stack(list(parts_of(first)))
    for _ in range(ROUNDS):
        for (part, entry), (n, sums) in fitted_sums(parts, books).items():
            books[part, entry] = [s // n for s in sums]
    return books


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """Codes of all vectors by codebooks fitted to all of them.

    Every component becomes floor(4096 * x); a vector is cut into 8 equal parts. A position's codebook starts as that
    part of the 16 vectors with the smallest ids (of equal ids, the smaller vector first; null ids last), fewer if
    there are fewer. Each of 6 rounds finds every distinct part's nearest entry (squared distance, ties to the lower
    index) by a walk over the trie of parts and moves entries to the floor of their parts' mean.

    Returns vec_id, code (two hex digits a part), error (squared distances summed), label_error (error summed over
    rows of the same label, nulls together; null beyond a long), codebooks_sha256. Left out are vectors that are null,
    hold null or non-finite components, are empty, have a length that 8 does not divide or other than the first kept
    vector's, or components so large that errors could exceed a long (46,000 at 64 components). Repeated rows and ids
    count each. Other columns, of any name, are left out; without vectors the result is empty.
    """
    spark = vectors.sparkSession
    tables = Tables(spark, "vector-codes")
    rows = vectors.select(
        F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    coded_as = f"{kinds}, code string, error bigint"
    order = [F.col("vec_id").asc_nulls_last(), "vector"]
    lead = rows.filter(usable("vector")).orderBy(*order).limit(1).collect()
    if not lead:
        return _finished(spark.createDataFrame([], coded_as), "")
    width = len(lead[0].vector) // PARTS
    rows = rows.filter(usable("vector", width))
    first = np.array([r.vector for r in rows.orderBy(*order).limit(ENTRIES).collect()], dtype=np.float64)
    scratch = Tables(spark, "vector-parts")
    books = fit(distinct_parts(rows, width, scratch), np.floor(first * SCALE).astype(np.int64))
    scratch.drop()

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, error = [], np.zeros(batch.num_rows, dtype=np.int64)
            for position, parts in enumerate(parts_of(_whole(batch.column(2), width))):
                keys, some, of = np.unique(keys_of(parts), return_index=True, return_inverse=True)
                walk, leaves = Walk(books[position]), parts[some]
                found = [nearest(walk.distances(leaves[a:a + LEAVES])) for a in range(0, len(leaves), LEAVES)]
                entry, distance = (np.concatenate(x)[of] for x in zip(*found))
                codes.append(entry)
                error += distance
            hexed = np.stack(codes, axis=1).astype(np.uint8).tobytes().hex()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1),
                pa.array([hexed[i:i + 2 * PARTS] for i in range(0, len(hexed), 2 * PARTS)], pa.string()),
                pa.array(error)], names=["vec_id", "label", "code", "error"])

    coded = tables.write(rows.mapInArrow(work, coded_as), "codes")
    said = ",".join(map(str, books.ravel().tolist()))
    return _finished(coded, hashlib.sha256(said.encode()).hexdigest())


def _finished(coded: DataFrame, books: str) -> DataFrame:
    """Adds the errors of labels: sums by label, joined back on a label that may be null."""
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint").alias("label_error"))
    sums = sums.withColumnRenamed("label", "__label")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("__label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    """Assignment to codebook k and the codebook after it."""
    return f"""
    near{k} AS MATERIALIZED (
        SELECT p, s, n, CAST(min(d * {ENTRIES} + e) % {ENTRIES} AS BIGINT) AS e FROM (
            SELECT x.p, x.s, x.n, b.e, list_sum(list_transform(list_zip(x.s, b.s), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
            FROM distinct_parts x JOIN book{k} b ON x.p = b.p) GROUP BY p, s, n),
    sums{k} AS (
        SELECT p, e, i, sum(n * x) AS total, sum(n) AS n FROM (
            SELECT p, e, n, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM near{k}) GROUP BY p, e, i),
    moved{k} AS (
        SELECT p, e, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY i) AS s FROM sums{k} GROUP BY p, e),
    book{k + 1} AS MATERIALIZED (
        SELECT b.p, b.e, coalesce(m.s, b.s) AS s FROM book{k} b LEFT JOIN moved{k} m ON b.p = m.p AND b.e = m.e),"""


SQL = f"""
    WITH kept AS MATERIALIZED (
        SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r,
            list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS MATERIALIZED (
        SELECT r, p, list_slice(v, p * (len(v) // {PARTS}) + 1, (p + 1) * (len(v) // {PARTS})) AS s
        FROM kept, range({PARTS}) AS positions(p)),
    distinct_parts AS MATERIALIZED (SELECT p, s, count(*) AS n FROM parts GROUP BY p, s),
    book0 AS MATERIALIZED (SELECT p, r - 1 AS e, s FROM parts WHERE r <= {ENTRIES}),
    {"".join(map(_round_sql, range(ROUNDS)))}
    nearest_last AS (
        SELECT p, s, min(d * {ENTRIES} + e) AS d FROM (
            SELECT x.p, x.s, b.e, list_sum(list_transform(list_zip(x.s, b.s), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
            FROM distinct_parts x JOIN book{ROUNDS} b ON x.p = b.p) GROUP BY p, s),
    coded AS (
        SELECT r, string_agg(printf('%02x', CAST(d % {ENTRIES} AS BIGINT)), '' ORDER BY p) AS code,
            CAST(sum(d // {ENTRIES}) AS BIGINT) AS error
        FROM parts JOIN nearest_last USING (p, s) GROUP BY r),
    said AS (
        SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (
            SELECT p, e, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM book{ROUNDS}))
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM coded JOIN kept USING (r), said
"""
