"""Suffix-array dedup: bytes covered by a string of fixed length that also starts elsewhere are removed.

Every start of such a string is a suffix cut to that length. Suffixes are bucketed by their anchor (see anchors), so
equal ones meet in a bucket at the same distance from it, and a text's suffixes fall into runs of one bucket:

1. A run whose anchor is nowhere else is unique. A run all of whose bytes occur elsewhere is repeated as a whole.
   Counting both takes two hashes a run; copies are merged before each shuffle.
2. Buckets with more runs than one task should sort are cut by their suffixes' distance from the anchor, and by the
   bytes that all suffixes of such a piece have in common. Equal suffixes are in equal pieces, and pieces are counted
   like runs; buckets of pieces that are still too large are cut again, at last into single suffixes.
3. The other runs, mostly at the edges of shared passages, send their bytes to their bucket. A task takes buckets
   together by their size in bytes. Suffixes whose hash is alone are unique; the rest are sorted by their first bytes, and
   ties by the precomputed ranks of a difference-cover sample of places, each rank standing for 256 bytes, so that no
   comparison walks along a long tie.

Per document the starts found are joined again with the text, and the bytes they cover are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.anchors import Hashes, window_runs
from pulsegrid.llm.shared import Tables, grouped, release, whole_text
from pulsegrid.llm.shingles import mixed

LENGTH = 400
PERIOD = 32
BLOCK = 1024  # runs of a bucket that is sorted as it is
SORTED_BYTES = 1 << 20  # buckets are sorted together up to about so many


def difference_cover(period: int) -> list[int]:
    """Residues whose differences are all residues: the next one added covers most differences not yet covered."""
    cover, missing = [0], set(range(1, period))
    while missing:
        gain = lambda r: len({d for c in cover for d in ((r - c) % period, (c - r) % period)} & missing)
        best = max(range(period), key=lambda r: (gain(r), -r))
        cover.append(best)
        missing -= {d for c in cover for d in ((best - c) % period, (c - best) % period)}
    return sorted(cover)


COVER = np.zeros(PERIOD, dtype=bool)
COVER[difference_cover(PERIOD)] = True
# Places from a residue to the next one of the sample, and to the one before.
AHEAD = np.array([next(k for k in range(PERIOD) if COVER[(r + k) % PERIOD]) for r in range(PERIOD)])
BEHIND = np.array([next(k for k in range(PERIOD) if COVER[(r - k) % PERIOD]) for r in range(PERIOD)])


def dense(*columns: np.ndarray) -> np.ndarray:
    """Ranks of rows in the order of their columns; equal rows have equal ranks."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=np.int64)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def repeated_suffixes(texts: list[bytes], anchors: np.ndarray, counts: np.ndarray, length: int = LENGTH,
                      buckets: np.ndarray | None = None) -> list[np.ndarray]:
    """For runs: which of each run's starts (0 to counts - 1) begin `length` bytes that others of its bucket share.

    A text holds a run's bytes, with its anchor at the given place; without `buckets` all are of one. Texts are laid out
    with their anchors at multiples of the period, so equal suffixes stand at equal residues and reach the sample after
    equally many bytes.
    """
    buckets = np.zeros(len(texts), dtype=np.int64) if buckets is None else buckets
    run = np.repeat(np.arange(len(texts)), counts)
    start = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
    hit = np.zeros(len(run), dtype=bool)
    # Only suffixes that share a slot of a hash with others are sorted.
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    at = (np.cumsum(sizes) - sizes)[run] + start
    apart = mixed(buckets[run].view(np.uint64) + (anchors[run] - start).astype(np.uint64))
    slot = mixed(Hashes(np.frombuffer(b"".join(texts), np.uint8)).of(at, at + length) + apart)
    bits = len(run).bit_length() + 3
    slot = (slot >> np.uint64(64 - bits)).view(np.int64)
    some = np.flatnonzero(np.bincount(slot, minlength=1 << bits)[slot] > 1)
    if not len(some):
        return np.split(hit, np.cumsum(counts)[:-1])
    # Of the runs that have such suffixes the bytes from the first to the last of them.
    run, start = run[some], start[some]
    edge = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    which, low, high = run[edge], start[edge], start[np.append(edge[1:], len(run)) - 1]
    texts = [texts[k][a:b + length] for k, a, b in zip(which.tolist(), low.tolist(), high.tolist())]
    anchors, buckets = anchors[which] - low, buckets[which]
    run = np.repeat(np.arange(len(which)), np.diff(np.append(edge, len(run))))
    start = start - low[run]
    pads = -anchors % PERIOD
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    rooms = -(-(pads + sizes) // PERIOD) * PERIOD + PERIOD
    base = np.cumsum(rooms) - rooms + pads
    flat = np.zeros(rooms.sum() + 8, dtype=np.uint8)
    for b, t in zip(base.tolist(), texts):
        flat[b:b + len(t)] = np.frombuffer(t, np.uint8)
    word = np.zeros(len(flat) - 8, dtype=np.uint64)  # eight bytes from a place, as a number in their order
    for k in range(8):
        word = word << np.uint64(8) | flat[k:k + len(word)]
    # Ranks of the sample: of 32 bytes by sorting, then of twice as many by pairs of ranks, up to 256.
    own = np.zeros(len(word), dtype=np.int32)  # bytes of its text that follow a place
    for b, n in zip(base.tolist(), sizes.tolist()):
        own[b:b + n] = np.arange(n, 0, -1)
    place = np.flatnonzero(COVER[np.arange(len(word)) % PERIOD] & (own >= PERIOD))
    ranks = np.full(len(word), -1, dtype=np.int32)
    ranks[place] = dense(*(word[place + k] for k in range(0, PERIOD, 8)))
    step = PERIOD
    while 2 * step <= length - 2 * PERIOD and step < 256:
        place = place[own[place] >= 2 * step]
        doubled = dense(ranks[place], ranks[place + step])
        ranks = np.full(len(word), -1, dtype=np.int32)
        ranks[place] = doubled
        step *= 2
    # The suffixes, told apart by their distance from the anchor, then by ever further bytes.
    at = base[run] + start
    name = dense(buckets[run], anchors[run] - start, word[at])
    todo = np.arange(len(at))

    def refine(column_of):
        nonlocal todo, name
        column = column_of(at[todo])
        fresh = dense(name, column)
        tied = np.bincount(fresh)[fresh] > 1
        todo, name = todo[tied], fresh[tied]

    tied = np.bincount(name)[name] > 1 if len(name) else np.empty(0, bool)
    todo, name = todo[tied], name[tied]
    first = lambda p: p + AHEAD[p % PERIOD]  # the first sample place; what stands before it is in `head`
    masked = lambda p, n: word[p] & np.where(n >= 8, ~np.uint64(0), ~(~np.uint64(0) >> (np.clip(n, 0, 7) * 8).astype(np.uint64)))
    end = lambda p: p + length
    for k in range(0, PERIOD, 8):
        refine(lambda p: np.where(AHEAD[p % PERIOD] > k, masked(p + k, AHEAD[p % PERIOD] - k), np.uint64(0)))
    covered = 0
    while covered < length - step and covered + step + PERIOD <= length:  # whole ranks one after another
        refine(lambda p: ranks[first(p) + covered])
        covered += step
    # One rank that ends as near to the end as the sample allows, and the bytes behind it.
    last = lambda p: (lambda q: q - BEHIND[q % PERIOD])(end(p) - step)
    refine(lambda p: ranks[last(p)])
    for k in range(0, PERIOD, 8):  # between the two, if they do not meet
        gap = lambda p: last(p) - first(p) - covered - k
        refine(lambda p: np.where(gap(p) > 0, masked(first(p) + covered + k, gap(p)), np.uint64(0)))
    for k in range(0, PERIOD, 8):
        left = lambda p: end(p) - (last(p) + step) - k
        refine(lambda p: np.where(left(p) > 0, masked(np.minimum(last(p) + step + k, len(word) - 1), left(p)), np.uint64(0)))
    hit[some[todo]] = True
    return np.split(hit, np.cumsum(counts)[:-1])


def intervals(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _runs(rows: DataFrame, length: int) -> DataFrame:
    """Runs of every text: rid, first, last (starts), anchor, bucket, whole, times. Runs that are equal within a text are
    one row with their number; a row without a bucket tells of starts repeated within the text."""

    def work(batches):
        for batch in batches:
            at = 0
            for texts in grouped(batch.column(1).to_pylist()):
                parts = []
                for rid, text in zip(batch.column(0).slice(at, len(texts)).to_pylist(), texts):
                    data = np.frombuffer(text, np.uint8)
                    if len(data) < length:
                        continue
                    hashes = Hashes(data)
                    first, last, anchor = window_runs(hashes, len(data), length)
                    bucket = hashes.of(anchor, anchor + 16)
                    whole = mixed(hashes.of(first, last + length) + mixed((anchor - first).astype(np.uint64) + mixed(bucket + (last - first).astype(np.uint64))))
                    _, one, which, times = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
                    more = np.flatnonzero((times > 1)[which])
                    parts.append((np.full(len(one), rid), first[one], last[one], anchor[one], bucket[one], whole[one], times, np.ones(len(one), bool)))
                    if len(more):
                        # Neighbouring runs of them are told in one row.
                        gap = np.flatnonzero(np.append(True, np.diff(more) != 1))
                        a, b = first[more[gap]], last[more[np.append(gap[1:], len(more)) - 1]]
                        none = np.zeros(len(a), np.uint64)
                        parts.append((np.full(len(a), rid), a, b, a, none, none, np.zeros(len(a), np.int64), np.zeros(len(a), bool)))
                at += len(texts)
                if not parts:
                    continue
                rid, first, last, anchor, bucket, whole, times, real = (np.concatenate(c) for c in zip(*parts))
                yield pa.RecordBatch.from_arrays([
                    pa.array(rid, pa.int64()), pa.array(first), pa.array(last), pa.array(anchor),
                    pa.array(bucket.view(np.int64), mask=~real), pa.array(whole.view(np.int64)), pa.array(times),
                ], names=["rid", "first", "last", "anchor", "bucket", "whole", "times"])

    return rows.mapInArrow(work, "rid long, first long, last long, anchor long, bucket long, whole long, times long")


def _with_texts(texts: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """rid, text and the wanted runs of every text that has any."""
    per_text = wanted.groupBy("rid").agg(F.collect_list(F.struct(*columns)).alias("runs"))
    return texts.join(per_text, "rid").select("rid", "text", "runs")


def _pieces(texts: DataFrame, wanted: DataFrame, width: int, length: int) -> DataFrame:
    """The wanted runs cut where the distance from the anchor is a multiple of `width`, with columns as of `_runs`.

    The bucket of a piece is that of its run, its range of distances and the bytes that all suffixes of these distances
    share, so equal suffixes meet again.
    """

    def work(batches):
        for batch in batches:
            for rid, text, runs in zip(batch.column(0), batch.column(1), batch.column(2)):
                first, last, anchor, bucket, times = (runs.values.field(k).to_numpy() for k in range(5))
                hashes = Hashes(np.frombuffer(text.as_py(), np.uint8))
                near, far = anchor - last, anchor - first
                n = far // width - near // width + 1
                run = np.repeat(np.arange(len(n)), n)
                cut = width * ((near // width)[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n))
                anchor, near, far = anchor[run], np.maximum(near[run], cut), np.minimum(far[run], cut + width - 1)
                common = hashes.of(anchor - cut, anchor - cut - width + 1 + length)
                bucket = mixed(common + mixed(bucket[run].view(np.uint64) + mixed(cut.astype(np.uint64) + np.uint64(width << 32))))
                whole = mixed(hashes.of(anchor - far, anchor - near + length) + mixed(far.astype(np.uint64) + mixed(bucket + (far - near).astype(np.uint64))))
                for a in range(0, len(run), 20_000):
                    columns = [np.full(len(run), rid.as_py()), anchor - far, anchor - near, anchor, bucket.view(np.int64), whole.view(np.int64), times[run]]
                    yield pa.RecordBatch.from_arrays([pa.array(c[a:a + 20_000]) for c in columns], names=names)

    names = ["rid", "first", "last", "anchor", "bucket", "whole", "times"]
    joined = _with_texts(texts, wanted, "first", "last", "anchor", "bucket", "times")
    return joined.mapInArrow(work, ", ".join(f"{n} long" for n in names))


def _bytes_of(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted runs: bucket, rid, first, count, lead (anchor's place in them), bytes."""

    def work(batches):
        for batch in batches:
            out = []
            for rid, text, runs in zip(*(c.to_pylist() for c in batch.columns)):
                for r in runs:
                    out.append((r["bucket"], rid, r["first"], r["last"] - r["first"] + 1, r["anchor"] - r["first"], text[r["first"]:r["last"] + length]))
                    if len(out) == 5000:
                        yield _batch(out)
                        out = []
            if out:
                yield _batch(out)

    def _batch(out):
        kinds = [pa.int64()] * 5 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    names = ["bucket", "rid", "first", "count", "lead", "bytes"]
    joined = _with_texts(texts, wanted, "first", "last", "anchor", "bucket")
    return joined.mapInArrow(work, ", ".join(f"{n} {'binary' if n == 'bytes' else 'long'}" for n in names))


def _sorted_buckets(runs: DataFrame, length: int) -> DataFrame:
    """Starts found repeated: rid, first, last."""

    def work(batches):
        key, held, seen, size = None, [], set(), 0

        def flush():
            bucket, rid, at, count, lead = (np.array(c, dtype=np.int64) for c in list(zip(*held))[:5])
            found = repeated_suffixes([h[5] for h in held], lead, count, length, bucket)
            parts = [(k, *intervals(flags)) for k, flags in enumerate(found) if flags.any()]
            if parts:
                run = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
                first, last = (np.concatenate([p[c] for p in parts]) + at[run] for c in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (rid[run], first, last)], names=["rid", "first", "last"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != key:
                    if size >= SORTED_BYTES:
                        yield from flush()
                        held, size = [], 0
                    key, seen = row[0], set()
                if row[1:3] not in seen:  # rows repeated with their ids send a run more than once
                    seen.add(row[1:3])
                    held.append(row)
                    size += len(row[5])
        if held:
            yield from flush()

    dealt = runs.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(work, "rid long, first long, last long")


def repeated_starts(texts: DataFrame, tables: Tables, length: int = LENGTH) -> DataFrame:
    """rid, first, last: ranges of starts whose `length` bytes start elsewhere too. `texts`: rid, text (binary)."""
    found, wanted = None, None
    runs = lambda: _runs(texts, length)
    for width in (max(1, length // 8), max(1, length // 64), 1, None):  # of the pieces of the next turn
        early = Tables(texts.sparkSession, "suffix-runs")
        cut = early.write(runs(), "runs")
        within = cut.where("bucket IS NULL").select("rid", "first", "last")
        real = cut.where("bucket IS NOT NULL")
        kinds = real.groupBy("bucket", "whole").agg(
            F.sum("times").alias("times"), *(F.first(c).alias(c) for c in ("rid", "first", "last", "anchor")))
        kinds = early.write(kinds, "kinds")
        often = kinds.where("times > 1").select("bucket", "whole")
        whole = tables.write(within.union(real.join(often, ["bucket", "whole"]).select("rid", "first", "last")), "whole")
        several = kinds.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("times").alias("least")).where("n > 1 AND least = 1")
        mixed_up = tables.write(kinds.join(several.select("bucket", "n"), "bucket").select(
            "rid", "first", "last", "anchor", "bucket", "times", "n"), "wanted")
        early.drop()
        large = mixed_up.where(F.col("n") > BLOCK)
        last = width is None or large.isEmpty()
        small = mixed_up if last else mixed_up.where(F.col("n") <= BLOCK)
        found, wanted = (whole, small) if found is None else (found.union(whole), wanted.union(small))
        if last:
            break
        runs = lambda large=large, width=width: _pieces(texts, large, width, length)
    return found.union(_sorted_buckets(_bytes_of(texts, wanted, length), length))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), spans of every document.

    `spans` are the maximal runs of removed bytes (start, stop). Matches lie within a document each, and may overlap,
    also with themselves. A null text is empty. Rows repeated are documents of their own, and so lose all that is at
    least `length` bytes long; null ids are kept. A text shorter than `length` loses nothing; an empty table gives an
    empty result.
    """
    tables = Tables(docs.sparkSession, "suffix-dedup")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.encode(whole_text(text_col), "utf-8").alias("text"))
    rows = rows.withColumn("rid", F.xxhash64("doc_id", "text"))
    starts = tables.write(repeated_starts(rows.select("rid", "text"), tables, length), "starts")
    release(docs.sparkSession)
    per_text = starts.groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("starts"))

    def work(batches):
        for batch in batches:
            out = []
            for doc, raw, found in zip(batch.column(0), batch.column(1), batch.column(2)):
                text = raw.as_py()
                edge = np.zeros(len(text) + 1, dtype=np.int32)
                if found.is_valid:
                    first, last = (found.values.field(k).to_numpy() for k in (0, 1))
                    np.add.at(edge, first, 1)
                    np.add.at(edge, last + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                a, b = intervals(gone)
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((doc.as_py(), len(text), int(gone.sum()), len(a), kept, hashlib.sha256(kept).hexdigest(),
                            [{"start": int(x), "stop": int(y) + 1} for x, y in zip(a, b)]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "spans"]
    kinds = [pa.int64()] * 4 + [pa.binary(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
    joined = rows.join(per_text, "rid", "left").select(F.col("doc_id").cast("long"), "text", "starts")
    return joined.mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, "
                                   "spans array<struct<start:bigint,stop:bigint>>")
