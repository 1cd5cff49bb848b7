"""Runs of words that repeat with a period, found by a suffix automaton and accesses to its link tree."""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import grouped, whole_text

# What counts as a run. It is at least so many words long and so many times as long as its period.
LEAST_LENGTH = 24
LEAST_TIMES = 3
# All but the last period of a run are at least so many words, so each window of this size within a run comes twice.
WINDOW = LEAST_LENGTH * (LEAST_TIMES - 1) // LEAST_TIMES

_word = re.compile("[^\x20\x09-\x0D]+")

Run = tuple[int, int, int]  # start, length, period


def suffix_automaton(word: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """Of every state its longest length and its link, and the state of every prefix. State 0 is the root."""
    length, link, step = [0], [-1], [{}]
    states, last = [], 0
    for i, w in enumerate(word):
        new = len(length)
        length.append(i + 1)
        link.append(0)
        step.append({})
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p >= 0:
            q = step[p][w]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                half = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                step.append(step[q].copy())
                while p >= 0 and step[p].get(w) == q:
                    step[p][w] = half
                    p = link[p]
                link[q] = link[new] = half
        states.append(new)
        last = new
    return length, link, states


def chains(length: list[int], link: list[int]) -> list[int]:
    """The head of each state's chain: a state's largest child goes on with its chain, the others start their own."""
    down = sorted(range(1, len(length)), key=length.__getitem__, reverse=True)
    size = [1] * len(length)
    heavy = [0] * len(length)
    for s in down:
        p = link[s]
        size[p] += size[s]
        if not heavy[p] or size[s] > size[heavy[p]]:
            heavy[p] = s
    head = list(range(len(length)))
    for s in reversed(down):
        if heavy[link[s]] == s:
            head[s] = head[link[s]]
    return head


def runs_of(word: Sequence[int]) -> list[Run]:
    """All runs of `word` by start, then period.

    The words are appended one by one. An access colours the path from the prefix's state to the root with the
    prefix's end; before, each segment of one colour on that path says where the suffixes that end in it came last. A
    segment whose deepest state is `deep` long and whose end lies d words back makes a repeat of period d that is
    deep + d words long and cannot start earlier: a square as soon as deep >= d. The last end a repeat is seen with
    makes it a run. A smaller period would give a nearer end, so d is the smallest.

    Segments lie as stacks on the heavy chains of the finished tree, the one at the chain's head on top: the same
    segments that a link-cut tree keeps as preferred paths, without the rotations that only a changing tree needs.
    """
    length, link, states = suffix_automaton(word)
    head = chains(length, link)
    stacks: dict[int, list[tuple[int, int]]] = {}
    ends: dict[tuple[int, int], int] = {}
    for i, state in enumerate(states):
        seen = -1
        while state > 0:
            top = head[state]
            deep = length[state]
            stack = stacks.get(top)
            if stack is None:
                stacks[top] = [(deep, i)]
            else:
                covered = []
                while stack and stack[-1][0] <= deep:
                    covered.append(stack.pop())
                if stack and (not covered or covered[-1][0] < deep):  # the next segment reaches up to here
                    covered.append((deep, stack[-1][1]))
                while covered:
                    at, end = covered.pop()
                    if end != seen:  # else a part, nearer to the root, of a segment seen in the chain below
                        seen = end
                        if at >= (LEAST_TIMES - 1) * (i - end):
                            ends[end - at + 1, i - end] = i
                stack.append((deep, i))
            state = link[top]
    found = [(start, i - start + 1, period) for (start, period), i in ends.items()]
    return sorted((r for r in found if r[1] >= LEAST_LENGTH), key=lambda r: (r[0], r[2]))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def stretches(ids: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Start and end of the stretches that can hold a run; `piece` numbers the words' texts.

    Every window of WINDOW words in a run comes again one period on or back, within the run. So words that no window
    covers that is repeated within its stretch are no part of any run, and a run lies in one stretch, whole. Windows
    are compared by hashes; unequal ones with equal hashes only keep more words.
    """
    none = np.empty((0, 2), np.int64)
    if len(ids) < WINDOW:
        return none
    window = _mix(ids.astype(np.uint64) + np.uint64(1))
    width = 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        window = _mix(window[:-step] * np.uint64(0xD6E8FEB86659FD93) + window[step:])
        width += step
    at = np.flatnonzero(piece[:len(window)] == piece[WINDOW - 1:])
    while len(at):
        key = window[at] ^ _mix(piece[at].astype(np.uint64) + np.uint64(7))
        order = np.argsort(key)
        same = np.diff(key[order]) == 0
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        settled = twice.all()
        at = at[twice]
        edges = np.bincount(at, minlength=len(ids) + 1) - np.bincount(at + WINDOW, minlength=len(ids) + 1)
        inside = np.cumsum(edges[:-1]) > 0
        starts = inside & ~(np.append(False, inside[:-1]) & np.append(True, piece[1:] == piece[:-1]))
        if settled:
            ends = inside & ~(np.append(inside[1:], False) & np.append(piece[1:] == piece[:-1], True))
            bounds = np.stack([np.flatnonzero(starts), np.flatnonzero(ends) + 1], axis=1)
            return bounds[bounds[:, 1] - bounds[:, 0] >= LEAST_LENGTH]
        piece = np.cumsum(starts)
    return none


def runs_of_texts(texts: Sequence[list[str]]) -> list[list[Run]]:
    """The runs of every text, given as its words."""
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for words in texts for w in words), dtype=np.int64)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    first = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(texts)), sizes)
    found: list[list[Run]] = [[] for _ in texts]
    for a, b in stretches(ids, text).tolist():
        of = int(text[a])
        shift = a - int(first[of])
        found[of] += [(start + shift, n, period) for start, n, period in runs_of(ids[a:b].tolist())]
    return found


def repeated_tail(words: list[str], key: str | None) -> list[str]:
    """The words, their tail made periodic in one text of ten, as the crc32 of the text's id tells."""
    h = zlib.crc32(key.encode()) if key is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def collapse(words: list[str], runs: list[Run]) -> list[str]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    kept, at = [], 0
    for a, b in sorted((start + period, start + n) for start, n, period in runs):
        if b > at:
            kept += words[at:max(a, at)]
            at = b
    return kept + words[at:]


COLUMNS = [
    ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
    ("exponent_milli", pa.int64()), ("runs", pa.list_(pa.struct(
        [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string()),
]
KINDS = ("n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
         "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False) -> DataFrame:
    """The runs of every text and the text with each run cut to its first period; no shuffle.

    A run is a longest stretch of consecutive words whose smallest period is q, at least LEAST_LENGTH words and
    LEAST_TIMES * q long. `planted` makes the tails of some texts periodic first (`repeated_tail`), by their ids.

    Returns doc_id, n_runs, start, length, period, exponent_milli (of the run with the greatest length / period; of
    equals the first to start, then the one of the smaller period; null without runs), runs (array of start, length,
    period) and collapsed (the words that stay, joined by one space). A null, empty or blank text has no words and no
    runs. A null id has no planted tail; repeated ids are rows of their own. Long texts are searched whole; the
    automaton's memory follows the longest repetitive stretch. Other columns, of any name, are left out; an empty
    table gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("__key"), whole_text(text_col).alias("__text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def row_of(words: list[str], runs: list[Run]) -> tuple:
        best = (None,) * 4
        if runs:
            start, n, period = runs[0]
            for s, m, q in runs[1:]:  # by start, then period: only a greater exponent takes over
                if m * period > n * q:
                    start, n, period = s, m, q
            best = start, n, period, 1000 * n // period
        said = [dict(zip(("start", "length", "period"), r)) for r in runs]
        return len(runs), *best, said, " ".join(collapse(words, runs))

    def work(batches):
        for batch in batches:
            at = 0
            keys = batch.column(1).to_pylist()
            for texts in grouped(batch.column(2).to_pylist()):
                words = [
                    repeated_tail(found, key) if planted else found
                    for found, key in zip(map(_word.findall, texts), keys[at:at + len(texts)])]
                made = zip(*map(row_of, words, runs_of_texts(words)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), *(pa.array(v, t) for v, (_, t) in zip(made, COLUMNS))],
                    names=["doc_id", *(c for c, _ in COLUMNS)])
                at += len(texts)

    return rows.mapInArrow(work, f"doc_id {kind}, {KINDS}")


def digests(found: DataFrame) -> DataFrame:
    """Digests of the runs and of the collapsed text in place of them."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumns({
        "runs_sha256": F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.col("n_runs") > 0, "\n").otherwise("")), 256),
        "collapsed_sha256": F.sha2("collapsed", 256),
    }).drop("runs", "collapsed")
