"""SentencePiece encoding by vectorised merge rounds, and decoding."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import grouped, whole_text

MARK = "▁"  # stands for a space inside the model
# Ids of words are remembered within a task up to so many words; then the memory starts anew.
REMEMBERED_WORDS = 400_000


class Merger:
    """Merges symbols of words as the model's scores tell.

    Symbols are piece ids; a character without a piece of its own is the number of pieces plus its code point. A word
    is a run of marks and what follows up to the next mark. No piece holds a mark after another character, so merges
    never cross words.
    """

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=model)
        n = self.pieces = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        plain = [not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i)) for i in range(n)]
        bytewise = [i for i in range(n) if self.model.is_byte(i)]
        if any(MARK in p.lstrip(MARK) for p in names) or any(map(self.model.is_unused, range(n))) or len(bytewise) < 256:
            raise ValueError("the model's pieces must stay within words, be in use, and include all bytes")
        ids = {p: i for i, p in enumerate(names) if plain[i]}
        symbol = lambda s: ids.get(s, n + ord(s) if len(s) == 1 else None)
        self.of_char = np.arange(n, n + 0x110000, dtype=np.int64)
        for p, i in ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        score = {i: self.model.get_score(i) for i in ids.values()}
        rank = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        table = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = symbol(p[:k]), symbol(p[k:])
                if a is not None and b is not None:
                    table[self._key(a, b)] = (rank[score[i]], i)
        self.keys = np.array(sorted(table), dtype=np.int64)
        self.rank, self.merged = (np.array([table[k][j] for k in self.keys.tolist()], dtype=np.int64) for j in (0, 1))
        self.never = len(rank)
        # A character that stays without a piece becomes its UTF-8 bytes.
        self.byte = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.limits = [self.model.bos_id(), self.model.eos_id()]

    @staticmethod
    def _key(a, b):
        return a * (1 << 24) + b

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs; `never` where they do not merge."""
        pair = self._key(left, right)
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.rank[at], self.never), self.merged[at]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each word has.

        Every round takes from each word its least rank and merges the pairs that have it, from the left, up to the
        first whose merge makes a pair of the same or a lesser rank: just what merging one pair at a time would do.
        """
        if not words:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        text = "".join(words)
        symbols = self.of_char[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)]
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        rank, into = self.look_up(symbols, np.append(symbols[1:], 0))
        rank[np.append(word[1:] != word[:-1], True)] = self.never
        done = []
        while len(symbols):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(first, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, first), sizes)
            over = least == self.never
            done.append((word[over], symbols[over]))
            hits = self._taken(np.flatnonzero((rank == least) & ~over), symbols, word, rank, into)
            stays = ~over
            stays[hits + 1] = False
            symbols[hits] = into[hits]
            fresh = np.zeros(len(symbols), dtype=bool)
            fresh[hits] = True
            symbols, word, rank, into, fresh = (x[stays] for x in (symbols, word, rank, into, fresh))
            fresh = np.flatnonzero(fresh | np.append(fresh[1:], False))  # pairs that start or end at a merged symbol
            within = np.append(word, -1)[fresh + 1] == word[fresh]
            rank[fresh] = self.never
            fresh = fresh[within]
            rank[fresh], into[fresh] = self.look_up(symbols[fresh], symbols[fresh + 1])
        word, symbols = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        word, symbols = word[order], symbols[order]
        strange = np.flatnonzero(symbols >= self.pieces)
        if len(strange):
            spelled = [[self.byte[b] for b in chr(c).encode()] for c in (symbols[strange] - self.pieces).tolist()]
            times = np.ones(len(symbols), dtype=np.int64)
            times[strange] = [len(s) for s in spelled]
            word, symbols = np.repeat(word, times), np.repeat(symbols, times)
            symbols[symbols >= self.pieces] = list(chain.from_iterable(spelled))
        return symbols.astype(np.uint32), np.bincount(word, minlength=len(words))

    def _taken(self, hits, symbols, word, rank, into):
        """Of the places with a word's least rank, those that merge in this round."""
        if not len(hits):
            return hits
        # Places that overlap: of a run of neighbours every second merges.
        run = np.append(True, np.diff(hits) != 1)
        number = np.arange(len(hits))
        hits = hits[(number - np.maximum.accumulate(np.where(run, number, 0))) % 2 == 0]
        starts = np.append(True, word[hits[1:]] != word[hits[:-1]])
        if starts.all():
            return hits
        merged = symbols.copy()
        merged[hits + 1] = into[hits]  # what stands to the left of the next symbol once the place has merged
        left, right = np.maximum(hits - 1, 0), np.minimum(hits + 2, len(symbols) - 1)
        low = lambda a, b, same: same & (self.look_up(a, b)[0] <= rank[hits])
        stop = low(merged[left], into[hits], (hits > 0) & (word[left] == word[hits])) | low(
            into[hits], symbols[right], (right == hits + 2) & (word[right] == word[hits]))
        before = np.cumsum(stop) - stop
        number = np.arange(len(hits))
        return hits[before == before[np.maximum.accumulate(np.where(starts, number, 0))]]


class Words(dict):
    """Number of every word seen; new words are numbered and kept for the next merge."""

    def __init__(self):
        self.new = []

    def __missing__(self, word):
        self.new.append(word)
        self[word] = len(self)
        return len(self) - 1

    def kept(self, numbers) -> "Words":
        """The words of these ascending numbers, numbered anew in that order."""
        out, names = Words(), list(self)
        out.update((names[k], n) for n, k in enumerate(numbers.tolist()))
        return out


class TextEncoder:
    """Encodes texts, merging only words that it has not seen lately."""

    def __init__(self, model: str):
        self.merger = Merger(model)
        self.split = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        self.forget()

    def forget(self):
        self.known, self.ids, self.starts = Words(), np.empty(0, np.uint32), np.zeros(1, np.int64)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text, with begin and end ids."""
        if len(self.known) > REMEMBERED_WORDS:
            self.forget()
        parts = [self.split(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        counts = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        number = np.fromiter(
            map(self.known.__getitem__, chain.from_iterable(parts)), dtype=np.int64, count=counts.sum())
        if self.known.new:
            more, sizes = self.merger.encode(self.known.new)
            self.known.new = []
            self.ids = np.concatenate([self.ids, more])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        size = np.diff(self.starts)[number]
        bound = np.append(0, np.cumsum(size))
        flat = self.ids[np.arange(bound[-1]) + np.repeat(self.starts[number] - bound[:-1], size)]
        cut = bound[np.append(0, np.cumsum(counts))]
        first, last = (np.array([i] if i >= 0 else [], dtype=np.uint32) for i in self.merger.limits)
        return [np.concatenate([first, flat[a:b], last]).astype("<u4") for a, b in zip(cut[:-1], cut[1:])]


def encode_documents(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None,
) -> DataFrame:
    """Ids and decoded text of every document, one row each; no shuffle.

    `model` is the path of a SentencePiece BPE model that every executor has. Only words that a task has not seen lately
    are merged, all at once in rounds: each round replaces in every word the leftmost pair of the best score, and words
    without a pair leave.

    Returns doc_id, the columns named by `carry`, ids (binary, little-endian unsigned 32-bit, begin and end ids
    included), decoded. A null or empty
    text has the begin and end ids only. Texts of any length are encoded whole; ids that repeat or are null are kept as
    they are; an empty table gives an empty result.
    """
    carry = carry or []
    rows = docs.select(F.col(id_col).alias("doc_id"), *carry, whole_text(text_col).alias("__text"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ["doc_id", *carry])

    def work(batches):
        encode = TextEncoder(model)
        for batch in batches:
            at = 0
            for texts in grouped(batch.column(len(carry) + 1).to_pylist()):
                pieces = encode(texts)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(k).slice(at, len(texts)) for k in range(len(carry) + 1)),
                    pa.array([p.tobytes() for p in pieces], pa.binary()),
                    pa.array([encode.merger.model.decode(p.tolist()) for p in pieces], pa.string()),
                ], names=["doc_id", *carry, "ids", "decoded"])
                at += len(texts)

    return rows.mapInArrow(work, f"{kinds}, ids binary, decoded string")
