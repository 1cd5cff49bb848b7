"""Token counts by merging byte pairs off a heap, without making any ids."""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import kept_by_worker, whole_text

MARK = "▁"  # stands for a space inside the model
# A worker remembers the counts of words up to so many characters in all; then its memory starts anew.
REMEMBERED_CHARS = 16_000_000
# Longer words are counted anew each time.
LONGEST_REMEMBERED = 64
# Texts are split into words in pieces of about so many characters.
PIECE_CHARS = 1_000_000


class PairCounter:
    """How many tokens a word has: its first symbols less its merges.

    A word is a run of marks and what follows up to the next mark. A character without a piece counts as its bytes
    unless it merges, which it cannot, since no piece holds it.
    """

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        pieces = SentencePieceProcessor(model_file=model)
        every = range(pieces.get_piece_size())
        if any(pieces.is_unused(i) for i in every) or sum(pieces.is_byte(i) for i in every) < 256:
            raise ValueError("the model's pieces must be in use and include all bytes")
        plain = [i for i in every if not (pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_byte(i))]
        score = {pieces.id_to_piece(i): pieces.get_score(i) for i in plain}
        if any(MARK in piece.lstrip(MARK) for piece in score):
            raise ValueError("the model's pieces must stay within words")
        place = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {piece: place[s] for piece, s in score.items()}
        self.counts: dict[str, int] = {}
        self.held = 0

    def count(self, word: str) -> int:
        """Merges the adjacent pair of the lowest rank, the leftmost of equals, until no pair is a piece."""
        rank = self.rank
        symbols = list(word)
        n = len(symbols)
        total = sum(1 if c in rank else len(c.encode()) for c in symbols)
        after = list(range(1, n + 1))  # the linked list: the next and the previous symbol that still stand
        before = list(range(-1, n - 1))
        heap = [(rank[pair], i, pair) for i, pair in enumerate(map(str.__add__, symbols, symbols[1:])) if pair in rank]
        heapify(heap)
        while heap:
            _, i, pair = heappop(heap)
            j = after[i]
            # A symbol that was merged away is empty; an entry whose pair has changed since is out of date.
            if j >= n or not symbols[i] or len(symbols[i]) + len(symbols[j]) != len(pair):
                continue
            symbols[i], symbols[j] = pair, ""
            total -= 1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                longer = pair + symbols[j]
                if longer in rank:
                    heappush(heap, (rank[longer], i, longer))
            h = before[i]
            if h >= 0:
                longer = symbols[h] + pair
                if longer in rank:
                    heappush(heap, (rank[longer], h, longer))
        return total

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if self.held > REMEMBERED_CHARS:
            self.counts.clear()
            self.held = 0
        known, total = self.counts, 0
        for words in words_of(text):
            for word in words:
                n = known.get(word)
                if n is None:
                    n = self.count(word)
                    if len(word) <= LONGEST_REMEMBERED:
                        known[word] = n
                        self.held += len(word)
                total += n
        return total


_word = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def words_of(text: str) -> Iterator[list[str]]:
    """The words of a text with its mark in front, some at a time."""
    marked = MARK + text.replace(" ", MARK)
    start = 0
    while start < len(marked):
        end = start + PIECE_CHARS
        # A piece ends before a run of marks; a word longer than a piece stays whole.
        while end < len(marked) and (marked[end] != MARK or marked[end - 1] == MARK):
            end = marked.find(MARK, end + 1)
            if end < 0:
                end = len(marked)
        yield _word.findall(marked, start, end)
        start = end


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Bytes and tokens of every text, and whether it has more tokens than `limit`; no shuffle.

    `model` is the path of a SentencePiece BPE model with byte fallback that every executor has. Begin and end ids are
    not counted. Words are counted by a heap over their adjacent pairs and a linked list of symbols, and remembered by
    the worker within a bound.

    Returns doc_id, n_bytes, n_tokens, over_limit. A null or empty text has no bytes and no tokens; a very long text is
    counted whole, piece by piece; rows whose ids repeat or are null stay as they are; other columns, of any name, are
    left out; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("__text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batches):
        count = kept_by_worker(("pair counter", model), lambda: PairCounter(model))
        for batch in batches:
            texts = batch.column(1)
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([len(t.as_py().encode()) for t in texts], pa.int64()),
                pa.array([count(t.as_py()) for t in texts], pa.int64()),
            ], names=["doc_id", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(work, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
