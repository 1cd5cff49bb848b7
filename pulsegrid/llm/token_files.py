"""Token ids in files of grammar-compressed blocks.

Documents are dealt out by ranges of their ids; each range is a shard, a run of blocks in ascending order. Inside a block
pairs of neighbouring ids that occur often become nonterminals, round by round, as Re-Pair does, several pairs a round.
A block's payload is:

    magic (4 bytes), counts of terminals, rules, symbols, documents (4 x u4), width (u4: bytes of a symbol),
    rules (2 x u4 each), expansion lengths of the rules (u4), symbols (u2 or u4), ends of the documents in symbols (u4)

all little-endian. No rule crosses a document's end, so a document is its own run of symbols; the expansion lengths find
any token of a block without decoding what stands before it.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain
from itertools import compress as compress_by

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.sentencepieces import REMEMBERED_WORDS, Words
from pulsegrid.llm.shared import Tables, grouped, kept_by_worker, whole_text

MAGIC = b"RPG1"
BLOCK_TOKENS = 500_000  # a block ends with the document that reaches so many
LEAST_COUNT = 24  # a pair is replaced if a block has it so often
PAIRS_A_ROUND = 8192
LEAST_GAIN = 0.01  # of the symbols, that a round must save for another to follow
TABLE_BITS = 19
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


class WordEncoder:
    """Ids of texts by a tokenizers file whose pre-tokenizer ends tokens at white space.

    Texts are cut at the six ASCII separators, and each different word is encoded once by the library.
    """

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.end = Tokenizer.from_file(path), end
        self.size = self.library.get_vocab_size()
        self.ends_word = np.zeros(self.size, dtype=bool)
        self.ends_word[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True
        self.words, self.parts, self.uses = Words(), Words(), np.empty(0, np.int64)
        self.of_words, self.of_parts = Runs(np.int64), Runs(np.uint32)

    def forget(self):
        """Keeps the words that came more than once, at most half of what may be remembered, and their parts."""
        kept = np.flatnonzero(self.uses > 1)
        kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[:REMEMBERED_WORDS // 2]])
        parts, bound = self.of_words.take(kept)
        used, numbers = np.unique(parts, return_inverse=True)
        ids, ends = self.of_parts.take(used)
        self.words, self.parts = self.words.kept(kept), self.parts.kept(used)
        self.of_words, self.of_parts = Runs(np.int64), Runs(np.uint32)
        self.of_words.add(numbers, np.diff(bound))
        self.of_parts.add(ids, np.diff(ends))
        self.uses = self.uses[kept] // 2

    def learn(self, words: list[bytes]):
        """Remembers the parts of new words, and the ids of new parts.

        A word is cut before the ASCII marks at its end if a Latin letter stands there, as the pre-tokenizer does. Parts
        of Latin letters only are one token group each, whose last id ends a word, so they are encoded in one go; the
        rest one by one."""
        parts, numbers, sizes = self.parts, [], []
        for w in words:
            core = w if b"<|" in w else w.rstrip(MARKS)
            if 0 < len(core) < len(w) and 97 <= core[-1] <= 122:
                numbers += parts[core], parts[w[len(core):]]
                sizes.append(2)
            else:
                numbers.append(parts[w])
                sizes.append(1)
        self.of_words.add(np.array(numbers, dtype=np.int64), np.array(sizes))
        texts, parts.new = [p.decode() for p in parts.new], []
        plain = np.array([t.isalpha() and max(t) < "\u0250" and t == t.lower() for t in texts], dtype=bool)
        # Without offsets into the text, which cost the library more than the ids.
        joined, = self.library.encode_batch_fast([" ".join(compress_by(texts, plain))], add_special_tokens=False)
        coded = np.array(joined.ids, dtype=np.uint32)
        ends = np.append(0, np.flatnonzero(self.ends_word[coded]) + 1)
        if len(ends) - 1 != plain.sum():
            raise ValueError("the vocabulary does not mark the ends of words")
        odd = [e.ids for e in self.library.encode_batch_fast(list(compress_by(texts, ~plain)), add_special_tokens=False)]
        size = np.empty(len(texts), dtype=np.int64)
        size[plain], size[~plain] = np.diff(ends), list(map(len, odd))
        flat = np.empty(size.sum(), dtype=np.uint32)
        by_plain = np.repeat(plain, size)
        flat[by_plain], flat[~by_plain] = coded, list(chain.from_iterable(odd))
        self.of_parts.add(flat, size)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, each text followed by the end id, and the sizes."""
        if len(self.words) > REMEMBERED_WORDS:
            self.forget()
        # The vocabulary is lower case. A text with what may be a special token is left to the library as it is.
        words = [(t if b"<|" in t else t.lower()).split() for t in texts]
        counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        number = np.fromiter(map(self.words.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=counts.sum())
        self.uses = np.append(self.uses, np.zeros(len(self.words) - len(self.uses), np.int64))
        self.uses += np.bincount(number, minlength=len(self.uses))
        if self.words.new:
            new, self.words.new = self.words.new, []
            self.learn(new)
        number, bound = self.of_words.take(number)
        cut = bound[np.append(0, np.cumsum(counts))]
        flat, bound = self.of_parts.take(number)
        sizes = np.diff(bound[cut])
        return np.insert(flat, np.cumsum(sizes), np.uint32(self.end)), sizes + 1


class Runs:
    """Runs of numbers one after another, taken by their places."""

    def __init__(self, kind):
        self.flat, self.starts = np.empty(0, kind), np.zeros(1, np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat = np.concatenate([self.flat, flat])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])

    def take(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of these numbers, joined, and their bounds."""
        size = self.starts[number + 1] - self.starts[number]
        bound = np.append(0, np.cumsum(size))
        return self.flat[np.arange(bound[-1]) + np.repeat(self.starts[number] - bound[:-1], size)], bound


def compress(ids: np.ndarray, sizes: np.ndarray, terminals: int) -> bytes:
    """A block's payload. `sizes` are the tokens of each document, at least one."""
    x = ids.astype(np.uint64)
    last = np.zeros(len(x), dtype=bool)
    last[np.cumsum(sizes) - 1] = True
    rules, lengths = [], [np.ones(terminals, dtype=np.int64)]
    total = terminals
    while len(x) > 1:
        pair = x[:-1] << np.uint64(32) | x[1:]
        slot = ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).view(np.int64)
        # A frequent pair makes a frequent slot, so only pairs of such slots need to be sorted and counted.
        often = (np.bincount(slot, minlength=1 << TABLE_BITS) >= LEAST_COUNT)[slot] & ~last[:-1]
        at = np.flatnonzero(often)
        seen = pair[at]
        kinds, count = np.unique(seen, return_counts=True)
        best = np.argsort(-count, kind="stable")[:PAIRS_A_ROUND]
        best = best[count[best] >= LEAST_COUNT]
        if not len(best):
            break
        rank_of = np.argsort(best)
        ordered = kinds[best[rank_of]]
        place = np.minimum(np.searchsorted(ordered, seen), len(ordered) - 1)
        hit = ordered[place] == seen
        order = np.full(len(x) + 1, len(best), dtype=np.int32)
        order[at[hit] + 1] = rank_of[place[hit]]
        # Of pairs that overlap the more frequent is replaced, of equal ones the first.
        here = order[1:-1]
        chosen = np.flatnonzero((here < len(best)) & (here < order[:-2]) & (here <= order[2:]))
        used = np.bincount(here[chosen], minlength=len(best))
        good = np.flatnonzero(used >= 4)
        if not len(good):
            break
        number = np.full(len(best), -1, dtype=np.int64)
        number[good] = total + np.arange(len(good))
        chosen = chosen[number[here[chosen]] >= 0]
        pairs = kinds[best[good]]
        rules.append(np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], axis=1))
        known = np.concatenate(lengths)
        lengths.append(known[rules[-1][:, 0].astype(np.int64)] + known[rules[-1][:, 1].astype(np.int64)])
        total += len(good)
        x[chosen] = number[here[chosen]]
        last[chosen] = last[chosen + 1]
        keep = np.ones(len(x), dtype=bool)
        keep[chosen + 1] = False
        x, last = x[keep], last[keep]
        if len(chosen) < LEAST_GAIN * len(x):
            break
    rules = np.concatenate(rules) if rules else np.empty((0, 2))
    width = 2 if total <= 1 << 16 else 4
    head = np.array([terminals, len(rules), len(x), len(sizes), width], dtype="<u4")
    return b"".join([MAGIC, head.tobytes(), rules.astype("<u4").tobytes(), np.concatenate(lengths)[terminals:].astype("<u4").tobytes(),
                     x.astype(f"<u{width}").tobytes(), (np.flatnonzero(last) + 1).astype("<u4").tobytes()])


class Block:
    """Reads a payload."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token block")
        self.terminals, rules, symbols, docs, width = (int(v) for v in np.frombuffer(payload, "<u4", 5, 4))
        at = 24
        self.rules = np.frombuffer(payload, "<u4", 2 * rules, at).reshape(-1, 2)
        self.lengths = np.frombuffer(payload, "<u4", rules, at + 8 * rules)
        self.symbols = np.frombuffer(payload, f"<u{width}", symbols, at + 12 * rules).astype(np.uint32)
        self.ends = np.frombuffer(payload, "<u4", docs, at + 12 * rules + width * symbols).astype(np.int64)

    def _expand(self, x: np.ndarray) -> np.ndarray:
        while len(big := np.flatnonzero(x >= self.terminals)):
            times = np.ones(len(x), dtype=np.int64)
            times[big] = 2
            first = np.cumsum(times)[big] - 2
            pair = self.rules[x[big] - self.terminals]
            x = np.repeat(x, times)
            x[first], x[first + 1] = pair[:, 0], pair[:, 1]
        return x

    def sizes(self) -> np.ndarray:
        """Tokens that every symbol stands for."""
        out = np.ones(len(self.symbols), dtype=np.int64)
        big = self.symbols >= self.terminals
        out[big] = self.lengths[self.symbols[big] - self.terminals]
        return out

    def document(self, k: int) -> np.ndarray:
        return self._expand(self.symbols[(self.ends[k - 1] if k else 0):self.ends[k]])

    def tokens(self, first: int, stop: int) -> np.ndarray:
        """Tokens first to stop - 1 of the block; only symbols that stand for some of them are expanded."""
        bound = np.append(0, np.cumsum(self.sizes()))
        a, b = np.searchsorted(bound, first, side="right") - 1, np.searchsorted(bound, stop)
        return self._expand(self.symbols[a:b])[first - bound[a]:stop - bound[a]]

    def documents(self) -> list[np.ndarray]:
        cut = np.cumsum(self.sizes())[self.ends - 1]
        return np.split(self._expand(self.symbols), cut[:-1])


def write_documents(docs: DataFrame, vocabulary: str, tables: Tables, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and writes all documents; gives the written blocks: shard, block, doc_ids, n_tokens, payload.

    One shuffle brings the texts into ascending ranges of ids. A task holds one block at a time. Ids that are null come
    first; repeated ids stand in order of their texts. Null and empty texts are the end id alone.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(whole_text(text_col), "utf-8").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ranged = ranged.withColumn("shard", F.spark_partition_id())

    def work(batches):
        encode = kept_by_worker((WordEncoder.__name__, vocabulary, end), lambda: WordEncoder(vocabulary, end))
        held, block = [], 0

        def flush(shard):
            nonlocal held, block
            ids, flat, sizes = [x for h in held for x in h[0]], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            held, block = [], block + 1
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([block - 1], pa.int32()), pa.array([ids], pa.list_(pa.int64())),
                pa.array([len(flat)], pa.int64()), pa.array([compress(flat, sizes, encode.size)], pa.binary()),
            ], names=["shard", "block", "doc_ids", "n_tokens", "payload"])

        shard = 0
        for batch in batches:
            ids, shard, at = batch.column(0).to_pylist(), batch.column(2)[0].as_py() if len(batch) else shard, 0
            for texts in grouped(batch.column(1).to_pylist()):
                held.append((ids[at:at + len(texts)], *encode(texts)))
                at += len(texts)
                if sum(len(h[1]) for h in held) >= BLOCK_TOKENS:
                    yield flush(shard)
        if held:
            yield flush(shard)

    return tables.write(ranged.select("doc_id", "text", "shard").mapInArrow(
        work, "shard int, block int, doc_ids array<long>, n_tokens long, payload binary"), "tokens")


def read_documents(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian u4) of every document in written blocks, by random access or
    not. `start` counts the ids of all documents before it: sums per shard and block are brought together, no rows."""
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.select("shard", "block", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = sizes.join(shards, "shard").select(
        "shard", "block", (F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)) + F.col("offset")).alias("first"))

    def work(batches):
        for batch in batches:
            for shard, number, ids, payload in zip(*batch.columns):
                texts = Block(payload.as_py()).documents()
                sizes = np.array([len(t) for t in texts], dtype=np.int64)
                n = len(texts)
                for a in range(0, n, 1000):
                    some = texts[a:a + 1000]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([shard.as_py()] * len(some), pa.int32()), pa.array([number.as_py()] * len(some), pa.int32()),
                        ids.values[a:a + 1000], pa.array((np.cumsum(sizes) - sizes)[a:a + 1000]), pa.array(sizes[a:a + 1000]),
                        pa.array([t.astype("<u4").tobytes() for t in some], pa.binary()),
                        pa.array([zlib.crc32(t.astype("<u4").tobytes()) for t in some], pa.int64()),
                    ], names=["shard", "block", "doc_id", "at", "n_tokens", "ids", "ids_crc32"])

    read = blocks.select("shard", "block", "doc_ids", "payload").mapInArrow(
        work, "shard int, block int, doc_id long, at long, n_tokens long, ids binary, ids_crc32 long")
    return read.join(placed, ["shard", "block"]).select(
        "doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids", "ids_crc32")
