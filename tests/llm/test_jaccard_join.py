import random

import numpy as np
import pytest

from pulsegrid.llm import jaccard_join as jj
from pulsegrid.llm.shingles import word_hashes
from tests_llm_data import documents


def brute(rows):
    sets = {}
    for i, text in rows:
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
            {ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
        sets[i] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_linked_sets_share_a_key():
    pick = np.random.default_rng(5)
    for n in [*range(1, 70), 90, 150, 333, 1000, 2500]:
        for _ in range(25 if n < 70 else 5):
            x = np.unique(pick.integers(0, 2**64, n, dtype=np.uint64))
            # The furthest linked set: lose some, gain some.
            lose = int(pick.integers(0, n // 5 + 1))
            gain = max(0, (len(x) - lose) * 100 // 80 - len(x))
            gain = int(pick.integers(max(0, gain - 1), gain + 1))
            y = np.unique(np.append(pick.permutation(x)[lose:], pick.integers(0, 2**64, gain, dtype=np.uint64)))
            both = len(np.intersect1d(x, y))
            assert jj.linked(both, len(x), len(y)) or gain
            if jj.linked(both, len(x), len(y)):
                assert len(np.intersect1d(jj.keys_of(x), jj.keys_of(y))), (n, lose, gain)


def test_classes_of_linked_sizes_are_neighbours():
    for n in range(1, 20_000):
        assert jj.size_class(n * 100 // 80) - jj.size_class(n) <= 1


def test_awkward_documents(spark):
    docs = documents(spark)
    assert result(jj.similar_documents(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("chunk,pivots", [(jj.CHUNK, jj.MOST_PIVOTS), (5, 3)])
def test_groups_of_near_copies(spark, monkeypatch, chunk, pivots):
    """Chains, stars and near misses around a few texts, with a passage that most share; large groups go in rounds."""
    monkeypatch.setattr(jj, "CHUNK", chunk)
    monkeypatch.setattr(jj, "MOST_PIVOTS", pivots)
    pick = random.Random(11)
    word = lambda: "".join(pick.choices("abcdefg", k=4))
    passage = " ".join(word() for _ in range(20))
    rows = []
    for _ in range(8):
        base = [word() for _ in range(pick.choice([6, 12, 40, 130, 400]))]
        for _ in range(25):
            text = list(base)
            for _ in range(pick.randrange(0, max(2, len(base) // 18))):
                text[pick.randrange(len(text))] = word()
            if pick.random() < 0.3:
                base = text  # drift: links in chains
            rows.append((len(rows), " ".join(text) + (" " + passage if pick.random() < 0.5 else "")))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert result(jj.similar_documents(docs)) == want
    kept = jj.keep_one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_null_ids_and_empty_table(spark):
    rows = [(None, "a b c d e f g h"), (4, "a b c d e f g h"), (None, None), (7, ""), (None, "x y"), (9, "X y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jj.similar_documents(docs).collect()), key=str)
    assert got == sorted([(None, 4, 4), (4, 4, 4), (None, 0, None), (7, 0, 7), (None, 1, 9), (9, 1, 9)], key=str)
    assert jj.similar_documents(docs.limit(0)).count() == 0


def test_long_words(spark):
    """Words that differ in a regular way: a sequence that balances all powers, its complement, and near ones."""
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    other = thue.translate({97: "b", 98: "a"})
    words = [thue[:1024], other[:1024], thue, other, thue[:1023], "a" * 1024, "a" * 1025, "ab" * 512, "ba" * 512, thue[::-1][1:]]
    rows = [(i, w) for i, w in enumerate(words)] + [(20 + i, " ".join([w] * 2 + ["x"] * 4)) for i, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(jj.similar_documents(docs)) == brute(rows)
    hashes, _ = word_hashes([w.encode() for w in words])
    assert len(set(hashes.tolist())) == len(words)
