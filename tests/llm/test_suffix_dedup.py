import hashlib
import random
from collections import Counter

import numpy as np

from pulsegrid.llm import suffix_dedup as sd
from pulsegrid.llm.anchors import Hashes, window_runs
from tests_llm_data import documents


def brute(texts, length):
    """Per text: covered bytes as flags."""
    count = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        out.append(gone)
    return out


def spans(gone):
    return sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))


def test_difference_cover():
    for v in (4, 16, 32, 64):
        cover = sd.difference_cover(v)
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_runs_cover_all_starts_and_depend_on_content():
    pick = np.random.default_rng(3)
    text = pick.integers(97, 101, 3000).astype(np.uint8)
    first, last, anchor = window_runs(Hashes(text), 3000, 400, piece=700)
    whole = window_runs(Hashes(text), 3000, 400)
    assert first[0] == 0 and last[-1] == 2600 and (first[1:] == last[:-1] + 1).all()
    places = lambda f, l, a: np.repeat(a, l - f + 1)
    assert (places(first, last, anchor) == places(*whole)).all()
    moved = window_runs(Hashes(text[500:]), 2500, 400)
    assert (places(*moved) == places(*whole)[500:] - 500).all()


def test_suffix_classes():
    pick = random.Random(9)
    for length in (400, 301):
        texts, anchors, counts = [], [], []
        common = bytes(pick.choices(b"ab", k=1200))
        for _ in range(40):
            n = pick.randrange(1, 200)
            a = pick.randrange(0, 1200 - length - n)
            t = bytearray(common[a:a + length + n - 1])
            if pick.random() < 0.7:
                t[pick.randrange(len(t))] ^= 1
            texts.append(bytes(t))
            anchors.append(600 - a if pick.random() < 0.9 else 601 - a)  # the bucket's anchor is place 600 of the common text
            counts.append(n)
        got = sd.repeated_suffixes(texts, np.array(anchors), np.array(counts), length)
        all_ = Counter((anchors[k] - i, texts[k][i:i + length]) for k in range(40) for i in range(counts[k]))
        for k in range(40):
            assert got[k].tolist() == [all_[anchors[k] - i, texts[k][i:i + length]] > 1 for i in range(counts[k])]


def compare(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in sd.remove_repeats(docs).collect()}
    assert len(got) == len(rows)
    texts = [(t or "").encode() for _, t in rows]
    for (i, _), t, gone in zip(rows, texts, brute(texts, 400)):
        kept = bytes(b for b, g in zip(t, gone) if not g)
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(t), sum(gone), spans(gone)), i
        assert bytes(r.kept) == kept and r.kept_sha256 == hashlib.sha256(kept).hexdigest()
        assert [(x.start, x.stop) for x in r.spans] == [(a, b + 1) for a, b in zip(*map(list, sd.intervals(np.array(gone, bool))))]


def test_documents(spark):
    pick = random.Random(2)
    rows = [(r.doc_id, r.text) for r in documents(spark).collect() if len(r.text or "") < 6000]
    passage = "".join(pick.choices("abcdefgh é", k=900))
    rows += [(10**7 + k, "".join(pick.choices("xyz ", k=pick.randrange(300))) + passage[k % 7:900 - 11 * (k % 5)]
              + "".join(pick.choices("xyz ", k=pick.randrange(300)))) for k in range(60)]
    rows += [(2 * 10**7, "a" * 1000), (2 * 10**7 + 1, "ab" * 600), (2 * 10**7 + 2, "abc" * 133), (2 * 10**7 + 3, "q" * 400), (2 * 10**7 + 4, passage * 2)]
    compare(spark, rows)


def test_large_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK", 5)
    pick = random.Random(7)
    passage = "".join(pick.choices("abcdefgh ", k=700))
    rows = [(k, "".join(pick.choices("xyz ", k=100 + k)) + passage[k % 3 * 40:] + "".join(pick.choices("uvw", k=150))) for k in range(40)]
    compare(spark, rows)


def near_copies(n):
    """Rows of one text that differ in one byte each, at any place."""
    pick = random.Random(11)
    text = "".join(pick.choices("abcdefgh ", k=1200))
    places = [pick.randrange(1200) for _ in range(n)]
    return [(k, text[:p] + chr(65 + k % 26) + text[p + 1:]) for k, p in enumerate(places)]


def test_large_buckets_make_no_row_a_suffix(spark, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK", 20)
    most, write = [], sd.Tables.write

    def counted(self, df, name):
        out = write(self, df, name)
        most.append(out.count())
        return out

    monkeypatch.setattr(sd.Tables, "write", counted)
    rows = near_copies(80)
    compare(spark, rows)
    assert max(most) < 80 * 40, most  # a text has 801 suffixes


def test_large_buckets_cut_to_single_suffixes(spark, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK", 1)
    pick = random.Random(5)
    compare(spark, near_copies(12) + [(100 + k, "".join(pick.choices("ab", k=20)) + "q" * pick.randrange(400, 900)) for k in range(8)])


def test_suffixes_of_several_buckets_at_once():
    text = bytes(random.Random(4).choices(b"abcd", k=500))
    other = text[:450] + b"X" + text[451:]
    got = sd.repeated_suffixes([text, text, other, text], np.array([90, 90, 90, 90]), np.array([80] * 4), 400, np.array([1, 2, 1, 3]))
    assert got[0].tolist() == got[2].tolist() == [k <= 50 for k in range(80)]
    assert not got[1].any() and not got[3].any()


def test_query_gives_kept_text_and_share(spark, tmp_path):
    from pulsegrid.llm.queries import QUERIES

    passage = "".join(random.Random(6).choices("abcdef", k=399)) + "é"
    rows = [(1, "left " + passage), (2, passage + " right"), (3, "é"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, round(r.removed_share, 4), r.kept_text) for r in QUERIES["op9_suffix_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: (401, round(401 / 406, 4), "left "), 2: (401, round(401 / 407, 4), " right"), 3: (0, 0, "é"), 4: (0, 0, "")}


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = "".join(random.Random(1).choices("abcdef", k=500))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text[:399]), (None, None)], "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed, r.n_spans) for r in sd.remove_repeats(docs).collect())
    assert got == [(0, 0, 0), (399, 0, 0), (500, 500, 1), (500, 500, 1)]
    assert sd.remove_repeats(docs.limit(0)).count() == 0
