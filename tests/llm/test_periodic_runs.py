import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.llm import periodic_runs as runs
from tests_llm_data import documents

SPACE = " \t\n\x0b\x0c\r"


def every_run(words):
    """By trying each period and each stretch of equal words at its distance."""
    n, found = len(words), {}
    for q in range(1, n // runs.LEAST_TIMES + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(runs.LEAST_LENGTH, runs.LEAST_TIMES * q):
                found.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = max(j, i + 1)
    return sorted(((a, m, q) for (a, m), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_words(text):
    return "".join(" " if c in SPACE else c for c in text or "").split(" ")


def expected(doc_id, text):
    words = [w for w in plain_words(text) if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = every_run(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for a, m, q in found for i in range(a + q, a + m)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = "".join(f"{a},{m},{q}\n" for a, m, q in found)
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(kept))


def periodic_words(pick, letters):
    words = []
    for _ in range(pick.randrange(1, 5)):
        unit = pick.choices(letters, k=pick.randrange(1, 14))
        words += (unit * pick.randrange(1, 40))[:pick.randrange(1, 130)]
        words += pick.choices(letters, k=pick.randrange(6))
    return words


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefgh"])
def test_runs_of_periodic_words(letters):
    pick = random.Random(len(letters))
    for _ in range(150):
        words = periodic_words(pick, letters)
        assert runs.runs_of([ord(w) for w in words]) == every_run(words)
        assert runs.runs_of_texts([words, [], words]) == [every_run(words), [], every_run(words)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=9), st.integers(1, 30)), max_size=4))
def test_runs_of_any_words(parts):
    words = list("".join(unit * times for unit, times in parts))
    assert runs.runs_of_texts([words]) == [every_run(words)]


def test_a_segment_that_ends_where_an_access_comes_in():
    """The deeper segment below it is no part of the path: it gave a second period, or a shorter run."""
    for parts in ([("aa", 9), ("b", 22), ("a", 1), ("b", 24)], [("aa", 17), ("b", 25), ("a", 2), ("b", 23)]):
        words = list("".join(unit * times for unit, times in parts))
        assert runs.runs_of_texts([words]) == [every_run(words)]


def test_long_runs_of_one_and_of_nested_periods():
    assert runs.runs_of([5] * 20_000) == [(0, 20_000, 1)]
    inner = [1] * 30 + [2]
    found = runs.runs_of(inner * 100)
    assert found == every_run(inner * 100) and (0, 3100, 31) in found and (0, 30, 1) in found
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 3000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    assert runs.runs_of(fibonacci[-1]) == every_run(fibonacci[-1])


def test_stretches_hold_repeated_windows_only():
    line = list(range(100, 130))
    ids = np.array([*range(50), *line, *range(200, 240), *line, *range(300, 340), *([7, 8, 9] * 20)])
    assert runs.stretches(ids, np.zeros(len(ids), dtype=np.int64)).tolist() == [[len(ids) - 60, len(ids)]]
    halves = np.repeat([0, 1], [len(ids) - 30, 30])  # two texts: a run does not cross them
    assert runs.stretches(ids, halves).tolist() == [[len(ids) - 60, len(ids) - 30], [len(ids) - 30, len(ids)]]


def test_collapse_overlapping_runs():
    words = [str(i) for i in range(100)]
    assert runs.collapse(words, [(0, 30, 3), (10, 25, 5), (60, 24, 1)]) == words[:3] + words[35:61] + words[84:]


def test_documents(spark):
    docs = documents(spark).withColumnRenamed("n", "start").withColumnRenamed("words", "runs")
    found = runs.digests(runs.periodic_runs(docs, planted=True))
    got = {r.doc_id: tuple(r)[1:] for r in found.collect()}
    want = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == want.keys()
    assert sum(g[0] > 0 for g in got.values()) > 15
    for k, text in want.items():
        if text is None or len(text) < 30_000:
            assert got[k] == expected(k, text), k


def test_odd_tables(spark):
    assert runs.periodic_runs(documents(spark).limit(0)).count() == 0
    tail = "x " * 30
    rows = spark.createDataFrame(
        [(None, None), (None, tail), ("b", "ab " * 24), ("b", "ab " * 24), ("c", "ab " * 23)], "doc_id string, text string")
    got = [(r.doc_id, r.n_runs, r.length, r.period, r.exponent_milli, r.collapsed) for r in runs.periodic_runs(rows).collect()]
    assert sorted(got, key=str) == sorted([
        (None, 0, None, None, None, ""), (None, 1, 30, 1, 30_000, "x"), ("b", 1, 24, 1, 24_000, "ab"),
        ("b", 1, 24, 1, 24_000, "ab"), ("c", 0, None, None, None, " ".join(["ab"] * 23))], key=str)
