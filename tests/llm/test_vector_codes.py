import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from pulsegrid.llm import vector_codes as codes
from tests_llm_data import TABLES


def expected(rows):
    """Plain loops over (vec_id, vector, label); rows in order of id, then vector."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows]
    width = len(kept[0][1]) // 8
    cut = lambda v, p: v[p * width:(p + 1) * width]
    books = [[list(cut(v, p)) for _, v, _ in kept[:16]] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda part, book: min((far(part, e), k) for k, e in enumerate(book))
    for _ in range(6):
        for p, book in enumerate(books):
            members = [[] for _ in book]
            for _, v, _ in kept:
                members[near(cut(v, p), book)[1]].append(cut(v, p))
            for k, of in enumerate(members):
                if of:
                    book[k] = [sum(xs) // len(of) for xs in zip(*of)]
    found = [[near(cut(v, p), books[p]) for p in range(8)] for _, v, _ in kept]
    errors = [sum(d for d, _ in f) for f in found]
    said = ",".join(str(x) for book in books for e in book for x in e)
    sha = hashlib.sha256(said.encode()).hexdigest()
    of_label = lambda label: sum(e for e, (_, _, other) in zip(errors, kept) if other == label)
    return [(i, "".join(f"{k:02x}" for _, k in f), e, of_label(label), sha)
            for (i, _, label), f, e in zip(kept, found, errors)]


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int")


def outcome(df):
    return sorted(map(tuple, codes.vector_codes(df).collect()), key=str)


@pytest.mark.parametrize("width,count,grid", [(1, 60, 6), (2, 200, 4), (4, 90, 200), (3, 9, 5)])
def test_against_plain_loops(spark, monkeypatch, width, count, grid):
    monkeypatch.setattr(codes, "LEAVES", 7)
    pick = random.Random(width)
    vectors = [[pick.randrange(-grid, grid) / 16 for _ in range(8 * width)] for _ in range(count)]
    vectors += vectors[:5] + [vectors[3]] * 40  # one vector makes a large part of the rows
    rows = [(i, v, pick.choice([None, 1, 1, 2])) for i, v in enumerate(vectors)]
    shuffled = pick.sample(rows, len(rows))
    assert outcome(table(spark, shuffled).repartition(5)) == sorted(expected(rows), key=str)


def test_walk_keeps_its_path_open():
    pick = np.random.default_rng(5)
    leaves = np.unique(pick.integers(-3, 3, (900, 5)), axis=0)
    book = pick.integers(-4, 4, (16, 5))
    want = ((leaves[:, None, :] - book[None]) ** 2).sum(axis=2)
    for step in (1, 2, 50, 1000):
        walk = codes.Walk(book)
        got = [walk.distances(leaves[a:a + step]) for a in range(0, len(leaves), step)]
        assert (np.concatenate(got) == want).all()


def test_keys_sort_as_numbers():
    parts = np.array([[-5, 3], [-5, -3], [0, 1], [70_000, -1], [-70_000, 2], [0, 0]])
    order = np.argsort(keys := codes.keys_of(parts))
    assert parts[order].tolist() == sorted(parts.tolist())
    import pyarrow as pa

    assert (codes.parts_in(pa.array([k.tobytes() for k in keys]), 2) == parts).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(None, [0.5] * 8, None), (3, [0.25] * 8, None), (3, [-0.25] * 8, 1), (3, [-0.25] * 8, 1)]
    odd = [(1, None, 1), (2, [0.5] * 7 + [None], 1), (4, [nan] * 8, 1), (5, [0.1] * 7 + [inf], 1), (6, [-inf] * 8, 1),
           (7, [], 1), (8, [0.1] * 9, 1), (9, [0.1] * 16, 1), (10, [1e30] * 8, 1), (None, None, None)]
    want = sorted(expected([good[2], good[3], good[1], good[0]]), key=str)
    for kind in ("float", "double"):
        assert outcome(table(spark, good + odd, kind)) == want
    clash = table(spark, good).withColumnsRenamed({"vec_id": "error", "embedding": "code", "label": "key"})
    clash = clash.selectExpr("*", "1 as n", "2 as part", "3 as vector", "4 as __label")
    got = codes.vector_codes(clash, "error", "code", "key").collect()
    assert sorted(map(tuple, got), key=str) == want
    assert codes.vector_codes(table(spark, [r for r in odd if r[0] != 9])).count() == 0
    empty = codes.vector_codes(table(spark, []))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0


def test_sql(spark):
    path = f"{TABLES}/embeddings.parquet"
    with duckdb.connect() as db:
        db.sql(f"create view embeddings as from '{path}'")
        want = sorted(db.sql(codes.SQL).fetchall(), key=str)
    assert outcome(spark.read.parquet(path)) == want
