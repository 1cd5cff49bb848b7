"""Ordered primitives against brute force, with hot keys and tiny cells."""

import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import ordered
from pulsegrid.operators.queries import nearest_rank


def series(seed, n=600):
    """A hot key holds two thirds of the rows."""
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.67 else f"k{rng.randrange(5)}", rng.randrange(2000), i) for i in range(n)]


def test_position_and_running(spark):
    rows = series(1)
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint")
    cell = F.floor(F.col("t") / 50)
    placed = ordered.with_position(df, ["k"], ["t", "i"], cell)
    out = ordered.running(placed, ["k"], F.floor(F.col("pos") / 7), ["pos"],
                          {"s": ("sum", F.col("i")), "hi": ("max", F.when(F.col("i") % 3 == 0, F.col("i"))), "lo": ("min", F.col("i"))})
    got = {(r.k, r.pos): (r.i, r.s, r.hi, r.lo) for r in out.collect()}
    for key in {r[0] for r in rows}:
        seen = []
        for pos, (_, t, i) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))):
            seen.append(i)
            thirds = [x for x in seen if x % 3 == 0]
            assert got[(key, pos)] == (i, sum(seen), max(thirds) if thirds else None, min(seen))
    assert len(got) == len(rows)


def test_running_in_ranges(spark):
    """All rows of the hot key at one instant: ranges split them all the same."""
    rows = [(k, 0 if k == "hot" else t, i) for k, t, i in series(3)]
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint").repartition(4)
    out = ordered.running_in_ranges(df, ["k"], ["t", "i"], {"s": ("sum", F.col("i"))})
    got = {(r.k, r.i): r.s for r in out.collect()}
    for key in {r[0] for r in rows}:
        total = 0
        for _, _, i in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:]):
            total += i
            assert got[(key, i)] == total
    assert len(got) == len(rows) and out.columns == ["k", "t", "i", "s"]


@pytest.mark.parametrize("seed", range(3))
def test_stack_matches(spark, monkeypatch, seed):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 5)
    rng = random.Random(seed)
    rows, want = [], set()
    for key in ("a", "b", "c"):
        stack = []
        for pos in range(300):
            op = rng.choice([1, -1, -1, 0])
            if op == 0:
                continue
            rows.append((key, pos, op, pos * 10))
            if op == 1:
                stack.append(pos)
            elif stack:
                want.add((key, stack.pop(), pos * 10))
    got = ordered.stack_matches(spark.createDataFrame(rows, "k string, pos bigint, op int, at bigint"), ["k"])
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_stack_matches_with_removals(spark, monkeypatch, seed):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 5)
    rng = random.Random(seed)
    rows, want = [], set()
    for key in ("a", "b", "c"):
        stack = []
        for pos in range(300):
            op = rng.choice([1, 1, -1, -1, 0])
            if op == 0:
                continue
            gone = pos * 10 + rng.randrange(-5, 200) if op == 1 and rng.random() < 0.5 else None
            rows.append((key, pos, op, pos * 10, gone))
            if op == 1:
                stack.append((pos, gone))
                continue
            stack = [(p, g) for p, g in stack if g is None or g > pos * 10]
            if stack:
                want.add((key, stack.pop()[0], pos * 10))
    df = spark.createDataFrame(rows, "k string, pos bigint, op int, s bigint, g bigint").select(
        "k", "pos", "op", F.timestamp_seconds("s").alias("at"), F.timestamp_seconds("g").alias("gone_at"))
    got = ordered.stack_matches_with_removals(df, ["k"]).select("k", "push_pos", F.unix_seconds("pop_at"))
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("spread", [3000, 40, 1])
def test_cooldown(spark, spread):
    rows = [(k, t * spread) for k, t, _ in series(2, 500)]
    seed = {"hot": 100_000, "k1": 10**7} if spread > 1 else {}
    df = spark.createDataFrame(rows, "k string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    last = spark.createDataFrame(list(seed.items()), "k string, s bigint").select(
        "k", F.timestamp_seconds("s").alias("last_at"))
    gap = {3000: 40_000, 40: 40_000, 1: 7}[spread]
    got = ordered.cooldown(df, ["k"], "ts", gap, last)
    want = set()
    for key in {k for k, _ in rows}:
        kept = seed.get(key)
        for t in sorted({t for k, t in rows if k == key}):
            if kept is None or t - kept >= gap:
                kept = t
                want.add((key, t))
    assert {tuple(r) for r in got.select("k", F.unix_seconds("ts")).collect()} == want


def test_cooldown_worked_case(spark):
    df = spark.createDataFrame([(t,) for t in (0, 100, 299, 300, 500, 600, 1000)], "s bigint").select(
        F.lit("t").alias("k"), F.timestamp_seconds("s").alias("ts"))
    kept = ordered.cooldown(df, ["k"], "ts", 300).select(F.unix_seconds("ts")).collect()
    assert sorted(r[0] for r in kept) == [0, 300, 600, 1000]


@pytest.mark.parametrize("batch", [7, 10_000])
def test_cooldown_of_many_small_keys(spark, batch):
    """Keys cost no Python call each; chunks and keys may end anywhere in a batch; null keys and times are left out."""
    rng = random.Random(batch)
    rows = [(k, rng.randrange(40 * 86_400)) for k in range(400) for _ in range(rng.choice([1, 2, 60]))]
    odd = [(None, 5), (3, None), (None, None)]
    df = spark.createDataFrame(rows + odd, "k bigint, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = ordered.cooldown(df, ["k"], "ts", 86_400)
        assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()
        found = [tuple(r) for r in got.select("k", F.unix_seconds("ts")).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, last = [], {}
    for k, t in sorted(set(rows)):
        if k not in last or t - last[k] >= 86_400:
            last[k] = t
            want.append((k, t))
    assert sorted(found) == want


def test_nearest_rank(spark):
    rng = random.Random(4)
    values = {"hot": [rng.randrange(50) for _ in range(1000)], "few": [5, 1, 9], "one": [7], "even": [1, 2, 3, 10]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v bigint")
    got = {r.k: r for r in nearest_rank(df, ["k"], "v", {"p95": 0.95, "p99": 0.99}, 10).collect()}
    import statistics

    for key, vs in values.items():
        vs = sorted(vs)
        assert (got[key].n, got[key].median, got[key].p95, got[key].p99) == (
            len(vs), statistics.median(vs), vs[int(len(vs) * 0.95)], vs[int(len(vs) * 0.99)])
    total = nearest_rank(df, [], "v", {"p95": 0.95}, 10).collect()[0]
    flat = sorted(v for vs in values.values() for v in vs)
    assert (total.n, total.p95) == (len(flat), flat[int(len(flat) * 0.95)])
