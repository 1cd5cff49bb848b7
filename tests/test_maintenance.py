"""Instants inside maintenance windows, against plain loops."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from pulsegrid.operators import maintenance

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
KEY = "tenant_id string, source_id string"


def test_instants_in_windows_of_all_lengths(spark):
    pick = random.Random(8)
    at = lambda s: T0 + timedelta(seconds=s)
    windows, points = [], []
    for _ in range(120):
        start, length = pick.randrange(10**6), int(2 ** pick.uniform(0, 22))
        windows.append(("t", f"s{pick.randrange(4)}", at(start), None if pick.random() < 0.02 else at(start + length)))
    windows += [("t", "s0", at(50), at(50)), ("t", "s0", at(60), at(40)), ("t", "s9", at(0), at(10**9)), ("u", "s1", at(0), at(10**6))]
    for _, source, start, end in windows[:60]:  # the borders: the start is inside, the end is not
        points += [("t", source, start), ("t", source, start - timedelta(microseconds=1))]
        points += [("t", source, end), ("t", source, end - timedelta(microseconds=1))] if end else []
    points += [("t", f"s{pick.randrange(10)}", at(pick.randrange(2 * 10**6))) for _ in range(400)]
    points += points[:5] + [("t", "s0", None)]
    rows = spark.createDataFrame(points, f"{KEY}, at timestamp")
    given = spark.createDataFrame(windows, f"{KEY}, starts_at timestamp, ends_at timestamp")
    got = maintenance.in_maintenance(rows, F.col("at"), given).collect()
    inside = lambda t, s, p: p is not None and any(
        (t, s) == (a, b) and start <= p and (end is None or p < end) for a, b, start, end in windows)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(
        ((t, s, p and p.replace(tzinfo=None), inside(t, s, p)) for t, s, p in points), key=key)
    assert {r.maintained for r in got} == {True, False}
    short = maintenance.covers(given.filter("unix_seconds(ends_at) - unix_seconds(starts_at) < 4000000"))
    assert short.groupBy(*given.columns).count().agg(F.max("count")).collect()[0][0] <= 2
    assert maintenance.in_maintenance(rows, F.col("at"), given.limit(0)).filter("maintained").count() == 0
    assert maintenance.in_maintenance(rows.limit(0), F.col("at"), given).count() == 0
