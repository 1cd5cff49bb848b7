import re
from collections import defaultdict

import numpy as np
import pytest

from pulsegrid.llm import mixing as mx
from tests_llm_data import documents


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """sizes by source: share out, cut at the cap, share the excess among those below, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    total, target, open_ = share * sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    while open_ and total > 1e-9:
        by = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += total * weight[s] / by
        total = 0.0
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                total += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.remove(s)
    return target


def test_permutations_are_permutations():
    for n in [1, 2, 3, 7, 64, 1000, 4097]:
        images = [mx.permuted(np.arange(n), np.full(n, n), np.full(n, k, np.uint64)) for k in (1, 2)]
        assert all(sorted(x.tolist()) == list(range(n)) for x in images)
        assert n < 5 or images[0].tolist() != images[1].tolist()


@pytest.mark.parametrize("empty", [False, True])
def test_documents(spark, empty):
    docs = documents(spark).limit(0) if empty else documents(spark)
    rows = mx.taken_words(docs).collect()
    assert len(rows) == docs.count()
    if empty:
        return
    again = {(r.doc_id, r.taken) for r in mx.taken_words(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    want = {r.doc_id: len(re.findall("[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == want[r.doc_id] and 0 <= r.taken <= 2 * r["size"]
        by[r.source].append(r)
    target = brute_targets({s: sum(r["size"] for r in v) for s, v in by.items()})
    for s, v in by.items():
        assert all(abs(r.target - target[s]) < 1e-6 * (1 + target[s]) for r in v)
        assert all(r.source_size == sum(x["size"] for x in v) for r in v)
        assert abs(sum(r.taken for r in v) - target[s]) <= 64


def test_slots_fill_shards_and_spread_sources(spark):
    placed, slots, pieces = mx.mix(documents(spark), p=mx.MixParams(shard_slots=256))
    rows = slots.toPandas()
    quota = rows.groupby("number").size()
    shares = rows.groupby("shard").number.value_counts(normalize=True).unstack(fill_value=0)
    assert len(shares) > 3
    assert np.abs(shares - quota / quota.sum()).to_numpy().max() < 0.15
    assert rows.groupby(["number", "block"]).size().max() <= 2
    words = pieces.groupBy("number", "block").sum("words").toPandas()["sum(words)"]
    assert words.max() <= mx.MixParams().block


def test_stage_repeats_rows_near_the_targets(spark):
    docs = documents(spark)
    out = mx.mixed_documents(docs)
    assert out.columns == docs.columns
    count = defaultdict(int)
    for r in out.collect():
        count[r.doc_id] += 1
    assert max(count.values()) <= 2
    taken = {r.doc_id: r for r in mx.taken_words(docs).collect()}
    assert all(abs(count[i] - r.taken / max(r["size"], 1)) < 1 for i, r in taken.items())
