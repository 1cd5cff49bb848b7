import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from pulsegrid.llm.exact_dedup import exact_dedup, keep_first
from tests_llm_data import documents


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups["".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")].append((-len(text or ""), i))
    out = {}
    for key, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(key.encode()).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()}


def test_matches_brute_force(spark):
    docs = documents(spark)
    assert result(exact_dedup(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_hash_collisions_do_not_merge(spark):
    docs = documents(spark)
    weak = exact_dedup(docs, digest=lambda c: F.substring(F.md5(c), 1, 1))
    assert result(weak) == result(exact_dedup(docs))


def test_stage_keeps_one_of_each_and_all_columns(spark):
    docs = documents(spark)
    kept = keep_first(docs)
    assert kept.columns == docs.columns
    want = {v[0] for v in brute([(r.doc_id, r.text) for r in docs.collect()]).values()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_ids_null_negative_repeated_and_empty(spark):
    rows = [(None, "a b"), (-5, "ab"), (-5, "ab"), (None, "c"), (9_223_372_036_854_775_807, ""), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept").collect()))
    assert got == sorted([
        "Row(doc_id=None, keep_id=None, group_size=3, kept=True)", "Row(doc_id=-5, keep_id=None, group_size=3, kept=False)",
        "Row(doc_id=-5, keep_id=None, group_size=3, kept=False)", "Row(doc_id=None, keep_id=None, group_size=1, kept=True)",
        "Row(doc_id=9223372036854775807, keep_id=3, group_size=2, kept=False)", "Row(doc_id=3, keep_id=3, group_size=2, kept=True)"])
    assert exact_dedup(docs.limit(0)).count() == 0
