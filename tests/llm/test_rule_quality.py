import numpy as np
from pyspark.sql import functions as F

from pulsegrid.llm import rule_quality as rq
from tests_llm_data import TABLES, documents


def labels(spark):
    return spark.read.parquet(f"{TABLES}/labels.parquet")


def test_held_out_accuracy(spark):
    table = "/root/testdata/sf0.01"
    docs, marks = (spark.read.parquet(f"{table}/{t}.parquet") for t in ("documents", "labels"))
    got = rq.score(docs, marks).where("held_out").join(marks, "doc_id").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert len(bad) and (good[:, None] > bad[None, :]).mean() > 0.95
    assert (got[got.quality == 1].predicted == 1).mean() > 0.97


def test_every_row_is_scored_and_only_by_its_text(spark):
    docs = documents(spark)
    got = rq.score(docs, labels(spark))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == docs.count() == got.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    assert {r.doc_id: r.score for r in rq.score(other, labels(spark)).collect()} == {k: r.score for k, r in rows.items()}


def test_held_out_labels_are_not_learnt(spark):
    docs, marks = documents(spark), labels(spark)
    flipped = marks.withColumn("quality", F.when(rq.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = lambda m: sorted((r.doc_id, r.score) for r in rq.score(docs, m).collect())
    assert scores(marks) == scores(flipped)


def test_compiled_rules_equal_the_model(spark):
    docs = documents(spark)
    stats = rq.statistics(docs)
    intercept, rules = rq.learn(stats, labels(spark))
    x = stats.select(*rq.FEATURES).toPandas().to_numpy(dtype=float)
    want = 1 / (1 + np.exp(-(intercept + sum(w * rq.holds(r, x) for r, w in rules))))
    got = stats.select(rq.compiled(intercept, rules, rq.FEATURES).alias("p")).toPandas().p.to_numpy()
    assert np.allclose(np.sort(got), np.sort(want))


def test_no_or_odd_labels_and_no_documents(spark):
    docs, marks = documents(spark), labels(spark)
    assert {r.score for r in rq.score(docs, marks.limit(0)).collect()} == {0.5}
    odd = marks.select("doc_id", F.lit(None).cast("int").alias("quality")).union(marks.select(F.lit(-9), F.lit(1)))
    assert rq.score(docs, odd).count() == docs.count()
    assert rq.score(docs.limit(0), marks).count() == 0


def test_stage_drops_only_rejected_rows(spark):
    docs, marks = documents(spark), labels(spark)
    kept = rq.keep_good(docs, marks)
    assert kept.columns == docs.columns
    want = sorted(r.doc_id for r in rq.score(docs, marks).where("predicted = 1").collect())
    assert sorted(r.doc_id for r in kept.collect()) == want
