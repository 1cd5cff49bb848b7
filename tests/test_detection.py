"""The Spark plans against the sequential model, on random series and on worked cases."""

import json
import random
from collections import defaultdict
from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators import ordered
from pulsegrid.params import DetectorParams
from pulsegrid.plans.batch import Detection
from sequential import Model

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
ENTRY = T.StructType([
    T.StructField("occurred_at", T.TimestampType()), T.StructField("level", T.StringType()),
    T.StructField("message", T.StringType()), T.StructField("source_id", T.StringType()),
    T.StructField("tenant_id", T.StringType()), T.StructField("service_name", T.StringType()),
    T.StructField("environment", T.StringType()), T.StructField("latency_ms", T.DoubleType()),
    T.StructField("seq", T.LongType()), T.StructField("batch_id", T.LongType()),
    T.StructField("received_at", T.TimestampType()),
])


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def random_entries(seed, minutes=400, sources=7):
    rng, rows = random.Random(seed), []
    for s in range(sources):
        tenant = f"t{s % 2}"
        burst = rng.randrange(30, 120)
        minute = 0
        while minute < minutes:
            rate = 0.02 if (minute // burst) % 3 else rng.choice([0.1, 0.5, 0.9])
            if minute % 70 in (68, 69):  # incidents of all sources
                rate = 0.8
            for _ in range(rng.randrange(1, 5)):
                sec = minute * 60 + round(rng.random() * 59.9, 3)
                err = rng.random() < rate
                lat = None if rng.random() < 0.3 else 50 + rng.random() * (5 if rng.random() < 0.95 else 500)
                rows.append((sec, "ERROR" if err else "INFO", f"boom {rng.choice('abcdef')} {rng.randrange(99)}",
                             f"s{s}", tenant, f"svc{s // 2 if s < 4 else s}", lat))
            minute += 1 if rng.random() < 0.97 else rng.randrange(2, 30)
    rows.sort(key=lambda r: r[0])
    return rows


def frame(spark, rows):
    return spark.createDataFrame(
        [(at(r[0]), r[1], r[2], r[3], r[4], r[5], "production", r[6], i, None, None) for i, r in enumerate(rows)], ENTRY)


def run_model(rows, params):
    model, units = Model(params), defaultdict(list)
    for r in rows:
        units[(int(r[0] // params.window_s + 1) * params.window_s, r[4], r[3])].append(
            (r[0], r[1], r[2], r[5], r[6]))
    for (now, tenant, source), entries in sorted(units.items(), key=lambda kv: (kv[0][0], kv[0][2])):
        model.ingest((tenant, source), now, entries)
    return model


def facts_of_model(model):
    return sorted(
        (a["kind"], a["tenant"], a["source"], float(a["at"]), a["severity"], round(float(a["cur"]), 5),
         round(float(a["base"]), 5), round(float(a["bound"]), 5), a["service"], a["status"],
         None if a["resolved"] is None else float(a["resolved"]), a.get("message"), tuple(a.get("members", ())))
        for a in model.alerts)


def facts_of_alerts(df):
    out = []
    for r in df.collect():
        sec = lambda ts: None if ts is None else (ts.replace(tzinfo=timezone.utc) - T0).total_seconds()
        context = json.loads(r.cascade_context) if r.cascade_context else None
        members = tuple(m["service_name"] for m in context["contributing_services"]) if context else ()
        message = json.loads(r.representative_msgs)[0] if r.anomaly_type == "NOVEL_ERROR" else None
        out.append((r.anomaly_type, r.tenant_id, r.source_id, sec(r.detected_at), r.severity,
                    round(r.current_value, 5), round(r.baseline_value, 5), round(r.upper_bound, 5), r.service_name,
                    r.status, sec(r.resolved_at), message, members))
    return sorted(out, key=lambda t: tuple(str(x) for x in t))


PARAMS = DetectorParams(silence_s=300, novel_ttl_s=3600)


@pytest.mark.parametrize("seed,block", [(1, None), (2, 16)])
def test_pipeline_equals_sequential_model(spark, monkeypatch, seed, block):
    if block:  # force many blocks and cells
        monkeypatch.setattr(DetectorParams, "cell_s", property(lambda p: 60 * block))
        monkeypatch.setattr(ordered, "BLOCK_ROWS", block)
    rows = random_entries(seed)
    got = facts_of_alerts(Detection(frame(spark, rows), PARAMS).alerts)
    want = sorted(facts_of_model(run_model(rows, PARAMS)), key=lambda t: tuple(str(x) for x in t))
    kinds = {t[0] for t in want}
    assert kinds == {"ERROR_RATE_SPIKE", "SUSTAINED_ELEVATION", "SERVICE_SILENCE", "LATENCY_SPIKE",
                     "NOVEL_ERROR", "CASCADE"}
    assert got == want


def test_two_runs_with_state_equal_one(spark):
    rows = random_entries(5, minutes=240)
    cut = 130 * 60
    whole = Detection(frame(spark, rows), PARAMS)
    first = Detection(frame(spark, [r for r in rows if r[0] < cut]), PARAMS)
    early = first.alerts.cache()
    cascaded = early.filter("anomaly_type = 'CASCADE'").groupBy("tenant_id").agg(F.max("detected_at").alias("last_at"))
    second = Detection(
        frame(spark, [r for r in rows if r[0] >= cut]), PARAMS, state=first.next_state,
        open_alerts=early.filter("status = 'open'"), last_cascades=cascaded, patterns=first.next_patterns)
    got = early.filter("status <> 'open'").unionByName(second.earlier_alerts).unionByName(second.alerts)
    assert facts_of_alerts(got) == facts_of_alerts(whole.alerts)
    payloads = second.earlier_alerts.filter("status = 'resolved'").select("full_payload").collect()
    assert payloads and all(json.loads(r[0])["resolution"]["auto_resolved"] for r in payloads)


def test_smoothing_is_the_recurrence(spark, monkeypatch):
    """To the last bit, over cells of any size, with a huge latency and a steady end."""
    from pulsegrid.operators import baseline

    monkeypatch.setattr(DetectorParams, "cell_s", property(lambda p: 60 * 100))
    lat = [50.0 + k % 3 for k in range(1000)] + [20.1] * 400
    lat[743] = 1e13
    for alpha in (0.3, 0.9, 0.001, 1.0):
        d = Detection(frame(spark, [(60.0 * k, "INFO", "m", "s", "t", "svc", x) for k, x in enumerate(lat)]),
                      DetectorParams(alpha=alpha))
        rows = baseline.latency_baseline(d.base, d.params).orderBy("lat_pos").collect()
        m = v = 0.0
        for k, (x, r) in enumerate(zip(lat, rows)):
            assert (r.lat_pos, r.prev_lm, r.prev_lv) == (k, m, v)
            m, v = alpha * x + (1 - alpha) * m, alpha * ((x - m) * (x - m)) + (1 - alpha) * v
            assert (r.lm, r.lv) == (m, v)
        assert len(rows) == 1400


def test_steady_rate_stays_above_its_mean(spark):
    """A rate that never falls keeps its elevation open: the mean comes near from below and does not reach it."""
    rows = [(60.0 * k + i, "ERROR" if i < 2 else "INFO", "m", "s", "t", "svc", None) for k in range(200) for i in range(10)]
    d = Detection(frame(spark, rows), DetectorParams())
    m = 0.0
    ups = []
    for _ in range(200):
        m = 0.3 * 0.2 + (1 - 0.3) * m
        ups.append(0.2 > m)
    got = d.base.orderBy("pos").collect()
    assert [r.is_up for r in got] == [u and k >= 9 for k, u in enumerate(ups)]
    sustained = d.alerts.filter("anomaly_type = 'SUSTAINED_ELEVATION'").collect()
    assert [r.status for r in sustained] == ["open" if all(ups[9:]) else "resolved"] * 2


def test_run_resumes_within_an_elevation(spark):
    """Cut at any window, two runs give the alerts of one: clean rows are counted on, an elevation goes on."""
    bad = [0.05] * 15 + [0.9, 0.05, 0.05, 0.9, 0.9] + [0.6 + 0.01 * k for k in range(25)] + [0.0, 0.0, 0.0]
    rows = [(60.0 * k + i / 2, "ERROR" if i < round(100 * rate) else "INFO", "boom", "s", "t", "svc", 50.0 + 100 * (k % 9 == 4))
            for k, rate in enumerate(bad) for i in range(100)]
    whole = facts_of_alerts(Detection(frame(spark, rows), DetectorParams()).alerts)
    assert {"SUSTAINED_ELEVATION", "ERROR_RATE_SPIKE", "LATENCY_SPIKE"} <= {r[0] for r in whole}
    for cut in (17, 31, 40, 46):
        first = Detection(frame(spark, [r for r in rows if r[0] < 60 * cut]), DetectorParams())
        early = first.alerts.cache()
        second = Detection(
            frame(spark, [r for r in rows if r[0] >= 60 * cut]), DetectorParams(), state=first.next_state,
            open_alerts=early.filter("status = 'open'"), patterns=first.next_patterns)
        both = early.filter("status <> 'open'").unionByName(second.earlier_alerts).unionByName(second.alerts)
        assert facts_of_alerts(both) == whole, cut


BATCHES = replace(DetectorParams(), batch_col="batch_id")


def batches(spark, sizes_and_rates, start=0, source="s", lat=None, message="fail"):
    """One batch per (n, error rate), a minute apart."""
    rows = []
    for b, (n, rate) in enumerate(sizes_and_rates):
        for i in range(n):
            now = at(start + 60 * b)
            rows.append((now, "ERROR" if i < round(n * rate) else "INFO", message, source, "t", "svc", "production",
                         None if lat is None else float(lat), b * 1000 + i, b, now))
    return spark.createDataFrame(rows, ENTRY)


def prewarmed(spark, **values):
    row = {"tenant_id": "t", "source_id": "s", "ewma_value": 0.05, "ewma_variance": 0.01, "alpha": 0.3, "sensitivity": 2.5,
           "warmup_count": 50, "warmup_required": 10, "log_volume_ewma": 10.0, "latency_ewma": 50.0,
           "latency_variance": 1.0, "latency_warmup": 50} | values
    ddl = ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}"
                    for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], ddl)


@pytest.mark.parametrize("state,rate,severity,bound", [
    ({}, 0.9, "CRITICAL", 0.30),                                        # 0.05 + 2.5 * sqrt(0.01)
    ({}, 0.5, "WARNING", 0.30),                                         # below 0.05 + 5 * 0.1 = 0.55
    ({}, 0.02, None, None),
    ({"ewma_value": 0.5, "ewma_variance": 0.04}, 0.9, None, None),      # 0.5 + 2.5 * 0.2 = 1.0
    ({"ewma_value": 0.0, "ewma_variance": 0.0}, 1.0, "CRITICAL", 0.0),
    ({"warmup_count": 8}, 0.9, None, None),                             # the 9th batch is not warm
    ({"warmup_count": 9}, 0.9, "CRITICAL", 0.30),                       # the 10th is
])
def test_spike_bounds(spark, state, rate, severity, bound):
    d = Detection(batches(spark, [(50, rate)]), BATCHES, state=prewarmed(spark, **state))
    got = d.spikes.select("severity", "upper_bound").collect()
    assert [r.severity for r in got] == ([severity] if severity else [])
    if severity:
        assert got[0].upper_bound == pytest.approx(bound)


@pytest.mark.parametrize("lat,fires", [(200, True), (50, False), (52.5, False)])
def test_latency_bound(spark, lat, fires):
    d = Detection(batches(spark, [(50, 0.0)], lat=lat), BATCHES, state=prewarmed(spark))
    assert [r.upper_bound for r in d.latency_spikes.collect()] == ([52.5] if fires else [])


def test_sustained_first_check_past_critical_skips_warning(spark):
    long = [(10, 0.6)] + [(10, 0.9)] * 2
    entries = batches(spark, long).withColumn(
        "received_at", F.expr("received_at + make_dt_interval(0, 0, CAST(batch_id AS INT) * 10, 0)"))
    d = Detection(entries, BATCHES, state=prewarmed(spark, ewma_value=0.02, ewma_variance=1e-5))
    # Batches 0, 11 and 22 minutes after the first: warning at 660 s, critical at 1320 s.
    assert sorted(r.severity for r in d.sustained.collect()) == ["CRITICAL", "WARNING"]
    jump = entries.filter("batch_id <> 1")
    d = Detection(jump, BATCHES, state=prewarmed(spark, ewma_value=0.02, ewma_variance=1e-5))
    assert [r.severity for r in d.sustained.collect()] == ["CRITICAL"]


def test_silence_uses_state_and_resolves_at_once(spark):
    state = prewarmed(spark).withColumn("last_log_at", F.lit(at(-121)))
    alert = Detection(batches(spark, [(10, 0.0)]), BATCHES, state=state).alerts.collect()
    assert [(r.anomaly_type, r.status, r.current_value) for r in alert] == [("SERVICE_SILENCE", "resolved", 121.0)]
    payload = json.loads(alert[0].full_payload)
    assert payload["resolution"] == {"resolved_at": "2026-01-01T00:00:00+00:00", "duration_seconds": 0.0, "auto_resolved": True}
    state = prewarmed(spark).withColumn("last_log_at", F.lit(at(-119)))
    assert Detection(batches(spark, [(10, 0.0)]), BATCHES, state=state).silences.count() == 0


def test_payload_contract(spark):
    row = Detection(batches(spark, [(10, 1.0)]), BATCHES, state=prewarmed(spark)).alerts.filter(
        "anomaly_type = 'ERROR_RATE_SPIKE'").collect()[0]
    payload = json.loads(row.full_payload)
    assert list(payload) == ["anomaly_id", "schema_version", "detected_at", "anomaly_type", "severity", "service", "evidence",
                             "detection_context", "cascade_context", "resolution", "links"]
    assert payload["evidence"]["representative_messages"] == ["fail"]
    assert payload["evidence"]["sample_count"] == 10 and payload["cascade_context"] is None
    assert payload["detection_context"]["observations_count"] == 51
    assert payload["resolution"] == {"resolved_at": None, "duration_seconds": None, "auto_resolved": None}
    assert payload["links"]["acknowledge"] == f"/api/v1/alerts/{row.id}/acknowledge"


def test_eval_targets(spark):
    """100 spike trials at 90 % errors and 200 normal ones at 2 %, each on a fresh prewarmed source."""
    from pulsegrid.operators import quality

    trials = spark.range(300).select(
        F.concat(F.lit("s"), "id").alias("source_id"), F.lit("t").alias("tenant_id"), (F.col("id") < 100).alias("expected"))
    n = F.explode(F.sequence(F.lit(1), F.lit(50)))
    entries = trials.withColumn("i", n).select(
        F.lit(at(0)).alias("occurred_at"),
        F.when(F.col("i") <= F.when(F.col("expected"), 45).otherwise(1), "ERROR").otherwise("INFO").alias("level"),
        F.lit("m").alias("message"), "source_id", "tenant_id", F.lit("svc").alias("service_name"),
        F.lit("production").alias("environment"), F.lit(None).cast("double").alias("latency_ms"),
        F.lit(0).cast("bigint").alias("batch_id"))
    state = prewarmed(spark).drop("source_id", "tenant_id")
    state = trials.select("tenant_id", "source_id").withColumn("k", F.lit(1)).join(state.withColumn("k", F.lit(1)), "k").drop("k")
    d = Detection(entries, BATCHES, state=state)
    labels = trials.join(d.base.select("source_id", "detected_at"), "source_id").withColumn("detector", F.lit("ERROR_RATE_SPIKE"))
    card = quality.scorecard(quality.detection_trials(d.base, d.spikes, labels, ["ERROR_RATE_SPIKE"])).collect()[0]
    assert (card.tp, card.fp, card.fn, card.tn) == (100, 0, 0, 200)
    assert (card.precision, card.recall, card.false_positive_rate) == (1.0, 1.0, 0.0)
