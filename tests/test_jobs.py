"""From a source to stored alerts, deliveries and cursors; restarts and replays add nothing."""

import json
import os

from pyspark.sql import functions as F

from pulsegrid.params import DetectorParams
from pulsegrid.plans.batch import Detection
from pulsegrid.schemas import LOG_SOURCE, SOURCE_STATE
from pulsegrid.streaming import engine, jobs
from test_detection import at, facts_of_alerts, frame

KEYS_DDL = ("id string, tenant_id string, key_hash string, scopes string, webhook_url string, webhook_filters string, "
            "expires_at timestamp, grace_period_ends_at timestamp, revoked_at timestamp")
PARAMS = DetectorParams(warmup_required=3)
ONCE = {"availableNow": True}


def keys_of(spark):
    return lambda: spark.createDataFrame([
        ("k1", "t", "h1", '["ingest"]', "https://hook/1", None, None, None, None),
        ("k2", "t", "h2", '["alerts:read"]', "https://hook/2", '{"severity":"CRITICAL"}', None, None, None)], KEYS_DDL)


def rate(minute):
    return 9 if minute in (8, 9, 20) else 0


def rows_of(minutes, source, service):
    return [(60.0 * m + 2 * i, "ERROR" if i < rate(m) else "INFO", f"boom {i}", source, "t", service, 5.0)
            for m in minutes for i in range(10)]


def test_landing_folder_to_alerts(spark, tmp_path):
    folder, root, checkpoint = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/cp"
    folder.mkdir()
    stamp = lambda s: at(s).isoformat().replace("+00:00", "Z")

    def push(name, minutes, key="h1"):
        batches = [{"batch_id": m, "key_hash": key, "received_at": stamp(60 * m + 59), "entries": [
            {"message": r[2], "level": r[1].lower(), "occurred_at": stamp(r[0]), "service_name": "svc", "latency_ms": r[6]}
            for r in rows_of([m], "k1", "svc")]} for m in minutes]
        (folder / name).write_text("".join(json.dumps(b) + "\n" for b in batches))

    def run():
        q = jobs.take_pushes(spark, str(folder), keys_of(spark), root, checkpoint, PARAMS, "0 seconds", ONCE)
        q.awaitTermination()
        assert q.exception() is None
        return (sorted(map(str, engine.stored_alerts(spark, root).collect())),
                sorted(map(str, jobs.stored_queue(spark, root).collect())),
                sorted(map(str, jobs.refused_batches(spark, root).collect())))

    push("a.json", range(12))
    push("bad.json", [3], key="h2")
    first = run()
    assert run() == first  # a restart with nothing new
    push("b.json", range(12, 24))
    alerts, queue, refused = second = run()
    assert run() == second and set(first[0]) - set(alerts) <= {a for a in first[0] if "open" in a}
    # The newest entry is in minute 23, which stays open.
    want = Detection(frame(spark, rows_of(range(23), "k1", "svc")), PARAMS).alerts
    assert facts_of_alerts(engine.stored_alerts(spark, root)) == facts_of_alerts(want)
    due = {(r.alert_id, r.api_key_id) for r in jobs.stored_queue(spark, root).collect()}
    assert due == {(r.id, k) for r in want.collect() for k in ("k1", "k2") if k == "k1" or r.severity == "CRITICAL"}
    assert [r.reason for r in jobs.refused_batches(spark, root).collect()] == ["INSUFFICIENT_SCOPE"]


def test_log_files_to_alerts(spark, tmp_path):
    path, root = str(tmp_path / "app.log"), f"{tmp_path}/out"
    other = str(tmp_path / "other.log")
    source = lambda i, path, form, active=True: tuple(
        {"id": i, "tenant_id": "t", "service_name": f"svc-{i}", "environment": "production", "source_type": "file",
         "connection_config": path, "latency_field": None, "log_format": form, "active": active}.get(f.name) for f in LOG_SOURCE)
    sources = lambda: spark.createDataFrame([source("s1", path, "json"), source("s2", other, "logfmt"), source("s3", "x", "json", False)], LOG_SOURCE)
    nothing = lambda: spark.createDataFrame([], SOURCE_STATE)

    def write(rows, where, form):
        with open(where, "a") as f:
            for r in rows:
                when = at(r[0]).isoformat().replace("+00:00", "Z")
                f.write(json.dumps({"level": r[1], "message": r[2], "time": when, "latency_ms": r[6]}) + "\n" if form == "json"
                        else f'level={r[1]} msg="{r[2]}" time={when} latency={r[6]}ms\n')

    def run(checkpoint="cp", cursors=nothing):
        q = jobs.follow_files(spark, sources, cursors, root, f"{tmp_path}/{checkpoint}", PARAMS, keys_of(spark), "0 seconds",
                              {"processingTime": "0 seconds"})
        q.processAllAvailable()
        q.stop()
        assert q.exception() is None

    write(rows_of(range(10), "s1", "svc"), path, "json")
    write(rows_of(range(10), "s2", "svc"), other, "logfmt")
    run()
    os.rename(path, path + ".1")
    write(rows_of(range(10, 18), "s1", "svc"), path + ".1", "json")  # the writer went on for a while
    write(rows_of(range(18, 24), "s1", "svc"), path, "json")
    write(rows_of(range(10, 24), "s2", "svc"), other, "logfmt")
    run()
    rows = sorted(rows_of(range(23), "s1", "svc-s1") + rows_of(range(23), "s2", "svc-s2"))
    want = facts_of_alerts(Detection(frame(spark, rows), PARAMS).alerts)
    assert facts_of_alerts(engine.stored_alerts(spark, root)) == want
    run()
    assert facts_of_alerts(engine.stored_alerts(spark, root)) == want
    place = {r.source_id: (r.file_inode, r.byte_offset) for r in jobs.stored_cursors(spark, root, nothing()).collect()}
    size = lambda p: (os.stat(p).st_ino, os.path.getsize(p))
    assert place == {"s1": size(path), "s2": size(other)}
    # A stream without a checkpoint goes on from the stored cursors: it reads no line again.
    stored = jobs.stored_cursors(spark, root).collect()
    cursors = lambda: spark.createDataFrame(stored, SOURCE_STATE)
    reader = jobs.tail.TailReader({"path": f"{path}{os.pathsep}{other}", "startingOffsets": json.dumps(
        {path: list(place["s1"]), other: list(place["s2"])})})
    assert reader.partitions(reader.initialOffset(), reader.latestOffset()) == []
    assert cursors().count() == 2
