"""Streams equal the batch plan on closed windows; the tail source follows rotating files."""

import json
import os

from pulsegrid.params import DetectorParams
from pulsegrid.plans import fixtures
from pulsegrid.plans.batch import Detection
from pulsegrid.sources import tail
from pulsegrid.streaming import engine
from pyspark.sql import functions as F
from test_detection import ENTRY, PARAMS, at, facts_of_alerts, frame, random_entries


def deliver(spark, rows, cuts, folder):
    """One file per stretch of `rows` between cuts; `seq` is the place among all rows."""
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = [(n, r) for n, r in enumerate(rows) if a <= r[0] < b]
        made = frame(spark, [r for _, r in part]).withColumn("seq", F.col("seq") + part[0][0])
        made.coalesce(1).write.parquet(f"{folder}/in-{i}")
    return f"{folder}/in-*"


def run(spark, folder, root, checkpoint, params=PARAMS, **kw):
    entries = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", 1).parquet(folder)
    q = engine.start(entries, root, checkpoint, params, delay="0 seconds", trigger={"availableNow": True}, **kw)
    q.awaitTermination()
    assert q.exception() is None


def test_stream_equals_batch(spark, tmp_path):
    rows = random_entries(3, minutes=150)
    src = deliver(spark, rows, [0, 60 * 60, 61 * 60, 10**9], tmp_path)
    run(spark, src, f"{tmp_path}/out", f"{tmp_path}/cp")
    # The windows newer than the watermark are judged when the run is closed.
    end = int(max(r[0] for r in rows) // 60) * 60
    got = engine.stored_alerts(spark, f"{tmp_path}/out")
    assert facts_of_alerts(got) == facts_of_alerts(Detection(frame(spark, [r for r in rows if r[0] < end]), PARAMS).alerts)
    engine.Run(spark, f"{tmp_path}/out", PARAMS).close()
    want = Detection(frame(spark, rows), PARAMS).alerts
    got = engine.stored_alerts(spark, f"{tmp_path}/out")
    assert facts_of_alerts(got) == facts_of_alerts(want)
    assert {(r.id, r.representative_msgs) for r in got.collect()} == {(r.id, r.representative_msgs) for r in want.collect()}
    assert engine.late_windows(spark, f"{tmp_path}/out").count() == 0


def windows_of(rows):
    cols = ["tenant_id", "source_id", "unit", "fp", "message", "service_name", "n", "n_lat", "first_seq", "min_ts", "max_ts"]
    return sorted((tuple(r) for r in rows.select(*cols, F.round("lat_sum", 6)).collect()), key=str)


def test_late_entries_reach_their_windows(spark, tmp_path):
    from pulsegrid.operators import observe

    rows = random_entries(4, minutes=60, sources=3)
    whole = frame(spark, rows)
    early = (F.unix_seconds("occurred_at") < F.lit(at(1800).timestamp())) & (F.col("seq") % 5 != 2)
    whole.filter(early).coalesce(1).write.parquet(f"{tmp_path}/in-0")
    whole.filter(~early).coalesce(1).write.parquet(f"{tmp_path}/in-1")
    run(spark, f"{tmp_path}/in-*", f"{tmp_path}/out", f"{tmp_path}/cp")
    got = engine.stored_windows(spark, f"{tmp_path}/out")
    assert windows_of(got) == windows_of(observe.window_rows(whole, PARAMS))
    late = engine.late_windows(spark, f"{tmp_path}/out").agg(F.sum("n")).collect()[0][0]
    judged = int(max(r[0] for n, r in enumerate(rows) if r[0] < 1800 and n % 5 != 2) // 60) * 60
    assert late == sum(r[0] < judged and n % 5 == 2 for n, r in enumerate(rows)) > 0


def test_silence_is_reported_when_due(spark, tmp_path):
    entry = lambda t, source: (t, "INFO", "m", source, "t", "svc", None)
    rows = [entry(60.0 * m, "steady") for m in range(40)]
    rows += [entry(60.0 * m + 1, "gap") for m in (0, 1, 2, 14, 15, 39)] + [entry(60.0 * m + 2, "gone") for m in range(5)]
    rows.sort()
    src = deliver(spark, rows, [0, 300, 600, 1200, 10**9], tmp_path)
    run(spark, src, f"{tmp_path}/out", f"{tmp_path}/cp")
    seconds = lambda t: F.unix_seconds(t) - int(at(0).timestamp())
    got = engine.stored_silences(spark, f"{tmp_path}/out").select("source_id", seconds("last_log_at"), seconds("due_at"))
    assert sorted(map(tuple, got.collect())) == [("gap", 121, 421), ("gap", 901, 1201), ("gone", 242, 542)]


def read_all(reader, start, end):
    return [row for part in reader.partitions(start, end) for row in reader.read(part)]


def write(path, text, mode="ab"):
    with open(path, mode) as f:
        f.write(text)


def test_tail_appends_rotation_and_half_lines(tmp_path, monkeypatch):
    path = str(tmp_path / "app.log")
    write(path, b"one\ntwo\nhal")
    reader = tail.TailReader({"path": path})
    start = reader.initialOffset()
    a = reader.latestOffset()
    assert [r[2] for r in read_all(reader, start, a)] == ["one", "two"]
    write(path, b"f\r\nbad \xff byte\n")
    b = reader.latestOffset()
    assert [r[2] for r in read_all(reader, a, b)] == ["half", "bad � byte"]
    assert read_all(reader, b, reader.latestOffset()) == []
    # Renamed: the old file's tail is drained, half-written end included, then the new file read from zero.
    write(path, b"late\nlast")
    os.rename(path, path + ".1")
    write(path, b"new\n", "wb")
    c = reader.latestOffset()
    assert [r[2] for r in read_all(reader, b, c)] == ["late", "last", "new"]
    # A reader started from a checkpoint goes on where the first one stood.
    write(path, b"more\n")
    other = tail.TailReader({"path": path})
    d = other.latestOffset()
    assert [r[2] for r in read_all(other, c, d)] == ["more"]
    # Truncated in place: read from zero.
    write(path, b"x\n", "wb")
    e = other.latestOffset()
    assert [r[2] for r in read_all(other, d, e)] == ["x"]
    os.unlink(path)
    assert read_all(other, e, other.latestOffset()) == []


def lines_between(reader, a, b):
    return [r[2] for r in read_all(reader, a, b)]


def test_tail_loses_and_repeats_nothing(tmp_path):
    """Two rotations between triggers, renamed matches, copies cut down, and replays after a restart."""
    path = str(tmp_path / "app.log")
    write(path + ".1", b"old, from before\n")
    write(path, b"1 first line\n")
    offsets, seen = [], []
    reader = tail.TailReader({"path": path})
    offsets.append(reader.initialOffset())

    def trigger(reader):
        offsets.append(json.loads(json.dumps(reader.latestOffset())))
        got = lines_between(reader, *offsets[-2:])
        seen.append(got)
        return got

    assert trigger(reader) == ["1 first line"]
    # Written, rotated, written, rotated, written: the middle file was never seen under its first name.
    write(path, b"2 more\n3 half")
    os.rename(path + ".1", path + ".3")
    os.rename(path, path + ".2")
    write(path, b"4 came and went\n")
    os.rename(path, path + ".1")
    write(path, b"5 now\n")
    assert sorted(trigger(reader)) == ["2 more", "3 half", "4 came and went", "5 now"]
    assert trigger(reader) == []
    # Copied and cut down in place; the copy holds two lines not read yet.
    write(path, b"6 a\n")
    os.rename(path + ".1", path + ".9")
    with open(path, "rb") as f:
        write(path + ".1", f.read() + b"7 b\n")
    write(path, b"8 c\n", "wb")
    write(path + ".2.gz", b"packed")
    assert sorted(trigger(tail.TailReader({"path": path}))) == ["6 a", "7 b", "8 c"]  # a reader that just started
    # Renamed while the stream is down, and a writer that still holds the renamed file.
    write(path, b"9 d\n10 not fin")
    os.rename(path, path + ".a")
    reader = tail.TailReader({"path": path})
    assert trigger(reader) == ["9 d"]
    write(path + ".a", b"ished\n")
    assert trigger(reader) == ["10 not finished"]
    write(path, b"11 e\n")
    assert trigger(reader) == ["11 e"]
    # Every micro-batch again: the same lines, wherever the files are now.
    again = tail.TailReader({"path": path})
    replayed = [lines_between(again, a, b) for a, b in list(zip(offsets, offsets[1:]))[4:]]
    assert replayed == seen[4:]


def test_tail_renamed_match(tmp_path):
    write(str(tmp_path / "a.log"), b"one\n")
    reader = tail.TailReader({"path": str(tmp_path / "*.log") + os.pathsep + str(tmp_path / "*.txt")})
    a = reader.latestOffset()
    write(str(tmp_path / "a.log"), b"two\n")
    os.rename(tmp_path / "a.log", tmp_path / "b.log")
    write(str(tmp_path / "a.log"), b"three\n")
    write(str(tmp_path / "c.txt"), b"four\n")
    b = reader.latestOffset()
    assert sorted(lines_between(reader, a, b)) == ["four", "three", "two"]
    os.rename(tmp_path / "b.log", tmp_path / "d.log")  # after the offset was taken
    assert sorted(lines_between(tail.TailReader({"path": str(tmp_path / "*.log") + os.pathsep + str(tmp_path / "*.txt")}), a, b)) == [
        "four", "three", "two"]


def test_tail_starts_at_a_stored_cursor(tmp_path):
    path = str(tmp_path / "app.log")
    write(path, b"read\nnew\n")
    start = json.dumps({path: [os.stat(path).st_ino, 5]})
    reader = tail.TailReader({"path": path, "startingOffsets": start})
    assert lines_between(reader, reader.initialOffset(), reader.latestOffset()) == ["new"]
    os.rename(path, path + ".1")
    write(path, b"next\n")
    reader = tail.TailReader({"path": path, "startingOffsets": start})
    assert lines_between(reader, reader.initialOffset(), reader.latestOffset()) == ["new", "next"]


def test_tail_splits_large_ranges(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "SPLIT_BYTES", 64)
    monkeypatch.setattr(tail, "_PROBE", 7)
    path = str(tmp_path / "big.log")
    lines = [f"line {i}" for i in range(100)]
    write(path, ("\n".join(lines) + "\n").encode())
    reader = tail.TailReader({"path": path})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(parts) > 5 and [r[2] for p in parts for r in reader.read(p)] == lines


def test_tail_stream_resumes_without_rereading(spark, tmp_path):
    tail.register(spark)
    logs, out, checkpoint = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "cp")
    logs.mkdir()
    for text in (b"a error\nb\n", b"c info\n"):
        write(str(logs / "x.log"), text)
        q = (spark.readStream.format("pulsegrid_tail").option("path", f"{logs}/*.log").load()
             .writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
             .trigger(processingTime="0 seconds").start())
        q.processAllAvailable()
        q.stop()
    rows = spark.read.parquet(out).orderBy("seq").collect()
    assert [(r.seq, r.line) for r in rows] == [(0, "a error"), (8, "b"), (10, "c info")]


def test_replayed_batch_changes_nothing(spark, tmp_path):
    rows = random_entries(3, minutes=80)
    parts = [frame(spark, [r for r in rows if a <= r[0] < b]) for a, b in ((0, 2400), (2400, 10**9))]
    job = engine.Run(spark, f"{tmp_path}/out", PARAMS, "0 seconds")
    seen = []
    for batch, part in ((0, parts[0]), (1, parts[1]), (1, parts[1])):
        job.add(part, batch)
        seen.append(sorted(map(str, engine.stored_alerts(spark, f"{tmp_path}/out").collect())))
    assert len(seen[0]) < len(seen[1]) and seen[1] == seen[2]
    # A micro-batch that did not finish is not read.
    job.tables.drop("progress", 1)
    assert sorted(map(str, engine.stored_alerts(spark, f"{tmp_path}/out").collect())) == seen[0]
    job.add(parts[1], 1)
    assert sorted(map(str, engine.stored_alerts(spark, f"{tmp_path}/out").collect())) == seen[1]
    job.add(parts[1].limit(0), 2)  # nothing new
    assert sorted(map(str, engine.stored_alerts(spark, f"{tmp_path}/out").collect())) == seen[1]


def test_acknowledged_alert_is_not_resolved(spark, tmp_path):
    """Two open spikes, the newer acknowledged between micro-batches: clean windows resolve the older."""
    minute = lambda m, bad: [(60.0 * m + i, "ERROR" if i < bad else "INFO", "boom", "s", "t", "svc", None) for i in range(10)]
    rows = [r for m in range(12) for r in minute(m, 0)] + minute(12, 3) + minute(13, 9) + minute(14, 0)
    more = [r for m in range(15, 20) for r in minute(m, 0)]
    root, params = f"{tmp_path}/out", DetectorParams(warmup_required=1)
    asked = []
    requests = lambda: spark.createDataFrame(asked, "tenant_id string, alert_id string, user_id string, acked_at timestamp")
    job = engine.Run(spark, root, params, "0 seconds", acks=requests)
    job.add(frame(spark, rows), 0)
    spikes = engine.stored_alerts(spark, root).filter("anomaly_type = 'ERROR_RATE_SPIKE'").orderBy("detected_at").collect()
    assert [r.status for r in spikes] == ["open", "open"]
    asked.append(("t", spikes[1].id, "u", at(14.5 * 60)))
    job.add(frame(spark, more), 1)
    now = {r.id: r.status for r in engine.stored_alerts(spark, root, requests()).collect()}
    assert [now[r.id] for r in spikes] == ["resolved", "acknowledged"]


def test_any_number_of_patterns_is_stored(spark, tmp_path):
    """Every pattern alerts once, and again after a day."""
    letters = [f"boom {'abcdefghijklmnopqrstuvwxyz'[i % 26]} {'abcdefghijklmnopqrstuvwxyz'[i // 26 % 26]} {'xyz'[i // 676]}" for i in range(1205)]
    job = engine.Run(spark, f"{tmp_path}/out", DetectorParams(warmup_required=1), "0 seconds")
    seen = []
    for batch, minute in enumerate((0, 1, 1441, 1442, 1443)):
        job.add(frame(spark, [(60.0 * minute, "ERROR", m, "s", "t", "svc", None) for m in letters]), batch)
        seen.append(engine.stored_alerts(spark, f"{tmp_path}/out").filter("anomaly_type = 'NOVEL_ERROR'").count())
    assert seen == [0, 1205, 1205, 2410, 2410]


def test_landing_folder(spark, tmp_path):
    from pulsegrid.sources import landing

    (tmp_path / "a.json").write_text('{"batch_id":1,"key_hash":"h","received_at":"2026-01-01T00:00:00Z",'
                                     '"entries":[{"message":"m","level":"error","metadata":{"a":"b"}}]}\n')
    row = landing.pushed_files(spark, str(tmp_path)).collect()[0]
    assert row.entries[0].message == "m" and row.entries[0].metadata == {"a": "b"}
    assert landing.pushed_stream(spark, str(tmp_path)).isStreaming


def test_event_slices_are_written_by_many_tasks(spark, tmp_path):
    rows = [(i, f"2024-01-{1 + i % 28:02} 00:00:00", i, "error", 1.0, "{}") for i in range(600)]
    events = spark.createDataFrame(rows, "event_id bigint, at string, user_id bigint, event_type string, value double, props string")
    events = events.coalesce(1).selectExpr("event_id", "cast(at as timestamp) ts", "user_id", "event_type", "value", "props")
    events.write.parquet(str(tmp_path / "events.parquet"))
    taken = []
    for slice_ in fixtures.event_slices(spark, str(tmp_path), str(tmp_path / "in")):
        folder = tmp_path / "in" / f"part={len(taken)}"
        assert len(list(folder.glob("*.parquet"))) > 1
        add = lambda df, batch: taken.append((batch, df.count()))
        slice_.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(add).trigger(
            availableNow=True).start().awaitTermination()
    early = sum(i % 28 < 14 for i in range(600))
    assert taken == [(0, early), (1, 600 - early)]
