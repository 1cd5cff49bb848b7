"""Streaming detection: each micro-batch adds to stored windows, and the batch operators judge those that close.

A micro-batch's entries become rows of partial windows, which merge with any other part of the same window. The
watermark is the newest event time seen less the delay; windows that end by it are judged, once, by the same plan as a
batch run, from the state that the micro-batch before left. Entries that come later than that still reach their stored
windows: a window read is always the merge of all its parts. Alerts already raised stay as they were.

Every micro-batch owns one folder per table, named by its id and overwritten when it is replayed, and reads only what
earlier ones left; its progress row is written last, and readers stop at the newest one. So a replay or a crash changes
nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.operators import detectors, observe
from pulsegrid.operators.observe import KEYS
from pulsegrid.operators.ordered import running
from pulsegrid.params import MICROS, DetectorParams
from pulsegrid.plans.batch import WindowDetection
from pulsegrid.schemas import ALERT, CLOSING, PROGRESS, SILENCE, WINDOW_PART
from pulsegrid.session import materialize, prepare
from pulsegrid.sources.tables import DATE, current_alerts

# What the next micro-batch resumes from, whole as of one micro-batch.
SNAPSHOTS = {
    "state": None, "patterns": "tenant_id string, source_id string, fp string, last_at timestamp",
    "open": "id string, tenant_id string, source_id string, anomaly_type string, service_name string, "
            "detected_at timestamp, status string",
    "fired": "tenant_id string, last_at timestamp",
}

FILES_A_DATE = 8

Requests = Callable[[], DataFrame]


@dataclass
class Progress:
    """Microseconds: the newest event, the watermark, and the end of the judged windows; `kept` names the snapshots."""

    batch: int = -1
    newest: int | None = None
    watermark: int | None = None
    judged: int | None = None
    kept: int = -1


class StreamTables:
    """The tables under one root: batch=<id> folders, facts with a date folder inside."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def path(self, table: str, batch: int | None = None) -> str:
        return f"{self.root}/{table}" + ("" if batch is None else f"/batch={batch}")

    def _folder(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self, table: str) -> list[int]:
        folder, files = self._folder(self.path(table))
        if not files.exists(folder):
            return []
        return sorted(int(s.getPath().getName().removeprefix("batch=")) for s in files.listStatus(folder))

    def write(self, df: DataFrame, table: str, batch: int, at: str | None = None) -> None:
        """`at` names the time that dates a fact; snapshots have none."""
        if at is None:
            df.write.mode("overwrite").parquet(self.path(table, batch))
        else:
            dated = df.withColumn(DATE, F.to_date(at))
            dated.write.mode("overwrite").partitionBy(DATE).parquet(self.path(table, batch))

    def drop(self, table: str, batch: int) -> None:
        folder, files = self._folder(self.path(table, batch))
        files.delete(folder, True)

    def facts(self, table: str, schema: T.StructType, upto: int) -> DataFrame:
        """A fact table through a micro-batch; filters on `part_date` prune folders."""
        if not self.batches(table):
            return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(DATE, T.DateType())]))
        whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField(DATE, T.DateType())])
        rows = self.spark.read.schema(whole).option("basePath", self.path(table)).parquet(self.path(table))
        return rows.filter(F.col("batch") <= upto).drop("batch")

    def of_batch(self, table: str, schema: T.StructType, batch: int) -> DataFrame:
        """What one micro-batch wrote."""
        if batch not in self.batches(table):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(table, batch))

    def snapshot(self, table: str, batch: int) -> DataFrame | None:
        if batch < 0:
            return None
        reader = self.spark.read
        return (reader.schema(SNAPSHOTS[table]) if SNAPSHOTS[table] else reader).parquet(self.path(table, batch))

    def progress(self, before: int | None = None) -> Progress:
        """Where the newest finished micro-batch, or the newest before one, left off."""
        done = [b for b in self.batches("progress") if before is None or b < before]
        if not done:
            return Progress()
        row = self.spark.read.schema(PROGRESS).parquet(self.path("progress", done[-1])).collect()[0]
        return Progress(done[-1], row.newest, row.watermark, row.judged, row.kept)


def _window_end(at: int, params: DetectorParams) -> int:
    width = params.window_s * MICROS
    return at // width * width


def _seconds(delay: str) -> float:
    """An interval such as '1 minute' in seconds."""
    from pandas import Timedelta

    return Timedelta(delay).total_seconds()


class Run:
    """One stream's micro-batches, over the tables under `root`."""

    def __init__(
        self, spark: SparkSession, root: str, params: DetectorParams, delay: str = "1 minute",
        state: DataFrame | None = None, acks: Requests | None = None,
    ) -> None:
        self.tables, self.params, self.delay = StreamTables(spark, root), params, int(_seconds(delay) * MICROS)
        self.first_state, self.acks = state, acks

    def add(self, entries: DataFrame, batch: int) -> None:
        """Store a micro-batch of entries and judge the windows that it closes."""
        was = self.tables.progress(before=batch)
        parts = observe.window_rows(entries, self.params)
        late = F.lit(False) if was.judged is None else F.col("unit") < was.judged
        rows = parts.withColumn("late", late).withColumn("_at", F.timestamp_micros("unit"))
        # A few files a date, whatever the number of tasks.
        rows = rows.repartition(F.to_date("_at"), F.pmod(F.hash("source_id", "unit", "message"), F.lit(FILES_A_DATE)))
        self.tables.write(rows.select(*WINDOW_PART.names, "_at"), "windows", batch, "_at")
        came = self.tables.spark.read.schema(WINDOW_PART).parquet(self.tables.path("windows", batch))
        newest = came.agg(F.unix_micros(F.max("max_ts"))).collect()[0][0]
        newest = max((x for x in (newest, was.newest) if x is not None), default=None)
        if newest is None:
            return self._finish(was, batch, was)
        watermark = max(newest - self.delay, was.watermark if was.watermark is not None else newest - self.delay)
        self._judge(was, batch, Progress(batch, newest, watermark, _window_end(watermark, self.params), was.kept))

    def close(self) -> None:
        """Judge the windows still open, as at the end of a bounded run. A stream that goes on writes over this."""
        was = self.tables.progress()
        if was.newest is not None:
            end = _window_end(was.newest, self.params) + self.params.window_s * MICROS
            for table in ("windows", "opened", "closed", "silences"):
                self.tables.drop(table, was.batch + 1)
            self._judge(was, was.batch + 1, Progress(was.batch + 1, was.newest, was.newest, end, was.kept))

    def _judge(self, was: Progress, batch: int, now: Progress) -> None:
        self._silences(was, batch, now)
        if was.judged is not None and now.judged <= was.judged:
            now.judged = was.judged
            return self._finish(was, batch, now)
        tables, params = self.tables, self.params
        windows = tables.facts("windows", WINDOW_PART, batch).filter(F.col("unit") < now.judged)
        if was.judged is not None:
            since = F.to_date(F.timestamp_micros(F.lit(was.judged)))
            windows = windows.filter((F.col("unit") >= was.judged) & (F.col(DATE) >= since))
        windows = materialize(observe.merged_windows(windows), "closing")
        state, patterns, opened, fired = (tables.snapshot(t, was.kept) for t in SNAPSHOTS)
        run = WindowDetection(
            windows, params, state=self.first_state if state is None else state, open_alerts=opened,
            last_cascades=fired, patterns=patterns, acks=None if self.acks is None else self.acks())
        alerts = materialize(run.alerts.drop("acknowledged_by", "acknowledged_at"), "stream-alerts")
        # What was asked for is told at reading; here an alert is open until it is resolved.
        status = F.when(F.col("status") == "acknowledged", "open").otherwise(F.col("status"))
        whole = alerts.withColumns({
            "status": status, "acknowledged_by": F.lit(None).cast("string"), "acknowledged_at": F.lit(None).cast("timestamp")})
        tables.write(whole.select(*ALERT.names), "opened", batch, "detected_at")
        kinds = [detectors.SPIKE, detectors.LATENCY, detectors.SUSTAINED]
        left = whole.filter(F.col("anomaly_type").isin(kinds) & (F.col("status") == "open"))
        left = left.select("id", *KEYS, "anomaly_type", "service_name", "detected_at", "status")
        if opened is not None:
            tables.write(run.closed_earlier, "closed", batch, "resolved_at")
            left = left.unionByName(opened.join(run.closed_earlier, "id", "left_anti").select(*left.columns))
        if run.acked is not None:  # rows judged from now on come after these requests
            gone = run.acked.filter(F.unix_micros("acked_at") < now.judged).select(*KEYS, "anomaly_type", "pos")
            ids = run.placed.join(gone, [*KEYS, "anomaly_type", "pos"]).select("id") if opened is not None else None
            own = alerts.filter("status = 'acknowledged'").join(
                self.acks().groupBy(F.col("alert_id").alias("id")).agg(F.min("acked_at").alias("_at")), "id")
            own = own.filter(F.unix_micros("_at") < now.judged).select("id")
            left = left.join(own if ids is None else own.unionByName(ids), "id", "left_anti")
        tables.write(left, "open", batch)
        latest = alerts.filter(F.col("anomaly_type") == detectors.CASCADE).groupBy("tenant_id").agg(
            F.max("detected_at").alias("last_at"))
        if fired is not None:
            latest = latest.unionByName(fired).groupBy("tenant_id").agg(F.max("last_at").alias("last_at"))
        tables.write(latest, "fired", batch)
        tables.write(run.next_patterns, "patterns", batch)
        tables.write(run.next_state, "state", batch)
        now.kept = batch
        self._finish(was, batch, now)

    def _silences(self, was: Progress, batch: int, now: Progress) -> None:
        """Report each silence once, when the watermark has passed its due time without a new entry."""
        limit = self.params.silence_s * MICROS
        recent = self.tables.facts("windows", WINDOW_PART, batch)
        if was.watermark is not None:
            # A silence that falls due now began with an entry at most this old.
            since = was.watermark - limit - self.params.window_s * MICROS
            recent = recent.filter((F.col("unit") >= since) & (F.col(DATE) >= F.to_date(F.timestamp_micros(F.lit(since)))))
        due = silences(recent, self.params, now.watermark)
        if was.watermark is not None:
            due = due.filter(F.unix_micros("due_at") > was.watermark)
        self.tables.write(due, "silences", batch, "due_at")

    def _finish(self, was: Progress, batch: int, now: Progress) -> None:
        row = (now.newest, now.watermark, now.judged, now.kept)
        self.tables.write(self.tables.spark.createDataFrame([row], PROGRESS).coalesce(1), "progress", batch)
        for table in (*SNAPSHOTS, "progress"):
            # A replay of this micro-batch still needs what it resumed from.
            for old in self.tables.batches(table):
                if old < (was.batch if table == "progress" else was.kept):
                    self.tables.drop(table, old)


def silences(windows: DataFrame, params: DetectorParams, clock: int) -> DataFrame:
    """Entries after which their source had none for `silence_s`, by `clock` (microseconds): `last_log_at`, `due_at`.

    Windows become two marks, at their first and at their last entry; a running maximum over time cells tells the
    last entry before each window.
    """
    units = windows.groupBy(*KEYS, "unit").agg(
        F.unix_micros(F.min("min_ts")).alias("first"), F.unix_micros(F.max("max_ts")).alias("last"))
    mark = lambda at, kind, last: F.struct(at.alias("at"), F.lit(kind).alias("kind"), last.alias("last"))
    marks = units.select(*KEYS, F.inline(F.array(
        mark(F.col("first"), 0, F.lit(None).cast("bigint")), mark(F.col("last"), 1, F.col("last")))))
    marks = materialize(marks, "marks")
    ended = running(marks, KEYS, F.floor(F.col("at") / F.lit(params.cell_s * MICROS)), ["at", "kind"], {
        "before": ("max", F.col("last"))}).filter("kind = 0").select(*KEYS, "before", "at")
    newest = marks.groupBy(*KEYS).agg(F.max("last").alias("before")).withColumn("at", F.lit(None).cast("bigint"))
    due = F.col("before") + params.silence_s * MICROS
    over = (due <= clock) & (F.col("at").isNull() | (F.col("at") >= due))
    return ended.unionByName(newest).filter(over).select(
        *KEYS, F.timestamp_micros("before").alias("last_log_at"), F.timestamp_micros(due).alias("due_at"))


def start(
    entries: DataFrame, root: str, checkpoint: str, params: DetectorParams, delay: str = "1 minute",
    state: DataFrame | None = None, trigger: dict | None = None, acks: Requests | None = None,
) -> StreamingQuery:
    """Run detection over a stream of LOG_ENTRY rows into the tables under `root`.

    `acks` gives the requests known by now (tenant_id, alert_id, user_id, acked_at); it is asked once a micro-batch.
    """
    run = Run(prepare(entries.sparkSession), root, params, delay, state, acks)
    return (
        entries.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run.add)
        .trigger(**(trigger or {"processingTime": "1 minute"})).start()
    )


def stored_alerts(spark: SparkSession, root: str, acks: DataFrame | None = None) -> DataFrame:
    """Alerts of a streaming run as they stand."""
    tables = StreamTables(spark, root)
    upto = tables.progress().batch
    opened = tables.facts("opened", ALERT, upto).select(*ALERT.names)
    return current_alerts(opened, tables.facts("closed", CLOSING, upto).select(*CLOSING.names), acks)


def stored_windows(spark: SparkSession, root: str) -> DataFrame:
    """Every window of a streaming run with all entries that came, late ones included."""
    tables = StreamTables(spark, root)
    return observe.merged_windows(tables.facts("windows", WINDOW_PART, tables.progress().batch))


def late_windows(spark: SparkSession, root: str) -> DataFrame:
    """What came after its window had been judged."""
    tables = StreamTables(spark, root)
    return tables.facts("windows", WINDOW_PART, tables.progress().batch).filter("late").drop("late", DATE)


def stored_silences(spark: SparkSession, root: str) -> DataFrame:
    tables = StreamTables(spark, root)
    return tables.facts("silences", SILENCE, tables.progress().batch).select(*SILENCE.names)
