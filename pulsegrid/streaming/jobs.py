"""Whole jobs: from a source to stored alerts, the delivery queue and the cursors, one micro-batch at a time.

Everything a micro-batch writes carries its id (see `engine.StreamTables`), so a replay writes the same again. Registry
tables are given as functions and read anew in every micro-batch, so a new source or key counts from the next one on.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.functions.parsing import normalize_lines
from pulsegrid.operators import ingest, registry, routing
from pulsegrid.params import DetectorParams
from pulsegrid.schemas import ALERT, ARRIVAL, PUSHED_BATCH, QUEUED, SOURCE_STATE
from pulsegrid.session import materialize, prepare
from pulsegrid.sources import landing, tail
from pulsegrid.sources.tables import latest_cursors, upsert_by_key
from pulsegrid.streaming.engine import Run, StreamTables

Registry = Callable[[], DataFrame]


def _arrived(tables: StreamTables, batch: int):
    """When a micro-batch first came; a replay keeps the time."""
    stored = tables.of_batch("arrivals", ARRIVAL, batch)
    if stored.isEmpty():
        tables.write(tables.spark.range(1).select(F.current_timestamp().alias("arrived_at")), "arrivals", batch)
        stored = tables.of_batch("arrivals", ARRIVAL, batch)
    return F.lit(stored.collect()[0]["arrived_at"])


def _queue(tables: StreamTables, batch: int, keys: Registry | None, signer: routing.Signer | None) -> None:
    if keys is not None:
        new = tables.of_batch("opened", ALERT, batch)
        queue = routing.delivery_queue(new, keys(), signer).join(new.select(F.col("id").alias("alert_id"), "detected_at"), "alert_id")
        tables.write(queue.select(*QUEUED.names, "detected_at"), "queue", batch, "detected_at")


def _stream(rows: DataFrame, checkpoint: str, handle, trigger: dict | None) -> StreamingQuery:
    return (
        rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
        .trigger(**(trigger or {"processingTime": "1 minute"})).start()
    )


def follow_files(
    spark: SparkSession, sources: Registry, cursors: Registry, root: str, checkpoint: str, params: DetectorParams,
    keys: Registry | None = None, delay: str = "1 minute", trigger: dict | None = None, signer: routing.Signer | None = None,
) -> StreamingQuery:
    """Follow the log files of the active file sources: lines become entries, windows, alerts and deliveries.

    A source's lines are those of the file it names. `cursors` (SOURCE_STATE) tell where a stream without a checkpoint
    of its own begins; the newest are stored with every micro-batch (`stored_cursors`). Files of sources that are
    registered later are followed after a restart.
    """
    prepare(spark)
    tail.register(spark)
    active = registry.active_sources(sources(), cursors()).filter("source_type = 'file' and file_path is not null")
    known = active.select("file_path", "file_inode", "byte_offset").collect()  # one small row per registered file
    if not known:
        raise ValueError("no active file source is registered")
    offsets = {r.file_path: [r.file_inode, r.byte_offset] for r in known if r.file_inode}
    lines = spark.readStream.format("pulsegrid_tail").option("path", os.pathsep.join(sorted({r.file_path for r in known}))).option(
        "startingOffsets", json.dumps(offsets)).load()
    run = Run(spark, root, params, delay)

    def handle(batch: DataFrame, number: int) -> None:
        rows = materialize(batch, "lines", spark)
        now = _arrived(run.tables, number)
        of = registry.active_sources(sources(), cursors()).filter("source_type = 'file'")
        named = rows.join(of.select(
            F.col("file_path").alias("path"), "source_id", "tenant_id", "service_name", "environment", "log_format",
            "latency_field"), "path").withColumn("ingest_ts", now)
        where = ["path", "inode", "until", "rotated"]
        run.add(normalize_lines(named).drop(*where), number)
        _queue(run.tables, number, keys, signer)
        # The file that is not rotated is the one to go on with.
        place = named.filter("not rotated").groupBy("source_id", "tenant_id").agg(
            F.max("until").alias("byte_offset"), F.max_by("inode", "until").alias("file_inode")).select(
            "source_id", "tenant_id", "byte_offset", "file_inode", F.lit(None).cast("string").alias("last_seen_id"),
            now.alias("updated_at"))
        run.tables.write(place.select(*SOURCE_STATE.names), "cursors", number, "updated_at")

    return _stream(lines, checkpoint, handle, trigger)


def stored_cursors(spark: SparkSession, root: str, before: DataFrame | None = None) -> DataFrame:
    """The newest cursor of every source, over those stored `before`."""
    tables = StreamTables(spark, root)
    log = tables.facts("cursors", SOURCE_STATE, tables.progress().batch).select(*SOURCE_STATE.names)
    newest = latest_cursors(log).select(*SOURCE_STATE.names)
    return newest if before is None else upsert_by_key(before.select(*SOURCE_STATE.names), newest, ["source_id"])


def take_pushes(
    spark: SparkSession, folder: str, keys: Registry, root: str, checkpoint: str, params: DetectorParams,
    delay: str = "1 minute", trigger: dict | None = None, signer: routing.Signer | None = None,
    max_entries: int | None = None, max_files: int = 1000,
) -> StreamingQuery:
    """Take pushed batches from a landing folder: accepted ones become entries, windows, alerts and deliveries.

    Refused batches are stored whole with the reason (`refused_batches`).
    """
    run = Run(prepare(spark), root, params, delay)

    def handle(batch: DataFrame, number: int) -> None:
        batches = materialize(batch, "pushes", spark)
        accepted, refused = ingest.split_batches(batches, keys(), max_entries)
        kept = refused.select(*PUSHED_BATCH.names, "reason", F.coalesce("received_at", F.lit("1970-01-01").cast("timestamp")).alias("_at"))
        run.tables.write(kept, "refused", number, "_at")
        entries = ingest.pushed_entries(accepted)
        entries = entries.withColumn("seq", F.unix_micros("received_at") + F.col("seq")).drop("batch_id", "received_at", "raw")
        run.add(entries, number)
        _queue(run.tables, number, keys, signer)

    return _stream(landing.pushed_stream(spark, folder, max_files), checkpoint, handle, trigger)


def refused_batches(spark: SparkSession, root: str) -> DataFrame:
    tables = StreamTables(spark, root)
    schema = T.StructType([*PUSHED_BATCH.fields, T.StructField("reason", T.StringType())])
    return tables.facts("refused", schema, tables.progress().batch).select(*schema.names)


def stored_queue(spark: SparkSession, root: str) -> DataFrame:
    """First attempts due for every alert of a job."""
    tables = StreamTables(spark, root)
    return tables.facts("queue", QUEUED, tables.progress().batch).select(*QUEUED.names)
