"""Entries to observations: one row per (tenant, source) and batch or window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.text import fingerprint, is_error
from pulsegrid.params import MICROS, DetectorParams

KEYS = ["tenant_id", "source_id"]


def with_unit(entries: DataFrame, params: DetectorParams) -> DataFrame:
    """Add `unit` (batch id, or window start in microseconds) and `seq`, the arrival order.

    An input without `seq` is taken to arrive in event order.
    """
    if params.batch_col:
        unit = F.col(params.batch_col).cast("bigint")
    else:
        width = params.window_s * MICROS
        unit = F.floor(F.unix_micros("occurred_at") / F.lit(width)) * F.lit(width)
    out = entries.withColumn("unit", unit)
    return out if "seq" in out.columns else out.withColumn("seq", F.unix_micros("occurred_at"))


def fine_observations(entries: DataFrame, params: DetectorParams) -> DataFrame:
    """First-level aggregate: per unit, error fingerprint and service.

    The only pass over all entries. Every buffer is a number, so Spark hash
    aggregates on the map side before anything is shuffled.
    """
    rows = with_unit(entries, params)
    arrived = F.col("received_at") if "received_at" in rows.columns else F.col("occurred_at")
    return (
        rows.withColumn("fp", F.when(is_error(F.col("level")), fingerprint(F.col("message"))))
        .groupBy(*KEYS, "unit", "fp", "service_name", "environment")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("latency_ms").alias("n_lat"),
            F.sum("latency_ms").alias("lat_sum"),
            F.min("occurred_at").alias("min_ts"),
            F.max("occurred_at").alias("max_ts"),
            F.max(arrived).alias("arrived_at"),
            F.min("seq").alias("first_seq"),
        )
    )


def unit_time(params: DetectorParams) -> Column:
    """When a unit is judged: the window's end, or the batch's arrival."""
    if params.batch_col:
        return F.max("arrived_at")
    return F.timestamp_micros(F.max("unit") + F.lit(params.window_s * MICROS))


def observations(fine: DataFrame, params: DetectorParams) -> DataFrame:
    """Second-level aggregate: error fraction, mean latency, volume, time range, first service."""
    n_err = F.coalesce(F.sum(F.when(F.col("fp").isNotNull(), F.col("n"))), F.lit(0))
    return fine.groupBy(*KEYS, "unit").agg(
        unit_time(params).alias("detected_at"),
        F.sum("n").alias("n"),
        n_err.alias("n_err"),
        (n_err / F.sum("n")).alias("error_rate"),
        F.sum("n_lat").alias("n_lat"),
        (F.sum("lat_sum") / F.sum("n_lat")).alias("lat_mean"),
        F.min("min_ts").alias("min_ts"),
        F.max("max_ts").alias("max_ts"),
        F.min_by("service_name", "first_seq").alias("service_name"),
        F.min_by("environment", "first_seq").alias("environment"),
    )


def error_patterns(fine: DataFrame, params: DetectorParams) -> DataFrame:
    """Distinct error fingerprints per unit, with the entry that showed each first."""
    return (
        fine.filter("fp is not null").groupBy(*KEYS, "unit", "fp")
        .agg(unit_time(params).alias("detected_at"), F.min("first_seq").alias("first_seq"))
    )


def representative_messages(entries: DataFrame, units: DataFrame, params: DetectorParams, keep: int = 3) -> DataFrame:
    """The first `keep` distinct error messages of the given units, in arrival order.

    Only error entries of those units are read, reduced to one row per message on
    the map side and to `keep` rows per unit before the final sort.
    """
    errors = with_unit(entries.filter(is_error(F.col("level"))), params)
    return first_messages(errors.select(*KEYS, "unit", "message", "seq"), units, keep)


def first_messages(seen: DataFrame, units: DataFrame, keep: int = 3) -> DataFrame:
    """The first `keep` messages of the given units; `seen` holds keys, unit, message and seq."""
    wanted = units.select(*KEYS, "unit").distinct()
    first = (
        seen.join(wanted, [*KEYS, "unit"], "left_semi")
        .groupBy(*KEYS, "unit", "message").agg(F.min("seq").alias("seq"))
    )
    rank = F.row_number().over(Window.partitionBy(*KEYS, "unit").orderBy("seq", "message"))
    return (
        first.withColumn("rank", rank).filter(F.col("rank") <= keep)
        .groupBy(*KEYS, "unit")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "message"))).alias("ranked"))
        .select(*KEYS, "unit", F.col("ranked.message").alias("messages"))
    )


def first_entries(entries: DataFrame, patterns: DataFrame, params: DetectorParams) -> DataFrame:
    """Message, time and service of the entry that showed each given pattern first."""
    errors = with_unit(entries.filter(is_error(F.col("level"))), params)
    # Matched by arrival first: fingerprints are computed for the few matches only.
    found = errors.select(*KEYS, "unit", "seq", "message", "occurred_at", "service_name", "environment").join(
        _showing(patterns), [*KEYS, "unit", "seq"])
    return _earliest(found.filter(fingerprint(F.col("message")) == F.col("fp")))


def _showing(patterns: DataFrame) -> DataFrame:
    return patterns.select(*KEYS, "unit", "fp", F.col("first_seq").alias("seq"))


def _earliest(found: DataFrame) -> DataFrame:
    return (
        found.groupBy(*KEYS, "unit", "fp")
        .agg(F.min(F.struct("message", "occurred_at", "service_name", "environment")).alias("e"))
        .select(*KEYS, "unit", "fp", "e.*")
    )


# -- windows as mergeable rows -------------------------------------------------


def window_rows(entries: DataFrame, params: DetectorParams) -> DataFrame:
    """`fine_observations` per error message too, so that windows of several deliveries can be merged.

    Whatever part of a window's entries a row covers, `merged_windows` of all parts is the row of all entries.
    """
    rows = with_unit(entries, params)
    arrived = F.col("received_at") if "received_at" in rows.columns else F.col("occurred_at")
    rows = rows.withColumn("fp", F.when(is_error(F.col("level")), fingerprint(F.col("message")))).withColumns({
        "message": F.when(F.col("fp").isNotNull(), F.col("message")), "n": F.lit(1).cast("bigint"),
        "n_lat": F.col("latency_ms").isNotNull().cast("bigint"), "lat_sum": F.col("latency_ms"),
        "min_ts": F.col("occurred_at"), "max_ts": F.col("occurred_at"), "arrived_at": arrived,
        "first_seq": F.col("seq").cast("bigint"), "first_ts": F.col("occurred_at"),
    })
    return merged_windows(rows)


def merged_windows(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS, "unit", "fp", "message", "service_name", "environment").agg(
        F.sum("n").alias("n"), F.sum("n_lat").alias("n_lat"), F.sum("lat_sum").alias("lat_sum"),
        F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"), F.max("arrived_at").alias("arrived_at"),
        F.min_by("first_ts", "first_seq").alias("first_ts"), F.min("first_seq").alias("first_seq"),
    )


def fine_of_windows(windows: DataFrame) -> DataFrame:
    """`fine_observations` out of window rows."""
    return windows.groupBy(*KEYS, "unit", "fp", "service_name", "environment").agg(
        F.sum("n").alias("n"), F.sum("n_lat").alias("n_lat"), F.sum("lat_sum").alias("lat_sum"),
        F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"), F.max("arrived_at").alias("arrived_at"),
        F.min("first_seq").alias("first_seq"),
    )


def first_entries_of_windows(windows: DataFrame, patterns: DataFrame) -> DataFrame:
    """`first_entries` out of window rows."""
    errors = windows.filter("fp is not null").select(
        *KEYS, "unit", "fp", F.col("first_seq").alias("seq"), "message", F.col("first_ts").alias("occurred_at"),
        "service_name", "environment")
    return _earliest(errors.join(_showing(patterns), [*KEYS, "unit", "fp", "seq"]))
