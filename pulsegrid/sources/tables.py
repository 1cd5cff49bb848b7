"""Stored tables: dimensions, date-partitioned facts and their current state (for writes see `versions`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE = "part_date"


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_dated(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A date-partitioned table; filters on `part_date` prune folders."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if DATE not in schema.names:
        schema = T.StructType([*schema.fields, T.StructField(DATE, T.DateType())])
    return spark.read.schema(schema).parquet(path)


def upsert_by_key(stored: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `changes` replace those of `stored` with the same key (cursors, states)."""
    return stored.join(changes.select(*keys), keys, "left_anti").unionByName(changes.select(*stored.columns))


def current_alerts(opened: DataFrame, closed: DataFrame, acks: DataFrame | None = None) -> DataFrame:
    """Alerts as they stand, from the append-only tables of openings, closings and requests.

    A closing does not touch an alert that was acknowledged before it.
    """
    from pulsegrid.operators import lifecycle

    first = closed.groupBy("id").agg(F.min("resolved_at").alias("resolved_at"))
    if acks is None:
        return lifecycle.apply_resolutions(opened, first)
    asked = acks.groupBy("tenant_id", F.col("alert_id").alias("id")).agg(F.min("acked_at").alias("acked_at"))
    early = opened.select("id", "tenant_id").join(asked, ["tenant_id", "id"])
    counts = first.join(early.select("id", "acked_at"), "id", "left").filter(
        "acked_at is null or resolved_at <= acked_at").select("id", "resolved_at")
    return lifecycle.apply_acks(lifecycle.apply_resolutions(opened, counts), acks)


def latest_cursors(cursors: DataFrame) -> DataFrame:
    """The newest cursor of each source from an append-only cursor log."""
    return cursors.groupBy("source_id", "tenant_id").agg(
        F.max("updated_at").alias("updated_at")).join(cursors, ["source_id", "tenant_id", "updated_at"])


