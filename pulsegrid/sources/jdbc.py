"""External SQL tables: column discovery, incremental scan, row mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions.parsing import parse_timestamp

# Accepted column names in order of preference.
REQUIRED = ("id", "message")
LEVEL_COLUMNS = ("level", "lvl", "severity", "log_level")
TIME_COLUMNS = ("timestamp", "created_at", "occurred_at", "time", "ts")
LATENCY_COLUMNS = ("latency_ms", "latency", "duration", "elapsed")

JDBC_PREFIX = {"postgres": "jdbc:postgresql:", "postgresql": "jdbc:postgresql:", "mysql": "jdbc:mysql:",
               "sqlite": "jdbc:sqlite:"}


def table_name(connection: str) -> str:
    """The `table` option of a connection string, else `logs`."""
    _, found, rest = connection.partition("?table=")
    return rest.split("&")[0] if found else "logs"


def jdbc_url(connection: str, source_type: str) -> str:
    """A JDBC URL for a connection string; one that already is a JDBC URL stays."""
    bare = connection.partition("?table=")[0]
    if bare.startswith("jdbc:"):
        return bare
    rest = bare.split("://", 1)[-1]
    prefix = JDBC_PREFIX[source_type]
    return prefix + (rest.lstrip("/") if source_type == "sqlite" else f"//{rest}")


def read_external(
    spark: SparkSession, connection: str, source_type: str, last_id: int | None = None,
    upper_id: int | None = None, partitions: int = 8, **options: str,
) -> DataFrame:
    """The external table, split by numeric id so that executors read ranges side by side."""
    reader = spark.read.format("jdbc").options(
        url=jdbc_url(connection, source_type), dbtable=table_name(connection), **options)
    if last_id is not None and upper_id is not None and upper_id > last_id:
        reader = reader.options(partitionColumn="id", lowerBound=last_id, upperBound=upper_id,
                                numPartitions=partitions)
    return reader.load()


def discover(columns: list[str], latency_field: str | None = None) -> dict[str, str | None]:
    """Which columns carry level, time and latency. A configured latency column wins."""
    missing = [c for c in REQUIRED if c not in columns]
    if missing:
        raise ValueError(f"table lacks required column(s): {missing}")
    first = lambda names: next((c for c in names if c in columns), None)
    latency = latency_field if latency_field in columns else first(LATENCY_COLUMNS)
    return {"level": first(LEVEL_COLUMNS), "time": first(TIME_COLUMNS), "latency": latency}


def rows_after(table: DataFrame, last_id: str | None) -> DataFrame:
    """Rows beyond the high-water mark, which reaches the database as a plain comparison.

    Numeric ids compare as numbers, so 10 follows 9; text ids compare as text.
    """
    numeric = isinstance(table.schema["id"].dataType, T.NumericType)
    mark = F.lit(int(last_id or 0)) if numeric else F.lit(last_id or "0")
    return table.filter(F.col("id") > mark)


def high_water_mark(rows: DataFrame) -> DataFrame:
    """The mark after a scan: one row, null when nothing new was read."""
    return rows.agg(F.max("id").cast("string").alias("last_seen_id"))


def table_entries(
    rows: DataFrame, ingest_ts: Column, source: dict[str, str], latency_field: str | None = None
) -> DataFrame:
    """LOG_ENTRY rows of an external table. `source` gives source_id, tenant_id, service_name, environment."""
    cols = discover(rows.columns, latency_field)

    def text(name: str | None) -> Column:
        return F.nullif(F.col(name).cast("string"), F.lit("")) if name else F.lit(None).cast("string")

    if cols["time"] and isinstance(rows.schema[cols["time"]].dataType, T.StringType):
        seen = parse_timestamp(F.col(cols["time"]), space_fraction=True)
    elif cols["time"] and isinstance(rows.schema[cols["time"]].dataType, (T.TimestampType, T.TimestampNTZType)):
        seen = F.col(cols["time"]).cast("timestamp")
    else:
        seen = F.lit(None).cast("timestamp")
    raw = F.map_from_arrays(
        F.array(*[F.lit(c) for c in rows.columns]), F.array(*[F.col(c).cast("string") for c in rows.columns]))
    out = [
        F.coalesce(seen, ingest_ts).alias("occurred_at"),
        F.upper(F.coalesce(text(cols["level"]), F.lit("UNKNOWN"))).alias("level"),
        F.coalesce(F.col("message").cast("string"), F.lit("")).alias("message"),
        F.lit(source["source_id"]).alias("source_id"),
        F.lit(source["tenant_id"]).alias("tenant_id"),
        F.lit(source["service_name"]).alias("service_name"),
        F.lit(source["environment"]).alias("environment"),
        text(cols["latency"]).try_cast("double").alias("latency_ms"),
        raw.alias("raw"),
    ]
    if isinstance(rows.schema["id"].dataType, T.IntegralType):
        out.append(F.col("id").cast("bigint").alias("seq"))
    return rows.select(*out)
