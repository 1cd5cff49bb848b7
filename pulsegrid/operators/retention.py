"""Retention and key expiry. Cut-offs are strict; inactive tenants are left alone."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOSED = ("resolved", "acknowledged")


def _marked(rows: DataFrame, tenants: DataFrame, at: str, days: str, now: Column, extra: Column) -> DataFrame:
    """Add `expired`: older than the tenant's number of days."""
    limits = tenants.filter("active").select(F.col("id").alias("tenant_id"), F.col(days).alias("_days"))
    cutoff = F.unix_micros(now) - F.col("_days") * F.lit(86_400_000_000)
    old = F.coalesce(F.unix_micros(at) < cutoff, F.lit(False))
    return rows.join(limits, "tenant_id", "left").withColumn("expired", old & extra).drop("_days")


def latest_cutoff(tenants: DataFrame, days: str, now: datetime) -> date | None:
    """The first date of which no row can be expired yet, by the shortest time that an active tenant keeps rows."""
    least = tenants.filter("active").agg(F.min(days)).collect()[0][0]
    return None if least is None else (now.astimezone(timezone.utc) - timedelta(days=least)).date() + timedelta(days=1)


def mark_alerts(alerts: DataFrame, tenants: DataFrame, now: Column) -> DataFrame:
    """Open alerts never expire."""
    return _marked(alerts, tenants, "created_at", "retention_days", now, F.col("status").isin(*CLOSED))


def mark_deliveries(deliveries: DataFrame, tenants: DataFrame, now: Column) -> DataFrame:
    return _marked(deliveries, tenants, "created_at", "retention_days", now, F.lit(True))


def mark_request_log(log: DataFrame, tenants: DataFrame, now: Column) -> DataFrame:
    return _marked(log, tenants, "timestamp", "log_retention_days", now, F.lit(True))


def kept(marked: DataFrame) -> DataFrame:
    return marked.filter("not expired").drop("expired")


def deleted_counts(alerts: DataFrame, deliveries: DataFrame, log: DataFrame) -> DataFrame:
    """Expired rows per tenant of the three marked tables."""
    tables = {"alerts_deleted": alerts, "deliveries_deleted": deliveries, "request_logs_deleted": log}
    stacked = None
    for name, df in tables.items():
        part = df.filter("expired").groupBy("tenant_id").agg(F.count(F.lit(1)).alias(name))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    return stacked.groupBy("tenant_id").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in tables])


def expire_keys(keys: DataFrame, now: Column) -> DataFrame:
    """Revoke live keys past their expiry or their grace period."""
    over = (F.col("expires_at") < now) | (F.col("grace_period_ends_at") < now)
    return keys.withColumn(
        "revoked_at", F.when(F.col("revoked_at").isNull() & over, now).otherwise(F.col("revoked_at")))
