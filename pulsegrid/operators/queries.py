"""Alert queries, dashboards and audit reports. Tenant-facing ones take a tenant first."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.predicates import alert_filters, before_cursor, scoped
from pulsegrid.functions.text import cursor_column, decode_cursor, hour_label
from pulsegrid.operators.ordered import running
from pulsegrid.params import PAGE_DEFAULT


def newest(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("detected_at"), F.desc("id"))


def _positive(value: int, what: str) -> int:
    if value < 1:
        raise ValueError(f"{what} must be at least 1, not {value}")
    return value


def list_alerts(alerts: DataFrame, tenant_id: str, limit: int = PAGE_DEFAULT, **filters) -> DataFrame:
    """A tenant's alerts, newest first, at most `limit`."""
    rows = scoped(alerts, tenant_id)
    for condition in alert_filters(**filters):
        rows = rows.filter(condition)
    return newest(rows).limit(_positive(limit, "limit"))


def alert_page(
    alerts: DataFrame, tenant_id: str, limit: int = PAGE_DEFAULT, cursor: str | None = None, **filters
) -> DataFrame:
    """One page with `page_row`, `has_more` and `next_cursor`, the cursor of its last row.

    One row beyond the page is fetched to know whether more follow; a cursor that
    cannot be read gives the first page.
    """
    limit = _positive(limit, "limit")
    rows = scoped(alerts, tenant_id)
    for condition in alert_filters(**filters):
        rows = rows.filter(condition)
    start = decode_cursor(cursor) if cursor else None
    if start:
        rows = rows.filter(before_cursor(*start))
    fetched = newest(rows).limit(limit + 1)
    # At most limit + 1 rows from here on.
    whole = Window.partitionBy(F.lit(1))
    numbered = fetched.withColumn("page_row", F.row_number().over(
        whole.orderBy(F.desc("detected_at"), F.desc("id")))).withColumn("_n", F.count(F.lit(1)).over(whole))
    last = F.max(F.when(F.col("page_row") == limit, cursor_column(F.col("detected_at"), F.col("id")))).over(whole)
    return (
        numbered.withColumn("has_more", F.col("_n") > limit)
        .withColumn("next_cursor", F.when(F.col("_n") > limit, last))
        .filter(F.col("page_row") <= limit).drop("_n")
    )


def get_alert(alerts: DataFrame, tenant_id: str, alert_id: str) -> DataFrame:
    return scoped(alerts, tenant_id).filter(F.col("id") == alert_id)


def summary(alerts: DataFrame, sources: DataFrame, tenant_id: str) -> DataFrame:
    """Alert counts by status and open severity, and the active sources: one pass per table."""
    status, severity = F.col("status"), F.col("severity")
    active = scoped(sources, tenant_id).filter("active and deleted_at is null").agg(F.count(F.lit(1)))
    return scoped(alerts, tenant_id).agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if(status == "open").alias("open"),
        F.count_if(status == "resolved").alias("resolved"),
        F.count_if(status == "acknowledged").alias("acknowledged"),
        F.count_if((status == "open") & (severity == "CRITICAL")).alias("critical_open"),
        F.count_if((status == "open") & (severity == "WARNING")).alias("warning_open"),
    ).withColumn("active_sources", active.scalar())


def trend(alerts: DataFrame, tenant_id: str, now: datetime, hours: int = 24) -> DataFrame:
    """Alerts per hour label for the last `hours`, empty hours included.

    The range starts `hours` before now, so one more, earlier label can appear.
    """
    hours = _positive(hours, "hours")
    counted = (
        scoped(alerts, tenant_id).filter(F.col("detected_at") >= F.lit(now - timedelta(hours=hours)))
        .groupBy(hour_label(F.col("detected_at")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    )
    end = F.lit(now)
    spine = alerts.sparkSession.range(1).select(F.explode(F.sequence(
        end - F.expr(f"interval {hours - 1} hours"), end, F.expr("interval 1 hour")
    )).alias("at")).select(hour_label(F.col("at")).alias("label"))
    return (
        spine.join(counted, "label", "full")
        .select("label", F.coalesce("n", F.lit(0)).alias("alerts")).orderBy("label")
    )


def platform_totals(tenants: DataFrame, alerts: DataFrame, sources: DataFrame, users: DataFrame) -> DataFrame:
    """Totals over all tenants: one aggregate per table, stacked and turned into columns."""
    one = F.lit(1)
    counts = {
        "total_tenants": (tenants, one), "active_tenants": (tenants, F.when(F.col("active"), 1)),
        "total_alerts": (alerts, one), "open_alerts": (alerts, F.when(F.col("status") == "open", 1)),
        "active_sources": (sources, F.when(F.col("active") & F.col("deleted_at").isNull(), 1)),
        "active_users": (users, F.when(F.col("active"), 1)),
    }
    parts = {}
    for name, (df, what) in counts.items():
        parts.setdefault(id(df), (df, []))[1].append(F.count(what).alias(name))
    stacked = None
    for df, aggs in parts.values():
        part = df.agg(*aggs)
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(name).alias(name) for name in counts])


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first `n` rows of each key; Spark limits each map task before shuffling."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def latest_open_alert(alerts: DataFrame) -> DataFrame:
    """The newest open alert of each source and type."""
    return latest_per(
        alerts.filter(F.col("status") == "open"), ["tenant_id", "source_id", "anomaly_type"],
        [F.desc("detected_at"), F.desc("id")], 1,
    )


def audit_rows(log: DataFrame, tenant_id: str, since: datetime, until: datetime) -> DataFrame:
    at = F.col("timestamp")
    return scoped(log, tenant_id).filter((at >= F.lit(since)) & (at <= F.lit(until))).orderBy(F.desc("timestamp"))


def audit_stats(log: DataFrame, cell_ms: float = 100.0) -> DataFrame:
    """Requests, mean and exact 95th percentile latency (by nearest rank) per path and status."""
    keys = ["path", "status_code"]
    means = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"), F.avg("latency_ms").alias("mean_ms"))
    ranks = nearest_rank(log, keys, "latency_ms", {"p95_ms": 0.95}, cell_ms).select(*keys, "p95_ms")
    return means.join(ranks, keys)


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float], cell: float) -> DataFrame:
    """Per key: count, median and, for each fraction p, the sorted value number int(n * p).

    Exact at any size: values are counted, and the counts summed up in value order
    cell by cell (`cell` is the width of a value cell), so no key is sorted in one
    task. `df` is read twice.
    """
    keys = list(keys)
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    summed = running(counted, keys, F.floor(F.col(value) / F.lit(cell)), [value], {"_upto": ("sum", F.col("_c"))})
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    # The median is the mean of the two middle values, which may be the same one.
    ranks = {
        "_low": F.floor((F.col("n") - 1) / 2), "_high": F.floor(F.col("n") / 2),
        **{name: F.floor(F.col("n") * F.lit(p)) for name, p in fractions.items()},
    }
    holds = lambda rank: (rank >= F.col("_upto") - F.col("_c")) & (rank < F.col("_upto"))
    out = summed.join(total, keys) if keys else summed.withColumn("n", total.agg(F.max("n")).scalar())
    return out.groupBy(*keys, "n").agg(
        *[F.max(F.when(holds(rank), F.col(value))).alias(name) for name, rank in ranks.items()]
    ).select(*keys, "n", ((F.col("_low") + F.col("_high")) / 2).alias("median"), *fractions)
