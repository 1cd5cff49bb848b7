"""Detector evaluation and isolation audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.queries import nearest_rank

_MEMBERS = "struct<contributing_services:array<struct<service_name:string,alert_id:string>>>"


def scorecard(trials: DataFrame) -> DataFrame:
    """Per detector from (detector, fired, expected): counts, precision, recall, false-positive rate.

    Precision is 1 when nothing fired; recall is 0 when nothing was to be found.
    """
    fired, expected = F.col("fired"), F.col("expected")
    counts = trials.groupBy("detector").agg(
        F.count_if(fired & expected).alias("tp"), F.count_if(fired & ~expected).alias("fp"),
        F.count_if(~fired & expected).alias("fn"), F.count_if(~fired & ~expected).alias("tn"),
    )
    share = lambda part, of, empty: F.when(of > 0, part / of).otherwise(F.lit(empty))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "detector", "tp", "fp", "fn", "tn",
        share(tp, tp + fp, 1.0).alias("precision"), share(tp, tp + fn, 0.0).alias("recall"),
        share(fp, fp + tn, 0.0).alias("false_positive_rate"),
    )


def detection_trials(observations: DataFrame, alerts: DataFrame, labels: DataFrame, detectors: list[str]) -> DataFrame:
    """Trials for `scorecard`: each labelled observation, and whether an alert fired there.

    `labels` holds tenant_id, source_id, detected_at, detector, expected.
    """
    keys = ["tenant_id", "source_id", "detected_at", "detector"]
    fired = alerts.select(*keys[:3], F.col("anomaly_type").alias("detector")).distinct().withColumn("_hit", F.lit(True))
    rows = labels.filter(F.col("detector").isin(*detectors)).join(
        observations.select(*keys[:3]), keys[:3], "left_semi")
    return rows.join(fired, keys, "left").select(
        "detector", F.col("_hit").isNotNull().alias("fired"), "expected")


def detection_lags(alerts: DataFrame) -> DataFrame:
    """Milliseconds from the last entry an alert looked at to its detection."""
    return alerts.select(
        "tenant_id", "anomaly_type",
        ((F.unix_micros("detected_at") - F.unix_micros("window_end")) / 1000).alias("lag_ms"),
    )


def lag_report(lags: DataFrame, keys: list[str], cell_ms: float = 1000.0) -> DataFrame:
    """Median, P95 and P99 of `lag_ms` per key, by nearest rank."""
    return nearest_rank(lags, keys, "lag_ms", {"p95": 0.95, "p99": 0.99}, cell_ms)


def isolation_breaches(alerts: DataFrame, sources: DataFrame) -> DataFrame:
    """Alerts of another tenant than their source's or of an unknown source, and cascades with a foreign or unknown
    member. Empty when all is well."""
    owner = sources.select(F.col("id").alias("source_id"), F.col("tenant_id").alias("owner"))
    breach = lambda held, kind: F.when(held.isNull(), f"unknown_{kind}").otherwise(f"{kind}_of_other_tenant").alias("breach")
    stray = alerts.join(owner, "source_id", "left").filter("owner is null or tenant_id <> owner").select(
        "id", "tenant_id", breach(F.col("owner"), "source"))
    members = alerts.filter("cascade_context is not null").select(
        F.col("id").alias("cascade_id"), F.col("tenant_id").alias("cascade_tenant"),
        F.explode(F.from_json("cascade_context", _MEMBERS)["contributing_services"]).alias("m"),
    ).select("cascade_id", "cascade_tenant", F.col("m.alert_id").alias("id"))
    held = alerts.select("id", "tenant_id")
    foreign = members.join(held, "id", "left").filter("tenant_id is null or tenant_id <> cascade_tenant").select(
        F.col("cascade_id").alias("id"), F.col("cascade_tenant").alias("tenant_id"), breach(F.col("tenant_id"), "member"))
    return stray.unionByName(foreign)
