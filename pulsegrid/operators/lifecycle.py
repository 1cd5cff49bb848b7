"""Alert rows: build, resolve, acknowledge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.text import iso_utc, uuid_of
from pulsegrid.operators.detectors import SILENCE
from pulsegrid.operators.observe import KEYS
from pulsegrid.schemas import ALERT

# Version, names and order of the alert document are a contract with its readers.
SCHEMA_VERSION = "1.0"
_JSON = {"ignoreNullFields": "false"}


def alert_id() -> Column:
    """Deterministic, so that a replay writes the same alert again."""
    return uuid_of(
        F.col("tenant_id"), F.col("source_id"), F.col("anomaly_type"), F.col("severity"),
        F.unix_micros("detected_at"), F.col("unit_id"), F.col("fp"),
    )


def _round6(name: str) -> Column:
    return F.round(name, 6)


def duration_seconds(resolved_at: Column, detected_at: Column) -> Column:
    return F.round((F.unix_micros(resolved_at) - F.unix_micros(detected_at)) / F.lit(1e6), 1)


def build_alerts(detections: DataFrame, window_seconds: int = 300) -> DataFrame:
    """DETECTION rows with `id`, `messages`, `contributing` and `resolved_at` to ALERT rows."""
    contributing = F.col("contributing")
    context = F.struct(
        F.lit("EWMA").alias("algorithm"),
        _round6("ewma_value").alias("ewma_value"),
        _round6("ewma_variance").alias("ewma_variance"),
        "alpha",
        F.col("sensitivity").alias("sensitivity_multiplier"),
        "warmup_complete",
        "observations_count",
    )
    cascade = F.when(contributing.isNotNull(), F.struct(
        contributing.alias("contributing_services"),
        F.lit(window_seconds).alias("window_seconds"),
        F.size(contributing).alias("service_count"),
    ))
    resolved = F.col("resolved_at").isNotNull()
    messages = F.coalesce("messages", F.array().cast("array<string>"))
    link = F.concat(F.lit("/api/v1/alerts/"), F.col("id"))
    payload = F.struct(
        F.col("id").alias("anomaly_id"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        iso_utc(F.col("detected_at")).alias("detected_at"),
        "anomaly_type",
        "severity",
        F.struct(
            F.col("service_name").alias("name"), "environment", "source_id",
        ).alias("service"),
        F.struct(
            _round6("current_value").alias("current_value"),
            _round6("baseline_value").alias("baseline_value"),
            _round6("upper_bound").alias("upper_bound"),
            "unit",
            iso_utc(F.col("window_start")).alias("window_start"),
            iso_utc(F.col("window_end")).alias("window_end"),
            "sample_count",
            messages.alias("representative_messages"),
        ).alias("evidence"),
        context.alias("detection_context"),
        cascade.alias("cascade_context"),
        F.struct(
            F.when(resolved, iso_utc(F.col("resolved_at"))).alias("resolved_at"),
            F.when(resolved, duration_seconds(F.col("resolved_at"), F.col("detected_at"))).alias("duration_seconds"),
            F.when(resolved, F.lit(True)).alias("auto_resolved"),
        ).alias("resolution"),
        F.struct(
            link.alias("self"), F.concat(link, F.lit("/acknowledge")).alias("acknowledge"),
        ).alias("links"),
    )
    made = {
        "representative_msgs": F.to_json(messages),
        "detection_context": F.to_json(context),
        "cascade_context": F.to_json(cascade),
        "full_payload": F.to_json(payload, _JSON),
        "status": F.when(resolved, "resolved").otherwise("open"),
        "acknowledged_by": F.lit(None), "acknowledged_at": F.lit(None),
        "auto_resolved": F.when(resolved, F.lit(True)),
        "created_at": F.col("detected_at"),
    }
    return detections.select(*[
        (made[f.name] if f.name in made else F.col(f.name)).cast(f.dataType).alias(f.name) for f in ALERT
    ])


def attach_resolution(detections: DataFrame, resolved: DataFrame) -> DataFrame:
    """Add `resolved_at`. A silence ends in the call that reports it."""
    keys = [*KEYS, "anomaly_type", "pos"]
    rows = detections.join(resolved.select(*keys, F.col("resolved_at").alias("_at")), keys, "left")
    return rows.withColumn(
        "resolved_at", F.when(F.col("anomaly_type") == SILENCE, F.col("detected_at")).otherwise(F.col("_at"))
    ).drop("_at")


def attach_evidence(detections: DataFrame, unit_messages: DataFrame) -> DataFrame:
    """Add representative messages; alerts judged without entries have none."""
    empty = F.array().cast("array<string>")
    shared = unit_messages.select(*KEYS, F.col("unit").alias("unit_id"), F.col("messages").alias("_shared"))
    return detections.join(shared, [*KEYS, "unit_id"], "left").withColumn(
        "messages",
        F.when(F.col("message").isNotNull(), F.array("message"))
        .when(F.col("sample_count") == 0, empty)
        .otherwise(F.coalesce("_shared", empty)),
    ).drop("_shared")


def apply_resolutions(alerts: DataFrame, resolved: DataFrame) -> DataFrame:
    """Close still-open alerts of an earlier run (`id`, `resolved_at`), payload included."""
    closing = alerts.join(resolved.select("id", F.col("resolved_at").alias("_at")), "id", "left")
    now = (F.col("status") == "open") & F.col("_at").isNotNull()
    resolution = F.to_json(F.struct(
        iso_utc(F.col("_at")).alias("resolved_at"),
        duration_seconds(F.col("_at"), F.col("detected_at")).alias("duration_seconds"),
        F.lit(True).alias("auto_resolved"),
    ))
    payload = F.regexp_replace(
        "full_payload", F.lit(r'"resolution":\{[^{}]*\}'), F.concat(F.lit('"resolution":'), resolution)
    )
    return closing.withColumns({
        "full_payload": F.when(now, payload).otherwise(F.col("full_payload")),
        "status": F.when(now, "resolved").otherwise(F.col("status")),
        "resolved_at": F.when(now, F.col("_at")).otherwise(F.col("resolved_at")),
        "auto_resolved": F.when(now, F.lit(True)).otherwise(F.col("auto_resolved")),
    }).select(*ALERT.names)


def cascade_closings(alerts: DataFrame) -> DataFrame:
    """Of the open cascades whose contributing alerts are all resolved: `id`, `resolved_at` of the last (not before the
    cascade itself). An acknowledged or unknown contributor keeps its cascade open."""
    held = "struct<contributing_services:array<struct<service_name:string,alert_id:string>>>"
    members = alerts.filter("anomaly_type = 'CASCADE' and status = 'open'").select(
        F.col("id").alias("cascade_id"), F.col("detected_at").alias("_since"),
        F.explode(F.from_json("cascade_context", held)["contributing_services"]["alert_id"]).alias("id"))
    known = alerts.select("id", F.when(F.col("status") == "resolved", F.col("resolved_at")).alias("_at"))
    found = members.join(known, "id", "left").groupBy(F.col("cascade_id").alias("id")).agg(
        F.count_if(F.col("_at").isNull()).alias("_open"), F.max("_at").alias("_last"), F.max("_since").alias("_since"))
    return found.filter("_open = 0").select("id", F.greatest("_last", "_since").alias("resolved_at"))


def _first_requests(acks: DataFrame) -> DataFrame:
    """The earliest request per tenant and alert; later ones find it acknowledged."""
    return acks.groupBy("tenant_id", F.col("alert_id").alias("id")).agg(
        F.min(F.struct("acked_at", "user_id")).alias("_ack")
    )


def apply_acks(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Open alerts become acknowledged; anything else keeps its state.

    `acks` holds tenant_id, alert_id, user_id, acked_at. A request acts only on an
    alert of its own tenant.
    """
    rows = alerts.join(_first_requests(acks), ["tenant_id", "id"], "left")
    now = (F.col("status") == "open") & F.col("_ack").isNotNull()
    return rows.withColumns({
        "acknowledged_by": F.when(now, F.col("_ack.user_id")).otherwise(F.col("acknowledged_by")),
        "acknowledged_at": F.when(now, F.col("_ack.acked_at")).otherwise(F.col("acknowledged_at")),
        "status": F.when(now, "acknowledged").otherwise(F.col("status")),
    }).select(*alerts.columns)


def ack_results(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """One answer per request: the acknowledgement, or why there is none."""
    known = alerts.select("tenant_id", F.col("id").alias("alert_id"), "status", "acknowledged_by", "acknowledged_at")
    first = _first_requests(acks).withColumnRenamed("id", "alert_id")
    rows = acks.join(known, ["tenant_id", "alert_id"], "left").join(first, ["tenant_id", "alert_id"])
    is_open, acked = F.col("status") == "open", F.col("status") == "acknowledged"
    return rows.select(
        "tenant_id", "alert_id", "user_id", "acked_at",
        F.when(F.col("status").isNull(), "ALERT_NOT_FOUND").when(F.col("status") == "resolved", "ALERT_RESOLVED")
        .alias("reason"),
        F.when(is_open | acked, "acknowledged").alias("new_status"),
        F.when(is_open, F.col("_ack.user_id")).when(acked, F.coalesce("acknowledged_by", F.lit("")))
        .alias("acknowledged_by"),
        F.when(is_open, F.col("_ack.acked_at")).when(acked, F.col("acknowledged_at")).alias("acknowledged_at"),
    )
