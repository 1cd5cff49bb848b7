"""Alert delivery as tables: queue, outcomes, retries, disabled subscriptions.

The POST itself is made elsewhere: it reads the queue and returns outcomes
(delivery_id, response_status, response_body, latency_ms); a time-out has no status.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.predicates import parsed_filters, parsed_filters_match, scoped
from pulsegrid.functions.text import signature, uuid_of
from pulsegrid.operators.queries import latest_per
from pulsegrid.params import BACKOFF_BASE_S, DISABLE_AFTER, MAX_ATTEMPTS
from pulsegrid.schemas import DELIVERY
from pulsegrid.session import materialize

SLICES = 64

# Maps a key id column to the HMAC pads of its secret, as two binary columns.
Signer = Callable[[Column], tuple[Column, Column]]


def subscriptions(keys: DataFrame) -> DataFrame:
    return keys.filter("webhook_url is not null and revoked_at is null")


def _signed(queue: DataFrame, signer: Signer | None) -> DataFrame:
    if signer is None:
        return queue.withColumn("signature", F.lit(""))
    return queue.withColumn("signature", signature(F.col("payload"), *signer(F.col("api_key_id"))))


def _delivery_id() -> Column:
    return uuid_of(F.col("alert_id"), F.col("api_key_id"), F.col("attempt_number"))


def delivery_queue(alerts: DataFrame, keys: DataFrame, signer: Signer | None = None) -> DataFrame:
    """First attempts: every alert to every matching live subscription of its tenant.

    A tenant's subscriptions fall into slices, and its alerts meet one slice a task, so that no tenant is one task's work.
    """
    subs = subscriptions(keys).select(
        "tenant_id", F.col("id").alias("api_key_id"), F.col("webhook_url").alias("target_url"),
        parsed_filters(F.col("webhook_filters")).alias("_filters"), F.pmod(F.hash("id"), F.lit(SLICES)).alias("_slice"))
    queue = (
        alerts.select("tenant_id", F.col("id").alias("alert_id"), "severity", "service_name",
                      F.col("full_payload").alias("payload"))
        .join(subs.select("tenant_id", "_slice").distinct(), "tenant_id")
        .join(subs, ["tenant_id", "_slice"])
        .filter(parsed_filters_match(F.col("_filters"), F.col("severity"), F.col("service_name")))
        .select("tenant_id", "alert_id", "api_key_id", F.lit(1).alias("attempt_number"), "target_url", "payload")
    )
    return _signed(queue.withColumn("delivery_id", _delivery_id()), signer)


def stored(rows: DataFrame, alerts: DataFrame, name: str) -> DataFrame:
    """A queue or attempts written once without the payload, which is the alert's; it is joined for who reads it.

    A payload is far longer than the rest of a row, and the same for all subscriptions and attempts of an alert.
    """
    written = materialize(rows.drop("payload"), name)
    payloads = alerts.groupBy("tenant_id", F.col("id").alias("alert_id")).agg(F.first("full_payload").alias("payload"))
    return written.join(payloads, ["tenant_id", "alert_id"], "left").select(*rows.columns)


def apply_outcomes(queue: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Attempt rows of the queue. Any status below 400 is a success.

    A failed attempt n below the last one is due again after 2 * 2^(n-1) seconds.
    A queued delivery without outcome is a failure without status.
    """
    rows = queue.join(outcomes, "delivery_id", "left")
    ok = F.coalesce(F.col("response_status") < 400, F.lit(False))
    delay = BACKOFF_BASE_S * F.pow(F.lit(2), F.col("attempt_number") - 1)
    again = ~ok & (F.col("attempt_number") < MAX_ATTEMPTS)
    return rows.select(*[
        {
            "id": F.col("delivery_id"),
            "sent_at": now, "created_at": now,
            "response_body": F.coalesce("response_body", F.lit("")),
            "success": ok,
            "next_retry_at": F.when(again, F.timestamp_seconds(F.unix_micros(now) / 1_000_000 + delay)),
        }.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name)
        for f in DELIVERY
    ])


def due(now: Column) -> Column:
    return ~F.col("success") & (F.col("next_retry_at") <= now)


def retry_queue(deliveries: DataFrame, keys: DataFrame, now: Column, signer: Signer | None = None) -> DataFrame:
    """Next attempts of failed deliveries that are due and whose key still has an address."""
    reachable = keys.filter("webhook_url is not null").select(F.col("id").alias("api_key_id"))
    queue = (
        deliveries.filter(due(now) & (F.col("attempt_number") < MAX_ATTEMPTS))
        .join(reachable, "api_key_id", "left_semi")
        .select("tenant_id", "alert_id", "api_key_id", (F.col("attempt_number") + 1).alias("attempt_number"),
                "target_url", "payload")
    )
    return _signed(queue.withColumn("delivery_id", _delivery_id()), signer)


def clear_due(deliveries: DataFrame, now: Column) -> DataFrame:
    """Due rows lose their schedule, whatever becomes of the retry."""
    return deliveries.withColumn("next_retry_at", F.when(~F.coalesce(due(now), F.lit(False)), F.col("next_retry_at")))


def last_deliveries(deliveries: DataFrame, n: int = DISABLE_AFTER) -> DataFrame:
    return latest_per(deliveries, ["api_key_id"], [F.desc("created_at"), F.desc("id")], n)


def failing_keys(deliveries: DataFrame) -> DataFrame:
    """Keys with an exhausted delivery whose last ten attempts all failed."""
    exhausted = deliveries.filter((F.col("attempt_number") >= MAX_ATTEMPTS) & ~F.col("success"))
    return (
        last_deliveries(deliveries).groupBy("api_key_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("success")).alias("n_ok"))
        .filter((F.col("n") >= DISABLE_AFTER) & (F.col("n_ok") == 0))
        .join(exhausted, "api_key_id", "left_semi").select("api_key_id")
    )


def disable_failing(keys: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Keys with the webhook address of failing ones removed."""
    failing = failing_keys(deliveries).withColumn("_failing", F.lit(True)).withColumnRenamed("api_key_id", "id")
    return (
        keys.join(failing, "id", "left")
        .withColumn("webhook_url", F.when(F.col("_failing").isNull(), F.col("webhook_url")))
        .select(*keys.columns)
    )


def delivery_history(deliveries: DataFrame, tenant_id: str, alert_id: str | None = None) -> DataFrame:
    """A tenant's attempts, newest first, without payload."""
    rows = scoped(deliveries, tenant_id)
    if alert_id:
        rows = rows.filter(F.col("alert_id") == alert_id)
    return rows.select(
        "id", "alert_id", "attempt_number", "sent_at", "target_url", "delivery_id", "response_status",
        "latency_ms", "success", "next_retry_at", "created_at",
    ).orderBy(F.desc("created_at"), F.desc("id"))
