"""Pushed batches: validate, attribute to a key, turn into LOG_ENTRY rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.predicates import credential_reason, has_scope
from pulsegrid.params import VALID_LEVELS


def entry_problem(entry: Column) -> Column:
    """Why an entry is invalid, or null. A missing level means INFO; future times are fine."""
    level = F.upper(F.coalesce(entry["level"], F.lit("INFO")))
    return (
        F.when(F.coalesce(entry["message"], F.lit("")) == "", "MESSAGE_EMPTY")
        .when(~level.isin(*VALID_LEVELS), "LEVEL_UNKNOWN")
        .when(entry["latency_ms"] < 0, "LATENCY_NEGATIVE")
    )


def validate_batches(batches: DataFrame, max_entries: int | None = None) -> DataFrame:
    """Add `problem`: one bad entry, an empty batch, or one over `max_entries`, rejects the whole batch.

    A batch is one row, so this needs no shuffle.
    """
    count = F.size("entries")
    problems = F.filter(F.transform("entries", entry_problem), lambda p: p.isNotNull())
    return batches.withColumn(
        "problem",
        F.when(F.col("entries").isNull() | (count < 1), "BATCH_EMPTY")
        .when(F.lit(False) if max_entries is None else count > max_entries, "BATCH_TOO_LARGE")
        .when(F.size(problems) > 0, F.element_at(problems, 1)),
    )


def attribute(batches: DataFrame, keys: DataFrame) -> DataFrame:
    """Join each batch to its key and add tenant, key id and the refusal reason, if any.

    The key's state is judged at the batch's arrival.
    """
    known = keys.select(
        "key_hash", "tenant_id", F.col("id").alias("api_key_id"), "scopes", "revoked_at", "expires_at",
        "grace_period_ends_at",
    )
    rows = batches.join(known, "key_hash", "left")
    refused = credential_reason(
        F.col("api_key_id").isNotNull(), F.col("revoked_at"), F.col("expires_at"),
        F.col("grace_period_ends_at"), F.col("received_at"),
    )
    reason = F.coalesce(refused, F.when(~has_scope(F.col("scopes"), "ingest"), "INSUFFICIENT_SCOPE"))
    return rows.withColumn("refused", reason).drop("scopes", "revoked_at", "expires_at", "grace_period_ends_at")


def split_batches(batches: DataFrame, keys: DataFrame, max_entries: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantine); quarantine rows carry the `reason`. A refused key comes first."""
    judged = attribute(validate_batches(batches, max_entries), keys).withColumn("reason", F.coalesce("refused", "problem"))
    judged = judged.drop("refused", "problem")
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


def pushed_entries(accepted: DataFrame) -> DataFrame:
    """LOG_ENTRY rows of accepted batches; the source of a pushed entry is its key."""
    rows = accepted.select(
        "batch_id", "received_at", "tenant_id", "api_key_id", F.posexplode("entries").alias("seq", "e")
    )
    return rows.select(
        F.coalesce("e.occurred_at", "received_at").alias("occurred_at"),
        F.upper(F.coalesce("e.level", F.lit("INFO"))).alias("level"),
        F.col("e.message").alias("message"),
        F.coalesce("api_key_id", F.lit("push")).alias("source_id"),
        "tenant_id",
        F.coalesce(F.nullif(F.col("e.service_name"), F.lit("")), F.lit("unknown")).alias("service_name"),
        F.lit("production").alias("environment"),
        F.col("e.latency_ms").alias("latency_ms"),
        F.coalesce("e.metadata", F.create_map().cast("map<string,string>")).alias("raw"),
        "batch_id", "received_at", F.col("seq").cast("bigint").alias("seq"),
    )
