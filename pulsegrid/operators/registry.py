"""Registry tables: tenants, users, keys, sources, and checks on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.predicates import live, scoped, visible_to

# Fixed values.
SOURCE_TYPES = ("file", "postgres", "mysql", "sqlite", "push")
LOG_FORMATS = ("json", "logfmt", "plaintext")
KEY_SCOPES = ("ingest", "alerts:read", "webhooks:manage", "sources:read")
KEY_ENVIRONMENTS = ("live", "test")

# Secrets and connection details never leave through a view.
SECRET_COLUMNS = ("connection_config", "key_hash", "webhook_secret", "password_hash")


def _public(df: DataFrame) -> DataFrame:
    return df.drop(*SECRET_COLUMNS).orderBy(F.desc("created_at"), F.desc("id"))


def active_sources(sources: DataFrame, state: DataFrame) -> DataFrame:
    """Active sources with their cursors, ready to be polled; new sources start at zero."""
    cursor = state.select(F.col("source_id").alias("id"), "file_inode", "byte_offset", "last_seen_id")
    rows = sources.filter("active").join(cursor, "id", "left")
    is_file = F.col("source_type") == "file"
    return rows.select(
        F.col("id").alias("source_id"), "tenant_id", "service_name", "environment", "source_type",
        "log_format", "poll_interval_s", "latency_field",
        F.when(~is_file, F.col("connection_config")).alias("connection_string"),
        F.when(is_file, F.col("connection_config")).alias("file_path"),
        "file_inode",
        F.coalesce("byte_offset", F.lit(0)).alias("byte_offset"),
        F.coalesce("last_seen_id", F.lit("0")).alias("last_seen_id"),
    )


def visible_sources(sources: DataFrame, tenant_id: str) -> DataFrame:
    return _public(live(scoped(sources, tenant_id)))


def visible_users(users: DataFrame, tenant_id: str) -> DataFrame:
    return _public(live(scoped(users, tenant_id)))


def visible_keys(keys: DataFrame, tenant_id: str, role: str, user_id: str | None = None) -> DataFrame:
    return _public(live(scoped(keys, tenant_id)).filter(visible_to(role, user_id)))


def all_tenants(tenants: DataFrame) -> DataFrame:
    """The platform administrator sees every tenant, inactive ones too."""
    return _public(tenants)


def effective_retention(tenants: DataFrame) -> DataFrame:
    return tenants.select(F.col("id").alias("tenant_id"), "retention_days", "log_retention_days")


def over_limit_tenants(sources: DataFrame, tenants: DataFrame) -> DataFrame:
    """Tenants with more live active sources than they may have."""
    used = live(sources).filter("active").groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_sources"))
    limits = tenants.select(F.col("id").alias("tenant_id"), "max_sources")
    return used.join(limits, "tenant_id").filter("n_sources > max_sources")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def duplicate_source_names(sources: DataFrame) -> DataFrame:
    return duplicates(live(sources), ["tenant_id", "name"])


def _violations(df: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in rules.items()]))
    return df.select(F.lit(table).alias("table"), "id", F.explode(broken).alias("rule"))


def _blank(name: str) -> Column:
    return F.trim(name) == ""


def constraint_report(tenants: DataFrame, sources: DataFrame, keys: DataFrame, users: DataFrame) -> DataFrame:
    """Every broken registry rule: values, uniqueness and limits. One row per row and rule."""
    scopes = F.from_json("scopes", "array<string>")
    valid = F.array(*[F.lit(s) for s in KEY_SCOPES])
    by_value = (
        _violations(tenants, "tenant", {
            "name_blank": _blank("name"),
            "max_sources_below_1": F.col("max_sources") < 1,
            "retention_days_below_1": F.col("retention_days") < 1,
            "log_retention_days_below_1": F.col("log_retention_days") < 1,
        })
        .unionByName(_violations(sources, "log_source", {
            "name_blank": _blank("name"),
            "service_name_blank": _blank("service_name"),
            "source_type_unknown": ~F.col("source_type").isin(*SOURCE_TYPES),
            "log_format_unknown": ~F.col("log_format").isin(*LOG_FORMATS),
            "poll_interval_below_1": F.col("poll_interval_s") < 1,
        }))
        .unionByName(_violations(keys, "api_key", {
            "name_blank": _blank("name"),
            "scopes_empty": F.size(scopes) < 1,
            "scope_unknown": F.size(F.array_except(scopes, valid)) > 0,
            "environment_unknown": ~F.col("environment").isin(*KEY_ENVIRONMENTS),
        }))
    )

    def repeated(df: DataFrame, table: str, columns: list[str], rule: str) -> DataFrame:
        return df.join(duplicates(df, columns).select(*columns), columns, "left_semi").select(
            F.lit(table).alias("table"), "id", F.lit(rule).alias("rule"))

    over = over_limit_tenants(sources, tenants).select(
        F.lit("tenant").alias("table"), F.col("tenant_id").alias("id"), F.lit("too_many_sources").alias("rule"))
    return (
        by_value.unionByName(repeated(live(sources), "log_source", ["tenant_id", "name"], "name_taken"))
        .unionByName(repeated(users, "user", ["email"], "email_taken"))
        .unionByName(over)
    )
