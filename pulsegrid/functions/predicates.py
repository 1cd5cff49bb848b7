"""Row predicates shared by the queries: tenancy, liveness, roles, filters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scoped(df: DataFrame, tenant_id: str) -> DataFrame:
    """Every tenant-facing query starts here."""
    return df.filter(F.col("tenant_id") == tenant_id)


def live(df: DataFrame) -> DataFrame:
    """Rows that are not deleted or revoked, as far as the table can say."""
    for name in ("deleted_at", "revoked_at"):
        if name in df.columns:
            df = df.filter(F.col(name).isNull())
    return df


def alert_filters(
    service: str | None = None,
    severity: str | None = None,
    anomaly_type: str | None = None,
    status: str | None = None,
    since: datetime | None = None,
    until: datetime | None = None,
) -> list[Column]:
    """Equality filters and an inclusive time range; an empty value filters nothing."""
    equal = {"service_name": service, "severity": severity, "anomaly_type": anomaly_type, "status": status}
    out = [F.col(name) == value for name, value in equal.items() if value]
    if since:
        out.append(F.col("detected_at") >= F.lit(since))
    if until:
        out.append(F.col("detected_at") <= F.lit(until))
    return out


def before_cursor(detected_at: datetime, alert_id: str) -> Column:
    at = F.col("detected_at")
    return (at < F.lit(detected_at)) | ((at == F.lit(detected_at)) & (F.col("id") < alert_id))


def subscription_matches(filters: Column, severity: Column, service: Column) -> Column:
    """Severity and service must equal the subscription's, where it names them.

    Absent or malformed filters let everything pass; a JSON null matches nothing.
    """
    return parsed_filters_match(parsed_filters(filters), severity, service)


def parsed_filters(filters: Column) -> Column:
    return F.from_json(filters, "map<string,string>")


def parsed_filters_match(parsed: Column, severity: Column, service: Column) -> Column:
    """`subscription_matches` of filters parsed before, once per subscription."""

    def passes(key: str, value: Column) -> Column:
        return ~F.coalesce(F.map_contains_key(parsed, F.lit(key)), F.lit(False)) | F.coalesce(
            parsed[key] == value, F.lit(False)
        )

    return parsed.isNull() | (passes("severity", severity) & passes("service_name", service))


def credential_reason(found: Column, revoked_at: Column, expires_at: Column, grace_ends_at: Column, now: Column) -> Column:
    """Why a key is refused at `now`; null when it is accepted."""
    return (
        F.when(~found, "KEY_INVALID")
        .when(revoked_at.isNotNull(), "KEY_REVOKED")
        .when(expires_at < now, "KEY_EXPIRED")
        .when(grace_ends_at < now, "KEY_REVOKED")
    )


def has_scope(scopes: Column, scope: str) -> Column:
    return F.coalesce(F.array_contains(F.from_json(scopes, "array<string>"), scope), F.lit(False))


def visible_to(role: str, user_id: str | None) -> Column:
    """Operators see their own keys, admins all of the tenant's."""
    if role == "tenant_operator" and user_id:
        return F.col("user_id") == user_id
    return F.lit(True)
