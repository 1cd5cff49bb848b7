"""Table schemas. Keys are strings; times are timestamps in a UTC session."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _I, _L, _B, _TS = (
    T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType(),
)


def _table(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in cols])


LOG_ENTRY = _table(
    ("occurred_at", _TS), ("level", _S), ("message", _S), ("source_id", _S), ("tenant_id", _S),
    ("service_name", _S), ("environment", _S), ("latency_ms", _D), ("raw", T.MapType(_S, _S)),
)

EWMA_STATE = _table(
    ("tenant_id", _S), ("source_id", _S), ("ewma_value", _D), ("ewma_variance", _D), ("alpha", _D),
    ("sensitivity", _D), ("warmup_count", _I), ("warmup_required", _I),
    ("error_fingerprints", T.ArrayType(_table(("fp", _S), ("seen_at", _TS)))),
    ("log_volume_ewma", _D), ("last_log_at", _TS),
    ("latency_ewma", _D), ("latency_variance", _D), ("latency_warmup", _I),
)

ALERT = _table(
    ("id", _S), ("tenant_id", _S), ("source_id", _S), ("detected_at", _TS), ("anomaly_type", _S),
    ("severity", _S), ("service_name", _S), ("environment", _S), ("current_value", _D),
    ("baseline_value", _D), ("upper_bound", _D), ("unit", _S), ("window_start", _TS),
    ("window_end", _TS), ("sample_count", _L), ("representative_msgs", _S),
    ("detection_context", _S), ("cascade_context", _S), ("full_payload", _S), ("status", _S),
    ("acknowledged_by", _S), ("acknowledged_at", _TS), ("resolved_at", _TS),
    ("auto_resolved", _B), ("created_at", _TS),
)

# Tables of a stream: parts of windows, closings, silences, and how far the micro-batches came (microseconds).
WINDOW_PART = _table(
    ("tenant_id", _S), ("source_id", _S), ("unit", _L), ("fp", _S), ("message", _S), ("service_name", _S),
    ("environment", _S), ("n", _L), ("n_lat", _L), ("lat_sum", _D), ("min_ts", _TS), ("max_ts", _TS),
    ("arrived_at", _TS), ("first_ts", _TS), ("first_seq", _L), ("late", _B),
)

CLOSING = _table(("id", _S), ("resolved_at", _TS))

SILENCE = _table(("tenant_id", _S), ("source_id", _S), ("last_log_at", _TS), ("due_at", _TS))

ARRIVAL = _table(("arrived_at", _TS))

QUEUED = _table(
    ("tenant_id", _S), ("alert_id", _S), ("api_key_id", _S), ("attempt_number", _I), ("target_url", _S),
    ("delivery_id", _S), ("payload", _S), ("signature", _S),
)

PROGRESS = _table(("newest", _L), ("watermark", _L), ("judged", _L), ("kept", _L))

TENANT = _table(
    ("id", _S), ("name", _S), ("plan", _S), ("contact_email", _S), ("max_sources", _I),
    ("retention_days", _I), ("log_retention_days", _I), ("active", _B), ("created_at", _TS),
    ("deleted_at", _TS),
)

USER = _table(
    ("id", _S), ("tenant_id", _S), ("email", _S), ("role", _S), ("active", _B),
    ("last_login_at", _TS), ("created_by", _S), ("created_at", _TS), ("deleted_at", _TS),
)

LOG_SOURCE = _table(
    ("id", _S), ("tenant_id", _S), ("name", _S), ("service_name", _S), ("environment", _S),
    ("source_type", _S), ("connection_config", _S), ("poll_interval_s", _I), ("latency_field", _S),
    ("log_format", _S), ("active", _B), ("created_by", _S), ("created_at", _TS),
    ("updated_at", _TS), ("deleted_at", _TS),
)

SOURCE_STATE = _table(
    ("source_id", _S), ("tenant_id", _S), ("byte_offset", _L), ("file_inode", _L),
    ("last_seen_id", _S), ("updated_at", _TS),
)

API_KEY = _table(
    ("id", _S), ("tenant_id", _S), ("user_id", _S), ("name", _S), ("key_hash", _S),
    ("environment", _S), ("scopes", _S), ("webhook_url", _S), ("webhook_filters", _S),
    ("expires_at", _TS), ("grace_period_ends_at", _TS), ("revoked_at", _TS), ("created_at", _TS),
)

DELIVERY = _table(
    ("id", _S), ("tenant_id", _S), ("alert_id", _S), ("api_key_id", _S), ("attempt_number", _I),
    ("sent_at", _TS), ("target_url", _S), ("payload", _S), ("delivery_id", _S),
    ("response_status", _I), ("response_body", _S), ("latency_ms", _I), ("success", _B),
    ("next_retry_at", _TS), ("created_at", _TS),
)

REQUEST_LOG = _table(
    ("id", _S), ("tenant_id", _S), ("timestamp", _TS), ("method", _S), ("path", _S),
    ("status_code", _I), ("latency_ms", _I), ("api_key_id", _S), ("user_id", _S),
    ("ip_address", _S), ("request_id", _S), ("error_detail", _S),
)

SYSTEM_CONFIG = _table(("tenant_id", _S), ("key", _S), ("value", _S), ("updated_at", _TS))

PUSHED_BATCH = _table(
    ("batch_id", _L), ("key_hash", _S), ("received_at", _TS),
    ("entries", T.ArrayType(_table(
        ("message", _S), ("level", _S), ("occurred_at", _TS), ("service_name", _S),
        ("latency_ms", _D), ("metadata", T.MapType(_S, _S)),
    ))),
)
