"""The registered queries again, as SQL over the given tables.

Written from the definitions, not from the Spark plans: smoothing is a
recursive walk, last-in-first-out matching is "first later place where the running sum
falls below the alert's", and cooldowns are recursive.
"""

from __future__ import annotations

import re

from pulsegrid.plans.fixtures import EVENT_PARAMS as P

H = P.window_s * 1_000_000
A = P.alpha


def stamp(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


def _hex_id(*parts: str) -> str:
    text = " || '|' || ".join(f"coalesce(({p})::VARCHAR, '')" for p in parts)
    return f"regexp_replace(substr(sha256({text}), 1, 32), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\\1-\\2-\\3-\\4-\\5')"


ALERT_ID = _hex_id("tenant_id", "source_id", "anomaly_type", "severity", "epoch_us(detected_at)", "unit_id", "fp")
_PAIR = r'(\w+)=(?:"((?:[^"\\]|\\.)*)"|(\S*))'
_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def fp_sql(message: str) -> str:
    stripped = f"regexp_replace(lower({message}), '^{_SPACE}+|{_SPACE}+$', '', 'g')"
    return f"substr(sha256(regexp_replace({stripped}, '\\p{{Nd}}+', 'N', 'g')), 1, 16)"


def _walk(name: str, source: str, pos: str, x: str, means: dict[str, str], m: str, v: str) -> str:
    """The recurrence row by row: means of `x` and of `means`' values, the variance of `x`, and all before the row."""
    a, b = f"{A}::DOUBLE", f"{1 - A}::DOUBLE"
    every = {m: x} | means
    first = ", ".join(f"{a} * {c} + {b} * 0 AS {o}, 0::DOUBLE AS prev_{o}" for o, c in every.items())
    then = ", ".join(f"{a} * p.{c} + {b} * w.{o}, w.{o}" for o, c in every.items())
    return f"""SELECT tenant_id, source_id, {pos}, {first}, {a} * ({x} * {x}) + {b} * 0 AS {v}, 0::DOUBLE AS prev_{v}
      FROM {source} WHERE {pos} = 0
    UNION ALL SELECT p.tenant_id, p.source_id, p.{pos}, {then}, {a} * ((p.{x} - w.{m}) * (p.{x} - w.{m})) + {b} * w.{v}, w.{v}
      FROM {name} w JOIN {source} p ON p.tenant_id = w.tenant_id AND p.source_id = w.source_id AND p.{pos} = w.{pos} + 1"""


_K = "PARTITION BY tenant_id, source_id"

# name -> SQL; a CTE may use any other by name.
CTES: dict[str, str] = {}

CTES["entries"] = f"""SELECT ts AS occurred_at, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
    event_type || ' code ' || translate(json_extract_string(props, '$.k'), '0123456789', 'abcdefghij') || ' after '
    || event_id || 'ms' AS message, 'src-' || (user_id % 12) AS source_id, 't-' || (user_id % 2) AS tenant_id,
    'svc-' || (user_id % 12) AS service_name, 'production' AS environment, value AS latency_ms, event_id AS seq,
    (epoch_us(ts) // {H}) * {H} AS unit FROM events"""

CTES["obs"] = f"""SELECT tenant_id, source_id, unit, make_timestamp(unit + {H}) AS detected_at, count(*) AS n,
    count(*) FILTER (level = 'ERROR') AS n_err, count(*) FILTER (level = 'ERROR') / count(*) AS error_rate,
    count(latency_ms) AS n_lat, avg(latency_ms) AS lat_mean, min(occurred_at) AS min_ts, max(occurred_at) AS max_ts,
    arg_min(service_name, seq) AS service_name, arg_min(environment, seq) AS environment
    FROM entries GROUP BY tenant_id, source_id, unit"""

CTES["placed"] = f"SELECT *, row_number() OVER ({_K} ORDER BY unit) - 1 AS pos FROM obs"
CTES["walk"] = _walk("walk", "placed", "pos", "error_rate", {"vol": "n"}, "m", "v")
CTES["judged"] = f"""SELECT *, prev_m + {P.warn_k}::DOUBLE * sqrt(prev_v) AS bound,
    ready AND error_rate > prev_m + {P.warn_k}::DOUBLE * sqrt(prev_v) AS is_spike,
    error_rate > prev_m + {P.crit_k}::DOUBLE * sqrt(prev_v) AS is_critical, ready AND error_rate > m AS is_up
    FROM (SELECT p.*, m, prev_m, v, prev_v, vol, prev_vol, lag(max_ts) OVER ({_K} ORDER BY pos) AS prev_max_ts,
      pos + 1 AS warm, pos + 1 >= {P.warmup_required} AS ready FROM placed p JOIN walk USING (tenant_id, source_id, pos))"""
CTES["base"] = f"""SELECT *, ready AND NOT is_spike AND
    coalesce(lag(ready AND NOT is_spike) OVER ({_K} ORDER BY pos), false) AS pops FROM judged"""

CTES["lat_placed"] = f"SELECT *, row_number() OVER ({_K} ORDER BY pos) - 1 AS lat_pos FROM base WHERE n_lat > 0"
CTES["lat_walk"] = _walk("lat_walk", "lat_placed", "lat_pos", "lat_mean", {}, "lm", "lv")
CTES["lat_judged"] = f"""SELECT *, ready AND lat_pos + 1 >= {P.warmup_required} AS lat_ready,
    prev_lm + {P.warn_k}::DOUBLE * sqrt(prev_lv) AS lat_bound,
    ready AND lat_pos + 1 >= {P.warmup_required} AND lat_mean > prev_lm + {P.warn_k}::DOUBLE * sqrt(prev_lv) AS lat_spike,
    lat_mean > prev_lm + {P.crit_k}::DOUBLE * sqrt(prev_lv) AS lat_critical
    FROM lat_placed JOIN lat_walk USING (tenant_id, source_id, lat_pos)"""
CTES["lat_base"] = f"""SELECT *, lat_ready AND NOT lat_spike AND
    coalesce(lag(lat_ready AND NOT lat_spike) OVER ({_K} ORDER BY lat_pos), false) AS lat_pops FROM lat_judged"""

_EVID = "m AS ewma_value, v AS ewma_variance, ready AS warmup_complete, warm AS observations_count"


def _found(kind: str, severity: str, cur: str, basev: str, upper: str, unit: str, source: str, where: str,
           start: str = "min_ts", end: str = "max_ts", n: str = "n", evid: str = _EVID,
           service: str = "service_name", env: str = "environment", fp: str = "NULL::VARCHAR") -> str:
    return f"""SELECT tenant_id, source_id, unit AS unit_id, pos, detected_at, '{kind}' AS anomaly_type,
    {severity} AS severity, {service} AS service_name, {env} AS environment, ({cur})::DOUBLE AS current_value,
    ({basev})::DOUBLE AS baseline_value, ({upper})::DOUBLE AS upper_bound, '{unit}' AS unit, {start} AS window_start,
    {end} AS window_end, ({n})::BIGINT AS sample_count, {evid}, {fp} AS fp FROM {source} WHERE {where}"""


def _sev(flag: str) -> str:
    return f"CASE WHEN {flag} THEN 'CRITICAL' ELSE 'WARNING' END"


CTES["spikes"] = _found("ERROR_RATE_SPIKE", _sev("is_critical"), "error_rate", "m", "bound", "error_fraction", "base", "is_spike")
CTES["lat_spikes"] = _found("LATENCY_SPIKE", _sev("lat_critical"), "lat_mean", "lm", "lat_bound", "ms", "lat_base", "lat_spike")
_GAP = "(epoch_us(min_ts) - epoch_us(prev_max_ts)) / 1e6"
CTES["silences"] = _found(
    "SERVICE_SILENCE", "'CRITICAL'", _GAP, "prev_vol", str(P.silence_s), "seconds_silent", "base",
    f"{_GAP} >= {P.silence_s}", start="prev_max_ts", end="min_ts",
    evid=f"prev_m AS ewma_value, prev_v AS ewma_variance, warm - 1 >= {P.warmup_required} AS warmup_complete, "
         "warm - 1 AS observations_count")
CTES["runs"] = f"""SELECT *, epoch(detected_at) - min(epoch(detected_at)) OVER (PARTITION BY tenant_id, source_id, run) AS age
    FROM (SELECT *, sum(CASE WHEN is_up THEN 0 ELSE 1 END) OVER ({_K} ORDER BY pos) AS run FROM base)
    WHERE is_up"""
CTES["run_marks"] = f"""SELECT tenant_id, source_id, run,
    min(pos) FILTER (age >= {P.sustained_warn_s}) AS warn_pos, min(pos) FILTER (age >= {P.sustained_crit_s}) AS crit_pos
    FROM runs GROUP BY ALL"""
CTES["sustained"] = _found(
    "SUSTAINED_ELEVATION", _sev("pos = crit_pos"), "error_rate", "m", "m", "error_fraction",
    "(SELECT r.*, warn_pos, crit_pos FROM runs r JOIN run_marks USING (tenant_id, source_id, run))",
    "pos = crit_pos OR (pos = warn_pos AND warn_pos IS DISTINCT FROM crit_pos)",
    start="detected_at", end="detected_at", n="0", service="'unknown'", env="'production'")

CTES["patterns"] = f"""SELECT tenant_id, source_id, unit, fp, min(seq) AS first_seq FROM
    (SELECT *, {fp_sql('message')} AS fp FROM entries WHERE level = 'ERROR') GROUP BY ALL"""
CTES["seen"] = """SELECT p.*, b.detected_at FROM patterns p JOIN base b USING (tenant_id, source_id, unit) WHERE b.ready"""
CTES["kept_patterns"] = f"""SELECT tenant_id, source_id, fp, min(detected_at) AS detected_at FROM seen GROUP BY ALL
    UNION ALL SELECT k.tenant_id, k.source_id, k.fp, min(s.detected_at) FROM kept_patterns k
    JOIN seen s ON s.tenant_id = k.tenant_id AND s.source_id = k.source_id AND s.fp = k.fp
      AND s.detected_at >= k.detected_at + INTERVAL {P.novel_ttl_s} SECOND
    GROUP BY k.tenant_id, k.source_id, k.fp, k.detected_at"""
CTES["novel"] = _found(
    "NOVEL_ERROR", "'WARNING'", "1.0", "0.0", "0.0", "novel_pattern",
    """(SELECT b.* EXCLUDE (service_name, environment), e.service_name, e.environment, s.fp, e.message, e.occurred_at
        FROM kept_patterns k JOIN seen s USING (tenant_id, source_id, fp, detected_at)
        JOIN base b USING (tenant_id, source_id, unit) JOIN entries e ON e.seq = s.first_seq)""",
    "true", start="occurred_at", end="occurred_at", n="1", fp="fp")

CTES["ops"] = """SELECT tenant_id, source_id, 'ERROR_RATE_SPIKE' AS anomaly_type, pos, detected_at AS at,
      CASE WHEN is_spike THEN 1 ELSE -1 END AS op FROM base WHERE is_spike OR pops
    UNION ALL SELECT tenant_id, source_id, 'LATENCY_SPIKE', pos, detected_at, CASE WHEN lat_spike THEN 1 ELSE -1 END
      FROM lat_base WHERE lat_spike OR lat_pops
    UNION ALL SELECT tenant_id, source_id, anomaly_type, pos, detected_at, 1 FROM sustained
    UNION ALL SELECT tenant_id, source_id, 'SUSTAINED_ELEVATION', pos, detected_at, -1 FROM base WHERE ready AND NOT is_up"""
CTES["sums"] = "SELECT *, sum(op) OVER (PARTITION BY tenant_id, source_id, anomaly_type ORDER BY pos) AS s FROM ops"
CTES["resolved"] = """SELECT a.tenant_id, a.source_id, a.anomaly_type, a.pos, min(b.at) AS resolved_at FROM sums a JOIN sums b
    ON a.tenant_id = b.tenant_id AND a.source_id = b.source_id AND a.anomaly_type = b.anomaly_type
    AND b.pos > a.pos AND b.s < a.s WHERE a.op = 1 GROUP BY ALL"""
CTES["known_spikes"] = f"""SELECT s.*, resolved_at, {ALERT_ID} AS id FROM spikes s
    LEFT JOIN resolved USING (tenant_id, source_id, anomaly_type, pos)"""
_W = P.cascade_window_s
CTES["crowds"] = f"""SELECT s.tenant_id, s.source_id, s.pos, s.detected_at, p.service_name, p.detected_at AS since, p.source_id AS by_source, p.id
    FROM known_spikes s JOIN known_spikes p ON p.tenant_id = s.tenant_id
    AND (p.detected_at < s.detected_at OR (p.detected_at = s.detected_at AND p.source_id <= s.source_id))
    AND p.detected_at >= s.detected_at - INTERVAL {_W} SECOND
    AND (p.resolved_at IS NULL OR p.resolved_at > s.detected_at OR p.detected_at = s.detected_at)"""
CTES["counts"] = """SELECT tenant_id, source_id, pos, detected_at, count(DISTINCT service_name) AS services
    FROM crowds GROUP BY ALL"""
CTES["candidates"] = f"SELECT * FROM counts WHERE services >= {P.cascade_min_services}"
CTES["fired"] = f"""SELECT tenant_id, min(detected_at) AS detected_at FROM candidates GROUP BY ALL
    UNION ALL SELECT f.tenant_id, min(c.detected_at) FROM fired f JOIN candidates c ON c.tenant_id = f.tenant_id
    AND c.detected_at >= f.detected_at + INTERVAL {_W} SECOND GROUP BY f.tenant_id, f.detected_at"""
CTES["triggers"] = """SELECT c.tenant_id, c.detected_at, min(c.source_id) AS source_id FROM fired f
    JOIN candidates c USING (tenant_id, detected_at) GROUP BY ALL"""
CTES["trigger_facts"] = """SELECT b.*, c.services FROM triggers t JOIN base b USING (tenant_id, source_id, detected_at)
    JOIN candidates c USING (tenant_id, source_id, detected_at)"""
CTES["cascades"] = _found(
    "CASCADE", "'CRITICAL'", "services", str(P.cascade_min_services - 1), str(P.cascade_min_services),
    "services_spiking", "trigger_facts", "true", start="detected_at", end="detected_at", n="0",
    service="'unknown'", env="'production'")
CTES["members"] = """SELECT tenant_id, detected_at, service_name,
    arg_min(id, strftime(since, '%Y%m%d%H%M%S') || by_source) AS alert_id
    FROM crowds JOIN triggers USING (tenant_id, source_id, detected_at) GROUP BY ALL"""

CTES["detections"] = " UNION ALL BY NAME ".join(
    f"SELECT * FROM {t}" for t in ("silences", "spikes", "cascades", "sustained", "lat_spikes", "novel"))
CTES["ranked_messages"] = """SELECT tenant_id, source_id, unit, message,
    row_number() OVER (PARTITION BY tenant_id, source_id, unit ORDER BY seq, message) AS rank FROM
    (SELECT tenant_id, source_id, unit, message, min(seq) AS seq FROM entries WHERE level = 'ERROR' GROUP BY ALL)"""
CTES["unit_messages"] = """SELECT tenant_id, source_id, unit, list(message ORDER BY rank) AS messages
    FROM ranked_messages WHERE rank <= 3 GROUP BY ALL"""
CTES["alerts"] = f"""SELECT *, CASE WHEN resolved_at IS NULL THEN 'open' ELSE 'resolved' END AS status FROM
    (SELECT d.*, {ALERT_ID} AS id, detected_at AS created_at,
      CASE WHEN anomaly_type = 'SERVICE_SILENCE' THEN detected_at ELSE r.resolved_at END AS resolved_at
     FROM detections d LEFT JOIN resolved r USING (tenant_id, source_id, anomaly_type, pos))"""

# -- requests inside a run

CTES["run_acks"] = """SELECT tenant_id, source_id, anomaly_type, pos, id,
    detected_at + CASE WHEN id < '3' THEN INTERVAL 60 MINUTE ELSE INTERVAL 30 MINUTE END AS acked_at
    FROM alerts WHERE id < '6' AND anomaly_type <> 'CASCADE'"""
CTES["ack_ops"] = """SELECT o.*, acked_at, row_number() OVER (
      PARTITION BY o.tenant_id, o.source_id, o.anomaly_type ORDER BY o.pos) AS k
    FROM ops o LEFT JOIN run_acks r ON o.op = 1 AND r.tenant_id = o.tenant_id AND r.source_id = o.source_id
      AND r.anomaly_type = o.anomaly_type AND r.pos = o.pos"""
CTES["ack_walk"] = """SELECT DISTINCT tenant_id, source_id, anomaly_type, 0::BIGINT AS k,
      CAST([] AS STRUCT(pos BIGINT, acked_at TIMESTAMP)[]) AS stack, NULL::BIGINT AS found, NULL::TIMESTAMP AS popped_at FROM ops
    UNION ALL SELECT tenant_id, source_id, anomaly_type, k, CASE WHEN op = 1
        THEN list_append(live, struct_pack(pos := CAST(pos AS BIGINT), acked_at := CAST(acked_at AS TIMESTAMP))) ELSE live[1:len(live) - 1] END,
      CASE WHEN op = -1 THEN live[-1].pos END, op_at
    FROM (SELECT o.tenant_id, o.source_id, o.anomaly_type, o.k, o.op, o.pos, o.acked_at, CAST(o.at AS TIMESTAMP) AS op_at,
        list_filter(w.stack, lambda s: s.acked_at IS NULL OR s.acked_at > CAST(o.at AS TIMESTAMP)) AS live
      FROM ack_walk w JOIN ack_ops o ON o.tenant_id = w.tenant_id AND o.source_id = w.source_id
        AND o.anomaly_type = w.anomaly_type AND o.k = w.k + 1)"""
CTES["ack_resolved"] = """SELECT tenant_id, source_id, anomaly_type, found AS pos, popped_at AS resolved_at FROM ack_walk
    WHERE found IS NOT NULL"""
CTES["ack_known_spikes"] = f"""SELECT s.*, resolved_at, acked_at, {ALERT_ID} AS id
    FROM spikes s LEFT JOIN ack_resolved USING (tenant_id, source_id, anomaly_type, pos)
    LEFT JOIN (SELECT tenant_id, source_id, anomaly_type, pos, acked_at FROM run_acks) USING (tenant_id, source_id, anomaly_type, pos)"""
_ACK_CHAIN = ["known_spikes", "crowds", "counts", "candidates", "fired", "triggers", "trigger_facts", "cascades"]
for _name in _ACK_CHAIN[1:]:
    CTES[f"ack_{_name}"] = re.sub(rf"\b(FROM|JOIN) ({'|'.join(_ACK_CHAIN)})\b", r"\1 ack_\2", CTES[_name])
CTES["ack_crowds"] += " AND (p.acked_at IS NULL OR p.acked_at > s.detected_at)"
CTES["ack_alerts"] = f"""SELECT a.id, a.source_id, a.anomaly_type, severity, detected_at, resolved_at,
    CASE WHEN resolved_at IS NULL THEN acked_at END AS acknowledged_at,
    CASE WHEN resolved_at IS NOT NULL THEN 'resolved' WHEN acked_at IS NOT NULL THEN 'acknowledged' ELSE 'open' END AS status
    FROM (SELECT d.*, {ALERT_ID} AS id,
        CASE WHEN d.anomaly_type = 'SERVICE_SILENCE' THEN d.detected_at ELSE k.resolved_at END AS resolved_at
      FROM (SELECT * FROM detections WHERE anomaly_type <> 'CASCADE' UNION ALL BY NAME SELECT * FROM ack_cascades) d
      LEFT JOIN ack_resolved k USING (tenant_id, source_id, anomaly_type, pos)) a
    LEFT JOIN run_acks r ON r.id = a.id"""

# -- registry and logs

CTES["tenants"] = """SELECT 't-' || n_nationkey AS id, CASE WHEN n_nationkey % 9 = 8 THEN ' ' ELSE n_name END AS name,
    n_nationkey * 40 AS max_sources, n_nationkey % 20 + 2 AS retention_days, n_nationkey % 6 AS log_retention_days,
    n_regionkey <> 4 AS active, make_timestamp((1672531200 + n_nationkey::BIGINT * 86400) * 1000000) AS created_at FROM nation"""
_CREATED = "make_timestamp((1672531200 + c_custkey * 60) * 1000000)"
_DELETED = "CASE WHEN c_acctbal < -500 THEN make_timestamp(1700000000000000) END"
CTES["users"] = f"""SELECT 'u-' || c_custkey AS id, 't-' || c_nationkey AS tenant_id,
    lower(c_mktsegment) || '.' || (c_custkey - c_custkey % 3) || '@example.com' AS email,
    CASE WHEN c_custkey % 10 = 0 THEN 'tenant_admin' ELSE 'tenant_operator' END AS role, c_acctbal > 0 AS active,
    {_CREATED} AS created_at, {_DELETED} AS deleted_at FROM customer"""
CTES["sources"] = f"""SELECT 'src-' || c_custkey AS id, 't-' || (c_custkey % 2) AS tenant_id,
    'source ' || (c_custkey - c_custkey % 4) AS name, 'svc-' || c_custkey AS service_name, 'production' AS environment,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'file' WHEN 'FURNITURE' THEN 'postgres' WHEN 'HOUSEHOLD' THEN 'mysql'
      WHEN 'MACHINERY' THEN 'push' ELSE 'syslog' END AS source_type, '/var/log/' || c_custkey AS connection_config,
    (c_custkey % 8)::INTEGER AS poll_interval_s, NULL::VARCHAR AS latency_field,
    CASE WHEN c_custkey % 13 = 0 THEN 'xml' WHEN c_custkey % 2 = 0 THEN 'json' ELSE 'logfmt' END AS log_format,
    c_acctbal > 0 AS active, {_CREATED} AS created_at, {_DELETED} AS deleted_at FROM customer"""
CTES["source_state"] = """SELECT 'src-' || c_custkey AS id, c_custkey * 100 AS byte_offset, c_custkey + 7 AS file_inode,
    (c_custkey * 3)::VARCHAR AS last_seen_id FROM customer WHERE c_acctbal > 1000"""
CTES["keys"] = """SELECT 'key-' || s_suppkey AS id, 't-' || s_nationkey AS tenant_id, 'u-' || (s_suppkey % 40) AS user_id,
    s_name AS name, sha256('key-' || s_suppkey) AS key_hash,
    CASE WHEN s_suppkey % 23 = 0 THEN 'staging' ELSE 'live' END AS environment,
    CASE WHEN s_suppkey % 10 = 9 THEN '["alerts:read"]' WHEN s_suppkey % 17 = 0 THEN '[]'
      WHEN s_suppkey % 19 = 0 THEN '["ingest","root"]' ELSE '["ingest","webhooks:manage"]' END AS scopes,
    CASE WHEN s_acctbal > 0 THEN 'https://hooks.example.net/' || s_suppkey END AS webhook_url,
    CASE WHEN s_suppkey % 4 = 1 THEN '{"severity":"CRITICAL"}'
      WHEN s_suppkey % 4 = 2 THEN '{"service_name":"svc-3","severity":"WARNING"}'
      WHEN s_suppkey % 4 = 3 THEN 'not json' END AS webhook_filters,
    CASE WHEN s_suppkey % 7 = 3 THEN TIMESTAMP '2024-01-01' WHEN s_suppkey % 7 = 4 THEN TIMESTAMP '2030-01-01' END AS expires_at,
    CASE WHEN s_suppkey % 11 = 5 THEN make_timestamp(1704000000000000) END AS grace_period_ends_at,
    CASE WHEN s_suppkey % 13 = 6 THEN make_timestamp(1703000000000000) END AS revoked_at,
    make_timestamp((1672531200 + s_suppkey * 3600) * 1000000) AS created_at FROM supplier"""
CTES["request_log"] = """SELECT 'req-' || event_id AS id, 't-' || (user_id % 25) AS tenant_id, ts AS "timestamp",
    '/api/v1/' || event_type AS path,
    CASE WHEN event_type = 'error' THEN 500 WHEN user_id % 9 = 0 THEN 404 ELSE 200 END AS status_code,
    floor(value)::INTEGER AS latency_ms,
    CASE WHEN user_id % 3 = 0 THEN ' 10.0.0.' || (user_id % 250) || ' , 10.1.1.1' WHEN user_id % 3 = 1 THEN '' END AS forwarded,
    '192.168.0.' || (user_id % 250) AS peer FROM events"""
CTES["acks"] = """SELECT tenant_id, id AS alert_id, 'u-1' AS user_id, detected_at + INTERVAL 30 MINUTE AS acked_at FROM alerts
    UNION ALL SELECT 't-9', id, 'u-9', detected_at + INTERVAL 30 MINUTE FROM alerts WHERE anomaly_type = 'ERROR_RATE_SPIKE'"""
CTES["acked"] = """SELECT a.* EXCLUDE (status), acked_at,
    CASE WHEN status = 'open' AND k.alert_id IS NOT NULL THEN 'acknowledged' ELSE status END AS status
    FROM alerts a LEFT JOIN acks k ON k.alert_id = a.id AND k.tenant_id = a.tenant_id"""
CTES["subs"] = "SELECT * FROM keys WHERE webhook_url IS NOT NULL AND revoked_at IS NULL"
_DELIVERY = _hex_id("alert_id", "api_key_id", "attempt_number")
CTES["queue"] = f"""SELECT *, {_DELIVERY} AS delivery_id FROM (SELECT a.tenant_id, a.id AS alert_id, s.id AS api_key_id,
    1 AS attempt_number, webhook_url AS target_url FROM alerts a JOIN subs s ON s.tenant_id = a.tenant_id
    WHERE webhook_filters IS NULL OR NOT json_valid(webhook_filters) OR
      (coalesce(json_extract_string(webhook_filters, '$.severity'), severity) = severity AND
       coalesce(json_extract_string(webhook_filters, '$.service_name'), a.service_name) = a.service_name))"""


def _attempts(queue: str, now: str) -> str:
    return f"""SELECT q.*, status AS response_status, coalesce(status < 400, false) AS success,
      CASE WHEN digit < 'b' THEN repeat(digit, 600) ELSE 'timeout' END AS response_body,
      TIMESTAMP '{now}' AS created_at,
      CASE WHEN NOT coalesce(status < 400, false) AND attempt_number < 3
        THEN TIMESTAMP '{now}' + to_seconds(2 * (2 ** (attempt_number - 1))::INTEGER) END AS next_retry_at
    FROM (SELECT *, substr(delivery_id, 1, 1) AS digit, CASE WHEN substr(delivery_id, 1, 1) < '4' THEN 200
      WHEN substr(delivery_id, 1, 1) < '6' THEN 302 WHEN substr(delivery_id, 1, 1) < 'b' THEN 503 END AS status FROM {queue}) q"""


def _next(attempts: str) -> str:
    return f"""SELECT *, {_DELIVERY} AS delivery_id FROM (SELECT tenant_id, alert_id, api_key_id,
    attempt_number + 1 AS attempt_number, target_url FROM {attempts} a
    WHERE next_retry_at IS NOT NULL AND api_key_id IN (SELECT id FROM keys WHERE webhook_url IS NOT NULL))"""


CTES["first_attempts"] = _attempts("queue", "2024-01-31 00:00:00")
CTES["retries"] = _next("first_attempts")
CTES["second_attempts"] = _attempts("retries", "2024-01-31 00:00:30")
CTES["third_queue"] = _next("second_attempts")
CTES["third_attempts"] = _attempts("third_queue", "2024-01-31 00:01:00")
CTES["deliveries"] = """SELECT * FROM first_attempts UNION ALL SELECT * FROM second_attempts
    UNION ALL SELECT * FROM third_attempts"""
CTES["failing"] = """SELECT api_key_id FROM (SELECT *, row_number() OVER (PARTITION BY api_key_id
      ORDER BY created_at DESC, delivery_id DESC) AS rank FROM deliveries) WHERE rank <= 10
    GROUP BY api_key_id HAVING count(*) = 10 AND NOT bool_or(success)
    AND api_key_id IN (SELECT api_key_id FROM deliveries WHERE attempt_number = 3 AND NOT success)"""

# -- raw lines and pushes

_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')"
_K_ = "json_extract_string(props, '$.k')"
CTES["json_lines"] = f"""SELECT event_id AS seq, CASE event_type
    WHEN 'error' THEN '{{"level":"error","message":"failed after ' || event_id || 'ms","time":"' || {_ISO} || '","latency_ms":' || value || '}}'
    WHEN 'click' THEN '{{"level":"","lvl":"warning","msg":"slow ' || {_K_} || '","ts":"' || {_ISO} || '","latency_ms":"' || value || '"}}'
    WHEN 'signup' THEN '{{"severity":"info","text":"new user","timestamp":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '","n":' || {_K_} || '}}'
    WHEN 'purchase' THEN '{{"level":"ERROR", order ' || event_id || ' is fatal'
    WHEN 'view' THEN '[' || event_id || ']' END AS line FROM events"""
CTES["logfmt_lines"] = f"""SELECT event_id AS seq, CASE event_type
    WHEN 'error' THEN 'level=error msg="failed after ' || event_id || 'ms" latency=' || value || 'ms ts=' || {_ISO}
    WHEN 'click' THEN 'lvl=warn message=slow duration=' || value || 's time=' || {_ISO}
    WHEN 'signup' THEN 'user ' || event_id || ' WARNING no pairs here'
    WHEN 'purchase' THEN 'level=info level=debug msg="a \\"quoted\\" b" elapsed=' || {_K_}
    WHEN 'view' THEN 'severity="" text="" latency=abc latency_ms=' || {_K_} END AS line FROM events"""
CTES["plain_lines"] = f"""SELECT event_id AS seq, trim(CASE event_type
    WHEN 'error' THEN '  [Error] request ' || event_id || ' failed' || chr(9)
    WHEN 'click' THEN 'warn: slow click ' || {_K_}
    WHEN 'signup' THEN 'INFO new user; debug on ' || {_K_}
    WHEN 'purchase' THEN 'payment ' || event_id || ' FATAL error'
    WHEN 'view' THEN 'errors seen ' || {_K_} || ' infos' END, ' ' || chr(9)) AS line FROM events"""
_WORD = r"[^\p{L}\p{N}_]"


def plain_level(line: str) -> str:
    arms = (("CRITICAL|FATAL", "CRITICAL"), ("ERROR", "ERROR"), ("WARN(ING)?", "WARNING"), ("INFO", "INFO"), ("DEBUG", "DEBUG"))
    return "CASE " + " ".join(
        f"WHEN regexp_matches({line}, '(?i)(^|{_WORD})({w})($|{_WORD})') THEN '{lv}'" for w, lv in arms
    ) + " ELSE 'UNKNOWN' END"


CTES["pushes"] = """SELECT conv_id * 1000 + turn // 100 AS batch_id, any_value(sha256('key-' || (conv_id % 120))) AS key_hash,
    make_timestamp((1704067200 + (conv_id * 1000 + turn // 100) * 60) * 1000000) AS received_at,
    count(*) AS n_entries, bool_or(role NOT IN ('user', 'assistant') AND conv_id % 5 = 0) AS bad_level,
    bool_or(turn * 10 - CASE WHEN conv_id % 7 = 0 THEN 10 ELSE 0 END < 0) AS bad_latency,
    bool_or(text IS NULL OR text = '') AS bad_message,
    arg_min(CASE WHEN text IS NULL OR text = '' THEN 'MESSAGE_EMPTY'
      WHEN role NOT IN ('user', 'assistant') AND conv_id % 5 = 0 THEN 'LEVEL_UNKNOWN'
      WHEN turn * 10 - CASE WHEN conv_id % 7 = 0 THEN 10 ELSE 0 END < 0 THEN 'LATENCY_NEGATIVE' END, turn) AS problem
    FROM conversations GROUP BY conv_id, turn // 100"""
CTES["judged_pushes"] = """SELECT p.*, k.id AS api_key_id, k.tenant_id, coalesce(
      CASE WHEN k.id IS NULL THEN 'KEY_INVALID' WHEN revoked_at IS NOT NULL THEN 'KEY_REVOKED'
        WHEN expires_at < received_at THEN 'KEY_EXPIRED' WHEN grace_period_ends_at < received_at THEN 'KEY_REVOKED'
        WHEN NOT contains(scopes, '"ingest"') THEN 'INSUFFICIENT_SCOPE' END, problem) AS reason
    FROM pushes p LEFT JOIN keys k USING (key_hash)"""


_RECURSIVE = ("walk", "lat_walk", "kept_patterns", "fired", "kept_visits", "ack_walk", "ack_fired")


def with_ctes(select: str) -> str:
    """Prepend the CTEs a statement uses, each after those it needs itself."""
    order: list[str] = []
    seen: set[str] = set()

    def need(sql: str) -> None:
        for name in re.findall(r"(?:FROM|JOIN)\s+(\w+)", sql):
            if name in CTES and name not in seen:
                seen.add(name)
                need(CTES[name])
                order.append(name)

    need(select)
    body = ",\n".join(f"{n} AS {'' if n in _RECURSIVE else 'MATERIALIZED '}({CTES[n]})" for n in order)
    return f"WITH RECURSIVE {body}\n{select}" if order else select
