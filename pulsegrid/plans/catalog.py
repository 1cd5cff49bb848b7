"""Every registered query: the Spark plan and the same question as SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import parsing, predicates, text
from pulsegrid.operators import (
    baseline, detectors, ingest, lifecycle, maintenance, observe, ordered, quality, queries, registry, retention, routing,
)
from pulsegrid.plans import fixtures as fx
from pulsegrid.plans import oracle as o
from pulsegrid.plans.batch import Detection
from pulsegrid.schemas import ALERT
from pulsegrid.session import materialize, prepare, scratch_dir
from pulsegrid.sources import jdbc
from pulsegrid.sources.versions import VersionedTable
from pulsegrid.streaming import engine

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)


# Added before rounding, so that an exact tie rounds alike in both engines.
NUDGE = 1e-9


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            nudged = re.sub(r"round\((\w+), (\d)\)", rf"round(\1 + {NUDGE}, \2)", sql)
            ORACLE[fn.__name__] = o.with_ctes(nudged)
        return fn

    return add


def stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


def rounded(name: str, places: int):
    return F.round(F.col(name) + NUDGE, places).alias(name)


def r6(name: str):
    return rounded(name, 6)


def detection(spark: SparkSession, sf_dir: str) -> Detection:
    return Detection(fx.log_entries(spark, sf_dir), fx.EVENT_PARAMS)


_STORED: dict[tuple[str, str], DataFrame] = {}


def stored_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alert table that the query operators read: detected from the events and written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        _STORED[key] = materialize(detection(spark, sf_dir).alerts, "alerts")
    return _STORED[key]


# -- parsing -----------------------------------------------------------------

_ENTRY = ["seq", "level", "message", "latency_ms"]
_LAT = "round(try_cast({0} AS DOUBLE), 6) AS latency_ms"


def _entries(lines: DataFrame) -> DataFrame:
    out = parsing.normalize_lines(lines)
    return out.select("seq", "level", "message", r6("latency_ms"), stamp("occurred_at"), "source_id", "tenant_id")


_ROUTE = "'src-' || (user_id % 12) AS source_id, 't-' || (user_id % 2) AS tenant_id"


@query(rf"""SELECT seq, upper(coalesce(nullif(level, ''), 'UNKNOWN')) AS level, message, latency_ms, {o.stamp('occurred_at')} AS occurred_at,
    {_ROUTE} FROM (
    SELECT seq, CASE WHEN json_valid(line) THEN coalesce(nullif(json_extract_string(line, '$.level'), ''),
        nullif(json_extract_string(line, '$.lvl'), ''), nullif(json_extract_string(line, '$.severity'), ''))
      ELSE {o.plain_level('line')} END AS level,
    CASE WHEN json_valid(line) THEN coalesce(nullif(json_extract_string(line, '$.message'), ''),
        nullif(json_extract_string(line, '$.msg'), ''), nullif(json_extract_string(line, '$.text'), ''), line) ELSE line END AS message,
    CASE WHEN json_valid(line) THEN {_LAT.format("json_extract_string(line, '$.latency_ms')").replace(' AS latency_ms', '')} END AS latency_ms,
    coalesce(CASE WHEN json_valid(line) THEN try_cast(replace(coalesce(json_extract_string(line, '$.time'),
        json_extract_string(line, '$.timestamp'), json_extract_string(line, '$.ts')), 'Z', '') AS TIMESTAMP) END,
        TIMESTAMP '2024-02-01') AS occurred_at
    FROM json_lines WHERE NOT json_valid(line) OR json_type(line) = 'OBJECT') JOIN events ON event_id = seq""")
def parse_json_lines(spark, sf_dir):
    return _entries(fx.event_lines(spark, sf_dir, "json"))


def _last(keys: tuple[str, ...]) -> str:
    """The last value of the first of `keys` that is present."""
    return "coalesce(" + ", ".join(
        f"list_filter(pairs, lambda p: p.k = '{k}')[-1].v" for k in keys) + ")"


def _number(key: str) -> str:
    return f"try_cast(rtrim(list_filter(pairs, lambda p: p.k = '{key}')[-1].v, 'ms') AS DOUBLE)"


@query(rf"""SELECT seq, upper(coalesce(nullif(CASE WHEN len(pairs) > 0 THEN {_last(parsing.LOGFMT_LEVEL)}
        ELSE {o.plain_level('line')} END, ''), 'UNKNOWN')) AS level,
    CASE WHEN len(pairs) > 0 THEN coalesce({_last(parsing.LOGFMT_MESSAGE)}, line) ELSE line END AS message,
    round(coalesce({', '.join(_number(k) for k in parsing.LOGFMT_LATENCY)}), 6) AS latency_ms,
    {o.stamp(f"coalesce(try_cast(replace({_last(parsing.LOGFMT_TIME)}, 'Z', '') AS TIMESTAMP), TIMESTAMP '2024-02-01')")} AS occurred_at,
    {_ROUTE}
    FROM (SELECT *, list_transform(generate_series(1, len(ks)), lambda i: {{'k': ks[i], 'v': coalesce(qs[i], '') || coalesce(us[i], '')}}) AS pairs
      FROM (SELECT *, regexp_extract_all(line, '{o._PAIR}', 1) AS ks, regexp_extract_all(line, '{o._PAIR}', 2) AS qs,
        regexp_extract_all(line, '{o._PAIR}', 3) AS us FROM logfmt_lines)) JOIN events ON event_id = seq""")
def parse_logfmt_lines(spark, sf_dir):
    return _entries(fx.event_lines(spark, sf_dir, "logfmt"))


@query(f"""SELECT seq, {o.plain_level('line')} AS level, line AS message, NULL::DOUBLE AS latency_ms,
    '2024-02-01 00:00:00.000000' AS occurred_at, {_ROUTE} FROM plain_lines JOIN events ON event_id = seq""")
def parse_plaintext_lines(spark, sf_dir):
    return _entries(fx.event_lines(spark, sf_dir, "plaintext"))


@query(rf"""SELECT doc_id, level, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM (SELECT doc_id, line, {o.plain_level('line')} AS level FROM (
    SELECT doc_id, regexp_replace(unnest(string_split_regex(text, '[\r\n\x0b\x0c\x1c-\x1e\x85\x{{2028}}\x{{2029}}]')),
      '^{o._SPACE}+|{o._SPACE}+$', '', 'g') AS line FROM documents) WHERE line <> '') GROUP BY ALL""")
def parse_document_lines(spark, sf_dir):
    """Whole documents as plain text logs: every line, every level keyword."""
    rows = parsing.normalize_lines(fx.document_lines(spark, sf_dir))
    return rows.groupBy(F.col("seq").alias("doc_id"), "level").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("message")).alias("n_chars"))


@query(f"""SELECT event_id AS id, upper(event_type) AS level, props AS message, round(value, 6) AS latency_ms,
    {o.stamp('ts')} AS occurred_at FROM events WHERE event_id > 9""")
def external_table_scan(spark, sf_dir):
    """Rows beyond the high-water mark 9, which a comparison as text would lose from 10 on."""
    rows = jdbc.rows_after(fx.external_rows(spark, sf_dir), "9")
    who = {"source_id": "src-0", "tenant_id": "t-0", "service_name": "svc-0", "environment": "production"}
    out = jdbc.table_entries(rows, F.current_timestamp(), who)
    return out.select(F.col("seq").alias("id"), "level", "message", r6("latency_ms"), stamp("occurred_at"))


@query("SELECT max(event_id)::VARCHAR AS last_seen_id FROM events")
def external_high_water_mark(spark, sf_dir):
    return jdbc.high_water_mark(fx.external_rows(spark, sf_dir))


@query(f"SELECT doc_id, {o.fp_sql('text')} AS fp FROM documents")
def message_fingerprints(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.fingerprint(F.col("text")).alias("fp"))


_SECRET = "whsec-example"
_IN, _OUT = text.signing_pads(_SECRET)


@query(f"""SELECT doc_id, 'sha256=' || sha256(from_hex('{_OUT.hex()}') || from_hex(sha256(from_hex('{_IN.hex()}') || encode(text)))) AS signature,
    true AS valid FROM documents""")
def payload_signatures(spark, sf_dir):
    pads = [F.unhex(F.lit(p.hex())) for p in (_IN, _OUT)]
    docs = fx.table(spark, sf_dir, "documents").withColumn("signature", text.signature(F.col("text"), *pads))
    return docs.select("doc_id", "signature", text.signature_valid(
        F.col("text"), *pads, F.col("signature")).alias("valid"))


@query("""SELECT id, CASE WHEN coalesce(forwarded, '') <> '' THEN trim(split_part(forwarded, ',', 1)) ELSE peer END AS ip
    FROM request_log""")
def client_addresses(spark, sf_dir):
    log = fx.request_log(spark, sf_dir)
    return log.select("id", text.client_ip(F.col("forwarded"), F.col("peer")).alias("ip"))


# -- pushes ------------------------------------------------------------------


@query("""SELECT batch_id, n_entries, api_key_id, tenant_id, reason FROM judged_pushes""")
def pushed_batch_verdicts(spark, sf_dir):
    accepted, quarantine = ingest.split_batches(fx.pushed_batches(spark, sf_dir), fx.api_keys(spark, sf_dir))
    both = accepted.unionByName(quarantine, allowMissingColumns=True)
    return both.select("batch_id", F.size("entries").cast("bigint").alias("n_entries"), "api_key_id", "tenant_id", "reason")


@query(f"""SELECT j.batch_id, turn % 100 AS seq, {o.stamp('received_at')} AS occurred_at,
    upper(CASE role WHEN 'user' THEN 'info' WHEN 'assistant' THEN 'error' ELSE 'INFO' END) AS level, text AS message,
    api_key_id AS source_id, tenant_id, CASE WHEN turn % 2 = 0 THEN 'svc-' || role ELSE 'unknown' END AS service_name,
    (turn * 10 - CASE WHEN conv_id % 7 = 0 THEN 10 ELSE 0 END)::DOUBLE AS latency_ms, turn::VARCHAR AS raw_turn
    FROM judged_pushes j JOIN conversations c ON c.conv_id * 1000 + c.turn // 100 = j.batch_id WHERE reason IS NULL""")
def pushed_entries(spark, sf_dir):
    accepted, _ = ingest.split_batches(fx.pushed_batches(spark, sf_dir), fx.api_keys(spark, sf_dir))
    return ingest.pushed_entries(accepted).select(
        "batch_id", "seq", stamp("occurred_at"), "level", "message", "source_id", "tenant_id", "service_name",
        "latency_ms", F.col("raw")["turn"].alias("raw_turn"))


# -- observations and baselines ----------------------------------------------

_UNIT = ["tenant_id", "source_id", "unit"]


@query(f"""SELECT tenant_id, source_id, unit, n, n_err, round(error_rate, 6) AS error_rate, n_lat, round(lat_mean, 6) AS lat_mean,
    {o.stamp('min_ts')} AS min_ts, {o.stamp('max_ts')} AS max_ts, {o.stamp('detected_at')} AS detected_at, service_name, environment FROM obs""")
def observations(spark, sf_dir):
    entries = fx.log_entries(spark, sf_dir)
    obs = observe.observations(observe.fine_observations(entries, fx.EVENT_PARAMS), fx.EVENT_PARAMS)
    return obs.select(*_UNIT, "n", "n_err", r6("error_rate"), "n_lat", r6("lat_mean"), stamp("min_ts"), stamp("max_ts"),
                      stamp("detected_at"), "service_name", "environment")


@query("SELECT tenant_id, source_id, unit, to_json(messages)::VARCHAR AS messages FROM unit_messages")
def representative_messages(spark, sf_dir):
    entries, p = fx.log_entries(spark, sf_dir), fx.EVENT_PARAMS
    found = observe.representative_messages(entries, observe.with_unit(entries, p), p)
    return found.select(*_UNIT, F.to_json("messages").alias("messages"))


@query("SELECT tenant_id, source_id, unit, fp, first_seq FROM patterns")
def error_patterns(spark, sf_dir):
    p = fx.EVENT_PARAMS
    return observe.error_patterns(observe.fine_observations(fx.log_entries(spark, sf_dir), p), p).select(*_UNIT, "fp", "first_seq")


@query("""SELECT tenant_id, source_id, unit, pos, round(m, 6) AS m, round(v, 6) AS v, round(vol, 6) AS vol, round(prev_m, 6) AS prev_m,
    round(prev_v, 6) AS prev_v, round(bound, 6) AS bound, warm, ready, is_spike, is_up, pops FROM base""")
def error_baseline(spark, sf_dir):
    d = detection(spark, sf_dir)
    rows = baseline.error_baseline(d.observations, d.params)
    return rows.select(*_UNIT, "pos", r6("m"), r6("v"), r6("vol"), r6("prev_m"), r6("prev_v"), r6("bound"), "warm", "ready",
                       "is_spike", "is_up", "pops")


@query("""SELECT tenant_id, source_id, unit, lat_pos, round(lm, 4) AS lm, round(lv, 3) AS lv, round(lat_bound, 4) AS bound,
    lat_ready AS ready, lat_spike AS is_spike, lat_pops AS pops FROM lat_base""")
def latency_baseline(spark, sf_dir):
    d = detection(spark, sf_dir)
    return baseline.latency_baseline(d.base, d.params).select(
        *_UNIT, "lat_pos", rounded("lm", 4), rounded("lv", 3), rounded("bound", 4), "ready", "is_spike", "pops")


@query(f"""SELECT tenant_id, source_id, round(m, 6) AS ewma_value, round(v, 6) AS ewma_variance, warm::INTEGER AS warmup_count,
    round(vol, 6) AS log_volume_ewma, {o.stamp('max_ts')} AS last_log_at FROM base
    QUALIFY row_number() OVER (PARTITION BY tenant_id, source_id ORDER BY pos DESC) = 1""")
def stored_state(spark, sf_dir):
    d = detection(spark, sf_dir)
    return baseline.next_state(d.base).select(
        "tenant_id", "source_id", r6("ewma_value"), r6("ewma_variance"), "warmup_count", r6("log_volume_ewma"), stamp("last_log_at"))


# -- detectors ---------------------------------------------------------------

_DET = ["tenant_id", "source_id", "unit_id", "anomaly_type", "severity", "service_name", "environment", "unit",
        "sample_count", "warmup_complete", "observations_count"]
_DET_SQL = f"""SELECT {', '.join(_DET)}, {o.stamp('detected_at')} AS detected_at, round(current_value, 4) AS current_value,
    round(baseline_value, 4) AS baseline_value, round(upper_bound, 4) AS upper_bound, {o.stamp('window_start')} AS window_start,
    {o.stamp('window_end')} AS window_end, round(ewma_value, 6) AS ewma_value, round(ewma_variance, 6) AS ewma_variance"""


def _found(df: DataFrame, *more: str) -> DataFrame:
    r4 = lambda c: rounded(c, 4)
    return df.select(*_DET, stamp("detected_at"), r4("current_value"), r4("baseline_value"), r4("upper_bound"),
                     stamp("window_start"), stamp("window_end"), r6("ewma_value"), r6("ewma_variance"), *more)


@query(f"{_DET_SQL} FROM spikes")
def error_rate_spikes(spark, sf_dir):
    d = detection(spark, sf_dir)
    return _found(detectors.error_rate_spikes(baseline.error_baseline(d.observations, d.params)))


@query(f"{_DET_SQL} FROM lat_spikes")
def latency_spikes(spark, sf_dir):
    d = detection(spark, sf_dir)
    return _found(detectors.latency_spikes(baseline.latency_baseline(d.base, d.params)))


@query(f"{_DET_SQL} FROM silences")
def service_silences(spark, sf_dir):
    d = detection(spark, sf_dir)
    return _found(detectors.service_silences(baseline.error_baseline(d.observations, d.params), d.params))


@query(f"{_DET_SQL} FROM sustained")
def sustained_elevations(spark, sf_dir):
    return _found(detection(spark, sf_dir).sustained)


@query(f"{_DET_SQL}, fp FROM novel")
def novel_errors(spark, sf_dir):
    return _found(detection(spark, sf_dir).novel_errors, "fp")


@query(f"{_DET_SQL} FROM cascades")
def cascades(spark, sf_dir):
    return _found(detection(spark, sf_dir).cascades)


@query(f"""SELECT tenant_id, {o.stamp('detected_at')} AS detected_at, service_name, alert_id FROM members""")
def cascade_members(spark, sf_dir):
    rows = detection(spark, sf_dir).cascades
    return rows.select("tenant_id", stamp("detected_at"), F.explode("contributing").alias("m")).select(
        "tenant_id", "detected_at", "m.service_name", "m.alert_id")


@query(f"SELECT tenant_id, source_id, {o.stamp('detected_at')} AS detected_at, services FROM counts")
def open_spiking_services(spark, sf_dir):
    d = detection(spark, sf_dir)
    return detectors.open_services(d.resolved_spikes, d.params).select(
        "tenant_id", "source_id", stamp("detected_at"), "services")


@query(f"SELECT tenant_id, source_id, anomaly_type, pos, {o.stamp('resolved_at')} AS resolved_at FROM resolved")
def automatic_resolutions(spark, sf_dir):
    return detection(spark, sf_dir).resolutions.select("tenant_id", "source_id", "anomaly_type", "pos", stamp("resolved_at"))


o.CTES["kept_visits"] = """SELECT user_id, min(ts) AS ts FROM events GROUP BY ALL UNION ALL
    SELECT k.user_id, min(e.ts) FROM kept_visits k JOIN events e ON e.user_id = k.user_id AND e.ts >= k.ts + INTERVAL 1 DAY
    GROUP BY k.user_id, k.ts"""


@query(f"SELECT user_id, {o.stamp('ts')} AS ts FROM kept_visits")
def event_cooldown(spark, sf_dir):
    """Per user, events at least a day after the last one kept."""
    events = fx.table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return ordered.cooldown(events, ["user_id"], "ts", 86_400).select("user_id", stamp("ts"))


# -- alerts ------------------------------------------------------------------


@query(f"""SELECT a.id, a.tenant_id, a.source_id, anomaly_type, severity, a.service_name, round(current_value, 4) AS current_value,
    round(baseline_value, 4) AS baseline_value, round(upper_bound, 4) AS upper_bound, a.unit, sample_count, status,
    {o.stamp('detected_at')} AS detected_at, {o.stamp('resolved_at')} AS resolved_at,
    CASE WHEN resolved_at IS NOT NULL THEN 'true' END AS auto_resolved,
    CASE WHEN a.fp IS NOT NULL THEN to_json([e.message])::VARCHAR WHEN sample_count = 0 THEN '[]'
      ELSE coalesce(to_json(u.messages)::VARCHAR, '[]') END AS representative_msgs,
    '1.0' AS schema_version, round((epoch_us(resolved_at) - epoch_us(detected_at)) / 1e6, 1) AS duration_seconds,
    warmup_complete, observations_count
    FROM alerts a LEFT JOIN unit_messages u ON u.tenant_id = a.tenant_id AND u.source_id = a.source_id AND u.unit = a.unit_id
    LEFT JOIN patterns p ON p.tenant_id = a.tenant_id AND p.source_id = a.source_id AND p.unit = a.unit_id AND p.fp = a.fp
    LEFT JOIN entries e ON e.seq = p.first_seq""")
def alert_rows(spark, sf_dir):
    """The flagship: entries to finished alerts, with some fields read back from the payload."""
    field = lambda path: F.get_json_object("full_payload", path)
    r4 = lambda c: rounded(c, 4)
    return detection(spark, sf_dir).alerts.select(
        "id", "tenant_id", "source_id", "anomaly_type", "severity", "service_name", r4("current_value"), r4("baseline_value"),
        r4("upper_bound"), "unit", "sample_count", "status", stamp("detected_at"), stamp("resolved_at"),
        F.col("auto_resolved").cast("string").alias("auto_resolved"),
        "representative_msgs", field("$.schema_version").alias("schema_version"),
        field("$.resolution.duration_seconds").cast("double").alias("duration_seconds"),
        field("$.detection_context.warmup_complete").cast("boolean").alias("warmup_complete"),
        field("$.detection_context.observations_count").cast("bigint").alias("observations_count"),
    )


_BRIEF = ["id", "source_id", "anomaly_type", "severity", "status"]
_BRIEF_SQL = f"{', '.join(_BRIEF)}, {o.stamp('detected_at')} AS detected_at"


def _brief(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*_BRIEF, stamp("detected_at"), *more)


@query(f"""SELECT id, source_id, severity, CASE WHEN closed_at IS NULL THEN 'open' ELSE 'resolved' END AS status,
    {o.stamp('detected_at')} AS detected_at, {o.stamp('closed_at')} AS resolved_at
    FROM (SELECT a.*, CASE WHEN all_closed THEN greatest(last_closed, a.detected_at) END AS closed_at FROM alerts a
      JOIN (SELECT tenant_id, m.detected_at, bool_and(k.resolved_at IS NOT NULL) AS all_closed, max(k.resolved_at) AS last_closed
        FROM members m JOIN known_spikes k USING (tenant_id) WHERE k.id = m.alert_id GROUP BY ALL) c
      ON c.tenant_id = a.tenant_id AND c.detected_at = a.detected_at WHERE anomaly_type = 'CASCADE')""")
def closed_cascades(spark, sf_dir):
    """Cascades end when all their contributing alerts have."""
    alerts = stored_alerts(spark, sf_dir)
    rows = lifecycle.apply_resolutions(alerts, lifecycle.cascade_closings(alerts)).filter(F.col("anomaly_type") == detectors.CASCADE)
    return rows.select("id", "source_id", "severity", "status", stamp("detected_at"), stamp("resolved_at"))


@query(f"""SELECT {_BRIEF_SQL} FROM (SELECT * FROM alerts WHERE tenant_id = 't-1' AND severity = 'CRITICAL'
    AND status = 'resolved' AND detected_at >= TIMESTAMP '2024-01-05' AND detected_at <= TIMESTAMP '2024-01-25'
    ORDER BY detected_at DESC, id DESC LIMIT 100)""")
def list_alerts(spark, sf_dir):
    return _brief(queries.list_alerts(
        stored_alerts(spark, sf_dir), "t-1", 100, severity="CRITICAL", status="resolved",
        since=datetime(2024, 1, 5, tzinfo=timezone.utc), until=datetime(2024, 1, 25, tzinfo=timezone.utc)))


_CURSOR_AT = datetime(2024, 1, 20, 12, tzinfo=timezone.utc)


@query(f"""SELECT {_BRIEF_SQL}, page_row, total > 20 AS has_more, CASE WHEN total > 20 THEN max(CASE WHEN page_row = 20 THEN
      translate(to_base64(encode('{{"detected_at":"' || strftime(detected_at, '%Y-%m-%dT%H:%M:%S') || '+00:00","id":"' || id || '"}}')), '+/', '-_') END) OVER () END AS next_cursor
    FROM (SELECT *, row_number() OVER (ORDER BY detected_at DESC, id DESC) AS page_row, count(*) OVER () AS total
      FROM alerts WHERE tenant_id = 't-0' AND (detected_at < TIMESTAMP '2024-01-20 12:00:00'
        OR (detected_at = TIMESTAMP '2024-01-20 12:00:00' AND id < '8'))) WHERE page_row <= 20""")
def alert_page(spark, sf_dir):
    page = queries.alert_page(stored_alerts(spark, sf_dir), "t-0", cursor=text.encode_cursor(_CURSOR_AT, "8"))
    return _brief(page, "page_row", "has_more", "next_cursor")


@query(f"SELECT {_BRIEF_SQL} FROM alerts WHERE tenant_id = 't-1' AND id = (SELECT min(id) FROM alerts WHERE tenant_id = 't-1')")
def single_alert(spark, sf_dir):
    alerts = stored_alerts(spark, sf_dir)
    wanted = predicates.scoped(alerts, "t-1").agg(F.min("id")).scalar()
    return _brief(predicates.scoped(alerts, "t-1").filter(F.col("id") == wanted))


@query(f"""SELECT {_BRIEF_SQL} FROM alerts WHERE status = 'open'
    QUALIFY row_number() OVER (PARTITION BY tenant_id, source_id, anomaly_type ORDER BY detected_at DESC, id DESC) = 1""")
def latest_open_alerts(spark, sf_dir):
    return _brief(queries.latest_open_alert(stored_alerts(spark, sf_dir)))


@query("""SELECT k.tenant_id, k.alert_id, k.user_id,
    CASE WHEN a.id IS NULL THEN 'ALERT_NOT_FOUND' WHEN status = 'resolved' THEN 'ALERT_RESOLVED' END AS reason,
    CASE WHEN status = 'open' THEN 'acknowledged' END AS new_status
    FROM acks k LEFT JOIN alerts a ON a.id = k.alert_id AND a.tenant_id = k.tenant_id""")
def acknowledge_requests(spark, sf_dir):
    alerts = stored_alerts(spark, sf_dir)
    return lifecycle.ack_results(alerts, fx.acks(alerts)).select("tenant_id", "alert_id", "user_id", "reason", "new_status")


@query(f"""SELECT id, status, CASE WHEN status = 'acknowledged' THEN 'u-1' END AS acknowledged_by,
    CASE WHEN status = 'acknowledged' THEN {o.stamp('acked_at')} END AS acknowledged_at FROM acked""")
def acknowledged_alerts(spark, sf_dir):
    alerts = stored_alerts(spark, sf_dir)
    return lifecycle.apply_acks(alerts, fx.acks(alerts)).select("id", "status", "acknowledged_by", stamp("acknowledged_at"))


@query("""SELECT count(*) AS total_alerts, count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'resolved') AS resolved,
    count(*) FILTER (status = 'acknowledged') AS acknowledged, count(*) FILTER (status = 'open' AND severity = 'CRITICAL') AS critical_open,
    count(*) FILTER (status = 'open' AND severity = 'WARNING') AS warning_open,
    (SELECT count(*) FROM sources WHERE tenant_id = 't-0' AND active AND deleted_at IS NULL) AS active_sources
    FROM alerts WHERE tenant_id = 't-0'""")
def dashboard_summary(spark, sf_dir):
    return queries.summary(stored_alerts(spark, sf_dir), fx.sources(spark, sf_dir), "t-0")


@query("""SELECT label, coalesce(n, 0) AS alerts FROM (SELECT strftime(unnest(generate_series(
      TIMESTAMP '2024-01-31' - INTERVAL 499 HOUR, TIMESTAMP '2024-01-31', INTERVAL 1 HOUR)), '%Y-%m-%dT%H:00') AS label)
    FULL JOIN (SELECT strftime(detected_at, '%Y-%m-%dT%H:00') AS label, count(*) AS n FROM alerts
      WHERE tenant_id = 't-0' AND detected_at >= TIMESTAMP '2024-01-31' - INTERVAL 500 HOUR GROUP BY 1) USING (label)""")
def dashboard_trend(spark, sf_dir):
    return queries.trend(stored_alerts(spark, sf_dir), "t-0", NOW, 500)


@query("""SELECT (SELECT count(*) FROM tenants) AS total_tenants, (SELECT count(*) FROM tenants WHERE active) AS active_tenants,
    (SELECT count(*) FROM alerts) AS total_alerts, (SELECT count(*) FROM alerts WHERE status = 'open') AS open_alerts,
    (SELECT count(*) FROM sources WHERE active AND deleted_at IS NULL) AS active_sources,
    (SELECT count(*) FROM users WHERE active) AS active_users""")
def platform_totals(spark, sf_dir):
    return queries.platform_totals(
        fx.tenants(spark, sf_dir), stored_alerts(spark, sf_dir), fx.sources(spark, sf_dir), fx.users(spark, sf_dir))


# -- audit log ---------------------------------------------------------------


@query("""SELECT path, status_code, count(*) AS requests, round(avg(latency_ms), 6) AS mean_ms,
    list_sort(list(latency_ms))[floor(count(*) * 0.95)::BIGINT + 1] AS p95_ms FROM request_log GROUP BY ALL""")
def audit_statistics(spark, sf_dir):
    return queries.audit_stats(fx.request_log(spark, sf_dir)).withColumn("mean_ms", F.round("mean_ms", 6))


@query(f"""SELECT id, path, status_code, latency_ms, {o.stamp('"timestamp"')} AS "timestamp" FROM request_log
    WHERE tenant_id = 't-3' AND "timestamp" BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20'""")
def audit_trail(spark, sf_dir):
    rows = queries.audit_rows(fx.request_log(spark, sf_dir), "t-3", datetime(2024, 1, 3, tzinfo=timezone.utc),
                              datetime(2024, 1, 20, tzinfo=timezone.utc))
    return rows.select("id", "path", "status_code", "latency_ms", stamp("timestamp"))


@query("""SELECT path, count(*) AS n, median(latency_ms)::DOUBLE AS median,
    list_sort(list(latency_ms))[floor(count(*) * 0.95)::BIGINT + 1] AS p95, list_sort(list(latency_ms))[floor(count(*) * 0.99)::BIGINT + 1] AS p99
    FROM request_log GROUP BY ALL""")
def request_latency_ranks(spark, sf_dir):
    """Exact nearest-rank percentiles per path."""
    return queries.nearest_rank(fx.request_log(spark, sf_dir), ["path"], "latency_ms", {"p95": 0.95, "p99": 0.99}, 50)


# -- registry ----------------------------------------------------------------


@query("""SELECT s.id AS source_id, tenant_id, service_name, source_type, log_format, poll_interval_s,
    CASE WHEN source_type <> 'file' THEN connection_config END AS connection_string,
    CASE WHEN source_type = 'file' THEN connection_config END AS file_path, coalesce(file_inode, 0) AS file_inode,
    coalesce(byte_offset, 0) AS byte_offset, coalesce(last_seen_id, '0') AS last_seen_id
    FROM sources s LEFT JOIN source_state USING (id) WHERE active""")
def active_source_cursors(spark, sf_dir):
    rows = registry.active_sources(fx.sources(spark, sf_dir), fx.source_state(spark, sf_dir))
    return rows.drop("environment", "latency_field").fillna(0, ["file_inode"])


@query(f"""SELECT id, tenant_id, name, service_name, environment, source_type, poll_interval_s, log_format, active,
    {o.stamp('created_at')} AS created_at FROM sources WHERE tenant_id = 't-1' AND deleted_at IS NULL""")
def visible_sources(spark, sf_dir):
    rows = registry.visible_sources(fx.sources(spark, sf_dir), "t-1")
    return rows.drop("deleted_at", "latency_field").withColumn("created_at", stamp("created_at"))


@query(f"""SELECT id, tenant_id, email, role, active, {o.stamp('created_at')} AS created_at FROM users
    WHERE tenant_id = 't-3' AND deleted_at IS NULL""")
def visible_users(spark, sf_dir):
    rows = registry.visible_users(fx.users(spark, sf_dir), "t-3")
    return rows.drop("deleted_at").withColumn("created_at", stamp("created_at"))


@query("""SELECT id, 'admin' AS seen_by FROM keys WHERE tenant_id = 't-3' AND revoked_at IS NULL UNION ALL
    SELECT id, 'operator' FROM keys WHERE tenant_id = 't-3' AND revoked_at IS NULL AND user_id = 'u-7'""")
def visible_keys(spark, sf_dir):
    keys = fx.api_keys(spark, sf_dir)
    admin = registry.visible_keys(keys, "t-3", "tenant_admin").select("id", F.lit("admin").alias("seen_by"))
    return admin.unionByName(registry.visible_keys(keys, "t-3", "tenant_operator", "u-7").select(
        "id", F.lit("operator").alias("seen_by")))


@query(f"SELECT id, name, max_sources::INTEGER AS max_sources, active, {o.stamp('created_at')} AS created_at FROM tenants")
def all_tenants(spark, sf_dir):
    return registry.all_tenants(fx.tenants(spark, sf_dir)).select("id", "name", "max_sources", "active", stamp("created_at"))


@query("SELECT id AS tenant_id, retention_days::INTEGER AS retention_days, log_retention_days::INTEGER AS log_retention_days FROM tenants")
def effective_retention(spark, sf_dir):
    return registry.effective_retention(fx.tenants(spark, sf_dir))


@query("""SELECT tenant_id, count(*) AS n_sources, any_value(max_sources)::INTEGER AS max_sources FROM sources s JOIN tenants t ON t.id = s.tenant_id
    WHERE s.active AND deleted_at IS NULL GROUP BY tenant_id HAVING count(*) > any_value(max_sources)""")
def tenants_over_limit(spark, sf_dir):
    return registry.over_limit_tenants(fx.sources(spark, sf_dir), fx.tenants(spark, sf_dir))


@query("SELECT tenant_id, name, count(*) AS rows FROM sources WHERE deleted_at IS NULL GROUP BY ALL HAVING count(*) > 1")
def duplicate_source_names(spark, sf_dir):
    return registry.duplicate_source_names(fx.sources(spark, sf_dir))


@query("""SELECT 'tenant' AS "table", id, unnest(list_filter([CASE WHEN trim(name) = '' THEN 'name_blank' END,
      CASE WHEN max_sources < 1 THEN 'max_sources_below_1' END, CASE WHEN retention_days < 1 THEN 'retention_days_below_1' END,
      CASE WHEN log_retention_days < 1 THEN 'log_retention_days_below_1' END], lambda x: x IS NOT NULL)) AS rule FROM tenants
    UNION ALL SELECT 'log_source', id, unnest(list_filter([
      CASE WHEN source_type NOT IN ('file', 'postgres', 'mysql', 'sqlite', 'push') THEN 'source_type_unknown' END,
      CASE WHEN log_format NOT IN ('json', 'logfmt', 'plaintext') THEN 'log_format_unknown' END,
      CASE WHEN poll_interval_s < 1 THEN 'poll_interval_below_1' END], lambda x: x IS NOT NULL)) FROM sources
    UNION ALL SELECT 'api_key', id, unnest(list_filter([CASE WHEN scopes = '[]' THEN 'scopes_empty' END,
      CASE WHEN contains(scopes, 'root') THEN 'scope_unknown' END,
      CASE WHEN environment NOT IN ('live', 'test') THEN 'environment_unknown' END], lambda x: x IS NOT NULL)) FROM keys
    UNION ALL SELECT 'log_source', id, 'name_taken' FROM sources WHERE deleted_at IS NULL
      QUALIFY count(*) OVER (PARTITION BY tenant_id, name) > 1
    UNION ALL SELECT 'user', id, 'email_taken' FROM users QUALIFY count(*) OVER (PARTITION BY email) > 1
    UNION ALL SELECT 'tenant', tenant_id, 'too_many_sources' FROM (SELECT tenant_id FROM sources s JOIN tenants t ON t.id = s.tenant_id
      WHERE s.active AND deleted_at IS NULL GROUP BY tenant_id HAVING count(*) > any_value(max_sources))""")
def registry_violations(spark, sf_dir):
    return registry.constraint_report(fx.tenants(spark, sf_dir), fx.sources(spark, sf_dir), fx.api_keys(spark, sf_dir),
                                      fx.users(spark, sf_dir))


@query("""SELECT id, CASE WHEN revoked_at IS NOT NULL THEN 'KEY_REVOKED' WHEN expires_at < TIMESTAMP '2024-01-31' THEN 'KEY_EXPIRED'
      WHEN grace_period_ends_at < TIMESTAMP '2024-01-31' THEN 'KEY_REVOKED' END AS reason, contains(scopes, '"webhooks:manage"') AS may_manage FROM keys""")
def credential_check(spark, sf_dir):
    c = F.col
    return fx.api_keys(spark, sf_dir).select(
        "id", predicates.credential_reason(F.lit(True), c("revoked_at"), c("expires_at"), c("grace_period_ends_at"), F.lit(NOW)).alias("reason"),
        predicates.has_scope(c("scopes"), "webhooks:manage").alias("may_manage"))


# -- delivery ----------------------------------------------------------------


def _status():
    return F.coalesce("response_status", F.lit(0)).alias("response_status")


def _now(seconds: int):
    return F.timestamp_seconds(F.lit(int(NOW.timestamp()) + seconds))


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of attempts, half a minute apart."""
    alerts, keys = stored_alerts(spark, sf_dir), fx.api_keys(spark, sf_dir)
    queue = routing.stored(routing.delivery_queue(alerts, keys), alerts, "queue")
    rounds = [routing.stored(routing.apply_outcomes(queue, fx.outcomes(queue), _now(0)), alerts, "attempts")]
    for i in (1, 2):
        queue = routing.retry_queue(rounds[-1], keys, _now(30 * i))
        rounds.append(routing.stored(routing.apply_outcomes(queue, fx.outcomes(queue), _now(30 * i)), alerts, "attempts"))
    return rounds[0].unionByName(rounds[1]).unionByName(rounds[2])


@query("SELECT tenant_id, alert_id, api_key_id, attempt_number, target_url, delivery_id FROM queue")
def delivery_queue(spark, sf_dir):
    return routing.delivery_queue(stored_alerts(spark, sf_dir), fx.api_keys(spark, sf_dir)).drop("payload", "signature")


_TRY = "tenant_id, alert_id, api_key_id, attempt_number, delivery_id, success"
_STATUS = "coalesce(response_status, 0)::INTEGER AS response_status"


@query(f"SELECT {_TRY}, {_STATUS}, response_body, {o.stamp('next_retry_at')} AS next_retry_at FROM first_attempts")
def delivery_outcomes(spark, sf_dir):
    alerts = stored_alerts(spark, sf_dir)
    queue = routing.stored(routing.delivery_queue(alerts, fx.api_keys(spark, sf_dir)), alerts, "queue")
    rows = routing.apply_outcomes(queue, fx.outcomes(queue), _now(0))
    return rows.select(*_TRY.split(", "), _status(), "response_body", stamp("next_retry_at"))


@query(f"SELECT {_TRY}, {_STATUS}, {o.stamp('next_retry_at')} AS next_retry_at FROM deliveries")
def delivery_retries(spark, sf_dir):
    return _deliveries(spark, sf_dir).select(*_TRY.split(", "), _status(), stamp("next_retry_at"))


@query("SELECT id, CASE WHEN id NOT IN (SELECT api_key_id FROM failing) THEN webhook_url END AS webhook_url FROM keys")
def disabled_subscriptions(spark, sf_dir):
    return routing.disable_failing(fx.api_keys(spark, sf_dir), _deliveries(spark, sf_dir)).select("id", "webhook_url")


@query(f"""SELECT alert_id, attempt_number, delivery_id, {_STATUS}, success, {o.stamp('created_at')} AS created_at
    FROM deliveries WHERE tenant_id = 't-1'""")
def delivery_history(spark, sf_dir):
    return routing.delivery_history(_deliveries(spark, sf_dir), "t-1").select(
        "alert_id", "attempt_number", "delivery_id", _status(), "success", stamp("created_at"))


# -- retention ---------------------------------------------------------------

_OLD = "{at} < TIMESTAMP '2024-01-31' - to_days(t.{days}::INTEGER)"


@query(f"""SELECT a.id, a.status FROM acked a LEFT JOIN tenants t ON t.id = a.tenant_id AND t.active
    WHERE NOT coalesce(a.status IN ('resolved', 'acknowledged') AND {_OLD.format(at='a.created_at', days='retention_days')}, false)""")
def retained_alerts(spark, sf_dir):
    alerts = stored_alerts(spark, sf_dir)
    acked = lifecycle.apply_acks(alerts, fx.acks(alerts))
    return retention.kept(retention.mark_alerts(acked, fx.tenants(spark, sf_dir), F.lit(NOW))).select("id", "status")


@query(f"""SELECT a.id, a.status FROM acked a LEFT JOIN tenants t ON t.id = a.tenant_id AND t.active
    WHERE NOT coalesce(a.status IN ('resolved', 'acknowledged') AND {_OLD.format(at='a.created_at', days='retention_days')}, false)""")
def expired_versions(spark, sf_dir):
    """The alerts as a table of versions: stored twice, expired in place, read back."""
    alerts = stored_alerts(spark, sf_dir)
    rows, tenants = lifecycle.apply_acks(alerts, fx.acks(alerts)), fx.tenants(spark, sf_dir)
    stored = VersionedTable(spark, f"{scratch_dir(spark)}/pulsegrid/versions-{uuid.uuid4().hex}", ALERT, "detected_at")
    stored.append_new(rows)
    stored.append_new(rows)
    stored.expire(lambda old: retention.mark_alerts(old, tenants, F.lit(NOW)),
                  retention.latest_cutoff(tenants, "retention_days", NOW))
    return stored.read().select("id", "status")


@query(f"""SELECT r.id FROM request_log r LEFT JOIN tenants t ON t.id = r.tenant_id AND t.active
    WHERE NOT coalesce({_OLD.format(at='r."timestamp"', days='log_retention_days')}, false)""")
def retained_request_log(spark, sf_dir):
    marked = retention.mark_request_log(fx.request_log(spark, sf_dir), fx.tenants(spark, sf_dir), F.lit(NOW))
    return retention.kept(marked).select("id")


@query(f"""SELECT tenant_id, sum(a)::BIGINT AS alerts_deleted, sum(d)::BIGINT AS deliveries_deleted, sum(l)::BIGINT AS request_logs_deleted FROM (
    SELECT tenant_id, 1 AS a, 0 AS d, 0 AS l FROM alerts x JOIN tenants t ON t.id = tenant_id AND t.active
      WHERE status IN ('resolved', 'acknowledged') AND {_OLD.format(at='x.created_at', days='retention_days')}
    UNION ALL SELECT tenant_id, 0, 1, 0 FROM deliveries x JOIN tenants t ON t.id = tenant_id AND t.active
      WHERE {_OLD.format(at='x.created_at', days='retention_days')}
    UNION ALL SELECT tenant_id, 0, 0, 1 FROM request_log x JOIN tenants t ON t.id = tenant_id AND t.active
      WHERE {_OLD.format(at='x."timestamp"', days='log_retention_days')}) GROUP BY tenant_id""")
def deleted_counts(spark, sf_dir):
    tenants, now = fx.tenants(spark, sf_dir), F.lit(NOW)
    return retention.deleted_counts(
        retention.mark_alerts(stored_alerts(spark, sf_dir), tenants, now),
        retention.mark_deliveries(_deliveries(spark, sf_dir), tenants, now),
        retention.mark_request_log(fx.request_log(spark, sf_dir), tenants, now))


@query(f"""SELECT id, {o.stamp('''CASE WHEN revoked_at IS NULL AND (expires_at < TIMESTAMP '2024-01-31'
      OR grace_period_ends_at < TIMESTAMP '2024-01-31') THEN TIMESTAMP '2024-01-31' ELSE revoked_at END''')} AS revoked_at FROM keys""")
def expired_keys(spark, sf_dir):
    return retention.expire_keys(fx.api_keys(spark, sf_dir), F.lit(NOW)).select("id", stamp("revoked_at"))


# -- evaluation --------------------------------------------------------------

# What each detector should find, by a simple rule on raw numbers; the gap is in whole windows.
_EXPECTED = {
    "ERROR_RATE_SPIKE": "n >= 2 AND error_rate >= 0.5",
    "LATENCY_SPIKE": "lat_mean >= 150",
    "SERVICE_SILENCE": f"gap >= {fx.EVENT_PARAMS.silence_s + 2 * fx.EVENT_PARAMS.window_s}",
}
_FOUND_BY = {"ERROR_RATE_SPIKE": "spikes", "LATENCY_SPIKE": "lat_spikes", "SERVICE_SILENCE": "silences"}
_TRIALS = " UNION ALL ".join(f"""SELECT '{name}' AS detector, coalesce({rule}, false) AS expected, EXISTS (
      SELECT 1 FROM {_FOUND_BY[name]} f WHERE f.tenant_id = b.tenant_id AND f.source_id = b.source_id AND f.pos = b.pos) AS fired
    FROM (SELECT *, epoch(detected_at) - epoch(lag(detected_at) OVER (PARTITION BY tenant_id, source_id ORDER BY pos)) AS gap FROM base) b"""
    for name, rule in _EXPECTED.items())


@query(f"""SELECT detector, count(*) FILTER (fired AND expected) AS tp, count(*) FILTER (fired AND NOT expected) AS fp,
    count(*) FILTER (NOT fired AND expected) AS fn, count(*) FILTER (NOT fired AND NOT expected) AS tn,
    round(coalesce(count(*) FILTER (fired AND expected) / nullif(count(*) FILTER (fired), 0), 1.0), 6) AS precision,
    round(coalesce(count(*) FILTER (fired AND expected) / nullif(count(*) FILTER (expected), 0), 0.0), 6) AS recall,
    round(coalesce(count(*) FILTER (fired AND NOT expected) / nullif(count(*) FILTER (NOT expected), 0), 0.0), 6) AS false_positive_rate
    FROM ({_TRIALS}) GROUP BY detector""")
def detector_scorecard(spark, sf_dir):
    """Three detectors against simple rules on the raw observations."""
    d = detection(spark, sf_dir)
    gap = (F.unix_seconds("detected_at") - F.unix_seconds("prev_detected_at")).alias("gap")
    rows = d.base.select("tenant_id", "source_id", "detected_at", "n", "error_rate", "lat_mean", gap)
    labels = rows.select("tenant_id", "source_id", "detected_at", F.inline(F.array(*[
        F.struct(F.lit(name).alias("detector"), F.coalesce(F.expr(rule), F.lit(False)).alias("expected")) for name, rule in _EXPECTED.items()])))
    found = d.spikes.unionByName(d.latency_spikes).unionByName(d.silences)
    card = quality.scorecard(quality.detection_trials(d.base, found, labels, list(_EXPECTED)))
    return card.select("detector", "tp", "fp", "fn", "tn", r6("precision"), r6("recall"), r6("false_positive_rate"))


_LAG = "(epoch_us(detected_at) - epoch_us(window_end)) / 1000"


@query(f"""SELECT anomaly_type, count(*) AS n, round(median({_LAG}), 3) AS median,
    round(list_sort(list({_LAG}))[floor(count(*) * 0.95)::BIGINT + 1], 3) AS p95,
    round(list_sort(list({_LAG}))[floor(count(*) * 0.99)::BIGINT + 1], 3) AS p99 FROM detections GROUP BY ALL""")
def detection_lag_report(spark, sf_dir):
    lags = materialize(quality.detection_lags(detection(spark, sf_dir).detections), "lags")
    out = quality.lag_report(lags, ["anomaly_type"], 60_000.0)
    return out.select("anomaly_type", "n", *[F.round(c, 3).alias(c) for c in ("median", "p95", "p99")])


@query("""SELECT a.id, a.tenant_id, CASE WHEN s.id IS NULL THEN 'unknown_source' ELSE 'source_of_other_tenant' END AS breach
    FROM alerts a LEFT JOIN sources s ON s.id = CASE left(a.id, 1) WHEN '0' THEN 'src-gone' WHEN '1' THEN 'src-1' ELSE a.source_id END
    WHERE s.id IS NULL OR s.tenant_id <> a.tenant_id""")
def isolation_breaches(spark, sf_dir):
    """Some alerts are given an unknown source, or one that may be another tenant's."""
    first = F.substring("id", 1, 1)
    moved = F.when(first == "0", "src-gone").when(first == "1", "src-1").otherwise(F.col("source_id"))
    alerts = stored_alerts(spark, sf_dir).withColumn("source_id", moved)
    return quality.isolation_breaches(alerts, fx.sources(spark, sf_dir))


# -- streams -----------------------------------------------------------------


_STREAMED: dict[tuple[str, str, bool], str] = {}


def _streamed(spark: SparkSession, sf_dir: str, late: bool = False) -> str:
    """The events run as a stream of two micro-batches, then closed, once per session; where its tables lie."""
    key = (spark.sparkContext.applicationId, sf_dir, late)
    if key in _STREAMED:
        return _STREAMED[key]
    root = f"{scratch_dir(spark)}/pulsegrid/stream-{uuid.uuid4().hex}"
    for events in fx.event_slices(spark, sf_dir, f"{root}/in", late):
        engine.start(fx.as_entries(events), f"{root}/out", f"{root}/cp", fx.EVENT_PARAMS, "0 seconds",
                     trigger={"availableNow": True}).awaitTermination()
    engine.Run(spark, f"{root}/out", fx.EVENT_PARAMS).close()
    _STREAMED[key] = f"{root}/out"
    return _STREAMED[key]


@query(f"""SELECT tenant_id, source_id, unit, fp, count(*) AS n, round(sum(latency_ms) + 1e-9, 4) AS lat_sum, min(seq) AS first_seq,
    CASE WHEN fp IS NOT NULL THEN arg_min(message, seq) END AS message
    FROM (SELECT *, CASE WHEN level = 'ERROR' THEN {o.fp_sql('message')} END AS fp FROM entries)
    GROUP BY tenant_id, source_id, unit, fp""")
def streamed_windows(spark, sf_dir):
    """The events as a stream, a tenth of the first half late: windows per source and pattern as they stand in the end."""
    rows = engine.stored_windows(spark, _streamed(spark, sf_dir, late=True))
    return rows.groupBy("tenant_id", "source_id", "unit", "fp").agg(
        F.sum("n").alias("n"), F.sum("lat_sum").alias("lat_sum"), F.min_by("message", "first_seq").alias("message"),
        F.min("first_seq").alias("first_seq"),
    ).select("tenant_id", "source_id", "unit", "fp", "n", rounded("lat_sum", 4), "first_seq", "message")


@query(f"""SELECT {_BRIEF_SQL}, tenant_id, round(current_value, 4) AS current_value, round(upper_bound, 4) AS upper_bound,
    {o.stamp('resolved_at')} AS resolved_at,
    CASE WHEN a.fp IS NOT NULL THEN to_json([message])::VARCHAR WHEN sample_count = 0 THEN '[]'
      ELSE coalesce(to_json(messages)::VARCHAR, '[]') END AS representative_msgs
    FROM (SELECT a.*, u.messages, e.message FROM alerts a
      LEFT JOIN unit_messages u ON u.tenant_id = a.tenant_id AND u.source_id = a.source_id AND u.unit = a.unit_id
      LEFT JOIN patterns p ON p.tenant_id = a.tenant_id AND p.source_id = a.source_id AND p.unit = a.unit_id AND p.fp = a.fp
      LEFT JOIN entries e ON e.seq = p.first_seq) a""")
def streamed_alerts(spark, sf_dir):
    """All six detectors over the events as a stream: the alerts of one batch run."""
    return _brief(
        engine.stored_alerts(spark, _streamed(spark, sf_dir)), "tenant_id", rounded("current_value", 4), rounded("upper_bound", 4),
        stamp("resolved_at"), "representative_msgs")


@query(f"""SELECT tenant_id, source_id, {o.stamp('max_ts')} AS last_log_at, {o.stamp(f'max_ts + to_seconds({fx.EVENT_PARAMS.silence_s})')} AS due_at
    FROM (SELECT *, lead(min_ts) OVER (PARTITION BY tenant_id, source_id ORDER BY unit) AS next_ts FROM obs)
    WHERE max_ts + to_seconds({fx.EVENT_PARAMS.silence_s}) <= coalesce(next_ts, (SELECT max(ts) FROM events))""")
def streamed_silences(spark, sf_dir):
    """Silences reported when they fall due, with or without an entry after them."""
    rows = engine.stored_silences(spark, _streamed(spark, sf_dir))
    return rows.select("tenant_id", "source_id", stamp("last_log_at"), stamp("due_at"))


# -- maintenance -------------------------------------------------------------


o.CTES["maintenance"] = """SELECT 't-' || (s_suppkey % 2) AS tenant_id, 'src-' || (s_suppkey % 12) AS source_id,
    TIMESTAMP '2024-01-01' + to_hours(s_suppkey * 37 % 700) AS starts_at, CASE WHEN s_suppkey % 30 <> 17 THEN
      TIMESTAMP '2024-01-01' + to_hours(s_suppkey * 37 % 700 + CASE WHEN s_suppkey % 10 = 0 THEN s_suppkey % 5 + 2 ELSE 0 END * 24
        + s_suppkey % 6 + 1) END AS ends_at FROM supplier"""


@query(f"""SELECT {_BRIEF_SQL} FROM alerts a WHERE NOT (anomaly_type = 'SERVICE_SILENCE' AND EXISTS (
    SELECT 1 FROM maintenance m WHERE m.tenant_id = a.tenant_id AND m.source_id = a.source_id
      AND window_start + to_seconds({fx.EVENT_PARAMS.silence_s}) >= starts_at
      AND (ends_at IS NULL OR window_start + to_seconds({fx.EVENT_PARAMS.silence_s}) < ends_at)))""")
def alerts_outside_maintenance(spark, sf_dir):
    """The alerts without silences that fell due in a maintenance window."""
    return _brief(maintenance.suppress_silences(
        stored_alerts(spark, sf_dir), fx.maintenance_windows(spark, sf_dir), fx.EVENT_PARAMS))


# -- runs that resume, requests inside a run ---------------------------------


@query(f"SELECT {_BRIEF_SQL}, {o.stamp('resolved_at')} AS resolved_at FROM alerts")
def resumed_alerts(spark, sf_dir):
    """Two runs, the second from what the first one left, raise and resolve what one run does."""
    entries, p = fx.log_entries(spark, sf_dir), fx.EVENT_PARAMS
    cut = F.timestamp_seconds(F.lit(1_705_233_600))  # the start of a window
    first = Detection(entries.filter(F.col("occurred_at") < cut), p)
    early = materialize(first.alerts, "early-alerts")
    fired = early.filter(F.col("anomaly_type") == detectors.CASCADE).groupBy("tenant_id").agg(F.max("detected_at").alias("last_at"))
    second = Detection(
        entries.filter(F.col("occurred_at") >= cut), p, state=materialize(first.next_state, "state"),
        open_alerts=early.filter("status = 'open'"), last_cascades=fired, patterns=materialize(first.next_patterns, "patterns"))
    done = early.filter("status <> 'open'")
    return _brief(done.unionByName(second.earlier_alerts).unionByName(second.alerts), stamp("resolved_at"))


@query(f"SELECT {_BRIEF_SQL}, {o.stamp('resolved_at')} AS resolved_at, {o.stamp('acknowledged_at')} AS acknowledged_at FROM ack_alerts")
def alerts_with_acks(spark, sf_dir):
    """Requests take alerts over while the run goes on: rows resolve others, and cascades count them no longer."""
    acks = fx.run_acks(stored_alerts(spark, sf_dir).filter(F.col("anomaly_type") != detectors.CASCADE))
    run = Detection(fx.log_entries(spark, sf_dir), fx.EVENT_PARAMS, acks=materialize(acks, "acks"))
    return _brief(run.alerts, stamp("resolved_at"), stamp("acknowledged_at"))
