"""The given tables read as this engine's inputs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.params import DetectorParams

# The events are sparse, so time limits are wider than in live service.
EVENT_PARAMS = DetectorParams(
    window_s=3600, silence_s=3 * 3600, sustained_warn_s=3 * 3600, sustained_crit_s=5 * 3600,
    cascade_window_s=6 * 3600, novel_ttl_s=5 * 86_400,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_entries(table(spark, sf_dir, "events"))


def as_entries(e: DataFrame) -> DataFrame:
    """`events` as LOG_ENTRY rows: twelve sources of two tenants; `seq` is the event id."""
    source = (F.col("user_id") % 12).cast("string")
    code = F.translate(F.get_json_object("props", "$.k"), "0123456789", "abcdefghij")
    return e.select(
        F.col("ts").cast("timestamp").alias("occurred_at"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
        F.concat(F.col("event_type"), F.lit(" code "), code, F.lit(" after "), F.col("event_id").cast("string"),
                 F.lit("ms")).alias("message"),
        F.concat(F.lit("src-"), source).alias("source_id"),
        F.concat(F.lit("t-"), (F.col("user_id") % 2).cast("string")).alias("tenant_id"),
        F.concat(F.lit("svc-"), source).alias("service_name"),
        F.lit("production").alias("environment"),
        F.col("value").alias("latency_ms"),
        F.create_map(F.lit("props"), F.col("props")).alias("raw"),
        F.col("event_id").alias("seq"),
    )


def event_slices(spark: SparkSession, sf_dir: str, folder: str, late: bool = False) -> Iterator[DataFrame]:
    """The events as a stream of two slices, in order of time; with `late`, some of the first come with the second.

    Each slice is written, as files of many tasks, when the stream has taken the one before.
    """
    events = table(spark, sf_dir, "events")
    middle = F.timestamp_seconds(F.lit(1_705_276_800))  # mid January 2024
    early = F.col("ts").cast("timestamp") < middle
    if late:
        early = early & (F.col("event_id") % 10 != 7)
    for i, part in enumerate((events.filter(early), events.filter(~early))):
        part.repartition(spark.sparkContext.defaultParallelism).write.parquet(f"{folder}/part={i}")
        yield spark.readStream.schema(events.schema).parquet(f"{folder}/part=*")


def _text(name: str):
    return F.col(name).cast("string")


def _iso(ts: str):
    return F.date_format(F.col(ts).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _source_columns():
    source = (F.col("user_id") % 12).cast("string")
    return [
        F.concat(F.lit("src-"), source).alias("source_id"),
        F.concat(F.lit("t-"), (F.col("user_id") % 2).cast("string")).alias("tenant_id"),
        F.concat(F.lit("svc-"), source).alias("service_name"),
        F.lit("production").alias("environment"),
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("ingest_ts"),
    ]


def _by_type(**lines):
    pick = F.lit(None).cast("string")
    for kind, line in lines.items():
        pick = F.when(F.col("event_type") == kind, line).otherwise(pick)
    return pick


def event_lines(spark: SparkSession, sf_dir: str, log_format: str) -> DataFrame:
    """Every event as one raw line of the given format, each event type in another dialect."""
    value, event, k = _text("value"), _text("event_id"), F.get_json_object("props", "$.k")
    seconds = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    s = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    forms = {
        "json": {
            "error": s('{"level":"error","message":"failed after ', event, 'ms","time":"', _iso("ts"),
                       '","latency_ms":', value, "}"),
            "click": s('{"level":"","lvl":"warning","msg":"slow ', k, '","ts":"', _iso("ts"), '","latency_ms":"',
                       value, '"}'),
            "signup": s('{"severity":"info","text":"new user","timestamp":"', seconds, '","n":', k, "}"),
            "purchase": s('{"level":"ERROR", order ', event, " is fatal"),
            "view": s("[", event, "]"),
        },
        "logfmt": {
            "error": s('level=error msg="failed after ', event, 'ms" latency=', value, "ms ts=", _iso("ts")),
            "click": s("lvl=warn message=slow duration=", value, "s time=", _iso("ts")),
            "signup": s("user ", event, " WARNING no pairs here"),
            "purchase": s('level=info level=debug msg="a \\"quoted\\" b" elapsed=', k),
            "view": s('severity="" text="" latency=abc latency_ms=', k),
        },
        "plaintext": {
            "error": s("  [Error] request ", event, " failed\t"),
            "click": s("warn: slow click ", k),
            "signup": s("INFO new user; debug on ", k),
            "purchase": s("payment ", event, " FATAL error"),
            "view": s("errors seen ", k, " infos"),
        },
    }
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), _by_type(**forms[log_format]).alias("line"),
        F.lit(log_format).alias("log_format"),
        (F.lit("latency_ms") if log_format == "json" else F.lit(None).cast("string")).alias("latency_field"),
        *_source_columns(),
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts as plain text of one source per document source."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), F.col("text").alias("line"), F.lit("plaintext").alias("log_format"),
        F.lit(None).cast("string").alias("latency_field"), F.col("source").alias("source_id"),
        F.lit("t-0").alias("tenant_id"), F.col("source").alias("service_name"), F.col("lang").alias("environment"),
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("ingest_ts"),
    )


def external_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as an external log table with other column names and text times."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("props").alias("message"), F.col("event_type").alias("severity"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"),
        F.col("value").alias("duration"),
    )


def pushed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as pushed batches of at most 100 turns; some levels and keys are invalid."""
    level = F.when(F.col("role") == "user", "info").when(F.col("role") == "assistant", "error").otherwise(
        F.when(F.col("conv_id") % 5 == 0, "notice"))
    received = F.timestamp_seconds(1_704_067_200 + F.col("batch_id") * 60)
    entry = F.struct(
        F.col("text").alias("message"), level.alias("level"),
        F.lit(None).cast("timestamp").alias("occurred_at"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("svc-"), F.col("role"))).alias("service_name"),
        (F.col("turn") * 10 - F.when(F.col("conv_id") % 7 == 0, 10).otherwise(0)).cast("double").alias("latency_ms"),
        _text("turn").alias("turn_text"),
    )
    rows = table(spark, sf_dir, "conversations").withColumn(
        "batch_id", F.col("conv_id") * 1000 + F.floor(F.col("turn") / 100))
    return rows.groupBy("batch_id").agg(
        F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("turn", entry.alias("e")))).alias("es")
    ).select(
        "batch_id", F.sha2(F.concat(F.lit("key-"), (F.col("conv_id") % 120).cast("string")), 256).alias("key_hash"),
        received.alias("received_at"), F.transform("es.e", lambda e: F.struct(
            *[e[c].alias(c) for c in ("message", "level", "occurred_at", "service_name", "latency_ms")],
            F.create_map(F.lit("turn"), e["turn_text"]).alias("metadata"))).alias("entries"),
    )


# -- registry ----------------------------------------------------------------


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("t-"), _text("n_nationkey")).alias("id"),
        F.when(n % 9 == 8, " ").otherwise(F.col("n_name")).alias("name"),
        F.lit("starter").alias("plan"), F.lit("ops@example.com").alias("contact_email"),
        (n * 40).cast("int").alias("max_sources"), (n % 20 + 2).cast("int").alias("retention_days"),
        (n % 6).cast("int").alias("log_retention_days"), (F.col("n_regionkey") != 4).alias("active"),
        F.timestamp_seconds(1_672_531_200 + n * 86_400).alias("created_at"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("u-"), _text("c_custkey")).alias("id"),
        F.concat(F.lit("t-"), _text("c_nationkey")).alias("tenant_id"),
        F.concat(F.lower("c_mktsegment"), F.lit("."), (c - c % 3).cast("string"), F.lit("@example.com")).alias("email"),
        F.when(c % 10 == 0, "tenant_admin").otherwise("tenant_operator").alias("role"),
        (F.col("c_acctbal") > 0).alias("active"), F.lit("hidden").alias("password_hash"),
        F.timestamp_seconds(1_672_531_200 + c * 60).alias("created_at"),
        F.when(F.col("c_acctbal") < -500, F.timestamp_seconds(F.lit(1_700_000_000))).alias("deleted_at"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source per customer; the first twelve are those of the events."""
    c = F.col("c_custkey")
    kinds = {"BUILDING": "file", "FURNITURE": "postgres", "HOUSEHOLD": "mysql", "MACHINERY": "push"}
    kind = F.lit("syslog")
    for segment, name in kinds.items():
        kind = F.when(F.col("c_mktsegment") == segment, name).otherwise(kind)
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("src-"), _text("c_custkey")).alias("id"),
        F.concat(F.lit("t-"), (c % 2).cast("string")).alias("tenant_id"),
        F.concat(F.lit("source "), (c - c % 4).cast("string")).alias("name"),
        F.concat(F.lit("svc-"), _text("c_custkey")).alias("service_name"),
        F.lit("production").alias("environment"), kind.alias("source_type"),
        F.concat(F.lit("/var/log/"), _text("c_custkey")).alias("connection_config"),
        (c % 8).cast("int").alias("poll_interval_s"), F.lit(None).cast("string").alias("latency_field"),
        F.when(c % 13 == 0, "xml").when(c % 2 == 0, "json").otherwise("logfmt").alias("log_format"),
        (F.col("c_acctbal") > 0).alias("active"),
        F.timestamp_seconds(1_672_531_200 + c * 60).alias("created_at"),
        F.when(F.col("c_acctbal") < -500, F.timestamp_seconds(F.lit(1_700_000_000))).alias("deleted_at"),
    )


def source_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").filter("c_acctbal > 1000").select(
        F.concat(F.lit("src-"), _text("c_custkey")).alias("source_id"),
        F.concat(F.lit("t-"), (c % 2).cast("string")).alias("tenant_id"),
        (c * 100).alias("byte_offset"), (c + 7).alias("file_inode"), (c * 3).cast("string").alias("last_seen_id"),
    )


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    at = lambda seconds: F.timestamp_seconds(F.lit(seconds))
    scopes = (
        F.when(s % 10 == 9, '["alerts:read"]').when(s % 17 == 0, '[]').when(s % 19 == 0, '["ingest","root"]')
        .otherwise('["ingest","webhooks:manage"]')
    )
    filters = (
        F.when(s % 4 == 1, '{"severity":"CRITICAL"}').when(s % 4 == 2, '{"service_name":"svc-3","severity":"WARNING"}')
        .when(s % 4 == 3, "not json")
    )
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("key-"), _text("s_suppkey")).alias("id"),
        F.concat(F.lit("t-"), _text("s_nationkey")).alias("tenant_id"),
        F.concat(F.lit("u-"), (s % 40).cast("string")).alias("user_id"), F.col("s_name").alias("name"),
        F.sha2(F.concat(F.lit("key-"), _text("s_suppkey")), 256).alias("key_hash"),
        F.when(s % 23 == 0, "staging").otherwise("live").alias("environment"), scopes.alias("scopes"),
        F.when(F.col("s_acctbal") > 0, F.concat(F.lit("https://hooks.example.net/"), _text("s_suppkey"))).alias("webhook_url"),
        filters.alias("webhook_filters"),
        F.when(s % 7 == 3, at(1_704_067_200)).when(s % 7 == 4, at(1_893_456_000)).alias("expires_at"),
        F.when(s % 11 == 5, at(1_704_000_000)).alias("grace_period_ends_at"),
        F.when(s % 13 == 6, at(1_703_000_000)).alias("revoked_at"),
        F.timestamp_seconds(1_672_531_200 + s * 3600).alias("created_at"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("req-"), _text("event_id")).alias("id"),
        F.concat(F.lit("t-"), (u % 25).cast("string")).alias("tenant_id"),
        F.col("ts").cast("timestamp").alias("timestamp"), F.lit("GET").alias("method"),
        F.concat(F.lit("/api/v1/"), F.col("event_type")).alias("path"),
        F.when(F.col("event_type") == "error", 500).when(u % 9 == 0, 404).otherwise(200).alias("status_code"),
        F.floor("value").cast("int").alias("latency_ms"),
        F.when(u % 3 == 0, F.concat(F.lit(" 10.0.0."), (u % 250).cast("string"), F.lit(" , 10.1.1.1")))
        .when(u % 3 == 1, "").alias("forwarded"),
        F.concat(F.lit("192.168.0."), (u % 250).cast("string")).alias("peer"),
    )


def acks(alerts: DataFrame) -> DataFrame:
    """Someone asks half an hour after each detection; spikes are also asked for by another tenant."""
    later = F.timestamp_micros(F.unix_micros("detected_at") + 1_800_000_000)
    own = alerts.select("tenant_id", F.col("id").alias("alert_id"), F.lit("u-1").alias("user_id"), later.alias("acked_at"))
    foreign = alerts.filter("anomaly_type = 'ERROR_RATE_SPIKE'").select(
        F.lit("t-9").alias("tenant_id"), F.col("id").alias("alert_id"), F.lit("u-9").alias("user_id"), later.alias("acked_at"))
    return own.unionByName(foreign)


def outcomes(queue: DataFrame) -> DataFrame:
    """What the receivers answered, derived from the delivery id; a third does not answer."""
    digit = F.substring("delivery_id", 1, 1)
    return queue.select(
        "delivery_id",
        F.when(digit < "4", 200).when(digit < "6", 302).when(digit < "b", 503).alias("response_status"),
        F.when(digit < "b", F.repeat(digit, 600)).otherwise("timeout").alias("response_body"),
        F.when(digit < "b", 12).alias("latency_ms"),
    )


def run_acks(alerts: DataFrame) -> DataFrame:
    """Requests soon after two alerts in five: at the end of the next window, or half a window after the alert."""
    first = F.substring("id", 1, 1)
    delay = F.when(first < "3", 3600).when(first < "6", 1800)
    return alerts.filter(delay.isNotNull()).select(
        "tenant_id", F.col("id").alias("alert_id"), F.lit("u-2").alias("user_id"),
        F.timestamp_micros(F.unix_micros("detected_at") + delay.cast("bigint") * 1_000_000).alias("acked_at"))


def maintenance_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One window per supplier: some hours long, every tenth some days, every thirtieth without an end."""
    key = F.col("s_suppkey")
    hour = 3600 * 1_000_000
    start = F.lit(1_704_067_200_000_000) + (key * 37 % 700).cast("bigint") * hour
    length = F.when(key % 10 == 0, key % 5 + 2).otherwise(0) * 24 + key % 6 + 1
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("t-"), (key % 2).cast("string")).alias("tenant_id"),
        F.concat(F.lit("src-"), (key % 12).cast("string")).alias("source_id"),
        F.timestamp_micros(start).alias("starts_at"),
        F.when(key % 30 != 17, F.timestamp_micros(start + length.cast("bigint") * hour)).alias("ends_at"))
