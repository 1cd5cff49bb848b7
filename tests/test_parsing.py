"""Line formats, pushes, external tables and column functions."""

import hashlib
import hmac
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import parsing, predicates, text
from pulsegrid.operators import ingest
from pulsegrid.schemas import PUSHED_BATCH
from pulsegrid.sources import jdbc

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)


def parse(spark, fmt, lines, latency_field=None):
    df = spark.createDataFrame([(i, line, fmt, latency_field) for i, line in enumerate(lines)],
                               "seq int, line string, log_format string, latency_field string")
    df = df.select("*", *[F.lit(v).alias(c) for c, v in (("source_id", "s"), ("tenant_id", "t"), ("service_name", "svc"),
                                                          ("environment", "prod"), ("ingest_ts", NOW))])
    return {r.seq: r for r in parsing.normalize_lines(df).collect()}


def test_json_lines(spark):
    got = parse(spark, "json", [
        '{"level":"ERROR","message":"timeout hit","time":"2026-01-01T12:00:00Z","latency_ms":1234.5}',
        '{"level":"","lvl":0,"severity":"warn","msg":"m","message":null,"ts":"2026-01-01T12:00:00.250+0200"}',
        '{"level":false,"text":"0","latency_ms":"x"}',
        '{"level":true,"message":[],"msg":"0"}',
        "[1, 2]", "5", '"text"', "null", "   ", "{broken ERROR", '{"a":1} tail fatal', '{"level":"info","level":"debug"}',
        "  {\"level\":\"info\"}　",
    ], "latency_ms")
    assert (got[0].level, got[0].message, got[0].latency_ms, got[0].occurred_at) == (
        "ERROR", "timeout hit", 1234.5, datetime(2026, 1, 1, 12))
    assert (got[1].level, got[1].message, got[1].occurred_at) == ("WARN", "m", datetime(2026, 1, 1, 10, 0, 0, 250000))
    assert (got[2].level, got[2].message, got[2].latency_ms) == ("UNKNOWN", "0", None)
    assert (got[3].level, got[3].message) == ("TRUE", "0")
    assert set(got) & {4, 5, 6, 7, 8} == set()
    assert (got[9].level, got[9].message, got[9].raw) == ("ERROR", "{broken ERROR", {"raw_line": "{broken ERROR"})
    assert (got[10].level, got[10].raw["raw_line"]) == ("CRITICAL", '{"a":1} tail fatal')
    assert got[11].level == "DEBUG" and got[11].message == '{"level":"info","level":"debug"}'
    assert got[12].message == '{"level":"info"}'


def test_logfmt_lines(spark):
    got = parse(spark, "logfmt", [
        'level=WARNING msg="cache miss" latency=250ms', 'lvl="" severity=error text=x duration=1.5s',
        'level=info level=error msg="a \\"b\\" c" elapsed=7', "no pairs but a Fatal word", "latency=abc latency_ms=9 time=2026-01-01T00:00:01Z",
        'msg="" level=debug',
    ])
    assert (got[0].level, got[0].message, got[0].latency_ms) == ("WARNING", "cache miss", 250.0)
    assert (got[1].level, got[1].message, got[1].latency_ms) == ("UNKNOWN", "x", 1.5)
    assert (got[2].level, got[2].message, got[2].latency_ms) == ("ERROR", 'a \\"b\\" c', 7.0)
    assert (got[3].level, got[3].raw) == ("CRITICAL", {"raw_line": "no pairs but a Fatal word"})
    assert (got[4].latency_ms, got[4].occurred_at, got[4].message) == (
        9.0, datetime(2026, 1, 1, 0, 0, 1), "latency=abc latency_ms=9 time=2026-01-01T00:00:01Z")
    assert got[5].message == ""
    configured = parse(spark, "logfmt", ["latency=5 took=12ms", "latency=5"], "took")
    assert (configured[0].latency_ms, configured[1].latency_ms) == (12.0, None)


@pytest.mark.parametrize("line,level", [
    ("an error, then FATAL", "CRITICAL"), ("Error: x", "ERROR"), ("errors seen", "UNKNOWN"), ("warn", "WARNING"),
    ("(warning)", "WARNING"), ("warnings", "UNKNOWN"), ("info_x", "UNKNOWN"), ("éinfo", "UNKNOWN"), ("debug info", "INFO"),
    ("[debug]", "DEBUG"),
])
def test_plaintext_level(spark, line, level):
    assert parse(spark, "plaintext", [line])[0].level == level
    assert parse(spark, "other", [line])[0].level == level


def test_line_ends_inside_a_chunk(spark):
    df = spark.createDataFrame([("a error\r\nb c\x0b\n\nd",)], "line string").select(
        "line", F.lit("plaintext").alias("log_format"), F.lit(None).cast("string").alias("latency_field"),
        *[F.lit("x").alias(c) for c in ("source_id", "tenant_id", "service_name", "environment")], F.lit(NOW).alias("ingest_ts"))
    assert sorted(r.message for r in parsing.normalize_lines(df).collect()) == ["a error", "b", "c", "d"]


@pytest.mark.parametrize("raw,want", [
    ("2026-01-01T12:00:00Z", (12, 0, 0)), ("2026-01-01T12:00:00.5Z", (12, 0, 500000)), ("2026-01-01T12:00:00+05:30", (6, 30, 0)),
    ("2026-01-01 12:00:00", (12, 0, 0)), ("2026-01-01 12:00:00.5", None), ("2026-01-01T12:00:00", None), ("yesterday", None), ("", None),
])
def test_timestamps(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "r string")
    got = df.select(parsing.parse_timestamp(F.col("r")).alias("t")).collect()[0].t
    if want is None:
        assert got is None
    else:
        assert (got.hour, got.minute, got.microsecond) == want
    if raw.endswith(":00.5"):
        wide = df.select(parsing.parse_timestamp(F.col("r"), True).alias("t")).collect()[0].t
        assert wide.microsecond == 500000


def test_fingerprints_match_sha256(spark):
    for message, normal in [("Timeout after 5s", "timeout after Ns"), ("  Port 5432\t", "port N"), ("x١٢y", "xNy"), ("", "")]:
        row = spark.createDataFrame([(message,)], "m string").select(
            text.normalize_message(F.col("m")).alias("n"), text.fingerprint(F.col("m")).alias("f")).collect()[0]
        assert row.n == normal and row.f == hashlib.sha256(normal.encode()).hexdigest()[:16]


@pytest.mark.parametrize("secret", ["k", "k" * 100])
def test_signature_equals_hmac(spark, secret):
    pads = [F.lit(bytearray(p)) for p in text.signing_pads(secret)]
    body = '{"a":"ü"}'
    got = spark.createDataFrame([(body,)], "b string").select(text.signature(F.col("b"), *pads)).collect()[0][0]
    assert got == "sha256=" + hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()
    none = F.lit(None).cast("binary")
    assert spark.range(1).select(text.signature(F.lit("b"), none, none)).collect()[0][0] == ""


def test_cursors(spark):
    at = datetime(2026, 1, 1, 12, 0, 0, 250000)
    zoned = at.replace(tzinfo=timezone.utc)  # a time without zone is taken as UTC
    assert text.decode_cursor(text.encode_cursor(at, "id-1")) == (zoned, "id-1")
    assert text.decode_cursor("garbage") is None and text.decode_cursor(None) is None
    row = spark.range(1).select(text.cursor_column(F.lit(zoned), F.lit("id-1")).alias("c")).collect()[0]
    assert text.decode_cursor(row.c) == (zoned, "id-1")


def test_client_ip_and_hour_label(spark):
    df = spark.createDataFrame([(" 1.2.3.4 , 5.6.7.8", "9.9.9.9"), ("", "9.9.9.9"), (None, "9.9.9.9")], "f string, p string")
    assert [r[0] for r in df.select(text.client_ip(F.col("f"), F.col("p"))).collect()] == ["1.2.3.4", "9.9.9.9", "9.9.9.9"]
    assert spark.range(1).select(text.hour_label(F.lit(NOW))).collect()[0][0] == "2026-01-01T00:00"


@pytest.mark.parametrize("filters,ok", [
    (None, True), ("", True), ("not json", True), ("[]", True), ("{}", True), ('{"severity":"CRITICAL"}', True), ('{"severity":"WARNING"}', False),
    ('{"severity":null}', False), ('{"service_name":"svc","severity":"CRITICAL"}', True), ('{"service_name":"other"}', False),
])
def test_subscription_filters(spark, filters, ok):
    df = spark.createDataFrame([(filters,)], "f string")
    assert df.select(predicates.subscription_matches(F.col("f"), F.lit("CRITICAL"), F.lit("svc"))).collect()[0][0] is ok


# -- pushes


def entry(message="m", level=None, latency=None, at=None):
    return {"message": message, "level": level, "occurred_at": at, "service_name": None, "latency_ms": latency, "metadata": None}


def test_push_validation(spark):
    later = NOW + timedelta(days=365)
    cases = {
        1: ([entry()], None), 2: ([entry(level="warning")] * 100, None), 3: ([entry(), entry(message=None), entry()], "MESSAGE_EMPTY"),
        4: ([entry(level="LOUD")], "LEVEL_UNKNOWN"), 5: ([entry(message="x" * 10_240)], None), 6: ([entry(at=later)], None),
        7: ([entry(), entry(latency=-1.0)], "LATENCY_NEGATIVE"), 8: ([], "BATCH_EMPTY"), 9: ([entry()] * 501, "BATCH_TOO_LARGE"),
        10: ([entry()] * 500, None), 11: ([entry(message="")], "MESSAGE_EMPTY"),
    }
    df = spark.createDataFrame([(i, "h", NOW, e) for i, (e, _) in cases.items()], PUSHED_BATCH)
    got = {r.batch_id: r.problem for r in ingest.validate_batches(df, max_entries=500).collect()}
    assert got == {i: p for i, (_, p) in cases.items()}
    assert {r.problem for r in ingest.validate_batches(df.filter("batch_id = 9")).collect()} == {None}  # no limit of its own


def test_push_attribution_and_entries(spark):
    day = timedelta(days=1)
    keys = spark.createDataFrame([
        ("k1", "t1", "h1", '["ingest"]', None, None, None), ("k2", "t1", "h2", '["ingest"]', NOW, None, None),
        ("k3", "t1", "h3", '["ingest"]', None, NOW - day, None), ("k4", "t1", "h4", '["ingest"]', None, None, NOW - day),
        ("k5", "t1", "h5", '["ingest"]', None, NOW + day, NOW + day), ("k6", "t1", "h6", '["alerts:read"]', None, None, None),
    ], "id string, tenant_id string, key_hash string, scopes string, revoked_at timestamp, expires_at timestamp, grace_period_ends_at timestamp")
    pushed = spark.createDataFrame([(i, f"h{i}", NOW, [entry(), entry(level="error", latency=2.0)]) for i in range(1, 8)], PUSHED_BATCH)
    accepted, refused = ingest.split_batches(pushed, keys)
    assert {r.batch_id: r.reason for r in refused.collect()} == {
        2: "KEY_REVOKED", 3: "KEY_EXPIRED", 4: "KEY_REVOKED", 6: "INSUFFICIENT_SCOPE", 7: "KEY_INVALID"}
    rows = ingest.pushed_entries(accepted).orderBy("batch_id", "seq").collect()
    assert [(r.batch_id, r.source_id, r.tenant_id, r.level, r.service_name, r.environment, r.latency_ms) for r in rows] == [
        (1, "k1", "t1", "INFO", "unknown", "production", None), (1, "k1", "t1", "ERROR", "unknown", "production", 2.0),
        (5, "k5", "t1", "INFO", "unknown", "production", None), (5, "k5", "t1", "ERROR", "unknown", "production", 2.0)]
    assert rows[0].occurred_at == NOW.replace(tzinfo=None) and rows[0].raw == {}


# -- external tables


def test_external_table_mapping(spark):
    table = spark.createDataFrame(
        [(i, "warn" if i % 2 else None, f"m{i}" if i != 10 else None, "2026-01-01 00:00:01.5", str(i)) for i in range(8, 13)],
        "id bigint, lvl string, message string, ts string, elapsed string")
    rows = jdbc.rows_after(table, "9")
    who = {"source_id": "s", "tenant_id": "t", "service_name": "svc", "environment": "e"}
    got = {r.seq: r for r in jdbc.table_entries(rows, F.lit(NOW), who).collect()}
    assert set(got) == {10, 11, 12}
    assert (got[10].level, got[10].message, got[10].latency_ms) == ("UNKNOWN", "", 10.0)
    assert (got[11].level, got[11].occurred_at.microsecond, got[11].raw["lvl"]) == ("WARN", 500000, "warn")
    assert jdbc.high_water_mark(rows).collect()[0][0] == "12"
    assert jdbc.high_water_mark(rows.filter("false")).collect()[0][0] is None
    with pytest.raises(ValueError):
        jdbc.discover(["id", "text"])
    assert jdbc.discover(["id", "message", "latency", "took"], "took") == {"level": None, "time": None, "latency": "took"}
    text_ids = spark.createDataFrame([("a", "m"), ("b", "m")], "id string, message string")
    assert jdbc.rows_after(text_ids, "a").count() == 1


def test_connection_strings():
    assert jdbc.table_name("sqlite:///x.db") == "logs" and jdbc.table_name("sqlite:///x.db?table=app&b=1") == "app"
    assert jdbc.jdbc_url("db://h:5/d?table=x", "postgres") == "jdbc:postgresql://h:5/d"
    assert jdbc.jdbc_url("sqlite:///x.db", "sqlite") == "jdbc:sqlite:x.db"
    assert jdbc.jdbc_url("jdbc:mysql://h/d", "mysql") == "jdbc:mysql://h/d"
