"""Alert queries, acknowledgement, delivery, retention, registry and stored tables."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import text
from pulsegrid.operators import lifecycle, quality, queries, registry, retention, routing
from pulsegrid.schemas import ALERT, API_KEY, DELIVERY, LOG_SOURCE, TENANT, USER
from pulsegrid.sources import tables
from pulsegrid.sources.versions import Conflict, VersionedTable

NOW = datetime(2026, 2, 1, 12, 30, tzinfo=timezone.utc)
DAY = timedelta(days=1)


def make(spark, schema, rows, **common):
    return spark.createDataFrame([tuple({**common, **r}.get(f.name) for f in schema) for r in rows], schema)


def alerts(spark, *rows, **common):
    base = {"tenant_id": "t", "source_id": "s", "detected_at": NOW, "anomaly_type": "ERROR_RATE_SPIKE", "severity": "WARNING",
            "service_name": "svc", "full_payload": '{"resolution":{"resolved_at":null,"duration_seconds":null,"auto_resolved":null}}',
            "status": "open", "created_at": NOW}
    return make(spark, ALERT, rows, **{**base, **common})


def test_pages_are_disjoint_and_complete(spark):
    df = alerts(spark, *[{"id": f"a{i}", "detected_at": NOW + timedelta(seconds=i // 2)} for i in range(5)],
                {"id": "x", "tenant_id": "other"})
    first = queries.alert_page(df, "t", 3).orderBy("page_row").collect()
    assert [r.id for r in first] == ["a4", "a3", "a2"] and first[0].has_more
    second = queries.alert_page(df, "t", 3, cursor=first[0].next_cursor).orderBy("page_row").collect()
    assert [r.id for r in second] == ["a1", "a0"] and not second[0].has_more and second[0].next_cursor is None
    assert queries.alert_page(df, "t", 3, cursor="bad").count() == 3
    assert queries.list_alerts(df, "t", 1000, service="svc", severity="CRITICAL").count() == 0
    assert queries.get_alert(df, "t", "x").count() == 0


def test_acknowledge(spark):
    df = alerts(spark, {"id": "open"}, {"id": "done", "status": "resolved"},
                {"id": "acked", "status": "acknowledged", "acknowledged_by": "u0", "acknowledged_at": NOW - DAY})
    asks = spark.createDataFrame(
        [("t", "open", "u1", NOW), ("t", "open", "u2", NOW + DAY), ("t", "done", "u1", NOW), ("t", "acked", "u1", NOW),
         ("other", "open", "u9", NOW - DAY), ("t", "none", "u1", NOW)],
        "tenant_id string, alert_id string, user_id string, acked_at timestamp")
    got = {r.id: (r.status, r.acknowledged_by) for r in lifecycle.apply_acks(df, asks).collect()}
    assert got == {"open": ("acknowledged", "u1"), "done": ("resolved", None), "acked": ("acknowledged", "u0")}
    answers = {(r.tenant_id, r.alert_id, r.user_id): (r.reason, r.acknowledged_by) for r in lifecycle.ack_results(df, asks).collect()}
    assert answers == {
        ("t", "open", "u1"): (None, "u1"), ("t", "open", "u2"): (None, "u1"), ("t", "done", "u1"): ("ALERT_RESOLVED", None),
        ("t", "acked", "u1"): (None, "u0"), ("other", "open", "u9"): ("ALERT_NOT_FOUND", None), ("t", "none", "u1"): ("ALERT_NOT_FOUND", None)}


def test_trend_may_have_one_label_more(spark):
    df = alerts(spark, {"id": "a", "detected_at": NOW}, {"id": "b", "detected_at": NOW - timedelta(hours=24)},
                {"id": "c", "detected_at": NOW - timedelta(hours=25)})
    rows = queries.trend(df, "t", NOW, 24).collect()
    assert len(rows) == 25 and [r.label for r in rows] == sorted(r.label for r in rows)
    assert sum(r.alerts for r in rows) == 2 and rows[0].label == "2026-01-31T12:00"
    assert queries.trend(df, "t", NOW, 1000).count() == 1000  # every hour asked for
    for ask in (lambda: queries.trend(df, "t", NOW, 0), lambda: queries.list_alerts(df, "t", 0)):
        with pytest.raises(ValueError):
            ask()


def deliveries(spark, *rows, **common):
    base = {"tenant_id": "t", "alert_id": "a", "api_key_id": "k", "attempt_number": 1, "target_url": "u", "payload": "{}",
            "success": False, "created_at": NOW, "sent_at": NOW}
    return make(spark, DELIVERY, rows, **{**base, **common})


def test_delivery_rounds(spark):
    keys = make(spark, API_KEY, [
        {"id": "k1", "webhook_url": "u1"}, {"id": "k2", "webhook_url": "u2", "webhook_filters": '{"severity":"CRITICAL"}'},
        {"id": "k3"}, {"id": "k4", "webhook_url": "u4", "revoked_at": NOW}, {"id": "k5", "webhook_url": "u5", "tenant_id": "other"},
    ], tenant_id="t")
    queue = routing.delivery_queue(alerts(spark, {"id": "a"}), keys).cache()
    assert [(r.api_key_id, r.attempt_number, r.signature) for r in queue.collect()] == [("k1", 1, "")]
    now = F.lit(NOW)

    def outcome(q, status):
        return q.select("delivery_id", F.lit(status).alias("response_status"), F.lit("x" * 600).alias("response_body"),
                        F.lit(5).alias("latency_ms"))

    assert [r.success for r in routing.apply_outcomes(queue, outcome(queue, 399), now).collect()] == [True]
    failed = routing.apply_outcomes(queue, outcome(queue, 500), now).cache()
    row = failed.collect()[0]
    assert (row.success, len(row.response_body), row.next_retry_at) == (False, 600, NOW.replace(tzinfo=None) + timedelta(seconds=2))
    assert routing.retry_queue(failed, keys, F.lit(NOW + timedelta(seconds=1))).count() == 0
    due = F.lit(NOW + timedelta(seconds=2))
    second = routing.retry_queue(failed, keys, due)
    again = routing.apply_outcomes(second, outcome(second, None), due).collect()[0]
    assert (again.attempt_number, again.next_retry_at) == (2, NOW.replace(tzinfo=None) + timedelta(seconds=2 + 4))
    assert routing.clear_due(failed, due).collect()[0].next_retry_at is None
    third = deliveries(spark, {"id": "d3", "attempt_number": 3, "next_retry_at": NOW, "api_key_id": "k1"})
    assert routing.retry_queue(third, keys, due).count() == 0
    bare = keys.withColumn("webhook_url", F.lit(None).cast("string"))
    assert routing.retry_queue(failed, bare, due).count() == 0


def test_one_crowded_tenant(spark):
    """A tenant's alerts meet its subscriptions slice by slice; what is written of a delivery has no payload."""
    keys = make(spark, API_KEY, [{"id": f"k{i}", "webhook_url": "u", "tenant_id": "t"} for i in range(300)] + [
        {"id": "few", "webhook_url": "u", "tenant_id": "small"}, {"id": "idle", "webhook_url": "u", "tenant_id": "none"}])
    rows = alerts(spark, *[{"id": f"a{i}", "full_payload": f"p{i}"} for i in range(5)],
                  {"id": "b", "tenant_id": "small", "full_payload": "pb"}, {"id": "c", "tenant_id": "keyless"})
    queue = routing.delivery_queue(rows, keys)
    assert "_slice" in queue._jdf.queryExecution().optimizedPlan().toString()
    want = {(f"a{i}", f"k{j}", f"p{i}") for i in range(5) for j in range(300)} | {("b", "few", "pb")}
    found = [tuple(r) for r in queue.select("alert_id", "api_key_id", "payload").collect()]
    assert len(found) == len(want) and set(found) == want
    kept = routing.stored(queue, rows, "queue")
    assert kept.columns == queue.columns and sorted(kept.collect()) == sorted(queue.collect())
    assert "payload" not in kept.select("delivery_id", "target_url")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n,ok_at,last_attempt,disabled", [(10, None, 3, True), (9, None, 3, False), (10, 4, 3, False), (12, 11, 3, True), (10, None, 2, False)])
def test_auto_disable(spark, n, ok_at, last_attempt, disabled):
    rows = [{"id": f"d{i:02}", "created_at": NOW - timedelta(minutes=i), "success": i == ok_at, "attempt_number": last_attempt}
            for i in range(n)]
    keys = make(spark, API_KEY, [{"id": "k", "webhook_url": "u", "tenant_id": "t"}])
    got = routing.disable_failing(keys, deliveries(spark, *rows)).collect()[0]
    assert (got.webhook_url is None) is disabled


def tenant(spark):
    return make(spark, TENANT, [{"id": "t", "active": True}, {"id": "off", "active": False}], retention_days=30, log_retention_days=7)


def test_retention(spark):
    old, edge = NOW - 31 * DAY, NOW - 30 * DAY
    df = alerts(spark, {"id": "gone", "status": "resolved", "created_at": old}, {"id": "gone2", "status": "acknowledged", "created_at": old},
                {"id": "open", "created_at": old}, {"id": "edge", "status": "resolved", "created_at": edge},
                {"id": "off", "tenant_id": "off", "status": "resolved", "created_at": old},
                {"id": "stray", "tenant_id": "none", "status": "resolved", "created_at": old})
    marked = retention.mark_alerts(df, tenant(spark), F.lit(NOW))
    assert {r.id for r in retention.kept(marked).collect()} == {"open", "edge", "off", "stray"}
    d = retention.mark_deliveries(deliveries(spark, {"id": "1", "created_at": old}, {"id": "2"}), tenant(spark), F.lit(NOW))
    log = retention.mark_request_log(
        spark.createDataFrame([("t", NOW - 8 * DAY)], "tenant_id string, timestamp timestamp"), tenant(spark), F.lit(NOW))
    assert [tuple(r) for r in retention.deleted_counts(marked, d, log).collect()] == [("t", 2, 1, 1)]


def test_key_expiry(spark):
    keys = make(spark, API_KEY, [{"id": "a", "expires_at": NOW - DAY}, {"id": "b", "grace_period_ends_at": NOW - DAY},
                                 {"id": "c", "expires_at": NOW}, {"id": "d", "revoked_at": NOW - 9 * DAY, "expires_at": NOW - DAY}])
    got = {r.id: r.revoked_at for r in retention.expire_keys(keys, F.lit(NOW)).collect()}
    now = NOW.replace(tzinfo=None)
    assert got == {"a": now, "b": now, "c": None, "d": now - 9 * DAY}


def test_registry_report(spark):
    sources = make(spark, LOG_SOURCE, [
        {"id": "1", "name": "n"}, {"id": "2", "name": "n"}, {"id": "3", "name": "n", "deleted_at": NOW}, {"id": "4", "name": " ", "source_type": "ftp"},
    ], tenant_id="t", service_name="s", source_type="file", log_format="json", poll_interval_s=5, active=True)
    tenants = make(spark, TENANT, [{"id": "t"}], name="t", max_sources=2, retention_days=0, log_retention_days=7)
    keys = make(spark, API_KEY, [{"id": "k", "name": "k", "scopes": '["ingest","x"]', "environment": "live"}])
    users = make(spark, USER, [{"id": "u1", "email": "e"}, {"id": "u2", "email": "e", "deleted_at": NOW}])
    got = {tuple(r) for r in registry.constraint_report(tenants, sources, keys, users).collect()}
    assert got == {
        ("log_source", "1", "name_taken"), ("log_source", "2", "name_taken"), ("log_source", "4", "name_blank"),
        ("log_source", "4", "source_type_unknown"), ("tenant", "t", "retention_days_below_1"), ("tenant", "t", "too_many_sources"),
        ("api_key", "k", "scope_unknown"), ("user", "u1", "email_taken"), ("user", "u2", "email_taken")}
    public = registry.visible_sources(sources, "t")
    assert "connection_config" not in public.columns and public.count() == 3


def test_settings_from_config(spark):
    from pulsegrid.operators import baseline

    config = spark.createDataFrame([(None, "alpha", "0.2"), ("t1", "alpha", "0.5"), (None, "k", "3")],
                                   "tenant_id string, key string, value string")
    sources = spark.createDataFrame([("s1", "t1"), ("s2", "t2")], "id string, tenant_id string")
    got = baseline.fixed_settings(config, sources, {"alpha": "alpha", "k": "warn_k"}).orderBy("source_id").collect()
    assert [(r.source_id, r.alpha, r.warn_k) for r in got] == [("s1", 0.5, 3.0), ("s2", 0.2, 3.0)]


def test_isolation(spark):
    sources = spark.createDataFrame([("s", "t"), ("s2", "t2")], "id string, tenant_id string")
    good = alerts(spark, {"id": "a"}, {"id": "b", "source_id": "s2", "tenant_id": "t2"},
                  {"id": "c", "cascade_context": '{"contributing_services":[{"service_name":"x","alert_id":"a"}]}'})
    assert quality.isolation_breaches(good, sources).count() == 0
    bad = alerts(spark, {"id": "a"}, {"id": "b", "source_id": "s2"},
                 {"id": "c", "source_id": "s2", "tenant_id": "t2", "cascade_context": '{"contributing_services":[{"service_name":"x","alert_id":"a"}]}'})
    assert {(r.id, r.breach) for r in quality.isolation_breaches(bad, sources).collect()} == {
        ("b", "source_of_other_tenant"), ("c", "member_of_other_tenant")}
    lost = alerts(spark, {"id": "a", "source_id": "gone"},
                  {"id": "c", "cascade_context": '{"contributing_services":[{"service_name":"x","alert_id":"none"}]}'})
    assert {(r.id, r.breach) for r in quality.isolation_breaches(lost, sources).collect()} == {
        ("a", "unknown_source"), ("c", "unknown_member")}


def test_cursors_name_one_instant_in_every_zone():
    at = datetime(2026, 2, 1, 12, 0, 0, 5, tzinfo=timezone.utc)
    tokyo = at.astimezone(timezone(timedelta(hours=9)))
    assert text.decode_cursor(text.encode_cursor(tokyo, "x")) == text.decode_cursor(text.encode_cursor(at, "x")) == (at, "x")
    assert text.decode_cursor(text.encode_cursor(at.replace(tzinfo=None), "y")) == (at, "y")
    assert [text.decode_cursor(c) for c in (None, "", "bad", "e30=", "W10=", "bnVsbA==", "é")] == [None] * 7


def test_append_is_idempotent_and_expiry_rewrites(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/alerts", ALERT, "detected_at")
    assert table.read().count() == 0 and table.versions() == []
    df = alerts(spark, {"id": "a", "detected_at": NOW - 40 * DAY, "created_at": NOW - 40 * DAY, "status": "resolved"},
                {"id": "b", "detected_at": NOW - 40 * DAY, "created_at": NOW - 40 * DAY},
                {"id": "c", "detected_at": NOW - 50 * DAY, "created_at": NOW - 50 * DAY, "status": "resolved"}, {"id": "d"})
    table.append_new(df)
    table.append_new(df.unionByName(df))
    ids = lambda *v: {r.id for r in table.read(*v).collect()}
    assert table.read().count() == 4
    cutoff = retention.latest_cutoff(tenant(spark), "retention_days", NOW)
    mark = lambda rows: retention.mark_alerts(rows, tenant(spark), F.lit(NOW))
    plan = table.read(before=cutoff)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part_date" in plan and f"part_date={NOW.date()}" not in str(table.read(before=cutoff).inputFiles())
    version, gone = table.expire(mark, cutoff)
    assert gone == 2 and ids() == {"b", "d"} and ids(version - 1) == {"a", "b", "c", "d"}
    assert table.expire(mark, cutoff) == (version, 0)
    assert dict(table.folders())[str((NOW - 40 * DAY).date())] != dict(table.folders(version - 1))[str((NOW - 40 * DAY).date())]
    table.vacuum(keep=1)
    assert table.versions() == [version] and ids() == {"b", "d"}


def test_interrupted_writes_leave_the_version(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, f"{tmp_path}/alerts", ALERT, "detected_at")
    old = {"detected_at": NOW - 40 * DAY, "created_at": NOW - 40 * DAY}
    table.append(alerts(spark, {"id": "a", "status": "resolved", **old}, {"id": "b", **old}))
    mark = lambda rows: retention.mark_alerts(rows, tenant(spark), F.lit(NOW))
    before = sorted(map(str, table.read().collect()))

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "commit", fail)
        for job in (lambda: table.expire(mark, NOW.date()), lambda: table.append(alerts(spark, {"id": "c"}))):
            with pytest.raises(RuntimeError):
                job()
        assert sorted(map(str, table.read().collect())) == before
    # A second writer from the same version fails; a new try goes on from the first one's.
    folders = table.folders()
    table.append(alerts(spark, {"id": "c"}))
    with pytest.raises(Conflict):
        table.commit(folders, 1)
    table.expire(mark, NOW.date())
    assert {r.id for r in table.read().collect()} == {"b", "c"}
    for i in range(4):
        table.append(alerts(spark, {"id": f"more{i}"}))
    table.compact(most=2)
    assert len(table.folders()[str(NOW.date())]) == 1 and table.read().count() == 6
    table.vacuum()
    assert table.read().count() == 6 and len(table.versions()) == 2


def test_cascades_close_with_their_members(spark):
    import json

    def cascade(i, members, **more):
        said = {"contributing_services": [{"service_name": f"svc{k}", "alert_id": m} for k, m in enumerate(members)]}
        return {"id": i, "anomaly_type": "CASCADE", "detected_at": NOW + timedelta(minutes=5), "cascade_context": json.dumps(said), **more}

    minute = lambda m: NOW + timedelta(minutes=m)
    df = alerts(
        spark, {"id": "a", "status": "resolved", "resolved_at": minute(9)}, {"id": "b", "status": "resolved", "resolved_at": minute(2)},
        {"id": "c"}, {"id": "d", "status": "acknowledged", "resolved_at": None},
        cascade("x", "ab"), cascade("early", "bb"), cascade("y", "ac"), cascade("z", "ad"), cascade("lost", ["a", "gone"]),
        cascade("done", "ab", status="resolved", resolved_at=minute(6)))
    closings = lifecycle.cascade_closings(df)
    assert {r.id: r.resolved_at.replace(tzinfo=timezone.utc) for r in closings.collect()} == {"x": minute(9), "early": minute(5)}
    got = {r.id: r.status for r in lifecycle.apply_resolutions(df, closings).filter("anomaly_type = 'CASCADE'").collect()}
    assert got == {"x": "resolved", "early": "resolved", "y": "open", "z": "open", "lost": "open", "done": "resolved"}
    assert lifecycle.cascade_closings(df.limit(0)).count() == 0


def test_current_alerts(spark):
    opened = alerts(spark, {"id": "a"}, {"id": "b"}, {"id": "c"})
    closed = spark.createDataFrame([("a", NOW + DAY), ("b", NOW + DAY)], "id string, resolved_at timestamp")
    asks = spark.createDataFrame([("t", "b", "u", NOW + DAY / 2), ("t", "a", "u", NOW + 2 * DAY), ("t", "c", "u", NOW)],
                                 "tenant_id string, alert_id string, user_id string, acked_at timestamp")
    got = {r.id: r.status for r in tables.current_alerts(opened, closed, asks).collect()}
    assert got == {"a": "resolved", "b": "acknowledged", "c": "acknowledged"}


def test_cursors_and_append_log(spark, tmp_path):
    first = spark.createDataFrame([("s1", "t", 10, NOW), ("s2", "t", 5, NOW)],
                                  "source_id string, tenant_id string, byte_offset bigint, updated_at timestamp")
    later = first.filter("source_id = 's1'").withColumn("byte_offset", F.lit(30).cast("bigint")).withColumn(
        "updated_at", F.lit(NOW + DAY))
    stored = VersionedTable(spark, f"{tmp_path}/cursors", first.schema, "updated_at")
    stored.append(first)
    stored.append(later)
    log = stored.read()
    assert {r.source_id: r.byte_offset for r in tables.latest_cursors(log).collect()} == {"s1": 30, "s2": 5}
    merged = tables.upsert_by_key(first, later, ["source_id"])
    assert {r.source_id: r.byte_offset for r in merged.collect()} == {"s1": 30, "s2": 5}


def test_polled_sources_get_their_cursor(spark):
    sources = make(spark, LOG_SOURCE, [
        {"id": "f", "source_type": "file", "connection_config": "/var/log/a", "active": True},
        {"id": "d", "source_type": "postgres", "connection_config": "db://h/d", "active": True}, {"id": "off", "active": False}])
    state = spark.createDataFrame([("d", None, 0, "42")], "source_id string, file_inode bigint, byte_offset bigint, last_seen_id string")
    got = {r.source_id: r for r in registry.active_sources(sources, state).collect()}
    assert set(got) == {"f", "d"}
    assert (got["f"].file_path, got["f"].connection_string, got["f"].byte_offset, got["f"].last_seen_id) == ("/var/log/a", None, 0, "0")
    assert (got["d"].file_path, got["d"].connection_string, got["d"].last_seen_id) == (None, "db://h/d", "42")


def test_summary_and_platform_totals(spark):
    df = alerts(spark, {"id": "1"}, {"id": "2", "severity": "CRITICAL"}, {"id": "3", "status": "resolved"},
                {"id": "4", "status": "acknowledged"}, {"id": "5", "tenant_id": "u"})
    sources = make(spark, LOG_SOURCE, [{"id": "a", "active": True}, {"id": "b", "active": False},
                                       {"id": "c", "active": True, "deleted_at": NOW}], tenant_id="t")
    users = make(spark, USER, [{"id": "u1", "active": True}, {"id": "u2", "active": False}])
    assert queries.summary(df, sources, "t").collect()[0].asDict() == {
        "total_alerts": 4, "open": 2, "resolved": 1, "acknowledged": 1, "critical_open": 1, "warning_open": 1, "active_sources": 1}
    assert queries.platform_totals(tenant(spark), df, sources, users).collect()[0].asDict() == {
        "total_tenants": 2, "active_tenants": 1, "total_alerts": 5, "open_alerts": 3, "active_sources": 1, "active_users": 1}
