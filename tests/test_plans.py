"""Plans have the shape they need at scale."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF
from pulsegrid.operators import observe, queries
from pulsegrid.plans import catalog, fixtures
from pulsegrid.plans.batch import Detection


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_pass_is_one_hash_aggregate_over_pruned_columns(spark):
    text = plan(observe.fine_observations(fixtures.log_entries(spark, SF), fixtures.EVENT_PARAMS))
    assert "SortAggregate" not in text and text.count("Exchange") == 1
    assert "partial_count" in text


def test_filters_reach_the_scan(spark, tmp_path):
    entries = fixtures.log_entries(spark, SF).drop("raw")
    entries.write.parquet(str(tmp_path / "e"))
    stored = spark.read.parquet(str(tmp_path / "e"))
    units = observe.with_unit(stored, fixtures.EVENT_PARAMS)
    text = plan(observe.representative_messages(stored, units, fixtures.EVENT_PARAMS))
    assert re.search(r"PushedFilters: \[[^]]*In\(level", text)
    assert "environment" not in re.search(r"ReadSchema: (\S+)", text).group(1)


def test_lists_are_top_k(spark):
    alerts = Detection(fixtures.log_entries(spark, SF), fixtures.EVENT_PARAMS).detections.withColumn("status", F.lit("open"))
    assert "TakeOrderedAndProject" in plan(queries.list_alerts(alerts, "t-0"))
    assert "WindowGroupLimit" in plan(queries.latest_open_alert(alerts))


# Queries whose plan can be looked at without computing an alert table first.
CHEAP = {
    "parse_json_lines", "parse_logfmt_lines", "parse_plaintext_lines", "parse_document_lines", "external_table_scan",
    "pushed_batch_verdicts", "pushed_entries", "observations", "representative_messages", "error_patterns", "error_baseline",
    "latency_baseline", "sustained_elevations", "service_silences", "novel_errors", "cascades", "audit_statistics",
    "request_latency_ranks", "active_source_cursors", "registry_violations", "tenants_over_limit", "retained_request_log",
    "delivery_queue", "dashboard_summary", "platform_totals", "retained_alerts",
}


@pytest.mark.parametrize("name", sorted(CHEAP))
def test_no_query_pairs_everything(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_queries_and_sql_have_the_same_names():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) > 60
