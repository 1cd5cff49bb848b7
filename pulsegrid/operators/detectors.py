"""The six detectors. Each returns DETECTION rows: facts of an alert, no payload yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import ordered
from pulsegrid.operators.observe import KEYS
from pulsegrid.operators.ordered import (
    cooldown, running, running_in_ranges, stack_matches, stack_matches_with_removals, time_cell, with_position,
)
from pulsegrid.params import MICROS, DetectorParams
from pulsegrid.session import materialize

SPIKE, SUSTAINED, SILENCE = "ERROR_RATE_SPIKE", "SUSTAINED_ELEVATION", "SERVICE_SILENCE"
LATENCY, NOVEL, CASCADE = "LATENCY_SPIKE", "NOVEL_ERROR", "CASCADE"

DETECTION = [
    *KEYS, "unit_id", "pos", "detected_at", "anomaly_type", "severity", "service_name", "environment",
    "current_value", "baseline_value", "upper_bound", "unit", "window_start", "window_end",
    "sample_count", "ewma_value", "ewma_variance", "alpha", "sensitivity", "warmup_complete",
    "observations_count", "fp", "message", "contributing",
]
_MEMBERS = "array<struct<service_name:string,alert_id:string>>"


def _detection(df: DataFrame, anomaly_type: str, **cols: Column) -> DataFrame:
    """Fill in what most detectors share and order the columns."""
    common = {
        "unit_id": F.col("unit"),
        "anomaly_type": F.lit(anomaly_type),
        "severity": F.when(F.col("is_critical"), "CRITICAL").otherwise("WARNING")
        if "is_critical" in df.columns else F.lit("WARNING"),
        "window_start": F.col("min_ts"), "window_end": F.col("max_ts"), "sample_count": F.col("n"),
        "ewma_value": F.col("m"), "ewma_variance": F.col("v"),
        "warmup_complete": F.col("warm") >= F.col("warmup_required"),
        "observations_count": F.col("warm"), "fp": F.lit(None).cast("string"),
        "message": F.lit(None).cast("string"), "contributing": F.lit(None).cast(_MEMBERS),
    }
    made = {**common, **cols}
    return df.select(*[made[c].alias(c) if c in made else F.col(c) for c in DETECTION])


def error_rate_spikes(base: DataFrame) -> DataFrame:
    return _detection(
        base.filter("is_spike"), SPIKE, current_value=F.col("error_rate"), baseline_value=F.col("m"),
        upper_bound=F.col("bound"), unit=F.lit("error_fraction"),
    )


def latency_spikes(latency: DataFrame) -> DataFrame:
    return _detection(
        latency.filter("is_spike"), LATENCY, current_value=F.col("lat_mean"), baseline_value=F.col("lm"),
        upper_bound=F.col("bound"), unit=F.lit("ms"),
    )


def _seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(float(MICROS))


def service_silences(base: DataFrame, params: DetectorParams) -> DataFrame:
    """A gap since the previous observation's last entry; evidence is the state before the update."""
    gap = _seconds(F.col("min_ts"), F.col("prev_max_ts"))
    rows = base.filter(gap >= params.silence_s)
    before = F.col("warm") - 1
    return _detection(
        rows, SILENCE, severity=F.lit("CRITICAL"), current_value=gap, baseline_value=F.col("prev_vol"),
        upper_bound=F.lit(float(params.silence_s)), unit=F.lit("seconds_silent"),
        window_start=F.col("prev_max_ts"), window_end=F.col("min_ts"),
        ewma_value=F.col("prev_m"), ewma_variance=F.col("prev_v"),
        warmup_complete=before >= F.col("warmup_required"), observations_count=before,
    )


def _bare(params: DetectorParams) -> dict[str, Column]:
    """Evidence of the alerts that are judged without entries."""
    fields = {
        "window_start": F.col("detected_at"), "window_end": F.col("detected_at"), "sample_count": F.lit(0).cast("bigint"),
    }
    if not params.carry_service:
        fields |= {"service_name": F.lit("unknown"), "environment": F.lit("production")}
    return fields


def sustained_elevations(base: DataFrame, params: DetectorParams) -> DataFrame:
    """First row of a run above the mean at each age limit; CRITICAL alone if one row passes both.

    Ages grow along a run, so a limit is passed where this row's age reaches it
    and the previous row's does not. `base` is read twice.
    """
    rows = running(
        base, KEYS, F.floor(F.col("pos") / F.lit(ordered.BLOCK_ROWS)), ["pos"],
        {"began": ("max", F.when(F.col("starts_up"), F.col("detected_at")))},
    ).filter("is_up and not starts_up")
    since = F.coalesce("began", "up_since")  # an elevation may have begun in an earlier run
    age = _seconds(F.col("detected_at"), since)
    prev_age = _seconds(F.col("prev_detected_at"), since)
    passes = lambda limit: (age >= limit) & (prev_age < limit)
    critical = passes(params.sustained_crit_s)
    # A row at or past the critical age gets no warning.
    warning = passes(params.sustained_warn_s) & (age < params.sustained_crit_s)
    rows = rows.withColumn("is_critical", critical).filter(critical | warning)
    return _detection(
        rows, SUSTAINED, current_value=F.col("error_rate"), baseline_value=F.col("m"),
        upper_bound=F.col("m"), unit=F.lit("error_fraction"), **_bare(params),
    )


def stored_patterns(state: DataFrame) -> DataFrame:
    """Patterns kept inside an EWMA_STATE table, one row each (`last_at`: first sighting)."""
    rows = state.select(*KEYS, F.explode("error_fingerprints").alias("e"))
    return rows.select(*KEYS, "e.fp", F.col("e.seen_at").alias("last_at"))


def novel_patterns(
    patterns: DataFrame, base: DataFrame, params: DetectorParams, known: DataFrame | None = None
) -> DataFrame:
    """Error patterns not stored for the time to live, after warm-up.

    A stored pattern's time runs from the alert and is not refreshed. `known` holds
    patterns stored by earlier runs. There is no cap on stored patterns, in the stream neither.
    """
    warm_from = base.filter("ready").groupBy(*KEYS).agg(F.min("pos").alias("_from"))
    placed = patterns.join(base.select(*KEYS, "unit", "pos"), [*KEYS, "unit"])
    seen = placed.join(warm_from, KEYS).filter("pos >= _from").drop("_from")
    kept = cooldown(seen, [*KEYS, "fp"], "detected_at", params.novel_ttl_s, known)
    # Several batches may arrive at one instant; the first of them shows the pattern.
    first = seen.groupBy(*KEYS, "fp", "detected_at").agg(F.min("pos").alias("pos"))
    return seen.join(first.join(kept, [*KEYS, "fp", "detected_at"]), [*KEYS, "fp", "detected_at", "pos"]).select(*patterns.columns)


def next_patterns(
    novel: DataFrame, base: DataFrame, params: DetectorParams, known: DataFrame | None = None
) -> DataFrame:
    """Patterns still stored after the last observation of their source, to seed the next run."""
    rows = novel.select(*KEYS, "fp", F.col("detected_at").alias("last_at"))
    if known is not None:
        rows = rows.unionByName(known.select(*rows.columns))
    end = base.groupBy(*KEYS).agg(F.max("detected_at").alias("_end"))
    latest = rows.groupBy(*KEYS, "fp").agg(F.max("last_at").alias("last_at")).join(end, KEYS, "left")
    age = _seconds(F.col("_end"), F.col("last_at"))
    return latest.filter(F.col("_end").isNull() | (age < params.novel_ttl_s)).drop("_end")


def novel_errors(novel: DataFrame, evidence: DataFrame, base: DataFrame) -> DataFrame:
    """Alerts for `novel_patterns`, each with the entry that showed the pattern (`first_entries`)."""
    facts = base.select(*KEYS, "unit", "pos", "detected_at", "m", "v", "warm", "warmup_required", "alpha", "sensitivity")
    rows = novel.select(*KEYS, "unit", "fp").join(evidence, [*KEYS, "unit", "fp"]).join(facts, [*KEYS, "unit"])
    return _detection(
        rows, NOVEL, severity=F.lit("WARNING"), current_value=F.lit(1.0), baseline_value=F.lit(0.0),
        upper_bound=F.lit(0.0), unit=F.lit("novel_pattern"), fp=F.col("fp"), message=F.col("message"),
        window_start=F.col("occurred_at"), window_end=F.col("occurred_at"), sample_count=F.lit(1).cast("bigint"),
    )


# -- automatic resolution ----------------------------------------------------


def _ops(df: DataFrame, kind: str, op: Column) -> DataFrame:
    return df.select(
        *KEYS, F.lit(kind).alias("anomaly_type"), "pos", op.cast("int").alias("op"),
        F.col("detected_at").alias("at"),
    ).filter("op is not null")


def push_or_pop(marked: DataFrame, kind: str) -> DataFrame:
    """Spikes open an alert; a clean row after a clean row resolves one."""
    return _ops(marked, kind, F.when(F.col("is_spike"), 1).when(F.col("pops"), -1))


def resolution_ops(base: DataFrame, latency: DataFrame, sustained: DataFrame) -> DataFrame:
    """Pushes (an alert opens) and pops (a row resolves the newest open one) per source and type."""
    return (
        push_or_pop(base, SPIKE)
        .unionByName(push_or_pop(latency, LATENCY))
        .unionByName(_ops(sustained, SUSTAINED, F.lit(1)))
        .unionByName(_ops(base.filter("ready and not is_up"), SUSTAINED, F.lit(-1)))
    )


def resolutions(ops: DataFrame, open_alerts: DataFrame | None = None, acked: DataFrame | None = None) -> DataFrame:
    """Which alert each clean row resolves: newest first, one per row.

    `open_alerts` are still-open alerts of earlier runs (acknowledged ones are not open); they lie below this run's
    alerts, oldest at the bottom. `acked` (keys, anomaly_type, pos, `acked_at`) are alerts that someone takes over: from
    then on no row resolves them. Returns keys, anomaly_type, `pos` of the alert (negative for earlier ones) and
    `resolved_at`.
    """
    kinds = [*KEYS, "anomaly_type"]
    if open_alerts is not None:
        ops = ops.unionByName(placed_open_alerts(open_alerts).select(
            *kinds, "pos", F.lit(1).alias("op"), F.col("detected_at").alias("at")))
    if acked is None:
        matched = stack_matches(ops, kinds)
    else:
        gone = acked.select(*kinds, "pos", F.lit(1).alias("op"), F.col("acked_at").alias("gone_at"))
        matched = stack_matches_with_removals(ops.join(gone, [*kinds, "pos", "op"], "left"), kinds)
    return matched.select(*kinds, F.col("push_pos").alias("pos"), F.col("pop_at").alias("resolved_at"))


def requested(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """The first request for each of `alerts` (DETECTION rows with `id`): keys, anomaly_type, pos, acked_at."""
    first = acks.groupBy("tenant_id", F.col("alert_id").alias("id")).agg(F.min("acked_at").alias("acked_at"))
    return alerts.select(*KEYS, "anomaly_type", "pos", "id").join(first, ["tenant_id", "id"]).drop("id")


def placed_open_alerts(alerts: DataFrame) -> DataFrame:
    """Open alerts with positions below zero in their source's and type's order."""
    kinds = [*KEYS, "anomaly_type"]
    rows = alerts.filter(F.col("status") == "open").filter(F.col("anomaly_type").isin(SPIKE, LATENCY, SUSTAINED))
    placed = with_position(rows, kinds, ["detected_at", "id"], time_cell(F.col("detected_at"), 86_400), "_up")
    total = rows.groupBy(*kinds).agg(F.count(F.lit(1)).alias("_count"))
    return placed.join(total, kinds).withColumn("pos", F.col("_up") - F.col("_count")).drop("_up", "_count")


# -- cascade -----------------------------------------------------------------


def open_services(spikes: DataFrame, params: DetectorParams) -> DataFrame:
    """At each spike, how many distinct services of the tenant have a recent open one.

    A spike counts for its service from its own instant through `cascade_window_s`
    later, or until it is resolved or acknowledged. Spikes of one instant are taken in source
    order. A sweep over starts and ends, cut into ranges of equal size, replaces any pairing of spikes. `spikes`
    holds detections with `resolved_at`, `acked_at` and `id`; pass a written table.
    """
    at = F.unix_micros("detected_at")
    end = F.least(at + params.cascade_window_s * MICROS + 1, F.unix_micros("resolved_at"), F.unix_micros("acked_at"))
    base = spikes.select(
        "tenant_id", "service_name", "source_id", "pos", "detected_at",
        at.alias("start"), F.greatest(end, at + 1).alias("end"),
    )
    edges = base.select(
        "tenant_id", "service_name", "source_id", "pos", "detected_at",
        F.explode(F.array(
            F.struct(F.col("start").alias("t"), F.lit(1).alias("step")),
            F.struct(F.col("end").alias("t"), F.lit(-1).alias("step")),
        )).alias("e"),
    ).select("*", "e.*").drop("e")
    # Ends come before starts of the same instant.
    order = ["t", "step", "source_id", "pos"]
    per_service = running_in_ranges(edges, ["tenant_id", "service_name"], order, {"depth": ("sum", F.col("step"))})
    change = (
        F.when((F.col("step") == 1) & (F.col("depth") == 1), 1)
        .when((F.col("step") == -1) & (F.col("depth") == 0), -1).otherwise(0)
    )
    per_tenant = running_in_ranges(
        per_service.withColumn("change", change), ["tenant_id"], order, {"services": ("sum", F.col("change"))})
    return per_tenant.filter("step = 1").select("tenant_id", "source_id", "pos", "detected_at", "services")


def cascades(
    spikes: DataFrame, params: DetectorParams, last_fired: DataFrame | None = None
) -> DataFrame:
    """Spikes that complete a cascade, with `contributing`: the earliest open spike of every service.

    `spikes` holds detections with `id`, `resolved_at` and `acked_at`; those of earlier runs
    (`pos` below zero) count but do not trigger.
    """
    crowded = open_services(spikes, params).filter(
        (F.col("services") >= params.cascade_min_services) & (F.col("pos") >= 0))
    counted = materialize(crowded, "crowds")
    fired = cooldown(counted, ["tenant_id"], "detected_at", params.cascade_window_s, last_fired)
    trigger = (
        counted.join(fired, ["tenant_id", "detected_at"])
        .groupBy("tenant_id", "detected_at")
        .agg(F.min(F.struct("source_id", "pos", "services")).alias("s"))
        .select("tenant_id", "detected_at", "s.*")
    )
    trigger = trigger.join(cascade_members(trigger, spikes, params), ["tenant_id", "detected_at"])
    least = float(params.cascade_min_services)
    bare = _bare(params)
    made = {
        "anomaly_type": F.lit(CASCADE), "severity": F.lit("CRITICAL"),
        "current_value": F.col("services").cast("double"), "baseline_value": F.lit(least - 1),
        "upper_bound": F.lit(least), "unit": F.lit("services_spiking"), **bare,
    }
    # The trigger is a spike of this run: its state is the state of that moment.
    facts = spikes.drop("detected_at", "contributing").join(trigger, [*KEYS, "pos"])
    return facts.select(*[made[c].alias(c) if c in made else F.col(c) for c in DETECTION])


def cascade_members(trigger: DataFrame, spikes: DataFrame, params: DetectorParams) -> DataFrame:
    """The open spikes behind each fired cascade, by time bucket.

    Cascades of a tenant are at least one window apart, so a spike belongs to at
    most two and the join stays linear.
    """
    width = params.cascade_window_s
    bucket = lambda ts: F.floor(F.unix_seconds(ts) / F.lit(width))
    fired = trigger.select(
        "tenant_id", F.col("detected_at").alias("fired_at"), F.col("source_id").alias("by_source"),
        bucket(F.col("detected_at")).alias("bucket"),
    )
    near = spikes.select(
        "tenant_id", "service_name", "source_id", "detected_at", F.least("resolved_at", "acked_at").alias("closed_at"), "id",
        F.explode(F.array(bucket(F.col("detected_at")), bucket(F.col("detected_at")) + 1)).alias("bucket"),
    )
    at, fired_at = F.col("detected_at"), F.col("fired_at")
    age = _seconds(fired_at, at)
    seen = ((age > 0) | ((age == 0) & (F.col("source_id") <= F.col("by_source"))))
    still_open = F.col("closed_at").isNull() | (F.col("closed_at") > fired_at) | (age == 0)
    return (
        near.join(fired, ["tenant_id", "bucket"])
        .filter(seen & (age <= width) & still_open)
        .groupBy("tenant_id", "fired_at", "service_name")
        .agg(F.min(F.struct("detected_at", "source_id", "id")).alias("first"))
        .groupBy("tenant_id", F.col("fired_at").alias("detected_at"))
        .agg(F.sort_array(F.collect_list(
            F.struct("service_name", F.col("first.id").alias("alert_id"))
        )).alias("contributing"))
    )
