"""The batch pipeline: LOG_ENTRY rows to ALERT rows.

Intermediates that several branches read are written once in the shared folder
(`materialize`): the first-level aggregate, the baselines and the spike list.
Everything else stays one lazy plan, so a caller that needs one detector only
pays for that one.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import baseline, detectors, lifecycle, observe
from pulsegrid.operators.observe import KEYS
from pulsegrid.params import DetectorParams
from pulsegrid.session import materialize, prepare


class Detection:
    """Detector outputs over one set of entries, each computed when first asked for.

    A run resumes from what earlier ones left: `state` (EWMA_STATE), `patterns`
    (stored error patterns, see `next_patterns`), `open_alerts` that may resolve in
    this run, and `last_cascades` (tenant_id, last_at). `acks` are requests (tenant_id,
    alert_id, user_id, acked_at) that take alerts over while the run goes on.
    """

    def __init__(
        self,
        entries: DataFrame,
        params: DetectorParams,
        state: DataFrame | None = None,
        open_alerts: DataFrame | None = None,
        last_cascades: DataFrame | None = None,
        patterns: DataFrame | None = None,
        acks: DataFrame | None = None,
    ) -> None:
        prepare(entries.sparkSession)
        self.entries, self.params, self.state = entries, params, state
        self.open_alerts, self.last_cascades, self.acks = open_alerts, last_cascades, acks
        if patterns is None and state is not None and "error_fingerprints" in state.columns:
            patterns = detectors.stored_patterns(state)
        self.patterns = patterns

    @cached_property
    def fine(self) -> DataFrame:
        return materialize(observe.fine_observations(self.entries, self.params), "fine")

    def first_entries(self) -> DataFrame:
        return observe.first_entries(self.entries, self.novel, self.params)

    def messages(self, judged: DataFrame) -> DataFrame:
        return observe.representative_messages(self.entries, judged, self.params)

    @cached_property
    def observations(self) -> DataFrame:
        return observe.observations(self.fine, self.params)

    @cached_property
    def base(self) -> DataFrame:
        return materialize(baseline.error_baseline(self.observations, self.params, self.state), "base")

    @cached_property
    def latency(self) -> DataFrame:
        return materialize(baseline.latency_baseline(self.base, self.params), "latency")

    @cached_property
    def next_state(self) -> DataFrame:
        return baseline.carried_state(baseline.next_state(self.base, self.latency), self.state)

    # -- detectors

    @cached_property
    def spikes(self) -> DataFrame:
        return detectors.error_rate_spikes(self.base)

    @cached_property
    def latency_spikes(self) -> DataFrame:
        return detectors.latency_spikes(self.latency)

    @cached_property
    def silences(self) -> DataFrame:
        return detectors.service_silences(self.base, self.params)

    @cached_property
    def sustained(self) -> DataFrame:
        return materialize(detectors.sustained_elevations(self.base, self.params), "sustained")

    @cached_property
    def novel(self) -> DataFrame:
        patterns = observe.error_patterns(self.fine, self.params)
        return materialize(detectors.novel_patterns(patterns, self.base, self.params, self.patterns), "novel")

    @cached_property
    def novel_errors(self) -> DataFrame:
        return detectors.novel_errors(self.novel, self.first_entries(), self.base)

    @cached_property
    def next_patterns(self) -> DataFrame:
        return detectors.next_patterns(self.novel, self.base, self.params, self.patterns)

    # -- resolution and cascade

    @cached_property
    def placed(self) -> DataFrame | None:
        """The earlier open alerts at their places below this run's."""
        if self.open_alerts is None:
            return None
        return materialize(detectors.placed_open_alerts(self.open_alerts), "placed")

    @cached_property
    def acked(self) -> DataFrame | None:
        """When each alert that rows could resolve was first asked for."""
        if self.acks is None:
            return None
        new = self.spikes.unionByName(self.latency_spikes).unionByName(self.sustained).withColumn("id", lifecycle.alert_id())
        cols = [*KEYS, "anomaly_type", "pos", "id"]
        alerts = new.select(*cols)
        if self.placed is not None:
            alerts = alerts.unionByName(self.placed.select(*cols))
        return materialize(detectors.requested(alerts, self.acks), "acked")

    @cached_property
    def resolutions(self) -> DataFrame:
        ops = materialize(detectors.resolution_ops(self.base, self.latency, self.sustained), "ops")
        return materialize(detectors.resolutions(ops, self.open_alerts, self.acked), "resolutions")

    @cached_property
    def resolved_spikes(self) -> DataFrame:
        """Error-rate spikes with id, resolution and request, those still open from earlier runs included."""
        spikes = lifecycle.attach_resolution(self.spikes, self.resolutions).withColumn("id", lifecycle.alert_id())
        if self.placed is not None:
            earlier = self.placed.filter(F.col("anomaly_type") == detectors.SPIKE).drop("resolved_at")
            cols = [*KEYS, "anomaly_type", "service_name", "pos", "detected_at", "resolved_at", "id"]
            spikes = spikes.unionByName(
                lifecycle.attach_resolution(earlier, self.resolutions).select(*cols), allowMissingColumns=True)
        if self.acked is None:
            spikes = spikes.withColumn("acked_at", F.lit(None).cast("timestamp"))
        else:
            spikes = spikes.join(self.acked, [*KEYS, "anomaly_type", "pos"], "left")
        return materialize(spikes, "spikes")

    @cached_property
    def cascades(self) -> DataFrame:
        return detectors.cascades(self.resolved_spikes, self.params, self.last_cascades)

    # -- alerts

    @cached_property
    def detections(self) -> DataFrame:
        parts = [self.silences, self.spikes, self.cascades, self.sustained, self.latency_spikes, self.novel_errors]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return materialize(out.withColumn("id", lifecycle.alert_id()), "detections")

    @cached_property
    def alerts(self) -> DataFrame:
        """All alerts of this run in their final state."""
        rows = lifecycle.attach_resolution(self.detections, self.resolutions)
        judged = self.detections.filter("sample_count > 0 and fp is null").select(
            *KEYS, F.col("unit_id").alias("unit"))
        alerts = lifecycle.build_alerts(lifecycle.attach_evidence(rows, self.messages(judged)), self.params.cascade_window_s)
        return alerts if self.acks is None else lifecycle.apply_acks(alerts, self.acks)

    @cached_property
    def closed_earlier(self) -> DataFrame:
        """Of the alerts passed in, `id` and `resolved_at` of those this run resolved."""
        found = self.placed.select("id", *KEYS, "anomaly_type", "pos").join(
            self.resolutions.filter("pos < 0"), [*KEYS, "anomaly_type", "pos"])
        return found.select("id", "resolved_at")

    @cached_property
    def earlier_alerts(self) -> DataFrame:
        """The alerts passed in, with those this run resolved closed and those asked for acknowledged."""
        alerts = lifecycle.apply_resolutions(self.open_alerts, self.closed_earlier)
        return alerts if self.acks is None else lifecycle.apply_acks(alerts, self.acks)


class WindowDetection(Detection):
    """The same over rows of `observe.window_rows`, one per window, source, pattern, message and service."""

    @cached_property
    def fine(self) -> DataFrame:
        return materialize(observe.fine_of_windows(self.entries), "fine")

    def first_entries(self) -> DataFrame:
        return observe.first_entries_of_windows(self.entries, self.novel)

    def messages(self, judged: DataFrame) -> DataFrame:
        errors = self.entries.filter("fp is not null")
        return observe.first_messages(errors.select(*KEYS, "unit", "message", F.col("first_seq").alias("seq")), judged)
