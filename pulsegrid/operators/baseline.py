"""Exponentially weighted baselines over each source's observations.

The mean is m = a*x + (1-a)*m and the variance the same over squared innovations, each row rounded as this recurrence
rounds it: a steady rate and its mean differ by less than any rounding of a rearranged sum, and detectors compare them
as they are. So rows are walked in order, in two passes. The first reads the bare numbers of a source as a stream and
notes the state at the start of every time cell. The second walks all cells at the same time, each from its start, and
has the whole rows. Neither holds more than one row and one state.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators.observe import KEYS
from pulsegrid.operators.ordered import time_cell
from pulsegrid.params import DetectorParams

# What a source's state starts from: name -> (type, value of a source that was never seen).
_NEVER = {
    "ewma_value": ("double", 0.0), "ewma_variance": ("double", 0.0), "warmup_count": ("int", 0),
    "log_volume_ewma": ("double", 0.0), "last_log_at": ("timestamp", None), "last_detected_at": ("timestamp", None),
    "last_error_rate": ("double", None), "last_ewma_value": ("double", None), "last_ewma_variance": ("double", None),
    "up_since": ("timestamp", None), "latency_ewma": ("double", 0.0), "latency_variance": ("double", 0.0),
    "latency_warmup": ("int", 0), "last_latency": ("double", None), "last_latency_ewma": ("double", None),
    "last_latency_variance": ("double", None), "last_latency_warm": ("bigint", None),
}


def upper_bound(mean: Column, variance: Column, k: Column | float) -> Column:
    return mean + (k if isinstance(k, Column) else F.lit(k)) * F.sqrt(variance)


def with_settings(obs: DataFrame, params: DetectorParams, state: DataFrame | None = None) -> DataFrame:
    """Join each source's stored smoothing state and settings, or the defaults."""
    start = _NEVER | {
        "alpha": ("double", params.alpha), "sensitivity": ("double", params.sensitivity),
        "warmup_required": ("int", params.warmup_required), "warn_k": ("double", params.warn_k),
        "crit_k": ("double", params.crit_k),
    }
    known = set(state.columns) if state is not None else set()
    if state is not None:
        obs = obs.join(state.select(*KEYS, *[c for c in start if c in known]), KEYS, "left")
    given = lambda name, default: F.coalesce(F.col(name), default) if name in known else default
    return obs.withColumns({name: given(name, F.lit(value).cast(kind)) for name, (kind, value) in start.items()})


@dataclass(frozen=True)
class Walk:
    """A sequence to smooth: its value, the names of its results, and the columns that it starts from.

    `seeds` are the mean, the variance, the mean and the variance before the last row, and the last row's value.
    `kept` maps a name to (column, seed): the previous row's value of a bigint column. `volume` is a second value,
    with its name and seed, of which only the mean is kept.
    """

    value: str
    mean: str
    variance: str
    position: str
    seeds: tuple[str, str, str, str, str]
    kept: dict[str, tuple[Column, Column]]
    volume: tuple[str, str, str] | None = None
    names: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        m, v = self.mean, self.variance
        names = [f"prev_{m}", f"prev_{v}", f"before_{m}", f"before_{v}", f"prev_{self.value}"]
        object.__setattr__(self, "names", (*names, f"prev_{self.volume[1]}" if self.volume else "_none"))


def _step(state: tuple, a: float, x: float, n: float) -> tuple:
    """(mean, variance, mean and variance before, value, volume) after a row."""
    mean, variance, _, _, _, volume = state
    d = x - mean
    return a * x + (1.0 - a) * mean, a * (d * d) + (1.0 - a) * variance, mean, variance, x, a * n + (1.0 - a) * volume


_START = "_from array<double>, _kept array<bigint>"


def _cell_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before the first row of every cell, of rows in order."""
    key = cell = state = kept = None
    for batch in batches:
        out = []
        for tenant, source, at, a, x, n, keeps, seed, first in zip(*(c.to_pylist() for c in batch.columns)):
            if (tenant, source) != key:
                key, cell, state, kept = (tenant, source), None, tuple(seed), first
            if at != cell:
                cell = at
                out.append((tenant, source, at, state, kept))
            state, kept = _step(state, a, x, n), [kept[0] + 1, *keeps]
        made = list(zip(*out)) or [[]] * 5
        types = [batch.schema.field(k).type for k in range(3)] + [pa.list_(pa.float64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(made, types)], names=[*KEYS, "_cell", "_from", "_kept"])


def walked(rows: DataFrame, cell: Column, order: list[str], walk: Walk) -> DataFrame:
    """Add the walk's position, its mean and variance after every row and the state before it.

    `cell` must not decrease along `order`. `rows` is read twice. The state before a row is prev_<mean>,
    prev_<variance>, the same before the previous row (before_...), the previous row's value and its kept columns;
    null where there is none.
    """
    volume = walk.volume or ("_none", "_none", "_none")
    rows = rows.withColumns({
        "_cell": cell, "_a": F.col("alpha"), "_x": F.col(walk.value).cast("double"),
        "_n": F.col(volume[0]).cast("double") if walk.volume else F.lit(0.0),
        "_keeps": F.array(*[c.cast("bigint") for c, _ in walk.kept.values()]),
    })
    seeds = [*(F.col(c).cast("double") for c in walk.seeds), F.col(volume[2]) if walk.volume else F.lit(0.0)]
    firsts = [F.lit(0).cast("bigint"), *(c.cast("bigint") for _, c in walk.kept.values())]
    helpers = ["_cell", "_a", "_x", "_n", "_keeps"]
    bare = rows.select(*KEYS, *helpers, *order, F.array(*seeds).alias("_from"), F.array(*firsts).alias("_kept"))
    bare = bare.repartition(*KEYS).sortWithinPartitions(*KEYS, *order).select(*KEYS, *helpers, "_from", "_kept")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*KEYS, "_cell").schema)
    starts = bare.mapInArrow(_cell_starts, f"{kinds}, {_START}")

    kept_columns = [c for c in rows.columns if c not in helpers]
    doubles = [walk.mean, walk.variance, *walk.names[:5], *([volume[1], walk.names[5]] if walk.volume else [])]
    longs = [walk.position, *walk.kept]
    schema = T.StructType([
        *(rows.schema[c] for c in kept_columns), *(T.StructField(c, T.DoubleType()) for c in doubles),
        *(T.StructField(c, T.LongType()) for c in longs)])
    both = rows.unionByName(starts, allowMissingColumns=True).repartition(*KEYS, "_cell").sortWithinPartitions(
        *KEYS, "_cell", *order)  # the start has no place in the order and comes first
    both = both.select(*helpers, "_from", "_kept", *kept_columns)
    has_volume = walk.volume is not None

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = kept = None
        for batch in batches:
            real, numbers, places = [], [], []
            lead = (batch.column(k).to_pylist() for k in range(1, 7))
            for a, x, n, keeps, start, first in zip(*lead):
                real.append(start is None)
                if start is not None:
                    state, kept = tuple(start), first
                    continue
                before, (m, v, *_, volume) = state, (state := _step(state, a, x, n))
                numbers.append((m, v, *before[:5], *((volume, before[5]) if has_volume else ())))
                places.append(kept)
                kept = [kept[0] + 1, *keeps]
            rest = pa.Table.from_batches([batch.select(range(7, batch.num_columns))]).filter(pa.array(real))
            made = list(zip(*numbers)) or [[]] * len(doubles)
            whole = list(zip(*places)) or [[]] * len(longs)
            for name, values in zip(doubles, made):
                rest = rest.append_column(name, pa.array(values, pa.float64()))
            for name, values in zip(longs, whole):
                rest = rest.append_column(name, pa.array(values, pa.int64()))
            yield from rest.to_batches()

    return both.mapInArrow(within, schema)


def _spikes(x: str, mean: str, var: str, ready: Column, was_ready: Column) -> dict[str, Column]:
    """Marks of a row against the previous baseline; `pops` marks a clean row after a clean row."""
    before = lambda k: upper_bound(F.col(f"prev_{mean}"), F.col(f"prev_{var}"), F.col(k))
    spike = ready & (F.col(x) > before("warn_k"))
    was_spike = F.col(f"prev_{x}") > upper_bound(F.col(f"before_{mean}"), F.col(f"before_{var}"), F.col("warn_k"))
    return {
        "ready": ready, "bound": before("warn_k"), "is_spike": spike, "is_critical": F.col(x) > before("crit_k"),
        "is_clean": ready & ~spike, "pops": ready & ~spike & F.coalesce(was_ready & ~was_spike, F.lit(False)),
    }


def error_baseline(obs: DataFrame, params: DetectorParams, state: DataFrame | None = None) -> DataFrame:
    """Error-rate and volume baselines with the row-local facts all detectors need.

    Adds `pos`, mean `m`, variance `v`, `vol`, their previous values, the warm-up count, `ready` (warm), spike marks,
    `is_up` (above the new mean), `starts_up` (and the row before was not) and the previous row's times. `state` may
    hold what an earlier run left, the last row's facts included. `obs` is read twice: pass a written table or its
    cheap aggregate.
    """
    micros = lambda c: F.unix_micros(c)
    rows = walked(with_settings(obs, params, state), time_cell(F.col("detected_at"), params.cell_s), ["detected_at", "unit"], Walk(
        "error_rate", "m", "v", "pos",
        ("ewma_value", "ewma_variance", "last_ewma_value", "last_ewma_variance", "last_error_rate"),
        {"prev_max_ts": (micros("max_ts"), micros("last_log_at")),
         "prev_detected_at": (micros("detected_at"), micros("last_detected_at"))},
        ("n", "vol", "log_volume_ewma")))
    rows = rows.withColumns({
        **{c: F.timestamp_micros(c) for c in ("prev_max_ts", "prev_detected_at")},
        "warm": F.col("warmup_count") + F.col("pos") + 1,
    })
    ready, was_ready = F.col("warm") >= F.col("warmup_required"), F.col("warm") - 1 >= F.col("warmup_required")
    was_up = F.coalesce(was_ready & (F.col("prev_error_rate") > F.col("prev_m")), F.lit(False))
    return rows.withColumns({
        **_spikes("error_rate", "m", "v", ready, was_ready), "is_up": ready & (F.col("error_rate") > F.col("m")),
    }).withColumn("starts_up", F.col("is_up") & ~was_up).drop(
        "ewma_value", "ewma_variance", "warmup_count", "log_volume_ewma", "last_log_at", "last_detected_at",
        "last_error_rate", "last_ewma_value", "last_ewma_variance", "prev_error_rate", "before_m", "before_v",
    )


_LATENCY_STATE = ["latency_ewma", "latency_variance", "last_latency_ewma", "last_latency_variance", "last_latency"]


def latency_baseline(base: DataFrame, params: DetectorParams) -> DataFrame:
    """Latency baselines over the observations that carry a latency.

    They form their own sequence with their own warm-up; a row inside either warm-up changes no counter. `base` is
    read twice.
    """
    keep = [*KEYS, "unit", "pos", "detected_at", "n", "lat_mean", "min_ts", "max_ts", "service_name",
            "environment", "m", "v", "warm", "alpha", "sensitivity", "warmup_required", "warn_k", "crit_k",
            "latency_warmup", "last_latency_warm", *_LATENCY_STATE]
    rows = walked(
        base.filter("n_lat > 0").select(*keep), time_cell(F.col("detected_at"), params.cell_s), ["pos"], Walk(
            "lat_mean", "lm", "lv", "lat_pos", tuple(_LATENCY_STATE),
            {"prev_warm": (F.col("warm"), F.col("last_latency_warm"))}))
    rows = rows.withColumn("lat_warm", F.col("latency_warmup") + F.col("lat_pos") + 1)
    need = F.col("warmup_required")
    ready = (F.col("warm") >= need) & (F.col("lat_warm") >= need)
    was_ready = (F.col("prev_warm") >= need) & (F.col("lat_warm") - 1 >= need)
    return rows.withColumns(_spikes("lat_mean", "lm", "lv", ready, was_ready)).drop(
        "prev_warm", "prev_lat_mean", "before_lm", "before_lv", "last_latency_warm", *_LATENCY_STATE)


def next_state(base: DataFrame, latency: DataFrame | None = None) -> DataFrame:
    """State after the last observation of each source, to seed the next run.

    It holds the last row's facts too, so that counts of clean rows and the start of an elevation go on. Sources
    without a row in this run keep the state that they had: see `carried_state`. Stored error patterns are a table of
    their own (`detectors.next_patterns`): they are too many for one row per source.
    """

    def last(df: DataFrame, pos: str) -> DataFrame:
        return df.join(df.groupBy(*KEYS).agg(F.max(pos).alias(pos)), [*KEYS, pos])

    began = base.groupBy(*KEYS).agg(F.max(F.when(F.col("starts_up"), F.col("detected_at"))).alias("_began"))
    out = last(base, "pos").join(began, KEYS).select(
        *KEYS, F.col("m").alias("ewma_value"), F.col("v").alias("ewma_variance"), "alpha", "sensitivity",
        F.col("warm").cast("int").alias("warmup_count"), "warmup_required",
        F.col("vol").alias("log_volume_ewma"), F.col("max_ts").alias("last_log_at"),
        F.col("detected_at").alias("last_detected_at"), F.col("error_rate").alias("last_error_rate"),
        F.col("prev_m").alias("last_ewma_value"), F.col("prev_v").alias("last_ewma_variance"),
        F.when(F.col("is_up"), F.coalesce("_began", "up_since")).alias("up_since"),
    )
    if latency is None:
        return out
    # A source without a latency in this run keeps its latency state.
    held = last(base, "pos").select(*KEYS, "latency_warmup", "last_latency_warm", *_LATENCY_STATE)
    fresh = last(latency, "lat_pos").select(
        *KEYS, F.col("lm").alias("latency_ewma"), F.col("lv").alias("latency_variance"),
        F.col("lat_warm").cast("int").alias("latency_warmup"), F.col("lat_mean").alias("last_latency"),
        F.col("prev_lm").alias("last_latency_ewma"), F.col("prev_lv").alias("last_latency_variance"),
        F.col("warm").alias("last_latency_warm"))
    names = ["latency_warmup", "last_latency_warm", *_LATENCY_STATE]
    marked = fresh.withColumnsRenamed({c: f"_{c}" for c in names}).withColumn("_fresh", F.lit(True))
    either = held.join(marked, KEYS, "left").select(
        *KEYS, *[F.when(F.col("_fresh"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in names])
    return out.join(either, KEYS)


def carried_state(state: DataFrame, before: DataFrame | None) -> DataFrame:
    """The state of all sources: of those with new rows `state`, of the others what was stored `before`."""
    if before is None:
        return state
    return state.unionByName(before.join(state, KEYS, "left_anti"), allowMissingColumns=True)


def fixed_settings(config: DataFrame, sources: DataFrame, names: dict[str, str]) -> DataFrame:
    """Detector settings per source from a key/value table.

    A tenant's row overrides the row without tenant. `names` maps config keys to
    setting columns, e.g. {"detector.alpha": "alpha"}.
    """
    rows = config.filter(F.col("key").isin(*names))

    def value_of(key: str) -> Column:
        return F.max(F.when(F.col("key") == key, F.col("value").try_cast("double")))

    own = rows.filter("tenant_id is not null").groupBy("tenant_id").agg(
        *[value_of(k).alias(c) for k, c in names.items()]
    )
    platform = rows.filter("tenant_id is null")
    return (
        sources.select("tenant_id", F.col("id").alias("source_id")).join(own, "tenant_id", "left")
        .select(*KEYS, *[
            F.coalesce(F.col(c), platform.agg(value_of(k)).scalar()).alias(c) for k, c in names.items()
        ])
    )
