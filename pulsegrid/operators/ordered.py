"""Ordered computations over one key that never put a whole key into one task.

Every function splits a key's timeline into bounded cells, works inside cells in
parallel, and combines one small row per cell in between.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.params import MICROS
from pulsegrid.session import materialize

BLOCK_ROWS = 4096

_UNBOUNDED = Window.unboundedPreceding


def time_cell(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(seconds))


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cell: Column, name: str = "pos"
) -> DataFrame:
    """Add each row's 0-based place in its key's order. `cell` must not decrease along `order`."""
    keys = list(keys)
    rows = df.withColumn("_cell", cell)
    starts = (
        rows.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *keys, "_cell",
            F.coalesce(
                F.sum("_n").over(Window.partitionBy(*keys).orderBy("_cell").rowsBetween(_UNBOUNDED, -1)),
                F.lit(0),
            ).alias("_start"),
        )
    )
    in_cell = Window.partitionBy(*keys, "_cell").orderBy(*order)
    return (
        rows.join(starts, [*keys, "_cell"])
        .withColumn(name, F.col("_start") + F.row_number().over(in_cell) - 1)
        .drop("_cell", "_start")
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    cell: Column,
    order: Sequence[str | Column],
    specs: Mapping[str, tuple[str, Column]],
) -> DataFrame:
    """Add running aggregates (current row included) per key.

    `specs` maps a new column to ("sum" | "max" | "min", expression). `df` is read
    twice, so it should be a written table or cheap to recompute.
    """
    keys = list(keys)
    agg = {"sum": F.sum, "max": F.max, "min": F.min}
    args = {f"_a_{name}": expr for name, (_, expr) in specs.items()}
    rows = df.withColumns({"_cell": cell, **args})
    totals = rows.groupBy(*keys, "_cell").agg(
        *[agg[how](f"_a_{name}").alias(f"_t_{name}") for name, (how, _) in specs.items()]
    )
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(_UNBOUNDED, -1)
    carried = totals.select(
        *keys, "_cell",
        *[agg[how](f"_t_{name}").over(before).alias(f"_c_{name}") for name, (how, _) in specs.items()],
    )
    upto = Window.partitionBy(*keys, "_cell").orderBy(*order).rowsBetween(_UNBOUNDED, 0)
    # greatest, least and the sum below all skip nulls, so a missing carry is neutral.
    joins = {
        "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
        "max": F.greatest,
        "min": F.least,
    }
    out = rows.withColumns({f"_r_{name}": agg[how](f"_a_{name}").over(upto) for name, (how, _) in specs.items()})
    out = out.join(carried, [*keys, "_cell"])
    return out.withColumns(
        {name: joins[how](F.col(f"_c_{name}"), F.col(f"_r_{name}")) for name, (how, _) in specs.items()}
    ).drop("_cell", *args, *[f"_{p}_{name}" for name in specs for p in "cr"])


def running_in_ranges(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], specs: Mapping[str, tuple[str, Column]]
) -> DataFrame:
    """`running` where no cell of time bounds a key's rows: cells are ranges of the rows in order, of about equal size.

    `df` is sorted over partitions by a sample of it and written once, so even rows of one instant are not one task's
    work.
    """
    sorted_ = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    rows = materialize(sorted_, "ranges")
    return running(rows, keys, F.col("_range"), order, specs).drop("_range")


def _leveled(ops: DataFrame, keys: list[str]) -> DataFrame:
    """Pushes and the pops that find something, each with the stack level it fills or empties.

    With S the running sum of op and M its running minimum, the depth is S - min(0, M); a pop at depth L undoes the
    latest push to depth L.
    """
    cell = F.floor(F.col("pos") / F.lit(BLOCK_ROWS))
    rows = ops.withColumn("_cell", cell)
    in_cell = Window.partitionBy(*keys, "_cell").orderBy("pos").rowsBetween(_UNBOUNDED, 0)
    local = rows.withColumn("_s", F.sum("op").over(in_cell)).withColumn("_m", F.min("_s").over(in_cell))
    ends = local.groupBy(*keys, "_cell").agg(F.sum("op").alias("_total"), F.min("_s").alias("_low"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(_UNBOUNDED, -1)
    carried = (
        ends.withColumn("_s0", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .withColumn("_m0", F.least(F.lit(0), F.coalesce(
            F.min(F.col("_s0") + F.col("_low")).over(before), F.lit(0))))
        .select(*keys, "_cell", "_s0", "_m0")
    )
    s, low = F.col("_s0") + F.col("_s"), F.least(F.col("_m0"), F.col("_s0") + F.col("_m"))
    return (
        local.withColumn("_pm", F.lag("_m").over(Window.partitionBy(*keys, "_cell").orderBy("pos")))
        .join(carried, [*keys, "_cell"])
        .withColumn("_S", s)
        .withColumn("_depth", F.col("_S") - low)
        .withColumn("_plow", F.least(F.col("_m0"), F.col("_s0") + F.coalesce("_pm", F.lit(0))))
        .filter((F.col("op") > 0) | (F.col("_S") >= F.col("_plow")))
        .withColumn("level", F.when(F.col("op") > 0, F.col("_depth")).otherwise(F.col("_depth") + 1))
        .select(*ops.columns, "level")
    )


def stack_matches(ops: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Match each pop to the newest unmatched push of its key (last in, first out).

    `ops` holds keys, `pos` (one row per place), `op` (+1 push, -1 pop) and `at`. A pop on an empty stack does
    nothing. Returns keys, `push_pos`, `pop_at`.
    """
    keys = list(keys)
    leveled = _leveled(ops.select(*keys, "pos", "op", "at"), keys)
    matched = running(
        leveled, [*keys, "level"], F.floor(F.col("pos") / F.lit(BLOCK_ROWS)), ["pos"],
        {"push_pos": ("max", F.when(F.col("op") > 0, F.col("pos")))}
    )
    return matched.filter("op < 0").select(*keys, "push_pos", F.col("at").alias("pop_at"))


def stack_matches_with_removals(ops: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`stack_matches` where a push may leave from the middle: from its `gone_at` on no pop finds it.

    Removals only empty a stack sooner. So wherever it would be empty without them it is empty, and the pops that
    find nothing without them find nothing. What lies between two such places is an episode of its own; episodes are
    walked at the same time, each with one stack.
    """
    keys = list(keys)
    leveled = _leveled(ops.select(*keys, "pos", "op", "at", "gone_at"), keys)
    cell = F.floor(F.col("pos") / F.lit(BLOCK_ROWS))
    opens = ((F.col("op") > 0) & (F.col("level") == 1)).cast("bigint")
    rows = running(leveled, keys, cell, ["pos"], {"episode": ("sum", opens)})
    rows = rows.repartition(*keys, "episode").sortWithinPartitions(*keys, "episode", "pos").select(
        *keys, "episode", "pos", "op", F.unix_micros("at").alias("at"), F.unix_micros("gone_at").alias("gone_at"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema]

    def walk(batches):
        episode, stack = None, []
        for batch in batches:
            matched = []
            columns = [c.to_pylist() for c in batch.columns]
            for row, (pos, op, at, gone_at) in zip(zip(*columns[:-4]), zip(*columns[-4:])):
                if row != episode:
                    episode, stack = row, []
                if op > 0:
                    stack.append((pos, gone_at))
                    continue
                while stack and stack[-1][1] is not None and stack[-1][1] <= at:
                    stack.pop()
                if stack:
                    matched.append((*row[:-1], stack.pop()[0], at))
            made = list(zip(*matched)) or [[]] * (len(keys) + 2)
            types = [batch.schema.field(k).type for k in range(len(keys))] + [pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(made, types)], names=[*keys, "push_pos", "pop_at"])

    found = rows.mapInArrow(walk, ", ".join([*kinds, "push_pos bigint, pop_at bigint"]))
    return found.withColumn("pop_at", F.timestamp_micros("pop_at"))


# -- greedy cooldown ---------------------------------------------------------


def _first_of_group(rows: pa.Table | pa.RecordBatch, n: int, before: pa.RecordBatch | None = None) -> np.ndarray:
    """Whether each row differs from the row above in one of its first `n` columns; `before` is the row above all."""
    batches = [*([] if before is None else [before]), *(rows.to_batches() if isinstance(rows, pa.Table) else [rows])]
    first = np.zeros(rows.num_rows, dtype=bool)
    first[:1] = before is None
    for k in range(n):
        codes = pa.concat_arrays([b.column(k) for b in batches]).dictionary_encode("encode").indices.to_numpy()
        first[len(first) - len(codes) + 1:] |= codes[1:] != codes[:-1]
    return first


def _whole_groups(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[pa.Table]:
    """Rows in the order of their first `n` columns as tables that cut no group of equal ones."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        first = _first_of_group(batch, n, held[-1].slice(held[-1].num_rows - 1) if held else None)
        if first.any():  # all but the batch's last group is whole
            cut = int(np.flatnonzero(first)[-1])
            if held or cut:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, batch = [], batch.slice(cut)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def cooldown(
    events: DataFrame,
    keys: Sequence[str],
    at: str,
    seconds: int,
    seed: DataFrame | None = None,
) -> DataFrame:
    """Keep an instant only if `seconds` have passed since the last one kept.

    Returns the distinct (keys, at) kept. `seed` may hold keys and `last_at`, the last instant kept earlier. The
    instants are written once. Which instant is kept next is a pointer, "the first instant at least so much later".
    Chunks of time follow their pointers by doubling and tell, for every instant that could be the first one kept
    there, the last one kept there; one pass over those few rows per key tells where each chunk really starts, and
    each chunk marks its instants on its own. Keys of all sizes go this way.
    """
    keys = list(keys)
    gap = seconds * MICROS
    instants = events.select(*keys, F.unix_micros(at).alias("t")).distinct()
    for c in (*keys, "t"):  # null keys equal none, and what has no time is no instant
        instants = instants.filter(F.col(c).isNotNull())
    if seed is not None:
        # What the seed still blocks can be left out at once.
        last = seed.select(*keys, F.unix_micros("last_at").alias("_last"))
        instants = instants.join(last, keys, "left").filter(
            F.col("_last").isNull() | (F.col("t") - F.col("_last") >= gap)).drop("_last")
    span = max(8 * gap, 86_400 * MICROS)
    rows = materialize(instants.withColumn("chunk", F.floor(F.col("t") / F.lit(span))), "instants")
    chunk = [*keys, "chunk"]
    ddl = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    in_order = lambda df, by, then: df.repartition(*by).sortWithinPartitions(*by, *then)

    def pieces(tables, most):
        for table in tables:
            cuts = [*np.flatnonzero(_first_of_group(table, len(chunk)))[::most].tolist(), table.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                yield table.slice(a, b - a)

    def exits(batches):
        """Of whole chunks, the instants that could be the first one kept (`upto`) and the last one kept then."""
        most = 2**62 // (span + gap)  # chunks that one line can take
        for table in pieces(_whole_groups(batches, len(chunk)), most):
            t, place = table["t"].to_numpy(), table["chunk"].to_numpy()
            first = _first_of_group(table, len(chunk))
            group = np.cumsum(first) - 1
            rel = t - place * span
            # One line for all chunks, with more than a gap between neighbours.
            line = rel + group * (span + gap)
            here = np.arange(len(t))
            after = np.searchsorted(line, line + gap)
            same = after < len(t)
            same[same] = group[after[same]] == group[same]
            last = np.where(same, after, here)
            while (further := last[last]).tobytes() != last.tobytes():
                last = further
            early = rel < gap
            starter = early | first | np.append(False, early[:-1])
            # Neighbouring starters mostly share an exit: keep the last of each run.
            shared = np.append(starter[1:] & ~first[1:] & (last[1:] == last[:-1]), False)
            pick = np.flatnonzero(starter & ~shared)
            out = table.select(chunk).take(pa.array(pick))
            out = out.append_column("upto", pa.array(t[pick])).append_column("leaves", pa.array(t[last[pick]]))
            yield from out.to_batches()

    def entries(batches):
        """Where each chunk starts: `need` is the earliest instant that could be kept there, null in a key's first."""
        above = need = None
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh, new_key = (_first_of_group(batch, n, above) for n in (len(chunk), len(keys)))
            above, out = batch.slice(batch.num_rows - 1), []
            for new, newer, upto, leaves in zip(
                    fresh.tolist(), new_key.tolist(), batch["upto"].to_pylist(), batch["leaves"].to_pylist()):
                if newer:
                    need = None
                if new:
                    out.append(need)
                    left = False
                if not left and (need is None or upto >= need):
                    need, left = leaves + gap, True
            begun = batch.select(chunk).filter(pa.array(fresh))
            yield pa.RecordBatch.from_arrays([*begun.columns, pa.array(out, pa.int64())], names=[*chunk, "need"])

    def marks(batches):
        """The instants kept; the row without an instant comes first in its chunk and says where the chunk starts."""
        due = None
        for batch in batches:
            kept = []
            for t, need in zip(batch["t"].to_pylist(), batch["need"].to_pylist()):
                if t is None:
                    due = need
                keep = t is not None and (due is None or t >= due)
                if keep:
                    due = t + gap
                kept.append(keep)
            yield batch.select([*keys, "t"]).filter(pa.array(kept, pa.bool_()))

    steps = in_order(rows.select(*chunk, "t"), chunk, ["t"]).mapInArrow(
        exits, f"{ddl(rows.select(*chunk))}, upto bigint, leaves bigint")
    starts = in_order(steps, keys, ["chunk", "upto"]).mapInArrow(entries, f"{ddl(rows.select(*chunk))}, need bigint")
    placed = rows.select(*chunk, "t").unionByName(starts, allowMissingColumns=True)
    kept = in_order(placed, chunk, ["t"]).mapInArrow(marks, f"{ddl(rows.select(*keys))}, t bigint")
    return kept.select(*keys, F.timestamp_micros("t").alias(at))
