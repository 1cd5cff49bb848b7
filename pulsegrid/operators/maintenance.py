"""Maintenance windows: times in which a source may be silent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.detectors import SILENCE
from pulsegrid.operators.observe import KEYS
from pulsegrid.params import MICROS, DetectorParams

# Buckets of a level are twice as long as those of the level before; the first are a minute, the last over 60 years.
_LEVELS = 26


def _bucket(micros: Column, level: Column) -> Column:
    return F.floor(micros / (F.pow(F.lit(2.0), level) * F.lit(60 * MICROS))).cast("bigint")


def covers(windows: DataFrame) -> DataFrame:
    """`windows` (keys, starts_at, ends_at) with the buckets that cover each: at most two, of its length's level.

    A window without an end runs on; one that ends before it starts has no buckets. Windows longer than the longest
    bucket take as many of those as they need.
    """
    start = F.unix_micros("starts_at")
    end = F.coalesce(F.unix_micros("ends_at"), start + F.lit(60 * MICROS * 2 ** (_LEVELS - 1)))
    minutes = F.greatest((end - start) / F.lit(60 * MICROS), F.lit(1.0))
    level = F.least(F.ceil(F.log2(minutes)), F.lit(_LEVELS - 1)).cast("int")
    rows = windows.filter(F.col("ends_at").isNull() | (F.col("ends_at") > F.col("starts_at"))).withColumn("level", level)
    return rows.withColumn("bucket", F.explode(F.sequence(_bucket(start, F.col("level")), _bucket(end - 1, F.col("level")))))


def in_maintenance(rows: DataFrame, at: Column, windows: DataFrame, name: str = "maintained") -> DataFrame:
    """Add whether the instant `at` lies in a window of the row's source, its start included and its end not.

    An instant lies in one bucket of each level, a window in at most two of one level. So the join is by equal
    buckets, whatever the lengths of windows, and a row meets only windows near it that are as long as the level says.
    `rows` is read twice and keeps all its rows; windows may overlap.
    """
    points = rows.select(*KEYS, F.unix_micros(at).alias("_at")).distinct()
    cells = points.withColumn("level", F.explode(F.array(*map(F.lit, range(_LEVELS))))).withColumn(
        "bucket", _bucket(F.col("_at"), F.col("level")))
    cover = covers(windows).select(
        *KEYS, "level", "bucket", F.unix_micros("starts_at").alias("_start"), F.unix_micros("ends_at").alias("_end"))
    keys = [*KEYS, "level", "bucket"]
    same = [cells[k] == cover[k] for k in keys]
    inside = (F.col("_at") >= F.col("_start")) & (F.col("_end").isNull() | (F.col("_at") < F.col("_end")))
    found = cells.join(cover, [*same, inside], "left_semi").select(*KEYS, "_at").distinct().withColumn(name, F.lit(True))
    marked = rows.withColumn("_at", F.unix_micros(at)).join(found, [*KEYS, "_at"], "left")
    return marked.withColumn(name, F.coalesce(name, F.lit(False))).drop("_at")


def suppress_silences(detections: DataFrame, windows: DataFrame, params: DetectorParams) -> DataFrame:
    """Without the silences that fell due in a maintenance window of their source; all other rows stay.

    `detections` may be DETECTION or ALERT rows: a silence begins at `window_start`. A silence that outlasts its window
    was still due inside it and stays suppressed, as one that began before the window and fell due before it stays.
    """
    due = F.when(F.col("anomaly_type") == SILENCE, F.timestamp_micros(
        F.unix_micros("window_start") + F.lit(params.silence_s * MICROS)))
    return in_maintenance(detections, due, windows, "_maintained").filter("not _maintained").drop("_maintained")
