"""Small helpers of the operators in this folder."""

from __future__ import annotations

import gc
import sys
import uuid
from collections.abc import Iterator
from types import ModuleType

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.session import materialize, scratch_dir

# The characters that separate words.
WHITESPACE = " \t\n\x0b\x0c\r"
WORD_GAP = "[\\x20\\x09-\\x0D]+"

# Python tasks work texts in groups of about so many characters: memory follows neither rows nor the mean length.
GROUP_CHARS = 2_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str) -> Column:
    """The text of a column of any type; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than the six separators, as an array."""
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def no_space(text: Column) -> Column:
    return F.translate(text, WHITESPACE, "")


def grouped(values: list, size=len) -> Iterator[list]:
    """Consecutive values in lists of about GROUP_CHARS characters; one long text is a list of its own."""
    group, held = [], 0
    for v in values:
        if group and held + size(v) > GROUP_CHARS:
            yield group
            group, held = [], 0
        group.append(v)
        held += size(v)
    if group:
        yield group


def in_order(df: DataFrame, order: list[Column], value: Column, start: str) -> DataFrame:
    """`df` sorted over partitions, written, with `shard` (its partition) and `start` (sum of `value` before the row).

    Ranges are sorted apart; only one sum per range is brought together, so no key and no group is one task's work.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("__value", value).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = materialize(ranged.select("*", F.spark_partition_id().alias("shard"), F.monotonically_increasing_id().alias("__row")), "ordered")
    within = Window.partitionBy("shard").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("shard").agg(F.sum("__value").alias("__sum"))
    offsets = offsets.select("shard", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    inside = ranged.withColumn(start, F.coalesce(F.sum("__value").over(within), F.lit(0)))
    return inside.join(F.broadcast(offsets), "shard").withColumn(start, F.col(start) + F.col("__offset")).drop(
        "__value", "__row", "__offset")  # one row per range: at most as many as shuffle partitions


class Tables:
    """Written tables of an iteration, under the shared folder of the session; those no longer read can go."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.count = spark, 0
        self.folder = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{name}-{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self):
        """Deletes the tables and lets Spark drop the shuffle files of finished plans."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        release(self.spark)


def kept_by_worker(key: tuple, make):
    """A value that a Python worker keeps from task to task, such as a loaded vocabulary. Functions of this folder are
    pickled by value, so their own globals last for one task."""
    state = sys.modules.setdefault("pulsegrid_worker_state", ModuleType("pulsegrid_worker_state")).__dict__
    if key not in state:
        state[key] = make()
    return state[key]


def release(spark: SparkSession):
    """Lets Spark delete the shuffle files of plans that nothing refers to any more, instead of at its next chance."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
