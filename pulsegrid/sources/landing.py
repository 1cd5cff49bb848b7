"""Pushed batches from a landing folder of JSON files, one batch per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.schemas import PUSHED_BATCH


def pushed_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(PUSHED_BATCH).option("maxFilesPerTrigger", max_files).json(path)


def pushed_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PUSHED_BATCH).json(path)


def line_files(spark: SparkSession, path: str, wholetext: bool = False) -> DataFrame:
    """Complete log files as lines; growing files are read by the `pulsegrid_tail` source."""
    lines = spark.read.option("wholetext", wholetext).text(path)
    return lines.select(F.col("value").alias("line"), F.input_file_name().alias("path"))
