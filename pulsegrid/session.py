"""Session settings and the shared scratch area for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # A written table outlives its shuffle: the files go when the write ends, not when the driver collects garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on; safe to call repeatedly."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Folder shared by all executors, as named by spark.checkpoint.dir.

    A local session may leave it unset; a cluster session may not, because a
    machine-local folder would be lost together with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="pulsegrid-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, name: str, spark: SparkSession | None = None) -> DataFrame:
    """Write `df` once as parquet in the shared folder and read it back, by another session if one is given.

    Used where several branches read the same intermediate: it cuts the lineage,
    survives executor loss, and gives later joins exact sizes.
    """
    spark = spark or df.sparkSession
    path = f"{scratch_dir(spark)}/pulsegrid/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
