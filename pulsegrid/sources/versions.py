"""Date-partitioned tables with versions: a version is a list of folders, and changes when its list is swapped.

A write puts its files in folders of its own, `data/part_date=<date>/w=<write>`, and then adds the next list under
`versions`. Nothing is overwritten: what an interrupted write left is in no list, readers of an older version keep their
files, and of two writers that start from one version the second fails and may try again. `vacuum` removes what the
newest versions do not name.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.session import materialize
from pulsegrid.sources.tables import DATE

Folders = dict[str, list[str]]  # date -> the writes that hold rows of it


class Conflict(RuntimeError):
    """Another writer made the next version first."""


class VersionedTable:
    """`at` names the timestamp that dates a row; rows without one are dated 1970-01-01."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, at: str) -> None:
        self.spark, self.path, self.schema, self.at = spark, path, schema, at

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder, files = self._file("versions")
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def folders(self, version: int | None = None) -> Folders:
        """What a version consists of; the newest if none is named."""
        known = self.versions()
        if not known:
            return {}
        path, files = self._file(f"versions/{known[-1] if version is None else version}.json")
        stream = files.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def read(self, version: int | None = None, since: dt.date | None = None, before: dt.date | None = None) -> DataFrame:
        """The rows with `part_date`; only folders of dates from `since` on and before `before` are listed and read."""
        chosen = [
            f"{self.path}/data/{DATE}={date}/w={w}" for date, writes in self.folders(version).items() for w in writes
            if (since is None or date >= since.isoformat()) and (before is None or date < before.isoformat())]
        whole = T.StructType([*self.schema.fields, T.StructField(DATE, T.DateType()), T.StructField("w", T.StringType())])
        if not chosen:
            return self.spark.createDataFrame([], whole).drop("w")
        rows = self.spark.read.schema(whole).option("basePath", f"{self.path}/data").parquet(*chosen).drop("w")
        # Named in the plan too, so that it shows what is read.
        bounds = [F.col(DATE) >= F.lit(since)] * (since is not None) + [F.col(DATE) < F.lit(before)] * (before is not None)
        for bound in bounds:
            rows = rows.filter(bound)
        return rows

    def _put(self, rows: DataFrame) -> Folders:
        """Write rows as folders that no version names yet."""
        write = uuid.uuid4().hex
        dated = rows.select(*self.schema.names).withColumn(DATE, F.coalesce(F.to_date(self.at), F.lit(dt.date(1970, 1, 1))))
        dated.withColumn("w", F.lit(write)).write.mode("append").partitionBy(DATE, "w").parquet(f"{self.path}/data")
        pattern, files = self._file(f"data/{DATE}=*/w={write}")
        found = [s.getPath().getParent().getName().removeprefix(f"{DATE}=") for s in files.globStatus(pattern) or []]
        return {date: [write] for date in found}

    def commit(self, folders: Folders, after: int) -> int:
        """Make `folders` the version after `after`, in one step: the list is written aside and then named."""
        done = {date: writes for date, writes in sorted(folders.items()) if writes}
        aside, files = self._file(f"versions/.{uuid.uuid4().hex}")
        stream = files.create(aside)
        stream.write(bytearray(json.dumps(done).encode()))
        stream.close()
        path, _ = self._file(f"versions/{after + 1}.json")
        if files.exists(path) or not files.rename(aside, path):
            files.delete(aside, False)
            raise Conflict(f"{self.path} has a version {after + 1} already")
        return after + 1

    def _newest(self) -> int:
        known = self.versions()
        return known[-1] if known else 0

    def append(self, rows: DataFrame) -> int:
        """Add rows; returns the version that has them."""
        after, folders = self._newest(), self.folders()
        for date, writes in self._put(rows).items():
            folders[date] = folders.get(date, []) + writes
        return self.commit(folders, after)

    def append_new(self, rows: DataFrame, key: str = "id") -> int:
        """Add rows whose key is not stored yet, so that a replay adds nothing. Only the dates that come are read:
        ids derive from the row's own time, so the same row always falls on the same date."""
        came = materialize(rows.select(*self.schema.names).dropDuplicates([key]), "incoming", self.spark)
        span = came.agg(F.min(F.to_date(self.at)).alias("low"), F.max(F.to_date(self.at)).alias("high")).collect()[0]
        if span.low is not None:
            stored = self.read(since=span.low, before=span.high + dt.timedelta(days=1)).select(key)
            came = came.join(stored, key, "left_anti")
        return self.append(came)

    def expire(self, mark: Callable[[DataFrame], DataFrame], before: dt.date) -> tuple[int, int]:
        """Remove the rows that `mark` gives a true `expired`, all of them dated before `before`.

        Later dates are not read. A date whose rows all go leaves the list, one with some is written anew without them,
        others stay as they are. Returns the version and how many rows went.
        """
        after, folders = self._newest(), self.folders()
        marked = materialize(mark(self.read(before=before)).select(*self.schema.names, DATE, "expired"), "marked", self.spark)
        per_date = marked.groupBy(DATE).agg(F.count_if("expired").alias("gone"), F.count(F.lit(1)).alias("n"))
        touched = {r[DATE].isoformat(): r for r in per_date.filter("gone > 0").collect()}  # one row per calendar day
        if not touched:
            return after, 0
        partly = [r[DATE] for r in touched.values() if r["gone"] < r["n"]]
        kept = self._put(marked.filter(F.col(DATE).isin(partly) & ~F.col("expired"))) if partly else {}
        for date in touched:
            folders[date] = kept.get(date, [])
        return self.commit(folders, after), sum(r["gone"] for r in touched.values())

    def compact(self, most: int = 8) -> int:
        """Write dates that many writes hold rows of as one folder each."""
        after, folders = self._newest(), self.folders()
        many = {date for date, writes in folders.items() if len(writes) > most}
        if not many:
            return after
        rows = self.read().filter(F.col(DATE).isin([dt.date.fromisoformat(d) for d in many]))
        return self.commit(folders | self._put(rows.repartition(DATE)), after)

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the newest versions, and the folders that none of those names."""
        known = self.versions()
        named = {(date, w) for v in known[-keep:] for date, writes in self.folders(v).items() for w in writes}
        for old in known[:-keep]:
            path, files = self._file(f"versions/{old}.json")
            files.delete(path, False)
        pattern, files = self._file(f"data/{DATE}=*/w=*")
        for status in files.globStatus(pattern) or []:
            folder = status.getPath()
            where = folder.getParent().getName().removeprefix(f"{DATE}="), folder.getName().removeprefix("w=")
            if where not in named:
                files.delete(folder, True)
