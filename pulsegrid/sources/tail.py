"""Streaming source `pulsegrid_tail`: follow growing, rotating log files.

The offset names every file there is by its inode: {inode: [path, bytes, head, rotated]}. So a file that was renamed goes
on where it stood, whatever its name now, and a file that came and went to the side between two micro-batches is new.
`path` is the name the file was followed under, `bytes` the place after the last whole line, `head` its first bytes, which
tell a file from a later one that got the same inode or place. A micro-batch is what lies between two offsets and
nothing else, so a replay reads the same bytes. Each is a set of byte ranges that executors read on their own, so files
must be visible to all of them.
"""

from __future__ import annotations

import fnmatch
import glob
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SPLIT_BYTES = 64 * 1024 * 1024
_PROBE = 1024 * 1024


_HEAD = 48
# Copies that a rotation made of a file already read.
_PACKED = (".gz", ".bz2", ".xz", ".zst", ".zip", ".lz4")

Known = tuple[str, int, str, bool]  # path, bytes, head, rotated


@dataclass
class ByteRange(InputPartition):
    path: str
    name: str
    inode: int
    rotated: bool
    start: int
    end: int


def last_line_end(path: str, size: int, floor: int = 0) -> int:
    """The offset just after the last newline in the first `size` bytes, or `floor`."""
    with open(path, "rb") as f:
        end = size
        while end > floor:
            begin = max(floor, end - _PROBE)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return floor


def beside(path: str) -> list[str]:
    """Where rotations of a file go: names that go on after its own with a dot or a dash. `path` may be a pattern."""
    return [p for mark in ".-" for p in glob.glob(path + mark + "*") if not p.endswith(_PACKED)]


def first_name(path: str, pattern: str) -> str:
    """The name that a rotated file had, as far as its own name and the pattern tell."""
    cuts = [i for i, c in enumerate(path) if c in ".-"]
    return next((path[:i] for i in reversed(cuts) if fnmatch.fnmatch(path[:i], pattern)), path)


def on_disk(patterns: list[str], names: dict[int, str]) -> dict[int, tuple[str, str, int, bool, int]]:
    """Of every file that matches, or is a rotation of one that did: where, followed under, size, rotated, changed.

    `names` tells what files were followed under before; a rotated file keeps that name.
    """
    matches = {p for pattern in patterns for p in glob.glob(pattern)}
    aside = {p: first_name(p, pattern) for pattern in patterns for p in beside(pattern) if p not in matches}
    out = {}
    for path, under in [*((p, p) for p in sorted(matches)), *sorted(aside.items())]:
        try:
            stat = os.stat(path)
        except OSError:
            continue  # renamed or removed meanwhile: seen under its other name, or gone
        was = names.get(stat.st_ino)
        gone_on = was is not None and path != was and path.startswith((was + ".", was + "-"))
        rotated = path in aside or gone_on
        if stat.st_ino not in out:
            out[stat.st_ino] = path, was if gone_on else under, stat.st_size, rotated, stat.st_mtime_ns
    return out


def reach(path: str, size: int, floor: int, rotated: bool, followed_on: bool) -> tuple[int, str]:
    """How far a file can be read, and its head. A rotated file that a newer one follows is read to its last byte."""
    with open(path, "rb") as f:
        head = f.read(_HEAD).decode("latin-1")
    return (size if rotated and followed_on else last_line_end(path, size, min(floor, size))), head


def same(a: Known, b: Known) -> bool:
    """Whether two sightings of an inode are of one file: the later is not shorter, and one head goes on the other."""
    return b[1] >= a[1] and (a[2].startswith(b[2]) or b[2].startswith(a[2]))


def between(start: dict[str, Known], end: dict[str, Known], first: bool) -> list[tuple[int, str, int, int]]:
    """(inode, name, from, to) between two offsets. `first`: nothing was followed before, so rotated files are old."""
    out = []
    cut = [k for k, a in start.items() if k in end and not same(a, end[k])]
    for inode, to in end.items():
        if inode in start:
            begin = start[inode][1] if same(start[inode], to) else 0
        elif first and to[3]:
            continue
        else:
            # A file copied to the side and then cut down: what was read of it has been read of the copy.
            copied = [start[k] for k in cut if start[k][0] == to[0] and to[3] and start[k][2] and same(start[k], to)]
            begin = copied[0][1] if copied else 0
        if to[1] > begin:
            out.append((int(inode), to[0], begin, to[1]))
    # The older file first: of one name, those that were rotated.
    return sorted(out, key=lambda r: (r[1], not end[str(r[0])][3], r[0]))


def locate(inode: int, path: str) -> str:
    """Where the file is now."""
    for where in [path, *beside(glob.escape(path))]:
        if os.path.exists(where) and os.stat(where).st_ino == inode:
            return where
    raise FileNotFoundError(f"{path} (inode {inode}) was removed before it was read")


def split(path: str, name: str, inode: int, rotated: bool, start: int, end: int) -> list[ByteRange]:
    """Cut at line ends into pieces of about SPLIT_BYTES."""
    cuts = [start]
    while end - cuts[-1] > SPLIT_BYTES:
        cut = last_line_end(path, cuts[-1] + SPLIT_BYTES, cuts[-1])
        if cut == cuts[-1]:
            break
        cuts.append(cut)
    return [ByteRange(path, name, inode, rotated, a, b) for a, b in zip(cuts, [*cuts[1:], end]) if b > a]


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.patterns = options["path"].split(os.pathsep)
        stored = json.loads(options.get("startingOffsets", "{}"))
        self.initial = {str(inode): (path, offset, "", False) for path, (inode, offset) in stored.items() if inode}
        self.known = dict(self.initial)

    def initialOffset(self) -> dict:
        return {"files": self.initial, "first": True}

    def latestOffset(self) -> dict:
        names = {int(k): v[0] for k, v in self.known.items()}
        disk = on_disk(self.patterns, names)
        latest = {}  # of every name, when its newest file changed; one that is not rotated is the newest
        for _, under, _, rotated, changed in disk.values():
            latest[under] = max(latest.get(under, 0), changed if rotated else 1 << 63)
        out = {}
        for inode, (path, under, size, rotated, changed) in disk.items():
            floor = self.known.get(str(inode), ("", 0))[1]
            try:
                end, head = reach(path, size, floor if floor <= size else 0, rotated, changed < latest[under])
            except FileNotFoundError:
                continue
            out[str(inode)] = (under, end, head, rotated)
        self.known = out
        return {"files": out}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # After a restart the reader learns where it stands from the checkpoint.
        self.known = dict(end["files"])
        out = []
        for inode, name, begin, to in between(start["files"], end["files"], start.get("first", False)):
            out += split(self._where(inode, name), name, inode, end["files"][str(inode)][3], begin, to)
        return out

    def _where(self, inode: int, name: str) -> str:
        """A file may have been renamed since the offset was taken, to another match also."""
        now = on_disk(self.patterns, {inode: name}).get(inode)
        return now[0] if now else locate(inode, name)

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        path = partition.path
        if not os.path.exists(path) or os.stat(path).st_ino != partition.inode:
            path = locate(partition.inode, partition.name)
        with open(path, "rb") as f:
            f.seek(partition.start)
            offset = partition.start
            while offset < partition.end:
                line = f.readline(partition.end - offset)
                if not line:
                    return
                text = line.rstrip(b"\r\n").decode("utf-8", errors="replace")
                yield partition.name, offset, text, partition.inode, offset + len(line), partition.rotated
                offset += len(line)

    def commit(self, end: dict) -> None:
        """Offsets live in the query's checkpoint; there is nothing to clean up."""


class TailSource(DataSource):
    """Options: `path` (files or patterns, separated as in a PATH), `startingOffsets` (JSON {path: [inode, bytes]}).

    Rows: the name the file is followed under, the line's place, the line, and for a cursor the inode, the place after
    the line and whether the file was rotated.
    """

    @classmethod
    def name(cls) -> str:
        return "pulsegrid_tail"

    def schema(self) -> str:
        return "path string, seq bigint, line string, inode bigint, until bigint, rotated boolean"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TailSource)
