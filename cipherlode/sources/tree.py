"""Files of a source tree: a data source that walks a folder, and the same rules for files that are rows of a table."""

from __future__ import annotations

import errno
import functools
import json
import os
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cipherlode.functions import paths as P

SCHEMA = "path string, kind string, size bigint, text string, reason string"
#: Bytes of files that one partition reads, about; folders that are listed before there are tasks; files of one folder that a task lists; tasks for folders.
PART_BYTES, LISTED, CROWDED, PARTS = 32 << 20, 500, 20_000, 10_000


@dataclass
class Part(InputPartition):
    """Files (path, kind, size) to read, rows that are known already, folders to list with all that is below them, and slices of crowded folders: one of so many."""

    files: list[tuple[str, str, int]] = field(default_factory=list)
    known: list[tuple[str, str | None, int | None, None, str]] = field(default_factory=list)
    folders: list[str] = field(default_factory=list)
    crowded: list[tuple[str, int, int]] = field(default_factory=list)


def _code(error: OSError) -> str:
    return errno.errorcode.get(error.errno or 0, "error")


class TreeReader(DataSourceReader):
    """The first LISTED folders are listed before there are tasks, breadth first; what lies below is listed by the tasks that read it, so the driver never holds a large tree's files."""

    def __init__(self, root: str, exclude: list[str], part_bytes: int, listed: int = LISTED, crowded: int = CROWDED, kinds: list[str | None] | None = None):
        self.root, self.exclude, self.part_bytes, self.listed, self.crowded, self.kinds = root, P.excludes(exclude), part_bytes, listed, crowded, kinds

    def _entries(self, path: str) -> Iterator[tuple]:
        """(path, kind, size, reason, whether a folder) in a folder, in order; names and sizes only, nothing is opened."""
        try:
            entries = sorted(os.scandir(os.path.join(self.root, path)), key=lambda e: e.name.encode("utf-16-be", "surrogatepass"))
        except OSError as error:
            yield path or ".", None, None, f"unreadable ({_code(error)})", False
            return
        for e in entries:
            at = f"{path}/{e.name}" if path else e.name
            folder = e.is_dir(follow_symlinks=False)
            if folder and e.name in P.NEVER or any(x in (e.name, at) or at.startswith(f"{x}/") for x in self.exclude):
                continue
            if e.is_symlink():
                yield at, None, None, "symbolic link, not followed", False
            elif folder:
                yield at, None, None, None, True
            elif e.is_file() and (kind := P.kind_of_name(e.name)):
                size = e.stat(follow_symlinks=False).st_size
                yield at, kind, size, "larger than 16 MB" if size > P.LARGEST else None, False

    def _walk(self, path: str) -> Iterator[tuple]:
        """What is in a folder and below it, without the folders."""
        for e in self._entries(path):
            if e[4]:
                yield from self._walk(e[0])
            else:
                yield e

    def _wanted(self, entry: tuple) -> bool:
        """Whether a file is of the kinds asked for; others are not opened."""
        return self.kinds is None or entry[1] in self.kinds

    def partitions(self) -> list[Part]:
        parts, held, left, listed = [Part()], 0, deque([""]), 0
        while left and listed < self.listed:
            folder = left.popleft()
            listed += 1
            entries = list(self._entries(folder))
            left += (e[0] for e in entries if e[4])
            files = [e for e in entries if not e[4] and self._wanted(e)]
            if len(files) > self.crowded:
                n = -(-len(files) // self.crowded)
                parts += (Part(crowded=[(folder, k, n)]) for k in range(n))
                continue
            for path, kind, size, reason, _ in files:
                if reason:
                    parts[0].known.append((path, kind, size, None, reason))
                    continue
                if held and held + size > self.part_bytes:
                    parts.insert(0, Part())
                    held = 0
                parts[0].files.append((path, kind, size))
                held += size
        below = list(left)
        return parts + [Part(folders=below[k::PARTS]) for k in range(min(PARTS, len(below)))]

    def read(self, partition: Part) -> Iterator[tuple]:
        yield from partition.known
        for path, kind, size in partition.files:
            yield self._row(path, kind, size)
        for folder in partition.folders:
            yield from (self._row(*e[:4]) for e in self._walk(folder) if self._wanted(e))
        for folder, k, n in partition.crowded:
            yield from (self._row(*e[:4]) for e in self._entries(folder) if not e[4] and self._wanted(e) and zlib.crc32(e[0].encode("utf-8", "surrogatepass")) % n == k)

    def _row(self, path: str, kind: str | None, size: int | None, reason: str | None = None) -> tuple:
        """One file as a row; it is opened here."""
        if reason:
            return path, kind, size, None, reason
        try:
            with open(os.path.join(self.root, path), "rb") as f:
                text = f.read().decode("utf-8", "replace")
        except OSError as error:
            return path, kind, size, None, f"unreadable ({_code(error)})"
        binary = "\0" in text[: P.SNIFFED]
        return path, kind, size, None if binary else text, "binary" if binary else None


class TreeSource(DataSource):
    """spark.read.format("source_tree").option("exclude", json list).load(folder); every executor must see the folder."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> TreeReader:
        root = os.path.abspath(self.options["path"])
        if not os.path.isdir(root):
            raise ValueError(f"not a directory: {self.options['path']}")
        return TreeReader(root, json.loads(self.options.get("exclude", "[]")), *(int(self.options.get(k, v)) for k, v in (("partbytes", PART_BYTES), ("listed", LISTED), ("crowded", CROWDED))), json.loads(self.options.get("kinds", "null")))


def read_tree(spark: SparkSession, folder: str, exclude: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(path, kind, size, text, reason) of a folder: files that are read have a text, skipped ones a reason.

    A part for each kind, whose kind is a constant: a plan that asks for one kind
    leaves the other parts out, so their files are never opened. (Filters that are pushed
    into a Python source are of no use here, since all scans of one source share what one of them asks.)
    """
    spark.dataSource.register(TreeSource)
    parts = [
        spark.read.format("source_tree").option("exclude", json.dumps(list(exclude))).option("kinds", json.dumps([kind])).load(folder).withColumn("kind", F.lit(kind).cast("string"))
        for kind in (*P.KINDS, None)
    ]
    return functools.reduce(DataFrame.union, parts)


def read_table(files: DataFrame, path: str = "path", text: str = "text", exclude: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The same columns for files that are rows of a table: the way in for corpora too large for one folder. A projection; no shuffle."""
    rows = files.select(F.col(path).alias("path"), F.col(text).alias("text")).where(F.col("path").isNotNull() & ~P.left_out(F.col("path"), exclude))
    kinds = rows.withColumn("kind", P.kind(F.col("path"))).where("kind IS NOT NULL")
    size = F.octet_length("text").cast("bigint")
    reason = F.coalesce(F.when(F.col("text").isNull(), "unreadable (error)"), P.why_skipped(size, F.col("text")))
    return kinds.select("path", "kind", size.alias("size"), F.when(reason.isNull(), F.col("text")).alias("text"), reason.alias("reason"))
