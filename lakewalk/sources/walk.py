"""Walks of file trees as a data source: ``spark.read.format("lakewalk_tree")``.

Options: ``path`` (one root) or ``roots`` (a JSON list), ``lite`` (names and types only, without a stat), ``dereference``
(stat what links point to), ``digest`` (SHA-256 of regular files), ``errors`` (``drop`` or ``keep``: rows of failed stats
with nulls and ``error`` missing or unreadable), ``split`` (levels below a root whose directories are tasks of their own; the
entries above them go into tasks of BATCH entries). A directory that can't be listed has ``error`` unlistable on its row,
whatever the option, as what lies in it is unknown. The roots themselves are listed. Overlapping roots list entries as often as
they are reached. With ``dereference`` a directory isn't entered again below itself. The mount has to be the same on all
executors. ``walk_levels`` is the walk for trees of unknown shape: it spreads directories and entries anew at every level.
"""

from __future__ import annotations

import hashlib
import json
import os
import stat
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from lakewalk import schema
from lakewalk.storage import written

BATCH = 10_000


def entry_type(mode: int) -> int:
    return {
        stat.S_IFREG: schema.FILE, stat.S_IFDIR: schema.DIRECTORY, stat.S_IFLNK: schema.LINK
    }.get(stat.S_IFMT(mode), schema.UNKNOWN)


class Subtrees(InputPartition):
    """Entries for one task: paths, and whether to go down from each."""

    def __init__(self, paths: list[tuple[str, bool]]):
        self.paths = paths


class TreeReader(DataSourceReader):
    def __init__(self, table: StructType, options: dict):
        on = lambda key: str(options.get(key, "false")).lower() == "true"
        self.table, self.lite, self.dereference, self.digest = table, on("lite"), on("dereference"), on("digest")
        self.keep, self.levels = options.get("errors", "drop") == "keep", int(options.get("split", "1"))
        roots = json.loads(options["roots"]) if "roots" in options else [options["path"]]
        self.roots = [os.path.normpath(r if r.startswith("/") else os.path.join(os.getcwd(), r)) for r in roots]

    def partitions(self) -> list[Subtrees]:
        """Directories at the split level are tasks; what lies above them is listed here and dealt out in batches."""
        deep: list[str] = []
        single: list[str] = []
        level = [(r, 0, os.path.isdir(r) and (self.dereference or not os.path.islink(r))) for r in self.roots]
        while level:
            path, depth, is_dir = level.pop()
            if is_dir and depth >= self.levels:
                deep.append(path)
                continue
            single.append(path)
            if is_dir:
                try:
                    level += [(e.path, depth + 1, e.is_dir(follow_symlinks=self.dereference)) for e in os.scandir(path)]
                except OSError:
                    pass  # its own row says so
        batches = [single[i : i + BATCH] for i in range(0, len(single), BATCH)]
        return [Subtrees([(p, True)]) for p in deep] + [Subtrees([(p, False) for p in b]) for b in batches]

    def _row(self, path: str, kind: int | None = None) -> tuple | None:
        names = self.table.names
        row = dict.fromkeys(names)
        row |= {"path": path, "depth": path.count("/"), "type": kind or schema.UNKNOWN}
        if kind is None or not self.lite:
            try:
                st = os.stat(path) if self.dereference else os.lstat(path)
            except OSError as e:
                if not self.keep:
                    return None
                row["error"] = "missing" if isinstance(e, FileNotFoundError) else "unreadable"
                return tuple(row[n] for n in names)
            row["type"] = entry_type(st.st_mode)
            if not self.lite:
                row |= {
                    "mode": st.st_mode,
                    "uid": st.st_uid,
                    "gid": st.st_gid,
                    "size": st.st_size,
                    "dev": st.st_dev,
                    "ino": st.st_ino,
                }
                for c, ns in (("atime", st.st_atime_ns), ("mtime", st.st_mtime_ns), ("ctime", st.st_ctime_ns)):
                    row[c], row[f"{c}_nsec"] = divmod(ns, 10**9)
                if row["type"] == schema.LINK:
                    row["link_target"] = os.readlink(path)
                if self.digest and row["type"] == schema.FILE:
                    row |= self._digest(path)
        return tuple(row.get(n) for n in names)

    def _digest(self, path: str) -> dict:
        try:
            with open(path, "rb") as f:
                return {"digest": hashlib.file_digest(f, "sha256").hexdigest()}
        except OSError:
            return {"error": "unreadable"}

    def _listed(self, path: str, kind: int | None) -> tuple[tuple | None, list[os.DirEntry]]:
        """The row of a directory and its entries."""
        row = self._row(path, kind)
        try:
            return row, list(os.scandir(path))
        except OSError:
            if row and "error" in self.table.names and row[self.table.names.index("type")] == schema.DIRECTORY:
                at = self.table.names.index("error")
                row = (*row[:at], "unlistable", *row[at + 1 :])
            return row, []

    def _kind(self, e: os.DirEntry) -> int:
        if e.is_dir(follow_symlinks=self.dereference):
            return schema.DIRECTORY
        if e.is_symlink() and not self.dereference:
            return schema.LINK
        return schema.FILE if e.is_file(follow_symlinks=self.dereference) else schema.UNKNOWN

    def _inode(self, path: str) -> tuple[int, int] | None:
        try:
            st = os.stat(path)
            return st.st_dev, st.st_ino
        except OSError:
            return None

    def _walk(self, part: Subtrees) -> Iterator[tuple]:
        todo = []
        for path, deep in part.paths:
            is_dir = os.path.isdir(path) and (self.dereference or not os.path.islink(path))
            if deep:
                todo.append((path, None, frozenset()))
            elif row := self._listed(path, None)[0] if is_dir else self._row(path):
                yield row
        while todo:
            path, kind, above = todo.pop()
            row, entries = self._listed(path, kind)
            if row:
                yield row
            if self.dereference:
                here = self._inode(path)
                entries = [] if here in above else entries
                above = above | {here}
            for e in entries:
                kind = self._kind(e)
                if kind == schema.DIRECTORY:
                    todo.append((e.path, kind, above))
                elif row := self._row(e.path, kind):
                    yield row

    def read(self, partition: Subtrees) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(self.table)
        rows: list[tuple] = []
        for row in self._walk(partition):
            rows.append(row)
            if len(rows) == BATCH:
                yield _batch(rows, arrow)
                rows = []
        if rows:
            yield _batch(rows, arrow)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lakewalk_tree"

    def schema(self) -> StructType:
        if str(self.options.get("lite", "false")).lower() == "true":
            return schema.LITE
        extra = [StructField("digest", StringType()), StructField("error", StringType())]
        return StructType([*schema.EXTENDED.fields, *extra])

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(schema, dict(self.options))


def walk(spark: SparkSession, *roots: str, **options: str) -> DataFrame:
    """The inventory of one or more roots."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("lakewalk_tree").options(roots=json.dumps(list(roots)), **options).load()


def walk_levels(spark: SparkSession, *roots: str, partitions: int | None = None, stats: bool = True) -> DataFrame:
    """The inventory of one or more roots, level by level: the directories of a level are dealt out evenly, listed and
    written, and those found are the next level, so no task is left with a deep subtree. Then all entries are dealt out
    evenly for their stats, so a directory of very many files is one task's only for its names. One job per level.
    Columns: path, depth, type and error, and with ``stats`` the whole inventory; entries gone meanwhile are left out.
    """
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = StructType([*schema.LITE.fields, StructField("error", StringType())])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        reader, arrow = TreeReader(table, {"roots": "[]", "lite": "true"}), to_arrow_schema(table)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    found = [(e.path, e.path.count("/"), reader._kind(e), None) for e in os.scandir(path)]
                except OSError:
                    found = [(path, path.count("/"), schema.DIRECTORY, "unlistable")]
                for i in range(0, len(found), BATCH):
                    yield _batch(found[i : i + BATCH], arrow)

    start = TreeReader(table, {"roots": json.dumps(roots), "lite": "true"})
    tops = [r for p in start.roots if (r := start._row(p))]
    levels = [written(spark.createDataFrame(tops, table), "level")]
    while not (todo := levels[-1].filter((F.col("type") == schema.DIRECTORY) & F.col("error").isNull())).isEmpty():
        levels.append(written(todo.select("path").repartition(n).mapInArrow(listed, table), "level"))
    names = reduce(DataFrame.unionAll, levels)
    # A directory that can't be listed has a row of its level and one that says so.
    lite = names.groupBy("path", "depth", "type").agg(F.max("error").alias("error"))
    if not stats:
        return lite
    return restat(lite.repartition(n)).join(lite.filter("error IS NOT NULL").select("path", "error"), "path", "left")


def restat(rows: DataFrame, dereference: bool = False) -> DataFrame:
    """``rows`` (path) with fresh stats, taken on the executors; what can't be read is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        reader = TreeReader(schema.EXTENDED, {"roots": "[]", "dereference": str(dereference)})
        for batch in batches:
            found = [r for p in batch.column(0).to_pylist() if p is not None and (r := reader._row(p))]
            if found:
                yield _batch(found, to_arrow_schema(schema.EXTENDED))

    return rows.select("path").mapInArrow(run, schema.EXTENDED)


def explicit(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """An inventory of given rows; missing fields are null, depth is counted."""
    names = schema.EXTENDED.names
    filled = [tuple({"depth": r["path"].count("/"), "type": schema.UNKNOWN, **r}.get(n) for n in names) for r in rows]
    return spark.createDataFrame(filled, schema.EXTENDED)
