"""Tar archives, their entries and index, and text that is compressed by bzip2."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewalk import schema
from lakewalk.sources.caches import _open
from lakewalk.storage import qualified, written

COLUMNS = "archive string, path string, type int, mode int, uid bigint, gid bigint, size bigint, mtime bigint, link_target string, offset bigint, data_offset bigint"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
BATCH, MOST_TASKS = 10_000, 10_000


def _entries(archive: str, tar) -> Iterator[tuple]:
    import tarfile

    kinds = {tarfile.REGTYPE: schema.FILE, tarfile.AREGTYPE: schema.FILE, tarfile.DIRTYPE: schema.DIRECTORY, tarfile.SYMTYPE: schema.LINK}
    for e in tar:
        kind = kinds.get(e.type, schema.UNKNOWN)
        yield archive, e.name, kind, e.mode, e.uid, e.gid, e.size, int(e.mtime), e.linkname or None, e.offset, e.offset_data
        tar.members.clear()


def archive_list(archives: DataFrame) -> DataFrame:
    """The entries of every archive (column ``archive``: names on a shared file system), with the places of their headers
    and data. Archives are streamed, plain or compressed, and put out in batches; directories end without a slash. An archive
    that was written by ``write_archives`` needs no such scan: its index is a table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tarfile

        for batch in batches:
            for name in batch["archive"].dropna():
                system, at = _open(name)
                with system.open_input_stream(at, compression=None) as source, tarfile.open(fileobj=source, mode="r|*") as tar:
                    entries = _entries(name, tar)
                    while rows := list(islice(entries, BATCH)):
                        yield pd.DataFrame(rows, columns=NAMES)

    # One archive per task: they are large, and few.
    names = archives.select("archive")
    return names.repartition(max(1, min(names.count(), MOST_TASKS)), "archive").mapInPandas(run, COLUMNS)


def write_archives(rows: DataFrame, root: str) -> DataFrame:
    """Write entries (path, type, mode, uid, gid, mtime, link_target and, for files, binary content) into archives below ``root``,
    one per partition of ``rows``, and give their index: the same columns as ``archive_list``. Null numbers are 0, null modes
    those of a plain file or directory. Rows of other types, or without a path, aren't archived.

    The index is written below ``root`` too and committed last; archives that it doesn't name (of tasks that were tried again)
    don't count. ``indexed_contents`` reads by it."""
    spark = rows.sparkSession
    root = qualified(spark, root).rstrip("/")
    columns = ["path", "type", "mode", "uid", "gid", "mtime", "link_target", "content"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tarfile

        system, at = _open(root)
        system.create_dir(at, recursive=True)
        name = f"archive-{uuid.uuid4().hex}.tar"
        found, tar, out = [], None, None
        for batch in batches:
            for path, kind, mode, uid, gid, mtime, target, content in batch.itertuples(index=False, name=None):
                if tar is None:
                    out = system.open_output_stream(f"{at}/{name}")
                    tar = tarfile.open(fileobj=out, mode="w|")
                e = tarfile.TarInfo(path)
                e.type = {schema.FILE: tarfile.REGTYPE, schema.DIRECTORY: tarfile.DIRTYPE, schema.LINK: tarfile.SYMTYPE}[kind]
                plain = 0o755 if kind == schema.DIRECTORY else 0o644
                e.mode = int(mode) & 0o7777 if pd.notna(mode) else plain
                e.uid, e.gid, e.mtime = (int(x) if pd.notna(x) else 0 for x in (uid, gid, mtime))
                e.linkname = (target or "") if kind == schema.LINK else ""
                data = bytes(content) if kind == schema.FILE and content is not None else b""
                e.size = len(data)
                start = tar.offset
                tar.addfile(e, io.BytesIO(data))
                data_at = tar.offset - -(-len(data) // 512) * 512
                found.append((f"{root}/{name}", path, kind, e.mode, e.uid, e.gid, e.size, e.mtime, e.linkname or None, start, data_at))
                if len(found) == BATCH:
                    yield pd.DataFrame(found, columns=NAMES)
                    found = []
        if found:
            yield pd.DataFrame(found, columns=NAMES)
        if tar is not None:
            tar.close()
            out.close()

    kept = rows.filter(F.col("path").isNotNull() & F.col("type").isin(schema.FILE, schema.DIRECTORY, schema.LINK))
    return written(kept.select(*columns).mapInPandas(run, COLUMNS), "index", f"{root}/index-{uuid.uuid4().hex}")


def indexed_contents(index: DataFrame, partitions: int | None = None) -> DataFrame:
    """path and content of the files in an index (of any archives that aren't compressed), read at their places: entries are
    dealt out evenly, so one large archive is read by many tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, part in batch.groupby("archive", sort=False):
                system, at = _open(archive)
                with system.open_input_file(at) as source:
                    part = part.sort_values("data_offset")
                    bodies = [source.read_at(int(n), int(k)) for n, k in zip(part["size"], part["data_offset"])]
                yield pd.DataFrame({"path": part["path"], "content": bodies})

    files = index.filter(F.col("type") == schema.FILE).select("archive", "path", "size", "data_offset")
    n = partitions or int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartitionByRange(n, "archive", "data_offset").mapInPandas(run, "path string, content binary")


def compressed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files; bzip2 files are split into blocks that tasks read in parallel."""
    return spark.read.text(path)


def write_compressed(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").option("compression", "bzip2").text(path)
