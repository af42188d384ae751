"""Lists of entries in files: text and binary caches, CSV, JSON and listings. Parquet is the native cache."""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lakewalk import schema
from lakewalk.functions import modes, paths, units
from lakewalk.storage import Files, qualified

#: Letters of types in text caches. Fixed values.
LETTERS = {schema.FILE: "F", schema.DIRECTORY: "D", schema.LINK: "L"}
#: Numbers of a binary record after the path, in order. Fixed values.
NUMBERS = ["mode", "uid", "gid", "atime", "atime_nsec", "mtime", "mtime_nsec", "ctime", "ctime_nsec", "size"]
RECORDS_PER_TASK = 1_000_000
#: Records that a writing task holds at once; each so many are a file.
RECORDS_PER_FILE = 250_000
#: Names the files of a folder that count.
MANIFEST = "_manifest.json"


def text_lines(rows: DataFrame) -> DataFrame:
    """'path|letter' of every row with a path: F, D, L, or U for other types."""
    letter = F
    for kind, name in LETTERS.items():
        letter = letter.when(F.col("type") == kind, name)
    return rows.filter("path IS NOT NULL").select(F.concat("path", F.lit("|"), letter.otherwise("U")).alias("value"))


def write_text_cache(rows: DataFrame, path: str) -> None:
    text_lines(rows).write.mode("overwrite").text(path)


def read_text_cache(spark: SparkSession, path: str) -> DataFrame:
    """A lite inventory. The last bar divides path and letter, so names may hold bars; a line without a bar, or with an
    unknown letter, is of unknown type."""
    line = F.col("value")
    letter = F.when(F.instr(line, "|") > 0, F.substring_index(line, "|", -1))
    name = F.when(F.instr(line, "|") > 0, F.regexp_replace(line, r"\|[^|]*$", "")).otherwise(line)
    kind = F
    for t, c in LETTERS.items():
        kind = kind.when(letter == c, t)
    return spark.read.text(path).select(
        name.alias("path"), paths.depth(name).cast("int").alias("depth"), kind.otherwise(schema.UNKNOWN).alias("type")
    )


def _open(path: str):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
    return system, at


def _header(source) -> dict:
    """Where the records of a binary cache start and how wide they are; versions 3 and 4."""
    source.seek(0)
    version = struct.unpack(">Q", source.read(8))[0]
    if version not in (3, 4):
        raise ValueError(f"unknown version of a binary cache: {version}")
    if version == 3:
        source.read(16)
    users, user_chars, groups, group_chars, count, chars = struct.unpack(">6Q", source.read(48))
    start = source.tell()
    return {
        "version": version,
        "users": (start, users, user_chars),
        "groups": (start + users * (user_chars + 8), groups, group_chars),
        "records": (start + users * (user_chars + 8) + groups * (group_chars + 8), count, chars),
    }


def _names(source, at: tuple[int, int, int]) -> list[tuple[int, str]]:
    start, count, chars = at
    source.seek(start)
    data = np.frombuffer(
        source.read(count * (chars + 8)), np.dtype([("name", f"S{max(chars, 1)}" if chars else "V0"), ("id", ">u8")])
    ) if count and chars else []
    return [(int(r["id"]), r["name"].decode()) for r in data]


class Records(InputPartition):
    def __init__(self, path: str, start: int, count: int, chars: int):
        self.path, self.start, self.count, self.chars = path, start, count, chars


def _cache_files(system, at: str, suffix: str) -> list[str]:
    """The files of a folder: those in its manifest, or without one all with the suffix that aren't hidden."""
    from pyarrow import fs

    if system.get_file_info(f"{at}/{MANIFEST}").type == fs.FileType.File:
        with system.open_input_file(f"{at}/{MANIFEST}") as source:
            return [f"{at}/{n}" for n in json.loads(source.read())["files"]]
    found = system.get_file_info(fs.FileSelector(at))
    return [f.path for f in found if f.base_name.endswith(suffix) and f.base_name[0] not in "._"]


class CacheReader(DataSourceReader):
    def __init__(self, path: str, suffix: str = ""):
        self.path, self.suffix = path, suffix

    def partitions(self) -> list[Records]:
        from pyarrow import fs

        system, at = _open(self.path)
        info = system.get_file_info(at)
        files = _cache_files(system, at, self.suffix) if info.type == fs.FileType.Directory else [at]
        parts = []
        for f in sorted(files):
            with system.open_input_file(f) as source:
                start, count, chars = _header(source)["records"]
            prefix = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else ""
            for first in range(0, count, RECORDS_PER_TASK):
                parts.append(
                    Records(prefix + f, start + first * (chars + 80), min(RECORDS_PER_TASK, count - first), chars)
                )
        return parts

    def read(self, partition: Records | None) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition is None:  # a cache without files
            return
        record = record_type(partition.chars)
        arrow = to_arrow_schema(schema.INVENTORY)
        system, at = _open(partition.path)
        with system.open_input_file(at) as source:
            source.seek(partition.start)
            for first in range(0, partition.count, 50_000):
                data = np.frombuffer(source.read(min(50_000, partition.count - first) * record.itemsize), record)
                names = [p.decode() for p in data["path"]]
                format_ = data["mode"].astype(np.int64) & schema.FORMAT_MASK
                kind = np.select(
                    [format_ == schema.REGULAR, format_ == schema.DIRECTORY_MODE, format_ == schema.LINK_MODE],
                    [schema.FILE, schema.DIRECTORY, schema.LINK],
                    schema.UNKNOWN,
                )
                columns = {
                    "path": names,
                    "depth": [p.count("/") for p in names],
                    "type": kind,
                    **{n: data[n].astype(np.int64) for n in NUMBERS},
                }
                yield pa.record_batch([pa.array(columns[f.name]).cast(f.type) for f in arrow], schema=arrow)


class CacheSource(DataSource):
    """Binary caches, versions 3 and 4: ``spark.read.format("lakewalk_cache").load(file or folder)``; option ``suffix``: of the
    files in a folder without a manifest. Records have a fixed width, so a large file is read by many tasks."""

    @classmethod
    def name(cls) -> str:
        return "lakewalk_cache"

    def schema(self) -> StructType:
        return schema.INVENTORY

    def reader(self, schema: StructType) -> CacheReader:
        return CacheReader(self.options["path"], self.options.get("suffix", ""))


def read_binary_cache(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    spark.dataSource.register(CacheSource)
    return spark.read.format("lakewalk_cache").option("suffix", suffix).load(path)


def cache_names(path: str) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """The (id, name) pairs of users and groups in a binary cache."""
    system, at = _open(path)
    with system.open_input_file(at) as source:
        head = _header(source)
        return _names(source, head["users"]), _names(source, head["groups"])


def record_type(chars: int) -> np.dtype:
    """A record: the path, padded with zeros, and the numbers, unsigned and big-endian."""
    return np.dtype([("path", f"S{chars}"), *[(n, ">u8") for n in NUMBERS]])


def encode_batch(batch: pa.RecordBatch, chars: int) -> bytes:
    """The records of path and NUMBERS, column by column; nulls are 0."""
    body = np.zeros(batch.num_rows, record_type(chars))
    body["path"] = batch.column(0).cast(pa.binary()).fill_null(b"").to_numpy(zero_copy_only=False).astype(f"S{chars}")
    for name, column in zip(NUMBERS, batch.columns[1:]):
        body[name] = column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)
    return body.tobytes()


def encode_head(
    records: int, users: list[tuple[int, str]], groups: list[tuple[int, str]], chars: int, version: int = 4
) -> bytes:
    """What stands before the records of a binary cache."""

    def table(pairs: list[tuple[int, str]]) -> tuple[int, bytes]:
        width = max((len(n.encode()) + 1 for _, n in pairs), default=0)
        return width, b"".join(n.encode().ljust(width, b"\0") + struct.pack(">Q", i) for i, n in pairs)

    user_chars, user_bytes = table(users)
    group_chars, group_bytes = table(groups)
    head = struct.pack(">Q", version) + (struct.pack(">2Q", 0, 0) if version == 3 else b"")
    return head + struct.pack(">6Q", len(users), user_chars, len(groups), group_chars, records, chars) + user_bytes + group_bytes


def write_binary_cache(
    rows: DataFrame,
    path: str,
    users: list[tuple[int, str]] = (),
    groups: list[tuple[int, str]] = (),
    version: int = 4,
    suffix: str = ".cache",
) -> int:
    """Write a folder of binary caches and give the number of records. Rows without a path don't count.

    Batches of columns become records as they come, a file for each RECORDS_PER_FILE. Files have names of their own, so a task
    that is tried again overwrites nothing; the folder's manifest then names those that count, in one step, and a reader of
    the folder has either the old cache or the new one. Files that the manifest no longer names are deleted. Nulls are written
    as 0, as the format has none. Names of users and groups go into every file, so give those that occur.
    """
    spark = rows.sparkSession
    path, files = qualified(spark, path).rstrip("/"), Files(spark)
    rows = rows.filter("path IS NOT NULL")
    longest = rows.agg(F.max(F.octet_length("path"))).first()[0] or 0
    chars = -(-(longest + 1) // 8) * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _open(path)
        held, n = [], 0

        def write() -> pa.RecordBatch:
            name = f"part-{uuid.uuid4().hex}{suffix}"
            system.create_dir(at, recursive=True)
            with system.open_output_stream(f"{at}/{name}") as out:
                out.write(encode_head(n, list(users), list(groups), chars, version))
                for body in held:
                    out.write(body)
            return pa.record_batch([pa.array([name]), pa.array([n], pa.int64())], ["name", "n"])

        for batch in batches:
            for first in range(0, batch.num_rows, RECORDS_PER_FILE):
                part = batch.slice(first, RECORDS_PER_FILE)
                held.append(encode_batch(part, chars))
                n += part.num_rows
                if n >= RECORDS_PER_FILE:
                    yield write()
                    held, n = [], 0
        if n:
            yield write()

    # One row per file.
    made = rows.select("path", *NUMBERS).mapInArrow(run, "name string, n bigint").collect()
    names = sorted(r["name"] for r in made)
    files.replace_text(f"{path}/{MANIFEST}", json.dumps({"files": names}))
    for name in files.names(path):
        if name.startswith("part-") and name.endswith(suffix) and name not in names:
            files.delete(f"{path}/{name}")
    return sum(r["n"] for r in made)


def listing(rows: DataFrame) -> DataFrame:
    """line of every row with a path, user and group: mode, user, group, size in units, time of change and path; rows without a mode
    as 'Type=... File=...'. Times are shown in the session's time
    zone; sizes are rounded half to even, as C does."""
    value, unit = units.bytes_and_unit(F.coalesce("size", F.lit(0)))
    long = F.format_string(
        "%s %s %s %7.3f %3s %s %s",
        modes.mode_string(F.col("mode")),
        F.col("user"),
        F.col("group"),
        F.bround(value, 3),
        unit,
        units.display_time(F.col("mtime")),
        F.col("path"),
    )
    kind = F.when(
        F.col("type") == schema.DIRECTORY, "DIR"
    ).when(F.col("type") == schema.FILE, "REG").when(F.col("type") == schema.LINK, "LNK").otherwise("UNK")
    return rows.filter("path IS NOT NULL").select(
        F.when(F.col("mode").isNotNull(), long).otherwise(
            F.format_string("Type=%s File=%s", kind, F.col("path"))
        ).alias("line")
    )


def csv_report(hot_cold: DataFrame) -> DataFrame:
    """The hot and cold report with its figures as text: six places for bytes, ten for the ratio."""
    fixed = lambda c: F.format_string("%.6f", F.col(c).cast("double")).alias(c)
    days = [c for c in hot_cold.columns if c.startswith("day")]
    return hot_cold.select(
        F.col("directory").alias("directory_path"),
        fixed("total"),
        fixed("cold"),
        F.format_string("%.10f", "ratio").alias("ratio"),
        F.col("errors").alias("error_count"),
        *[fixed(c) for c in days],
    )


def write_csv_report(hot_cold: DataFrame, path: str) -> None:
    csv_report(hot_cold).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def json_report(counts: DataFrame, sizes: DataFrame, ages: DataFrame, broken: DataFrame, now: int) -> DataFrame:
    """The profile as one JSON text in ``value``: counters, histograms and the sample of broken paths (all bounded)."""
    table = lambda df, name, *order: df.agg(
        F.to_json(
            F.array_sort(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in order])))
        ).alias(name)
    )
    parts = [
        counts.select(F.to_json(F.struct(*counts.columns)).alias("summary")),
        table(sizes, "size_histogram", "bin"),
        table(ages, "age_histograms", "field", "bin"),
        table(broken, "broken_paths", "path"),
    ]
    texts = [p.first()[0] for p in parts]
    names = ["summary", "size_histogram", "age_histograms", "broken_paths"]
    value = f'{{"generated_at": {now}, ' + ", ".join(f'"{n}": {t}' for n, t in zip(names, texts)) + "}"
    return counts.sparkSession.createDataFrame([(value,)], "value string")
