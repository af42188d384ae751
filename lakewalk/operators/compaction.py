"""Packing very many small files into few well-sized ones."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakewalk.operators.keyed_state import Conflict, key_columns
from lakewalk.storage import Files, configured, observed, written

#: Up to so many ids (8 bytes each) are broadcast.
MOST_IDS = 2_000_000


class ChecksumMismatch(RuntimeError):
    """The packed rows aren't the multiset of the rows that were to be packed; nothing was committed."""


def parent(path: Column) -> Column:
    """The path without its last component; '' for an entry of the root."""
    return F.regexp_replace(path, "/[^/]*$", "")


def small_files(files: DataFrame, least: int = 1, most: int = 4096, per_directory: int = 8) -> DataFrame:
    """frag_id of the rows of ``files`` (frag_id, path, type, size, dev, ino, content) worth packing.

    Of rows with the same dev and ino the lowest frag_id counts (a null dev or ino is the same as no other). Of these,
    regular files (type 2) of ``least`` to ``most`` bytes in directories that hold at least ``per_directory`` such
    files. A null size stands for the byte count of content; with null content too, the row doesn't count. Only ids, sizes
    and 128-bit hashes of directories are shuffled, and directories are counted before they are joined.
    """
    light = files.select(
        "frag_id",
        *key_columns(parent(F.col("path"))),
        "type",
        F.coalesce("size", F.octet_length("content").cast("bigint")).alias("bytes"),
        "dev",
        "ino",
    )
    alone = F.col("dev").isNull() | F.col("ino").isNull()
    first = light.groupBy("dev", "ino", F.when(alone, F.col("frag_id")).alias("alone")).agg(
        F.min(F.struct("frag_id", "k1", "k2", "type", "bytes")).alias("r")
    ).select("r.*")
    fit = first.filter((F.col("type") == 2) & F.col("bytes").between(least, most)).select("frag_id", "k1", "k2")
    enough = fit.groupBy("k1", "k2").count().filter(F.col("count") >= per_directory).select("k1", "k2")
    return fit.join(enough, ["k1", "k2"], "left_semi").select("frag_id")


def records(files: DataFrame) -> DataFrame:
    """One row per line of content: rec_no from 0 and record without its line end, which is CR LF, LF or CR.

    A last line without line end is a record; nothing follows a last line end. Empty lines are records. An empty or null
    content gives one row with null rec_no and record, so that the file isn't lost.
    """
    lines = F.split("content", "\r\n|\n|\r")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    keep = [c for c in files.columns if c != "content"]
    return files.select(*keep, F.posexplode_outer(lines).alias("rec_no", "record"))


def _sums(columns: list[str]) -> list[Column]:
    h = F.xxhash64(*[F.col(c).isNull() for c in columns], *columns)
    h2 = F.xxhash64(F.lit(7), *[F.col(c).isNull() for c in columns], *columns)
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum(h.cast("decimal(20,0)")).cast("string").alias("sum"),
        F.bit_xor(h2).alias("xor"),
    ]


def multiset(df: DataFrame) -> dict:
    """Count, sum and exclusive or of row hashes: equal for equal multisets, whatever their order and partitions."""
    return df.agg(*_sums(df.columns)).first().asDict()


def compact(rows: DataFrame, root: str, by: list[str], target_bytes: int | None = None) -> DataFrame:
    """Write ``rows`` into few files near ``target_bytes`` (default: the session's advisory size) and commit them.

    The rows are shuffled by ``by`` under a REBALANCE hint: the sizes seen at run time merge small partitions and split
    large ones, also those of one hot value, so the number of files follows the bytes and not the number of values. The
    multiset checksum of ``rows`` is taken while they are written, and what was written is read again; only if its checksum
    is the same is the new folder committed. (Where the two differ the source is counted once more by itself, as a stage that
    was run again after a loss counts its rows twice.) Otherwise ``ChecksumMismatch`` is raised and readers keep what they
    had. No rows give an empty table. Returns the committed rows.

    Every run writes a folder of a name of its own, and the commit makes the file ``root/commits/<version>.json`` unless it is
    there: of two runs from the same version the second raises ``Conflict``. The last two versions' folders are kept.
    """
    spark = rows.sparkSession
    files, (version, _) = Files(spark), _version(spark, root)
    at = f"{root}/packed-{uuid.uuid4().hex}"
    sizes = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true"
    }
    if target_bytes:
        sizes["spark.sql.adaptive.advisoryPartitionSizeInBytes"] = str(target_bytes)
    order = [c for c in rows.columns if c not in by]
    seen = Observation()
    with configured(spark, **sizes):
        rows.observe(seen, *_sums(rows.columns)).hint("rebalance", *by).sortWithinPartitions(*by, *order).write.parquet(at)
    packed = spark.read.schema(rows.schema).parquet(at)
    got = multiset(packed)
    if observed(seen) != got and (wanted := multiset(rows)) != got:
        files.delete(at)
        raise ChecksumMismatch(f"to pack {wanted}, packed {got}")
    record = {"folder": at, "checksum": got, "schema": rows.schema.jsonValue()}
    if not files.put_new(f"{root}/commits/{version + 1:09d}.json", json.dumps(record)):
        files.delete(at)
        raise Conflict(f"version {version + 1} of {root} has been committed by another writer")
    if version > 1:
        files.delete(_record(files, root, version - 1)["folder"])
    return packed


def _record(files: Files, root: str, version: int) -> dict:
    return json.loads(files.read_text(f"{root}/commits/{version:09d}.json"))


def _version(spark: SparkSession, root: str) -> tuple[int, dict]:
    files = Files(spark)
    names = [n for n in files.names(f"{root}/commits") if n.endswith(".json")]
    version = int(names[-1].removesuffix(".json")) if names else 0
    return version, _record(files, root, version) if version else {}


def committed(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the version in force."""
    record = _version(spark, root)[1]
    return spark.read.schema(StructType.fromJson(record["schema"])).parquet(record["folder"])


def pack_fragments(files: DataFrame, root: str, target_bytes: int | None = None, **limits: int) -> DataFrame:
    """``small_files`` of ``files``, as records, packed by directory: frag_id, path, directory, rec_no, record.

    Contents are read twice, for their lengths and to be packed. They are shuffled once, by the packing, if the ids to pack
    are few enough to be broadcast (MOST_IDS, counted), and otherwise once more by the join with the ids.
    """
    chosen = written(small_files(files, **limits), "chosen")
    if chosen.count() <= MOST_IDS:
        chosen = F.broadcast(chosen)
    bodies = files.select("frag_id", "path", "content").join(chosen, "frag_id", "left_semi")
    rows = records(bodies.withColumn("directory", parent(F.col("path"))))
    return compact(rows.select("directory", "path", "frag_id", "rec_no", "record"), root, ["directory"], target_bytes)
