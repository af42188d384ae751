"""Files with equal contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewalk import schema
from lakewalk.functions import paths
from lakewalk.operators.order import numbered
from lakewalk.storage import written


#: Up to so many sizes (8 bytes each) are broadcast.
MOST_SIZES = 500_000


def hashed(files: DataFrame) -> DataFrame:
    """path, bytes and digest (SHA-256 in hexadecimal) of the regular, non-empty files of a size that several share.

    ``size`` counts; where it is null the bytes of content. Sizes are counted first, without reading contents but those of
    files without a size. If the shared ones are few enough to be broadcast (counted), files of a unique size are dropped
    where they are read; beyond that all files are hashed there, with the same groups in the end. Each file is hashed once,
    into a table of paths and digests; contents are never shuffled. Files with null contents don't count. Without a column
    ``size`` all sizes are null.
    """
    if "size" not in files.columns:
        files = files.withColumn("size", F.lit(None).cast("bigint"))
    sized = files.filter(
        (F.col("type") == schema.FILE) & F.col("content").isNotNull()
    ).withColumn("bytes", F.coalesce("size", F.octet_length("content").cast("bigint"))).filter("bytes > 0")
    known = files.filter((F.col("type") == schema.FILE) & (F.col("size") > 0)).select(F.col("size").alias("bytes"))
    unknown = sized.filter("size IS NULL").select("bytes")
    shared = known.unionAll(unknown).groupBy("bytes").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("bytes")
    shared = written(shared, "sizes")
    if shared.count() <= MOST_SIZES:
        sized = sized.join(F.broadcast(shared), "bytes", "left_semi")
    return written(sized.select("path", "bytes", F.sha2("content", 256).alias("digest")), "digests")


def _groups(digests: DataFrame) -> DataFrame:
    return digests.groupBy("digest").agg(
        F.min("path").alias("first_path"), F.count(F.lit(1)).alias("copies"), F.max("bytes").alias("bytes")
    ).filter("copies > 1")


def duplicates(files: DataFrame) -> DataFrame:
    """path, digest and group_size of every file whose content another file has too. Copies stay rows of one class; pairs
    aren't formed."""
    digests = hashed(files)
    sizes = _groups(digests).select("digest", F.col("copies").alias("group_size"))
    return digests.join(sizes, "digest").select("path", "digest", "group_size")


def duplicate_groups(files: DataFrame) -> DataFrame:
    """Per digest: the least path, the number of copies and the bytes that all but one of them take."""
    return _groups(hashed(files)).select(
        "digest", "first_path", "copies", (F.col("bytes") * (F.col("copies") - 1)).alias("wasted")
    )


def ranked_groups(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``rows`` with the dense number of their key (from 0, in the keys' order), the size of its group and their place in it.

    Rows are numbered in the order of (key, order) by range partitions; a row's place is its number less the least of its
    group. No window holds a group, however many rows a key has.
    """
    placed = numbered(rows, [F.col(key).asc_nulls_first(), F.col(order)], "_index")
    groups = placed.groupBy(key).agg(F.count(F.lit(1)).alias("group_size"), F.min("_index").alias("_start"))
    keys = numbered(groups, [F.col(key).asc_nulls_first()], "group_id")
    joined = placed.alias("r").join(keys.alias("k"), F.col(f"r.{key}").eqNullSafe(F.col(f"k.{key}")))
    return joined.select(
        "r.*", "k.group_id", "k.group_size", (F.col("_index") - F.col("_start")).alias("group_rank")
    ).drop("_index")


def parent_directories(rows: DataFrame) -> DataFrame:
    """The distinct directories that hold the rows."""
    return rows.select(paths.dirname("path").alias("parent")).distinct()
