"""The inventory: one row per entry of a file tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Codes of entry types. Fixed values, as persisted in list caches.
UNKNOWN, FILE, DIRECTORY, LINK = 1, 2, 3, 4
#: Bits of a mode. Fixed values of POSIX.
FORMAT_MASK, REGULAR, DIRECTORY_MODE, LINK_MODE = 0o170000, 0o100000, 0o040000, 0o120000
BLOCK_DEVICE, CHARACTER_DEVICE, FIFO, SOCKET = 0o060000, 0o020000, 0o010000, 0o140000

LITE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("type", T.IntegerType()),
    ]
)
_STAT = ["uid", "gid", "size", "atime", "atime_nsec", "mtime", "mtime_nsec", "ctime", "ctime_nsec"]
INVENTORY = T.StructType(
    [*LITE.fields, T.StructField("mode", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in _STAT]]
)
EXTENDED = T.StructType(
    [
        *INVENTORY.fields,
        *[T.StructField(c, T.LongType()) for c in ("dev", "ino", "btime")],
        T.StructField("link_target", T.StringType()),
    ]
)


def with_names(rows: DataFrame, users: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with user and group: the name of uid and gid, or the id in decimal where it has none; null for null ids.

    Of several names of an id the least counts. The dimensions are joined as Spark finds best: users grow with the data.
    """
    names = users.groupBy(F.col("uid")).agg(F.min("name").alias("user"))
    group_names = groups.groupBy(F.col("gid")).agg(F.min("name").alias("group"))
    named = rows.join(names, "uid", "left").join(group_names, "gid", "left")
    return named.withColumn("user", F.coalesce("user", F.col("uid").cast("string"))).withColumn(
        "group", F.coalesce("group", F.col("gid").cast("string"))
    )


def combined(*inventories: DataFrame) -> DataFrame:
    """Several walks in one inventory. Entries that more than one walk saw are kept as often as they were seen."""
    first, *rest = inventories
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
