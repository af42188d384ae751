"""Profiles: counts, histograms, hot and cold capacity, roll-ups."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewalk import schema
from lakewalk.functions import paths, patterns, units
from lakewalk.functions.units import parse_size

#: Upper ends of the profile's classes, which include them; None is open. Fixed values.
SIZE_ENDS = [4 << 10, 64 << 10, 1 << 20, 16 << 20, 256 << 20, 1 << 30, 16 << 30, 256 << 30, 4 << 40, None]
AGE_ENDS = [1, 7, 30, 90, 180, 365, 1095, 3650, None]
HOT_DAYS = [1, 30, 90, 180, 365]


def _sum(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0))


def summary(rows: DataFrame) -> DataFrame:
    """One row: entries by type, bytes of regular files and bytes per file (cut off; 0 without files)."""
    of = lambda t: F.count_if(F.col("type") == t)
    size = _sum(F.when(F.col("type") == schema.FILE, F.col("size")))
    counted = rows.agg(
        F.count(F.lit(1)).alias("items"),
        of(schema.DIRECTORY).alias("directories"),
        of(schema.FILE).alias("files"),
        of(schema.LINK).alias("links"),
        F.count_if(~F.coalesce("type", F.lit(0)).isin(schema.DIRECTORY, schema.FILE, schema.LINK)).alias("unknown"),
        size.alias("bytes"),
    )
    return counted.withColumn("bytes_per_file", F.when(F.col("files") > 0, F.expr("bytes div files")).otherwise(0))


def statistics(rows: DataFrame) -> DataFrame:
    """One row: entries, the longest path in bytes with a final NUL, least and greatest depth."""
    return rows.agg(
        F.count(F.lit(1)).alias("items"),
        (F.max(F.octet_length("path")) + 1).alias("longest"),
        F.min("depth").alias("min_depth"),
        F.max("depth").alias("max_depth"),
    )


def type_counts(rows: DataFrame, now: int) -> DataFrame:
    """One row: files, directories, links, others, failed stats and suspicious entries."""
    from lakewalk.operators.filters import flags

    of = lambda t: F.count_if(F.col("type") == t)
    return rows.agg(
        of(schema.FILE).alias("files"),
        of(schema.DIRECTORY).alias("directories"),
        of(schema.LINK).alias("links"),
        F.count_if(F.col("type") == schema.UNKNOWN).alias("others"),
        F.count_if(F.col("mode").isNull()).alias("scan_errors"),
        F.count_if(flags(now) != 0).alias("broken"),
    )


def bin_of(value: Column, ends: Sequence[int | None]) -> Column:
    """The first class whose upper end isn't passed; null for null."""
    found = F
    for i, end in enumerate(ends):
        found = found.when(value.isNotNull() if end is None else value <= end, i)
    return found


def bins(spark, ends: Sequence[int | None], first: int = 0) -> DataFrame:
    rows = [(i, first if i == 0 else ends[i - 1], end) for i, end in enumerate(ends)]
    return spark.createDataFrame(rows, "bin int, lower bigint, upper bigint")


def filled(counted: DataFrame, table: DataFrame, *values: str) -> DataFrame:
    """Every class, with 0 where nothing fell into it."""
    joined = table.join(counted, "bin", "left")
    return joined.select("bin", "lower", "upper", *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def histogram(rows: DataFrame, value: Column, ends: Sequence[int | None]) -> DataFrame:
    """bin, lower, upper, number: how many rows fall into each class, empty classes included."""
    counted = rows.select(bin_of(value, ends).alias("bin")).filter("bin IS NOT NULL").groupBy("bin").agg(
        F.count(F.lit(1)).alias("number")
    )
    return filled(counted, bins(rows.sparkSession, ends), "number")


def default_ends(largest: int | None) -> list[int]:
    """1 and the powers of 2**10 up to the first that isn't below the largest size (by its logarithm as a double)."""
    bits = math.ceil(math.log2(largest) / 10) * 10 if largest and largest > 1 else 0
    return [1, *(1 << k for k in range(10, bits + 1, 10))]


def size_histogram(rows: DataFrame) -> DataFrame:
    """Sizes of entries of all types in the default classes, of which the last takes what the logarithm rounded away."""
    ends = default_ends(rows.agg(F.max("size")).first()[0])
    return histogram(rows, F.when(F.col("size").isNotNull(), F.least("size", F.lit(ends[-1]))), ends)


def parse_distribution(text: str) -> list[int | None]:
    """'size:1k,1m' as upper ends, sorted and without repetition, and an open one. At most 128; ValueError otherwise."""
    kind, _, rest = text.partition(":")
    ends = sorted({parse_size(x) for x in rest.split(",") if x})
    if kind != "size" or not ends or len(ends) > 128:
        raise ValueError(f"not a distribution: {text!r}")
    return [*ends, None]


def size_distribution(rows: DataFrame, text: str) -> DataFrame:
    """Sizes of entries of all types in classes of the caller's."""
    return histogram(rows, F.col("size"), parse_distribution(text))


def file_size_profile(rows: DataFrame) -> DataFrame:
    """Regular files by size in the profile's ten classes, with their labels."""
    found = histogram(rows.filter(F.col("type") == schema.FILE), F.col("size"), SIZE_ENDS)
    return found.withColumn("label", units.interval_label(F.col("lower"), F.col("upper")))


def age_profile(rows: DataFrame, now: int) -> DataFrame:
    """Bytes of regular files by age, for each of atime, mtime and ctime: field, bin, lower, upper, bytes."""
    files = rows.filter((F.col("type") == schema.FILE) & F.col("size").isNotNull())
    each = F.explode(
        F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("t")) for c in ("atime", "mtime", "ctime")])
    ).alias("a")
    aged = files.select(each, "size").select(
        F.col("a.field").alias("field"), bin_of(units.age_days(F.col("a.t"), now), AGE_ENDS).alias("bin"), "size"
    )
    counted = aged.filter("bin IS NOT NULL").groupBy("field", "bin").agg(F.sum("size").alias("bytes"))
    spark = rows.sparkSession
    # Three fields by nine classes.
    every = spark.createDataFrame(
        [(f, i, AGE_ENDS[i - 1] if i else 0, e) for f in ("atime", "mtime", "ctime") for i, e in enumerate(AGE_ENDS)],
        "field string, bin int, lower bigint, upper bigint",
    )
    return every.join(counted, ["field", "bin"], "left").select(
        "field", "bin", "lower", "upper", F.coalesce("bytes", F.lit(0)).alias("bytes")
    )


def hot_cold(rows: DataFrame, top: str, now: int, days: int, field: str = "atime") -> DataFrame:
    """Per top directory (the column ``top``): bytes of regular files, bytes unused for at least ``days`` days, their ratio
    (0 without bytes), failed stats, and bytes at most 1, 30, 90, 180 and 365 days old. Rows without a top don't count."""
    age, size = units.age_days(F.col(field), now), F.when(F.col("type") == schema.FILE, F.col("size"))
    counted = rows.filter(F.col(top).isNotNull()).groupBy(F.col(top).alias("directory")).agg(
        _sum(size).alias("total"), _sum(F.when(age >= days, size)).alias("cold"), F.count_if(F.col("mode").isNull()).alias("errors"), *[
            _sum(F.when(age <= d, size)).alias(f"day{d}") for d in HOT_DAYS
        ]
    )
    return counted.withColumn("ratio", F.when(F.col("total") > 0, F.col("cold") / F.col("total")).otherwise(0.0))


def top_directories(rows: DataFrame, root: str, exclude: str | None = None) -> DataFrame:
    """The directories right below ``root``; ``exclude`` is an extended regular expression for their whole paths."""
    found = rows.filter((F.col("type") == schema.DIRECTORY) & (paths.dirname("path") == root))
    return found.filter(~F.col("path").rlike(patterns.extended(exclude))) if exclude else found


def implied_directories(rows: DataFrame) -> DataFrame:
    """path, depth and type of every directory that the rows' paths go through, listed or not."""
    above = rows.select(F.explode(paths.ancestors("path")).alias("path")).distinct()
    return above.select("path", paths.depth("path").cast("int").alias("depth"), F.lit(schema.DIRECTORY).alias("type"))


def with_top(rows: DataFrame, root: str) -> DataFrame:
    """``rows`` with the column ``top``: the entry right below ``root`` that they lie in; null elsewhere."""
    return rows.withColumn("top", F.concat(F.lit(root.rstrip("/") + "/"), paths.child_of("path", root)))


def unique_inodes(rows: DataFrame) -> DataFrame:
    """Of rows with the same dev and ino the one with the least path; rows where either is null are all kept.

    Hard links are aggregated as structs, combined before the shuffle; no window holds a group.
    """
    others = [c for c in rows.columns if c not in ("dev", "ino", "path")]
    known = rows.filter("dev IS NOT NULL AND ino IS NOT NULL").groupBy("dev", "ino").agg(
        F.min(F.struct("path", *others)).alias("r")
    ).select("dev", "ino", "r.*")
    return known.select(*rows.columns).unionByName(rows.filter("dev IS NULL OR ino IS NULL"))


def roll_up(rows: DataFrame, root: str, limit: int | None = None) -> DataFrame:
    """Per entry right below ``root``: entries in it and their bytes, of all types; largest first, then by name. ``limit``
    is the report's length."""
    counted = rows.filter(paths.is_below("path", root)).select(paths.child_of("path", root).alias("child"), "size").groupBy("child").agg(
        F.count(F.lit(1)).alias("items"), _sum(F.col("size")).alias("bytes")
    )
    ordered = counted.orderBy(F.col("bytes").desc(), "child")
    return ordered if limit is None or limit < 0 else ordered.limit(limit)


def totals(rows: DataFrame) -> DataFrame:
    """One row: entries, bytes of regular files, and entries and bytes per second between the first and last received_at."""
    took = F.greatest(
        F.lit(1.0),
        (
            F.unix_micros(
                F.max(F.col("received_at").cast("timestamp"))
            ) - F.unix_micros(F.min(F.col("received_at").cast("timestamp")))
        ) / 1e6,
    )
    counted = rows.agg(
        F.count(F.lit(1)).alias("items"),
        _sum(F.when(F.col("type") == schema.FILE, F.col("size"))).alias("bytes"),
        took.alias("seconds"),
    )
    return counted.withColumn(
        "items_per_second", F.col("items") / F.col("seconds")
    ).withColumn("bytes_per_second", F.col("bytes") / F.col("seconds"))
