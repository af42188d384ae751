"""Filters and splits of inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewalk import schema
from lakewalk.functions import paths, patterns, units

#: What makes an entry suspicious. Fixed values.
BAD_SIZE, BAD_TIME, MISSING, UNREADABLE = 1, 2, 4, 8
LARGEST_FILE, OLDEST_DAYS = 2**50, 3650


def matching(rows: DataFrame, pattern: str | None, exclude: bool = False, on_name: bool = False) -> DataFrame:
    """Rows whose path (or last component) has a basic regular expression in it, or hasn't. Without a pattern: none."""
    if pattern is None:
        return rows.limit(0)
    found = (paths.basename("path") if on_name else F.col("path")).rlike(patterns.basic(pattern))
    return rows.filter(~found if exclude else found)


def split(rows: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """The rows for which the condition holds, and all others, those with a null result among them."""
    holds = F.coalesce(condition, F.lit(False))
    return rows.filter(holds), rows.filter(~holds)


def subtree(rows: DataFrame, root: str, inclusive: bool = False) -> tuple[DataFrame, DataFrame]:
    """What lies below ``root`` (with it, if inclusive), and the rest."""
    return split(rows, paths.is_below("path", root, inclusive))


def children_like(rows: DataFrame, root: str, argument: str) -> tuple[DataFrame, DataFrame]:
    """What lies below children of ``root`` whose names match (``*``: any characters), with those, and the rest."""
    return split(rows, paths.child_of("path", root).rlike(patterns.child_pattern(argument)))


def purgeable(rows: DataFrame, now: int, days: int = 60) -> DataFrame:
    """Files and links whose atime and ctime are both more than ``days`` days back."""
    old = lambda c: F.lit(now) - F.col(c) > days * 86400
    return rows.filter(F.col("type").isin(schema.FILE, schema.LINK) & old("atime") & old("ctime"))


def restripeable(rows: DataFrame, least_size: int, stripes: int, stripe_size: int) -> DataFrame:
    """Regular files of at least ``least_size`` bytes whose stripe_count or stripe_size isn't the wanted one. Files whose
    layout is unknown (null) aren't listed."""
    wrong = (F.col("stripe_count") != stripes) | (F.col("stripe_size") != stripe_size)
    return rows.filter((F.col("type") == schema.FILE) & (F.col("size") >= least_size) & wrong)


def nonempty_files(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("type") == schema.FILE) & (F.col("size") > 0))


def one_device(rows: DataFrame, top: str) -> DataFrame:
    """Rows on the device of the top directory they lie in, which the column ``top`` names; rows whose top directory has no
    known device are kept."""
    devices = rows.filter(
        (F.col("path") == F.col(top)) & F.col("dev").isNotNull()
    ).groupBy(F.col(top).alias("_top")).agg(F.min("dev").alias("_dev"))
    joined = rows.join(devices, F.col(top) == F.col("_top"), "left")
    return joined.filter(F.col("_dev").isNull() | (F.col("dev") == F.col("_dev"))).drop("_top", "_dev")


def flags(now: int, error: str | None = None) -> Column:
    """Bits of what is wrong with an entry: a file over 2**50 bytes, a time ahead or more than 3650 days back, and, from
    the column ``error`` of a walk, what went missing or couldn't be read."""
    late = [(F.col(c) > now) | (F.col(c) < now - OLDEST_DAYS * 86400) for c in ("atime", "mtime", "ctime")]
    bits = F.when((F.col("type") == schema.FILE) & (F.col("size") > LARGEST_FILE), BAD_SIZE).otherwise(0)
    bits = bits + F.when(late[0] | late[1] | late[2], BAD_TIME).otherwise(0)
    if error:
        bits = bits + F.when(F.col(error) == "missing", MISSING).when(F.col(error).isNotNull(), UNREADABLE).otherwise(0)
    return bits


def broken(rows: DataFrame, now: int, error: str | None = None) -> DataFrame:
    """The rows with something wrong, and in ``flags`` what."""
    return rows.withColumn("flags", flags(now, error)).filter("flags <> 0")


def broken_sample(rows: DataFrame, now: int, limit: int, error: str | None = None) -> DataFrame:
    """The first ``limit`` broken paths in the order of paths: a report's sample; ``broken`` gives all of them."""
    return broken(rows, now, error).select("path", "flags").orderBy("path", "flags").limit(limit)


def links_below(rows: DataFrame, root: str) -> DataFrame:
    """Links whose absolute target lies strictly below ``root``, with the reduced target."""
    target = paths.reduced("link_target")
    links = rows.filter((F.col("type") == schema.LINK) & F.col("link_target").startswith("/"))
    return links.withColumn("target", target).filter(paths.is_below(F.col("target"), root))


def grep(rows: DataFrame, pattern: str, extended: bool = False) -> DataFrame:
    """path, line_no (from 1) and line of every line of regular files' content with the expression in it."""
    lines = rows.filter(F.col("type") == schema.FILE).select(
        "path", F.posexplode(F.split("content", "\n")).alias("at", "line")
    )
    return lines.filter(
        F.col("line").rlike(patterns.extended(pattern) if extended else patterns.basic(pattern))
    ).select("path", (F.col("at") + 1).alias("line_no"), "line")


def under(rows: DataFrame, *roots: str) -> DataFrame:
    """Rows with ``root``, the one of the roots they lie in; a row in several roots comes once for each."""
    each = F.explode(F.array_compact(F.array(*[F.when(paths.is_below("path", r, True), r) for r in roots])))
    return rows.withColumn("root", each)


def size_range(least: str | None = None, most: str | None = None) -> Column:
    """Sizes from ``least`` to ``most``, both given with units."""
    condition = F.lit(True)
    if least is not None:
        condition = condition & (F.col("size") >= units.parse_size(least))
    if most is not None:
        condition = condition & (F.col("size") <= units.parse_size(most))
    return condition
