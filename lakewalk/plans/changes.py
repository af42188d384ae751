"""Plans of changes to one tree: modes and owners, links, removals, copies, directories, layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewalk import schema
from lakewalk.functions import modes, paths
from lakewalk.operators import filters


def chmod(rows: DataFrame, change: str, umask: int = 0o022, force: bool = False) -> DataFrame:
    """path, old_mode and new_mode (low twelve bits) of the entries that a change of modes changes, or of all with
    ``force``. Links and entries with unknown modes are left alone."""
    new = modes.changed(F.col("mode"), F.col("type") == schema.DIRECTORY, change, umask)
    planned = rows.filter((F.col("type") != schema.LINK) & F.col("mode").isNotNull()).select(
        "path", F.col("mode").bitwiseAND(0o7777).alias("old_mode"), new.alias("new_mode")
    )
    return planned if force else planned.filter("old_mode <> new_mode")


def chown(rows: DataFrame, uid: int | None = None, gid: int | None = None, force: bool = False) -> DataFrame:
    """path with old and new owners, where they change."""
    known = rows.filter(F.col("uid").isNotNull() & F.col("gid").isNotNull())
    planned = known.select(
        "path",
        F.col("uid").alias("old_uid"),
        F.col("gid").alias("old_gid"),
        (F.col("uid") if uid is None else F.lit(uid)).cast("bigint").alias("new_uid"),
        (F.col("gid") if gid is None else F.lit(gid)).cast("bigint").alias("new_gid"),
    )
    return planned if force else planned.filter("old_uid <> new_uid OR old_gid <> new_gid")


def relink(rows: DataFrame, old: str, new: str, relative: bool = False) -> DataFrame:
    """path, old_target and new_target of the links whose absolute target lies below ``old``, moved to ``new``; relative to
    the link's directory if wanted, where the directory itself is '.'."""
    links = filters.links_below(rows, old)
    moved = F.concat(F.lit(new.rstrip("/")), F.substring("target", len(old.rstrip("/")) + 1, 2**31 - 1))
    if relative:
        way = paths.relative(paths.dirname("path"), moved)
        moved = F.when(way == "", ".").otherwise(way)
    return links.select("path", F.col("link_target").alias("old_target"), moved.alias("new_target"))


def remove(rows: DataFrame) -> DataFrame:
    """path, type, depth and step, in the order of removal: all but directories first, at step 0, then directories level by
    level, deepest first."""
    directory = F.col("type") == schema.DIRECTORY
    planned = rows.select("path", "type", "depth", directory.alias("directory"))
    deepest = planned.filter("directory").agg(F.max("depth")).first()[0] or 0
    step = F.when(F.col("directory"), F.lit(deepest + 1) - F.col("depth")).otherwise(0)
    return planned.select("path", "type", "depth", step.alias("step")).orderBy("step", "path")


def make_directories(rows: DataFrame) -> DataFrame:
    """Directories with their modes, from the top."""
    return rows.filter(F.col("type") == schema.DIRECTORY).select(
        "path", "depth", "mode", "uid", "gid"
    ).orderBy("depth", "path")


def copy(rows: DataFrame, source: str, dest: str) -> DataFrame:
    """path, destination, action and bytes of everything at or below ``source``."""
    action = F.when(
        F.col("type") == schema.DIRECTORY, "MKDIR"
    ).when(F.col("type") == schema.LINK, "SYMLINK").when(F.col("type") == schema.FILE, "COPY").otherwise("MKNOD")
    size = F.when(F.col("type") == schema.FILE, F.coalesce("size", F.lit(0))).otherwise(0)
    inside = rows.filter(paths.is_below("path", source, inclusive=True))
    return inside.select(
        "path",
        paths.destination("path", source, dest).alias("destination"),
        action.alias("action"),
        size.cast("bigint").alias("bytes"),
    )


def launch_order(planned: DataFrame) -> DataFrame:
    """Copies, the largest first."""
    return planned.filter("action = 'COPY'").orderBy(F.col("bytes").desc(), "path")


def check_copy(sources: list[tuple[str, int]], dest: str, dest_type: int | None, parent_exists: bool = True) -> bool:
    """Whether sources (path, type) may be copied to ``dest``, and if so whether into it (True) or as it (False).

    Several sources need an existing directory; one directory can't replace a file; a missing destination needs a
    parent. ValueError otherwise.
    """
    if not sources:
        raise ValueError("nothing to copy")
    if dest_type == schema.DIRECTORY:
        return True
    if len(sources) > 1:
        raise ValueError(f"several sources need a directory: {dest!r}")
    if dest_type is not None and sources[0][1] == schema.DIRECTORY:
        raise ValueError(f"a directory can't replace {dest!r}")
    if dest_type is None and not parent_exists:
        raise ValueError(f"no directory to hold {dest!r}")
    return False


def restripe(rows: DataFrame, least_size: int, stripes: int, stripe_size: int) -> tuple[DataFrame, DataFrame]:
    """The files to lay out anew, and one row with their number and bytes."""
    planned = filters.restripeable(rows, least_size, stripes, stripe_size)
    return planned, planned.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def hard_links(rows: DataFrame) -> DataFrame:
    """Files that share dev and ino: the least path, which is kept, and each other path, to be linked to it."""
    files = rows.filter(
        (F.col("type") == schema.FILE) & F.col("dev").isNotNull() & F.col("ino").isNotNull()
    ).select("dev", "ino", "path").distinct()
    first = files.groupBy("dev", "ino").agg(F.min("path").alias("target"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return files.join(first, ["dev", "ino"]).filter("path <> target").select("path", "target")


def with_parents(rows: DataFrame, cwd: str) -> DataFrame:
    """The paths of ``rows`` and of every directory strictly between ``cwd`` and them. Paths outside raise an error when
    the plan runs."""
    inside = rows.select(
        F.when(paths.is_below("path", cwd), F.col("path")).otherwise(
            F.raise_error(F.concat(F.lit(f"not below {cwd}: "), "path"))
        ).alias("path")
    )
    above = inside.select(F.explode(F.filter(paths.ancestors("path"), lambda p: paths.is_below(p, cwd))).alias("path"))
    return inside.unionAll(above).distinct()
