"""What has to be done to make a destination like its source: plans as rows, nothing is executed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewalk import schema
from lakewalk.functions import hashes, modes, paths
from lakewalk.operators.compare import paired

#: Actions in the order in which they have to run. Fixed values.
ACTIONS = ["REMOVE", "MKDIR", "SYMLINK_UPDATE", "COPY", "META_UPDATE"]
STAT = ["mode", "uid", "gid", "mtime", "mtime_nsec", "atime", "atime_nsec"]


class UnsafeSync(RuntimeError):
    """The plan would do harm; see ``check``."""


def check(
    src: DataFrame, delete: bool = False, source_errors: bool = False, chown: bool = False, link_dest: bool = False
) -> bool:
    """Whether the plan may delete. An empty source, and owners or modes that are replaced along with hard links, raise
    UnsafeSync; errors in the scan of the source, also those that its rows tell of in ``error`` (directories that couldn't be
    listed), forbid deletions."""
    if src.isEmpty():
        raise UnsafeSync("the source is empty")
    if chown and link_dest:
        raise UnsafeSync("replaced owners or modes would change the linked files too")
    return delete and not source_errors and ("error" not in src.columns or src.filter("error IS NOT NULL").isEmpty())


def override(
    src: DataFrame,
    uid: int | None = None,
    gid: int | None = None,
    file_bits: int | None = None,
    directory_bits: int | None = None,
) -> DataFrame:
    """The source as if it had other owners and modes, so that the differences show up as updates. Links keep their modes."""
    mode = modes.overridden(F.col("mode"), F.col("type"), file_bits, directory_bits)
    out = src.withColumn("mode", mode)
    return out.withColumns({k: F.lit(v).cast("bigint") for k, v in (("uid", uid), ("gid", gid)) if v is not None})


def without_links(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("type") != schema.LINK)


def _differs(*names: str) -> Column:
    found = F.lit(False)
    for n in names:
        found = found | ~F.col(f"s.{n}").eqNullSafe(F.col(f"d.{n}"))
    return found


def _action(name: str, when: Column, side: str = "s", size: Column | None = None, target: bool = False) -> Column:
    fields = [F.col(f"{side}.{c}").alias(c) for c in STAT]
    made = F.struct(
        F.lit(name).alias("action"),
        (F.lit(0) if size is None else size).cast("bigint").alias("size"),
        *fields,
        (F.col("s.link_target") if target else F.lit(None).cast("string")).alias("link_target"),
    )
    return F.when(when, made)


def actions(src: DataFrame, dst: DataFrame, delete: bool = True, contents: bool = False) -> DataFrame:
    """relpath, action, size, mode, uid, gid, times and link_target: the planner's actions for two sides (relative_rows).

    Differing types: REMOVE, then what creates the entry. Files: COPY if the size differs, or the digest (``contents``; a
    missing one differs) or else the mtime; otherwise META_UPDATE if mode, uid, gid or mtime differ. Links:
    SYMLINK_UPDATE if the target differs (null is the empty target), otherwise META_UPDATE as above. Other entries:
    META_UPDATE as above or if the size differs. Entries of the source alone are created, those of the destination alone
    removed if ``delete``.
    """
    both, s, d = F.col("s").isNotNull() & F.col("d").isNotNull(), F.col("s").isNotNull(), F.col("d").isNotNull()
    kind = F.col("s.type")
    retyped = both & (F.col("s.type") != F.col("d.type"))
    same = both & (F.col("s.type") == F.col("d.type"))
    create = retyped | (s & ~d)
    identity = _differs("mode", "uid", "gid", "mtime", "mtime_nsec")
    data = _differs("size") | (
        (
            F.col("s.digest").isNull() | F.col("d.digest").isNull() | _differs("digest")
        ) if contents else _differs("mtime", "mtime_nsec")
    )
    target = F.coalesce("s.link_target", F.lit("")) != F.coalesce("d.link_target", F.lit(""))
    is_file, is_link = kind == schema.FILE, kind == schema.LINK
    update = same & F.when(is_file, ~data & identity).when(
        is_link, ~target & identity
    ).otherwise(identity | _differs("size"))
    steps = [
        _action("REMOVE", retyped | (d & ~s if delete else F.lit(False)), "d"),
        _action("MKDIR", create & (kind == schema.DIRECTORY), size=F.col("s.size")),
        _action(
            "SYMLINK_UPDATE",
            (create | (same & target)) & is_link,
            size=F.when(create, F.col("s.size")).otherwise(0),
            target=True,
        ),
        _action(
            "COPY", (create & ~kind.isin(schema.DIRECTORY, schema.LINK)) | (same & is_file & data), size=F.col("s.size")
        ),
        _action("META_UPDATE", update, target=False),
    ]
    return paired(src, dst).select(
        "relpath", F.explode(F.array_compact(F.array(*steps))).alias("a")
    ).select("relpath", "a.*")


def in_order(planned: DataFrame) -> DataFrame:
    """Sorted for execution, with the columns of the order: removals deepest first, directories from the top, then links,
    copies and updates; ties by path."""
    priority = F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col("action")).cast("int") - 1
    depth = paths.relative_depth("relpath")
    level = F.when(F.col("action") == "REMOVE", -depth).when(F.col("action") == "MKDIR", depth).otherwise(0)
    return planned.withColumn("priority", priority).withColumn("level", level).orderBy("priority", "level", "relpath")


def deferred(planned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The actions that can run batch by batch, and those on directories that have to wait for the end of all batches
    (removals and updates of directories), deepest first."""
    late = F.col("action").isin("REMOVE", "META_UPDATE") & (
        F.col("mode").bitwiseAND(schema.FORMAT_MASK) == schema.DIRECTORY_MODE
    )
    return planned.filter(~late), planned.filter(late).orderBy(paths.relative_depth("relpath").desc(), "relpath")


def owned(planned: DataFrame, source_workers: int, destination_workers: int) -> DataFrame:
    """The actions with the workers that read and write them: src_owner (-1 for removals, which read nothing), dst_owner."""
    src = F.when(F.col("action") == "REMOVE", -1).otherwise(
        hashes.bucket(F.col("relpath"), source_workers, hashes.SOURCE_OWNER)
    )
    return planned.withColumn("src_owner", src).withColumn(
        "dst_owner", hashes.bucket(F.col("relpath"), destination_workers, hashes.DESTINATION_OWNER)
    )


def action_counts(planned: DataFrame, skipped: int = 0) -> DataFrame:
    """One row: how often each action occurs, and what was left in place."""
    counts = [
        F.count_if(F.col("action") == a).alias(a.lower()) for a in (
            "COPY", "REMOVE", "MKDIR", "SYMLINK_UPDATE", "META_UPDATE"
        )
    ]
    return planned.agg(*counts).withColumn("skipped_only_dst", F.lit(skipped).cast("bigint"))


def mirror(
    src: DataFrame, dst: DataFrame, delete: bool = False, contents: bool = False, nanoseconds: bool = True
) -> DataFrame:
    """relpath, do_remove, do_copy, do_refresh, content_differs: the mirror tool's lists, for entries with something to do.

    Of the source alone: copy. Differing types, link targets, or files whose size differs: remove and copy. Other files:
    by mtime, with nanoseconds only if wanted (the tool wants them if both roots have some), remove and copy; or with
    ``contents`` by their content, which is then overwritten in place (copy alone). An entry of both sides is refreshed if
    uid, gid, permission bits, or atime or mtime in whole seconds differ. Of the destination alone: remove, if ``delete``.
    """
    both, s, d = F.col("s").isNotNull() & F.col("d").isNotNull(), F.col("s").isNotNull(), F.col("d").isNotNull()
    format_s, format_d = modes.format_bits(F.col("s.mode")), modes.format_bits(F.col("d.mode"))
    regular = format_d == schema.REGULAR
    times = _differs("mtime", "mtime_nsec") if nanoseconds else _differs("mtime")
    replaced = both & F.when(format_s != format_d, True).when(format_d == schema.LINK_MODE, _differs("link_target")).when(
        regular, _differs("size") | (F.lit(False) if contents else times)
    ).otherwise(False)
    overwritten = both & (
        format_s == format_d
    ) & regular & ~_differs("size") & _differs("content") if contents else F.lit(False)
    refresh = both & (
        _differs("uid", "gid", "atime", "mtime") | (
            modes.permissions(F.col("s.mode")) != modes.permissions(F.col("d.mode"))
        )
    )
    remove = replaced | (d & ~s & F.lit(delete))
    listed = paired(src, dst).select(
        "relpath",
        F.coalesce(remove, F.lit(False)).alias("do_remove"),
        F.coalesce((s & ~d) | replaced | overwritten, F.lit(False)).alias("do_copy"),
        F.coalesce(refresh, F.lit(False)).alias("do_refresh"),
        F.coalesce(replaced | overwritten, F.lit(False)).alias("content_differs"),
    )
    return listed.filter("do_remove OR do_copy OR do_refresh")


def with_links(src: DataFrame, dst: DataFrame, link: DataFrame, nanoseconds: bool = True) -> DataFrame:
    """relpath and how: 'hardlink', 'copy' or 'replace' (remove, then hard link), against a third tree ``link``.

    What would be copied is hard-linked instead if it is no directory or link and ``link`` has it with the same type, size
    and mtime. A file of the destination that is like the source is replaced by a hard link if ``link`` has it too, unless
    it is that inode already (dev and ino, where both trees have them).
    """
    pairs = paired(src, dst).filter(F.col("s").isNotNull())
    third = link.select("relpath", F.struct(*[c for c in link.columns if c != "relpath"]).alias("l"))
    joined = pairs.join(third, "relpath", "left")
    same_as = lambda o: (F.col(f"{o}.type") == F.col("s.type")) & (F.col(f"{o}.size") == F.col("s.size")) & (F.col(f"{o}.mtime") == F.col("s.mtime")) & (
        (F.col(f"{o}.mtime_nsec") == F.col("s.mtime_nsec")) if nanoseconds else F.lit(True)
    )
    linkable = F.coalesce(~F.col("s.type").isin(schema.DIRECTORY, schema.LINK) & same_as("l"), F.lit(False))
    there = F.coalesce(
        F.when(
            F.col("s.type") == schema.LINK,
            (F.col("d.type") == schema.LINK) & F.col("s.link_target").eqNullSafe(F.col("d.link_target")),
        ).when(F.col("s.type") == schema.DIRECTORY, F.col("d.type") == schema.DIRECTORY).otherwise(same_as("d")),
        F.lit(False),
    )
    inode = (
        F.col("l.dev") == F.col("d.dev")
    ) & (F.col("l.ino") == F.col("d.ino")) if {"dev", "ino"} <= set(dst.columns) & set(link.columns) else F.lit(False)
    how = F.when(~there & linkable, "hardlink").when(~there, "copy").when(
        linkable & ~F.coalesce(inode, F.lit(False)), "replace"
    )
    return joined.select("relpath", how.alias("how")).filter("how IS NOT NULL")
