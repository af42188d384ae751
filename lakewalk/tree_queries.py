"""Queries over contents, over a tree that they make in the shared folder, and over batches, with the SQL they are checked
against. The made tree is that of ``synthetic.tree`` with files of up to 2,000 bytes, whatever the tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewalk import queries as q
from lakewalk import schema
from lakewalk.functions import paths
from lakewalk.operators import compare, order, predicates, progress
from lakewalk.pipeline_queries import DST_ROOT, SRC_ROOT, table
from lakewalk.plans import changes, sync
from lakewalk.sources import archives, synthetic, walk
from lakewalk.storage import new_folder
from lakewalk.streaming import profile as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# Comparison by contents -------------------------------------------------------------------------------------------------


def _copies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The fragments as two trees: either lacks some paths, and in the second a digit is another in all contents."""
    mode = F.when(F.col("type") == 2, 0o100644).when(F.col("type") == 3, 0o040755).when(F.col("type") == 4, 0o120777).otherwise(0o010644)
    zero = F.lit(0).cast("bigint")
    rows = table(spark, d, "fragments").select(
        "frag_id", "path", "type", "size", "mtime", "content", mode.alias("mode"), zero.alias("uid"), zero.alias("gid"), zero.alias("mtime_nsec"),
        F.col("mtime").alias("atime"), zero.alias("atime_nsec"), F.lit(None).cast("string").alias("link_target"),
    )
    src = rows.filter(~F.col("path").contains("9"))
    dst = rows.filter(~F.col("path").contains("5")).withColumn("content", F.translate("content", "1", "2"))
    return tuple(compare.relative_rows(x, "/", "frag_id") for x in (src, dst))


def _copy_sql(without: str, content: str) -> str:
    return f"(SELECT * EXCLUDE (content, path, r), {content} AS content FROM (SELECT *, substring(path, 2) AS relpath, row_number() OVER (PARTITION BY path ORDER BY frag_id) AS r FROM fragments WHERE NOT contains(path, '{without}')) WHERE r = 1)"


_CONTENTS = f"""
WITH s AS {_copy_sql('9', 'content')}, d AS {_copy_sql('5', "replace(content, '1', '2')")},
j AS (SELECT coalesce(s.relpath, d.relpath) AS relpath, s, d, s.relpath IS NOT NULL AND d.relpath IS NOT NULL AS b, s.relpath IS NOT NULL AS hs, d.relpath IS NOT NULL AS hd,
    s.size IS DISTINCT FROM d.size AS sizes, s.content IS DISTINCT FROM d.content AS bodies FROM s FULL JOIN d ON s.relpath = d.relpath)
"""


@query(_CONTENTS + """SELECT relpath, CASE WHEN b THEN 'COMMON' WHEN hs THEN 'ONLY_SRC' ELSE 'ONLY_DEST' END AS "EXIST", CASE WHEN b THEN CASE WHEN s.type = 3 OR NOT sizes THEN 'COMMON' ELSE 'DIFFER' END END AS "SIZE",
    CASE WHEN b THEN CASE WHEN s.type <> 2 OR NOT sizes AND NOT bodies THEN 'COMMON' ELSE 'DIFFER' END END AS "CONTENT" FROM j""")
def compare_contents(spark: SparkSession, d: str) -> DataFrame:
    """Two trees compared byte by byte."""
    return compare.states(*_copies(spark, d), ["CONTENT"], lite=False).select("relpath", "EXIST", "SIZE", "CONTENT")


@query(_CONTENTS + """, m AS (SELECT *, b AND s.type = 2 AND sizes AS replaced, b AND s.type = 2 AND NOT sizes AND bodies AS over FROM j)
    SELECT relpath, replaced OR NOT hs AS do_remove, replaced OR over OR NOT hd AS do_copy, false AS do_refresh, replaced OR over AS content_differs FROM m WHERE replaced OR over OR NOT b""")
def mirror_contents(spark: SparkSession, d: str) -> DataFrame:
    """The mirror tool's lists by contents: files of equal size that differ are overwritten in place."""
    return sync.mirror(*_copies(spark, d), delete=True, contents=True)


@query(_CONTENTS + """SELECT relpath, 'REMOVE' AS action, CAST(0 AS BIGINT) AS size FROM j WHERE NOT hs
    UNION ALL SELECT relpath, CASE s.type WHEN 3 THEN 'MKDIR' WHEN 4 THEN 'SYMLINK_UPDATE' ELSE 'COPY' END, s.size FROM j WHERE NOT hd
    UNION ALL SELECT relpath, 'COPY', s.size FROM j WHERE b AND s.type = 2 AND (sizes OR bodies OR s.content IS NULL)""")
def sync_contents(spark: SparkSession, d: str) -> DataFrame:
    """The planner's actions by digests of contents."""
    digest = F.when(F.col("type") == schema.FILE, F.sha2("content", 256))
    src, dst = (x.withColumn("digest", digest) for x in _copies(spark, d))
    return sync.actions(src, dst, contents=True).select("relpath", "action", "size")


@query(q._STATES + "SELECT 'only' AS file, relpath, 'src' AS side FROM st WHERE EXIST = 'ONLY_SRC' UNION ALL SELECT 'sizes', relpath, unnest(['src', 'dst']) FROM st WHERE EXIST = 'COMMON' AND SIZE = 'DIFFER'")
def compare_matched_files(spark: SparkSession, d: str) -> DataFrame:
    """Lists of what satisfies two expressions, written to the files they name and read again."""
    compared = compare.states(q.src(spark, d), q.dst(spark, d), ["EXIST", "SIZE"])
    at = new_folder(spark, "matched")
    compare.write_matched(compared, ["EXIST=ONLY_SRC:only", "EXIST=COMMON@SIZE=DIFFER:sizes", "EXIST=DIFFER"], at)
    read = lambda name: spark.read.schema("relpath string, side string").parquet(f"{at}/{name}")
    return read("only").withColumn("file", F.lit("only")).unionByName(read("sizes").withColumn("file", F.lit("sizes")))


@query(q._TREES + """SELECT relpath, CASE WHEN b THEN 'COMMON' WHEN hs THEN 'ONLY_SRC' ELSE 'ONLY_DEST' END AS "EXIST",
    CASE WHEN b THEN CASE WHEN s.uid IS NOT DISTINCT FROM d.uid AND s.gid IS NOT DISTINCT FROM d.gid THEN 'COMMON' ELSE 'DIFFER' END END AS "ACL" FROM j""")
def compare_acl(spark: SparkSession, d: str) -> DataFrame:
    """Access lists, as text columns of both sides."""
    acl = F.format_string("user:%s:rwx,group:%s:r-x", "uid", "gid")
    src, dst = (x.withColumn("acl", acl) for x in (q.src(spark, d), q.dst(spark, d)))
    return compare.states(src, dst, ["ACL"]).select("relpath", "EXIST", "ACL")


_PLAIN = q._ACTIONS.replace(f"s AS {q._side('src_tree', SRC_ROOT)}", f"s AS (SELECT * FROM {q._side('src_tree', SRC_ROOT)} WHERE type <> 4)").replace(
    f"d AS {q._side('dst_tree', DST_ROOT)}", f"d AS (SELECT * FROM {q._side('dst_tree', DST_ROOT)} WHERE type <> 4)"
)


@query(_PLAIN + "SELECT relpath, action, size FROM a")
def sync_without_links(spark: SparkSession, d: str) -> DataFrame:
    """The planner's actions with links left alone on both sides."""
    planned = sync.actions(sync.without_links(q.src(spark, d)), sync.without_links(q.dst(spark, d)))
    return planned.select("relpath", "action", "size")


@query("SELECT * FROM (VALUES ('whole', 'delete'), ('unlisted directory', 'keep'), ('empty', 'unsafe'), ('links with other owners', 'unsafe')) AS t(source, verdict)")
def sync_safety(spark: SparkSession, d: str) -> DataFrame:
    """Whether a plan with deletions may delete, for sources in several states."""
    src = q.src(spark, d)
    cases = {
        "whole": (src, {}),
        "unlisted directory": (src.withColumn("error", F.when(F.col("type") == schema.DIRECTORY, "unlistable")), {}),
        "empty": (src.limit(0), {}),
        "links with other owners": (src, {"chown": True, "link_dest": True}),
    }

    def verdict(rows: DataFrame, how: dict) -> str:
        try:
            return "delete" if sync.check(rows, delete=True, **how) else "keep"
        except sync.UnsafeSync:
            return "unsafe"

    return spark.createDataFrame([(n, verdict(*c)) for n, c in cases.items()], "source string, verdict string")


@query("SELECT * FROM (VALUES (1, 'into'), (2, 'as'), (3, 'error'), (4, 'error'), (5, 'error'), (6, 'into'), (7, 'as'), (8, 'error')) AS t(no, verdict)")
def copy_targets(spark: SparkSession, d: str) -> DataFrame:
    """Whether sources are copied into a destination, as it, or not at all."""
    file, other, folder = ("/a/f", schema.FILE), ("/a/g", schema.FILE), ("/a/d", schema.DIRECTORY)
    cases = [
        ([file], schema.DIRECTORY, True), ([file], None, True), ([file], None, False), ([file, other], schema.FILE, True),
        ([folder], schema.FILE, True), ([file, folder], schema.DIRECTORY, True), ([file], schema.FILE, True), ([], None, True),
    ]
    found = []
    for no, (sources, kind, parent) in enumerate(cases, 1):
        try:
            found.append((no, "into" if changes.check_copy(sources, "/b/x", kind, parent) else "as"))
        except ValueError:
            found.append((no, "error"))
    return spark.createDataFrame(found, "no int, verdict string")


# Order and batches ------------------------------------------------------------------------------------------------------


@query("""
    SELECT inv_id, CAST(coalesce(sum(size) OVER (PARTITION BY gid ORDER BY path, inv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
    CAST(coalesce(sum(size) OVER (PARTITION BY gid ORDER BY path DESC, inv_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS after FROM inventory""")
def segment_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Per group and in the order of paths, the bytes before each entry and after it."""
    rows, by = q.inventory(spark, d).select("inv_id", "gid", "path", "size"), [("path", False), ("inv_id", False)]
    before = order.segmented_before(rows, ["gid"], by, "size", "before")
    after = order.segmented_before(rows, ["gid"], by, "size", "after", backwards=True)
    return before.select("inv_id", "before").join(after.select("inv_id", "after"), "inv_id")


@query("SELECT depth - (SELECT min(depth) FROM inventory) AS list, inv_id FROM inventory WHERE depth IS NOT NULL")
def depth_lists(spark: SparkSession, d: str) -> DataFrame:
    """The inventory as lists, one for each depth, put together again with the place of each in the sequence."""
    lists = order.depth_lists(q.inventory(spark, d))
    first = lists[0][0] if lists else 0
    parts = [rows.select(F.lit(k - first).alias("list"), "inv_id") for k, rows in lists]
    none = q.inventory(spark, d).limit(0).select(F.lit(0).alias("list"), "inv_id")
    return schema.combined(*(parts or [none]))


@query("SELECT regexp_replace(path, '/[^/]*$', '') AS parent, count(*) AS n, CAST(1 AS BIGINT) AS places FROM inventory GROUP BY 1")
def spread_by_parent(spark: SparkSession, d: str) -> DataFrame:
    """Entries moved to the partition of their directory's hash: all of a directory meet."""
    parent = F.regexp_replace("path", "/[^/]*$", "")
    spread = order.spread_by(q.inventory(spark, d).select("path"), 16, parent)
    placed = spread.select(parent.alias("parent"), F.spark_partition_id().alias("place"))
    return placed.groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("place").alias("places"))


@query("SELECT rec_id, path, size, true AS whole FROM inventory_feed")
def spool_replay(spark: SparkSession, d: str) -> DataFrame:
    """A stream written to a spool in batches by a hash of the path and replayed batch by batch; ``whole``: all records of the
    path came in one batch."""
    stream = streaming.arriving(spark, f"{d}/inventory_feed.parquet").select("rec_id", "path", "size")
    at = streaming.spool(stream, new_folder(spark, "spool"), 4, "path")
    parts = [streaming.replayed(spark, at, k, stream.schema) for k in range(4)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    batches = whole.groupBy("path").agg(F.count_distinct("batch_id").alias("n"))
    same = F.col("w.path").eqNullSafe(F.col("b.path"))
    return whole.alias("w").join(batches.alias("b"), same).select("rec_id", "w.path", "size", (F.col("n") == 1).alias("whole"))


@query("SELECT count(*) AS entries, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM inventory")
def progress_totals(spark: SparkSession, d: str) -> DataFrame:
    """What is observed of an inventory while it is written."""
    rows, seen = progress.observed(q.inventory(spark, d), "inventory")
    rows.write.parquet(new_folder(spark, "observed"))
    return spark.createDataFrame([(seen.get["entries"], seen.get["bytes"])], "entries bigint, bytes bigint")


@query("SELECT inv_id FROM inventory WHERE length(path) - length(replace(path, '/', '')) > 4 AND ends_with(path, 'z')")
def find_hook(spark: SparkSession, d: str) -> DataFrame:
    """A test of the caller's own, in batches on the executors."""
    return predicates.find(q.inventory(spark, d), predicates.hook(lambda p: p.count("/") > 4 and p.endswith("z"))).select("inv_id")


@query("SELECT inv_id, '/backup' || path || '/new' AS path FROM inventory")
def joined_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths with something put before and after them."""
    return q.inventory(spark, d).select("inv_id", paths.joined("/backup/", F.col("path"), "new/").alias("path"))


@query("""
    WITH w AS (SELECT CAST(epoch(time_bucket(INTERVAL 6 HOUR, ts)) AS BIGINT) - k * 21600 AS window_start, event_type FROM events, range(2) AS t(k) WHERE ts IS NOT NULL)
    SELECT window_start, event_type, count(*) AS n FROM w WHERE window_start + 43200 <= (SELECT epoch(max(ts)) - 86400 FROM events) GROUP BY 1, 2""")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Events per twelve hours, every six hours, and type: the windows for which no more can come, as a stream puts them out."""
    stream = streaming.arriving(spark, f"{d}/events.parquet")
    return streaming.run_final(
        streaming.windows(stream, "ts", ["event_type"], "12 hours", "1 day", "6 hours"), new_folder(spark, "stream")
    )


# A made tree ------------------------------------------------------------------------------------------------------------

ITEMS, SEED, MOST_BYTES = 2000, 5, 2000
TARGET = "../nowhere"


def _rows(spark: SparkSession) -> DataFrame:
    made = synthetic.tree(spark, ITEMS, SEED, root="", most_bytes=MOST_BYTES)
    return synthetic.fill(made, "alternate").withColumn("link_target", F.when(F.col("type") == schema.LINK, TARGET))


def _made(spark: SparkSession) -> str:
    """A tree on the shared file system, written by the executors: its root."""
    folder = new_folder(spark, "tree")
    if not folder.startswith("file:"):
        raise ValueError(f"only a mounted file system can be walked, not {folder}")
    root = "/" + folder.removeprefix("file:").lstrip("/")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for batch in batches:
            for path, kind, mtime, content in batch[["path", "type", "mtime", "content"]].itertuples(index=False, name=None):
                at = root + path
                os.makedirs(os.path.dirname(at), exist_ok=True)
                if kind == schema.DIRECTORY:
                    os.makedirs(at, exist_ok=True)
                elif kind == schema.LINK:
                    if not os.path.islink(at):
                        os.symlink(TARGET, at)
                else:
                    with open(at, "wb") as f:
                        f.write(content)
                    os.utime(at, (mtime, mtime))
            yield pd.DataFrame({"n": [len(batch)]})

    _rows(spark).select("path", "type", "mtime", "content").mapInPandas(make, "n bigint").agg(F.sum("n")).first()
    return root


def _number(what: int) -> str:
    """The made-up number of an entry: three rounds of the generator, as in ``synthetic``."""
    return q._G(what).replace(str(3 * 7919 + what * 104729), str(SEED * 7919 + what * 104729))


_TREE = f"""
WITH g AS (SELECT i, CAST(2 + {_number(1)} % 3 AS INT) AS type, {_number(2)} % {MOST_BYTES} AS bytes, 1767225600 - {_number(4)} % 126144000 AS mtime FROM range({ITEMS}) AS t(i)),
e AS (SELECT '/d' || (i // 16) || '/' || CASE type WHEN 2 THEN 'file_' WHEN 3 THEN 'dir_' ELSE 'link_' END || lpad(CAST(i AS VARCHAR), 8, '0') AS path, type,
    CASE WHEN type = 2 THEN bytes END AS size, CASE WHEN type = 2 THEN mtime END AS mtime, CASE WHEN type = 4 THEN '{TARGET}' END AS link_target FROM g),
t AS (SELECT * FROM e UNION ALL SELECT DISTINCT '/d' || (i // 16), 3, NULL::BIGINT, NULL::BIGINT, NULL FROM g UNION ALL SELECT '', 3, NULL::BIGINT, NULL::BIGINT, NULL)
"""
_BODY = "unhex(substring(repeat('FF00', CAST(size AS BIGINT)), 1, CAST(size * 2 AS BIGINT)))"


def _below(found: DataFrame, root: str, *columns: str) -> DataFrame:
    file = F.col("type") == schema.FILE
    values = {"size": F.when(file, F.col("size")), "mtime": F.when(file, F.col("mtime"))} if "size" in found.columns else {}
    return found.withColumns(values).select(F.substring("path", len(root) + 1, 2**31 - 1).alias("path"), *columns)


@query(_TREE + "SELECT * FROM t")
def walk_tree(spark: SparkSession, d: str) -> DataFrame:
    """A walk with stats."""
    root = _made(spark)
    return _below(walk.walk(spark, root), root, "type", "size", "mtime", "link_target")


@query(_TREE + "SELECT path, type FROM t")
def walk_lite(spark: SparkSession, d: str) -> DataFrame:
    """A walk for names and types alone."""
    root = _made(spark)
    return _below(walk.walk(spark, root, lite="true"), root, "type")


@query(_TREE + "SELECT *, NULL::VARCHAR AS error FROM t")
def walk_balanced(spark: SparkSession, d: str) -> DataFrame:
    """A walk that spreads directories and entries anew at every level."""
    root = _made(spark)
    return _below(walk.walk_levels(spark, root), root, "type", "size", "mtime", "link_target", "error")


@query(_TREE + "SELECT path, type, size, mtime FROM t WHERE type <> 3")
def restat_tree(spark: SparkSession, d: str) -> DataFrame:
    """Fresh stats of a list of paths, some of which are gone."""
    root = _made(spark)
    listed = walk.walk(spark, root, lite="true").filter(F.col("type") != schema.DIRECTORY)
    gone = listed.select(F.concat("path", F.lit(".gone")).alias("path"), "depth", "type")
    return _below(walk.restat(listed.unionByName(gone)), root, "type", "size", "mtime")


@query(_TREE + f"SELECT path, sha256({_BODY}) AS digest FROM t WHERE type = 2")
def walk_digests(spark: SparkSession, d: str) -> DataFrame:
    """Digests of contents, taken while walking."""
    root = _made(spark)
    return _below(walk.walk(spark, root, digest="true").filter(F.col("type") == schema.FILE), root, "digest")


@query("SELECT * FROM (VALUES ('/x/y', 2, 1, CAST(NULL AS BIGINT)), ('/x', 1, 3, CAST(4096 AS BIGINT))) AS t(path, depth, type, size)")
def explicit_rows(spark: SparkSession, d: str) -> DataFrame:
    """An inventory of given rows."""
    rows = walk.explicit(spark, [{"path": "/x/y"}, {"path": "/x", "type": schema.DIRECTORY, "size": 4096}])
    return rows.select("path", "depth", "type", "size")


@query(_TREE + "SELECT path, type, coalesce(size, 0) AS size, coalesce(link_target, '') AS link_target, true AS found FROM e")
def archive_scan(spark: SparkSession, d: str) -> DataFrame:
    """Archives of the tree, scanned entry by entry; ``found``: the index has the entry at the same places."""
    index = archives.write_archives(_rows(spark).repartition(3).withColumns({"uid": F.lit(0), "gid": F.lit(0)}), new_folder(spark, "archives"))
    scanned = archives.archive_list(index.select("archive").distinct())
    places = ["archive", "path", "offset", "data_offset"]
    known = index.select(*places).withColumn("known", F.lit(True))
    # Names are stored as given; the walk's paths begin with a slash.
    met = scanned.withColumn("path", F.concat(F.lit("/"), F.ltrim("path", F.lit("/")))).join(
        known.withColumn("path", F.concat(F.lit("/"), F.ltrim("path", F.lit("/")))), places, "left"
    )
    return met.select("path", "type", "size", F.coalesce("link_target", F.lit("")).alias("link_target"), F.coalesce("known", F.lit(False)).alias("found"))


@query(_TREE + f"SELECT path, sha256({_BODY}) AS digest FROM e WHERE type = 2")
def archive_contents(spark: SparkSession, d: str) -> DataFrame:
    """Contents read from archives by their index."""
    index = archives.write_archives(_rows(spark).repartition(3).withColumns({"uid": F.lit(0), "gid": F.lit(0)}), new_folder(spark, "archives"))
    return archives.indexed_contents(index).select("path", F.sha2("content", 256).alias("digest"))


@query("SELECT path AS value FROM inventory")
def compressed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines written with bzip2 and read again."""
    at = new_folder(spark, "lines")
    archives.write_compressed(q.inventory(spark, d).select("path"), at)
    return archives.compressed_lines(spark, at)
