"""The queries of the data-pipeline operators outside ``llm``, and the SQL that they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewalk.operators import compaction, incremental, reconcile, snapshots, valuefreq
from lakewalk.operators.keyed_state import KeyedState
from lakewalk.storage import new_folder

SRC_ROOT, DST_ROOT = "/lake/proj/corvel", "/mirror/b2/corvel"
TREE_FIELDS = ["size", "mtime", "mtime_nsec", "mode", "uid", "gid", "link_target"]
SNAP_FIELDS = ["size", "mtime", "mtime_nsec", "ctime", "ctime_nsec"]
PERCENTS = [0.25, 0.5, 0.75, 0.9, 0.99]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The records that each successful run over the feed has to take, by replaying the runs on persistent state. A run
    without a last drop saw none that it could name, so it doesn't count."""
    log = table(spark, d, "run_log")
    # The run log is one row per run, not per record.
    runs = [
        (r["run_id"], r["last_drop"]) for r in log.filter(
            "run_state = 'succeeded' AND last_drop IS NOT NULL"
        ).select("run_id", "last_drop").distinct().orderBy("run_id").collect()
    ]
    newest = log.agg(F.max("run_id")).first()[0] or 0
    rows = table(spark, d, "inventory_feed").filter("size IS NOT NULL AND mtime IS NOT NULL AND path IS NOT NULL")
    state = KeyedState(spark, new_folder(spark, "feed"))
    found = incremental.replay(
        state,
        rows,
        [*runs, (newest + 1, None)],
        "drop_id",
        key=[F.col("path")],
        content=[F.col("size"), F.col("mtime"), F.coalesce("mtime_nsec", F.lit(0))],
        rank=[F.col("walk_no"), -F.col("rec_id")],
        row_id=F.col("rec_id"),
    )
    state.close()
    return found.select("run_id", F.col("row_id").alias("rec_id"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The fragments that were packed: read from the committed files."""
    packed = compaction.pack_fragments(table(spark, d, "fragments"), new_folder(spark, "packed"))
    return packed.select("frag_id").distinct()


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    """Per packed fragment, how many records it has and how many characters they hold."""
    packed = compaction.pack_fragments(table(spark, d, "fragments"), new_folder(spark, "packed"))
    return packed.groupBy("frag_id").agg(
        F.count("rec_no").alias("n_records"), F.sum(F.length("record")).alias("n_chars")
    )


def _below(df: DataFrame, root: str) -> DataFrame:
    """The entries below ``root``, which isn't one itself."""
    return df.filter(F.col("path").startswith(root + "/")).withColumn("relpath", F.substring("path", len(root) + 2, 2**31 - 1))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Entries missing on a side and fields that differ between the two trees."""
    return reconcile.differences(
        _below(table(spark, d, "src_tree"), SRC_ROOT),
        _below(table(spark, d, "dst_tree"), DST_ROOT),
        "relpath",
        "row_id",
        TREE_FIELDS,
        ignore={"size": F.col("src_type") == 3},
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The uids and gids that hold at least 1% of all rows."""
    rows = table(spark, d, "inventory")
    freq = valuefreq.compress(valuefreq.by_kind(rows, ["uid", "gid"], F.col("size")), ["key_kind", "key_id"], "value")
    counts = valuefreq.key_counts(freq, ["key_kind", "key_id"])
    return valuefreq.hot_keys(counts, rows.count(), 0.01).select("key_kind", "key_id")


def p6_results(spark: SparkSession, d: str) -> DataFrame:
    """Per uid and gid: rows, sized rows, distinct sizes, total and most frequent size."""
    rows = table(spark, d, "inventory")
    freq = valuefreq.compress(valuefreq.by_kind(rows, ["uid", "gid"], F.col("size")), ["key_kind", "key_id"], "value")
    return valuefreq.key_counts(freq, ["key_kind", "key_id"]).withColumn("total", F.col("total").cast("bigint"))


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per uid and gid: exact percentiles of size."""
    _, ps = valuefreq.per_key(table(spark, d, "inventory"), ["uid", "gid"], F.col("size"), PERCENTS)
    return ps.select("key_kind", "key_id", "p", "n_values", "value")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Paths added, removed or changed between consecutive snapshots."""
    return p7_values(spark, d).select("snap_id", "path", "change_kind")


def p7_values(spark: SparkSession, d: str) -> DataFrame:
    """p7_found with the old and new values."""
    rows = table(spark, d, "snapshots")
    # One id per snapshot: their number doesn't grow with the rows.
    ids = [r[0] for r in rows.select("snap_id").distinct().orderBy("snap_id").collect() if r[0] is not None]
    index = KeyedState(spark, new_folder(spark, "snapshots"))
    found = snapshots.changes_between(index, rows, "snap_id", ids, key="path", row_id="snap_row", fields=SNAP_FIELDS)
    index.close()
    if found is None:
        return snapshots.nothing(rows, "path", SNAP_FIELDS, {"snap_id": 0})
    return found


QUERIES = {
    f.__name__: f for f in (
        p1_found, p3_found, p3_records, p5_found, p6_found, p6_results, p6_percentiles, p7_found, p7_values
    )
}

_P3 = """
WITH f AS (SELECT *, coalesce(size, octet_length(encode(content))) AS bytes, regexp_replace(path, '/[^/]*$', '') AS dir,
    row_number() OVER (PARTITION BY dev, ino ORDER BY frag_id) AS r FROM fragments),
small AS (SELECT * FROM f WHERE r = 1 AND type = 2 AND bytes BETWEEN 1 AND 4096),
packed AS (SELECT * FROM small WHERE dir IN (SELECT dir FROM small GROUP BY dir HAVING count(*) >= 8))
"""

_P5_FIELDS = " UNION ALL ".join(
    f"SELECT relpath, '{f}' AS diff_kind FROM both_sides WHERE s.row_id IS NOT NULL AND d.row_id IS NOT NULL AND s.{f} IS DISTINCT FROM d.{f}" + " AND s.type <> 3" * (f == "size") for f in TREE_FIELDS
)

_P7 = """
WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snap_id, path ORDER BY snap_row) AS r FROM snapshots) WHERE r = 1),
ids AS (SELECT snap_id, lag(snap_id) OVER (ORDER BY snap_id) AS prev FROM (SELECT DISTINCT snap_id FROM snapshots)),
n AS (SELECT i.snap_id AS sid, f.* FROM ids i JOIN f ON f.snap_id = i.snap_id WHERE i.prev IS NOT NULL),
o AS (SELECT i.snap_id AS sid, f.* FROM ids i JOIN f ON f.snap_id = i.prev),
j AS (SELECT coalesce(n.sid, o.sid) AS snap_id, coalesce(n.path, o.path) AS path,
    CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change_kind,
    o.size AS old_size, o.mtime AS old_mtime, o.mtime_nsec AS old_mtime_nsec, o.ctime AS old_ctime, o.ctime_nsec AS old_ctime_nsec,
    n.size AS new_size, n.mtime AS new_mtime, n.mtime_nsec AS new_mtime_nsec, n.ctime AS new_ctime, n.ctime_nsec AS new_ctime_nsec
    FROM n FULL JOIN o ON n.sid = o.sid AND n.path = o.path
    WHERE n.path IS NULL OR o.path IS NULL OR n.size IS DISTINCT FROM o.size OR n.mtime IS DISTINCT FROM o.mtime
    OR n.mtime_nsec IS DISTINCT FROM o.mtime_nsec OR n.ctime IS DISTINCT FROM o.ctime OR n.ctime_nsec IS DISTINCT FROM o.ctime_nsec)
"""

_P6 = "(SELECT 'uid' AS key_kind, uid AS key_id, size FROM inventory UNION ALL SELECT 'gid', gid, size FROM inventory)"

SQL = {
    # Each row belongs to the first run that sees its drop; a path's state is the greatest (walk_no, -rec_id) up to a run.
    "p1_found": """
        WITH runs AS (SELECT run_id, last_drop FROM run_log WHERE run_state = 'succeeded' AND last_drop IS NOT NULL
            UNION ALL SELECT coalesce(max(run_id), 0) + 1, 2147483647 FROM run_log),
        taken AS (SELECT d.drop_id, min(run_id) AS run_id FROM (SELECT DISTINCT drop_id FROM inventory_feed) d JOIN runs r ON d.drop_id <= r.last_drop GROUP BY d.drop_id),
        f AS (SELECT t.run_id, path, rec_id, size, mtime, coalesce(mtime_nsec, 0) AS ns, CAST(walk_no AS HUGEINT) * 1000000000000 - rec_id AS rk
            FROM inventory_feed JOIN taken t USING (drop_id) WHERE size IS NOT NULL AND mtime IS NOT NULL AND path IS NOT NULL),
        best AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY run_id, path ORDER BY rk DESC) = 1),
        newer AS (SELECT *, max(rk) OVER (PARTITION BY path ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM best QUALIFY before IS NULL OR rk > before),
        steps AS (SELECT *, lag(rec_id) OVER w AS prev, lag(size) OVER w AS s, lag(mtime) OVER w AS m, lag(ns) OVER w AS n FROM newer WINDOW w AS (PARTITION BY path ORDER BY run_id))
        SELECT run_id, rec_id FROM steps WHERE prev IS NULL OR size <> s OR mtime <> m OR ns <> n""",
    "p3_found": _P3 + "SELECT frag_id FROM packed",
    "p3_records": _P3
    + """, lines AS (SELECT frag_id, unnest(string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line,
        right(content, 1) IN (chr(10), chr(13)) AS ended FROM packed)
        SELECT frag_id, CAST(count(*) - max(CAST(ended AS INT)) AS BIGINT) AS n_records, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM lines GROUP BY frag_id""",
    "p5_found": f"""
        WITH s0 AS (SELECT *, substring(path, {len(SRC_ROOT) + 2}) AS relpath, row_number() OVER (PARTITION BY path ORDER BY row_id) AS r FROM src_tree WHERE starts_with(path, '{SRC_ROOT}/')),
        d0 AS (SELECT *, substring(path, {len(DST_ROOT) + 2}) AS relpath, row_number() OVER (PARTITION BY path ORDER BY row_id) AS r FROM dst_tree WHERE starts_with(path, '{DST_ROOT}/')),
        both_sides AS (SELECT coalesce(s.relpath, d.relpath) AS relpath, s, d FROM (SELECT * FROM s0 WHERE r = 1) s FULL JOIN (SELECT * FROM d0 WHERE r = 1) d ON s.relpath = d.relpath)
        SELECT relpath, 'only_src' AS diff_kind FROM both_sides WHERE d.row_id IS NULL
        UNION ALL SELECT relpath, 'only_dst' FROM both_sides WHERE s.row_id IS NULL UNION ALL {_P5_FIELDS}""",
    "p6_found": f"SELECT key_kind, key_id FROM {_P6} WHERE key_id IS NOT NULL GROUP BY ALL HAVING count(*) >= 0.01 * (SELECT count(*) FROM inventory)",
    "p6_results": f"""
        WITH v AS (SELECT key_kind, key_id, size, count(*) AS freq FROM {_P6} GROUP BY ALL),
        m AS (SELECT *, row_number() OVER (PARTITION BY key_kind, key_id ORDER BY (size IS NULL), freq DESC, size) AS r FROM v)
        SELECT key_kind, key_id, CAST(sum(freq) AS BIGINT) AS n_rows, CAST(coalesce(sum(freq) FILTER (size IS NOT NULL), 0) AS BIGINT) AS n_values,
        count(size) AS n_distinct, CAST(sum(CAST(size AS HUGEINT) * freq) AS BIGINT) AS total, max(size) FILTER (r = 1) AS mode_value,
        max(freq) FILTER (r = 1 AND size IS NOT NULL) AS mode_freq FROM m GROUP BY key_kind, key_id""",
    "p6_percentiles": f"""
        WITH v AS (SELECT key_kind, key_id, size, row_number() OVER (PARTITION BY key_kind, key_id ORDER BY size) AS r,
            count(*) OVER (PARTITION BY key_kind, key_id) AS n_values FROM {_P6} WHERE size IS NOT NULL)
        SELECT key_kind, key_id, p, n_values, size AS value FROM v, (VALUES {", ".join(f"(CAST({p} AS DOUBLE))" for p in PERCENTS)}) AS t(p)
        WHERE r = greatest(1, CAST(ceil(n_values * p) AS BIGINT))""",
    "p7_found": _P7 + "SELECT snap_id, path, change_kind FROM j",
    "p7_values": _P7 + "SELECT * FROM j",
}
