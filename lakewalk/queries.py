"""The queries of the inventory operators, each with the SQL that it is checked against.

A query takes a session and the folder of the tables. The SQL is written for DuckDB over the same tables; it shares fixed
values with the operators (bits, names of units, ends of classes, starts of hashes), and no logic. Every query runs over whole
tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewalk import schema
from lakewalk.functions import hashes, modes, paths, units
from lakewalk.operators import chunks, compare, dedup, filters, order, predicates, profile
from lakewalk.pipeline_queries import DST_ROOT, SRC_ROOT, table
from lakewalk.plans import changes, sync
from lakewalk.sources import caches, synthetic
from lakewalk.storage import new_folder
from lakewalk.streaming import profile as streaming

#: The clock of the tables. Fixed value.
NOW = 1767225600

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def inventory(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "inventory")


def named(spark: SparkSession, d: str) -> DataFrame:
    return schema.with_names(inventory(spark, d), table(spark, d, "user_names"), table(spark, d, "group_names"))


def src(spark: SparkSession, d: str) -> DataFrame:
    return compare.relative_rows(table(spark, d, "src_tree"), SRC_ROOT, "row_id")


def dst(spark: SparkSession, d: str) -> DataFrame:
    return compare.relative_rows(table(spark, d, "dst_tree"), DST_ROOT, "row_id")


_NAMED = """(SELECT i.*, coalesce(u.name, CAST(i.uid AS VARCHAR)) AS usr, coalesce(g.name, CAST(i.gid AS VARCHAR)) AS grp FROM inventory i
    LEFT JOIN user_names u ON i.uid = u.uid LEFT JOIN group_names g ON i.gid = g.gid)"""


def _side(name: str, root: str) -> str:
    return f"(SELECT * EXCLUDE (r) FROM (SELECT *, substring(path, {len(root) + 2}) AS relpath, row_number() OVER (PARTITION BY path ORDER BY row_id) AS r FROM {name} WHERE mode IS NOT NULL AND starts_with(path, '{root}/')) WHERE r = 1)"


_TREES = f"""
WITH s AS {_side('src_tree', SRC_ROOT)}, d AS {_side('dst_tree', DST_ROOT)},
j AS (SELECT coalesce(s.relpath, d.relpath) AS relpath, s, d, s.relpath IS NOT NULL AND d.relpath IS NOT NULL AS b, s.relpath IS NOT NULL AS hs, d.relpath IS NOT NULL AS hd FROM s FULL JOIN d ON s.relpath = d.relpath)
"""
_CONTENT = """CASE WHEN (s.mode & 61440) <> (d.mode & 61440) THEN 'DIFFER'
    WHEN (d.mode & 61440) = 40960 THEN CASE WHEN s.link_target IS NOT DISTINCT FROM d.link_target THEN 'COMMON' ELSE 'DIFFER' END
    WHEN (d.mode & 61440) <> 32768 THEN 'COMMON' WHEN s.type <> 3 AND s.size IS DISTINCT FROM d.size THEN 'DIFFER'
    WHEN s.mtime IS NOT DISTINCT FROM d.mtime AND s.mtime_nsec IS NOT DISTINCT FROM d.mtime_nsec THEN 'COMMON' ELSE 'DIFFER' END"""


def _same(test: str) -> str:
    return f"CASE WHEN b THEN CASE WHEN {test} THEN 'COMMON' ELSE 'DIFFER' END END"


_STATES = _TREES + f""", st AS (SELECT relpath, CASE WHEN b THEN 'COMMON' WHEN hs THEN 'ONLY_SRC' ELSE 'ONLY_DEST' END AS EXIST,
    {_same('(s.mode & 61440) = (d.mode & 61440)')} AS TYPE, {_same('s.type = 3 OR s.size IS NOT DISTINCT FROM d.size')} AS SIZE,
    {_same('s.uid IS NOT DISTINCT FROM d.uid')} AS UID, {_same('s.gid IS NOT DISTINCT FROM d.gid')} AS GID,
    {_same('s.atime IS NOT DISTINCT FROM d.atime AND s.atime_nsec IS NOT DISTINCT FROM d.atime_nsec')} AS ATIME,
    {_same('s.mtime IS NOT DISTINCT FROM d.mtime AND s.mtime_nsec IS NOT DISTINCT FROM d.mtime_nsec')} AS MTIME,
    {_same('(s.mode & 511) = (d.mode & 511)')} AS PERM, CASE WHEN b THEN {_CONTENT} END AS CONTENT FROM j)
"""


def _report_sql(expressions: list[str]) -> str:
    rows = []
    for e in expressions:
        tests = []
        for term in e.split("@"):
            field, state = term.split("=")
            tests.append("EXIST <> 'COMMON'" if term == "EXIST=DIFFER" else f"{field} = '{state}'")
        rows.append(
            f"SELECT '{e}' AS expression, count(*) FILTER (EXIST <> 'ONLY_DEST') AS src, count(*) FILTER (EXIST <> 'ONLY_SRC') AS dst FROM st WHERE {' AND '.join(tests)}"
        )
    return _STATES + " UNION ALL ".join(rows)


def _bin(value: str, ends: list) -> str:
    whens = " ".join(f"WHEN {value} <= {e} THEN {i}" for i, e in enumerate(ends) if e is not None)
    return f"CASE WHEN {value} IS NULL THEN NULL {whens}" + (
        f" ELSE {len(ends) - 1} END" if ends[-1] is None else " END"
    )


def _ends(ends: list) -> str:
    rows = ", ".join(f"({i}, CAST({ends[i - 1] if i else 0} AS BIGINT), CAST({'NULL' if e is None else e} AS BIGINT))" for i, e in enumerate(ends))
    return f"(VALUES {rows}) AS e(bin, lower, upper)"


# Searches ---------------------------------------------------------------------------------------------------------------


@query(" UNION ALL ".join(f"SELECT '{c}' AS letter, count(*) AS n, count(DISTINCT path) AS n_paths FROM inventory WHERE (mode & 61440) = {bits}" for c, bits in predicates.TYPE_BITS.items()))
def find_type(spark: SparkSession, d: str) -> DataFrame:
    """Entries by each letter of type."""
    letter = F.coalesce(*[F.when(predicates.of_type(c), c) for c in predicates.TYPE_BITS])
    counted = inventory(spark, d).groupBy(letter.alias("letter")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("n_paths")
    )
    letters = spark.createDataFrame([(c,) for c in predicates.TYPE_BITS], "letter string")
    return letters.join(counted, "letter", "left").fillna(0, ["n", "n_paths"])


@query(
    r"SELECT inv_id, path FROM inventory WHERE regexp_matches(path, '(?s)/([^./][^/]*)?\.gz$') AND NOT regexp_matches(path, '(?s)/\.[^/]*$') OR regexp_matches(path, '(?s)/[^.a-m/][^/]*[._-][^/]*\.h[^/]$')"
)
def find_name(spark: SparkSession, d: str) -> DataFrame:
    """Names by shell patterns; hidden names aren't matched by a leading star."""
    return predicates.find(
        inventory(spark, d), predicates.name("*.gz") | predicates.name("[!a-m]*[._-]*.h?")
    ).select("inv_id", "path")


@query(
    "SELECT inv_id, path FROM inventory WHERE starts_with(path, '/lake/proj/') AND contains(substring(path, 12), '/run0') AND NOT ends_with(path, '/')"
)
def find_path(spark: SparkSession, d: str) -> DataFrame:
    """Whole paths by a shell pattern whose stars go across slashes."""
    return predicates.find(inventory(spark, d), predicates.path("/lake/proj/*/run0*")).select("inv_id", "path")


@query(
    r"SELECT inv_id, path FROM inventory WHERE regexp_matches(path, '/(run|v)[0-9.]+/') AND regexp_matches(path, '\.[a-z]+$')"
)
def find_regex(spark: SparkSession, d: str) -> DataFrame:
    """Basic regular expressions: operators are those with backslashes."""
    return predicates.find(
        inventory(spark, d),
        predicates.regex(r"/\(run\|v\)[0-9.]\{1,\}/"),
        predicates.regex(r"\.[[:lower:]][[:lower:]]*$"),
    ).select("inv_id", "path")


@query("SELECT inv_id, uid, gid FROM inventory WHERE uid > 100000 AND gid < 1000 OR uid = 1201")
def find_ids(spark: SparkSession, d: str) -> DataFrame:
    """Owners by number: more, less, equal."""
    both = predicates.number("uid", "+100000") & predicates.number("gid", "-1000")
    return predicates.find(inventory(spark, d), both | predicates.number("uid", "1201")).select("inv_id", "uid", "gid")


@query(
    f"SELECT inv_id, usr AS user, grp AS \"group\" FROM {_NAMED} WHERE usr = 'draewe_svc' OR usr = '100276' OR grp = '512'"
)
def find_names(spark: SparkSession, d: str) -> DataFrame:
    """Owners by name, or by number where they have no name."""
    rows = named(spark, d)
    return predicates.find(
        rows, predicates.user("draewe_svc") | predicates.user("100276") | predicates.group("512")
    ).select("inv_id", "user", "group")


@query("SELECT inv_id, size FROM inventory WHERE size > 1048576 AND size < 10737418240 OR size = 4096")
def find_size(spark: SparkSession, d: str) -> DataFrame:
    """Sizes with units; all types count."""
    between = predicates.size("+1m") & predicates.size("-10GB")
    return predicates.find(inventory(spark, d), between | predicates.size("4k")).select("inv_id", "size")


def _age_sql(field: str, unit: int) -> str:
    return f"CASE WHEN {field} IS NOT NULL THEN greatest(0, {NOW}::BIGINT * 1000000000 - ({field} * 1000000000 + coalesce({field}_nsec, 0))) // {unit}000000000 END"


@query(
    f"SELECT inv_id FROM inventory WHERE {_age_sql('atime', 60)} < 20000 AND {_age_sql('mtime', 60)} > 30000 OR {_age_sql('ctime', 60)} = 0"
)
def find_minutes(spark: SparkSession, d: str) -> DataFrame:
    """Ages in minutes of all three times."""
    age = lambda f, n: predicates.age(f, n, (NOW, 0), predicates.MINUTE)
    return predicates.find(
        inventory(spark, d), (age("atime", "-20000") & age("mtime", "+30000")) | age("ctime", "0")
    ).select("inv_id")


@query(
    f"SELECT inv_id FROM inventory WHERE {_age_sql('atime', 86400)} > 365 AND {_age_sql('mtime', 86400)} > 365 OR {_age_sql('ctime', 86400)} = 30"
)
def find_days(spark: SparkSession, d: str) -> DataFrame:
    """Ages in days of all three times; times ahead are 0 days old."""
    age = lambda f, n: predicates.age(f, n, (NOW, 0), predicates.DAY)
    return predicates.find(
        inventory(spark, d), (age("atime", "+365") & age("mtime", "+365")) | age("ctime", "30")
    ).select("inv_id")


@query(
    "SELECT inv_id FROM inventory WHERE (atime > 1766000000 OR atime = 1766000000 AND atime_nsec > 5) AND (mtime > 1760000000 OR mtime = 1760000000 AND mtime_nsec > 0) OR ctime > 1767200000 OR ctime = 1767200000 AND ctime_nsec > 0"
)
def find_newer(spark: SparkSession, d: str) -> DataFrame:
    """Strictly later than a time, to the nanosecond."""
    newer = predicates.newer
    return predicates.find(
        inventory(spark, d),
        (newer("atime", 1766000000, 5) & newer("mtime", 1760000000, 0)) | newer("ctime", 1767200000, 0),
    ).select("inv_id")


@query(
    "SELECT inv_id, path FROM inventory WHERE (path = '/lake/home' OR starts_with(path, '/lake/home/')) AND length(path) - length(replace(path, '/', '')) <= 5"
)
def find_depth(spark: SparkSession, d: str) -> DataFrame:
    """At most three levels below a root."""
    return predicates.find(inventory(spark, d), predicates.max_depth("/lake/home", 3)).select("inv_id", "path")


@query(
    "SELECT path, size FROM inventory WHERE (mode & 61440) = 32768 AND size > 1073741824 AND regexp_matches(path, '/[^/.][^/]*\\.tar$') AND mtime < 1767225600 - 91 * 86400"
)
def find_combined(spark: SparkSession, d: str) -> DataFrame:
    """A usual search: large old archives."""
    old = F.col("mtime") < NOW - 91 * 86400
    return predicates.find(
        inventory(spark, d), predicates.of_type("f"), predicates.size("+1g"), predicates.name("*.tar"), old
    ).select("path", "size")


@query(
    r"SELECT inv_id, 'path' AS kind FROM inventory WHERE regexp_matches(path, 'ba.*[0-9]') UNION ALL SELECT inv_id, 'name' FROM inventory WHERE NOT regexp_matches(regexp_extract(path, '[^/]*$'), 'ba.*[0-9]')"
)
def match_exclude(spark: SparkSession, d: str) -> DataFrame:
    """Paths with an expression in them, and names without it."""
    rows = inventory(spark, d)
    return filters.matching(rows, "ba.*[0-9]").select("inv_id", F.lit("path").alias("kind")).unionAll(
        filters.matching(rows, "ba.*[0-9]", exclude=True, on_name=True).select("inv_id", F.lit("name").alias("kind"))
    )


@query("SELECT inv_id, starts_with(path, '/lake/scratch/') AS inside FROM inventory")
def subtree_split(spark: SparkSession, d: str) -> DataFrame:
    """What lies below a directory, and the rest."""
    inside, rest = filters.subtree(inventory(spark, d), "/lake/scratch")
    return inside.select("inv_id", F.lit(True).alias("inside")).unionAll(
        rest.select("inv_id", F.lit(False).alias("inside"))
    )


@query("SELECT inv_id, path, regexp_matches(path, '^/lake/home/ax[^/]*(/|$)') AS inside FROM inventory")
def children_like(spark: SparkSession, d: str) -> DataFrame:
    """Everything in children whose names match, and the rest."""
    inside, rest = filters.children_like(inventory(spark, d), "/lake/home", "ax*")
    return inside.select("inv_id", "path", F.lit(True).alias("inside")).unionAll(
        rest.select("inv_id", "path", F.lit(False).alias("inside"))
    )


@query(
    f"SELECT inv_id, path FROM inventory WHERE type IN (2, 4) AND {NOW} - atime > 60 * 86400 AND {NOW} - ctime > 60 * 86400"
)
def purgeable(spark: SparkSession, d: str) -> DataFrame:
    """Files and links that weren't used or changed for 60 days."""
    return filters.purgeable(inventory(spark, d), NOW).select("inv_id", "path")


@query("SELECT inv_id, size FROM inventory WHERE type = 2 AND size > 0")
def nonempty_files(spark: SparkSession, d: str) -> DataFrame:
    return filters.nonempty_files(inventory(spark, d)).select("inv_id", "size")


def _striped(spark: SparkSession, d: str) -> DataFrame:
    """The inventory with a layout: one stripe for small files, four for others, unknown without a device."""
    count = F.when(F.col("dev").isNotNull(), F.when(F.col("size") < 2**30, 1).otherwise(4))
    return inventory(spark, d).withColumn("stripe_count", count).withColumn(
        "stripe_size", F.when(F.col("dev") == 2049, 1 << 20).otherwise(4 << 20)
    )


_STRIPED = "SELECT * FROM (SELECT *, CASE WHEN dev IS NOT NULL THEN CASE WHEN size < 1073741824 THEN 1 ELSE 4 END END AS sc, CASE WHEN dev = 2049 THEN 1048576 ELSE 4194304 END AS ss FROM inventory) WHERE type = 2 AND size >= 1048576 AND (sc <> 4 OR ss <> 4194304)"


@query(f"SELECT inv_id, path, size FROM ({_STRIPED})")
def restripeable(spark: SparkSession, d: str) -> DataFrame:
    """Large files whose layout isn't the wanted one."""
    return changes.restripe(_striped(spark, d), 1 << 20, 4, 4 << 20)[0].select("inv_id", "path", "size")


@query(f"SELECT count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM ({_STRIPED})")
def restripe_totals(spark: SparkSession, d: str) -> DataFrame:
    return changes.restripe(_striped(spark, d), 1 << 20, 4, 4 << 20)[1]


@query("""
    WITH t AS (SELECT *, CASE WHEN starts_with(path, '/lake/') THEN '/lake/' || split_part(substring(path, 7), '/', 1) END AS top FROM inventory),
    v AS (SELECT top, min(dev) AS dv FROM t WHERE path = top AND dev IS NOT NULL GROUP BY top)
    SELECT inv_id FROM t LEFT JOIN v USING (top) WHERE dv IS NULL OR dev = dv""")
def one_device(spark: SparkSession, d: str) -> DataFrame:
    """Entries on their top directory's device."""
    return filters.one_device(profile.with_top(inventory(spark, d), "/lake"), "top").select("inv_id")


_FLAGS = f"""(CASE WHEN type = 2 AND size > 1125899906842624 THEN 1 ELSE 0 END +
    CASE WHEN atime > {NOW} OR atime < {NOW} - 3650 * 86400 OR mtime > {NOW} OR mtime < {NOW} - 3650 * 86400 OR ctime > {NOW} OR ctime < {NOW} - 3650 * 86400 THEN 2 ELSE 0 END
    + CASE WHEN mode IS NOT NULL THEN 0 WHEN contains(path, '7') THEN 4 ELSE 8 END)"""


def _with_errors(spark: SparkSession, d: str) -> DataFrame:
    """The inventory with errors as of a walk: of the failed stats some are of entries that went missing."""
    error = F.when(F.col("path").contains("7"), "missing").otherwise("unreadable")
    return inventory(spark, d).withColumn("error", F.when(F.col("mode").isNull(), error))


@query(f"SELECT inv_id, path, {_FLAGS} AS flags FROM inventory WHERE {_FLAGS} <> 0")
def broken(spark: SparkSession, d: str) -> DataFrame:
    """Entries with something wrong, and what."""
    return filters.broken(_with_errors(spark, d), NOW, "error").select("inv_id", "path", "flags")


@query(f"SELECT path, {_FLAGS} AS flags FROM inventory WHERE {_FLAGS} <> 0 ORDER BY path, flags LIMIT 100")
def broken_sample(spark: SparkSession, d: str) -> DataFrame:
    """The report's sample of them."""
    return filters.broken_sample(_with_errors(spark, d), NOW, 100, "error")


@query(
    "SELECT inv_id, path, link_target AS target FROM inventory WHERE type = 4 AND starts_with(link_target, '/lake/archive/') AND NOT contains(link_target, '/.') AND NOT contains(link_target, '//') AND NOT ends_with(link_target, '/')"
)
def links_below(spark: SparkSession, d: str) -> DataFrame:
    """Links to places below a directory."""
    return filters.links_below(inventory(spark, d), "/lake/archive").select("inv_id", "path", "target")


@query(r"""
    WITH l AS (SELECT frag_id, path, unnest(string_split(content, chr(10))) AS line, unnest(range(1, 1 + len(string_split(content, chr(10))))) AS line_no FROM fragments WHERE type = 2)
    SELECT path, CAST(line_no AS INT) AS line_no, line FROM l WHERE regexp_matches(line, 'S[EA]L.*[0-9]+\.5')""")
def grep(spark: SparkSession, d: str) -> DataFrame:
    """Lines of files with an expression in them."""
    return filters.grep(table(spark, d, "fragments"), r"S[EA]L.*[0-9][0-9]*\.5")


# Profiles ---------------------------------------------------------------------------------------------------------------


@query("""
    SELECT count(*) AS items, count(*) FILTER (type = 3) AS directories, count(*) FILTER (type = 2) AS files, count(*) FILTER (type = 4) AS links,
    count(*) FILTER (type NOT IN (2, 3, 4) OR type IS NULL) AS unknown, CAST(coalesce(sum(size) FILTER (type = 2), 0) AS BIGINT) AS bytes,
    CAST(coalesce(sum(size) FILTER (type = 2), 0) // greatest(1, count(*) FILTER (type = 2)) AS BIGINT) AS bytes_per_file FROM inventory""")
def summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts and bytes of the whole inventory."""
    return profile.summary(inventory(spark, d))


@query(
    "SELECT count(*) AS items, CAST(max(strlen(path)) + 1 AS INT) AS longest, min(depth) AS min_depth, max(depth) AS max_depth FROM inventory"
)
def statistics(spark: SparkSession, d: str) -> DataFrame:
    return profile.statistics(inventory(spark, d))


@query(f"""
    SELECT count(*) FILTER (type = 2) AS files, count(*) FILTER (type = 3) AS directories, count(*) FILTER (type = 4) AS links, count(*) FILTER (type = 1) AS others,
    count(*) FILTER (mode IS NULL) AS scan_errors, count(*) FILTER ({_FLAGS} NOT IN (0, 4, 8)) AS broken FROM inventory""")
def type_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.type_counts(inventory(spark, d), NOW)


@query("""
    WITH m AS (SELECT CAST(ceil(log2(max(size)) / 10) * 10 AS INT) AS bits FROM inventory),
    e AS (SELECT CAST(row_number() OVER (ORDER BY u) - 1 AS INT) AS bin, coalesce(lag(u) OVER (ORDER BY u), 0) AS lower, u AS upper FROM
        (SELECT CAST(1 AS BIGINT) AS u UNION ALL SELECT CAST(1 AS BIGINT) << k FROM (VALUES (10), (20), (30), (40), (50), (60)) AS v(k), m WHERE k <= bits)),
    c AS (SELECT (SELECT min(bin) FROM e WHERE size <= upper) AS b FROM inventory WHERE size IS NOT NULL)
    SELECT bin, lower, upper, (SELECT count(*) FROM c WHERE coalesce(b, (SELECT max(bin) FROM e)) = e.bin) AS number FROM e""")
def size_histogram(spark: SparkSession, d: str) -> DataFrame:
    """All entries by size, in powers of 1024."""
    return profile.size_histogram(inventory(spark, d))


_OWN_ENDS = [0, 100, 4096, 1048576, 16777216, 1073741824, None]


@query(
    f"SELECT bin, lower, upper, (SELECT count(*) FROM inventory WHERE {_bin('size', _OWN_ENDS)} = e.bin) AS number FROM {_ends(_OWN_ENDS)}"
)
def size_distribution(spark: SparkSession, d: str) -> DataFrame:
    """All entries by size, in classes of the caller's."""
    return profile.size_distribution(inventory(spark, d), "size:1g,0,100,4k,1m,16MB,4k")


@query(f"""
    SELECT bin, lower, upper, (SELECT count(*) FROM inventory WHERE type = 2 AND {_bin('size', profile.SIZE_ENDS)} = e.bin) AS number,
    '[' || lower || ',' || coalesce(CAST(upper AS VARCHAR), 'INF') || ']' AS label FROM {_ends(profile.SIZE_ENDS)}""")
def file_size_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.file_size_profile(inventory(spark, d))


_DAYS = lambda f: f"CASE WHEN {f} IS NOT NULL THEN greatest(0, {NOW} - {f}) // 86400 END"


@query(
    " UNION ALL ".join(
        f"SELECT '{f}' AS field, bin, lower, upper, CAST(coalesce((SELECT sum(size) FROM inventory WHERE type = 2 AND {_bin(_DAYS(f), profile.AGE_ENDS)} = e.bin), 0) AS BIGINT) AS bytes FROM {_ends(profile.AGE_ENDS)}" for f in (
            "atime", "mtime", "ctime"
        )
    )
)
def age_profile(spark: SparkSession, d: str) -> DataFrame:
    """Bytes by age, for three times."""
    return profile.age_profile(inventory(spark, d), NOW)


def _hot_sql(source: str) -> str:
    days = ", ".join(
        f"CAST(coalesce(sum(size) FILTER (type = 2 AND {_DAYS('atime')} <= {k}), 0) AS BIGINT) AS day{k}" for k in profile.HOT_DAYS
    )
    return f"""SELECT *, CASE WHEN total > 0 THEN cold / total ELSE 0.0 END AS ratio FROM (SELECT top AS directory, CAST(coalesce(sum(size) FILTER (type = 2), 0) AS BIGINT) AS total,
        CAST(coalesce(sum(size) FILTER (type = 2 AND {_DAYS('atime')} >= 90), 0) AS BIGINT) AS cold, count(*) FILTER (mode IS NULL) AS errors, {days}
        FROM (SELECT *, '/lake/' || split_part(substring(path, 7), '/', 1) AS top FROM {source} WHERE starts_with(path, '/lake/')) GROUP BY top)"""


@query(_hot_sql("inventory"))
def hot_cold(spark: SparkSession, d: str) -> DataFrame:
    """Used and unused bytes per top directory."""
    return profile.hot_cold(profile.with_top(inventory(spark, d), "/lake"), "top", NOW, 90)


_UNIQUE = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dev, ino ORDER BY path, depth, type, mode, uid, gid, size, atime, atime_nsec, mtime, mtime_nsec, ctime, ctime_nsec) AS rn FROM inventory) WHERE rn = 1 OR dev IS NULL OR ino IS NULL)"


@query(_hot_sql(_UNIQUE))
def hot_cold_unique(spark: SparkSession, d: str) -> DataFrame:
    """The same with each inode counted once."""
    columns = [f.name for f in schema.INVENTORY if f.name != "path"]
    rows = profile.unique_inodes(inventory(spark, d).select("dev", "ino", "path", *columns))
    return profile.hot_cold(profile.with_top(rows, "/lake"), "top", NOW, 90)


@query(
    r"SELECT DISTINCT '/lake/proj/' || split_part(path, '/', 4) AS path FROM inventory WHERE regexp_matches(path, '^/lake/proj/[^/]+/') AND NOT regexp_matches(path, '^/lake/proj/(ax|ba)[a-z]+/')"
)
def top_directories(spark: SparkSession, d: str) -> DataFrame:
    """Directories right below one, without those that an expression names."""
    return profile.top_directories(
        profile.implied_directories(inventory(spark, d)), "/lake/proj", "/(ax|ba)[[:lower:]]+$"
    ).select("path")


@query(
    "SELECT split_part(substring(path, 12), '/', 1) AS child, count(*) AS items, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM inventory WHERE starts_with(path, '/lake/proj/') GROUP BY 1 ORDER BY bytes DESC, child LIMIT 100"
)
def roll_up(spark: SparkSession, d: str) -> DataFrame:
    """The hundred largest children of a directory."""
    return profile.roll_up(inventory(spark, d), "/lake/proj", 100)


@query(
    "SELECT split_part(substring(path, 7), '/', 1) AS child, count(*) AS items, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM inventory WHERE starts_with(path, '/lake/') GROUP BY 1"
)
def roll_up_all(spark: SparkSession, d: str) -> DataFrame:
    """All children of the root."""
    return profile.roll_up(inventory(spark, d), "/lake")


@query("""
    WITH t AS (SELECT count(*) AS items, CAST(coalesce(sum(size) FILTER (type = 2), 0) AS BIGINT) AS bytes, greatest(1.0, (epoch_us(max(received_at)) - epoch_us(min(received_at))) / 1e6) AS seconds FROM inventory)
    SELECT items, bytes, seconds, items / seconds AS items_per_second, bytes / seconds AS bytes_per_second FROM t""")
def scan_totals(spark: SparkSession, d: str) -> DataFrame:
    return profile.totals(inventory(spark, d))


# Order ------------------------------------------------------------------------------------------------------------------


@query(
    "SELECT inv_id, size, path, row_number() OVER (ORDER BY size DESC NULLS LAST, path, inv_id) - 1 AS row_index FROM inventory"
)
def sorted_index(spark: SparkSession, d: str) -> DataFrame:
    """Every entry's place in a sort by size, descending, and path."""
    rows = inventory(spark, d).select("inv_id", "size", "path")
    return order.numbered(rows, [*order.sort_columns("-size", rows.columns), F.col("inv_id")])


@query(f"""
    WITH r AS (SELECT path, usr AS user, size, row_number() OVER (ORDER BY usr NULLS FIRST, size DESC NULLS LAST, path, inv_id) - 1 AS row_index, count(*) OVER () AS n FROM {_NAMED})
    SELECT path, user, size, row_index FROM r WHERE row_index < 10 OR row_index >= n - 10""")
def head_tail(spark: SparkSession, d: str) -> DataFrame:
    """The first and last ten of a sort by user and size."""
    return order.head_tail(named(spark, d), "user,-size").select("path", "user", "size", "row_index")


@query(
    "SELECT bucket, count(*) AS n, min(path) AS first_path, max(path) AS last_path FROM (SELECT path, CAST(ntile(7) OVER (ORDER BY path, inv_id) - 1 AS INT) AS bucket FROM inventory) GROUP BY bucket"
)
def even_spread(spark: SparkSession, d: str) -> DataFrame:
    """Contiguous runs of paths whose lengths differ by one at most."""
    spread = order.even_spread(inventory(spark, d).select("path", "inv_id"), [F.col("path"), F.col("inv_id")], 7)
    return spread.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"), F.max("path").alias("last_path")
    )


@query(
    "SELECT batch, count(*) AS n, min(inv_id) AS first_id FROM (SELECT inv_id, (row_number() OVER (ORDER BY inv_id) - 1) // 1000 AS batch FROM inventory) GROUP BY batch"
)
def batch_slices(spark: SparkSession, d: str) -> DataFrame:
    """Batches of a thousand consecutive entries."""
    sliced = order.slices(inventory(spark, d).select("inv_id"), [F.col("inv_id")], 1000)
    return sliced.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("inv_id").alias("first_id"))


@query("SELECT depth, count(*) AS entries FROM inventory GROUP BY depth")
def by_depth(spark: SparkSession, d: str) -> DataFrame:
    return order.by_depth(inventory(spark, d))


@query(
    "SELECT count(*) AS batches, CAST(sum(n) AS BIGINT) AS entries, max(n) AS largest, avg(n) AS mean, max(n) / avg(n) AS ratio FROM (SELECT count(*) AS n FROM inventory GROUP BY gid)"
)
def imbalance(spark: SparkSession, d: str) -> DataFrame:
    """How uneven the groups' shares are."""
    return order.imbalance(inventory(spark, d), "gid")


@query(
    "SELECT walk_day, path, inv_id FROM inventory UNION ALL SELECT walk_day, path, inv_id FROM inventory WHERE type = 3"
)
def union_of_walks(spark: SparkSession, d: str) -> DataFrame:
    """Two overlapping inventories as one, without removing what both saw."""
    rows = inventory(spark, d).select("walk_day", "path", "inv_id", "type")
    return schema.combined(rows, rows.filter(F.col("type") == schema.DIRECTORY)).select("walk_day", "path", "inv_id")


# Duplicates, chunks, archives -------------------------------------------------------------------------------------------

_HASHED = "(SELECT path, content, sha256(content) AS digest, strlen(content) AS bytes FROM fragments WHERE type = 2 AND strlen(content) > 0)"


@query(
    f"SELECT path, digest, count(*) OVER (PARTITION BY digest) AS group_size FROM {_HASHED} QUALIFY count(*) OVER (PARTITION BY digest) > 1"
)
def duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Files whose content another has too."""
    return dedup.duplicates(table(spark, d, "fragments"))


@query(
    f"SELECT digest, min(path) AS first_path, count(*) AS copies, max(bytes) * (count(*) - 1) AS wasted FROM {_HASHED} GROUP BY digest HAVING count(*) > 1"
)
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_groups(table(spark, d, "fragments"))


@query(
    "SELECT frag_id, dense_rank() OVER (ORDER BY size NULLS FIRST) - 1 AS group_id, count(*) OVER (PARTITION BY size) AS group_size, row_number() OVER (PARTITION BY size ORDER BY frag_id) - 1 AS group_rank FROM fragments"
)
def ranked_groups(spark: SparkSession, d: str) -> DataFrame:
    """Files grouped by size: number and size of their group, and their place in it."""
    return dedup.ranked_groups(
        table(spark, d, "fragments").select("frag_id", "size"), "size", "frag_id"
    ).select("frag_id", "group_id", "group_size", "group_rank")


@query(
    "SELECT DISTINCT CASE WHEN regexp_replace(path, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END AS parent FROM inventory"
)
def parent_directories(spark: SparkSession, d: str) -> DataFrame:
    return dedup.parent_directories(inventory(spark, d))


@query("""
    WITH f AS (SELECT path, size, unnest(range(greatest(1, CAST((size + 999) // 1000 AS BIGINT)))) AS chunk_no FROM fragments WHERE type = 2 AND size IS NOT NULL)
    SELECT path, chunk_no, chunk_no * 1000 AS "offset", least(1000, size - chunk_no * 1000) AS length, size AS file_size FROM f""")
def file_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Files in chunks of a thousand bytes."""
    return chunks.chunks(table(spark, d, "fragments"), 1000)


@query("""
    WITH c AS (SELECT path, sha256(substring(content, CAST(k * 500 + 1 AS BIGINT), 500)) AS digest FROM
        (SELECT path, content, unnest(range(CAST((greatest(length(content), 1) + 499) // 500 AS BIGINT))) AS k FROM fragments WHERE content IS NOT NULL))
    SELECT path, bool_or(digest < '4') AS flagged FROM c GROUP BY path""")
def chunk_flags(spark: SparkSession, d: str) -> DataFrame:
    """Per file whether any of its chunks has a digest below a bound."""
    cut = chunks.content_chunks(table(spark, d, "fragments"), 500).withColumn("flagged", F.col("digest") < "4")
    return chunks.any_chunk(cut, "flagged")


@query("""
    WITH e AS (SELECT path, CASE WHEN type = 2 THEN 512 + (coalesce(size, 0) + 511) // 512 * 512 ELSE 512 END AS entry_size FROM inventory WHERE type IN (2, 3, 4))
    SELECT path, CAST(entry_size AS BIGINT) AS entry_size, CAST(coalesce(sum(entry_size) OVER (ORDER BY path, entry_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM e""")
def archive_entries(spark: SparkSession, d: str) -> DataFrame:
    """Where each entry starts in an archive of all."""
    return chunks.archive_entries(inventory(spark, d))


@query(
    "SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM inventory WHERE type = 2 AND size >= 67108864"
)
def large_copies(spark: SparkSession, d: str) -> DataFrame:
    """Large files dealt out to eight workers: none is lost."""
    return chunks.assigned_bytes(chunks.balanced(inventory(spark, d), 8)).agg(
        F.sum("files").alias("files"), F.sum("bytes").alias("bytes")
    )


_DEALT = """
    WITH f AS (SELECT list(CAST([size] AS HUGEINT[]) ORDER BY size DESC, path) AS sizes FROM inventory WHERE type = 2 AND size >= 67108864),
    r AS (SELECT list_reduce(list_prepend(list_transform(range(16), lambda x: CAST(0 AS HUGEINT)), sizes), lambda acc, x:
        list_transform(acc, lambda v, i: CASE WHEN i = list_position(acc[1:8], list_min(acc[1:8])) THEN v + x[1] WHEN i = list_position(acc[1:8], list_min(acc[1:8])) + 8 THEN v + 1 ELSE v END)) AS loads FROM f WHERE sizes IS NOT NULL)
    SELECT CAST(w AS INT) AS worker, CAST(loads[w + 9] AS BIGINT) AS files, CAST(loads[w + 1] AS BIGINT) AS bytes FROM r, range(8) AS t(w) WHERE loads[w + 9] > 0
"""


@query(_DEALT)
def balanced_copies(spark: SparkSession, d: str) -> DataFrame:
    """Files and bytes per worker."""
    return chunks.assigned_bytes(chunks.balanced(inventory(spark, d), 8))


# Comparison and synchronisation -----------------------------------------------------------------------------------------


@query(_STATES + "SELECT * FROM st")
def compare_states(spark: SparkSession, d: str) -> DataFrame:
    """Every field of every entry of two trees."""
    return compare.states(src(spark, d), dst(spark, d))


@query(_report_sql(compare.COMPARE_REPORT))
def compare_report(spark: SparkSession, d: str) -> DataFrame:
    """The usual counts of a comparison."""
    return compare.report(compare.states(src(spark, d), dst(spark, d), compare.fields_of(compare.COMPARE_REPORT)))


@query(
    _report_sql(compare.SYNC_REPORT).replace(" AND s.atime_nsec IS NOT DISTINCT FROM d.atime_nsec", "").replace(
        "s.mtime IS NOT DISTINCT FROM d.mtime AND s.mtime_nsec IS NOT DISTINCT FROM d.mtime_nsec THEN 'COMMON' ELSE 'DIFFER' END END AS MTIME",
        "s.mtime IS NOT DISTINCT FROM d.mtime THEN 'COMMON' ELSE 'DIFFER' END END AS MTIME",
    )
)
def sync_report(spark: SparkSession, d: str) -> DataFrame:
    """The mirror tool's counts: metadata times in whole seconds."""
    return compare.report(
        compare.states(src(spark, d), dst(spark, d), compare.fields_of(compare.SYNC_REPORT), nanoseconds=False),
        compare.SYNC_REPORT,
    )


_EXPRESSION = "EXIST=ONLY_SRC,EXIST=COMMON@SIZE=DIFFER,EXIST=COMMON@MTIME=DIFFER@PERM=COMMON,EXIST=DIFFER"


@query(_STATES + """, m AS (SELECT *, CASE WHEN EXIST = 'ONLY_SRC' THEN 0 WHEN EXIST = 'COMMON' AND SIZE = 'DIFFER' THEN 1 WHEN EXIST = 'COMMON' AND MTIME = 'DIFFER' AND PERM = 'COMMON' THEN 2 WHEN EXIST <> 'COMMON' THEN 3 END AS conjunction FROM st)
    SELECT conjunction, count(*) FILTER (EXIST <> 'ONLY_DEST') AS src, count(*) FILTER (EXIST <> 'ONLY_SRC') AS dst FROM m WHERE conjunction IS NOT NULL GROUP BY conjunction""")
def compare_conjunctions(spark: SparkSession, d: str) -> DataFrame:
    """Counts of an expression's parts, each entry in the first that it satisfies."""
    return compare.conjunction_counts(compare.states(src(spark, d), dst(spark, d)), _EXPRESSION)


@query(
    _STATES + "SELECT relpath, unnest(['src', 'dst']) AS side FROM st WHERE EXIST = 'COMMON' AND CONTENT = 'DIFFER' UNION ALL SELECT relpath, 'src' FROM st WHERE EXIST = 'ONLY_SRC'"
)
def compare_matched(spark: SparkSession, d: str) -> DataFrame:
    """The entries that satisfy an expression, by side."""
    return compare.matched(compare.states(src(spark, d), dst(spark, d)), "EXIST=COMMON@CONTENT=DIFFER,EXIST=ONLY_SRC")


@query(
    _STATES + "SELECT count(*) FILTER (EXIST = 'ONLY_SRC') AS only_src, count(*) FILTER (EXIST = 'ONLY_DEST') AS only_dst, count(*) FILTER (EXIST = 'COMMON') AS common FROM st"
)
def compare_counters(spark: SparkSession, d: str) -> DataFrame:
    return compare.counters(compare.states(src(spark, d), dst(spark, d), ["EXIST"]))


@query(
    _TREES + "SELECT relpath, 'common' AS kind FROM j WHERE b UNION ALL SELECT relpath, 'only_src' FROM j WHERE NOT hd UNION ALL SELECT relpath, 'only_dst' FROM j WHERE NOT hs"
)
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Intersection and both differences of two trees."""
    a, b = src(spark, d), dst(spark, d)
    named_ = lambda df, kind: df.select("relpath", F.lit(kind).alias("kind"))
    return named_(compare.common(a, b), "common").unionAll(
        named_(compare.missing(a, b), "only_src")
    ).unionAll(named_(compare.missing(b, a), "only_dst"))


@query(_TREES + "SELECT relpath, CASE WHEN hs THEN 'src' ELSE 'dst' END AS side FROM j WHERE NOT b")
def symmetric_difference(spark: SparkSession, d: str) -> DataFrame:
    return compare.symmetric_difference(src(spark, d), dst(spark, d))


_IDENTITY = "(s.mode <> d.mode OR s.uid IS DISTINCT FROM d.uid OR s.gid IS DISTINCT FROM d.gid OR s.mtime IS DISTINCT FROM d.mtime OR s.mtime_nsec IS DISTINCT FROM d.mtime_nsec)"
_DATA = "(s.size IS DISTINCT FROM d.size OR s.mtime IS DISTINCT FROM d.mtime OR s.mtime_nsec IS DISTINCT FROM d.mtime_nsec)"
_STAT_OF = lambda x: ", ".join(f"{x}.{c}" for c in sync.STAT)
_ACTIONS = _TREES + f""", k AS (SELECT *, b AND s.type <> d.type AS retyped, b AND s.type = d.type AS same, hs AND (NOT hd OR s.type <> d.type) AS made, coalesce(s.link_target, '') <> coalesce(d.link_target, '') AS lt FROM j),
a AS (SELECT relpath, 'REMOVE' AS action, CAST(0 AS BIGINT) AS size, {_STAT_OF('d')}, NULL AS link_target FROM k WHERE retyped OR NOT hs
UNION ALL SELECT relpath, CASE s.type WHEN 3 THEN 'MKDIR' WHEN 4 THEN 'SYMLINK_UPDATE' ELSE 'COPY' END, s.size, {_STAT_OF('s')}, CASE WHEN s.type = 4 THEN s.link_target END FROM k WHERE made
UNION ALL SELECT relpath, 'COPY', s.size, {_STAT_OF('s')}, NULL FROM k WHERE same AND s.type = 2 AND {_DATA}
UNION ALL SELECT relpath, 'SYMLINK_UPDATE', 0, {_STAT_OF('s')}, s.link_target FROM k WHERE same AND s.type = 4 AND lt
UNION ALL SELECT relpath, 'META_UPDATE', 0, {_STAT_OF('s')}, NULL FROM k WHERE same AND CASE WHEN s.type = 2 THEN NOT {_DATA} AND {_IDENTITY} WHEN s.type = 4 THEN NOT lt AND {_IDENTITY} ELSE {_IDENTITY} OR s.size IS DISTINCT FROM d.size END)
"""


@query(_ACTIONS + "SELECT * FROM a")
def sync_actions(spark: SparkSession, d: str) -> DataFrame:
    """What the planner does to make one tree like the other."""
    return sync.actions(src(spark, d), dst(spark, d))


@query(_ACTIONS + """, o AS (SELECT relpath, action, CASE action WHEN 'REMOVE' THEN 0 WHEN 'MKDIR' THEN 1 WHEN 'SYMLINK_UPDATE' THEN 2 WHEN 'COPY' THEN 3 ELSE 4 END AS priority, length(relpath) - length(replace(relpath, '/', '')) + 1 AS dep FROM a)
    SELECT relpath, action, priority, CAST(CASE action WHEN 'REMOVE' THEN -dep WHEN 'MKDIR' THEN dep ELSE 0 END AS INT) AS level FROM o""")
def sync_order(spark: SparkSession, d: str) -> DataFrame:
    """The same in the order of execution."""
    return sync.in_order(sync.actions(src(spark, d), dst(spark, d))).select("relpath", "action", "priority", "level")


@query(
    _ACTIONS + ", n AS (SELECT " + ", ".join(
        f"count(*) FILTER (action = '{x}') AS {x.lower()}" for x in (
            "COPY", "REMOVE", "MKDIR", "SYMLINK_UPDATE", "META_UPDATE"
        )
    ) + " FROM a) SELECT *, CAST(0 AS BIGINT) AS skipped_only_dst FROM n"
)
def sync_counts(spark: SparkSession, d: str) -> DataFrame:
    return sync.action_counts(sync.actions(src(spark, d), dst(spark, d)))


@query(
    _ACTIONS + "SELECT relpath, action, CAST((mode & 61440) = 16384 AND action IN ('REMOVE', 'META_UPDATE') AS BOOLEAN) AS late FROM a"
)
def sync_deferred(spark: SparkSession, d: str) -> DataFrame:
    """Which actions have to wait for the end of all batches."""
    now, late = sync.deferred(sync.actions(src(spark, d), dst(spark, d)))
    return now.select("relpath", "action", F.lit(False).alias("late")).unionAll(
        late.select("relpath", "action", F.lit(True).alias("late"))
    )


@query(_TREES + """, m AS (SELECT relpath, hs, hd, b, coalesce(b AND CASE WHEN (s.mode & 61440) <> (d.mode & 61440) THEN true WHEN (d.mode & 61440) = 40960 THEN s.link_target IS DISTINCT FROM d.link_target
        WHEN (d.mode & 61440) = 32768 THEN s.size IS DISTINCT FROM d.size OR s.mtime IS DISTINCT FROM d.mtime OR s.mtime_nsec IS DISTINCT FROM d.mtime_nsec ELSE false END, false) AS replaced,
        coalesce(b AND (s.uid IS DISTINCT FROM d.uid OR s.gid IS DISTINCT FROM d.gid OR s.atime IS DISTINCT FROM d.atime OR s.mtime IS DISTINCT FROM d.mtime OR (s.mode & 511) <> (d.mode & 511)), false) AS do_refresh FROM j)
    SELECT relpath, replaced OR NOT hs AS do_remove, replaced OR NOT hd AS do_copy, do_refresh, replaced AS content_differs FROM m WHERE replaced OR NOT b OR do_refresh""")
def mirror_lists(spark: SparkSession, d: str) -> DataFrame:
    """The mirror tool's lists with deletion, comparing sizes and times."""
    return sync.mirror(src(spark, d), dst(spark, d), delete=True)


_SAME = "d.type = s.type AND d.size = s.size AND d.mtime = s.mtime AND d.mtime_nsec = s.mtime_nsec"


@query(_TREES + f"""SELECT relpath, how FROM (SELECT s.relpath AS relpath, s.type NOT IN (3, 4) AND coalesce({_SAME}, false) AS linkable,
        coalesce(NOT contains(s.relpath, '7') AND CASE s.type WHEN 4 THEN d.type = 4 AND s.link_target IS NOT DISTINCT FROM d.link_target WHEN 3 THEN d.type = 3 ELSE {_SAME} END, false) AS there,
        CASE WHEN there THEN CASE WHEN linkable THEN 'replace' END WHEN linkable THEN 'hardlink' ELSE 'copy' END AS how FROM s LEFT JOIN d ON s.relpath = d.relpath) WHERE how IS NOT NULL""")
def link_dest(spark: SparkSession, d: str) -> DataFrame:
    """A new copy that has a part of an old copy already and takes unchanged files from that one by hard links."""
    old = dst(spark, d)
    return sync.with_links(src(spark, d), old.filter(~F.col("relpath").contains("7")), old)


@query(
    f"SELECT relpath, uid, gid, CASE WHEN type = 3 THEN (mode & ~4095) | 493 WHEN type = 4 THEN mode ELSE (mode & ~4095) | 420 END AS mode FROM (SELECT relpath, type, mode, CAST(7 AS BIGINT) AS uid, CAST(8 AS BIGINT) AS gid FROM {_side('src_tree', SRC_ROOT)})"
)
def sync_override(spark: SparkSession, d: str) -> DataFrame:
    """The source with other owners and modes."""
    files, directories = modes.parse_override("D0755,F0644")
    return sync.override(src(spark, d), 7, 8, files, directories).select("relpath", "uid", "gid", "mode")


# Plans for one tree -----------------------------------------------------------------------------------------------------


@query("""
    WITH m AS (SELECT path, mode & 4095 AS old_mode, type = 3 AS dir FROM inventory WHERE type <> 4 AND mode IS NOT NULL),
    a AS (SELECT *, old_mode | 384 | CASE WHEN dir THEN 64 ELSE 0 END AS x FROM m), b AS (SELECT *, (x & ~56) | (((x >> 6) & 7) << 3) AS y FROM a), c AS (SELECT *, y & ~7 AS new_mode FROM b)
    SELECT path, old_mode, new_mode FROM c WHERE old_mode <> new_mode""")
def chmod_plan(spark: SparkSession, d: str) -> DataFrame:
    """A change of modes in clauses."""
    return changes.chmod(inventory(spark, d), "u+rwX,g=u,o-rwx")


@query(
    "SELECT path, mode & 4095 AS old_mode, CASE WHEN type = 3 OR (mode & 64) <> 0 THEN ((mode & 4095) | 9 | CASE WHEN type = 3 THEN 64 ELSE 0 END) & ~18 | (mode & 18) ELSE mode & 4095 END AS new_mode FROM inventory WHERE type <> 4 AND mode IS NOT NULL"
)
def chmod_masked(spark: SparkSession, d: str) -> DataFrame:
    """A clause without classes, which leaves the bits of the umask alone; all entries are listed."""
    return changes.chmod(inventory(spark, d), "+X", 0o022, force=True)


@query(
    "SELECT path, mode & 4095 AS old_mode, 488 AS new_mode FROM inventory WHERE type <> 4 AND mode IS NOT NULL AND (mode & 4095) <> 488"
)
def chmod_octal(spark: SparkSession, d: str) -> DataFrame:
    return changes.chmod(inventory(spark, d), "750")


@query(
    "SELECT path, uid AS old_uid, gid AS old_gid, uid AS new_uid, CAST(500 AS BIGINT) AS new_gid FROM inventory WHERE uid IS NOT NULL AND gid <> 500"
)
def chown_plan(spark: SparkSession, d: str) -> DataFrame:
    return changes.chown(inventory(spark, d), gid=500)


@query(
    "SELECT path, link_target AS old_target, '/vault' || substring(link_target, 6) AS new_target FROM inventory WHERE type = 4 AND starts_with(link_target, '/lake/') AND NOT contains(link_target, '/.') AND NOT contains(link_target, '//') AND NOT ends_with(link_target, '/')"
)
def relink_plan(spark: SparkSession, d: str) -> DataFrame:
    """Links moved to another root."""
    return changes.relink(inventory(spark, d), "/lake", "/vault")


@query(
    "SELECT path, type, depth, CAST(CASE WHEN type = 3 THEN (SELECT max(depth) + 1 FROM inventory WHERE type = 3) - depth ELSE 0 END AS INT) AS step FROM inventory"
)
def remove_plan(spark: SparkSession, d: str) -> DataFrame:
    """A removal of everything, directories last and from the bottom."""
    return changes.remove(inventory(spark, d))


@query("SELECT path, depth, mode, uid, gid FROM inventory WHERE type = 3")
def mkdir_plan(spark: SparkSession, d: str) -> DataFrame:
    return changes.make_directories(inventory(spark, d))


_COPY = "(SELECT path, '/backup/home' || substring(path, 11) AS destination, CASE type WHEN 3 THEN 'MKDIR' WHEN 4 THEN 'SYMLINK' WHEN 2 THEN 'COPY' ELSE 'MKNOD' END AS action, CASE WHEN type = 2 THEN coalesce(size, 0) ELSE 0 END AS bytes FROM inventory WHERE path = '/lake/home' OR starts_with(path, '/lake/home/'))"


@query(f"SELECT * FROM {_COPY}")
def copy_plan(spark: SparkSession, d: str) -> DataFrame:
    """Where everything below a directory is copied to."""
    return changes.copy(inventory(spark, d), "/lake/home", "/backup/home")


@query(f"SELECT path, destination, bytes FROM {_COPY} WHERE action = 'COPY'")
def copy_order(spark: SparkSession, d: str) -> DataFrame:
    """The copies among it, the largest first."""
    return changes.launch_order(
        changes.copy(inventory(spark, d), "/lake/home", "/backup/home")
    ).select("path", "destination", "bytes")


@query("""
    WITH f AS (SELECT DISTINCT dev, ino, path FROM inventory WHERE type = 2 AND dev IS NOT NULL AND ino IS NOT NULL), t AS (SELECT dev, ino, min(path) AS target FROM f GROUP BY dev, ino)
    SELECT path, target FROM f JOIN t USING (dev, ino) WHERE path <> target""")
def hard_links(spark: SparkSession, d: str) -> DataFrame:
    """Names that share an inode."""
    return changes.hard_links(inventory(spark, d))


@query("""
    WITH p AS (SELECT path, string_split(path, '/') AS c FROM inventory WHERE starts_with(path, '/lake/proj/')),
    a AS (SELECT array_to_string(c[1:k], '/') AS path FROM (SELECT c, unnest(range(4, len(c) + 1)) AS k FROM p))
    SELECT DISTINCT path FROM a""")
def parent_closure(spark: SparkSession, d: str) -> DataFrame:
    """Paths with all directories between them and a root."""
    inside, _ = filters.subtree(inventory(spark, d), "/lake/proj")
    return changes.with_parents(inside, "/lake/proj")


# Column functions -------------------------------------------------------------------------------------------------------


@query(r"""
    SELECT inv_id, regexp_extract(path, '[^/]*$') AS base, regexp_replace(path, '/[^/]*$', '') AS dir, CAST(len(string_split(path, '/')) AS INT) AS n, CAST(length(path) - length(replace(path, '/', '')) AS INT) AS depth,
    array_to_string(string_split(path, '/')[3:4], '/') AS middle, array_to_string(string_split(path, '/')[-2:], '/') AS last_two, '/backup' || substring(path, 6) AS dest, path AS reduced,
    regexp_replace(path, '/[^/]*$', '') AS up FROM inventory""")
def path_functions(spark: SparkSession, d: str) -> DataFrame:
    """Parts and reductions of paths."""
    p = F.col("path")
    messy = F.concat(F.lit("/../."), p, F.lit("//x/./../"))
    return inventory(spark, d).select(
        "inv_id", paths.basename(p).alias("base"), paths.dirname(p).alias("dir"), paths.count(p).alias("n"), paths.depth(p).alias("depth"), paths.part(p, 2, 2).alias("middle"), paths.part(p, -2).alias("last_two"),
        paths.destination(p, "/lake", "/backup").alias("dest"), paths.reduced(messy).alias("reduced"), paths.absolute(
            F.concat(p, F.lit("/..")), "/elsewhere"
        ).alias("up"),
    )


@query("""
    SELECT inv_id, CASE WHEN path = '/lake/proj' THEN 'EQUAL' WHEN starts_with(path, '/lake/proj/') THEN 'SRC_CHILD' WHEN starts_with('/lake/proj/', path || '/') THEN 'DEST_CHILD' ELSE 'DIFF' END AS relation,
    CASE WHEN path = '/lake/home/user' THEN '' WHEN starts_with(path, '/lake/home/user/') THEN substring(path, 17) WHEN path = '/lake/home' THEN '..' WHEN starts_with(path, '/lake/home/') THEN '../' || substring(path, 12)
    WHEN path = '/lake' THEN '../..' WHEN starts_with(path, '/lake/') THEN '../../' || substring(path, 7) ELSE '../../..' || path END AS way FROM inventory""")
def path_relations(spark: SparkSession, d: str) -> DataFrame:
    """How paths lie to a directory, and the way to them from another."""
    return inventory(spark, d).select(
        "inv_id",
        paths.compare(F.col("path"), F.lit("/lake/proj")).alias("relation"),
        paths.relative(F.lit("/lake/home/user"), F.col("path")).alias("way"),
    )


def _format_sql(names: list[str], base: int, up: bool) -> str:
    number = "CASE " + " ".join(
        f"WHEN size / {float(base**k)!r} > 1.0 THEN {k}" for k in range(len(names) - 1, 0, -1)
    ) + " ELSE 0 END"
    step = f"k + CASE WHEN k < {len(names) - 1} AND size / pow({float(base)!r}, k) > 1000.0 THEN 1 ELSE 0 END" if up else "k"
    return f"(SELECT inv_id, size, {step} AS k FROM (SELECT inv_id, size, {number} AS k FROM inventory WHERE size IS NOT NULL))"


@query(f"""
    SELECT b.inv_id AS inv_id, round(b.size / pow(1024.0, b.k), 6) AS value, list_extract({units.BYTES!r}, CAST(b.k + 1 AS BIGINT)) AS unit, round(c.size / pow(1000.0, c.k), 6) AS count_value,
    list_extract({units.COUNTS!r}, CAST(c.k + 1 AS BIGINT)) AS count_unit, list_extract({units.BANDWIDTHS!r}, CAST(b.k + 1 AS BIGINT)) AS rate_unit, b.size / 1073741824.0 AS gib
    FROM {_format_sql(units.BYTES, 1024, True)} b JOIN {_format_sql(units.COUNTS, 1000, False)} c USING (inv_id)""")
def format_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes in binary and decimal units."""
    size = F.col("size")
    (value, unit), (number, letter), (_, rate) = units.bytes_and_unit(size), units.count_and_unit(size), units.bandwidth_and_unit(size)
    return inventory(spark, d).filter("size IS NOT NULL").select(
        "inv_id",
        F.round(value, 6).alias("value"),
        unit.alias("unit"),
        F.round(number, 6).alias("count_value"),
        letter.alias("count_unit"),
        rate.alias("rate_unit"),
        units.to_unit(size, "g").alias("gib"),
    )


_MODE = "CASE WHEN mode IS NOT NULL THEN CASE mode & 61440 WHEN 16384 THEN 'd' WHEN 40960 THEN 'l' ELSE '-' END || " + " || ".join(f"CASE WHEN (mode & {bit << shift}) <> 0 THEN '{c}' ELSE '-' END" for shift in (6, 3, 0) for c, bit in modes.BITS.items()) + " END"


@query(
    f"SELECT inv_id, {_MODE} AS text, mode & 511 AS perm, CASE WHEN mode IS NULL THEN NULL WHEN (mode & 61440) = 32768 THEN 2 WHEN (mode & 61440) = 16384 THEN 3 WHEN (mode & 61440) = 40960 THEN 4 ELSE 1 END AS kind FROM inventory"
)
def format_modes(spark: SparkSession, d: str) -> DataFrame:
    """Modes in letters, permission bits and types."""
    mode = F.col("mode")
    return inventory(spark, d).select(
        "inv_id",
        modes.mode_string(mode).alias("text"),
        modes.permissions(mode).alias("perm"),
        modes.type_of(mode).alias("kind"),
    )


@query(
    f"SELECT inv_id, {_DAYS('atime')} AS days, {_age_sql('mtime', 60)} AS minutes, strftime(to_timestamp(mtime) AT TIME ZONE 'UTC', '%b ') || lpad(strftime(to_timestamp(mtime) AT TIME ZONE 'UTC', '%-d'), 2, ' ') || strftime(to_timestamp(mtime) AT TIME ZONE 'UTC', ' %Y %H:%M') AS shown FROM inventory"
)
def times(spark: SparkSession, d: str) -> DataFrame:
    """Ages and shown times."""
    return inventory(spark, d).select(
        "inv_id",
        units.age_days(F.col("atime"), NOW).alias("days"),
        units.age_units(F.col("mtime"), F.col("mtime_nsec"), NOW, 0, 60).alias("minutes"),
        units.display_time(F.col("mtime")).alias("shown"),
    )


@query(
    "SELECT frag_id, sha256(content) AS digest, regexp_matches(hex(encode(content)), '^(00)*$') AS all_zero FROM fragments WHERE type = 2 AND content IS NOT NULL"
)
def digests(spark: SparkSession, d: str) -> DataFrame:
    """Digests of contents, and whether they hold nothing but zeros."""
    rows = table(spark, d, "fragments").filter("type = 2 AND content IS NOT NULL")
    return rows.select(
        "frag_id",
        F.sha2("content", 256).alias("digest"),
        F.hex(F.encode("content", "utf-8")).rlike("^(00)*$").alias("all_zero"),
    )


_BYTES = "list_transform(range(1, 2 * strlen(path), 2), lambda i: CAST('0x' || substring(hex(encode(path)), i, 2) AS {}))"


def _jenkins_sql(domain: int | None) -> str:
    """The 32-bit hash as a fold over bytes: x + (x << 10) is 1025 x, modulo 2**32."""
    head = [0, *(int(domain).to_bytes(4, "little") if domain is not None else b"")]
    step = "((((h + b) & 4294967295) * 1025) & 4294967295)"
    folded = f"list_reduce(list_concat([{', '.join(f'{x}::BIGINT' for x in head)}], {_BYTES.format('BIGINT')}), lambda h, b: xor({step}, {step} >> 6))"
    return f"(SELECT (y * 32769) & 4294967295 FROM (SELECT xor(x, x >> 11) AS y FROM (SELECT ({folded} * 9) & 4294967295 AS x)))"


_FNV = f"list_reduce(list_concat([{hashes.FNV_START}::HUGEINT], {_BYTES.format('HUGEINT')}), lambda h, b: (xor(h, b) * {hashes.FNV_FACTOR}) % 18446744073709551616)"


@query(
    f"SELECT inv_id, {_jenkins_sql(None)} AS jenkins, {_jenkins_sql(hashes.SCAN)} AS jenkins_scan, CAST(CASE WHEN v > 9223372036854775807 THEN v - 18446744073709551616 ELSE v END AS BIGINT) AS fnv FROM (SELECT *, {_FNV} AS v FROM inventory)"
)
def owner_hashes(spark: SparkSession, d: str) -> DataFrame:
    """The hashes that decide which worker owns a path or directory."""
    path = F.col("path")
    return inventory(spark, d).select(
        "inv_id",
        hashes.jenkins(path).alias("jenkins"),
        hashes.jenkins(path, hashes.SCAN).alias("jenkins_scan"),
        hashes.fnv(path).alias("fnv"),
    )


@query(_ACTIONS + f""", p AS (SELECT relpath AS path, action FROM a)
    SELECT path AS relpath, action, CAST(CASE WHEN action = 'REMOVE' THEN -1 ELSE {_jenkins_sql(hashes.SOURCE_OWNER)} % 5 END AS INT) AS src_owner, CAST({_jenkins_sql(hashes.DESTINATION_OWNER)} % 3 AS INT) AS dst_owner,
    CAST({_jenkins_sql(hashes.BATCH)} % 4 AS INT) AS batch FROM p""")
def sync_owners(spark: SparkSession, d: str) -> DataFrame:
    """Which workers read and write each action, and its batch."""
    planned = sync.owned(sync.actions(src(spark, d), dst(spark, d)), 5, 3)
    return planned.select(
        "relpath", "action", "src_owner", "dst_owner", hashes.batch(F.col("relpath"), 4).alias("batch")
    )


@query(f"SELECT inv_id, path, CAST({_jenkins_sql(hashes.BATCH)} % 4 AS INT) AS batch FROM inventory")
def hash_batches(spark: SparkSession, d: str) -> DataFrame:
    """All batches of a division by the hash of the path, put together again: each entry in its batch, none lost or doubled."""
    numbered = inventory(spark, d).select("inv_id", "path", hashes.batch(F.col("path"), 4).alias("batch"))
    first, *rest = [numbered.filter(F.col("batch") == k) for k in range(4)]
    return schema.combined(first, *rest)


# Sources and sinks ------------------------------------------------------------------------------------------------------


@query(
    "SELECT path, CAST(length(path) - length(replace(path, '/', '')) AS INT) AS depth, CASE WHEN type IN (2, 3, 4) THEN type ELSE 1 END AS type FROM inventory"
)
def text_cache(spark: SparkSession, d: str) -> DataFrame:
    """The inventory written as a text cache and read again."""
    at = new_folder(spark, "text")
    caches.write_text_cache(inventory(spark, d), at)
    return caches.read_text_cache(spark, at)


@query(
    "SELECT path, CASE WHEN type IN (2, 3, 4) THEN type ELSE 1 END AS type, mode, uid, gid, coalesce(size, 0) AS size, coalesce(atime, 0) AS atime, coalesce(atime_nsec, 0) AS atime_nsec, mtime, mtime_nsec, ctime, ctime_nsec FROM inventory WHERE mode IS NOT NULL"
)
def binary_cache(spark: SparkSession, d: str) -> DataFrame:
    """The inventory written as binary caches and read again."""
    at, known = new_folder(spark, "cache"), inventory(spark, d).filter("mode IS NOT NULL")
    caches.write_binary_cache(known, at)
    return caches.read_binary_cache(spark, at).drop("depth")


@query(f"""
    WITH b AS (SELECT inv_id, k FROM {_format_sql(units.BYTES, 1024, True)})
    SELECT {_MODE} || ' ' || usr || ' ' || grp || ' ' || printf('%7.3f', coalesce(size, 0) / pow(1024.0, coalesce(k, 0))) || ' ' || lpad(list_extract({units.BYTES!r}, CAST(coalesce(k, 0) + 1 AS BIGINT)), 3, ' ') || ' ' ||
    strftime(to_timestamp(mtime) AT TIME ZONE 'UTC', '%b ') || lpad(strftime(to_timestamp(mtime) AT TIME ZONE 'UTC', '%-d'), 2, ' ') || strftime(to_timestamp(mtime) AT TIME ZONE 'UTC', ' %Y %H:%M') || ' ' || path AS line
    FROM {_NAMED} LEFT JOIN b USING (inv_id) WHERE mode IS NOT NULL
    UNION ALL SELECT 'Type=' || CASE type WHEN 3 THEN 'DIR' WHEN 2 THEN 'REG' WHEN 4 THEN 'LNK' ELSE 'UNK' END || ' File=' || path FROM inventory WHERE mode IS NULL""")
def listing(spark: SparkSession, d: str) -> DataFrame:
    """Every entry as a line for people."""
    return caches.listing(named(spark, d))


@query(
    f"SELECT directory AS directory_path, printf('%.6f', total::DOUBLE) AS total, printf('%.6f', cold::DOUBLE) AS cold, printf('%.10f', ratio) AS ratio, errors AS error_count, " + ", ".join(
        f"printf('%.6f', day{k}::DOUBLE) AS day{k}" for k in profile.HOT_DAYS
    ) + f" FROM ({_hot_sql('inventory')})"
)
def csv_report(spark: SparkSession, d: str) -> DataFrame:
    """The hot and cold report, written as CSV and read again."""
    at = new_folder(spark, "csv")
    caches.write_csv_report(hot_cold(spark, d), at)
    days = ", ".join(f"day{k} string" for k in profile.HOT_DAYS)
    return spark.read.option("header", True).option("escape", '"').schema(
        f"directory_path string, total string, cold string, ratio string, error_count bigint, {days}"
    ).csv(at)


@query(f"""
    SELECT {NOW}::BIGINT AS generated_at, (SELECT count(*) FROM inventory WHERE type = 2) AS files, (SELECT count(*) FROM inventory WHERE mode IS NULL) AS scan_errors,
    CAST({len(profile.SIZE_ENDS)} AS INT) AS size_bins, (SELECT count(*) FROM inventory WHERE type = 2 AND size IS NOT NULL) AS sized, CAST({3 * len(profile.AGE_ENDS)} AS INT) AS age_bins,
    (SELECT CAST(coalesce(sum(size * (CAST(atime IS NOT NULL AS INT) + CAST(mtime IS NOT NULL AS INT) + CAST(ctime IS NOT NULL AS INT))), 0) AS BIGINT) FROM inventory WHERE type = 2) AS aged_bytes,
    (SELECT count(*) FROM (SELECT 1 FROM inventory WHERE {_FLAGS} <> 0 LIMIT 100)) AS broken, (SELECT min(path) FROM inventory WHERE {_FLAGS} <> 0) AS first_broken""")
def json_report(spark: SparkSession, d: str) -> DataFrame:
    """The profile as one JSON text, and what it says when it is read again."""
    text = caches.json_report(
        type_counts(spark, d), file_size_profile(spark, d), age_profile(spark, d), broken_sample(spark, d), NOW
    )
    kind = "generated_at bigint, summary struct<files: bigint, scan_errors: bigint>, size_histogram array<struct<number: bigint>>, age_histograms array<struct<bytes: bigint>>, broken_paths array<struct<path: string>>"
    total = lambda name, field: F.aggregate(f"r.{name}", F.lit(0).cast("bigint"), lambda s, x: s + x[field])
    return text.select(F.from_json("value", kind).alias("r")).select(
        "r.generated_at",
        "r.summary.files",
        "r.summary.scan_errors",
        F.size("r.size_histogram").alias("size_bins"),
        total("size_histogram", "number").alias("sized"),
        F.size("r.age_histograms").alias("age_bins"),
        total("age_histograms", "bytes").alias("aged_bytes"),
        F.size("r.broken_paths").cast("bigint").alias("broken"),
        F.try_element_at("r.broken_paths", F.lit(1))["path"].alias("first_broken"),
    )


_G = lambda what: "(((((i + " + str(
    3 * 7919 + what * 104729
) + ") % 2147483647 + 1) * 48271 % 2147483647 + " + f"{what}) * 48271 % 2147483647 + {what}) * 48271 % 2147483647 + {what})"


@query(f"""
    WITH g AS (SELECT i, CAST(2 + {_G(1)} % 3 AS INT) AS type FROM range(20000) AS t(i))
    SELECT '/synthetic/d' || (i // 16) || '/' || CASE type WHEN 2 THEN 'file_' WHEN 3 THEN 'dir_' ELSE 'link_' END || lpad(CAST(i AS VARCHAR), 8, '0') AS path, 3 AS depth, type,
    CASE type WHEN 2 THEN 33188 WHEN 3 THEN 16877 ELSE 41471 END AS mode, {_G(3)} % 100 AS uid, CASE WHEN type = 2 THEN {_G(2)} % 1048576 ELSE 0 END AS size, 1767225600 - {_G(4)} % 126144000 AS mtime FROM g""")
def synthetic_tree(spark: SparkSession, d: str) -> DataFrame:
    """A made-up tree of 20,000 entries."""
    return synthetic.tree(spark, 20_000, seed=3)


@query("SELECT type, count(*) AS entries, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM inventory GROUP BY type")
def stream_profile(spark: SparkSession, d: str) -> DataFrame:
    """Entries and bytes by type, as a stream over the inventory's files."""
    stream = streaming.arriving(spark, f"{d}/inventory.parquet")
    return streaming.run_complete(streaming.type_profile(stream), new_folder(spark, "stream"))


@query(
    "SELECT CAST(epoch(time_bucket(INTERVAL 6 HOUR, ts)) AS BIGINT) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2"
)
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per six hours and type, as a stream."""
    stream = streaming.arriving(spark, f"{d}/events.parquet")
    return streaming.run_complete(
        streaming.windows(stream, "ts", ["event_type"], "6 hours", "1 day"), new_folder(spark, "stream")
    )
