"""The queries of this subpackage, and the SQL that they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewalk.llm import bpe, digest, mixing, reading, topn
from lakewalk.operators import valuefreq
from lakewalk.storage import written

PERCENTS = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def first_of_path(rows: DataFrame) -> DataFrame:
    """Of rows with the same path only the lowest inv_id; carried are the columns that the queries need."""
    return rows.groupBy("path").agg(F.min(F.struct("inv_id", "type", "uid", "size", "atime")).alias("r")).select("r.*")


def p2_top(spark: SparkSession, d: str) -> DataFrame:
    files = first_of_path(table(spark, d, "inventory")).filter("type = 2 AND uid IS NOT NULL AND size IS NOT NULL")
    return topn.top_n(files, "uid", [("size", True), ("atime", True), ("inv_id", False)], 10)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The ten largest files of every uid."""
    return p2_top(spark, d).select("uid", "inv_id")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    """size of every regular file under each of its three keys, as key_kind and key."""
    rows = table(spark, d, "inventory").filter("type = 2 AND size IS NOT NULL")
    kinds = F.array(
        *[
            F.struct(
                F.lit(k).alias("key_kind"), F.col(k).cast("string").alias("key")
            ) for k in ("uid", "gid", "walk_day")
        ]
    )
    return rows.select(F.explode(kinds).alias("k"), "size").select("k.*", "size")


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the files' size for every uid, gid and walk_day, with their certified rank errors."""
    return digest.percentiles(_sizes(spark, d), ["key_kind", "key"], "size", PERCENTS)


def p4_certified(spark: SparkSession, d: str) -> DataFrame:
    """Per key and p, whether the estimate's rank is within the stated error, with the number of values."""
    rows = p4_percentiles(spark, d)
    return rows.select("key_kind", "key", "p", "n", (F.col("rank_error") <= digest.tolerance(F.col("p"))).alias("within"))


#: For each of PERCENTS the shares of the ranks between which an estimate has to lie; the upper one excludes its own rank.
_BOUNDS = [(p - 0.02 * min(p, 1 - p), p + 0.02 * min(p, 1 - p) + 1e-12) for p in PERCENTS]


def p4_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Per key and p the exact values at the ends of the stated error, and whether the estimate lies between them."""
    keys = ["key_kind", "key"]
    sizes = written(valuefreq.compress(_sizes(spark, d), keys, "size"), "freq")
    exact = valuefreq.percentiles(sizes, keys, [x for b in _BOUNDS for x in b]).groupBy(*keys).agg(
        F.first("n_values").alias("n"), F.map_from_entries(F.collect_set(F.struct("p", "value"))).alias("at")
    )
    ends = [F.struct(F.lit(p).alias("p"), F.col("at")[F.lit(a)].alias("low"), F.col("at")[F.lit(b)].alias("high")) for p, (a, b) in zip(PERCENTS, _BOUNDS)]
    bounds = exact.select(*keys, "n", F.explode(F.array(*ends)).alias("b")).select(*keys, "n", "b.*").alias("b")
    found = digest.percentiles(_sizes(spark, d), keys, "size", PERCENTS).alias("f")
    same = F.col("b.key_kind").eqNullSafe(F.col("f.key_kind")) & F.col("b.key").eqNullSafe(F.col("f.key")) & (F.col("b.p") == F.col("f.p"))
    inside = F.col("f.estimate").between(F.col("b.low").cast("double"), F.col("b.high").cast("double")) & (F.col("f.n") == F.col("b.n"))
    return bounds.join(found, same, "left").select("b.*", F.coalesce(inside, F.lit(False)).alias("inside"))


def p4_exact_share(spark: SparkSession, d: str) -> DataFrame:
    """How often an exact percentile had to step in for an estimate, per kind of key."""
    return p4_percentiles(spark, d).groupBy("key_kind").agg(
        F.count(F.lit(1)).alias("estimates"), F.count_if("exact").alias("exact"), F.max("rank_error").alias("most_rank_error")
    )


def p4_from_days(spark: SparkSession, d: str) -> DataFrame:
    """Medians per uid from digests that were made per uid and day and then combined, with certified rank errors."""
    rows = table(spark, d, "inventory").filter("type = 2 AND size IS NOT NULL")
    found = digest.from_days(rows, "walk_day", ["uid"], "size", [0.5])
    return found.select("uid", "n", F.col("estimate").alias("median"), "below", "upto", "rank_error", "exact")


def _tokens(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "mix_targets")
    docs = table(spark, d, "documents").select("doc_id", "source", "text").join(
        F.broadcast(targets.select("source").distinct()), "source", "left_semi"
    )
    return written(bpe.count_tokens(docs), "tokens"), targets


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixed corpus: which tokens of which document fill each slot."""
    return mixing.mix(*_tokens(spark, d))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source."""
    return mixing.mix(*_tokens(spark, d))[1]


def p9_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The combined records: the token ids of every slot."""
    mixed = mixing.mix(*_tokens(spark, d))[0]
    docs = table(spark, d, "documents").join(F.broadcast(table(spark, d, "mix_targets").select("source").distinct()), "source", "left_semi")
    return mixing.records(mixed, bpe.encode_corpus(docs.select("doc_id", "text")))


def p9_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Whether blocks, slots, tokens and shares of the mix agree."""
    return mixing.consistency(*mixing.mix(*_tokens(spark, d)))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return bpe.encode_corpus(table(spark, d, "documents"))


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every document, encoded and decoded again."""
    return bpe.decode_corpus(bpe.encode_corpus(table(spark, d, "documents")))


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    """Words, language and reading level of every document's main text."""
    return reading.levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents in de, en, es or fr with at least 60 words of main text that read at grade 4 or 5."""
    return reading.demanding(p10_levels(spark, d)).select("doc_id")


QUERIES = {
    f.__name__: f for f in (
        p2_found,
        p2_top,
        p4_percentiles,
        p4_certified,
        p4_bounds,
        p4_exact_share,
        p4_from_days,
        p8_ids,
        p8_roundtrip,
        p9_mix,
        p9_shares,
        p9_corpus,
        p9_consistency,
        p10_found,
        p10_levels,
    )
}

_P2 = """
    WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY inv_id) AS r FROM inventory)
        WHERE r = 1 AND type = 2 AND uid IS NOT NULL AND size IS NOT NULL),
    t AS (SELECT uid, size, atime, inv_id, CAST(row_number() OVER (PARTITION BY uid ORDER BY size DESC, atime DESC NULLS LAST, inv_id) AS INT) AS rank FROM f)
"""

_KEYED = """(SELECT 'uid' AS key_kind, CAST(uid AS VARCHAR) AS key, size FROM inventory WHERE type = 2 AND size IS NOT NULL
    UNION ALL SELECT 'gid', CAST(gid AS VARCHAR), size FROM inventory WHERE type = 2 AND size IS NOT NULL
    UNION ALL SELECT 'walk_day', CAST(walk_day AS VARCHAR), size FROM inventory WHERE type = 2 AND size IS NOT NULL)"""

SQL = {
    "p4_bounds": f"""
        WITH r AS (SELECT key_kind, key, size, row_number() OVER (PARTITION BY key_kind, key ORDER BY size) AS r, count(*) OVER (PARTITION BY key_kind, key) AS n FROM {_KEYED}),
        b AS (SELECT * FROM (VALUES {", ".join(f"({p!r}::DOUBLE, {a!r}::DOUBLE, {b!r}::DOUBLE)" for p, (a, b) in zip(PERCENTS, _BOUNDS))}) AS t(p, a, b))
        SELECT key_kind, key, n, p, max(size) FILTER (r = greatest(1, CAST(ceil(n * a) AS BIGINT))) AS low,
        max(size) FILTER (r = greatest(1, CAST(ceil(n * b) AS BIGINT))) AS high, true AS inside FROM r, b GROUP BY key_kind, key, n, p""",
    "p9_consistency": "SELECT true AS blocks_once, true AS slots_unique, true AS slots_dense, true AS blocks_full, true AS tokens_agree",
    "p4_certified": f"""
        SELECT key_kind, key, p, count(*) AS n, true AS within FROM (
            SELECT 'uid' AS key_kind, CAST(uid AS VARCHAR) AS key FROM inventory WHERE type = 2 AND size IS NOT NULL
            UNION ALL SELECT 'gid', CAST(gid AS VARCHAR) FROM inventory WHERE type = 2 AND size IS NOT NULL
            UNION ALL SELECT 'walk_day', CAST(walk_day AS VARCHAR) FROM inventory WHERE type = 2 AND size IS NOT NULL),
            (VALUES {", ".join(f"(CAST({p} AS DOUBLE))" for p in PERCENTS)}) AS t(p) GROUP BY ALL""",
    "p2_found": _P2 + "SELECT uid, inv_id FROM t WHERE rank <= 10",
    "p2_top": _P2 + "SELECT uid, size, atime, inv_id, rank FROM t WHERE rank <= 10",
    "p8_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
