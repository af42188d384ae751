"""Percentiles of very large numeric columns from merging centroid digests, with a certified rank error.

A digest holds per key some tens to hundreds of centroids: neighbouring values, clustered so that a cluster's share of
the rows shrinks towards the ends of the distribution. Digests of parts are merged by clustering their centroids again,
so those of separate days or partitions can be kept and combined. A second pass over the values counts, for every
estimate, the rows below it and up to it, which certifies the rank error instead of assuming it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewalk.operators import valuefreq
from lakewalk.storage import written

#: Clusters per digest, about; the rank error of an estimate is near pi / (2 * DELTA) at most.
DELTA = 300
#: The rank error that is certified at the median, as a share of the key's rows; at other p see ``tolerance``.
RANK_ERROR = 0.01
#: Rows per part of the first clustering. A key of whatever size is split into parts of about that many.
PART_ROWS = 200_000
#: So many digests are merged in one step.
FAN_IN = 64
#: Up to so many keys that are split into parts are broadcast.
MOST_LARGE = 1_000_000
#: The columns of a cluster.
POINT = ("mean", "w", "low", "high")


def _clustered(points: DataFrame, keys: Sequence[str], delta: int) -> DataFrame:
    """Cluster (keys, mean, w, low, high) sorted by mean: the cluster number is the integer part of the arc sine scale,
    delta * (asin(2q - 1) / pi + 1/2), at the quantile q of the point's middle."""
    by_key = Window.partitionBy(*keys)
    upto = F.sum("w").over(by_key.orderBy("mean", "low", "high", "w").rowsBetween(Window.unboundedPreceding, 0))
    q = (F.col("upto") - F.col("w") / 2) / F.sum("w").over(by_key)
    number = F.floor(
        F.lit(delta) * (
            F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q * 2 - 1))) / F.lit(3.141592653589793) + 0.5
        )
    )
    return (
        points.withColumn("upto", upto)
        .withColumn("cluster", number.cast("int"))
        .groupBy(*keys, "cluster")
        .agg(
            (F.sum(F.col("mean") * F.col("w")) / F.sum("w")).alias("mean"),
            F.sum("w").alias("w"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
        )
        .drop("cluster")
    )


def weighted(df: DataFrame, keys: Sequence[str], value: str, part_rows: int) -> DataFrame:
    """keys, part, value, w: the distinct values with their numbers, combined before the shuffle. Nulls don't count.

    A key of more than ``part_rows`` rows has a part for each so many, by the hash of the value; others have one. The large
    keys, at most one for ``part_rows`` rows of the table, are broadcast if there are no more than MOST_LARGE of them.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("value"))
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > part_rows)
    large = written(large.select(*keys, F.ceil(F.col("_n") / part_rows).cast("int").alias("_parts")), "large")
    joined = rows.alias("r").join(
        F.broadcast(large).alias("l") if large.count() <= MOST_LARGE else large.alias("l"), _same("r", "l", keys), "left"
    )
    part = F.pmod(F.xxhash64("value"), F.coalesce("_parts", F.lit(1))).cast("int").alias("part")
    return joined.select(*[F.col(f"r.{k}").alias(k) for k in keys], part, "value").groupBy(
        *keys, "part", "value"
    ).agg(F.count(F.lit(1)).alias("w"))


def digests(values: DataFrame, keys: Sequence[str], delta: int = DELTA) -> DataFrame:
    """Digests of the parts of ``weighted`` values: keys, part, mean, w, low, high."""
    value = F.col("value").cast("double")
    return _clustered(
        values.select(*keys, "part", value.alias("mean"), "w", value.alias("low"), value.alias("high")),
        [*keys, "part"],
        delta,
    )


def merged(digest: DataFrame, keys: Sequence[str], delta: int = DELTA, fan_in: int = FAN_IN) -> DataFrame:
    """One digest per ``keys`` from any number of digests of parts, days or anything else that ``keys`` leaves out.

    A key of more than ``fan_in`` digests' clusters is merged in steps: its digests are dealt out by the columns that ``keys``
    leaves out, so that no task sorts many more than ``fan_in`` of them, however many parts or days a key has.
    """
    names = [c for c in digest.columns if c not in (*keys, *POINT)] or ["mean", "low", "high"]
    digest = written(digest, "digest")
    largest = lambda: digest.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    while (most := largest()) > fan_in * delta:
        group = F.pmod(F.xxhash64(*names), F.lit(-(-most // (fan_in * delta)))).alias("_group")
        digest = written(_clustered(digest.select(*keys, group, *POINT), [*keys, "_group"], delta), "digest")
        names = ["_group"]
    return _clustered(digest.select(*keys, *POINT), keys, delta)


def estimates(digest: DataFrame, keys: Sequence[str], ps: Sequence[float]) -> DataFrame:
    """keys, n, estimate: an array with, for each of ``ps``, a value from the cluster that holds rank p * n, by linear
    interpolation between the cluster's extremes."""
    by_key = Window.partitionBy(*keys)
    order = by_key.orderBy("mean", "low", "high", "w").rowsBetween(Window.unboundedPreceding, 0)
    placed = digest.withColumn("upto", F.sum("w").over(order)).withColumn("n", F.sum("w").over(by_key))
    chosen = []
    for i, p in enumerate(ps):
        rank = F.greatest(F.lit(0.5), F.col("n") * F.lit(float(p)))
        inside = (rank <= F.col("upto")) & (rank > F.col("upto") - F.col("w"))
        share = (rank - (F.col("upto") - F.col("w"))) / F.col("w")
        chosen.append(F.max(F.when(inside, F.col("low") + (F.col("high") - F.col("low")) * share)).alias(f"e{i}"))
    return placed.groupBy(*keys, "n").agg(*chosen).select(
        *keys, "n", F.array(*[F.col(f"e{i}") for i in range(len(ps))]).alias("estimate")
    )


def _same(left: str, right: str, keys: Sequence[str]) -> list[Column]:
    return [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]


def certified(
    values: DataFrame, found: DataFrame, keys: Sequence[str], ps: Sequence[float], spread: Sequence[str] = ("part",)
) -> DataFrame:
    """The counting pass: keys, n, p, estimate, below, upto (rows under the estimate, and under or at it), rank_error.

    The estimates are joined to the parts (``spread``) of their keys first, so that a hot key's values stay spread over them.
    rank_error is the distance of p from the interval [below / n, upto / n]: 0 if the estimate is a true percentile.
    """
    parts = values.select(*keys, *spread).distinct()
    to_part = parts.alias("a").join(found.alias("b"), _same("a", "b", keys)).select(
        *[F.col(f"a.{k}").alias(k) for k in (*keys, *spread)], "n", "estimate"
    )
    joined = values.alias("v").join(to_part.alias("e"), _same("v", "e", [*keys, *spread]))
    at = [F.col("e.estimate")[i] for i in range(len(ps))]
    value = F.col("v.value").cast("double")
    counts = joined.groupBy(*[F.col(f"v.{k}").alias(k) for k in keys]).agg(
        F.first("e.n").alias("n"), F.first("e.estimate").alias("estimate"), *[F.sum(F.when(value < e, F.col("v.w")).otherwise(0)).alias(f"b{i}") for i, e in enumerate(at)], *[
            F.sum(F.when(value <= e, F.col("v.w")).otherwise(0)).alias(f"u{i}") for i, e in enumerate(at)
        ]
    )
    each = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col("estimate")[i].alias("estimate"), F.col(f"b{i}").alias("below"), F.col(f"u{i}").alias("upto")) for i, p in enumerate(ps)])).alias("r")
    error = F.greatest(F.lit(0.0), F.col("below") / F.col("n") - F.col("p"), F.col("p") - F.col("upto") / F.col("n"))
    return counts.select(*keys, "n", each).select(*keys, "n", "r.*").withColumn("rank_error", error)


def tolerance(p: Column, rank_error: float = RANK_ERROR) -> Column:
    """The rank error allowed at p: ``rank_error`` at the median, less towards the ends in proportion to min(p, 1 - p)."""
    return F.lit(2 * rank_error) * F.least(p, 1 - p)


def settled(
    values: DataFrame, found: DataFrame, keys: Sequence[str], ps: Sequence[float], rank_error: float, spread: Sequence[str] = ("part",)
) -> DataFrame:
    """The estimates with their certified rank errors; exact percentiles, counted likewise, in place of those that miss
    the ``tolerance``."""
    checked = written(certified(values, found, keys, ps, spread), "certified")
    within = F.col("rank_error") <= tolerance(F.col("p"), rank_error)
    missed = checked.filter(~within)
    kept = checked.filter(within).withColumn("exact", F.lit(False))
    if missed.isEmpty():
        return kept
    bad = missed.select(*keys).distinct()
    open_values = values.alias("v").join(
        bad.alias("b"), _same("v", "b", keys), "left_semi"
    ).select(*keys, *spread, "value", "w")
    freq = open_values.groupBy(*keys, "value").agg(F.sum("w").alias("freq"))
    exact = valuefreq.percentiles(freq, keys, ps).groupBy(*keys).agg(
        F.first("n_values").alias("n"),
        F.array(*[F.max(F.when(F.col("p") == float(p), F.col("value"))).cast("double") for p in ps]).alias("estimate"),
    )
    counted = certified(open_values, exact, keys, ps, spread).alias("x")
    fixed = counted.join(
        missed.select(*keys, "p").alias("m"), [*_same("x", "m", keys), F.col("x.p") == F.col("m.p")], "left_semi"
    )
    return kept.unionByName(fixed.withColumn("exact", F.lit(True)))


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ps: Sequence[float],
    rank_error: float = RANK_ERROR,
    delta: int = DELTA,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Per key and p: n, estimate, below, upto, rank_error and exact (false, or true where an exact value had to step in).

    ``rank_error`` is that allowed at the median, and less towards the ends by ``tolerance``: where a digest's estimate
    misses it, the exact percentile of the key is computed and taken, and its rows are counted too. Null values don't count and keys without values give no rows; a null key is a key. The
    values must be numbers; integers beyond 2**53 are rounded to doubles in the estimates.
    """
    keys = list(keys)
    values = written(weighted(df, keys, value, part_rows), "values")
    found = estimates(merged(digests(values, keys, delta), keys, delta), keys, ps)
    return settled(values, found, keys, ps, rank_error)


def from_days(
    df: DataFrame,
    day: str,
    keys: Sequence[str],
    value: str,
    ps: Sequence[float],
    rank_error: float = RANK_ERROR,
    delta: int = DELTA,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """As ``percentiles``, but from one stored digest per ``keys`` and day, which are then read and combined to one per
    ``keys``. A day of a key is clustered in parts of about ``part_rows``, so a hot key's day isn't one task."""
    keys = list(keys)
    values = written(weighted(df, [day, *keys], value, part_rows), "values")
    daily = written(merged(digests(values, [day, *keys], delta), [day, *keys], delta), "daily")
    found = estimates(merged(daily, keys, delta), keys, ps)
    return settled(values, found, keys, ps, rank_error, [day, "part"])
