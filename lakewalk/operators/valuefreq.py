"""Per-key results without imbalance, when a few keys hold most of the rows: value-frequency compression.

Rows are first grouped by key *and* value, which combines before the shuffle and spreads a hot key over all its values.
Counts, distinct counts, modes and percentiles then come from the weighted values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewalk.storage import written

#: A cell of values: sign, exponent and leading bits of the mantissa. Cells ascend with the values in them.
CELL_BITS = 8
#: Distinct values that a cell may have to be sorted in one task, and the parts that a larger one is cut into.
CELL_VALUES, SPLIT = 200_000, 4096


def compress(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, value, freq. Null values are kept as a value (their frequency counts rows); null keys are keys."""
    return df.groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("freq"))


def by_kind(df: DataFrame, kinds: Sequence[str], value: Column) -> DataFrame:
    """One row per kind and row of ``df``: key_kind, key_id, value. All kinds go through one grouping."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key_kind"), F.col(k).cast("bigint").alias("key_id")) for k in kinds])
    return df.select(F.explode(pairs).alias("k"), value.alias("value")).select("k.*", "value")


def key_counts(freq: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: rows, valued rows, distinct values, sum, and mode with its frequency (the lowest of the most frequent
    values). Of a key with null values only: 0, null sum and null mode."""
    valued = F.col("value").isNotNull()
    return freq.groupBy(*keys).agg(
        F.sum("freq").alias("n_rows"),
        F.sum(F.when(valued, F.col("freq")).otherwise(0)).alias("n_values"),
        F.count("value").alias("n_distinct"),
        F.sum(F.when(valued, F.col("value").cast("decimal(38,0)") * F.col("freq"))).alias("total"),
        F.max(F.when(valued, F.struct("freq", (-F.col("value")).alias("neg")))).alias("top"),
    ).select(*keys, "n_rows", "n_values", "n_distinct", "total", (-F.col("top.neg")).alias("mode_value"), F.col("top.freq").alias("mode_freq"))


def cell(value: Column, bits: int = CELL_BITS) -> Column:
    """The value's cell: at most 64 * 2**bits non-negative ones and as many negative, in the order of the values."""
    magnitude = F.abs(value.cast("decimal(20,0)")).cast("double")
    exponent = F.when(magnitude < 1, F.lit(0)).otherwise(F.floor(F.log2(F.greatest(magnitude, F.lit(1.0)))))
    power = F.pow(F.lit(2.0), exponent)
    index = F.when(magnitude < 1, F.lit(0)).otherwise(
        (exponent + 1) * 2**bits + F.floor((magnitude / power - 1) * 2**bits)
    ).cast("bigint")
    return F.when(value < 0, -index).otherwise(index)


def percentiles(freq: DataFrame, keys: Sequence[str], ps: Sequence[float], most: int = CELL_VALUES) -> DataFrame:
    """Exact percentiles per key: keys, p, n_values, value; the least value whose cumulative weight reaches p * n.

    Values of a key are first counted by cell, so that no task ever holds all values of a key: the running sum over
    cells has at most some ten thousand rows per key, and only the values of the few cells in which a percentile falls
    are sorted, each cell by itself. A cell of more than ``most`` distinct values (a hot key whose values lie close
    together) is cut into SPLIT equal ranges between its least and greatest value, counted again, and so on. Keys without
    values give no rows; null values don't count.
    """
    keys = list(keys)
    where = [*keys, "cell"]
    freq = freq.filter(F.col("value").isNotNull()).select(*keys, cell(F.col("value")).alias("cell"), "value", "freq")
    counted = _counted(freq, where)
    by_key = Window.partitionBy(*keys)
    running = counted.withColumn(
        "upto", F.sum("w").over(by_key.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("n_values", F.sum("w").over(by_key))
    ranks = [
        F.struct(
            F.lit(float(p)).alias("p"),
            F.greatest(F.lit(1), F.ceil(F.col("n_values") * F.lit(float(p)))).cast("bigint").alias("rank"),
        ) for p in ps
    ]
    targets = written(_holding(running.withColumn("ts", F.array(*ranks)), where), "cells")
    inside, done = _values_of(freq, targets, where), []
    while not targets.filter(F.col("n") > most).isEmpty():
        done.append(_placed(inside.filter(F.col("n") <= most), where))
        inside = inside.filter(F.col("n") > most)
        share = (F.col("value") - F.col("low")).cast("double") / (F.col("high") - F.col("low")).cast("double")
        sub = f"cell{len(done)}"
        split = written(inside.withColumn(sub, F.floor(share * (SPLIT - 1))), "split")
        finer = _counted(split, [*where, sub], "n_values", "before", "ts")
        order = Window.partitionBy(*where).orderBy(sub).rowsBetween(Window.unboundedPreceding, 0)
        upto = finer.withColumn("upto", F.col("before") + F.sum("w").over(order))
        where = [*where, sub]
        targets = written(_holding(upto, where), "cells")
        inside = _values_of(split.select(*where, "value", "freq"), targets, where)
    done.append(_placed(inside, where))
    return reduce(DataFrame.unionByName, [d.select(*keys, "p", "n_values", "value") for d in done])


def _counted(values: DataFrame, where: Sequence[str], *kept: str) -> DataFrame:
    """Per cell: weight, number of distinct values, least and greatest value."""
    return values.groupBy(*where).agg(
        F.sum("freq").alias("w"),
        F.count(F.lit(1)).alias("n"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        *[F.first(c).alias(c) for c in kept],
    )


def _holding(running: DataFrame, where: Sequence[str]) -> DataFrame:
    """The cells that hold one of the ranks ``ts``, with those and the weight before the cell."""
    before = F.col("upto") - F.col("w")
    held = F.filter("ts", lambda t: (t["rank"] <= F.col("upto")) & (t["rank"] > before))
    return running.select(
        *where, "n", "low", "high", "n_values", before.alias("before"), held.alias("ts")
    ).filter(F.size("ts") > 0)


def _values_of(values: DataFrame, targets: DataFrame, where: Sequence[str]) -> DataFrame:
    same = [F.col(f"v.{k}").eqNullSafe(F.col(f"t.{k}")) for k in where]
    return values.alias("v").join(targets.alias("t"), same).select(
        *[F.col(f"v.{k}").alias(k) for k in where], "value", "freq", "n", "low", "high", "n_values", "before", "ts"
    )


def _placed(inside: DataFrame, where: Sequence[str]) -> DataFrame:
    """The values at the ranks, by sorting each cell."""
    in_cell = Window.partitionBy(*where).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("upto", F.col("before") + F.sum("freq").over(in_cell))
    return (
        ranked.select(*where, "value", "n_values", "freq", "upto", F.explode("ts").alias("t"))
        .filter("t.rank <= upto AND t.rank > upto - freq")
        .select(*where, F.col("t.p").alias("p"), "n_values", "value")
    )


def hot_keys(counts: DataFrame, total_rows: int, share: float = 0.01) -> DataFrame:
    """The non-null keys that hold at least ``share`` of all rows."""
    return counts.filter(F.col("key_id").isNotNull() & (F.col("n_rows") >= F.lit(share) * F.lit(total_rows)))


def per_key(
    df: DataFrame, kinds: Sequence[str], value: Column, ps: Sequence[float] = (0.5, 0.9, 0.99)
) -> tuple[DataFrame, DataFrame]:
    """``key_counts`` and ``percentiles`` for several kinds of key from one compressed table."""
    freq = written(compress(by_kind(df, kinds, value), ["key_kind", "key_id"], "value"), "freq")
    return key_counts(freq, ["key_kind", "key_id"]), percentiles(freq, ["key_kind", "key_id"], ps)
