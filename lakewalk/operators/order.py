"""Global order without a global task: row numbers, running sums, even spreads, heads and tails.

A table is range-partitioned by its order and numbered partition by partition; only the partitions' totals are summed
up in one place. No window ever holds more than one partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewalk.storage import written

FIELDS = ["name", "user", "group", "uid", "gid", "atime", "mtime", "ctime", "size"]


def sort_keys(fields: str, columns: Sequence[str]) -> list[tuple[str, bool]]:
    """'-size,name' as (column, descending?). Times compare with their nanoseconds where the inventory has them; the path
    always settles ties. A field that doesn't exist or comes twice raises ValueError."""
    keys, seen = [], set()
    for field in filter(None, fields.split(",")):
        name, down = field.lstrip("-"), field.startswith("-")
        if name not in FIELDS or name in seen:
            raise ValueError(f"can't sort by {field!r}")
        seen.add(name)
        column = "path" if name == "name" else name
        if column not in columns:
            raise ValueError(f"no column {column!r} to sort by")
        keys += [(c, down) for c in ([column, f"{column}_nsec"] if f"{column}_nsec" in columns else [column])]
    return keys if "name" in seen else [*keys, ("path", False)]


def _ordered(keys: Sequence[tuple[str, bool]], backwards: bool = False) -> list[Column]:
    return [F.col(c).desc_nulls_last() if down != backwards else F.col(c).asc_nulls_first() for c, down in keys]


def sort_columns(fields: str, columns: Sequence[str]) -> list[Column]:
    """The same as columns to order by: nulls are the least."""
    return _ordered(sort_keys(fields, columns))


def sorted_by(rows: DataFrame, fields: str) -> DataFrame:
    return rows.orderBy(*sort_columns(fields, rows.columns))


def numbered(rows: DataFrame, order: Sequence[Column | str], name: str = "row_index") -> DataFrame:
    """``rows`` with their place in ``order``, from 0. Rows equal in all of the order take any of their places."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    kept = written(
        ranged.withColumn("_part", F.shiftright(place, 33).cast("int")).withColumn("_at", place.bitwiseAND(2**33 - 1)),
        "numbered",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition.
    offsets = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    return kept.join(F.broadcast(offsets), "_part").withColumn(
        name, F.col("_before") + F.col("_at")
    ).drop("_part", "_at", "_before")


def running_before(
    rows: DataFrame, order: Sequence[Column | str], value: str, name: str, place: str | None = None
) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows before them in ``order``. Null values count as 0. ``place`` names a column
    of numbers that ascend in the order."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    kept = written(ranged.withColumn("_part", F.shiftright(number, 33).cast("int")).withColumn("_at", number), "running")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept.groupBy("_part").agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    if place:
        kept = kept.withColumn(place, F.col("_at"))
    local = kept.withColumn("_local", F.coalesce(F.sum(F.coalesce(F.col(value), F.lit(0))).over(inside), F.lit(0)))
    return local.join(F.broadcast(offsets), "_part").withColumn(
        name, F.col("_before") + F.col("_local")
    ).drop("_part", "_at", "_before", "_local")


def segmented_before(
    rows: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], value: str, name: str, backwards: bool = False
) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of the same keys before them in ``order`` (column, descending?), or,
    ``backwards``, after them. Null values count as 0, null keys are keys.

    The sum runs over all rows in the order of keys and ``order``, by range partitions, and a key's share before its first row
    is taken off, so no window holds a key, however many rows it has. Of rows equal in all of ``order`` any comes first.
    """
    places = [*[F.col(k).asc_nulls_first() for k in keys], *_ordered(order, backwards)]
    ran = written(running_before(rows, places, value, "_run", place="_place"), "segments")
    starts = ran.groupBy(*keys).agg(F.min_by("_run", "_place").alias("_start"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    return ran.alias("r").join(starts.alias("s"), same).select(
        *[F.col(f"r.{c}").alias(c) for c in rows.columns], (F.col("_run") - F.col("_start")).alias(name)
    )


def bucket_of(index: Column, total: int, buckets: int) -> Column:
    """Which of ``buckets`` contiguous runs a row number falls into, from 0: sizes differ by one, the longer ones first."""
    least, longer = divmod(total, buckets)
    edge = longer * (least + 1)
    return F.when(index < edge, F.floor(index / (least + 1))).otherwise(
        longer + F.floor((index - edge) / max(least, 1))
    ).cast("int")


def even_spread(rows: DataFrame, order: Sequence[Column | str], buckets: int, name: str = "bucket") -> DataFrame:
    placed = numbered(rows, order, "_index")
    return placed.withColumn(name, bucket_of(F.col("_index"), placed.count(), buckets)).drop("_index")


def slices(rows: DataFrame, order: Sequence[Column | str], size: int, name: str = "batch") -> DataFrame:
    """Batches of ``size`` consecutive rows, from 0."""
    return numbered(rows, order, "_index").withColumn(name, F.floor(F.col("_index") / size)).drop("_index")


def head_tail(rows: DataFrame, fields: str = "name", head: int = 10, tail: int = 10) -> DataFrame:
    """The first and last rows with their place ``row_index``; all of them if there are no more than head + tail. Either end
    is a bounded heap per task; nothing is sorted as a whole."""
    keys, total = sort_keys(fields, rows.columns), rows.count()
    if total <= head + tail:
        head, tail = total, 0
    first = rows.orderBy(*_ordered(keys)).limit(head).withColumn(
        "row_index", F.row_number().over(Window.orderBy(*_ordered(keys))).cast("bigint") - 1
    )
    last = rows.orderBy(*_ordered(keys, True)).limit(tail).withColumn(
        "row_index", F.lit(total) - F.row_number().over(Window.orderBy(*_ordered(keys, True)))
    )
    return first.unionByName(last)


def by_depth(rows: DataFrame) -> DataFrame:
    """The number of entries at each depth."""
    return rows.groupBy("depth").agg(F.count(F.lit(1)).alias("entries"))


def depth_lists(rows: DataFrame) -> list[tuple[int, DataFrame]]:
    """The lists of entries of each depth, from the top. Depths, not entries, come to the driver: paths are short."""
    depths = [r[0] for r in rows.filter("depth IS NOT NULL").select("depth").distinct().orderBy("depth").collect()]
    return [(d, rows.filter(F.col("depth") == d)) for d in depths]


def hash_batch(relpath: Column, batches: int) -> Column:
    """An even batch number from 0; '.' goes to batch 0."""
    return F.when(relpath == ".", 0).otherwise(F.pmod(F.xxhash64(relpath), F.lit(batches))).cast("int")


def batch_count(src_items: int, dst_items: int, batch_files: int) -> int:
    """How many batches keep the larger side at ``batch_files`` entries each; 1 without a limit or entries."""
    return max(1, -(-max(src_items, dst_items) // batch_files)) if batch_files > 0 else 1


def spread_by(rows: DataFrame, partitions: int, *keys: Column) -> DataFrame:
    """Rows moved to the partition that an expression names; those with equal keys meet."""
    return rows.repartition(partitions, *keys)


def imbalance(rows: DataFrame, batch: str) -> DataFrame:
    """Batches, rows, mean and maximum rows of a batch, and their ratio."""
    sizes = rows.groupBy(batch).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("batches"),
        F.sum("n").alias("entries"),
        F.max("n").alias("largest"),
        F.avg("n").alias("mean"),
    ).withColumn("ratio", F.col("largest") / F.col("mean"))
