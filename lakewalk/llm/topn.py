"""The N highest-scoring rows of every group, reading little of what can't be among them.

The rows are clustered into files by group and, within a file, sorted by descending score (large groups each by itself, the
others together), with small row groups. From the statistics of the row groups alone, a lower bound of a large group's N-th
score follows wherever a row group of that group only holds N rows; row groups of the group strictly below it are never opened.
Each file's others are taken in the order in which their maximum scores descend. The groups in a row group are read first, one
column; if its maximum score is strictly below the N-th score, so far, of every one of them, its other columns are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewalk.storage import new_folder, written

ROW_GROUP_BYTES = 64 * 1024
#: A group is large if it has a row for each so many bytes of a row group (some four row groups); up to so many large groups are
#: broadcast.
LARGE_BYTES, MOST_LARGE = 8, 1_000_000


def _sorted(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_last() for c, desc in order]


def cluster(
    df: DataFrame, group: str, order: Sequence[tuple[str, bool]], path: str, row_group_bytes: int = ROW_GROUP_BYTES
) -> list[str]:
    """Write ``df`` range-partitioned by group and order: a hot group is spread over many files, even if all its scores are the
    same. Within a file the groups of many row groups come first, one after the other, so that row groups are theirs alone; the
    others are mixed, by the order alone, so that their low scores share row groups. The file names."""
    large = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= row_group_bytes // LARGE_BYTES)
    large = written(large.select(F.col(group), F.lit(True).alias("_large")), "large")
    # At most one for each so many rows of the table.
    marked = df.join(F.broadcast(large) if large.count() <= MOST_LARGE else large, group, "left")
    first = F.when(F.col("_large"), F.col(group)).asc_nulls_last()
    clustered = marked.repartitionByRange(F.col(group), *_sorted(order)).sortWithinPartitions(first, *_sorted(order), group).select(*df.columns)
    clustered.write.option("parquet.block.size", str(row_group_bytes)).option(
        "parquet.page.size", str(max(4096, row_group_bytes // 8))
    ).mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).inputFiles()


def _open(path: str):
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    return pq.ParquetFile(system.open_input_file(at))


def statistics(files: DataFrame, group: str, score: str) -> DataFrame:
    """file, row_group, n, low and high of the group, min and max of the score, from the footers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["file"]:
                meta, rows = _open(path).metadata, []
                names = [meta.schema.column(i).name for i in range(meta.num_columns)]
                g, s = names.index(group), names.index(score)
                for k in range(meta.num_row_groups):
                    part = meta.row_group(k)
                    a, b = part.column(g).statistics, part.column(s).statistics
                    rows.append((path, k, part.num_rows, a.min, a.max, b.min, b.max))
                yield pd.DataFrame(rows, columns=["file", "row_group", "n", "low", "high", "min_score", "max_score"])

    return files.mapInPandas(
        run, "file string, row_group int, n bigint, low bigint, high bigint, min_score bigint, max_score bigint"
    )


def _kept(source, parts: pd.DataFrame, columns: list[str], group: str, score: str, n: int) -> Iterator[pa.Table]:
    """Of one file, whose rows are in the order, the first n of each group; an empty table for a row group that was skipped."""
    # In the file's order a group's scores descend, and among mixed groups the maxima of the row groups do.
    parts = parts.sort_values("row_group")
    groups = [source.read_row_group(k, columns=[group]).column(0).to_numpy() for k in parts["row_group"]]
    _, place = np.unique(np.concatenate(groups), return_inverse=True)
    count = np.zeros(place.max(initial=0) + 1, np.int64)
    nth = np.full(len(count), np.iinfo(np.int64).min)
    for part, at in zip(parts.itertuples(), np.split(place, np.cumsum([len(g) for g in groups])[:-1])):
        if (count[at] >= n).all() and part.max_score < nth[at].min():
            yield pa.table([])
            continue
        rows = source.read_row_group(part.row_group, columns=columns)
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        rank = np.empty(len(at), np.int64)
        rank[order] = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
        rank += count[at]
        last = rank == n - 1
        nth[at[last]] = rows.column(score).to_numpy()[last]
        count += np.bincount(at, minlength=len(count))
        yield rows.filter(pa.array(rank < n))


def read_best(parts: DataFrame, columns: list[str], group: str, order: Sequence[tuple[str, bool]], n: int) -> DataFrame:
    """The first n rows of each group in each file."""
    schema = pa.schema([(c, pa.int64()) for c in columns])

    def run(table: pa.Table) -> pa.Table:
        listed = table.to_pandas()
        found = [t.cast(schema) for t in _kept(_open(listed["file"].iloc[0]), listed, columns, group, order[0][0], n) if t.num_rows]
        return pa.concat_tables(found) if found else schema.empty_table()

    return parts.groupBy("file").applyInArrow(run, ", ".join(f"{c} bigint" for c in columns))


def reading(parts: DataFrame, columns: list[str], group: str, order: Sequence[tuple[str, bool]], n: int) -> DataFrame:
    """How many of its row groups ``read_best`` takes and skips in each file: file, row_groups, skipped."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["file"].iloc[0]
        skipped = sum(t.num_columns == 0 for t in _kept(_open(name), pdf, columns, group, order[0][0], n))
        return pd.DataFrame({"file": [name], "row_groups": [len(pdf)], "skipped": [skipped]})

    return parts.groupBy("file").applyInPandas(run, "file string, row_groups int, skipped int")


def alive(parts: DataFrame, n: int) -> DataFrame:
    """Of the ``statistics`` the row groups that no row group of a single group rules out."""
    floors = parts.filter(
        (F.col("low") == F.col("high")) & (F.col("n") >= n)
    ).groupBy("low").agg(F.max("min_score").alias("floor"))
    return parts.join(floors, "low", "left").filter(
        (F.col("low") != F.col("high")) | F.col("floor").isNull() | (F.col("max_score") >= F.col("floor"))
    ).select("file", "row_group", "low", "high", "max_score")


def top_n(
    df: DataFrame,
    group: str,
    order: Sequence[tuple[str, bool]],
    n: int,
    path: str | None = None,
    row_group_bytes: int = ROW_GROUP_BYTES,
) -> DataFrame:
    """The first ``n`` rows of each group by ``order``: (bigint column, descending?), the score first and descending.

    Nulls come last in every column of the order; rows with a null group or score don't count. Give an order without
    ties (a unique id last) for a defined result; of rows equal in all of it any may be returned. Columns of ``df``
    besides group and order aren't kept. An empty table gives none.
    """
    spark = df.sparkSession
    score, columns = order[0][0], [group, *[c for c, _ in order]]
    assert order[0][1], "the score has to be descending"
    rows = df.select(
        *[F.col(c).cast("bigint").alias(c) for c in columns]
    ).filter(F.col(group).isNotNull() & F.col(score).isNotNull())
    # Read three times: to count, to find the ranges, to be sorted.
    rows = written(rows, "scores")
    names = cluster(rows, group, order, path or new_folder(spark, "topn"), row_group_bytes)
    if not names:
        return rows.limit(0).withColumn("rank", F.lit(0))
    # File names only: one per advisory partition size of the data.
    files = spark.createDataFrame([(f,) for f in names], "file string").repartition(len(names))
    best = read_best(
        alive(statistics(files, group, score), n).repartition(len(names), "file"), columns, group, order, n
    )
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*_sorted(order))))
    return ranked.filter(F.col("rank") <= n)
