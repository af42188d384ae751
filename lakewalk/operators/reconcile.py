"""Differences between two copies of a dataset, by invertible Bloom lookup tables.

Each row is hashed to its key (k1, k2: 128 bits) and an entry e over key and compared fields. Keys fall into buckets; each
bucket has a table of cells to which an entry is added in three places, with a plus for one side and a minus for the other. A
cell holds the count and the sums of the entries in it, so the tables of equal sides cancel and what is left can be peeled,
cell by cell, into the entries that the sides have in different numbers. Cells are shuffled, not rows; rows are fetched for
the keys that peeling names, and for keys that a side has repeatedly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewalk.operators.keyed_state import content_hash, key_columns
from lakewalk.storage import written

#: xxHash64's primes (fixed values of the public specification).
P1, P2, P3, P4, P5 = (
    np.uint64(x) for x in (
        11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
    )
)
PLACES = 3
#: Columns of a cell besides its count: halves of k1 and of the entry, and a checksum.
SUMS = ["k1_high", "k1_low", "e_high", "e_low", "checked"]
#: Rows of a side per bucket, and per range in which repeated keys are sought, about.
BUCKET_ROWS, RANGE_ROWS = 4096, 1_000_000
#: Up to so many candidate keys (16 bytes each) are broadcast.
MOST_KEYS = 2_000_000


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxhash64_longs(*columns: np.ndarray) -> np.ndarray:
    """What Spark's ``xxhash64`` gives for non-null bigint columns."""
    with np.errstate(over="ignore"):
        h = np.uint64(42)
        for c in columns:
            k = _rotl(c.astype(np.int64).view(np.uint64) * P2, 31) * P1
            h = _rotl((h + P5 + np.uint64(8)) ^ k, 27) * P1 + P4
            h = (h ^ (h >> np.uint64(33))) * P2
            h = (h ^ (h >> np.uint64(29))) * P3
            h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)


def _places(e: np.ndarray, width: int) -> list[np.ndarray]:
    """The cells of an entry, one in each third of the table, from 21 bits each."""
    u = e.view(np.uint64)
    return [
        ((u >> np.uint64(21 * i)) & np.uint64(0x1FFFFF)).astype(np.int64) % width + i * width for i in range(PLACES)
    ]


def _halves(x: Column) -> list[Column]:
    return [F.shiftrightunsigned(x, 32), x.bitwiseAND(0xFFFFFFFF)]


def cells(sides: Sequence[tuple[DataFrame, int]], buckets: int, width: int) -> DataFrame:
    """The subtracted tables: one row per bucket and cell that isn't zero, with the count n and, as halves of 32 bits so that
    no sum overflows, the sums of k1 and e and of half a checksum of both. Combined before the shuffle."""
    entries = reduce(
        DataFrame.unionByName, [df.select("k1", "k2", "h", F.lit(sign).cast("bigint").alias("n")) for df, sign in sides]
    )
    entries = entries.select("n", "k1", F.pmod("k1", F.lit(buckets)).alias("bucket"), F.xxhash64("k1", "k2", "h").alias("e"))
    place = [
        (F.shiftrightunsigned("e", 21 * i).bitwiseAND(0x1FFFFF) % width + i * width).cast("int") for i in range(PLACES)
    ]
    check = F.shiftrightunsigned(F.xxhash64("k1", "e"), 32)
    values = [*_halves(F.col("k1")), *_halves(F.col("e")), check]
    spread = entries.select(
        "bucket", "n", *[(F.col("n") * v).alias(s) for v, s in zip(values, SUMS)], F.explode(F.array(*place)).alias("cell")
    )
    summed = spread.groupBy("bucket", "cell").agg(*[F.sum(c).alias(c) for c in ("n", *SUMS)])
    return summed.filter(" OR ".join(f"{c} <> 0" for c in ("n", *SUMS)))


def peel(n: np.ndarray, sums: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """k1 and net numbers of the entries left in one table, and whether all of it could be peeled. A cell is pure if it holds
    any number of copies of one entry: its sums are then that multiple of values that fit their checksum."""
    out, copies = [], []
    for _ in range(len(n) + 1):
        at = np.flatnonzero(n)
        values, rest = np.divmod(sums[at], n[at, None])
        fits = (rest == 0).all(axis=1) & (values >= 0).all(axis=1) & (values < 2**32).all(axis=1)
        at, u = at[fits], values[fits].astype(np.uint64)
        k1, e = (((u[:, i] << np.uint64(32)) | u[:, i + 1]).view(np.int64) for i in (0, 2))
        pure = (xxhash64_longs(k1, e).view(np.uint64) >> np.uint64(32)) == u[:, 4] if len(at) else np.zeros(0, bool)
        if not pure.any():
            break
        _, first = np.unique(e[pure], return_index=True)
        k1, e, value, number = k1[pure][first], e[pure][first], u[pure][first].astype(np.int64), n[at][pure][first]
        out.append(k1)
        copies.append(number)
        for cell in _places(np.ascontiguousarray(e), width):
            np.subtract.at(n, cell, number)
            np.subtract.at(sums, cell, value * number[:, None])
    none = np.zeros(0, np.int64)
    return (np.concatenate(out) if out else none), (np.concatenate(copies) if copies else none), not (n.any() or sums.any())


def peeled(table: DataFrame, width: int) -> DataFrame:
    """Peel each bucket: rows (bucket, k1, ok). A bucket that can't be peeled gives one row with ok false."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        n, sums = np.zeros(PLACES * width, np.int64), np.zeros((PLACES * width, len(SUMS)), np.int64)
        at = pdf["cell"].to_numpy()
        n[at] = pdf["n"].to_numpy()
        sums[at] = pdf[SUMS].to_numpy()
        k1, _, ok = peel(n, sums, width)
        return pd.DataFrame({"bucket": np.int64(pdf["bucket"].iloc[0]), "k1": np.unique(k1) if ok else [np.int64(0)], "ok": ok})

    return table.groupBy("bucket").applyInPandas(one, "bucket bigint, k1 bigint, ok boolean")


def hashed(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """k1, k2 and h of every row, where it is read: nothing is shuffled."""
    return df.select(*key_columns(F.col(key)), content_hash(*map(F.col, fields)).alias("h"))


def repeated(df: DataFrame, rows: int) -> DataFrame:
    """k1 of the keys that may occur in more than one of the ``rows`` rows of hashed ``df``.

    Tasks put out, for ranges of k1, the lower 32 bits of all k1 as one binary: four bytes a row are shuffled, not keys. What
    meets twice in a range is repeated, or one of the few keys that share range and bits with another, which does no harm.
    """
    ranges = max(8, -(-rows // RANGE_ROWS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k1 in _together((b.column(0).to_numpy() for b in batches), RANGE_ROWS):
            at = (k1 >> 32) % ranges
            order = np.argsort(at, kind="stable")
            names, first = np.unique(at[order], return_index=True)
            parts = np.split(k1[order].astype(np.uint32), first[1:])
            yield pa.record_batch([pa.array(names), pa.array([p.tobytes() for p in parts], pa.binary())], ["at", "bits"])

    def twice(table: pa.Table) -> pa.Table:
        bits, n = np.unique(np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint32), return_counts=True)
        found = bits[n > 1].astype(np.int64)
        return pa.table([pa.array(np.full(len(found), table.column("at")[0].as_py())), pa.array(found)], ["at", "low"])

    found = df.select("k1").mapInArrow(pack, "at bigint, bits binary").groupBy("at").applyInArrow(twice, "at bigint, low bigint")
    keyed = df.select(
        "k1", F.pmod(F.shiftright("k1", 32), F.lit(ranges)).alias("at"), F.col("k1").bitwiseAND(0xFFFFFFFF).alias("low")
    )
    return keyed.join(_bounded(found), ["at", "low"], "left_semi").select("k1").distinct()


def _together(arrays: Iterator[np.ndarray], most: int) -> Iterator[np.ndarray]:
    """The arrays, put together to such of about ``most`` items."""
    held, n = [], 0
    for a in arrays:
        held.append(a)
        n += len(a)
        if n >= most:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def _bounded(df: DataFrame, most: int = MOST_KEYS) -> DataFrame:
    """``df`` written, and broadcast in joins if its rows are few enough (counted)."""
    df = written(df, "keys")
    return F.broadcast(df) if df.count() <= most else df


def _in(df: DataFrame, bucket: Column, open_: DataFrame | None) -> DataFrame:
    df = df.select("k1", "k2", "h", bucket)
    return df if open_ is None else df.join(open_, "bucket", "left_semi")


def estimated_entries(src: DataFrame, dst: DataFrame, one_in: int) -> float:
    """How many entries only one side has, from the keys whose second hash falls into one of ``one_in`` strata. It only
    sizes the tables; a wrong estimate costs another round, never a result."""
    sampled = [df.filter(F.pmod("k2", F.lit(one_in)) == 0).select("k1", "k2", "h", F.lit(s).alias("s")) for df, s in ((src, 1), (dst, -1))]
    left = sampled[0].unionAll(sampled[1]).groupBy("k1", "k2", "h").agg(F.sum("s").alias("s")).filter("s <> 0")
    return left.count() * one_in


def differing_keys(
    src: DataFrame, dst: DataFrame, rows: int, bucket_rows: int = BUCKET_ROWS, widths: Sequence[int] | None = None, stratum_rows: int = 20_000
) -> DataFrame:
    """k1 of the entries that the hashed sides (k1, k2, h) of at most ``rows`` rows each have in different numbers.

    Buckets have about ``bucket_rows`` rows of either side. Unless ``widths`` (cells per third of a table, one number for
    each round) are given, the first table gets 1.6 cells for each entry that a stratum of about ``stratum_rows`` keys
    lets expect, the second four times as many. Buckets that the first can't peel go into the second; of what even that
    can't peel, all keys are given, so that the comparison of rows decides: nothing is lost, however many differences
    there are and however they lie.
    """
    buckets = max(1, -(-rows // bucket_rows))
    if widths is None:
        expected = estimated_entries(src, dst, max(1, rows // stratum_rows)) / buckets
        width = int(1.6 * expected / PLACES) + 16
        widths = (width, 4 * width)
    bucket = F.pmod("k1", F.lit(buckets)).alias("bucket")
    found, open_ = [], None
    for width in widths:
        sides = [(_in(df, bucket, open_), sign) for df, sign in ((src, 1), (dst, -1))]
        got = written(peeled(cells(sides, buckets, width), width), "peeled")
        found.append(got.filter("ok").select("k1"))
        open_ = got.filter("NOT ok").select("bucket")
        if open_.isEmpty():
            return reduce(DataFrame.union, found)
    rest = [_in(df, bucket, open_).select("k1") for df in (src, dst)]
    return reduce(DataFrame.union, [*found, *rest])


def first_rows(df: DataFrame, keys: DataFrame, key: str, row_id: str, columns: Sequence[str], side: str) -> DataFrame:
    """Of the rows whose k1 is among ``keys`` the one with the lowest id of each key: k1, k2, <side>_key and columns."""
    wanted = df.select(
        *key_columns(F.col(key)), F.col(key).alias("key"), F.col(row_id).alias("id"), *[F.col(c).alias(f"f{i}") for i, c in enumerate(columns)]
    ).join(keys, "k1", "left_semi")
    first = wanted.groupBy("k1", "k2").agg(F.min(F.struct("id", "key", *[f"f{i}" for i in range(len(columns))])).alias("r"))
    return first.select(
        "k1", "k2", F.col("r.key").alias(f"{side}_key"), *[F.col(f"r.f{i}").alias(f"{side}_{c}") for i, c in enumerate(columns)], F.lit(True).alias(f"{side}_is")
    )


def differences(
    src: DataFrame, dst: DataFrame, key: str, row_id: str, fields: Sequence[str], ignore: dict[str, Column] | None = None, **how
) -> DataFrame:
    """Rows (key, diff_kind): only_src, only_dst, or the name of a field whose values differ, one row each.

    Of rows with the same key on a side, the one with the lowest ``row_id`` counts; a null key is a key. Null equals only
    null. ``ignore`` gives, for a field, a condition under which it isn't compared, over the source's columns, prefixed
    ``src_`` (any columns of ``src``). Other columns don't matter.

    All rows of either side go into the lookup tables, repeated keys too; equal rows cancel, whatever their number. What
    peeling names, and the keys that are repeated on a side, are candidates: for these the rows are fetched, reduced to the
    first of each key and compared. So rows are shuffled for candidates only, and four bytes of every other row.
    """
    ignore = ignore or {}
    extra = [c for c in src.columns if ignore and c not in fields and any(f"src_{c}" in names_in(x) for x in ignore.values())]
    all_src, all_dst = (written(hashed(df, key, fields), "side") for df in (src, dst))
    n_src, n_dst = all_src.count(), all_dst.count()
    keys = differing_keys(all_src, all_dst, max(n_src, n_dst), **how)
    keys = _bounded(keys.union(repeated(all_src, n_src)).union(repeated(all_dst, n_dst)).distinct())
    a = first_rows(src, keys, key, row_id, [*fields, *extra], "src")
    b = first_rows(dst, keys, key, row_id, fields, "dst")
    met = a.join(b, ["k1", "k2"], "full_outer")
    kinds = [F.when(F.col("dst_is").isNull(), "only_src"), F.when(F.col("src_is").isNull(), "only_dst")]
    for f in fields:
        differs = F.col("src_is") & F.col("dst_is") & ~F.col(f"src_{f}").eqNullSafe(F.col(f"dst_{f}"))
        kinds.append(F.when(differs & ~F.coalesce(ignore[f], F.lit(False)) if f in ignore else differs, f))
    return met.select(
        F.when(F.col("src_is"), F.col("src_key")).otherwise(F.col("dst_key")).alias(key),
        F.explode(F.array_compact(F.array(*kinds))).alias("diff_kind"),
    )


def names_in(condition: Column) -> set[str]:
    """The words of a condition, among which are the columns that it is over."""
    return set(re.findall(r"\w+", str(condition)))
