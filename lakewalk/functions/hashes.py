"""Hashes over bytes that Spark lacks, for results that have to agree with other tools' owners and batches.

Use ``xxhash64`` where only an even spread matters: it stays in generated code.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Start and factor of the 64-bit FNV-1a used for directory owners. Fixed values; the start isn't the standard one.
FNV_START, FNV_FACTOR = 1469598103934665603, 1099511628211
#: Domains that keep the uses of the 32-bit hash apart. Fixed values.
SCAN, BATCH, PLANNER, SOURCE_OWNER, DESTINATION_OWNER = 0x5343414E, 0x42415443, 0x504C4E52, 0x5352434F, 0x4453544F


def _bytes(strings: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The strings' bytes as a matrix padded with zeros, and their lengths."""
    encoded = [s.encode() for s in strings]
    lens = np.array([len(e) for e in encoded], np.int64)
    width = int(lens.max(initial=0))
    flat = np.frombuffer(b"".join(e.ljust(width, b"\0") for e in encoded), np.uint8)
    return flat.reshape(len(encoded), width), lens


def one_at_a_time(strings: pd.Series, domain: int | None = None) -> np.ndarray:
    """Jenkins' one-at-a-time hash, after the four bytes of ``domain`` (least first) if given. One step per byte position,
    over all strings of a batch."""
    data, lens = _bytes(strings)
    if domain is not None:
        head = np.frombuffer(int(domain).to_bytes(4, "little"), np.uint8)
        data, lens = np.hstack([np.tile(head, (len(data), 1)), data]), lens + 4
    h = np.zeros(len(data), np.uint32)
    with np.errstate(over="ignore"):
        for i in range(data.shape[1]):
            on = lens > i
            x = h + data[:, i]
            x += x << np.uint32(10)
            x ^= x >> np.uint32(6)
            h = np.where(on, x, h)
        h += h << np.uint32(3)
        h ^= h >> np.uint32(11)
        h += h << np.uint32(15)
    return h


def fnv1a(strings: pd.Series) -> np.ndarray:
    data, lens = _bytes(strings)
    h = np.full(len(data), FNV_START, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(data.shape[1]):
            h = np.where(lens > i, (h ^ data[:, i].astype(np.uint64)) * np.uint64(FNV_FACTOR), h)
    return h


def _nullable(strings: pd.Series, f) -> pd.Series:
    out = pd.Series([None] * len(strings), dtype="Int64")
    there = strings.notna().to_numpy()
    if there.any():
        out[there] = f(strings[there]).astype(np.int64)
    return out


def jenkins(path: Column, domain: int | None = None) -> Column:
    """One-at-a-time hash as bigint from 0 to 2**32 - 1; null for null."""

    @F.pandas_udf("bigint")
    def run(s: pd.Series) -> pd.Series:
        return _nullable(s, lambda x: one_at_a_time(x, domain))

    return run(path)


def fnv(path: Column) -> Column:
    """64-bit FNV-1a as bigint (the upper half negative); null for null."""

    @F.pandas_udf("bigint")
    def run(s: pd.Series) -> pd.Series:
        return _nullable(s, lambda x: fnv1a(x).view(np.int64))

    return run(path)


def bucket(path: Column, buckets: int, domain: int) -> Column:
    """The owner, from 0, of a path among ``buckets``; null for null."""
    return F.when(path.isNotNull(), F.lit(0)) if buckets <= 1 else (jenkins(path, domain) % buckets).cast("int")


def batch(relpath: Column, batches: int) -> Column:
    """The batch of an entry; '.' is in batch 0."""
    return F.when(relpath == ".", 0).otherwise(bucket(relpath, batches, BATCH))
