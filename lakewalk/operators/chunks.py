"""Files in chunks, archives as running offsets, and large copies spread over workers."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewalk import schema
from lakewalk.operators.order import running_before
from lakewalk.storage import written

#: A tar block. Fixed value of the format.
BLOCK = 512
#: From this size on a copy counts as large.
LARGE = 64 << 20
#: Large files per part of their order.
PART_ROWS = 100_000


def chunks(rows: DataFrame, chunk: int) -> DataFrame:
    """path, chunk_no, offset, length, file_size of regular files cut into chunks; an empty file has one of length 0.
    Null sizes have none."""
    files = rows.filter((F.col("type") == schema.FILE) & F.col("size").isNotNull())
    last = F.greatest(F.floor((F.col("size") - 1) / chunk), F.lit(0))
    cut = files.select(
        "path",
        F.col("size").alias("file_size"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("chunk_no"),
    )
    offset = F.col("chunk_no") * chunk
    return cut.select(
        "path",
        "chunk_no",
        offset.alias("offset"),
        F.least(F.lit(chunk).cast("bigint"), F.col("file_size") - offset).alias("length"),
        "file_size",
    )


def any_chunk(flagged: DataFrame, flag: str, key: str = "path") -> DataFrame:
    """Per file whether the flag holds for any of its chunks; null flags count as false."""
    return flagged.groupBy(key).agg(F.max(F.coalesce(F.col(flag), F.lit(False))).alias(flag))


def content_chunks(files: DataFrame, chunk: int) -> DataFrame:
    """path, chunk_no and the digest of each chunk of content (in characters, for text)."""
    length = F.greatest(F.length("content"), F.lit(1))
    starts = F.explode(F.sequence(F.lit(0), ((length - 1) / chunk).cast("int"))).alias("chunk_no")
    cut = files.filter("content IS NOT NULL").select("path", "content", starts)
    return cut.select(
        "path", "chunk_no", F.sha2(F.expr(f"substring(content, chunk_no * {chunk} + 1, {chunk})"), 256).alias("digest")
    )


def archive_entries(rows: DataFrame, header: int = BLOCK) -> DataFrame:
    """path, entry_size and offset of the entries of an archive in the order of paths.

    Files, directories and links take a header; files their content too, padded to blocks; other types take nothing and
    aren't listed. Of equal paths any may come first.
    """
    padded = F.ceil(F.coalesce("size", F.lit(0)) / BLOCK) * BLOCK
    size = F.when(F.col("type") == schema.FILE, padded + header).otherwise(header).cast("bigint")
    entries = rows.filter(
        F.col("type").isin(schema.FILE, schema.DIRECTORY, schema.LINK)
    ).select("path", size.alias("entry_size"))
    return running_before(entries, ["path", "entry_size"], "entry_size", "offset")


def balanced(files: DataFrame, workers: int, least: int = LARGE, part_rows: int = PART_ROWS) -> DataFrame:
    """path, size and worker of the files of at least ``least`` bytes, spread so that the workers' bytes come out even.

    Largest first (equal ones by path), each to the worker with the fewest bytes so far, of equal ones the lowest. That
    rule is a chain from file to file. The files are range-partitioned by its order into parts of about ``part_rows``;
    one task streams the chain over the numbers of equal sizes, without paths, to get the workers' bytes before each
    part, and from there the parts are assigned side by side. So the rule is exact for any number of files.
    """
    large = files.filter((F.col("type") == schema.FILE) & (F.col("size") >= least)).select("path", "size")
    parts = max(1, -(-large.count() // part_rows))
    ordered = large.repartitionByRange(parts, F.col("size").desc(), "path")
    placed = written(ordered.withColumn("part", F.spark_partition_id()), "large")
    runs = placed.groupBy("part", "size").agg(F.count(F.lit(1)).alias("n"))

    def chain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heap, part = [(0, w) for w in range(workers)], None
        for pdf in frames:
            found = []
            for p, size, n in zip(pdf["part"].tolist(), pdf["size"].tolist(), pdf["n"].tolist()):
                if p != part:
                    part = p
                    found.append((p, [str(load) for load, _ in sorted(heap, key=lambda x: x[1])]))
                for _ in range(n):
                    heapq.heapreplace(heap, (heap[0][0] + size, heap[0][1]))
            yield pd.DataFrame(found, columns=["part", "loads"])

    one_by_one = runs.repartition(1).sortWithinPartitions("part", F.col("size").desc())
    before = {
        r["part"]: [int(x) for x in r["loads"]] for r in one_by_one.mapInPandas(chain, "part int, loads array<string>").collect()
    }

    def assign(key: tuple[int], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "path"], ascending=[False, True])
        heap = [(load, w) for w, load in enumerate(before[key[0]])]
        heapq.heapify(heap)
        chosen = []
        for size in pdf["size"].tolist():
            load, worker = heap[0]
            chosen.append(worker)
            heapq.heapreplace(heap, (load + size, worker))
        return pdf.assign(worker=chosen)[["path", "size", "worker"]]

    return placed.groupBy("part").applyInPandas(assign, "path string, size bigint, worker int")


def assigned_bytes(placed: DataFrame) -> DataFrame:
    return placed.groupBy("worker").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
