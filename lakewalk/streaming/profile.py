"""Profiles over inventories that keep arriving, with Structured Streaming.

The checkpoint below ``root`` makes a query that was cut off go on where it was. ``run_complete`` is for results of bounded
size, such as classes: each batch replaces the result as a whole, so nothing counts twice, and keeps all of it as state.
``run_final`` is for windows, whose number grows: each is put out once, when no more can come for it, and leaves the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lakewalk.storage import Files


def arriving(
    spark: SparkSession, path: str, schema: StructType | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """A stream over the parquet files of a folder, or over one file."""
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    names = [n for n in Files(spark).names(path) if n.endswith(".parquet")]
    if names == [path.rsplit("/", 1)[-1]]:
        folder, name = path.rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def run_complete(aggregated: DataFrame, root: str) -> DataFrame:
    """Run a grouped stream over all that is there, keeping the whole result below ``root``; the result so far. The result
    before it is kept too, for readers that hold it; older ones are deleted."""
    spark = aggregated.sparkSession
    result = f"{root}/result"
    files = Files(spark)

    def keep(batch: DataFrame, number: int) -> None:
        at = f"{result}-{number:09d}"
        batch.write.mode("overwrite").parquet(at)
        files.replace_text(f"{root}/CURRENT", at)
        kept = sorted(n for n in files.names(root) if n.startswith("result-") and n <= at.rsplit("/", 1)[1])[-2:]
        for n in files.names(root):
            if n.startswith("result-") and n < kept[0]:
                files.delete(f"{root}/{n}")

    query = aggregated.writeStream.outputMode("complete").option(
        "checkpointLocation", f"{root}/checkpoint"
    ).foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    if not files.exists(f"{root}/CURRENT"):
        return spark.createDataFrame([], aggregated.schema)
    return spark.read.parquet(files.read_text(f"{root}/CURRENT"))


def run_final(aggregated: DataFrame, root: str) -> DataFrame:
    """Run a stream of windows over all that is there; the windows so far that the watermark has passed, each once."""
    query = aggregated.writeStream.outputMode("append").format("parquet").option(
        "checkpointLocation", f"{root}/checkpoint"
    ).option("path", f"{root}/windows").trigger(availableNow=True).start()
    query.awaitTermination()
    return aggregated.sparkSession.read.schema(aggregated.schema).parquet(f"{root}/windows")


def type_profile(stream: DataFrame) -> DataFrame:
    """Entries and bytes by type."""
    return stream.groupBy("type").agg(
        F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")
    )


def windows(
    stream: DataFrame, time: str, keys: list[str], length: str, late: str, slide: str | None = None
) -> DataFrame:
    """Rows per window and keys, tumbling or, with ``slide``, sliding by so much; rows later than ``late`` behind the latest
    seen may be dropped. Rows without a time don't count."""
    timed = stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    counted = timed.groupBy(F.window("_at", length, slide).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.unix_seconds("w.start").alias("window_start"), *keys, "n")


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Rows per session of keys: runs of rows that follow each other within ``gap``; otherwise as ``windows``."""
    timed = stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    counted = timed.groupBy(F.session_window("_at", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.unix_seconds("w.start").alias("window_start"), F.unix_seconds("w.end").alias("window_end"), *keys, "n")


def first_seen(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each key once within the time that state is kept: repeated deliveries are dropped."""
    return stream.withColumn(
        "_at", F.col(time).cast("timestamp")
    ).withWatermark("_at", late).dropDuplicatesWithinWatermark([key]).drop("_at")


def spool(stream: DataFrame, root: str, batches: int, key: str) -> str:
    """Write a stream's rows to a spool, partitioned by a hash batch of ``key``; a replay reads batch by batch and prunes."""
    numbered = stream.withColumn("batch_id", F.pmod(F.xxhash64(key), F.lit(batches)).cast("int"))
    query = numbered.writeStream.format("parquet").partitionBy("batch_id").option(
        "checkpointLocation", f"{root}/checkpoint"
    ).option("path", f"{root}/spool").trigger(availableNow=True).start()
    query.awaitTermination()
    return f"{root}/spool"


def replayed(spark: SparkSession, spool_path: str, batch: int, schema: StructType | None = None) -> DataFrame:
    """One batch of a spool; ``schema`` is that of the stream, which an empty spool doesn't tell."""
    reader = spark.read if schema is None else spark.read.schema(StructType([*schema.fields, StructField("batch_id", IntegerType())]))
    return reader.parquet(spool_path).filter(F.col("batch_id") == batch)
