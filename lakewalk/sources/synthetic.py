"""Made-up trees, the same for the same seed whatever the number of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewalk import schema

#: Constants of the mixing function: primes below 2**31. Fixed values.
FACTOR, MODULUS = 48271, 2147483647


def _mixed(i: Column, seed: int, what: int) -> Column:
    """A number below 2**31 for each id, from three rounds of a multiplicative generator."""
    x = (i + F.lit(seed * 7919 + what * 104729)) % MODULUS + 1
    for _ in range(3):
        x = (x * FACTOR) % MODULUS + what
    return x


def tree(
    spark: SparkSession,
    items: int,
    seed: int = 1,
    root: str = "/synthetic",
    most_bytes: int = 1 << 20,
    fan_out: int = 16,
) -> DataFrame:
    """``items`` entries below ``root``: files, directories and links in about equal numbers, in directories d0, d1 and so
    on, each below the one of a ``fan_out``-th of its number; sizes below ``most_bytes``."""
    i = F.col("id")
    kind = (F.lit(2) + _mixed(i, seed, 1) % 3).cast("int")
    word = F.when(kind == schema.FILE, "file_").when(kind == schema.DIRECTORY, "dir_").otherwise("link_")
    folder = F.floor(i / fan_out)
    path = F.concat(F.lit(f"{root}/d"), folder.cast("string"), F.lit("/"), word, F.lpad(i.cast("string"), 8, "0"))
    size = F.when(kind == schema.FILE, _mixed(i, seed, 2) % most_bytes).otherwise(0)
    mode = F.when(kind == schema.FILE, 0o100644).when(kind == schema.DIRECTORY, 0o040755).otherwise(0o120777)
    return spark.range(items).select(
        path.alias("path"),
        F.lit(root.count("/") + 2).alias("depth"),
        kind.alias("type"),
        mode.alias("mode"),
        (_mixed(i, seed, 3) % 100).alias("uid"),
        size.cast("bigint").alias("size"),
        (F.lit(1767225600) - _mixed(i, seed, 4) % (4 * 365 * 86400)).alias("mtime"),
    )


def fill(rows: DataFrame, pattern: str = "random") -> DataFrame:
    """``rows`` with ``content`` of ``size`` bytes for files: all zero ('false'), all 255 ('true'), both by turns
    ('alternate') or digits of hashes of the path ('random'). Meant for small files."""
    size = F.col("size").cast("int")
    if pattern == "random":
        count = F.floor(size / 64).cast("int")
        text = F.array_join(
            F.transform(
                F.sequence(F.lit(0), count), lambda k: F.sha2(F.concat("path", F.lit("#"), k.cast("string")), 256)
            ),
            "",
        )
        body = F.encode(F.substring(text, F.lit(1), size), "utf-8")
    else:
        body = F.unhex(
            F.substring(
                F.repeat(F.lit({"false": "00", "true": "FF", "alternate": "FF00"}[pattern]), size), F.lit(1), size * 2
            )
        )
    return rows.withColumn("content", F.when(F.col("type") == schema.FILE, body))
