"""A session as the queries expect it."""

from __future__ import annotations

import io
import os
import uuid
import zipfile

from pyspark.sql import SparkSession

from lakewalk.storage import Files, shared_root

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable for the Python workers of all executors: once per application, as an archive in the
    shared folder, so that nothing has to be installed or on a path there."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(here):
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
            for folder, _, names in os.walk(here):
                for name in sorted(n for n in names if n.endswith(".py")):
                    at = os.path.join(folder, name)
                    archive.write(at, os.path.join("lakewalk", os.path.relpath(at, here)))
        path = f"{shared_root(spark)}/lakewalk-package-{uuid.uuid4().hex}/lakewalk_package.zip"  # kept until the application ends
        Files(spark).write_bytes(path, packed.getvalue())
        spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
