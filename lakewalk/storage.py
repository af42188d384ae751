"""Folders and small files on whatever file system the cluster shares."""

from __future__ import annotations

import os
import re
import tempfile
import time
import uuid
from contextlib import contextmanager
from urllib.parse import unquote, urlsplit

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession

_OWN: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where that is unset, a temporary one is made on a local master (tests,
    one machine); on a cluster a folder of one machine would be read as empty by the others, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return qualified(spark, root).rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="lakewalk-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, which is the cluster's default where none is given."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString()
    return re.sub("^file:/(?!/)", "file:///", whole)


def new_folder(spark: SparkSession, what: str) -> str:
    """A name under the shared folder that nothing uses yet."""
    path = f"{shared_root(spark)}/lakewalk-{what}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete all that this application wrote by ``new_folder`` and ``written`` so far, and give the number of folders. Call
    it when no result is read any more: results are tables in those folders."""
    made, files = _MADE.pop(spark.sparkContext.applicationId, []), Files(spark)
    for path in made:
        files.delete(path)
    return len(made)


def written(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = path or new_folder(spark, what)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def configured(spark: SparkSession, **values: str):
    """The session with some settings for what runs inside."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def observed(seen: Observation) -> dict | None:
    """What an observation saw; None if the plan that it stood in was found to be empty and didn't run."""
    try:
        return dict(seen.get)
    except Py4JJavaError:
        return None


class Files:
    """The few file operations that a commit needs, through Hadoop's file system layer."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def delete(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)

    def names(self, path: str) -> list[str]:
        return [name for name, _ in self.entries(path)]

    def entries(self, path: str) -> list[tuple[str, float]]:
        """Names in a folder, sorted, with the seconds since each was changed."""
        if not self.exists(path):
            return []
        now = time.time()
        found = self._fs(path).listStatus(self._path(path))
        return sorted((s.getPath().getName(), now - s.getModificationTime() / 1000) for s in found)

    def read_text(self, path: str) -> str:
        stream = self._fs(path).open(self._path(path))
        try:
            return str(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write_bytes(self, path: str, data: bytes) -> None:
        stream = self._fs(path).create(self._path(path), True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def _aside(self, path: str, text: str) -> str:
        aside = f"{path}.{uuid.uuid4().hex}"
        self._fs(path).mkdirs(self._path(path).getParent())
        self.write_bytes(aside, text.encode())
        return aside

    def _rename(self, aside: str, path: str, overwrite: bool) -> None:
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(path).toUri(), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), int(overwrite))
        if overwrite:
            options[0] = rename.OVERWRITE
        context.rename(self._path(aside), self._path(path), options)

    def replace_text(self, path: str, text: str) -> None:
        """Readers see the old text or the new one, never a part: written aside, then renamed over."""
        self._rename(self._aside(path, text), path, overwrite=True)

    def put_new(self, path: str, text: str) -> bool:
        """Make the file with its whole text, unless it is there already: of several writers exactly one gets True.

        On HDFS by a rename that doesn't overwrite, on a local or mounted file system by a hard link. The file system has
        to offer one of these as one step; a plain object store doesn't.
        """
        aside = self._aside(path, text)
        try:
            if re.match("file:|/", path):
                os.link(unquote(urlsplit(aside).path), unquote(urlsplit(path).path))
            else:
                self._rename(aside, path, overwrite=False)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            self.delete(aside)
