"""Tables written to the shared folder to cut lineage.

Iterative operators write each round to ``spark.checkpoint.dir`` and read it
back, so a lost executor costs a re-read of one table and never the whole
lineage. The folder is the cluster's own; a private one is made only on a local
master without the setting (tests, a laptop).

Writing runs jobs, so an operator that cuts its lineage does work while its frame is
being built. Tables that a returned frame still reads stay until ``release_all`` or the
end of the application; a long-lived session that runs many queries should call it
after each result is written.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class NoSharedFolder(RuntimeError):
    """Executors on other machines, and no folder that all of them see."""


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, else the one given to ``setCheckpointDir``.

    Where neither is set, a temporary one on a ``local`` master, and :class:`NoSharedFolder` on any other.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        set_by_call = spark.sparkContext._jsc.sc().getCheckpointDir()
        given = set_by_call.get() if set_by_call.isDefined() else None
    if given:
        return given.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise NoSharedFolder("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark, "_tidemark_dir", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, own, True)
        spark._tidemark_dir = own
    return own


_written: dict[str, list[Scratch]] = {}


def release_all(spark: SparkSession) -> int:
    """Delete the tables of all operator calls of this application; frames they returned cannot be read any more."""
    calls = _written.pop(spark.sparkContext.applicationId, [])
    for call in calls:
        call._fs(call.root).delete(call._path(call.root), True)
    return len(calls)


class Scratch:
    """Writes and replaces named intermediate tables of one operator call.

    What a returned frame still reads stays until :func:`release_all` or the application's end.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
        self.version: dict[str, int] = {}
        self.marked = False

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _mark(self) -> None:
        """Have the tables of this call deleted at the latest when the application ends."""
        if not self.marked:
            self._fs(self.root).deleteOnExit(self._path(self.root))
            self.marked = True
            _written.setdefault(self.spark.sparkContext.applicationId, []).append(self)

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read from the file; the version before last is deleted."""
        n = self.version.get(name, 0) + 1
        self.version[name] = n
        path = f"{self.root}/{name}-{n}"
        df.write.mode("overwrite").parquet(path)
        self._mark()
        if n > 1:
            self.drop(f"{name}-{n - 1}")
        return self.spark.read.schema(df.schema).parquet(path)

    def text(self, df: DataFrame, name: str, by: list[str]) -> str:
        """Write one text column as files of lines in a folder per value of ``by``; returns the folder of all."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").partitionBy(*by).text(path)
        self._mark()
        return path

    def drop(self, leaf: str) -> None:
        """Delete one written table, wherever the folder lives."""
        self._fs(self.root).delete(self._path(f"{self.root}/{leaf}"), True)

    def release(self, name: str) -> None:
        """Delete the current version of a table nothing reads any more."""
        if name in self.version:
            self.drop(f"{name}-{self.version.pop(name)}")
