"""The observation ledger: a Parquet table by UTC day, written once per dedupe key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.copies import deduplicate
from tidemark.sources.snapshots import id_collisions, read_objects

SCHEMA_VERSION = 2


class LedgerError(RuntimeError):
    """A ledger this version must not touch, or a collision of identifiers."""


class Ledger:
    """Batches below ``root/batch=…``; a batch counts once its marker ``_batches/<id>`` exists, so a write is all or nothing.

    A batch may hold snapshots and checkpoints beside its observations; one marker commits the three. One writer works at a
    time: it holds ``_writer``, which is created atomically, and a second one is refused instead of losing to it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, leaf: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{leaf}")

    def batches(self) -> list[str]:
        """Committed batches in order of commit; refuses a newer schema."""
        fs, markers = self._fs(), self._path("_batches")
        names = sorted(s.getPath().getName() for s in fs.listStatus(markers)) if fs.exists(markers) else []
        if any(int(n.split("-")[1]) > SCHEMA_VERSION for n in names):
            raise LedgerError("the ledger was written by a newer version")
        return names

    def read(self) -> DataFrame | None:
        """All committed observations, or None of an empty ledger."""
        paths = [p for b in self.batches() if self._fs().exists(self._path((p := f"batch={b}")))]
        paths = [f"{self.root}/{p}" for p in paths]
        return self.spark.read.option("mergeSchema", "true").option("basePath", self.root).parquet(*paths).drop("batch") if paths else None

    def beside(self, what: str) -> DataFrame | None:
        """All committed rows of ``snapshots`` or ``checkpoints`` with their batch, or None."""
        paths = [f"{self.root}/_{what}/batch={b}" for b in self.batches() if self._fs().exists(self._path(f"_{what}/batch={b}"))]
        return self.spark.read.option("basePath", f"{self.root}/_{what}").parquet(*paths) if paths else None

    def unlock(self) -> None:
        """Clear away the claim of a writer that died."""
        self._fs().delete(self._path("_writer"), False)

    def append(self, observations: DataFrame, snapshots: DataFrame | None = None, checkpoints: DataFrame | None = None) -> int:
        """Adds the observations whose dedupe key is new, first by ``ingest_seq``; returns how many.

        A known key is ignored. An id that stands for two keys, within the batch or against the ledger, is an error, and nothing
        is written. ``snapshots`` and ``checkpoints`` are committed with the batch, also where no observation is new.
        """
        self._fs().mkdirs(self._path("."))
        try:
            self._fs().create(self._path("_writer"), False).close()
        except Exception as e:  # py4j wraps the file system's own error
            raise LedgerError("another writer is at work, or one died: see unlock") from e
        try:
            return self._append(observations, {"snapshots": snapshots, "checkpoints": checkpoints})
        finally:
            self.unlock()

    def _append(self, observations: DataFrame, besides: dict[str, DataFrame | None]) -> int:
        known = self.read()
        batch = f"{len(self.batches()):08d}-{SCHEMA_VERSION}-{uuid.uuid4().hex[:8]}"
        written = [f"batch={batch}"]

        def undo() -> None:
            for leaf in written:
                self._fs().delete(self._path(leaf), True)

        fresh = deduplicate(observations, ["dedupe_key"], ["ingest_seq"])
        if known is not None:
            fresh = fresh.join(known.select("dedupe_key"), "dedupe_key", "left_anti").select(*observations.columns)
        day = F.date_format(F.timestamp_seconds("instant"), "yyyy-MM-dd")
        dated = fresh.withColumn("utc_day", F.coalesce(day, F.lit("unknown")))
        dated.write.partitionBy("utc_day").parquet(f"{self.root}/batch={batch}")
        added = self.spark.read.schema(dated.schema).parquet(f"{self.root}/batch={batch}")
        n = added.count()
        if n and not id_collisions(added, known).isEmpty():
            undo()
            raise LedgerError("an observation id is known under another key")
        if not n:
            undo()
            written.clear()
        for what, rows in besides.items():
            if rows is not None:
                rows.write.parquet(f"{self.root}/_{what}/batch={batch}")
                written.append(f"_{what}/batch={batch}")
        if written:
            self._fs().mkdirs(self._path("_batches"))
            self._fs().create(self._path(f"_batches/{batch}"), False).close()
        return n

    def between(self, start: int, end: int) -> DataFrame:
        """Observations of ``[start, end)``: days pruned with a day's margin, then tested on the instant.

        Rows without an instant whose text sorts into the range stay, to be counted as unusable.
        """
        rows = self.read()
        day = lambda s: F.date_format(F.timestamp_seconds(F.lit(s)), "yyyy-MM-dd")
        bound = lambda s: F.date_format(F.timestamp_seconds(F.lit(s)), "yyyy-MM-dd'T'HH:mm:ss")
        pruned = rows.where((F.col("utc_day") == "unknown") | F.col("utc_day").between(day(start - 86_400), day(end + 86_400)))
        exact = (F.col("instant") >= start) & (F.col("instant") < end)
        text = F.col("instant").isNull() & (F.col("occurred_at") >= bound(start - 86_400)) & (F.col("occurred_at") < bound(end + 86_400))
        return pruned.where(exact | text)


def register_identities(known: DataFrame, seen: DataFrame) -> DataFrame:
    """``ref, display, first_seen`` not yet known; the earliest sighting of a ref counts."""
    first = seen.groupBy("ref").agg(F.min(F.struct("first_seen", "display")).alias("x"))
    return first.select("ref", F.col("x.display").alias("display"), F.col("x.first_seen").alias("first_seen")).join(known, "ref", "left_anti")


def with_display(rows: DataFrame, identities: DataFrame, ref: str, out: str) -> DataFrame:
    """``rows`` plus ``out``: the display of a ref, or the ref itself."""
    names = identities.select(F.col("ref").alias("__ref"), F.col("display").alias("__display"))
    return rows.join(names, F.col(ref) == F.col("__ref"), "left").withColumn(out, F.coalesce("__display", ref)).drop("__ref", "__display")


def new_rows_only(incoming: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not known yet: reconciles a legacy table with the ledger."""
    return incoming.join(known.select(*keys).distinct(), keys, "left_anti").select(*incoming.columns)


def reconcile(legacy: DataFrame, known: DataFrame, objects: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of a legacy table to take over, rows that cannot be): a row needs an object that is what its id names.

    ``objects(object_id, content)``. Rows the ledger knows already are in neither.
    """
    fresh = read_objects(new_rows_only(legacy, known, keys), objects)
    why = F.when(F.col("content").isNull(), "object_missing").when(~F.col("intact"), "object_altered")
    return fresh.where("intact").select(*legacy.columns), fresh.where(~F.col("intact")).select(*legacy.columns, why.alias("problem"))
