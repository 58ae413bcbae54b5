"""Raw files: content-addressed snapshots, complete lines, cursors and prefix checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.scratch import Scratch

OBJECT_ID = r"^sha256:[0-9a-f]{64}$"


def discover(spark: SparkSession, roots: dict[str, str], glob: str = "*.jsonl") -> DataFrame:
    """``kind, locator, content, object_id`` of every file of the pattern below the roots; a missing root has none."""
    jvm = spark._jvm
    out = spark.createDataFrame([], "kind string, locator string, content binary")
    for kind, root in roots.items():
        path = jvm.org.apache.hadoop.fs.Path(root)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            continue
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
        out = out.unionByName(found.select(F.lit(kind).alias("kind"), F.col("path").alias("locator"), "content"))
    return out.withColumn("object_id", object_id(F.col("content")))


def object_id(content: Column) -> Column:
    """``sha256:`` and the digest of the bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def is_object_id(text: Column) -> Column:
    """Whether a text is an object id in lower case."""
    return F.coalesce(text.rlike(OBJECT_ID), F.lit(False))


def archive(found: DataFrame, objects: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new objects, new snapshots, outcome counts) of discovered files; known content and known versions are not added again."""
    new_objects = found.select("object_id", "content").dropDuplicates(["object_id"]).join(objects, "object_id", "left_anti")
    tagged = found.join(snapshots.select("locator", "object_id", F.lit(True).alias("known")), ["locator", "object_id"], "left")
    outcome = F.when(F.col("known"), "present").otherwise("created")
    fresh = tagged.where(F.col("known").isNull()).select("kind", "locator", "object_id")
    return new_objects, fresh, tagged.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def latest(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of every locator."""
    columns = [c for c in snapshots.columns if c != "locator"]
    best = snapshots.groupBy("locator").agg(F.max_by(F.struct(*columns), "snapshot_id").alias("s"))
    return best.select("locator", *[F.col(f"s.{c}") for c in columns])


def complete_lines(content: Column) -> Column:
    """The lines that end in a newline, one trailing return stripped; invalid bytes are replaced."""
    lines = F.split(F.make_valid_utf8(content.cast("string")), "\n", -1)
    whole = F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))
    return F.transform(whole, lambda x: F.regexp_replace(x, r"\r$", ""))


def ends_torn(content: Column) -> Column:
    """Whether bytes stop inside a line."""
    text = content.cast("string")
    return (F.length(content) > 0) & ~text.endswith("\n")


def read_lines(snapshots: DataFrame) -> DataFrame:
    """``locator, snapshot_id, line_no, line`` from 1 of snapshots with content."""
    at = F.posexplode(complete_lines(F.col("content"))).alias("pos", "line")
    return snapshots.select("locator", "snapshot_id", at).select("locator", "snapshot_id", (F.col("pos") + 1).alias("line_no"), "line")


def cursors(current: DataFrame, previous: DataFrame) -> DataFrame:
    """``locator, start_line``: where reading the current snapshot goes on.

    ``previous(locator, snapshot_id, cursor, content)`` is the checkpointed snapshot. A locator whose
    checkpoint is current is left out. Unless the first ``cursor`` complete lines are the same in
    both, or where the old bytes are gone, reading starts again at line 0.
    """
    old = previous.select("locator", F.col("snapshot_id").alias("old_id"), "cursor", F.col("content").alias("old"))
    both = current.join(old, "locator", "left").where(~F.col("snapshot_id").eqNullSafe(F.col("old_id")))
    head = lambda c: F.sha2(F.array_join(F.slice(complete_lines(F.col(c)), 1, F.greatest("cursor", F.lit(0))), "\n"), 256)
    long_enough = (F.size(complete_lines(F.col("content"))) >= F.col("cursor")) & (F.size(complete_lines(F.col("old"))) >= F.col("cursor"))
    same = F.coalesce(long_enough & (head("content") == head("old")), F.lit(False))
    return both.select("locator", F.when(same, F.col("cursor")).otherwise(0).alias("start_line"))


#: Splits whose first numbers are sent to every task; beyond that they are joined by a shuffle.
SPLITS_TO_SEND = 200_000


def numbered_lines(spark: SparkSession, root: str, glob: str = "*.jsonl") -> DataFrame:
    """``locator, line_no, line`` of every complete line below a folder, for files of any size.

    Files are read by splits and no file is ever one row. A task hands out a split's lines in order under consecutive ids, so a line's
    number is its id less the split's lowest, plus the lines of the file's splits before, which a prefix sum over splits gives: lines
    themselves are not shuffled. Should the splits of the second reading differ from those counted (small inputs are split by the number of
    cores, which may change), the reading fails with a message and loses nothing. A last line without its newline is left out; one trailing return is stripped. Lines are in UTF-8. The
    splits are counted in a job of their own while the frame is being built.
    """
    meta = F.col("_metadata")
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", "\n").text(root)
    lines = read.select(
        meta["file_path"].alias("locator"), meta["file_size"].alias("size"), meta["file_block_start"].alias("at"), F.monotonically_increasing_id().alias("m"), F.col("value").alias("line")
    )
    per = lines.groupBy("locator", "at").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("line") + 1).alias("b"), F.max("size").alias("size"), F.min("m").alias("m0")
    )
    per = Scratch(spark).cut(per, "splits")
    before = Window.partitionBy("locator").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("locator")
    torn = F.sum("b").over(whole) > F.col("size")
    splits = per.select(
        F.col("locator").alias("__l"), F.col("at").alias("__a"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), "n", "m0",
        F.when(torn, F.sum("n").over(whole)).alias("torn_line"),
    )
    if per.count() <= SPLITS_TO_SEND:
        splits = F.broadcast(splits)
    placed = lines.join(splits, (F.col("locator") == F.col("__l")) & (F.col("at") == F.col("__a")), "left")
    k = F.col("m") - F.col("m0") + 1
    number = F.when(F.coalesce(k.between(1, F.col("n")), F.lit(False)), F.col("offset") + k).otherwise(F.raise_error(F.lit("the splits changed between two readings: read again")).cast("bigint"))
    placed = placed.withColumn("line_no", number)
    kept = placed.where(F.col("torn_line").isNull() | (F.col("line_no") < F.col("torn_line")))
    return kept.select("locator", "line_no", F.regexp_replace("line", r"\r$", "").alias("line"))


def lines_after(snapshots: DataFrame, starts: DataFrame) -> DataFrame:
    """The lines of :func:`read_lines` behind each locator's ``start_line`` of :func:`cursors`; locators without one are not read."""
    from_line = starts.select(F.col("locator").alias("__l"), "start_line")
    lines = read_lines(snapshots.join(from_line, F.col("locator") == F.col("__l"), "left_semi"))
    return lines.join(from_line, F.col("locator") == F.col("__l")).where(F.col("line_no") > F.col("start_line")).drop("__l", "start_line")


def archive_report(found: DataFrame, outcomes: DataFrame, failed: int = 0) -> DataFrame:
    """One row: ``scanned, archived, unchanged, failed, bytes`` of a run, which writes nothing itself.

    ``outcomes`` are the counts of :func:`archive`, ``failed`` the files that could not be read, bytes those of what is new by content.
    """
    count = lambda name: F.coalesce(F.sum(F.when(F.col("outcome") == name, F.col("n"))), F.lit(0)).alias(name)
    totals = outcomes.agg(count("created"), count("present"))
    size = found.select("object_id", F.octet_length("content").alias("b")).dropDuplicates(["object_id"]).agg(F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"))
    return totals.withColumn("bytes", size.scalar()).select(
        (F.col("created") + F.col("present") + failed).alias("scanned"), F.col("created").alias("archived"), F.col("present").alias("unchanged"),
        F.lit(failed).alias("failed"), "bytes",
    )


def advance(checkpoints: DataFrame, written: DataFrame) -> DataFrame:
    """Checkpoints after a write: the highest snapshot of a locator, the later write where equal."""
    both = checkpoints.withColumn("w", F.lit(0)).unionByName(written.withColumn("w", F.lit(1)))
    best = both.groupBy("locator").agg(F.max(F.struct("snapshot_id", "w", "cursor")).alias("b"))
    return best.select("locator", F.col("b.snapshot_id").alias("snapshot_id"), F.col("b.cursor").alias("cursor"))
