"""Profile of raw records by kind: counts, fields, stable identifier, bytes and time range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import variant_string
from tidemark.functions.steps import step


def inventory(records: DataFrame, kind: str, body: str, candidates: Sequence[str], time_field: str) -> DataFrame:
    """``kind, n, bytes, fields, stable_id, first_time, last_time`` of JSON records.

    fields is the sorted union of top-level names, joined by commas. stable_id is the candidate that is the first
    one held as a string by every record of the kind, in its payload where it has one, else null. Unreadable records count
    under kind null.
    """
    rows = step(records.select(F.col(kind).alias("__kind"), F.col(body).alias("__body")), __v=F.try_parse_json(F.col("__body")))
    readable = F.col("__v").isNotNull()
    payload = F.schema_of_variant(F.try_variant_get("__v", "$.payload", "variant")).startswith("OBJECT")
    held = lambda c: F.when(F.coalesce(payload, F.lit(False)), variant_string(F.col("__v"), f"$.payload.{c}")).otherwise(variant_string(F.col("__v"), f"$.{c}"))
    found = F.coalesce(*[F.when(held(c).isNotNull(), c) for c in candidates], F.lit(""))
    typed = rows.select(
        F.when(readable, F.col("__kind")).alias("kind"), F.octet_length("__body").alias("b"), F.when(readable, F.json_object_keys("__body")).alias("keys"),
        F.when(readable, F.get_json_object("__body", f"$.{time_field}")).alias("t"), F.when(readable, found).alias("found"),
    )
    # Each distinct key list is one row before names are gathered, so the gathered lists stay small.
    shapes = typed.groupBy("kind", "keys").agg(
        F.count(F.lit(1)).alias("n"), F.sum("b").alias("b"), F.min("t").alias("lo"), F.max("t").alias("hi"), F.min("found").alias("f_lo"), F.max("found").alias("f_hi"),
    )
    stable = F.when((F.min("f_lo") == F.max("f_hi")) & (F.min("f_lo") != ""), F.min("f_lo"))
    return shapes.groupBy("kind").agg(
        F.sum("n").alias("n"), F.sum("b").alias("bytes"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("keys")))), ",").alias("fields"),
        stable.alias("stable_id"), F.min("lo").alias("first_time"), F.max("hi").alias("last_time"),
    )


def fingerprints(records: DataFrame, vendor: str, file: str, body: str, order: str) -> DataFrame:
    """``vendor, signature, files``: how many files of a vendor have each format.

    A file of vendor ``codex`` is told by the client's version and the sorted names in the payload of its first session record by
    ``order``; any other by the sorted versions its records carry (``?`` where one has none). Unreadable records do not count; a file
    without a session record has ``cli=?;meta_keys=none``.
    """
    rows = step(records.select(F.col(vendor).alias("v"), F.col(file).alias("f"), F.col(order).alias("o"), F.col(body).alias("__body")), __j=F.try_parse_json(F.col("__body")))
    rows = rows.where(F.col("__j").isNotNull())
    get = lambda path: F.try_variant_get("__j", path, "string")
    is_meta = F.coalesce(get("$.type"), F.lit("")) == "session_meta"
    keys = F.array_join(F.array_sort(F.json_object_keys(F.get_json_object("__body", "$.payload"))), ",")
    meta = F.struct("o", F.coalesce(get("$.payload.cli_version"), F.lit("?")).alias("cli"), F.coalesce(keys, F.lit("none")).alias("keys"))
    first = rows.groupBy("v", "f").agg(F.min(F.when(is_meta, meta)).alias("m"))
    by_meta = F.concat(F.lit("cli="), F.coalesce("m.cli", F.lit("?")), F.lit(";meta_keys="), F.coalesce("m.keys", F.lit("none")))
    # Versions are one row per file and version before they are gathered.
    versions = rows.groupBy("v", "f", F.coalesce(get("$.version"), F.lit("?")).alias("x")).agg(F.count(F.lit(1)))
    by_version = versions.groupBy("v", "f").agg(F.concat(F.lit("version="), F.array_join(F.array_sort(F.collect_set("x")), ",")).alias("signature"))
    codex = F.col("v") == "codex"
    signed = first.where(codex).select("v", by_meta.alias("signature")).unionByName(by_version.where(~codex).select("v", "signature"))
    return signed.groupBy(F.col("v").alias("vendor"), "signature").agg(F.count(F.lit(1)).alias("files"))
