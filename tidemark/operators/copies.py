"""Messages delivered at least once: exactly one row of each identifier stays.

Identifiers are split by their aggregated frequency, a map-side combined count over
16-byte key hashes. Rows of identifiers seen once pass straight through; only members
of repeated groups are ranked, and the union of both is the result. A repeated group is
ranked in buckets whose number follows from its size: first inside a bucket, then over
the buckets' first rows, so a group that holds a third of all rows is never sorted in
one task. The join to the repeated identifiers is many-to-one, which adaptive execution
splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.identifiers import key_hash
from tidemark.functions.steps import step

H1, H2, COUNT, BUCKET, RANK, ORDER = (f"__copies_{x}" for x in ("h1", "h2", "n", "bucket", "rank", "order"))
#: Members of a group that are ranked together; larger groups are cut into buckets of about this size.
GROUP_AT_ONCE = 20_000


def _hashed(df: DataFrame, keys: Sequence[Column], order: Column) -> DataFrame:
    """``df`` with the hashed key; a row without a whole key has a hash of its own, so it is nobody's copy."""
    # A step of its own, as each key is mentioned three times below and may be costly to write in its one form.
    named = [f"__copies_key{i}" for i in range(len(keys))]
    keyed = step(df, **dict(zip(named, keys, strict=True)))
    whole = F.lit(True)
    for k in named:
        whole = whole & F.col(k).isNotNull()
    h1, h2 = key_hash(*map(F.col, named))
    apart = F.lit("no key"), order
    # Both hashes are never null: a join then adds no filter, and both joins below share one shuffle of the rows.
    hashes = {H1: F.when(whole, h1).otherwise(F.xxhash64(*apart)), H2: F.when(whole, h2).otherwise(F.xxhash64(F.lit("apart"), *apart))}
    return keyed.withColumns(hashes).drop(*named)


def _repeated(hashed: DataFrame) -> DataFrame:
    return hashed.groupBy(H1, H2).agg(F.count(F.lit(1)).alias(COUNT)).where(F.col(COUNT) > 1)


def _ranked(members: DataFrame, order: Column) -> tuple[DataFrame, DataFrame]:
    """(first rows, further rows) of repeated groups, members carrying their group's COUNT."""
    buckets = F.ceil(F.col(COUNT) / F.lit(GROUP_AT_ONCE))
    # The join leaves a group in one task, which would do for the window: the buckets are spread on purpose.
    cut = members.withColumn(BUCKET, F.pmod(F.xxhash64(order), buckets)).repartition(H1, H2, BUCKET)
    inside = Window.partitionBy(H1, H2, BUCKET).orderBy(order)
    local = cut.withColumn(RANK, F.row_number().over(inside))
    # The first row of each bucket competes once more: one row per bucket of a group.
    heads = local.where(F.col(RANK) == 1).withColumn(RANK, F.row_number().over(Window.partitionBy(H1, H2).orderBy(order)))
    helpers = [COUNT, BUCKET, RANK]
    later = local.where(F.col(RANK) > 1).drop(*helpers)
    return heads.where(F.col(RANK) == 1).drop(*helpers), later.unionByName(heads.where(F.col(RANK) > 1).drop(*helpers))


def duplicate_rows(df: DataFrame, keys: Sequence[Column], order: Column) -> DataFrame:
    """The rows to drop: all of a repeated identifier but the lowest ``order``.

    ``order`` must be unique within a group (an arrival number). A null in any key
    makes the row its own record, so it is never a copy. Empty input gives no row.
    """
    hashed = _hashed(df, keys, order)
    _, later = _ranked(hashed.join(_repeated(hashed), [H1, H2]), order)
    return later.drop(H1, H2)


def kept_rows(df: DataFrame, keys: Sequence[Column], order: Column) -> DataFrame:
    """The complement of :func:`duplicate_rows`, under the same rules: singletons united with the first of each repeated group."""
    hashed = _hashed(df, keys, order)
    repeated = _repeated(hashed)
    once = hashed.join(repeated, [H1, H2], "left_anti")
    first, _ = _ranked(hashed.join(repeated, [H1, H2]), order)
    return once.unionByName(first.select(*once.columns)).drop(H1, H2)


def deduplicate(stored: DataFrame, keys: Sequence[str], order: Sequence[str], new: DataFrame | None = None) -> DataFrame:
    """Exactly one row per identifier of all stored and new messages, for orders that may tie.

    Singletons and rows with a null key pass unchanged. Of a repeated identifier a stored row stays before a
    new one, and among those the row with the lowest ``order`` (nulls first); rows that tie are told apart by
    a hash of the whole row, and of rows equal in every column one stays. ``new`` may lack columns of
    ``stored`` (null then). Columns of any name may be present; names starting with ``__copies_`` are reserved.
    """
    rows = stored.withColumn("__copies_new", F.lit(0))
    if new is not None:
        rows = rows.unionByName(new.withColumn("__copies_new", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in rows.columns if c != "__copies_new"]
    named = F.struct(*[F.col(f"`{c}`") for c in columns])
    tagged = rows.withColumn(ORDER, F.struct("__copies_new", *[F.col(f"`{c}`") for c in order], F.xxhash64(F.to_json(named)).alias("h")))
    hashed = _hashed(tagged, [F.col(f"`{k}`") for k in keys], F.col(ORDER))
    # Equal rows without a key share a hash of their own and would count as copies; each stays.
    keyless = F.lit(False)
    for k in keys:
        keyless = keyless | F.col(f"`{k}`").isNull()
    loose = hashed.where(keyless)
    hashed = hashed.where(~keyless)
    repeated = _repeated(hashed)
    once = hashed.join(repeated, [H1, H2], "left_anti")
    # Rows equal in every column are combined before the ranking, so none of them meet in one bucket.
    first, _ = _ranked(hashed.join(repeated, [H1, H2]).dropDuplicates([H1, H2, ORDER]), F.col(ORDER))
    every = once.unionByName(first.select(*once.columns)).unionByName(loose)
    return every.select(*[F.col(f"`{c}`") for c in columns])


def transcript_key(session: str = "session_id", uuid: str = "rec_uuid") -> list[Column]:
    """The record identity of transcript rows."""
    from tidemark.functions.identifiers import canonical_uuid

    return [canonical_uuid(session), canonical_uuid(uuid)]
