"""Schemas that drift between files and versions.

Every Arrow batch of raw records is folded to its own small schema: the leaf fields,
their JSON type and a fixed-size signature of their values. Schemas meet in map-side
combined aggregates, so what is shuffled depends on the number of fields and not of
records, and types fold through a promotion lattice. Neighbouring versions are then
compared field by field, and records are cast to the union schema.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.blocks import json_text, read_json, utf8

#: Where each vendor keeps its record and its version.
RECORD = {"codex": ("payload", "cli_version"), "claude-code": (None, "version")}
VERSION = re.compile(r"^\s*[vV]?(\d+)\.(\d+)\.(\d+)(?![\d.])")
TYPES = ("boolean", "number", "string", "array")
#: Bits of what the numbers of a field need: a fraction, more than 53 bits, more than 64 bits.
FRACTION, WIDE, HUGE = 1, 2, 4
SIGNATURE = 48
#: Values are of one kind when this share of their distinct values is common ...
COMMON_VALUES = 0.2
#: ... or this share of the distinct values of the side that has fewer ...
COMMON_CONTAINED = 0.5
#: ... or, if either field rarely repeats a value, this share of their forms.
COMMON_FORMS = 0.5

_MULTIPLY = np.random.default_rng(20).integers(1, 2**61, SIGNATURE, dtype=np.uint64) | np.uint64(1)
_ADD = np.random.default_rng(21).integers(1, 2**61, SIGNATURE, dtype=np.uint64)


def json_type(value) -> str:
    """boolean, number, string or array."""
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else "array"


def number_bits(value) -> int:
    """What a number needs of its column's type; 0 for a whole number any type holds, and for anything else."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return 0
    if isinstance(value, float):
        return FRACTION if math.isfinite(value) else HUGE
    return 0 if abs(value) <= 2**53 else WIDE if -(2**63) <= value < 2**63 else WIDE | HUGE


def number_type(bits: int) -> str:
    """The type that holds numbers of such needs exactly: integer, number, or string (their JSON text)."""
    if bits & HUGE or (bits & FRACTION and bits & WIDE):
        return "string"
    return "number" if bits & FRACTION else "integer"


def promote(a: str, b: str) -> str:
    """Least type that holds both: equal types stay; anything with an array is array; else string."""
    if a == b:
        return a
    return "array" if "array" in (a, b) else "string"


def leaves(record: dict) -> Iterator[tuple[str, object]]:
    """Non-null leaves of a record, objects entered and joined by dots, arrays not entered."""
    stack = [("", record)]
    while stack:
        base, obj = stack.pop()
        for k, v in obj.items():
            path = f"{base}.{k}" if base else k
            if isinstance(v, dict):
                stack.append((path, v))
            elif v is not None:
                yield path, v


def split_record(vendor: str | None, body: str | None) -> tuple[str | None, dict | None]:
    """(version as x.y.z or None, record below its root or None) of a raw line."""
    if vendor not in RECORD:
        return None, None
    root, version_field = RECORD[vendor]
    whole = read_json(body)
    record = whole.get(root) if root and isinstance(whole, dict) else whole
    if not isinstance(record, dict):
        return None, None
    text = record.get(version_field)
    m = VERSION.match(text) if isinstance(text, str) else None
    return (".".join(str(int(x)) for x in m.groups()) if m else None), record


def _h64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little")


def _form(text: str) -> str:
    return re.sub(r"[0-9A-Za-z]+", "", text) + f"#{len(text)}"


def _forms(texts: set[str]) -> set[str]:
    return {_form(t) for t in texts}


def _signature(hashes: set[int]) -> list[int]:
    x = np.fromiter(hashes, np.uint64, len(hashes))
    mixed = x[:, None] * _MULTIPLY + _ADD
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)).min(axis=0).astype(np.int64).tolist()


def field_profiles(lines: DataFrame) -> DataFrame:
    """``vendor, cli_version, field_path, json_type, n, bits, values, forms`` of ``lines(vendor, body)``.

    ``values`` and ``forms`` are minimum-hash signatures of the distinct values and of their
    outer forms, ``bits`` what the numbers need of a type. Records without a version have cli_version null.
    Unreadable records and unknown vendors are left out, as is the version field itself.
    """
    names = ["vendor", "cli_version", "field_path", "json_type", "n", "bits"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32()]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, list] = {}
            for vendor, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                version, record = split_record(vendor, body)
                if record is None:
                    continue
                for path, value in leaves(record):
                    if path == RECORD[vendor][1]:
                        continue
                    known = seen.setdefault((vendor, version, utf8(path), json_type(value)), [0, set(), 0])
                    known[0] += 1
                    known[1].add(value if isinstance(value, str) else json_text(value, sort_keys=True))
                    known[2] |= number_bits(value)
            keys = list(zip(*seen, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(k), t) for k, t in zip([*keys, [v[0] for v in seen.values()], [v[2] for v in seen.values()]], kinds, strict=True)]
                # Each distinct value of a batch is hashed once, each distinct form too.
                + [pa.array([_signature({_h64(x) for x in of(v[1])}) for v in seen.values()], pa.list_(pa.int64())) for of in (set, _forms)],
                names=[*names, "values", "forms"],
            )

    schema = "vendor string, cli_version string, field_path string, json_type string, n bigint, bits int, values array<bigint>, forms array<bigint>"
    partial = lines.select("vendor", "body").mapInArrow(fold, schema)
    mins = [F.min(F.col(c)[i]).alias(f"{c}_{i}") for c in ("values", "forms") for i in range(SIGNATURE)]
    merged = partial.groupBy("vendor", "cli_version", "field_path", "json_type").agg(F.sum("n").alias("n"), F.bit_or("bits").alias("bits"), *mins)
    packed = [F.array(*[F.col(f"{c}_{i}") for i in range(SIGNATURE)]).alias(c) for c in ("values", "forms")]
    return merged.select(*names, *packed)


def _alike(a: list[int], b: list[int]) -> float:
    return float(np.mean(np.asarray(a) == np.asarray(b)))


def _distinct(signature: list[int]) -> float:
    share = float(np.sum(np.asarray(signature, dtype=np.float64) / 2.0**63))
    return len(signature) / max(share, 1e-12) - 1


def _contained(a: list[int], b: list[int]) -> float:
    """Estimated share of the smaller set's members that the other set has too."""
    alike, sizes = _alike(a, b), [max(_distinct(x), 1.0) for x in (a, b)]
    return min(1.0, alike / (1 + alike) * sum(sizes) / min(sizes))


def same_kind(a, b) -> float:
    """0 unless two field profiles hold the same kind of values, else how alike they are."""
    if a.json_type != b.json_type:
        return 0.0
    values, forms = _alike(a.values_, b.values_), _alike(a.forms, b.forms)
    # A set of few values, all of them in one of many, has a small common share: it is measured on its own size.
    contained = _contained(a.values_, b.values_)
    rare = any(_distinct(x.values_) > 0.5 * x.n for x in (a, b))
    if values >= COMMON_VALUES or contained >= COMMON_CONTAINED or (rare and forms >= COMMON_FORMS):
        # A name that only changes its style is no evidence of its own; it decides between equal candidates.
        return 1 + max(values, contained) + forms + (_bare(a.field_path) == _bare(b.field_path))
    return 0.0


def _bare(path: str) -> str:
    return re.sub(r"[^a-z0-9.]", "", path.lower())


def _changes(pdf: pd.DataFrame) -> pd.DataFrame:
    """Ordered differences of one vendor: versions by number, renames paired best first."""
    pdf = pdf.rename(columns={"values": "values_"})
    fields: dict[tuple, dict] = {}
    for row in pdf.itertuples(index=False):
        at = fields.setdefault(tuple(int(x) for x in row.cli_version.split(".")), {})
        known = at.get(row.field_path)
        if known is None:
            at[row.field_path] = row
        else:
            many = row if row.n > known.n else known
            at[row.field_path] = many._replace(json_type=promote(row.json_type, known.json_type))
    out, order = [], sorted(fields)
    for low, high in zip(order, order[1:], strict=False):
        old, new = fields[low], fields[high]
        name = ".".join(map(str, high))
        gone, come = set(old) - set(new), set(new) - set(old)
        pairs = sorted(((-s, a, b) for a in gone for b in come if (s := same_kind(old[a], new[b]))))
        for _, a, b in pairs:
            if a in gone and b in come:
                gone.remove(a)
                come.remove(b)
                out.append((name, a, "renamed", b))
        out += [(name, a, "removed", "") for a in gone] + [(name, b, "added", "") for b in come]
        out += [(name, p, "retyped", "") for p in set(old) & set(new) if old[p].json_type != new[p].json_type]
    vendor = pdf["vendor"].iloc[0] if len(pdf) else None
    return pd.DataFrame([(vendor, *x) for x in sorted(out)], columns=["vendor", "cli_version", "field_path", "change_kind", "new_path"])


def schema_changes(profiles: DataFrame) -> DataFrame:
    """``vendor, cli_version, field_path, change_kind, new_path`` between neighbouring versions.

    What one task receives is a vendor's field list, whose size is that of the schema and
    not of the data. A field with several types in one version has their promotion. Records without a
    version do not count.
    """
    schema = "vendor string, cli_version string, field_path string, change_kind string, new_path string"
    return profiles.where(F.col("cli_version").isNotNull()).groupBy("vendor").applyInPandas(_changes, schema)


def union_schema(profiles: DataFrame) -> list[tuple[str, str]]:
    """(field, promoted type) of every field of any readable record, with or without a version, ordered by name.

    Numbers are ``integer`` where all are whole and fit 64 bits, ``number`` (a double) where that loses
    nothing, else ``string``. Collected to the driver: one row per field name and type of the schema.
    """
    folded: dict[str, str] = {}
    per_field = profiles.groupBy("field_path", "json_type").agg(F.bit_or("bits").alias("bits"))
    for row in per_field.orderBy("field_path", "json_type").collect():
        kind = number_type(row.bits) if row.json_type == "number" else row.json_type
        known = folded.get(row.field_path)
        folded[row.field_path] = kind if known is None else promote(known, kind)
    return sorted(folded.items())


def column_names(fields: list[tuple[str, str]], taken: tuple[str, ...] = ("line_id", "vendor", "cli_version")) -> list[str]:
    """A column name for every field: dots become double underscores.

    Names that would meet (``a.b`` and ``a__b``, names that differ in case only, the table's own columns) get a number
    behind them, the first field by name keeping the plain one.
    """
    used, out = {t.lower() for t in taken}, []
    for path, _ in fields:
        plain = name = path.replace(".", "__") or "_"
        n = 2
        while name.lower() in used:
            name, n = f"{plain}__{n}", n + 1
        used.add(name.lower())
        out.append(name)
    return out


def unified_table(lines: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """All readable records cast to the union schema: ``line_id, vendor, cli_version`` and one column per field.

    Columns are named by :func:`column_names`. Whole numbers are bigint, others double; arrays and values of
    promoted fields are text (JSON unless already text); a missing or null field is null. Unreadable lines
    are left out; records without a version stay, with a null cli_version.
    """
    spark_type = {"boolean": ("boolean", pa.bool_()), "integer": ("bigint", pa.int64()), "number": ("double", pa.float64())}
    typed = [(p, *spark_type.get(t, ("string", pa.string()))) for p, t in fields]
    names = ["line_id", "vendor", "cli_version", *column_names(fields)]
    quoted = [n.replace("`", "``") for n in names[3:]]
    schema = "line_id bigint, vendor string, cli_version string" + "".join(f", `{n}` {t}" for n, (_, t, _) in zip(quoted, typed, strict=True))

    def cast(value, kind: str):
        if value is None or kind in ("boolean", "bigint"):
            return value
        if kind == "double":
            return float(value)
        return utf8(value if isinstance(value, str) else json_text(value, ensure_ascii=False, separators=(",", ":")))

    def conform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list = []
            cols: list[list] = [[] for _ in range(2 + len(typed))]
            for i, vendor, body in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                version, record = split_record(vendor, body)
                if record is None:
                    continue
                version_field = RECORD[vendor][1]
                flat = {utf8(p): v for p, v in leaves(record) if p != version_field}
                ids.append(i)
                cols[0].append(vendor)
                cols[1].append(version)
                for c, (path, kind, _) in zip(cols[2:], typed, strict=True):
                    c.append(cast(flat.get(path), kind))
            arrays = [pa.array(ids, pa.int64()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string())]
            arrays += [pa.array(c, t) for c, (_, _, t) in zip(cols[2:], typed, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return lines.select("line_id", "vendor", "body").mapInArrow(conform, schema)


def field_counts(profiles: DataFrame) -> DataFrame:
    """``vendor, cli_version, field_path, json_type, n``: how many records of a version hold a field with each type."""
    return profiles.select("vendor", "cli_version", "field_path", "json_type", "n")
