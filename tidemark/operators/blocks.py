"""Nested content blocks shredded into an adjacency table and pivoted into an entity table.

Arrow batches turn each content document into adjacency rows: object nodes (the
blocks) and scalar nodes (their fields), each with its parent, label and ordinal; a
node is named by its ordinals from the top. Object nodes are then joined with their
scalar children by grouping on the owning node, which pivots labels into columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.scratch import Scratch

NODE_SCHEMA = "owner string, parent string, label string, ordinal int, kind string, scalar string"


def _no_constant(name: str) -> None:
    raise ValueError(name)


_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = json.JSONDecoder(parse_constant=_no_constant)


def read_deep(text: str):
    """The value of a JSON text of any depth, by an explicit stack; ``ValueError`` for any other text.

    Only strings, numbers and literals are left to the library, which never nests for them.
    """
    skip = lambda i: _SPACE.match(text, i).end()
    open_: list[tuple[list | dict, str | None]] = []

    def key_at(i: int) -> tuple[str, int]:
        if text[i : i + 1] != '"':
            raise ValueError("a name is expected")
        key, i = _SCALAR.raw_decode(text, i)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError("a colon is expected")
        return key, skip(i + 1)

    at = skip(0)
    while True:
        c = text[at : at + 1]
        if c in ("[", "{"):
            value = [] if c == "[" else {}
            at = skip(at + 1)
            if text[at : at + 1] != ("]" if c == "[" else "}"):
                key, at = (None, at) if c == "[" else key_at(at)
                open_.append((value, key))
                continue
            at += 1
        else:
            value, at = _SCALAR.raw_decode(text, at)
        while open_:  # the value is complete: it goes into what holds it, which may end as well
            holder, key = open_.pop()
            if isinstance(holder, list):
                holder.append(value)
            else:
                holder[key] = value
            at = skip(at)
            c = text[at : at + 1]
            if c == ",":
                at = skip(at + 1)
                key, at = (None, at) if isinstance(holder, list) else key_at(at)
                open_.append((holder, key))
                break
            if c != ("]" if isinstance(holder, list) else "}"):
                raise ValueError("a comma or an end is expected")
            value, at = holder, at + 1
        else:
            if skip(at) != len(text):
                raise ValueError("more than one value")
            return value


def read_json(text: str | None):
    """The value of a JSON text; ``None`` for null and unreadable texts."""
    if text is None:
        return None
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        try:
            return read_deep(text)
        except ValueError:
            return None
    except ValueError:
        return None


def json_text(value, **options) -> str:
    """The JSON text of a value of any depth, as ``json.dumps`` writes it."""
    try:
        return json.dumps(value, **options)
    except RecursionError:
        pass
    comma, colon = options.get("separators") or (", ", ": ")
    out: list[str] = []
    todo: list[tuple[bool, object]] = [(False, value)]
    while todo:
        is_text, x = todo.pop()
        if is_text or not (x and isinstance(x, (list, dict))):
            out.append(x if is_text else json.dumps(x, **options))
        elif isinstance(x, list):
            parts = [p for v in x for p in ((True, comma), (False, v))][1:]
            todo += [(True, "]"), *reversed(parts), (True, "[")]
        else:
            items = sorted(x.items()) if options.get("sort_keys") else x.items()
            parts = [p for k, v in items for p in ((True, comma), (True, json.dumps(k, **options) + colon), (False, v))][1:]
            todo += [(True, "}"), *reversed(parts), (True, "{")]
    return "".join(out)


def blocks_of(value) -> list:
    """Content as a list of positions: block objects, and ``None`` where a position holds none."""
    if isinstance(value, str):
        if value.lstrip()[:1] == "[":
            inner = read_json(value)
            if isinstance(inner, list) and all(x is None or isinstance(x, dict) for x in inner):
                return inner
        return [{"type": "text", "text": value}]
    if isinstance(value, dict):
        return [value]
    if isinstance(value, list):
        return [x if isinstance(x, dict) else None for x in value]
    return []


def walk(value) -> Iterator[tuple[str, str, int, dict]]:
    """Every block of a content value with its path, its parent's path and its position."""
    stack = [("", value)]
    while stack:
        base, content = stack.pop()
        for i, block in enumerate(blocks_of(content)):
            if block is None:
                continue
            path = f"{base}.{i}" if base else str(i)
            yield path, base, i, block
            if block.get("content") is not None:
                stack.append((path, block["content"]))


def utf8(text: str) -> str:
    """Text that UTF-8 can hold; lone surrogates become question marks."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-8", "replace").decode()


def adjacency(df: DataFrame, ids: Sequence[str], content: str, labels: Sequence[str] | None = None) -> DataFrame:
    """``ids`` plus owner, parent, label, ordinal, kind, scalar of every node.

    A row of kind ``object`` is a block; one of kind ``scalar`` is a field of the block named
    by ``owner``, its value as text (JSON for numbers, booleans, objects and arrays other than
    content). ``labels`` keeps only the named fields. Null, unreadable and scalar content
    other than text yields no row.
    """
    source = df.select(*ids, F.col(content).alias("__content"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(ids)]) + ", " + NODE_SCHEMA
    wanted = None if labels is None else frozenset(labels)
    n_ids = len(ids)

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            cols: list[list] = [[], [], [], [], [], []]

            def put(row: int, *values) -> None:
                at.append(row)
                for c, v in zip(cols, values, strict=True):
                    c.append(v)

            for row, text in enumerate(batch.column(n_ids).to_pylist()):
                for path, base, i, block in walk(read_json(text)):
                    put(row, path, base, "content", i, "object", None)
                    for k, v in block.items():
                        if v is None or (wanted is not None and k not in wanted):
                            continue
                        if k == "content" and wanted is None:
                            continue
                        shown = v if isinstance(v, str) else json_text(v, ensure_ascii=False)
                        put(row, path, path, utf8(k), None, "scalar", utf8(shown))
            take = pa.array(at, pa.int64())
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(j).take(take) for j in range(n_ids)] + [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                names=[*ids, "owner", "parent", "label", "ordinal", "kind", "scalar"],
            )

    return source.mapInArrow(shred, schema)


def entity_table(nodes: DataFrame, ids: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """One row per block: ``ids``, block_path, parent_path, ordinal and one column per label.

    A label a block lacks, or holds as null, is null.
    """
    pick = [F.max(F.when((F.col("kind") == "scalar") & (F.col("label") == x), F.col("scalar"))).alias(x) for x in labels]
    is_object = F.col("kind") == "object"
    return (
        nodes.groupBy(*ids, "owner")
        .agg(F.max(F.when(is_object, F.col("parent"))).alias("parent_path"), F.max(F.when(is_object, F.col("ordinal"))).alias("ordinal"), *pick)
        .withColumnRenamed("owner", "block_path")
    )


def path_order(path: Column) -> Column:
    """Sort key of block paths: document order, by number and not by text."""
    return F.transform(F.split(path, r"\."), lambda x: x.cast("int"))


def block_table(rows: DataFrame, row_id: str, session: str, content: str) -> DataFrame:
    """``row_id, block_path, block_type, use_row_id, use_path`` of every block.

    block_type is '' where a block has none. A tool_result is linked to the tool_use with its
    id in the same session; of several the first by row and place counts. Without such a block,
    without a session or an id, and for every other block, the link is -1 and ''. The entity table is written
    to the shared folder first, so content is read once.
    """
    labels = ("type", "id", "tool_use_id")
    nodes = adjacency(rows.select(row_id, session, content), [row_id, session], content, labels)
    table = Scratch(rows.sparkSession).cut(entity_table(nodes, [row_id, session], labels), "blocks")
    uses = (
        table.where((F.col("type") == "tool_use") & F.col("id").isNotNull() & F.col(session).isNotNull())
        .groupBy(F.col(session).alias("__s"), F.col("id").alias("__id"))
        .agg(F.min(F.struct(F.col(row_id).alias("r"), path_order(F.col("block_path")).alias("o"), F.col("block_path").alias("p"))).alias("__use"))
    )
    key = F.when(F.col("type") == "tool_result", F.col("tool_use_id"))
    # Blocks without a link to look up are spread by their row instead of meeting under a null key.
    apart = F.when(F.col("__key").isNull() | F.col(session).isNull(), F.col(row_id)).otherwise(F.lit(-1))
    same = (F.col(session) == F.col("__s")) & (F.col("__key") == F.col("__id")) & (F.col("__apart") == F.col("__none"))
    return (
        table.withColumn("__key", key)
        .withColumn("__apart", apart)
        .join(uses.withColumn("__none", F.lit(-1).cast("bigint")), same, "left")
        .select(
            row_id,
            "block_path",
            F.coalesce("type", F.lit("")).alias("block_type"),
            F.coalesce(F.col("__use.r"), F.lit(-1)).cast("bigint").alias("use_row_id"),
            F.coalesce(F.col("__use.p"), F.lit("")).alias("use_path"),
        )
    )
