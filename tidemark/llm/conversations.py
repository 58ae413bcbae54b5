"""Ordered conversations rebuilt from separate message rows.

Rows are linked by the parent they reply to. Links over rows that are no messages are
resolved by pointer jumping. Rows that lack a session identifier are put into conversations
as the connected components of their reply and quote links, found by alternating
large-star and small-star joins. Conversations are then judged by map-side combined counts
(first messages, absent parents, branches, unanswered prompts), and the promising ones are
numbered along their chain; one whose messages do not all get a number has a cycle. Conversations
of a bounded number of messages are numbered in one group each, longer ones by pointer
jumping, in as many rounds as the logarithm of the longest chain, so a session that holds a
third of all rows is never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tidemark.functions.identifiers import canonical_uuid, key_hash
from tidemark.llm.components import connected_components
from tidemark.operators.blocks import read_json, walk
from tidemark.scratch import Scratch

ROOT, ABSENT = -1, -2
#: Messages of a conversation that may be gathered into one row; longer conversations are numbered by joins.
SMALL = 1_000


def content_says_something(text: str | None) -> bool:
    """Whether content holds a block other than text, or a text with more than white space."""
    for _, _, _, block in walk(read_json(text)):
        if block.get("type") != "text":
            return True
        said = block.get("text")
        if isinstance(said, str) and said.strip():
            return True
    return False


@F.pandas_udf(BooleanType())
def has_content(content: pd.Series) -> pd.Series:
    """Vectorised :func:`content_says_something`."""
    return content.map(content_says_something).astype(bool)


def message_role() -> Column:
    """'user' or 'assistant' of a row, else another text or null."""
    blank = r"^\s+|\s+$"
    return F.lower(F.regexp_replace(F.coalesce("msg_role", "rec_type"), blank, ""))


def message_rows(kept: DataFrame) -> DataFrame:
    """``id, session, uuid, parent, role, is_msg, answer`` of deduplicated transcript rows."""
    role = message_role()
    is_msg = F.coalesce(role.isin("user", "assistant"), F.lit(False)) & ~F.coalesce("is_sidechain", F.lit(False))
    reply = is_msg & (role == "assistant")
    return kept.select(
        F.col("row_id").alias("id"), canonical_uuid("session_id").alias("session"), canonical_uuid("rec_uuid").alias("uuid"),
        F.when(F.col("parent_uuid") != "", canonical_uuid("parent_uuid")).alias("parent"),
        F.when(is_msg, role).alias("role"), is_msg.alias("is_msg"),
        F.when(reply, F.col("content_json")).alias("content"),
    ).withColumn("answer", F.col("content").isNotNull() & has_content("content")).drop("content")


def with_parent_id(rows: DataFrame) -> DataFrame:
    """Adds ``up``: the id of the parent row of the same session, ROOT without a parent, ABSENT without its row.

    Rows of no session are linked among themselves. Should a parent text name several rows, the
    one with the lowest id counts.
    """
    scope = F.coalesce("session", F.lit(""))
    h1, h2 = key_hash(scope, F.col("uuid"))
    named = (
        rows.where(F.col("uuid").isNotNull())
        .select(h1.alias("h1"), h2.alias("h2"), "id")
        .groupBy("h1", "h2")
        .agg(F.min("id").alias("up_id"))
    )
    p1, p2 = key_hash(scope, F.col("parent"))
    asks = rows.withColumns(
        {"h1": F.when(F.col("parent").isNotNull(), p1).otherwise(F.xxhash64("id")), "h2": F.when(F.col("parent").isNotNull(), p2)}
    )
    up = F.when(F.col("parent").isNull(), ROOT).otherwise(F.coalesce("up_id", F.lit(ABSENT)))
    return asks.join(named, ["h1", "h2"], "left").withColumn("up", up.cast("bigint")).drop("h1", "h2", "up_id")


def pass_over(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, session, uuid, role, answer, up`` of messages, ``up`` led past rows that are no messages.

    Rows that are no messages jump to their target's target until each ends at a message, at
    ROOT or at ABSENT; one that still leads to itself lies on a cycle and counts as ABSENT.
    """
    kind = rows.select(F.col("id").alias("t"), F.col("is_msg").alias("t_msg"))
    others = (
        rows.where(~F.col("is_msg")).select("id", "up").join(kind, F.col("up") == F.col("t"), "left")
        .select("id", "up", (F.col("up") < 0) | F.col("t_msg"))
        .toDF("id", "up", "done")
    )
    jumps = scratch.cut(others, "jumps")
    open_rows = jumps.where(~F.col("done")).count()
    while open_rows:
        far = jumps.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("done").alias("done2"))
        moved = jumps.where(~F.col("done")).join(far, "up").select("id", F.col("up2").alias("up"), F.col("done2").alias("done"))
        jumps = scratch.cut(jumps.where("done").unionByName(moved), "jumps")
        left = jumps.where(~F.col("done")).count()
        # Open paths at least halve per round; an unchanged count after enough rounds is a set of cycles.
        if left == open_rows and not _shorter(jumps):
            break
        open_rows = left
    ends = jumps.select(F.col("id").alias("up"), F.when(F.col("done"), F.col("up")).otherwise(ABSENT).cast("bigint").alias("end"))
    msgs = rows.where("is_msg").select("id", "session", "uuid", "role", "answer", "up")
    return msgs.join(ends, "up", "left").withColumn("up", F.coalesce("end", "up")).drop("end")


def _shorter(jumps: DataFrame) -> bool:
    """Whether any open path still leads to a finished row."""
    done = jumps.where("done").select(F.col("id").alias("up"))
    return not jumps.where(~F.col("done")).join(done, "up", "left_semi").isEmpty()


def promising(msgs: DataFrame) -> DataFrame:
    """``conversation, n`` of those with one first message, no absent parent, no branch and an answer to every prompt."""
    child = msgs.where(F.col("up") >= 0).groupBy("up").agg(
        F.count(F.lit(1)).alias("children"), F.max((F.col("role") == "assistant") & F.col("answer")).alias("answered")
    )
    seen = msgs.join(child.withColumnRenamed("up", "c"), F.col("id") == F.col("c"), "left")
    children = F.coalesce("children", F.lit(0))
    return (
        seen.groupBy("conversation")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("up") == ROOT).alias("roots"),
            F.count_if(F.col("up") == ABSENT).alias("absent"),
            F.max(children).alias("most"),
            F.count_if((F.col("role") == "user") & ~((children == 1) & F.coalesce("answered", F.lit(False)))).alias("unanswered"),
        )
        .where("roots = 1 and absent = 0 and most <= 1 and unanswered = 0")
        .select("conversation", "n")
    )


def chain_positions(msgs: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, msg_no`` from 1 along ``up``; rows that never reach a ROOT (cycles) get none.

    Each round writes what is still open and what became final; final rows are not written again.
    """
    still = scratch.cut(msgs.select("id", "up", F.lit(1).cast("bigint").alias("steps")), "ranks")
    final = still.where(F.col("up") < 0)
    before, no = None, 0
    while True:
        still_open = still.where(F.col("up") >= 0)
        n = still_open.count()
        if not n or n == before:
            return final.where(F.col("up") == ROOT).select("id", F.col("steps").alias("msg_no"))
        before, no = n, no + 1
        far = final.unionByName(still_open).select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"))
        moved = still_open.join(far, "up").select("id", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"))
        still = scratch.cut(moved, f"ranks{no}")
        final = final.unionByName(still.where(F.col("up") < 0))


def walk_chain(ups: list[int], ids: list[int]) -> list[int] | None:
    """Positions in the order from the first message, or None where the links are no single chain."""
    at, reply = {x: i for i, x in enumerate(ids)}, {}
    for i, up in enumerate(ups):
        if up in reply:
            return None
        reply[up] = i
    order, here = [], ROOT
    while (i := reply.get(here)) is not None and len(order) < len(ids):
        order.append(i)
        here = ids[i]
    return order if len(order) == len(at) else None


def number_small(msgs: DataFrame) -> DataFrame:
    """``conversation, id, uuid, role, msg_no`` of conversations that are single chains, each gathered into one row.

    For conversations of at most SMALL messages only: the group is bounded.
    """
    fields = ("id", "up", "uuid", "role")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    grouped = msgs.groupBy("conversation").agg(*[F.collect_list(F.struct(*fields)).alias("m")])
    packed = grouped.select("conversation", *[F.col(f"m.{f}").alias(f) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [batch.column(i + 1).flatten() for i in range(len(fields))]
            ends = np.cumsum([0, *batch.column(1).value_lengths().to_pylist()])
            ids, ups = flat[0].to_pylist(), flat[1].to_pylist()
            take, owner, number = [], [], []
            for row, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
                order = walk_chain(ups[a:b], ids[a:b])
                if order is not None:
                    take += [a + i for i in order]
                    owner += [row] * (b - a)
                    number += range(1, b - a + 1)
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), flat[0].take(at), flat[2].cast(kinds[2]).take(at), flat[3].cast(kinds[3]).take(at), pa.array(number, pa.int64())],
                names=["conversation", "id", "uuid", "role", "msg_no"],
            )

    return packed.mapInArrow(run, "conversation string, id bigint, uuid string, role string, msg_no bigint")


def number_large(msgs: DataFrame, scratch: Scratch) -> DataFrame:
    """The same of conversations of any size, by pointer jumping; ``msgs`` carries ``n``, the number of messages."""
    placed = msgs.join(chain_positions(msgs, scratch), "id")
    whole = placed.groupBy("conversation").agg(F.count(F.lit(1)).alias("placed"))
    return placed.join(whole, "conversation").where("placed = n").select("conversation", "id", "uuid", "role", "msg_no")


def name_by_components(loose: DataFrame, quotes: DataFrame | None, scratch: Scratch) -> DataFrame:
    """``loose`` plus ``conversation``: ``component/`` and the lowest id of all messages linked to one another."""
    links = loose.where(F.col("up") >= 0).select(F.col("id").alias("u"), F.col("up").alias("v"))
    if quotes is not None:
        members = loose.select("id")
        ends = quotes.select("u", "v").join(members.withColumnRenamed("id", "u"), "u").join(members.withColumnRenamed("id", "v"), "v")
        links = links.unionByName(ends.select("u", "v"))
    parts = connected_components(links, scratch).withColumnRenamed("node", "id")
    named = loose.join(parts, "id", "left")
    return named.withColumn("conversation", F.concat(F.lit("component/"), F.coalesce("component", "id"))).drop("component")


def rebuild_conversations(kept: DataFrame, quotes: DataFrame | None = None) -> DataFrame:
    """``session_id, component, conversation, msg_no, id, rec_uuid, role`` of the messages of all good conversations.

    ``kept`` holds deduplicated transcript rows with a unique row_id. A conversation is the messages of a
    session, or, of rows without one, those linked by replies and by ``quotes(u, v)`` between row ids
    (links to rows of a session do not count); its session_id is null then, and component its lowest row. It is good when its messages form one
    chain from exactly one first message and an assistant message that holds content directly follows every user message;
    others are dropped whole. A null rec_uuid can be no parent but can end a chain. Empty tables
    give no row; unknown roles and sidechain rows are passed over. Jobs run while the frame is being built.
    """
    scratch = Scratch(kept.sparkSession)
    # Every row is asked for by its replies as well as asking for its parent: it is deduplicated and read once.
    rows = scratch.cut(with_parent_id(scratch.cut(message_rows(kept), "plain")), "rows")
    scratch.release("plain")
    msgs = scratch.cut(pass_over(rows, scratch), "msgs")
    scratch.release("rows")
    scratch.release("jumps")
    loose = msgs.where(F.col("session").isNull())
    components = name_by_components(loose, quotes, scratch)
    every = msgs.where(F.col("session").isNotNull()).withColumn("conversation", F.concat(F.lit("session/"), F.col("session"))).unionByName(components)
    candidates = scratch.cut(every.join(promising(every), "conversation").select("conversation", "n", "id", "up", "uuid", "role"), "candidates")
    scratch.release("msgs")
    scratch.release("edges")
    numbered = number_small(candidates.where(F.col("n") <= SMALL))
    large = candidates.where(F.col("n") > SMALL)
    if not large.isEmpty():
        numbered = numbered.unionByName(number_large(large, scratch))
    after = lambda prefix: F.when(F.col("conversation").startswith(prefix), F.substring("conversation", len(prefix) + 1, 1 << 30))
    return numbered.select(
        after("session/").alias("session_id"), after("component/").cast("bigint").alias("component"), "conversation", "msg_no", "id",
        F.col("uuid").alias("rec_uuid"), "role",
    )
