"""Queries of the text problems (p1, p8, p9, p10) and their SQL."""

from __future__ import annotations

__all__ = ["QUERIES", "SQL"]

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.conversations import rebuild_conversations
from tidemark.llm.encode import decode, encode, token_counts, token_offsets, tokenizer_path
from tidemark.llm.lookalike import consistent_text, look_alike_pairs, text_classes
from tidemark.llm.packing import pack, packing_faults, step_balance
from tidemark.llm.sql import SQL
from tidemark.operators.copies import kept_rows, transcript_key
from tidemark.tables import table


def conversations(spark: SparkSession, d: str) -> DataFrame:
    """All good conversations of the kept transcript rows."""
    rows = table(spark, d, "transcripts").select(
        "row_id", "session_id", "rec_uuid", "parent_uuid", "rec_type", "msg_role", "is_sidechain", "content_json"
    )
    return rebuild_conversations(kept_rows(rows, transcript_key(), F.col("row_id")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Messages of the good conversations of a session, numbered from 1."""
    return conversations(spark, d).where(F.col("session_id").isNotNull()).select("session_id", "msg_no", "rec_uuid")


def p1_conversations(spark: SparkSession, d: str) -> DataFrame:
    """All good conversations, also those of rows without a session: name, first and last message and size."""
    found = conversations(spark, d)
    ends = [F.min_by("id", "msg_no").alias("first_row"), F.max_by("id", "msg_no").alias("last_row")]
    return found.groupBy("conversation").agg(F.count(F.lit(1)).alias("n_messages"), F.count_if(F.col("role") == "user").alias("n_prompts"), *ends)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode(table(spark, d, "documents"), tokenizer_path())


def p8_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Every token of every document with the code points it touches."""
    return token_offsets(table(spark, d, "documents"), tokenizer_path())


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """Per document with tokens: the code points its tokens cover, and how many tokens leave a gap before them (none)."""
    tokens = token_offsets(table(spark, d, "documents"), tokenizer_path())
    # Tokens of one document come in one batch and in order, so a gap shows against the token before in it.
    before = F.lag("char_to", 1, 0).over(Window.partitionBy("doc_id").orderBy("pos"))
    gaps = tokens.withColumn("gap", F.col("char_from") > before)
    return gaps.groupBy("doc_id").agg(
        F.min("char_from").alias("first_char"), F.max("char_to").alias("last_char"), F.count_if("gap").cast("int").alias("breaks")
    )


def p8_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text of every document as it comes back from its ids; empty for a null text."""
    return decode(encode(table(spark, d, "documents"), tokenizer_path()), tokenizer_path())


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose decoded ids are not their text: none."""
    back = p8_texts(spark, d).withColumnRenamed("text", "back")
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.join(back, "doc_id").where(F.coalesce("text", F.lit("")) != F.col("back")).select("doc_id", "text", "back")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every document with its container and step group."""
    return pack(token_counts(table(spark, d, "documents"), tokenizer_path()))


def p9_steps(spark: SparkSession, d: str) -> DataFrame:
    """Containers, pieces and tokens of every step group."""
    return step_balance(p9_containers(spark, d))


def p9_audit(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the packing: documents placed, and how many containers, windows and pieces break a rule (none)."""
    return packing_faults(p9_containers(spark, d), token_counts(table(spark, d, "documents"), tokenizer_path()))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that look the same but differ in characters."""
    return look_alike_pairs(table(spark, d, "documents"))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """Class and text of every document with something to see."""
    return text_classes(table(spark, d, "documents"))


def p10_text(spark: SparkSession, d: str) -> DataFrame:
    """The one form of every text for comparisons, and a form to read."""
    return consistent_text(table(spark, d, "documents")).select("doc_id", "consistent", "readable")


def p10_keys(spark: SparkSession, d: str) -> DataFrame:
    """The one form of every text for comparisons."""
    return consistent_text(table(spark, d, "documents"), readable=False).select("doc_id", "consistent")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_conversations, p8_ids, p8_offsets, p8_spans, p8_texts, p8_round_trip, p9_containers, p9_steps, p9_audit, p10_found, p10_classes, p10_keys, p10_text,
    )
}
