"""Token ids of whole texts by a public byte-level vocabulary, and back.

Texts go through the tokenizers library in Arrow batches. Byte-level vocabularies write
every byte as one printable character; the table between the two is built by rule and
reversed for decoding, so an id sequence gives back the exact bytes even where a token
boundary splits a character.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters of text handed to the library at once: bounds a worker's memory.
CHARS_AT_ONCE = 1 << 20


def tokenizer_path(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    """Path of a public tokenizer file, in ``folder`` or where the machine keeps them."""
    if folder:
        return os.path.join(folder, name)
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


_loaded: dict = {}
_sent: set[tuple[str, str]] = set()


def send(df: DataFrame, path: str) -> str:
    """Send a tokenizer file to the executors, once per application, and return its path."""
    context = df.sparkSession.sparkContext
    if (context.applicationId, path) not in _sent:
        context.addFile(path)
        _sent.add((context.applicationId, path))
    return path


def load(path: str):
    """The tokenizer of a file, once per worker process; its special strings are ordinary text.

    Where the machine has no such file, the copy that :func:`send` sent is read.
    """
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from pyspark import SparkFiles
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
        tokenizer.encode_special_tokens = True
        _loaded[path] = tokenizer
    return _loaded[path]


def grouped(texts: list[str | None]) -> Iterator[list[str]]:
    """Texts in order, null as empty, in groups of about CHARS_AT_ONCE characters."""
    group, size = [], 0
    for t in texts:
        group.append(t or "")
        size += len(group[-1])
        if size >= CHARS_AT_ONCE:
            yield group
            group, size = [], 0
    if group:
        yield group


def encoded_once(texts: list[str | None], path: str, take: Callable) -> Iterator[list]:
    """``take`` of the encoding of each text by group, without special tokens; copies of a text in a group are encoded once."""
    tokenizer = load(path)
    for group in grouped(texts):
        distinct = list(dict.fromkeys(group))
        found = dict(zip(distinct, map(take, tokenizer.encode_batch_fast(distinct, add_special_tokens=False)), strict=True))
        yield [found[t] for t in group]


def id_lists(texts: list[str | None], path: str) -> Iterator[list[list[int]]]:
    """Token ids of each text by group; empty for an empty and for a null text."""
    return encoded_once(texts, path, lambda encoded: encoded.ids)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids`` of every row; a null and an empty text have an empty list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for lists in id_lists(batch.column(1).to_pylist(), path):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(lists)), pa.array(lists, pa.list_(pa.int32()))], names=[key, "ids"])
                at += len(lists)

    path = send(docs, path)
    return docs.select(key, text).mapInArrow(run, f"`{key}` bigint, ids array<int>")


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens`` of every row, without keeping the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [n for group in encoded_once(batch.column(1).to_pylist(), path, len) for n in group]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=[key, "n_tokens"])

    path = send(docs, path)
    return docs.select(key, text).mapInArrow(run, f"`{key}` bigint, n_tokens bigint")


def token_offsets(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, pos, id, char_from, char_to``: the half-open code points each token touches.

    Tokens that share a split character name the same code point. Empty and null texts give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokenizer = load(path)
            keys, row = batch.column(0).to_pylist(), 0
            for group in grouped(batch.column(1).to_pylist()):
                cols: list[list] = [[], [], [], [], []]
                for encoded in tokenizer.encode_batch(group, add_special_tokens=False):
                    n = len(encoded.ids)
                    cols[0] += [keys[row]] * n
                    cols[1] += range(n)
                    cols[2] += encoded.ids
                    cols[3] += [a for a, _ in encoded.offsets]
                    cols[4] += [b for _, b in encoded.offsets]
                    row += 1
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[key, "pos", "id", "char_from", "char_to"]
                )

    path = send(docs, path)
    return docs.select(key, text).mapInArrow(run, f"`{key}` bigint, pos int, id int, char_from int, char_to int")


def byte_of_char() -> dict[str, int]:
    """The reversed byte table: printable Latin-1 stands for itself, other bytes follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, text`` from id lists. Bytes that form no character become U+FFFD; a null list gives null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, tokenizer = byte_of_char(), load(path)
        pieces: dict[int, bytes] = {}

        def piece(i: int) -> bytes:
            if i not in pieces:
                pieces[i] = bytes(table[c] for c in tokenizer.id_to_token(i))
            return pieces[i]

        for batch in batches:
            texts = [
                None if x is None else b"".join(map(piece, x)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    path = send(encoded, path)
    return encoded.select(key, ids).mapInArrow(run, f"`{key}` bigint, text string")
