"""Packing: concatenate all documents' tokens and cut them into fixed windows.

Two passes. The first tokenizes each input partition and writes its ids with their place in that partition; the sum of
each partition's tokens, one number a partition, then gives every partition its place in the one long stream. The second
reads the ids and cuts each document where the stream crosses a multiple of the window.

Null or empty texts are the end id alone; repeated rows are packed each for itself; an empty table gives no row; columns
other than the id and the text are ignored. A null id is carried through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.shared import kept, lean
from textloom.llm.tokens import encoder, vocabulary_size

TOKENS = "part long, doc_id long, local_start long, ids binary"
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Rows of a batch are passed on when their ids reach so many bytes.
BATCH_BYTES = 4 << 20


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Each document's ids as little-endian uint32 or uint16 with the end id, and their place in the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, at, part = encoder(tokenizer), 0, TaskContext.get().partitionId()
        end = np.array([end_id], enc.dtype).tobytes()
        rows: tuple[list, list, list] = ([], [], [])
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(text.as_py()).tobytes() + end
                for column, value in zip(rows, (doc_id, at, ids), strict=True):
                    column.append(value)
                at += len(ids) // len(end)
                size += len(ids)
                if size >= BATCH_BYTES:
                    yield _token_batch(part, rows)
                    rows, size = ([], [], []), 0
        if rows[0]:
            yield _token_batch(part, rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), TOKENS)


def _token_batch(part: int, rows: tuple[list, list, list]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([part] * len(rows[0]), pa.int64()), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())], ["part", "doc_id", "local_start", "ids"])


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = 1024) -> DataFrame:
    """One row a piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32)."""
    width = 2 if vocabulary_size(tokenizer) <= 1 << 16 else 4
    stream = kept(tokenized(docs, tokenizer, end_id), "packing")
    # One row for each partition of the input, however large that is.
    totals = sorted(stream.groupBy("part").agg(F.sum(F.octet_length("ids") / width).cast("long")).collect())
    bases, at = [], 0
    for part, total in totals:
        bases.append((part, at))
        at += total
    spark = docs.sparkSession
    placed = stream.join(F.broadcast(spark.createDataFrame(bases, "part long, base long")), "part")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for batch in batches:
            for doc_id, at, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = np.frombuffer(raw.as_py(), f"<u{width}").astype("<u4")
                marks = [at, *range((at // window + 1) * window, at + len(ids), window), at + len(ids)]
                out += [(doc_id, a - at, b - a, len(ids), a // window, a % window, ids[a - at : b - at].tobytes()) for a, b in zip(marks, marks[1:], strict=False)]
                size += ids.nbytes
                if size >= BATCH_BYTES:
                    yield _piece_batch(out)
                    out, size = [], 0
        if out:
            yield _piece_batch(out)

    return placed.select("doc_id", (F.col("base") + F.col("local_start")).alias("at"), "ids").mapInArrow(lean(cut), PIECES)


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def with_crc(pieces: DataFrame) -> DataFrame:
    """Each piece's unsigned CRC-32 of its ids instead of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
