"""Token-ID / binary output: fixed-width bit packing in files with block offsets.

A file: the magic, blocks of packed ids, a footer, the footer's length in eight bytes, the magic. Each id takes the fewest
bits that hold every id of the vocabulary, lowest bit first. A block holds BLOCK ids (the last one fewer) and starts on a
byte, so numpy unpacks it alone. The footer has JSON (bits, ids, documents, block), a byte for each document that has an
id, the documents' ids, their first tokens within the file, and the blocks' places.

Documents are dealt by ranges of their id and sorted, so files in order of their number hold them in ascending order;
null ids come first. Null or empty texts are the end id alone. Repeated ids stay rows of their own. An empty table makes
no file with documents. A retried task writes a file of another name; only the names in the manifest count.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.shared import file_system, lean
from textloom.llm.tokens import encoder, vocabulary_size

MAGIC = b"TLIDS001"
BLOCK = 1 << 14
MANIFEST = "part long, file string, documents long, tokens long"
READ = "doc_id long, start long, n_tokens long, ids binary"
BATCH_BYTES = 4 << 20


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def packed(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype("<u4")[:, None] >> np.arange(bits, dtype="<u4") & 1).astype(np.uint8)
    return np.packbits(planes.ravel(), bitorder="little").tobytes()


def unpacked(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype("<u4")
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (planes.astype("<u4") << np.arange(bits, dtype="<u4")).sum(1, dtype="<u4")


class Writer:
    """Writes one file; holds a block of ids and two numbers a document."""

    def __init__(self, sink, bits: int):
        self.sink, self.bits = sink, bits
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.tokens = 0
        self.docs: list[int | None] = []
        self.starts: list[int] = []
        self.places = [len(MAGIC)]
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.tokens)
        self.tokens += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK:
            self._flush(self.n_waiting // BLOCK * BLOCK)

    def _flush(self, count: int) -> None:
        ids = np.concatenate(self.waiting)
        for at in range(0, count, BLOCK):
            data = packed(ids[at : min(at + BLOCK, count)], self.bits)
            self.sink.write(data)
            self.places.append(self.places[-1] + len(data))
        self.waiting, self.n_waiting = [ids[count:]], len(ids) - count

    def close(self) -> None:
        if self.n_waiting:
            self._flush(self.n_waiting)
        head = json.dumps({"bits": self.bits, "ids": self.tokens, "documents": len(self.docs), "block": BLOCK}).encode()
        footer = struct.pack("<I", len(head)) + head + bytes(d is not None for d in self.docs)
        footer += np.array([d or 0 for d in self.docs], "<i8").tobytes() + np.array(self.starts, "<i8").tobytes() + np.array(self.places, "<i8").tobytes()
        self.sink.write(footer + struct.pack("<Q", len(footer)) + MAGIC)


class Reader:
    """Random access to one file's documents, and all of them in order."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - 16)
        length, magic = struct.unpack("<Q8s", source.read(16))
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(end - 16 - length)
        footer = source.read(length)
        n = struct.unpack_from("<I", footer)[0]
        head = json.loads(footer[4 : 4 + n])
        self.bits, self.tokens, n_docs = head["bits"], head["ids"], head["documents"]
        self.block = head["block"]
        at = 4 + n
        has = footer[at : at + n_docs]
        ids, self.starts, self.places = (np.frombuffer(footer, "<i8", c, a) for c, a in ((n_docs, at + n_docs), (n_docs, at + 9 * n_docs), (-1, at + 17 * n_docs)))
        self.docs = [int(d) if h else None for d, h in zip(ids, has, strict=True)]
        self.held: tuple[int, np.ndarray] | None = None

    def _block(self, k: int) -> np.ndarray:
        if self.held is None or self.held[0] != k:
            self.source.seek(int(self.places[k]))
            data = self.source.read(int(self.places[k + 1] - self.places[k]))
            self.held = k, unpacked(data, min(self.block, self.tokens - k * self.block), self.bits)
        return self.held[1]

    def ids(self, start: int, end: int) -> np.ndarray:
        """The file's ids from start to end; reads only their blocks."""
        parts = [self._block(k)[max(0, start - k * self.block) : end - k * self.block] for k in range(start // self.block, -(-end // self.block))] if end > start else []
        return np.concatenate(parts) if parts else np.empty(0, "<u4")

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]) if k + 1 < len(self.starts) else self.tokens)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Write the documents' ids under `folder`; returns the manifest, a row for each file, which is kept there too."""
    bits = bits_for(vocabulary_size(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], enc.dtype)
        fs, top = file_system(folder)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.ids"
        writer = sink = None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    fs.create_dir(top, recursive=True)
                    sink = fs.open_output_stream(f"{top}/{name}")
                    writer = Writer(sink, bits)
                writer.add(doc_id, np.concatenate([enc.encode(text.as_py()), end]))
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.record_batch([pa.array([x]) for x in (part, name, len(writer.docs), writer.tokens)], ["part", "file", "documents", "tokens"])

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = ("doc_id", F.xxhash64("text"))  # rows of one id, or of none, can lie in several files
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(lean(run), MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the files in the manifest: doc_id, start (in all files), n_tokens, ids (little-endian uint32)."""
    files, at = [], 0
    for part, name, tokens in sorted(spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("part", "file", "tokens").collect()):  # a row a file
        files.append((part, name, at))
        at += tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = file_system(folder)
        for batch in batches:
            for name, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                with fs.open_input_file(f"{top}/{name}") as source:
                    reader, rows, size = Reader(source), [], 0
                    for k, doc_id in enumerate(reader.docs):
                        ids = reader.document(k)
                        rows.append((doc_id, base + int(reader.starts[k]), len(ids), ids.tobytes()))
                        size += ids.nbytes
                        if size >= BATCH_BYTES:
                            yield _batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows)

    listed = spark.createDataFrame(files, "part long, file string, base long")
    return listed.repartition(max(1, len(files))).mapInArrow(lean(run), READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids"])
