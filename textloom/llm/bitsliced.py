"""Exact top-k search: a bit-sliced index over quantised vectors.

The index lies in files of up to BLOCK rows. An attribute of a block is stored as bitmaps, one for each bit of its quantised
value above the block's least one: bit r of slice j is bit j of row r. For a query the inner product of all rows at once
is a sum of slices, each shifted by a bit of the query's component (components below zero take the complements), added by
bitmap arithmetic: full adders over whole slices turn three bitmaps of a weight into one of it and one of the next. The
sum's slices then give the top rows from the most significant down: a bitmap of rows that are in for sure and one of rows that
are level so far. What is level at the end is the boundary, resolved exactly by score and vec_id.

Vectors with a component beyond LARGEST / scale, whose products could leave 64 bits, lie in files of their own and are compared in
Python's integers, as candidates and as queries. Ranks are exact; a score beyond 64 bits is given as the nearest number of 64 bits.

A block is a piece of work that loads it once and goes over all files of queries, a file at a time; where blocks are fewer than the cores can use, the
files are dealt among several pieces. The best k of each block meet by the query's row.

Vectors that are null or hold null or non-finite components take no part. Vectors are compared with those of their own length. Rows that share a vec_id are rows of
their own, as candidates and as queries, but none is a candidate of a query with its id. A null vec_id takes no part; an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.shared import file_system, lean, work_folder

BLOCK = 1 << 15
QUERIES = 512
LARGEST = 1 << 24
MANIFEST = "file string, rows long, width int"
#: What a number has to be less than in size to be a score, and an offset that makes any other one positive.
BEYOND, OFFSET = 1 << 63, 1 << 2200
FOUND = "query_row long, query_id long, vec_id long, score long, beyond int, wide binary"


def finite(vectors: pa.Array) -> list[np.ndarray | None]:
    """Each vector, None for those that take no part."""
    out: list[np.ndarray | None] = []
    for v in vectors:
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) if v.is_valid and not v.values.null_count and len(v.values) else None
        out.append(x if x is not None and np.isfinite(x).all() else None)
    return out


def whole_numbers(raw: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) in Python's integers, without rounding or overflow."""
    def one(x: float) -> int:
        above, below = x.as_integer_ratio()
        return scale * above // below

    return np.array([[one(x) for x in row] for row in raw.tolist()], object)


def sliced(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least value and bits of each column, and all slices, column by column from the lowest bit, rows in 64-bit words."""
    least = values.min(0)
    above = (values - least).astype(np.uint64)
    bits = np.array([int(m).bit_length() for m in above.max(0)])
    words = -(-len(values) // 64)
    planes = np.zeros((int(bits.sum()), words * 8), np.uint8)
    at = 0
    for column, n in enumerate(bits):
        for j in range(n):
            packed = np.packbits((above[:, column] >> np.uint64(j) & np.uint64(1)).astype(np.uint8), bitorder="little")
            planes[at, : len(packed)] = packed
            at += 1
    return least, bits, planes.view(np.uint64)


def added(planes: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """The slices of the sum of bitmaps; planes: those of each weight, as arrays of bitmaps."""
    out, weight = [], 0
    width = next(p for v in planes.values() for p in v).shape[1]
    while planes:
        stack = planes.pop(weight, [])
        now = np.concatenate(stack) if stack else np.zeros((0, width), np.uint64)
        carries = planes.setdefault(weight + 1, [])
        while len(now) > 2:
            n = len(now) // 3
            a, b, c = now[:n], now[n : 2 * n], now[2 * n : 3 * n]
            ab = a ^ b
            carries.append(a & b | ab & c)
            now = np.concatenate([ab ^ c, now[3 * n :]])
        if len(now) == 2:
            carries.append((now[0] & now[1])[None])
            now = (now[0] ^ now[1])[None]
        out.append(now[0] if len(now) else np.zeros(width, np.uint64))
        weight += 1
        if not planes[weight]:
            del planes[weight]
            if planes:  # weights without a bitmap between others
                planes[weight] = planes.get(weight, [])
    return out


def product_slices(query: np.ndarray, bits: np.ndarray, planes: np.ndarray) -> list[np.ndarray]:
    """Slices of the rows' inner products with the query, up to a constant."""
    starts = np.concatenate([[0], np.cumsum(bits)[:-1]])
    size, column = np.abs(query), np.repeat(np.arange(len(bits)), bits)
    place = np.arange(len(column)) - starts[column]
    flip = (query < 0)[column]
    parts: dict[int, list[np.ndarray]] = {}
    top = int(place.max(initial=-1)) + int(size.max(initial=0)).bit_length()
    weights = np.arange(int(size.max(initial=0)).bit_length())
    set_bits = (size[:, None] >> weights & 1).astype(bool)
    for w in range(top):
        pick = [np.flatnonzero((place == w - i) & set_bits[column, i]) for i in weights if 0 <= w - i]
        pick = np.concatenate(pick) if pick else np.empty(0, np.int64)
        if len(pick):
            chosen = planes[pick]
            chosen[flip[pick]] ^= np.uint64(0xFFFFFFFFFFFFFFFF)
            parts[w] = [chosen]
        else:
            parts[w] = []
    return added(parts) if any(parts.values()) else []


def top_rows(slices: list[np.ndarray], among: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the rows surely in the top k, and of those level on the boundary."""
    sure, level = np.zeros_like(among), among
    for s in reversed(slices):
        upper = sure | level & s
        n = int(np.bitwise_count(upper).sum())
        if n > k:
            level = level & s
        elif n < k:
            sure, level = upper, level & ~s
        else:
            return upper, np.zeros_like(among)
    return sure, level


def rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def search_block(block: dict[str, np.ndarray], query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """vec_ids and scores of the block's best k rows for the query, without its own."""
    n = len(block["ids"])
    among = np.zeros(block["planes"].shape[1] * 64, np.uint8)
    among[:n] = block["ids"] != query_id
    among = np.packbits(among, bitorder="little").view(np.uint64)
    sure, level = top_rows(product_slices(query, block["bits"], block["planes"]), among, k)
    rows = np.concatenate([rows_of(sure), rows_of(level)])
    ids, scores = block["ids"][rows], block["values"][rows].astype(np.int64) @ query
    best = np.lexsort((ids, -scores))[:k]
    return ids[best], scores[best]


def exact_best(ids: np.ndarray, values: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[list[int], list[int]]:
    """search_block for arrays of Python's integers."""
    best = sorted((-score, vec_id) for vec_id, score in zip(ids.tolist(), (values @ query).tolist(), strict=True) if vec_id != query_id)[:k]
    return [i for _, i in best], [-s for s, _ in best]


def write_blocks(vectors: DataFrame, folder: str, rows: int, slices: bool, scale: int) -> DataFrame:
    """vectors: vec_id, embedding. Writes files of up to `rows` vectors of one length, wide ones apart; returns their manifest, kept there too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = file_system(folder)
        held: dict[tuple[int, bool], tuple[list, list]] = {}

        def store(width: int, wide: bool) -> pa.RecordBatch:
            ids, values = held.pop((width, wide))
            block = {"ids": np.array(ids, np.int64), **({"raw": np.array(values)} if wide else {"values": np.array(values, np.int32)})}
            if slices and not wide:
                block["least"], block["bits"], block["planes"] = sliced(np.array(values, np.int64))
            name, data = f"{uuid.uuid4().hex}.npz", io.BytesIO()
            np.savez(data, **block)
            fs.create_dir(top, recursive=True)
            with fs.open_output_stream(f"{top}/{name}") as sink:
                sink.write(data.getbuffer())
            return pa.record_batch([pa.array([name]), pa.array([len(ids)], pa.int64()), pa.array([width], pa.int32())], ["file", "rows", "width"])

        for batch in batches:
            for vec_id, raw in zip(batch.column(0).to_pylist(), finite(batch.column(1)), strict=True):
                if vec_id is not None and raw is not None:
                    with np.errstate(over="ignore"):
                        values = np.floor(raw * scale)
                    wide = bool(np.abs(values).max() > LARGEST)
                    own = held.setdefault((len(raw), wide), ([], []))
                    own[0].append(vec_id)
                    own[1].append(raw if wide else values.astype(np.int32))
                    if len(own[0]) == rows:
                        yield store(len(raw), wide)
        for kind in list(held):
            yield store(*kind)

    vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(lean(run), MANIFEST).write.parquet(f"{folder}/manifest")
    return vectors.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def load_block(fs, path: str) -> dict[str, np.ndarray]:
    with fs.open_input_file(path) as source:
        return dict(np.load(io.BytesIO(source.read())))


def build_index(vectors: DataFrame, folder: str, scale: int = 256) -> DataFrame:
    """Index every row; no shuffle, small input partitions are read together so that blocks are full."""
    return write_blocks(vectors.coalesce(max(1, -(-vectors.count() // BLOCK))), folder, BLOCK, True, scale)


def search(spark: SparkSession, folder: str, queries: DataFrame, k: int, scale: int = 256) -> DataFrame:
    """The index's k best rows for each query (vec_id, embedding): query_id, rank, vec_id, score."""
    asked = work_folder(spark, "queries")
    groups = write_blocks(queries.coalesce(max(1, -(-queries.count() // QUERIES))), asked, QUERIES, False, scale)
    # One row for each file of queries; the cores bound the pieces beyond one a block.
    blocks = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    n_blocks = blocks.count()
    most = max(1, -(-2 * spark.sparkContext.defaultParallelism // max(1, n_blocks)))
    files = groups.select("file", "width", F.dense_rank().over(Window.orderBy("file")).alias("n"))
    dealt = files.groupBy("width", (F.col("n") % most).alias("piece")).agg(F.collect_list(F.struct("file", "n")).alias("asked"))
    work = blocks.select("file", "width").join(F.broadcast(dealt), "width").select("file", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = file_system(folder)
        fs_asked, top_asked = file_system(asked)
        for batch in batches:
            for name, asked_files in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block = load_block(fs, f"{top}/{name}")
                for x in asked_files:
                    yield found_in(block, load_block(fs_asked, f"{top_asked}/{x['file']}"), x["n"])

    def found_in(block: dict[str, np.ndarray], own: dict[str, np.ndarray], n: int) -> pa.RecordBatch:
        rows = [(n << 32) + at for at in range(len(own["ids"]))]
        if "raw" in block or "raw" in own:
            values, asking = (whole_numbers(x["raw"], scale) if "raw" in x else x["values"].astype(object) for x in (block, own))
            out = [(row, q, *exact_best(block["ids"], values, q, v, k)) for row, q, v in zip(rows, own["ids"].tolist(), asking, strict=True)]
        else:
            out = [(row, q, *(x.tolist() for x in search_block(block, q, v, k))) for row, q, v in zip(rows, own["ids"].tolist(), own["values"].astype(np.int64), strict=True)]
        lines = [(row, q, i, score, 0, None) if abs(score) < BEYOND else (row, q, i, BEYOND - 1 if score > 0 else 1 - BEYOND, 1 if score > 0 else -1, (OFFSET - score).to_bytes(300, "big")) for row, q, ids, scores in out for i, score in zip(ids, scores, strict=True)]
        kinds = (*(pa.int64(),) * 4, pa.int32(), pa.binary())
        return pa.record_batch([pa.array([x[c] for x in lines], kind) for c, kind in enumerate(kinds)], ["query_row", "query_id", "vec_id", "score", "beyond", "wide"])

    found = work.repartition(max(1, n_blocks * most)).mapInArrow(lean(run), FOUND)
    order = F.struct((-F.col("beyond")).alias("under"), (-F.col("score")).alias("down"), "wide", "vec_id")
    best = F.slice(F.array_sort(F.collect_list(order)), 1, k)
    ranked = found.groupBy("query_row", "query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("place", "b"))
    return ranked.select("query_id", (F.col("place") + 1).alias("rank"), "b.vec_id", (-F.col("b.down")).alias("score"))
