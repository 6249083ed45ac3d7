"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

Texts of the same words are one class from the start; only one of each, its smallest doc_id, enters the bands. Band and
row counts follow from the threshold and the recall asked for. Texts that share a band's hash are a bucket, and all pairs
of a bucket are compared, whatever its size; a pair of several common buckets is compared in the first of them. A bucket of up to
SMALL texts gives its pairs by a join. A larger one is dealt into parts of some PART texts by a hash. Each part is compared
within, by products of matrices; if it isn't the only one, its n-gram sets are written to a file, and the files of a bucket
are compared two by two, a task holding two of them. So what is shuffled, written and returned is in proportion to a bucket's texts, while
comparisons grow with the square of a group of texts that are all alike, for each link counts.

Null texts and those without words are alone in their class. A text of fewer words than the n-gram is one n-gram. Rows that
share an id are one document, in the class of either text. Rows whose id is null are documents of their own:
each has a row with a null class_id and no links, and first_of_class keeps them all. An empty table gives no row. Other columns are ignored.
Words are told apart by CRC-32: a word counts as another one with a probability of 2 ** -32.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections import Counter
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.components import components
from textloom.llm.shared import BROADCAST_KEYS, drop_folder, file_system, held, lean, only_keys, texts_of, words_of, work_folder, written
from textloom.llm.shingles import hashed, jaccard, mixed, ngrams

SMALL = 32
#: Texts in a part of a larger bucket, n-grams in a matrix, files that one file meets in a piece of work.
PART, COLUMNS, MET = 512, 1 << 12, 32
FOUND = "a long, b long, n long, bucket long, part int, file string"
#: Texts whose links a task counts before it passes them on.
COUNTED = 1 << 18


def bands_for(threshold: float, recall: float, most: int = 96) -> tuple[int, int]:
    """Bands and rows: the most rows, so the fewest false candidates, whose bands stay within `most` hashes."""
    fits = [(bands_of(threshold, recall, rows), rows) for rows in range(1, 33)]
    return max((x for x in fits if x[0] * x[1] <= most), key=lambda x: x[1], default=fits[0])


def bands_of(threshold: float, recall: float, rows: int) -> int:
    """How many bands of `rows` rows find a pair at the threshold with the recall asked for."""
    return ceil(log(1 - recall) / log(1 - threshold**rows)) if threshold < 1 else 1


def factors_for(bands: int, rows: int) -> np.ndarray:
    """Odd numbers."""
    return np.random.Generator(np.random.PCG64(0)).integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)


def least_hashes(grams: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least value of each hash function x * factor over the grams, whose bits are spread already."""
    step = max(1, (1 << 18) // len(factors))
    return np.min([(grams[at : at + step, None] * factors).min(0) for at in range(0, len(grams), step)], axis=0)


def banded(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A number for each band and its rows."""
    least, out = least.reshape(bands, rows), np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        out = mixed(out + least[:, k])
    return out.view(np.int64)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, key (of the words; null without words), words (their hashes), bands (a number for each band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = factors_for(bands, rows)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                out: tuple[list, list, list] = ([], [], [])
                for text in texts_of(batch.column(1)):
                    spelt = words_of(text)
                    words = hashed(spelt)
                    out[0].append(hashlib.blake2b(b" ".join(spelt), digest_size=16).digest() if spelt else None)
                    out[1].append(words.tobytes())
                    out[2].append(banded(least_hashes(np.unique(ngrams(words, n)), factors), bands, rows) if spelt else [])
                yield pa.record_batch([batch.column(0), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.list_(pa.int64()))], ["doc_id", "key", "words", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, key binary, words binary, bands array<long>")


def verified(pairs: DataFrame, words: DataFrame, n: int, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) whose n-gram sets are similar enough, with jaccard; pairs is a checkpoint or a table, words: id, words.

    Both texts of a pair meet by the pair, not by a text, so a text of many pairs is no hot key.
    """
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("id"))
    few = pairs.count() <= BROADCAST_KEYS // 8  # two rows of three numbers a pair
    met = words.join(F.broadcast(sides) if few else sides, "id").groupBy("a", "b").agg(F.collect_set(F.struct("id", "words")).alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for a, b, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                # an id whose rows differ has several texts; the most similar ones count
                sets = [(t["id"].as_py(), np.unique(ngrams(np.frombuffer(t["words"].as_buffer(), "<u4"), n))) for t in texts]
                best = max((similar(x, y, threshold) for i, x in sets if i == a for k, y in sets if k == b), default=0.0)
                if best >= threshold:
                    for column, value in zip(out, (a, b, best), strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["a", "b", "jaccard"])

    return met.mapInArrow(lean(run), "a long, b long, jaccard double")


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """The Jaccard similarity, or 0 where the sizes rule out the threshold."""
    return jaccard(a, b) if min(len(a), len(b)) >= threshold * max(len(a), len(b)) else 0.0


class Part:
    """Texts of a bucket: ids, bands (a row each), and their n-gram sets, end to end with the size of each."""

    def __init__(self, ids: np.ndarray, bands: np.ndarray, sizes: np.ndarray, grams: np.ndarray):
        self.ids, self.bands, self.sizes, self.grams = ids, bands, sizes, grams

    @classmethod
    def of(cls, rows: list[tuple], n: int) -> Part:
        """rows: id, bands, words (hashes)."""
        sets = [np.unique(ngrams(np.frombuffer(r[2], "<u4"), n)) for r in rows]
        return cls(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.array([len(x) for x in sets]), np.concatenate(sets))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, bands=self.bands, sizes=self.sizes, grams=self.grams)
        return out.getvalue()

    @classmethod
    def read(cls, fs, path: str, size: int) -> Part:
        with fs.open_input_file(path) as source:
            data = np.load(io.BytesIO(pa.decompress(source.read(), size, "zstd", asbytes=True)))
        return cls(*(data[k] for k in ("ids", "bands", "sizes", "grams")))


def common(left: Part, right: Part) -> np.ndarray:
    """How many n-grams each text of the left has in common with each other one of the right."""
    if left is right:
        values, counts = np.unique(left.grams, return_counts=True)
        shared = values[counts > 1]
    else:
        shared = np.intersect1d(left.grams, right.grams)
    out = np.zeros((len(left.ids), len(right.ids)), np.int64)
    if not len(shared):
        return out
    places = []
    for part in (left, right):
        at = np.minimum(np.searchsorted(shared, part.grams), len(shared) - 1)
        has = shared[at] == part.grams
        places.append((np.repeat(np.arange(len(part.ids)), part.sizes)[has], at[has]))
    for at in range(0, len(shared), COLUMNS):
        sides = []
        for part, (row, column) in zip((left, right), places, strict=True):
            here = (column >= at) & (column < at + COLUMNS)
            matrix = np.zeros((len(part.ids), min(COLUMNS, len(shared) - at)), np.float32)
            matrix[row[here], column[here] - at] = 1
            sides.append(matrix)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def links_between(left: Part, right: Part, bucket: int, threshold: float) -> np.ndarray:
    """Which texts of two parts (or of one, given twice: each pair once) are similar enough and have no earlier bucket in common."""
    todo = left.ids[:, None] != right.ids[None, :]
    if left is right:
        todo &= np.tri(len(left.ids), k=-1, dtype=bool)
    for band in range(int(np.flatnonzero(left.bands[0] == bucket)[0])):
        todo &= left.bands[:, None, band] != right.bands[None, :, band]
    least, most = (f(left.sizes[:, None], right.sizes[None, :]) for f in (np.minimum, np.maximum))
    todo &= least >= threshold * most
    if not todo.any():
        return todo
    both = common(left, right)
    return todo & (both / (left.sizes[:, None] + right.sizes[None, :] - both) >= threshold)


class Links:
    """Counts the links of each text, and keeps those that lead wherever all of them lead."""

    def __init__(self):
        self.counts: Counter[int] = Counter()
        self.over: dict[int, int] = {}  # a text to a smaller one of its component

    def _top(self, x: int) -> int:
        while (up := self.over.get(x, x)) != x:
            self.over[x] = self.over.get(up, up)
            x = up
        return x

    def add(self, left: Part, right: Part, linked: np.ndarray) -> None:
        for part, n in ((left, linked.sum(1)), (right, linked.sum(0))):
            for k in np.flatnonzero(n).tolist():
                self.counts[int(part.ids[k])] += int(n[k])
        whole = linked | linked.T if left is right else np.block([[np.zeros((len(left.ids),) * 2, bool), linked], [linked.T, np.zeros((len(right.ids),) * 2, bool)]])
        nodes = left.ids if left is right else np.concatenate([left.ids, right.ids])
        for x, y in forest(whole):
            a, b = self._top(int(nodes[x])), self._top(int(nodes[y]))
            if a != b:
                self.over[max(a, b)] = min(a, b)

    def rows(self) -> list[tuple]:
        """a, null, the number of its links; a, b, 0 for a link that keeps a component together."""
        return [(a, None, n) for a, n in self.counts.items()] + [(b, a, 0) for a, b in self.over.items()]


def found_batch(links: list[tuple], files: list[tuple] = ()) -> pa.RecordBatch:
    rows = [(*x, None, None, None) for x in links] + [(None, None, size, bucket, part, name) for bucket, part, name, size in files]
    kinds = (*(pa.int64(),) * 4, pa.int32(), pa.string())
    return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["a", "b", "n", "bucket", "part", "file"])


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """The links of a spanning tree of each component."""
    out, seen = [], ~linked.any(1)
    for start in range(len(linked)):
        todo = [] if seen[start] else [start]
        seen[start] = True
        while todo:
            x = todo.pop()
            new = np.flatnonzero(linked[x] & ~seen).tolist()
            seen[new] = True
            out += [(x, y) for y in new]
            todo += new
    return out


def within_parts(many: DataFrame, texts: DataFrame, words: DataFrame, n: int, threshold: float, folder: str) -> DataFrame:
    """The links within the parts of large buckets (see Links.rows), and a row for each file of a part that isn't its bucket's only one.

    many: bucket, n (its size), id, key; texts: id, key, bands; words: id, key, words.
    """
    parts = F.ceil(F.col("n") / PART).cast("int")
    dealt = many.select("bucket", "id", "key", parts.alias("parts"), F.pmod(F.xxhash64("id", "key"), parts).cast("int").alias("part"))
    wanted = many.select("id").distinct().checkpoint()
    content = only_keys(texts, wanted, "id").join(only_keys(words, wanted, "id").dropDuplicates(["id", "key"]), ["id", "key"]).checkpoint()
    place = ["bucket", "part"]
    loaded = dealt.join(content, ["id", "key"]).select(*place, "parts", "id", "bands", "words").repartition(*place).sortWithinPartitions(*place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = file_system(folder)

        def out(bucket: int, number: int, parts: int) -> pa.RecordBatch:
            part, links, files = Part.of(rows, n), Links(), []
            links.add(part, part, links_between(part, part, bucket, threshold))
            if parts > 1:
                name, data = f"{uuid.uuid4().hex}.part", part.to_bytes()
                fs.create_dir(top, recursive=True)
                with fs.open_output_stream(f"{top}/{name}") as sink:
                    sink.write(pa.compress(data, "zstd", asbytes=True))
                files.append((bucket, number, name, len(data)))
            return found_batch(links.rows(), files)

        now, rows = None, []
        for batch in batches:
            for at, row in zip(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True), zip(*(batch.column(k).to_pylist() for k in range(3, 6)), strict=True), strict=True):
                if at != now:
                    if rows:
                        yield out(*now)
                    now, rows = at, []
                rows.append(row)
        if rows:
            yield out(*now)

    return loaded.mapInArrow(lean(run), FOUND)


def between_parts(files: DataFrame, threshold: float, folder: str) -> DataFrame:
    """The links between the parts of a bucket (see Links.rows). Files stand in a ring, and each meets the next half of it."""
    listed = files.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("part", "file", "n"))).alias("ring"))  # a row a file
    size = F.size("ring")
    each = listed.select("bucket", "ring", size.alias("size"), F.explode(F.sequence(F.lit(0), size - 1)).alias("i"))
    half = F.floor((F.col("size") - 1) / 2) + F.when((F.col("size") % 2 == 0) & (F.col("i") < F.col("size") / 2), 1).otherwise(0)
    at = lambda k: F.get("ring", ((F.col("i") + k) % F.col("size")).cast("int"))
    met = each.where(half > 0).select("bucket", at(F.lit(0)).alias("own"), F.explode(F.sequence(F.lit(1), half.cast("int"), F.lit(MET))).alias("from"), half.cast("int").alias("half"), "ring", "i", "size")
    work = met.select("bucket", "own", F.transform(F.sequence("from", F.least("half", F.col("from") + MET - 1)), at).alias("others"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = file_system(folder)
        links = Links()
        for batch in batches:
            for bucket, own, others in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                left = Part.read(fs, f"{top}/{own['file']}", own["n"])
                for other in others:
                    right = Part.read(fs, f"{top}/{other['file']}", other["n"])
                    links.add(left, right, links_between(left, right, bucket, threshold))
                    if len(links.counts) >= COUNTED:
                        yield found_batch(links.rows())
                        links = Links()
        yield found_batch(links.rows())

    return work.repartition(F.xxhash64("bucket", F.col("own.part"))).mapInArrow(lean(run), FOUND)


def links_of(texts: DataFrame, words: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """id, n_links of the texts with verified links, and links a < b that lead wherever all of them lead.

    texts: id, key, bands; words: id, key, words. A pair counts in its first common bucket.
    Sizes are a checkpoint: joins of plain shuffles are those that Spark can split where a bucket has too many rows.
    """
    split = texts.select("id", "key", F.explode("bands").alias("bucket"))
    sizes = split.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").checkpoint()
    members = held(split.join(sizes, "bucket"))
    few, many = members.where(F.col("n") <= SMALL).join(texts, ["id", "key"]), members.where(F.col("n") > SMALL)
    own, other = (few.select("bucket", F.col("id").alias(x), F.col("bands").alias(f"bands_{x}")) for x in "ab")
    first = F.array_position(F.zip_with("bands_a", "bands_b", lambda x, y: x == y), True) == F.array_position("bands_a", F.col("bucket"))
    pairs = own.join(other, "bucket").where("a < b").where(first).select("a", "b").distinct().checkpoint()
    found = verified(pairs, words.select("id", "words"), n, threshold).select("a", "b").checkpoint()
    ends = found.select(F.explode(F.array("a", "b")).alias("id"), F.lit(1).cast("long").alias("n"))
    if not many.isEmpty():
        folder = work_folder(texts.sparkSession, "parts")
        inner = within_parts(many, texts, words, n, threshold, folder).checkpoint()
        outer = between_parts(inner.where("file IS NOT NULL").select("bucket", "part", "file", "n"), threshold, folder).checkpoint()
        drop_folder(texts.sparkSession, folder)
        large = inner.unionByName(outer).where("file IS NULL")
        ends = ends.unionByName(large.where("b IS NULL").select(F.col("a").alias("id"), "n"))
        found = found.unionByName(large.where("b IS NOT NULL").select("a", "b"))
    members.unpersist()
    return ends.groupBy("id").agg(F.sum("n").alias("n_links")), found


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """A row for each document: doc_id, class_id (the smallest doc_id that links lead to), n_links (of its text)."""
    bands, rows = bands_for(threshold, recall)
    signed, signed_folder = written(signatures(docs, n, bands, rows), "signatures")
    named = signed.where("doc_id IS NOT NULL")
    texts, texts_folder = written(named.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("id"), F.min("bands").alias("bands")), "texts")
    ends, links = links_of(texts, named.where("key IS NOT NULL").select(F.col("doc_id").alias("id"), "key", "words"), n, threshold)
    labels = components(links).withColumnRenamed("node", "id")
    classes = texts.select("key", "id").join(ends, "id", "left").join(labels, "id", "left").select("key", F.coalesce("label", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rows_of = named.select("doc_id", "key").join(classes, "key", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    nameless = signed.where("doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    found, _ = written(rows_of.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links")).unionByName(nameless), "classes")
    for folder in (signed_folder, texts_folder):  # what was made of them is written
        drop_folder(docs.sparkSession, folder)
    return found


def first_of_class(docs: DataFrame, **options) -> DataFrame:
    """The documents without those that have a smaller doc_id in their class; those without a doc_id stay."""
    firsts = near_duplicates(docs, **options).where("doc_id = class_id").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(firsts, docs["doc_id"] == firsts["kept_id"], "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))
