"""Substring dedup: passages of at least `least` words that an earlier document has as well, found by compact windows.

A text is its word 5-grams. A hash function's Cartesian tree has a node for each range in which one value is the least; the nodes
as long as a passage are the compact windows, here read off as runs of equal sliding minima. The windows of the ROWS
functions of a band are joined by interval: where they overlap by a passage, their least values together are the signature
of every passage in the overlap. Two passages of Jaccard similarity s have a signature in common with probability
1 - (1 - s ** ROWS) ** BANDS for each place where a passage fits: 0.95 for a single one at 0.8, more for longer passages.

Overlaps of one signature are a group, whose members are joined with the smallest doc_id alone and verified on all words: runs
of words that both have, or that differ by so little that the 5-gram sets have a similarity of the threshold. What
this doesn't explain is looked at again. Members whose signature leads to nothing the smallest document has meet one another:
each pair in a group of up to FEW such members by a join. A larger group is dealt into parts; every two parts meet in one piece of
work, which counts the grams that each two of their overlaps have in common and compares all those that have enough for a passage. And where a group's
members have passages that the smallest document hasn't word for word, they are grouped by these whole passages; equal keys
are equal passages there, so the smallest document verifies all, and exact passages are found without exception.

Null or empty texts, and those shorter than a passage, have no repeats. Repeats within one document, or in rows
that share an id, don't count. Rows whose id is null have no place in the order: they neither have repeats nor are they any
document's, and without_repeats keeps them whole. An empty table gives no row. Other columns are ignored. Words are told apart by
CRC-32, so two passages that differ are taken for equal with a probability of some 2 ** -32 for each word that differs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.shared import FOLD, drop_folder, drop_shuffles, lean, only_keys, texts_of, words_of, written
from textloom.llm.shingles import hashed, jaccard, mixed, ngrams

N = 5
BANDS, ROWS = 3, 2
#: Members of a group that its smallest document doesn't explain and that are paired with one another.
FEW = 16
#: Overlaps of a larger group that are one part of it, and grams of two parts that are counted at once.
PART, COLUMNS = 1024, 1 << 12
#: Grams that a passage may miss between two it has: what one changed word and its neighbour take.
GAP = 10
#: Places of a text that are hashed at once.
CHUNK = 1 << 16
SPANS = "doc_id long, ref_doc_id long, start_word int, end_word int, ref_start_word int, ref_end_word int"


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The least value in each range of `width` along the last axis."""
    length = 1
    size = values.shape[-1] - width + 1
    while 2 * length <= width:
        values, length = np.minimum(values[..., :-length], values[..., length:]), 2 * length
    return np.minimum(values[..., :size], values[..., width - length : width - length + size])


@cache
def functions_of(level: int) -> np.ndarray:
    """Odd factors, one for each hash function of a level, which is a product with the low half of a gram's number."""
    return np.random.Generator(np.random.PCG64(level)).integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)


def overlaps(grams: np.ndarray, width: int, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signature, first and end of the starts of passages, for each overlap of a band's compact windows of at least `width` grams."""
    return overlaps_of([grams], width, level)[0]


def overlaps_of(texts: list[np.ndarray], width: int, level: int = 0) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The overlaps of each text, made for all of them end to end."""
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    grams, factors = np.concatenate(texts).astype(np.uint32), functions_of(level)[:, None]
    last = np.maximum(bounds[1:] - width + 1, bounds[:-1])  # where no passage of the text begins any more
    fits = np.zeros(len(grams) + 1, np.int32)
    np.add.at(fits, bounds[:-1], 1)
    np.add.at(fits, last, -1)
    edges, fits = fits != 0, np.cumsum(fits) > 0
    edges[bounds], edges[last] = True, True
    found: list[tuple] = []
    for at in range(0, len(grams) - width + 1, CHUNK):
        least = least_in_windows(grams[at : at + CHUNK + width - 1] * factors, width).reshape(BANDS, ROWS, -1)
        begins = np.ones((BANDS, least.shape[2]), bool)
        begins[:, 1:] = (least[:, :, 1:] != least[:, :, :-1]).any(1)
        begins |= edges[at : at + least.shape[2]]
        band, start = np.nonzero(begins)
        end = np.append(start[1:], 0)
        end[end == 0] = least.shape[2]
        keep = fits[start + at]
        band, start, end = band[keep], start[keep], end[keep]
        key = band.astype(np.uint64)
        for row in range(ROWS):
            key = mixed(key + least[band, row, start])
        found.append((key.view(np.int64), start + at, end + at))
    keys, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
    text = np.searchsorted(bounds, starts, side="right") - 1
    order = np.argsort(text, kind="stable")
    places = np.cumsum(np.bincount(text, minlength=len(texts)))[:-1]
    base = bounds[text]
    columns = (keys, (starts - base).astype(np.int32), (ends - base).astype(np.int32))
    return list(zip(*(np.split(c[order], places) for c in columns), strict=True))


def solid(has: np.ndarray) -> list[tuple[int, int]]:
    """The ranges in which all places are true."""
    edges = np.flatnonzero(np.diff(has.astype(np.int8), prepend=0, append=0))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def dense(has: np.ndarray, least: int, share: float) -> list[tuple[int, int]]:
    """Ranges whose places lie in stretches of `least` places or more of which `share` are true, with no more than GAP false ones at a time.

    A range begins and ends with a true place, so it can be shorter than `least`, but has as many true places as such a stretch.
    """
    at = np.flatnonzero(has)
    found = []
    for part in np.split(at, np.flatnonzero(np.diff(at) > GAP + 1) + 1):
        if not len(part) or len(part) < share * least:
            continue
        lo, hi = int(part[0]), int(part[-1]) + 1
        if hi - lo <= least:
            found.append((lo, hi))
            continue
        # a stretch has the share if the sum of what it is above it isn't less at its end than at its start
        sums = np.concatenate([[0.0], np.cumsum(has[lo:hi] - share)])
        later = np.maximum.accumulate(sums[::-1])[::-1]
        ends = np.searchsorted(-later, 1e-9 - sums, side="right") - 1
        starts = np.flatnonzero(ends - np.arange(len(ends)) >= least)
        marks = np.zeros(len(sums), np.int64)
        np.add.at(marks, starts, 1)
        np.add.at(marks, ends[starts], -1)
        for a, b in solid(np.cumsum(marks)[:-1] > 0):
            true = np.flatnonzero(has[lo + a : lo + b]) + lo + a
            found.append((int(true[0]), int(true[-1]) + 1))
    return found


def widened(own: np.ndarray, ref: np.ndarray, span: tuple[int, int, int, int], least: int) -> tuple[int, int, int, int]:
    """The span (start, end, start in ref, end in ref) with the words before and after it that agree beyond one changed word, and with a changed word at each end where that makes `least` words."""
    start, end, ref_start, ref_end = span
    before = after = 0
    for k in range(2, min(N, start, ref_start) + 1):
        if own[start - k] != ref[ref_start - k]:
            break
        before = k
    for k in range(1, min(N, len(own) - end, len(ref) - ref_end)):
        if own[end + k] != ref[ref_end + k]:
            break
        after = k + 1
    start, end, ref_start, ref_end = start - before, end + after, ref_start - before, ref_end + after
    if end - start < least <= end - start + 2:
        if end < len(own) and ref_end < len(ref):
            end, ref_end = end + 1, ref_end + 1
        if end - start < least and start and ref_start:
            start, ref_start = start - 1, ref_start - 1
    return start, end, ref_start, ref_end


class Text:
    """The grams of a text and what they are looked up in, made when needed and once for all its pairs."""

    def __init__(self, words: np.ndarray, least: int):
        self.words, self.least = words, least

    @cached_property
    def grams(self) -> np.ndarray:
        return ngrams(self.words, N) if len(self.words) >= N else np.empty(0, np.uint64)

    @cached_property
    def index(self) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.grams, kind="stable")
        return self.grams[order], order

    @cached_property
    def whole_set(self) -> np.ndarray:
        return np.unique(ngrams(self.words, self.least)) if len(self.words) >= self.least else np.empty(0, np.uint64)

    def places(self, grams: np.ndarray) -> np.ndarray:
        """The first place of each gram, -1 for those that aren't there."""
        if not len(self.grams):
            return np.full(len(grams), -1)
        known, order = self.index
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        return np.where(known[at] == grams, order[at], -1)


def found_in(values: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Which values occur in the sorted array."""
    if not len(within):
        return np.zeros(len(values), bool)
    return within[np.minimum(np.searchsorted(within, values), len(within) - 1)] == values


def equal_passages(ref: Text, own: Text, place: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(first, end, first in ref) of the starts of passages of `least` words that ref has too; place: where ref has own's grams."""
    size = least - N + 1
    out = [(i, j + 2 - size, int(place[i])) for i, j in solid((place[1:] == place[:-1] + 1) & (place[:-1] >= 0)) if j + 1 - i >= size]
    for i, j in solid(place >= 0):
        if j - i < size:
            continue
        covered = np.zeros(j - i - size + 1, bool)
        for s, e, _ in out:
            covered[max(0, s - i) : max(0, e - i)] = True
        if not covered.all():  # grams that ref has several times hide where it has a passage
            whole = ngrams(own.words[i : j + N - 1], least)
            for s, e in solid(found_in(whole, ref.whole_set) & ~covered):
                out.append((i + s, i + e, int(np.flatnonzero(ngrams(ref.words, least) == whole[s])[0])))
    return sorted(out)


def alike(ref: Text, own: Text, i: int, j: int, place: np.ndarray, size: int, share: float, threshold: float) -> tuple[tuple[float, int, int], list[tuple[int, int]]]:
    """The similarity of own's grams i to j to the most similar range of ref, that range, and parts of own's that another range of ref is like."""
    here = np.unique(own.grams[i:j])
    known = place[i:j][place[i:j] >= 0]
    best, parts = (0.0, 0, 0), []
    ranges = [(int(known.min()), int(known.max()) + 1)]
    if ranges[0][1] - ranges[0][0] > (j - i) / threshold:
        ranges = dense(found_in(ref.grams, here), int(size * threshold), share * threshold)
    for a, b in ranges:
        there = np.unique(ref.grams[a:b])
        both = np.count_nonzero(found_in(here, there))
        best = max(best, (both / (len(here) + len(there) - both), a, b))
        if best[0] < threshold:
            parts += [(i + x, i + y) for x, y in dense(found_in(own.grams[i:j], there), size, share) if y - x < j - i]
    return best, parts


def shared_passages(ref: Text, own: Text, least: int, threshold: float) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """(start, end, start in ref, end in ref), in words, of the passages of `own` that `ref` has too; and the ranges of starts of equal ones."""
    place = ref.places(own.grams)
    equal = equal_passages(ref, own, place, least)
    out = [(i, j + least - 1, a, a + j - i + least - 1) for i, j, a in equal]
    share, size = 2 * threshold / (1 + threshold), least - N + 1
    todo = dense(place >= 0, size, share)
    while todo:
        i, j = todo.pop()
        if any(s <= i and j + N - 1 <= e for s, e, _, _ in out):
            continue
        (best, a, b), parts = alike(ref, own, i, j, place, size, share, threshold)
        if best >= threshold:
            span = (i, j + N - 1, a, b + N - 1)
            if j - i < size:
                span = widened(own.words, ref.words, span, least)
                best = jaccard(*(np.unique(t.grams[x : y - N + 1]) for t, x, y in ((own, *span[:2]), (ref, *span[2:]))))
            if span[1] - span[0] >= least and best >= threshold:
                out.append(span)
        else:  # places of ref that are like parts of it
            todo += set(parts)
    return sorted(out), [(i, j) for i, j, _ in equal]


def without(ranges: list[tuple[int, int]], gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What of the ranges is in none of those that are gone; both in any order."""
    if not ranges:
        return []
    marks = np.zeros(max(e for _, e in ranges) + 1, bool)
    for s, e in ranges:
        marks[s:e] = True
    for s, e in gone:
        marks[s:e] = False
    return solid(marks)


def windows(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, keys, starts, ends (of overlaps) for each text of at least `least` words; docs: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                read = [(doc_id, hashed(words_of(text))) for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True)]
                read = [(doc_id, words) for doc_id, words in read if len(words) >= least]
                made = overlaps_of([ngrams(words, N) for _, words in read], least - N + 1) if read else []
                out = ([i for i, _ in read], *([m[k] for m in made] for k in range(3)))
                yield pa.record_batch([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True)], ["doc_id", "keys", "starts", "ends"])

    return docs.mapInArrow(lean(run), "doc_id long, keys array<long>, starts array<int>, ends array<int>")


def words_in(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, words (their hashes) of the documents with these ids; only their texts are read for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                yield pa.record_batch([batch.column(0), pa.array([hashed(words_of(t)).tobytes() for t in texts_of(batch.column(1))], pa.binary())], ["doc_id", "words"])

    return only_keys(docs, ids, "doc_id").mapInArrow(lean(run), "doc_id long, words binary")


def grouped(rows: DataFrame) -> DataFrame:
    """rows: key, doc_id and more. Those whose key other documents have too, with the smallest of these as ref_doc_id.

    The keys are a checkpoint: a join of two plain shuffles is one that Spark can split where a key has too many rows.
    """
    first = rows.groupBy("key").agg(F.min("doc_id").alias("ref_doc_id"), F.max("doc_id").alias("last")).where("last > ref_doc_id").drop("last").checkpoint()
    return rows.join(first, "key")


def compared(pairs: DataFrame, docs: DataFrame, least: int, threshold: float) -> DataFrame:
    """pairs: ref_doc_id, doc_id, keys, starts, ends. Adds spans; equal and open: the ranges of starts of passages that ref has, and of those in overlaps that it hasn't; lost: overlaps that no span touches where all their passages meet."""

    def apart(spans: list[tuple], start: int, end: int) -> bool:
        lo, hi = (end - 1, start + least) if end <= start + least else (start, end - 1 + least)
        return not any(s < hi and lo < e for s, e, _, _ in spans)

    ids = pairs.select(F.explode(F.array("doc_id", "ref_doc_id")).alias("doc_id")).distinct().checkpoint()
    texts = words_in(docs, ids)
    loaded = pairs.join(texts, "doc_id").join(texts.select(F.col("doc_id").alias("ref_doc_id"), F.col("words").alias("ref_words")), "ref_doc_id")
    struct = lambda *names: pa.list_(pa.struct([(n, pa.int64() if n == "key" else pa.int32()) for n in names]))
    kinds = {"spans": struct("start", "end", "ref_start", "ref_end"), "equal": struct("start", "end"), "open": struct("start", "end"), "lost": struct("key", "start", "end")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ref = None, None
        for batch in batches:
            out: dict[str, list] = {name: [] for name in kinds}
            for ref_id, keys, starts, ends, words, ref_words in zip(batch.column(0).to_pylist(), *(batch.column(c) for c in range(2, 7)), strict=True):
                if ref_id != last or ref is None:
                    last, ref = ref_id, Text(np.frombuffer(ref_words.as_buffer(), "<u4"), least)
                spans, equal = shared_passages(ref, Text(np.frombuffer(words.as_buffer(), "<u4"), least), least, threshold)
                places = list(zip(keys.as_py(), starts.as_py(), ends.as_py(), strict=True))
                for name, rows in (("spans", spans), ("equal", equal), ("open", without([p[1:] for p in places], equal)), ("lost", [p for p in places if apart(spans, *p[1:])])):
                    fields = [f.name for f in kinds[name].value_type]
                    out[name].append([dict(zip(fields, row, strict=True)) for row in rows])
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(out[n], k) for n, k in kinds.items())], ["ref_doc_id", "doc_id", *kinds])

    span = "array<struct<start:int,end:int>>"
    return loaded.select("ref_doc_id", "doc_id", "keys", "starts", "ends", "words", "ref_words").mapInArrow(lean(run), f"ref_doc_id long, doc_id long, spans array<struct<start:int,end:int,ref_start:int,ref_end:int>>, equal {span}, open {span}, lost array<struct<key:long,start:int,end:int>>")


def finer_keys(texts: DataFrame, least: int) -> DataFrame:
    """texts: doc_id, words, open and equal (ranges of starts). key, doc_id for each whole passage that is open and not equal."""

    def made(words: np.ndarray, open_: list[dict], equal: list[dict]) -> np.ndarray:
        keys = [ngrams(words[s : e + least - 1], least).view(np.int64) for s, e in without([(p["start"], p["end"]) for p in open_], [(p["start"], p["end"]) for p in equal])]
        return np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, words, *places in zip(batch.column(0).to_pylist(), batch.column(1), *(batch.column(c).to_pylist() for c in (2, 3)), strict=True):
                keys = made(np.frombuffer(words.as_buffer(), "<u4"), *places)
                yield pa.record_batch([pa.array(keys), pa.array([doc_id] * len(keys), pa.int64())], ["key", "doc_id"])

    return texts.select("doc_id", "words", "open", "equal").mapInArrow(lean(run), "key long, doc_id long")


def in_common(sets: list[np.ndarray]) -> np.ndarray:
    """How many grams each two of the sets have in common."""
    found, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shared = np.flatnonzero(uses > 1)  # the others are in one set
    number = np.full(len(found), -1)
    number[shared] = np.arange(len(shared))
    owner, column = owner[number[column] >= 0], number[column[number[column] >= 0]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, len(shared), COLUMNS):
        here = (column >= at) & (column < at + COLUMNS)
        has = np.zeros((len(sets), min(COLUMNS, len(shared) - at)), np.float32)
        has[owner[here], column[here] - at] = 1
        out += has @ has.T
    return out


def partners(rows: list[tuple[int, int, bytes]], one: int, other: int, least: int, threshold: float) -> list[tuple[int, int]]:
    """(ref_doc_id, doc_id) of rows (doc_id, part, words of an overlap) of two parts, or of one with itself.

    A row meets each of a smaller doc_id that has as many of its grams as shared_passages asks for at least; those that have no more of it than smaller ones are left out.
    """
    rows = sorted(rows)
    ids, parts = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    texts = [Text(np.frombuffer(r[2], "<u4"), least) for r in rows]
    sets = [np.unique(t.grams) for t in texts]
    size = least - N + 1
    fewest = np.array([np.ceil(2 * threshold / (1 + threshold) * size - 1e-9) - len(t.grams) + len(x) for t, x in zip(texts, sets, strict=True)])
    meet = (in_common(sets) >= np.maximum(fewest, 1)[:, None]) & (ids[:, None] > ids)
    if one != other:
        meet &= parts[:, None] != parts
    out = []
    for k in np.flatnonzero(meet.any(1)):
        covered = np.zeros(len(texts[k].grams), bool)
        for ref in np.flatnonzero(meet[k]):
            if covered[found_in(texts[k].grams, sets[ref])].all():
                continue
            spans = shared_passages(texts[ref], texts[k], least, threshold)[0]
            before = covered.sum()
            for start, end, _, _ in spans:
                covered[start : end - N + 1] = True
            if covered.sum() > before:
                out.append((int(ids[ref]), int(ids[k])))
    return out


def met_in_parts(many: DataFrame, docs: DataFrame, least: int, threshold: float) -> DataFrame:
    """ref_doc_id, doc_id of the overlaps of large groups that have a passage in common; many: key, doc_id, start, end, parts (of the key's group)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "one", "other", "part", "doc_id", "words")
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        for batch in batches:
            for doc_id, raw, lost in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words, own = np.frombuffer(raw.as_buffer(), "<u4"), int(mixed(np.array([doc_id], np.int64).view(np.uint64))[0])
                for p in lost:
                    part, region = own % p["parts"], words[p["start"] : p["end"] - 1 + least].tobytes()
                    rows = [(p["key"], min(part, k), max(part, k), part, doc_id, region) for k in range(p["parts"])]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(place: tuple[int, int, int]) -> pa.RecordBatch:
            found = partners(rows, *place[1:], least, threshold)
            return pa.record_batch([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["ref_doc_id", "doc_id"])

        now, rows = None, []
        for batch in batches:
            for place, part, doc_id, words in zip(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True), *(batch.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
                if place != now:
                    if rows:
                        yield out(now)
                    now, rows = place, []
                rows.append((doc_id, part, words))
        if rows:
            yield out(now)

    asked = many.groupBy("doc_id").agg(F.collect_set(F.struct("key", "start", "end", "parts")).alias("lost")).checkpoint()
    dealt = asked.join(words_in(docs, asked.select("doc_id")), "doc_id").select("doc_id", "words", "lost").mapInArrow(lean(cut), "key long, one int, other int, part int, doc_id long, words binary")
    place = ["key", "one", "other"]
    return dealt.repartition(*place).sortWithinPartitions(*place).mapInArrow(lean(meet), "ref_doc_id long, doc_id long")


def looked_at_again(first: DataFrame, docs: DataFrame, least: int, threshold: float) -> DataFrame:
    """ref_doc_id, doc_id of the pairs that what the first comparison left open and lost leads to.

    A passage that is open in a document has no equal in its groups' smallest documents. Another document that has it is in
    these groups too, and there it is open as well.
    """
    lost = first.select("doc_id", F.explode("lost").alias("p")).select("doc_id", "p.*")
    sizes = lost.groupBy("key").agg(F.countDistinct("doc_id").alias("n"), F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")).where("n > 1").checkpoint()
    members = lost.join(sizes, "key").checkpoint()
    few = members.where(F.col("n") <= FEW).select("key", "doc_id").distinct()
    met = few.join(few.withColumnRenamed("doc_id", "ref_doc_id"), "key").where("ref_doc_id < doc_id").select("ref_doc_id", "doc_id")
    many = met_in_parts(members.where(F.col("n") > FEW), docs, least, threshold)
    ranges = first.where("size(open) > 0").groupBy("doc_id").agg(F.flatten(F.collect_list("open")).alias("open"))
    equal = first.where("size(equal) > 0").groupBy("doc_id").agg(F.flatten(F.collect_list("equal")).alias("equal"))
    asked = ranges.join(equal, "doc_id", "left").checkpoint()
    spread = asked.select("doc_id", "open", F.coalesce("equal", F.array().cast(asked.schema["equal"].dataType)).alias("equal"))
    finer = grouped(finer_keys(spread.join(words_in(docs, asked.select("doc_id")), "doc_id"), least))
    return met.unionByName(many).unionByName(finer.where("doc_id != ref_doc_id").select("ref_doc_id", "doc_id")).distinct()


def repeated_passages(docs: DataFrame, least: int = 50, threshold: float = 0.8) -> DataFrame:
    """A row for each passage and each earlier document found to have it: see SPANS; ends are exclusive."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    spark = docs.sparkSession
    made, windows_folder = written(windows(docs, least), "windows")
    # one number for both ends keeps the shuffled rows short
    rows = made.select("doc_id", F.explode(F.arrays_zip("keys", "starts", "ends")).alias("w")).select(F.col("w.keys").alias("key"), "doc_id", (F.shiftleft(F.col("w.starts").cast("long"), 32) + F.col("w.ends")).alias("place"))
    placed = grouped(rows).select("*", F.shiftright("place", 32).cast("int").alias("start"), F.col("place").bitwiseAND(0xFFFFFFFF).cast("int").alias("end"))
    pairs, pairs_folder = written(placed.where("doc_id != ref_doc_id").groupBy("ref_doc_id", "doc_id").agg(*(F.collect_list(x).alias(f"{x}s") for x in ("key", "start", "end"))), "pairs")
    drop_folder(spark, windows_folder)  # what was made of it is written
    first, first_folder = written(compared(pairs, docs, least, threshold), "passages")
    drop_folder(spark, pairs_folder)
    drop_shuffles(spark)
    found = first.select("doc_id", "ref_doc_id", F.explode("spans").alias("s"))
    more = looked_at_again(first, docs, least, threshold).join(first.select("ref_doc_id", "doc_id"), ["ref_doc_id", "doc_id"], "left_anti")
    more = more.select("ref_doc_id", "doc_id", F.array().cast("array<long>").alias("keys"), *(F.array().cast("array<int>").alias(x) for x in ("starts", "ends"))).checkpoint()
    found = found.unionByName(compared(more, docs, least, threshold).select("doc_id", "ref_doc_id", F.explode("spans").alias("s")))
    found, _ = written(found.select("doc_id", "ref_doc_id", *(F.col(f"s.{a}").alias(f"{a}_word") for a in ("start", "end", "ref_start", "ref_end"))).distinct(), "repeats")
    drop_folder(spark, first_folder)
    return found


def without_repeats(docs: DataFrame, least: int = 50, threshold: float = 0.8) -> DataFrame:
    """The documents without the passages that an earlier one has; those of which no word is left go."""
    found = repeated_passages(docs, least, threshold).select("doc_id", F.struct(F.col("start_word").alias("s"), F.col("end_word").alias("e")).alias("span"))
    drop_shuffles(docs.sparkSession)  # before the texts are shuffled for the cut
    # names that no column of docs has
    own, listed = (next(n for k in range(len(docs.columns) + 1) if (n := f"{x}_{k}") not in docs.columns) for x in ("repeat_id", "repeats"))
    spans = found.groupBy("doc_id").agg(F.sort_array(F.collect_set("span")).alias(listed)).withColumnRenamed("doc_id", own)
    joined = docs.join(spans, docs["doc_id"].cast("long") == spans[own], "left").drop(own)
    clean, cut = joined.where(F.col(listed).isNull()).drop(listed), joined.where(F.col(listed).isNotNull())

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut_words(t, spans) for t, spans in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            columns = [pa.array(texts, pa.string()) if k == place else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.record_batch(columns, batch.schema.names[:-1])

    place = clean.columns.index("text")
    wide = cut.withColumn("text", F.col("text").cast("string")).select(*clean.columns, listed)
    left = wide.mapInArrow(lean(rest), wide.drop(listed).schema).where(F.col("text").isNotNull())
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.unionByName(left.select(clean.columns))


def cut_words(text: str, spans) -> str | None:
    """The text without the words of the spans and what stands between them; None if no word is left."""
    raw = text.encode()
    folded = np.frombuffer(raw.translate(FOLD), np.uint8) != 32
    edges = np.diff(np.concatenate([[0], folded.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    gone, parts, at, words = np.zeros(len(starts), bool), [], 0, 0
    for s in spans:
        gone[s["s"] : s["e"]] = True
    edges = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
    for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
        parts.append(raw[at : starts[a]])
        at = ends[b - 1]
    words = len(starts) - int(gone.sum())
    return b"".join([*parts, raw[at:]]).decode() if words else None
