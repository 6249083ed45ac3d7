"""Toxicity: noisy-channel deobfuscation, then a linear score of the restored text.

Written to be missed, a word has digits or signs for letters, letters set apart, or letters drawn out. Spans of a text that
look so are decoded: a lattice holds what each character may stand for, its costs are the channel's, and Viterbi finds the
path of least cost under a character trigram model counted over all documents. What is decoded replaces the span.

The score is a logistic regression on the words of the restored text and their first letters. It learns from labelled
documents outside the held-out fold, at most `most_rows` of them, drawn by a hash of their id; features are those that
stand out among toxic documents. Model counts cover every document.

Null and empty texts get the score of a text without features; long texts are restored and scored whole; equal texts get
equal scores. Rows without an id are never learnt from and count as held out. Without labels no feature is learnt and each
score is the same, below one half. An empty table gives no row. Other columns never enter a score.
"""

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.shared import bounded_batches, held, lean, words_of

#: What a sign may stand for when it isn't itself.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c"}
#: Costs of the channel, in nats: a sign for a letter, a digit that is one, a sign that is left out, a drawn-out run made one or two letters.
COST_SIGN, COST_KEEP, COST_DROP, COST_RUN = 1.0, 0.7, 2.5, (0.2, 0.7)
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
SIZE = len(LETTERS) + 1
_CODE = np.zeros(0x180, np.int64)
_CODE[[ord(c) for c in LETTERS]] = np.arange(1, SIZE)
_SIGN = re.escape("".join(LEET))
#: Letters set apart by a sign or space, in lower-case text.
APART = re.compile(rf"(?<![^\s.,;:])(?:[^\W\d_][ .*_-](?=[^\W_]|[{_SIGN}])|[{_SIGN}][ .*_-](?=[^\W_]|[{_SIGN}])){{3,}}[^\W_](?![^\W_])")
#: What a word written to be missed holds somewhere: a sign before a letter, or a letter three times. Few words do.
HINT = re.compile(rf"[{_SIGN}]+(?=[^\W\d_])|([^\W\d_])\1\1")
#: Such words, or their part: signs within or before letters; a letter three times and more.
SUSPECT = re.compile(rf"(?:(?<![^\s.,;:])[{_SIGN}]{{1,2}})?[^\W\d_]+(?:[{_SIGN}]+[^\W\d_]+)+|(?<![^\s.,;:])[{_SIGN}]{{1,2}}[^\W\d_]{{2,}}[{_SIGN}]?[^\W\d_]*|[^\W\d_]*([^\W\d_])\1\1[^\W\d_]*")
PREFIXES = (4, 5)
Model = dict[int, int]


def trigram_counts(docs: DataFrame) -> Model:
    """How often each run of three letters occurs in all documents, other characters being one; SIZE ** 3 numbers at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, waiting, size = np.zeros(SIZE**3, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                own = np.frombuffer(f"  {(text.as_py() or '').lower()}  ".encode("utf-32-le"), "<u4")
                code = _CODE[np.minimum(own, len(_CODE) - 1)]
                codes = code[:-2] * (SIZE * SIZE) + code[1:-1] * SIZE + code[2:]
                waiting.append(codes)
                size += len(codes)
                if size > 1 << 20:
                    seen += np.bincount(np.concatenate(waiting), minlength=SIZE**3)
                    waiting, size = [], 0
        if waiting:
            seen += np.bincount(np.concatenate(waiting), minlength=SIZE**3)
        found = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(found), pa.array(seen[found])], ["code", "n"])

    return {r[0]: r[1] for r in docs.select(F.col("text").cast("string")).mapInArrow(lean(run), "code long, n long").groupBy("code").agg(F.sum("n")).collect()}


class Decoder:
    """Viterbi over character lattices; what is decoded is kept for the next time, up to `most` spans."""

    def __init__(self, counts: Model, most: int = 50_000):
        pairs: Model = {}
        ones: Model = {}
        for code, n in counts.items():
            pairs[code // SIZE] = pairs.get(code // SIZE, 0) + n
            ones[code % SIZE] = ones.get(code % SIZE, 0) + n
        follow: Model = {}
        first: Model = {}
        for code, n in pairs.items():
            first[code // SIZE] = first.get(code // SIZE, 0) + n
            follow[code] = n
        self.counts, self.pairs, self.first, self.ones, self.total = counts, follow, first, ones, sum(ones.values())
        self.most = most
        self.seen: dict[str, str] = {}
        self.costs: dict[int, float] = {}

    def cost(self, code: int) -> float:
        """Minus the logarithm of the last letter's chance after the two before, backed by shorter runs."""
        found = self.costs.get(code)
        if found is None:
            ab, b, c = code // SIZE, code // SIZE % SIZE, code % SIZE
            one = (self.ones.get(c, 0) + 0.5) / (self.total + 0.5 * SIZE)
            two = (self.pairs.get(b * SIZE + c, 0) + 20 * one) / (self.first.get(b, 0) + 20)
            found = self.costs[code] = -math.log((self.counts.get(code, 0) + 20 * two) / (self.pairs.get(ab, 0) + 20))
        return found

    def lattice(self, span: str) -> list[list[tuple[str, float]]]:
        """For each step the strings it may be and their costs."""
        out: list[list[tuple[str, float]]] = []
        apart = bool(re.search(r"\S[ .*_-]\S[ .*_-]\S[ .*_-]", span))
        letters = re.sub(r"[ .*_-]", "", span) if apart else span
        for run in re.finditer(r"(.)\1*", letters, re.DOTALL):
            sign, n = run[1], len(run[0])
            if sign in LEET:
                stands = [(x, COST_SIGN) for x in LEET[sign]] + [(sign, COST_KEEP) if sign.isdigit() else ("", COST_DROP)]
                out += [stands] * n
            elif n >= 3:
                out.append([(sign, COST_RUN[0]), (sign * 2, COST_RUN[1])])
            else:
                out.append([(run[0], 0.0)])
        return out

    def decoded(self, span: str) -> str:
        found = self.seen.get(span)
        if found is None:
            states: dict[int, tuple[float, str]] = {0: (0.0, "")}
            for options in self.lattice(span):
                after: dict[int, tuple[float, str]] = {}
                for state, (cost, text) in states.items():
                    for string, extra in options:
                        now, s = cost + extra, state
                        for c in string:
                            code = s * SIZE + int(_CODE[ord(c)] if ord(c) < len(_CODE) else 0)
                            now, s = now + self.cost(code), code % (SIZE * SIZE)
                        if s not in after or now < after[s][0]:
                            after[s] = (now, text + string)
                states = after
            found = min(((cost + self.cost(state * SIZE), text) for state, (cost, text) in states.items()))[1]
            if len(self.seen) >= self.most:
                self.seen.clear()
            self.seen[span] = found
        return found

    def restored(self, text: str | None) -> str:
        """The text in lower case with its suspect spans decoded."""
        if not text:
            return ""
        low = APART.sub(lambda m: self.decoded(m[0]), text.lower())
        parts, at = [], 0
        for hint in HINT.finditer(low):
            k = hint.start()
            if k >= at:
                start = max(low.rfind(" ", at, k), low.rfind("\n", at, k), at - 1) + 1
                end = min((e for e in (low.find(" ", k), low.find("\n", k)) if e >= 0), default=len(low))
                parts += [low[at:start], SUSPECT.sub(lambda m: self.decoded(m[0]), low[start:end])]
                at = end
        return "".join([*parts, low[at:]]) if parts else low


def features(text: str) -> set[bytes]:
    """The words in UTF-8, and the first bytes of those long enough, marked as such."""
    words = set(words_of(text.encode("utf-8", "replace")))
    return words.union(*({w[:n] + b"*" for w in words if len(w) >= n} for n in PREFIXES))


class Score:
    """bias and weights; log odds of a text whose words are looked up by the sets of what has a weight."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.bias, self.weights = bias, {f.encode("latin-1"): w for f, w in weights.items()}
        self.words = {f for f in self.weights if not f.endswith(b"*")}
        self.first = {n: {f[:-1] for f in self.weights if f.endswith(b"*") and len(f) == n + 1} for n in PREFIXES}

    def __call__(self, text: str) -> float:
        words = set(words_of(text.encode("utf-8", "replace")))
        found = [self.weights[w] for w in words & self.words]
        for n, known in self.first.items():
            found += [self.weights[w + b"*"] for w in {w[:n] for w in words} & known]
        return self.bias + math.fsum(found)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_features(docs: DataFrame, labels: DataFrame, counts: Model, most_rows: int) -> DataFrame:
    """doc_id, toxic, features of labelled documents outside the held-out fold, about `most_rows` at most."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, most_rows / max(1, known.count()))
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30))
    chosen = docs.where(drawn).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(known.where(drawn).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int")), "doc_id")
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = [sorted(f.decode("latin-1") for f in features(decoder.restored(t.as_py()))) for t in batch.column(2)]
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], ["doc_id", "toxic", "features"])

    return chosen.select("doc_id", "toxic", "text").mapInArrow(lean(run), "doc_id long, toxic int, features array<string>")


def fitted(rows: DataFrame, most_features: int = 20_000, least_docs: int = 3, least_gain: float = 15.0) -> tuple[dict[str, float], float]:
    """Weights of the features that mark toxic documents, and the bias."""
    size = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    n, n1 = sum(size.values()), size.get(1, 0)
    if not n1 or n1 == n:
        return {}, -3.0
    ones, all_ = F.col("ones"), F.col("docs")
    counted = rows.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("ones"), F.count(F.lit(1)).alias("docs")).where((ones >= least_docs) & (ones * n > all_ * n1))
    part = lambda k, m: F.when(k > 0, k * F.log(k / m)).otherwise(0.0)
    gain = 2 * (part(ones, all_ * n1 / n) + part(all_ - ones, all_ * (n - n1) / n))
    names = [r[0] for r in counted.withColumn("gain", gain).where(F.col("gain") >= least_gain).orderBy(F.desc("gain"), "f").limit(most_features).select("f").collect()]
    place = {f: k for k, f in enumerate(names)}
    sent = rows.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[sent.value[f] for f in row if f in sent.value] for row in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "toxic", "places"])

    sample = sorted(map(tuple, rows.select("doc_id", "toxic", "features").mapInArrow(lean(run), "doc_id long, toxic int, places array<int>").collect()))  # most_rows rows
    weights, bias = logistic([s[2] for s in sample], np.array([s[1] for s in sample], float), len(names))
    return {f: float(w) for f, w in zip(names, weights, strict=True)}, bias


def logistic(rows: list[list[int]], y: np.ndarray, size: int, rounds: int = 300, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features by Adam over all rows."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.array([c for r in rows for c in r], np.int64)
    w, b = np.zeros(size), math.log(y.mean() / (1 - y.mean()))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[column], len(rows)), -30, 30)))
        error = (p - y) / len(rows)
        g = np.append(np.bincount(column, error[row], size) + decay * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def scored(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """A row for each row of docs: its columns, held_out, score, predicted; own columns of these names are replaced."""
    rated = with_score(docs.drop("score", "held_out", "predicted"), labels, "score", most_rows)
    return rated.withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """The documents that aren't predicted toxic, with their columns as they are."""
    name = next(n for k in range(len(docs.columns) + 1) if (n := f"toxicity_{k}") not in docs.columns)
    return with_score(docs, labels, name, most_rows).where(F.col(name) < 0.5).drop(name)


def with_score(docs: DataFrame, labels: DataFrame, name: str, most_rows: int) -> DataFrame:
    """docs with the score as a further column of that name."""
    bounded_batches(docs.sparkSession)
    counts = trigram_counts(docs)
    weights, bias = fitted(rows := held(training_features(docs, labels, counts, most_rows)))
    rows.unpersist()
    sent = docs.sparkSession.sparkContext.broadcast((counts, weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, weights, bias = sent.value
        decoder, log_odds = Decoder(counts), Score(weights, bias)
        for batch in batches:
            sums = np.array([log_odds(decoder.restored(t.as_py())) for t in batch.column(text)], float)
            yield batch.append_column(name, pa.array(1 / (1 + np.exp(-np.clip(sums, -30, 30)))))

    text = docs.columns.index("text")
    schema = T.StructType([*docs.withColumn("text", F.col("text").cast("string")).schema, T.StructField(name, T.DoubleType())])
    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(lean(run), schema)
