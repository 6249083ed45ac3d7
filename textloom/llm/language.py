"""Language ID of web pages: Bayesian fusion of text, declared language, address suffix and host.

Each page's posterior is prior(host) x P(text | language) x P(declared | language) x P(suffix | language). Text likelihoods
come from character trigrams, counted over all pages by the language they declare; a page's log likelihood counts as that of
`reach` trigrams at most, since neighbouring trigrams say much the same. What the text alone says then is counted by
declared language, by suffix, and by host, domain and whole collection: each level's shares are drawn to those of the level
above by `strength` pages, so a host with few pages follows its domain, and that the collection.

A page without text, markup or address goes without that evidence; without any it gets the collection's shares. Languages
outside the list are declared as none, or as `other` where that is asked for: a language more, whose text is as likely as one whose trigrams are
all equally frequent, so it is text unlike that of every listed language. Repeated rows count and are returned each. Ties go to the language that comes first
in the list. An empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.shared import kept, lean

LANGUAGES = ("de", "en", "es", "fr")
#: Labels before a country's suffix under which names are registered, as in example.co.uk.
REGISTRIES = {"ac", "co", "com", "edu", "gob", "gouv", "gov", "net", "or", "org"}
BUCKETS = 1 << 16
_DECLARED = re.compile(r"<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})\b", re.IGNORECASE)
_META = re.compile(r"<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?([A-Za-z]{2,3})\b", re.IGNORECASE)
_MARKUP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.IGNORECASE | re.DOTALL)
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", re.IGNORECASE)


def declared(page: str, languages: tuple[str, ...], other: str | None = None) -> int:
    """The place of the declared language in the list, -1 for none; languages that aren't in it count as `other`, if the list has that."""
    found = _DECLARED.search(page) or _META.search(page)
    name = found[1].lower() if found else ""
    if name and name not in languages and other:
        name = other
    return languages.index(name) if name in languages else -1


def visible(page: str) -> str:
    return " ".join(entities.unescape(_MARKUP.sub(" ", page)).lower().split())


def trigrams(text: str) -> np.ndarray:
    """A bucket for each run of three characters."""
    c = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(c) < 3:
        return np.empty(0, np.int64)
    mixed = (c[:-2] * np.uint64(0x9E3779B1) ^ c[1:-1] * np.uint64(0x85EBCA77) ^ c[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x27D4EB2F)
    return (mixed >> np.uint64(13) & np.uint64(BUCKETS - 1)).astype(np.int64)


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower().rstrip(".") if found else ""


def domain_of(host: str) -> str:
    """The registered name: the last two labels, or three under a country's registry."""
    labels = host.split(".")
    return ".".join(labels[-3 if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in REGISTRIES else -2 :])


def trained(pages: DataFrame, languages: tuple[str, ...], other: str | None = None) -> np.ndarray:
    """Log chances of the trigram buckets, a row for each language, those of `other` all equal; the counts are len(languages) * BUCKETS numbers at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            for page in batch.column(0):
                if (own := page.as_py()) and (k := declared(own, languages)) >= 0:
                    seen[k] += np.bincount(trigrams(visible(own)), minlength=BUCKETS)
        found = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(found), pa.array(seen.ravel()[found])], ["cell", "n"])

    counts = np.zeros(len(languages) * BUCKETS)
    for cell, n in pages.select(F.col("html").cast("string")).mapInArrow(lean(run), "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        counts[cell] = n
    counts = counts.reshape(len(languages), BUCKETS)
    whole = (counts.sum(0) + 0.5) / (counts.sum() + 0.5 * BUCKETS)
    model = np.log((counts + 1000 * whole) / (counts.sum(1, keepdims=True) + 1000))
    if other:
        model[languages.index(other)] = -np.log(BUCKETS)
    return model


def text_evidence(pages: DataFrame, model: np.ndarray, languages: tuple[str, ...], reach: int, other: str | None = None) -> DataFrame:
    """page_id, declared, suffix, domain, host, text (log likelihoods) and said (the text's language, null without text)."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = page.as_py() or ""
                host, grams, k = host_of(url), trigrams(visible(own)) if own else np.empty(0, np.int64), declared(own, languages, other)
                labels = host.split(".")
                logs = sent.value[:, grams].sum(1) * min(1.0, reach / max(1, len(grams))) if len(grams) else np.zeros(len(languages))
                row = (languages[k] if k >= 0 else None, labels[-1], domain_of(host), host, logs - logs.max(), languages[int(logs.argmax())] if len(grams) > 2 else None)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.float64()), pa.string())
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["page_id", "declared", "suffix", "domain", "host", "text", "said"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(lean(run), "page_id long, declared string, suffix string, domain string, host string, text array<double>, said string")


def _counts(rows: DataFrame, languages: tuple[str, ...], name: str, *keys: str) -> DataFrame:
    """How many texts of each language have each value of the keys, as an array in the order of the list.

    A checkpoint, for Spark splits the join with a host of too many pages only if both its sides are plain shuffles.
    """
    sums = [F.sum((F.col("said") == language).cast("double")) for language in languages]
    return rows.where("said IS NOT NULL").groupBy(*keys).agg(F.array(*sums).alias(name)).checkpoint()


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)


def _drawn(counts: Column, above: Column, strength: float) -> Column:
    """Shares of the counts, drawn to the shares above as by `strength` more pages."""
    total = _total(counts) + strength
    return F.coalesce(F.zip_with(counts, above, lambda n, p: (n + strength * p) / total), above)


def identified(pages: DataFrame, languages: tuple[str, ...] = LANGUAGES, reach: int = 30, strength: float = 20.0, other: str | None = None) -> DataFrame:
    """A row for each page: page_id, language, posterior, text_language, declared_language, host."""
    languages = (*languages, other) if other else languages
    found = kept(text_evidence(pages, trained(pages, languages, other), languages, reach, other), "languages")
    size = len(languages)
    first = found.where("said IS NOT NULL").agg(*(F.sum((F.col("said") == x).cast("double")) for x in languages)).first()
    whole = [((n or 0.0) + 1.0) / (sum(x or 0.0 for x in first) + size) for n in first]
    shares = F.array(*map(F.lit, whole))
    totals = F.array(*(F.lit((n or 0.0)) for n in first))
    # Given a language, the chance of a value: its texts with the value, drawn to the value's share of all pages.
    rows = found.join(_counts(found, languages, "at_domain", "domain"), "domain", "left").join(_counts(found, languages, "at_host", "host"), "host", "left")
    rows = rows.join(F.broadcast(_counts(found, languages, "of_declared", "declared").where("declared IS NOT NULL")), "declared", "left")
    suffixes = _counts(found, languages, "of_suffix", "suffix")
    rows = rows.join(suffixes, "suffix", "left")
    n = sum(x or 0.0 for x in first)

    def likelihood(counts: str) -> Column:
        share = (_total(F.col(counts)) + 1.0) / (n + 1.0)
        return F.coalesce(F.zip_with(counts, totals, lambda c, t: F.log((c + strength * share) / (t + strength))), F.array_repeat(F.lit(0.0), size))

    prior = F.transform(_drawn(F.col("at_host"), _drawn(F.col("at_domain"), shares, strength), strength), lambda p: F.log(p))
    suffix = F.when(F.col("suffix") != "", likelihood("of_suffix")).otherwise(F.array_repeat(F.lit(0.0), size))
    sums = F.zip_with(F.zip_with(F.col("text"), prior, lambda a, b: a + b), F.zip_with(likelihood("of_declared"), suffix, lambda a, b: a + b), lambda a, b: a + b)
    fused = rows.select("page_id", "host", "said", "declared", sums.alias("sums")).withColumn("top", F.array_max("sums"))
    place = F.array_position("sums", F.col("top")).cast("int")
    posterior = F.lit(1.0) / F.aggregate("sums", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    return fused.select("page_id", F.element_at(F.array(*map(F.lit, languages)), place).alias("language"), posterior.alias("posterior"), F.col("said").alias("text_language"), F.col("declared").alias("declared_language"), "host")
