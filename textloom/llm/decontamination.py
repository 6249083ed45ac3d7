"""Benchmark decontamination: a prefix-filtered set join of item windows with documents, in SQL functions alone.

A window is `size` consecutive words of an item, or a whole shorter item. As a set of shingles (runs of SHINGLE words) it is
contained in a document only if each of its shingles is, so one necessary shingle finds it: the prefix of length one
in the order of rarity. A first pass counts the windows' shingles over all documents, which gives that order; a second joins
the documents' shingles with the windows' rarest ones only, drops those whose place leaves no room for the window before or
after (bounds on position and length), and compares the words of what is left one by one. Up to BROADCAST_ROWS windows that is one pass
over the documents, without a shuffle of their words; beyond, shingles and their places meet the windows by a shuffle, and only the texts of
candidates, told apart by id and digest, are read for their words.

Null texts have no words, so neither windows nor hits; items without words or with a null id are left out. Repeated rows are
documents of their own. Without items each document is clean; an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.shared import checkpoint_folder, native_words

SHINGLE = 3
#: The windows' table is broadcast up to so many rows (some 200 bytes each), and joined by a shuffle beyond; so are the windows' shingles (eight bytes).
BROADCAST_ROWS, BROADCAST_SHINGLES = 200_000, 2_000_000


def _shingles(words: Column, size: int) -> Column:
    """A number for each run of `size` words; empty if there are fewer."""
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size)), F.lit(size)))


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """window (number), words, items: each different window and the sorted ids of the items that have it."""
    words = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), native_words(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    cut = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i + 1, size))).alias("words"))
    return cut.groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def rarest(windows: DataFrame, docs: DataFrame) -> tuple[DataFrame, list[int]]:
    """The windows with their rarest shingle and its place, and the shingle sizes there are."""
    size = F.least(F.size("words"), F.lit(SHINGLE))
    sizes = sorted(r[0] for r in windows.select(size).distinct().collect())  # SHINGLE numbers at most
    by_size = F.lit(None).cast("array<long>")
    for k in sizes:
        by_size = F.when(size == k, _shingles(F.col("words"), k)).otherwise(by_size)
    own = windows.select("*", F.posexplode(by_size).alias("place", "shingle")).withColumn("k", size)
    n = own.count()
    wanted, every = own.select("shingle").distinct(), shingled(docs.select(native_words(F.col("text").cast("string")).alias("w")), sizes)
    count = F.count(F.lit(1)).alias("n")
    # few are looked up before they are counted; else counts, combined before the shuffle, are joined
    counts = every.join(F.broadcast(wanted), "shingle").groupBy("shingle").agg(count) if n <= BROADCAST_SHINGLES else every.groupBy("shingle").agg(count).join(wanted, "shingle")
    order = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "place", "k")
    ranked = own.join(counts, "shingle", "left").groupBy("words", "items").agg(F.min(order).alias("r"))
    return ranked.select("words", "items", "r.shingle", "r.place"), sizes


def shingled(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """Each shingle of the documents."""
    return docs.select(F.explode(F.concat(F.array().cast("array<long>"), *(_shingles(F.col("w"), k) for k in sizes))).alias("shingle"))


def contaminated(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_hit, items (sorted ids), hits (first and last word of each window found)."""
    checkpoint_folder(docs.sparkSession)
    windows = item_windows(items, size).checkpoint()
    prefix, sizes = rarest(windows, docs)
    prefix = prefix.select("shingle", F.col("place").alias("before"), F.col("words").alias("window"), "items").checkpoint()
    found = found_in_place(docs, F.broadcast(prefix), sizes) if prefix.count() <= BROADCAST_ROWS else found_by_shuffle(docs, prefix, sizes)
    empty = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("last"))
    covered = F.aggregate("hits", empty, lambda a, h: F.struct((a["n"] + F.greatest(h["last"] - F.greatest(h["first"] - 1, a["last"]), F.lit(0))).alias("n"), F.greatest(a["last"], h["last"]).alias("last")))
    return found.select("doc_id", "n_words", covered["n"].alias("n_hit"), "items", "hits")


def _hit() -> Column:
    return F.struct(F.col("start").alias("first"), (F.col("start") + F.size("window") - 1).alias("last"))


def _hits() -> list[Column]:
    return [F.sort_array(F.collect_set("hit")).alias("hits"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")]


def _shingles_and_places(sizes: list[int]) -> list[Column]:
    return [F.transform(_shingles(F.col("w"), k), lambda s, i: F.struct(s.alias("shingle"), i.alias("place"))) for k in sizes]


def _fits(n_words: Column) -> Column:
    return (F.col("start") >= 0) & (F.col("start") + F.size("window") <= n_words)


def found_in_place(docs: DataFrame, prefix: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, n_words, hits, items of each row, by one pass; prefix is broadcast."""
    own = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), native_words(F.col("text").cast("string")).alias("w"))
    # One more entry, whose place is the number of words, keeps documents without windows.
    end = F.array(F.struct(F.lit(None).cast("long").alias("shingle"), F.size("w").alias("place")))
    spread = own.select("doc_id", "row", "w", F.explode(F.concat(*_shingles_and_places(sizes), end)).alias("s")).select("doc_id", "row", "w", "s.shingle", "s.place")
    last = F.col("shingle").isNull()
    joined = spread.join(prefix, "shingle", "left").withColumn("start", F.col("place") - F.col("before")).where(last | (F.col("window").isNotNull() & _fits(F.size("w"))))
    same = joined.where(last | (F.slice("w", F.col("start") + 1, F.size("window")) == F.col("window")))
    found = same.select("doc_id", "row", F.when(last, F.col("place")).alias("n_words"), F.when(~last, _hit()).alias("hit"), "items")
    return found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").cast("long").alias("n_words"), *_hits())


def found_by_shuffle(docs: DataFrame, prefix: DataFrame, sizes: list[int]) -> DataFrame:
    """The same for any number of windows. What is shuffled of all documents are shingles with their places, never word arrays."""
    text = F.col("text").cast("string")
    own = docs.select(F.struct("doc_id", F.xxhash64(text).alias("digest")).alias("key"), native_words(text).alias("w"))
    spread = own.select("key", F.size("w").alias("n"), F.explode(F.concat(*_shingles_and_places(sizes))).alias("s")).select("key", "n", "s.shingle", "s.place")
    candidates = spread.join(prefix, "shingle").withColumn("start", F.col("place") - F.col("before")).where(_fits(F.col("n"))).select("key", "start", "window", "items").checkpoint()
    same = candidates.join(own, "key").where(F.slice("w", F.col("start") + 1, F.size("window")) == F.col("window"))
    hits = same.select("key", _hit().alias("hit"), "items").groupBy("key").agg(*_hits())
    left = own.select("key", F.size("w").cast("long").alias("n_words")).join(hits, "key", "left")
    none = F.array().cast("array<struct<first:int,last:int>>")
    return left.select("key.doc_id", "n_words", F.coalesce("hits", none).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def digest(found: DataFrame) -> DataFrame:
    """The result with the items' number and digest instead of their ids."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, size: int = 10, share: float = 0.0) -> DataFrame:
    """The documents of whose words no more than `share` are in windows of items.

    Rows that share an id stay or go together; those whose id is null are documents of their own, told apart by their text.
    """
    nameless = F.when(docs["doc_id"].isNull(), F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256))
    found = contaminated(docs.select(F.struct(docs["doc_id"].alias("id"), nameless.alias("digest")).alias("doc_id"), "text"), items, size)
    bad = found.where(F.col("n_hit") > F.col("n_words") * share).select(F.col("doc_id.id").alias("bad_id"), F.col("doc_id.digest").alias("bad_digest")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & nameless.eqNullSafe(bad["bad_digest"]), "left_anti")
