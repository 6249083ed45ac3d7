"""Blocks of a document: the line grammar, runs, sections, continuity and loss checks."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import text as T

HEADING = r"(?iu)^(?:titulo|t[ií]tulo|secao|se[cç][aã]o|capitulo|cap[ií]tulo(?:\s+\d+)?)\s*:\s*(.+)$"


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line: the lines of each text with something in them, without white space at their ends."""
    cut = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r\n|\r|\n")).alias("line_no", "line"))
    return cut.select("doc_id", "line_no", F.trim("line").alias("line")).where("line != ''")


def parsed(docs: DataFrame) -> DataFrame:
    """Blocks by the line grammar: doc_id, ord, type, level, text, items, rows, start.

    Rows of a table that stand together are one block, separators left out; every other line is a block.
    """
    lines = lines_of(docs)
    line, w = F.col("line"), W.partitionBy("doc_id").orderBy("line_no")
    kind = (
        F.when(line.rlike(r"^#{1,6}\s+"), "heading")
        .when(line.rlike(HEADING) | T.is_upper_heading(line), "heading")
        .when(line.rlike(r"^[-*+]\s+"), "list")
        .when(line.rlike(r"^(?:\(?\d+\)|\d+\))\s+") | line.rlike(r"^\d+\.\s+"), "list")
        .when(line.startswith("```"), "code")
        .when(T.is_table_row(line), "table")
        .when(line == "[imagem decorativa]", "image")
        .otherwise("paragraph")
    )
    typed = lines.withColumn("type", kind)
    first = (F.col("type") != "table") | ~F.lag("type", 1, "").over(w).eqNullSafe("table")
    runs = typed.withColumn("ord", F.sum(first.cast("int")).over(w))
    cells = F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))
    is_row = (F.col("type") == "table") & ~F.forall(cells, lambda c: c.rlike("^[-:]*$"))
    level = F.when(line.rlike(r"^#"), F.length(F.regexp_extract(line, "^(#+)", 1))).when(line.rlike(r"(?iu)^t[ií]tulo"), 1).when(line.rlike(HEADING), 2).otherwise(F.when(F.col("ord") == 1, 1).otherwise(2))
    text = F.when(line.rlike("^#"), F.regexp_replace(line, r"^#+\s+", "")).when((F.col("type") == "heading") & line.rlike(HEADING), F.regexp_extract(line, HEADING, 1)).otherwise(line)
    item = F.regexp_replace(line, r"^(?:[-*+]|\(?\d+\)|\d+\)|\d+\.)\s+", "")
    blocks = runs.withColumns({"level": F.when(F.col("type") == "heading", level), "body": F.when(F.col("type").isin("heading", "paragraph", "code"), text), "item": F.when(F.col("type") == "list", item), "cells": F.when(is_row, cells), "start": F.expr("try_cast(nullif(regexp_extract(line, '^\\\\(?([0-9]+)', 1), '') AS int)")})
    in_order = F.transform(F.array_sort(F.collect_list(F.when(F.col("cells").isNotNull(), F.struct("line_no", "cells")))), lambda r: r["cells"])
    return blocks.groupBy("doc_id", "ord").agg(F.min("type").alias("type"), F.min("level").alias("level"), F.min("body").alias("text"), F.min("item").alias("item"), in_order.alias("rows"), F.min(F.when(F.col("type") == "list", F.col("start"))).alias("start"))


def sections(blocks: DataFrame) -> DataFrame:
    """Headings with the nearest one before of a lower level: doc_id, ord, level, title, parent_ord."""
    headings = blocks.where("type = 'heading'").select("doc_id", "ord", "level", F.col("text").alias("title"))
    w = W.partitionBy("doc_id").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    # An open heading is the last of its level with no lower one after it; the parent is the latest open one below.
    last = {k: F.max(F.when(F.col("level") == k, F.col("ord"))).over(w) for k in range(1, 7)}
    parent = F.greatest(*(F.when(F.col("level") > k, last[k]) for k in range(1, 7)))
    return headings.withColumn("parent_ord", parent)


def skipped_levels(headings: DataFrame) -> DataFrame:
    """Headings more than one level below the one before (0 before the first)."""
    before = F.lag("level", 1, 0).over(W.partitionBy("doc_id").orderBy("ord"))
    return headings.withColumn("previous", before).where(F.col("level") > F.col("previous") + 1)


def distinct_ids(rows: DataFrame, base: str, order: str) -> DataFrame:
    """Adds id: the base, with -2, -3 and so on from its second use in a document."""
    n = F.row_number().over(W.partitionBy("doc_id", base).orderBy(order))
    return rows.withColumn("id", F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), n.cast("string"))))


def regrouped(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of a document that stand together with one key, which isn't null, become one: doc_id, run, key, first, n, text."""
    w = W.partitionBy("doc_id").orderBy(order)
    new = F.col(key).isNull() | ~F.lag(key).over(w).eqNullSafe(F.col(key))
    runs = rows.withColumn("run", F.sum(new.cast("int")).over(w))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))
    return runs.groupBy("doc_id", "run").agg(F.min(key).alias(key), F.min(order).alias("first"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text"))


def broken_order(rows: DataFrame, order: str, page: str) -> DataFrame:
    """Rows whose page is lower than one before."""
    highest = F.max(page).over(W.partitionBy("doc_id").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("highest", highest).where(F.col(page) < F.col("highest"))


def first_of_content(rows: DataFrame, order: str) -> DataFrame:
    """Of rows of a document with the same text, but for case and white space, the first."""
    marked = rows.withColumn("fingerprint", T.fingerprint(F.col("text")))
    n = F.row_number().over(W.partitionBy("doc_id", "fingerprint").orderBy(order))
    return marked.withColumn("n", n).where("n = 1").drop("n")


def repeats(rows: DataFrame, order: str, least: int = 40, before: int = 3, ratio: float = 0.9) -> DataFrame:
    """Texts of `least` letters that are as like one of the `before` such texts before as `ratio`, by matching blocks."""
    clean = rows.withColumn("clean", F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9 ]", ""))).where(F.length("clean") >= least)
    w = W.partitionBy("doc_id").orderBy(order).rowsBetween(-before, -1)
    near = clean.withColumn("earlier", F.collect_list(F.struct(F.col(order).alias("o"), F.col("clean").alias("t"))).over(w)).where(F.size("earlier") > 0)

    @F.pandas_udf("o long, ratio double")
    def like(texts: pd.Series, earlier: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([first_like(t, e, ratio) for t, e in zip(texts, earlier, strict=True)], columns=["o", "ratio"])

    return near.withColumn("m", like("clean", "earlier")).where("m.o IS NOT NULL").select("doc_id", order, F.col("m.o").alias("like"), F.round("m.ratio", 6).alias("ratio"))


def first_like(text: str, earlier, ratio: float) -> tuple[int | None, float | None]:
    for e in earlier:
        match = SequenceMatcher(None, text, e["t"])
        # two upper bounds come first: most texts aren't alike
        if match.real_quick_ratio() >= ratio and match.quick_ratio() >= ratio and (r := match.ratio()) >= ratio:
            return e["o"], r
    return None, None


#: Types that pruning leaves alone; how many blocks back a repeat is looked for.
OUTSIDE_TEXT, REACH = ("table", "math", "list", "code"), 6
#: Least letters of a key, share of common words, and share of matching letters of blocks that say the same in other words.
LONG_KEY, LIKE_WORDS, LIKE_LETTERS = 60, 0.55, 0.85


def pruned(rows: DataFrame, order: str) -> DataFrame:
    """Blocks (doc_id, order, type, text, and has_mathml if there is one) without noise and without repeats of one of the last REACH that stay.

    Of two that say the same, the less broken one stays in the place of the first, then one with MathML, then the longer. What
    stays depends on what stayed before, so a document is a row of arrays, one for each feature; noise is gone by then.
    """
    maths = F.col("has_mathml").cast("int") if "has_mathml" in rows.columns else F.lit(0)
    typed = rows.select("doc_id", F.col(order).cast("long").alias("o"), "type", F.coalesce("text", F.lit("")).alias("raw"), maths.alias("maths"), F.col("type").isin(*OUTSIDE_TEXT).alias("outside"))
    clean = typed.where(F.col("outside") | ~T.is_noise(F.col("raw"), F.col("type") == "image"))
    said = clean.withColumn("text", F.when(F.col("outside"), F.col("raw")).otherwise(T.without_process_label(F.col("raw"))))
    ready = said.withColumn("key", F.when(F.col("outside"), "").otherwise(T.comparison_key(F.col("raw"))))
    ready = ready.withColumns({"numbers": F.array_join(T.numbers_of(F.col("text")), " "), "terms": F.transform(T.terms_of(F.col("text")), lambda x: F.xxhash64(x)), "broken": T.brokenness(F.col("text"))})
    rank = F.array((-F.col("broken")).cast("int"), F.col("maths").cast("int"), F.length("text")).alias("rank")
    features = ("key", "numbers", "terms", "broken", "rank")
    listed = ready.withColumn("rank", rank).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("o", "type", "text", *features))).alias("rows"))

    def stay(keys: pd.Series, numbers: pd.Series, terms: pd.Series, broken: pd.Series, ranks: pd.Series) -> pd.Series:
        return pd.Series([staying(*row) for row in zip(keys, numbers, terms, broken, ranks, strict=True)])

    chosen = listed.select("doc_id", "rows", F.explode(F.pandas_udf(stay, "array<int>")(*(f"rows.{n}" for n in features))).alias("k"))
    return chosen.select("doc_id", F.get("rows", "k").alias("b")).select("doc_id", F.col("b.o").alias(order), "b.type", "b.text")


def letter_counts(key: str) -> np.ndarray:
    return np.bincount(np.frombuffer(key.encode(), np.uint8), minlength=128)


def staying(keys, numbers, terms, broken, ranks) -> list[int]:
    """Which rows stay, each in the place of the first that says the same; a row without a key is never a repeat."""
    slots: list[int] = []  # rows that stay
    words, counts = {}, {}

    def of(k: int) -> tuple[frozenset, np.ndarray]:
        if k not in words:
            words[k], counts[k] = frozenset(terms[k]), letter_counts(keys[k])
        return words[k], counts[k]

    def alike(a: int, b: int) -> bool:
        if keys[a] == keys[b]:
            return True
        cut_off = broken[a] != broken[b] and len(numbers[a]) != len(numbers[b])
        long_ = numbers[a] == numbers[b] and min(len(keys[a]), len(keys[b])) >= LONG_KEY
        if not cut_off and not long_:
            return False
        (x, xs), (y, ys) = of(a), of(b)
        if not x and not y:
            return False
        if len(x & y) >= LIKE_WORDS * len(x | y):
            short, whole = sorted((a, b), key=lambda k: -broken[k])
            return long_ or f"{numbers[whole]} ".startswith(f"{numbers[short]} ".lstrip())
        most = 2 * np.minimum(xs, ys).sum() / (len(keys[a]) + len(keys[b]))  # no ratio is above it
        return long_ and bool(most >= LIKE_LETTERS) and SequenceMatcher(None, keys[a], keys[b]).ratio() >= LIKE_LETTERS

    for k in range(len(keys)):
        near = range(len(slots) - 1, max(-1, len(slots) - 1 - REACH), -1) if keys[k] else ()
        place = next((p for p in near if keys[slots[p]] and alike(k, slots[p])), None)
        if place is None:
            slots.append(k)
        elif tuple(ranks[k]) > tuple(ranks[slots[place]]):
            slots[place] = k
    return slots
