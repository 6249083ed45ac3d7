"""Which piece of evidence a text or a box belongs to: lookups in tiers, each tier for what those before left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T

#: Labels of layout models, the first that the label contains: fixed values, in order.
LABELS = (
    ("image", ("figure", "picture", "image", "photo")), ("table", ("table",)), ("formula", ("formula", "equation", "math")), ("heading", ("heading", "title", "section")),
    ("list", ("list", "enumeration")), ("code", ("code", "source", "terminal")), ("callout", ("note", "callout", "sidebar", "quote")), ("caption", ("caption", "legend")),
)


def region_type(label: Column) -> Column:
    low = F.lower(F.coalesce(label, F.lit("")))
    hits = [(kind, reduce(Column.__or__, (F.contains(low, F.lit(w)) for w in words))) for kind, words in LABELS]
    return reduce(lambda c, h: c.when(h[1], h[0]), hits[1:], F.when(hits[0][1], hits[0][0])).otherwise("text")


def exact_key(text: Column) -> Column:
    return T.tidy(text)


def loose_key(text: Column) -> Column:
    """Letters and digits in lower case, accents off; what scanning changes least."""
    return F.regexp_replace(T.folded(text), "[^a-z0-9]", "")


def matched(texts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """texts: doc_id, key, text; catalogue: doc_id, evidence_id, text. doc_id, key, evidence_id, tier of those found.

    First by equal text, then by equal loose key, then by the shortest evidence of the document that contains the loose key.
    """
    found = []
    left = texts
    for tier, rule in ((1, exact_key), (2, loose_key)):
        known = catalogue.withColumn("k", rule(F.col("text"))).where("k != ''").groupBy("doc_id", "k").agg(F.min("evidence_id").alias("evidence_id"))
        asked = left.withColumn("k", rule(F.col("text")))
        found.append(asked.join(known, ["doc_id", "k"]).select("doc_id", "key", "evidence_id", F.lit(tier).alias("tier")))
        left = asked.join(known, ["doc_id", "k"], "left_anti").drop("k")
    whole = catalogue.select("doc_id", "evidence_id", loose_key(F.col("text")).alias("whole"))
    inside = left.withColumn("k", loose_key(F.col("text"))).where(F.length("k") >= 4).join(whole, "doc_id").where(F.contains("whole", F.col("k")))
    found.append(inside.groupBy("doc_id", "key").agg(F.min_by("evidence_id", F.struct(F.length("whole"), "evidence_id")).alias("evidence_id")).withColumn("tier", F.lit(3)))
    return reduce(DataFrame.unionByName, found)


def at_box(boxes: DataFrame, assets: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """boxes: doc_id, key, x0..y1; assets: doc_id, asset_id, x0..y1. Assets all of whose edges lie within the tolerance, the nearest first.

    Left edges meet in cells of the tolerance, of which each box asks three.
    """
    cell = lambda x: F.floor(x / tolerance)
    asked = boxes.select("doc_id", "key", *(F.col(c).alias("b" + c) for c in ("x0", "y0", "x1", "y1")), F.explode(F.sequence(cell(F.col("x0")) - 1, cell(F.col("x0")) + 1)).alias("cell"))
    known = assets.withColumn("cell", cell(F.col("x0")))
    off = F.greatest(*(F.abs(F.col(c) - F.col("b" + c)) for c in ("x0", "y0", "x1", "y1")))
    near = asked.join(known, ["doc_id", "cell"]).withColumn("off", off).where(F.col("off") <= tolerance)
    return near.groupBy("doc_id", "key").agg(F.min_by("asset_id", F.struct("off", "asset_id")).alias("asset_id"))


def latex_and_reading(text: Column) -> Column:
    """Struct of the last LATEX: and LEITURA: lines."""
    last = lambda name: F.try_element_at(F.regexp_extract_all(text, F.lit(rf"(?im)^\s*{name}:[ \t]*(.*?)\s*$"), F.lit(1)), F.lit(-1))
    return F.struct(last("LATEX").alias("latex"), last("LEITURA").alias("reading"))


def digit_place(shift: Column, font: Column, line_font: Column) -> Column:
    """super, sub or baseline: a digit raised or lowered by 0.8 whose font is under 0.9 of the line's."""
    small = (line_font > 0) & (font / F.when(line_font > 0, line_font).otherwise(1.0) < 0.9)
    return F.when((shift >= 0.8) & small, "super").when((shift <= -0.8) & small, "sub").otherwise("baseline")


def ambiguities(source: Column, complete: Column) -> Column:
    """What a reader can't decide from the signs alone."""
    radical = source.rlike(r"√\s*(?!\()[A-Za-z0-9⁰-⁹₀-₉²³Δ∆]+\s*[+\-−·×]\s*\S")
    sides = F.split(source, "/", 2)
    fraction = F.contains(source, F.lit("/")) & ~F.contains(source, F.lit(r"\frac")) & F.forall(sides, lambda s: F.size(F.filter(F.split(F.trim(s), r"\s+"), lambda w: w != "")) > 1)
    found = F.array(F.when(radical, "escopo_do_radical"), F.when(fraction, "fracao_em_linha_unica"), F.when(~complete, "trecho_nao_interpretado"))
    return F.filter(found, lambda a: a.isNotNull())
