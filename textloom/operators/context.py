"""What stands around a region, and where a text lies in another: context, spans, assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import layout

# ---- fixed values ----

CONTEXT_GAP, CONTEXT_LETTERS = 120.0, 400
WITHOUT_CONTEXT = ("embedded_image", "unknown")
IDENTITY_TERMS = ("cerejeira", "sakura", "ipe", "ipê", "jacaranda", "jacarandá", "orquidea", "orquídea", "rosa-do-deserto")
CONTRASTS = (
    " mas ", " porem ", " porém ", " enquanto ", " na verdade ", " entretanto ", " contudo ", " ao passo que ", " em vez de ", " ao inves de ",
    " ao invés de ", " no lugar de ", " substituido por ", " substituído por ", " foi substituido ", " foi substituído ", " quando deveria ser ",
)
SAME_ON_BOTH_SIDES = r"([\w,.\-]{1,20})\s+na\s+descri[cç][aã]o\b[^;]{0,40}?\b\1\s+na\s+imagem"
QUOTES = "\"'“”‘’"
SPECIALISTS = {"raster_text": "regiao_texto_escaneado", "formula": "regiao_formula", "visual_object": "regiao_imagem", "vector_complex": "regiao_imagem"}
LEAST_ANCHORED = 0.7


# ---- context of a region ----


def reduced_context(regions: DataFrame, gap: float = CONTEXT_GAP, letters: int = CONTEXT_LETTERS) -> DataFrame:
    """doc_id, page_num, region_idx, context: texts near a region, nearest first, until one doesn't fit into `letters`."""
    named = regions.select("doc_id", "page_num", "region_idx", "x0", "y0", "x1", "y1", F.trim(F.coalesce("text", F.lit(""))).alias("text"))
    near = layout.near_pairs(named, gap).where("b_text != ''")
    order = W.partitionBy("doc_id", "page_num", "a_region_idx").orderBy("gap", "b_region_idx")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    # a text costs its letters, and a line break after the first; costs only grow, so the first overflow ends it
    costs = near.withColumn("cost", F.sum(F.length("b_text") + 1).over(so_far) - 1).withColumn("n", F.row_number().over(order)).where(F.col("cost") <= letters)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", F.col("b_text").alias("t")))), lambda x: x["t"])
    return costs.groupBy("doc_id", "page_num", F.col("a_region_idx").alias("region_idx")).agg(F.array_join(parts, "\n").alias("context"))


def context_for(kind: Column, context: Column) -> Column:
    """None for images and unknown regions, and where nothing is near."""
    return F.when(~kind.isin(*WITHOUT_CONTEXT) & (context != ""), context)


def unconfirmed(description: Column, context: Column) -> Column:
    """Names of identity that both the description and its context have, so that the context may be where they come from."""
    listed = F.array(*map(F.lit, IDENTITY_TERMS))
    return F.filter(listed, lambda t: F.contains(F.lower(F.coalesce(description, F.lit(""))), t) & F.contains(F.lower(F.coalesce(context, F.lit(""))), t))


def cited_values(text: Column) -> Column:
    quoted = F.regexp_extract_all(text, F.lit(f"[{QUOTES}]([^{QUOTES}]{{1,60}})[{QUOTES}]"), F.lit(1))
    return F.filter(F.transform(F.concat(quoted, F.regexp_extract_all(text, F.lit(r"(?U)\b[\w\-]*\d[\w\-]*\b"), F.lit(0))), T.plain_typography), lambda v: v != "")


def contradicts_itself(claim: Column) -> Column:
    """Does a claim of a difference name the same value on both sides?"""
    low = T.plain_typography(claim)
    link = F.element_at(F.filter(F.array(*map(F.lit, CONTRASTS)), lambda c: F.contains(low, c)), 1)
    link = F.when(F.exists(F.array(*map(F.lit, CONTRASTS)), lambda c: F.contains(low, c)), link)
    values, at = cited_values(claim), F.locate(link, low) if isinstance(link, str) else F.instr(low, link)
    left, right = cited_values(F.substr(low, F.lit(1), at - 1)), cited_values(F.substr(low, at + F.length(link)))
    told = (F.size(F.array_distinct(values)) == 1) | ((F.size(right) > 0) & (F.size(F.array_except(right, left)) == 0))
    return low.rlike("(?iU)" + SAME_ON_BOTH_SIDES) | F.coalesce(link.isNotNull() & (F.size(values) >= 2) & told, F.lit(False))


def row_context(headings: Column, siblings: Column) -> Column:
    """Headings and the other cells of a row in one line."""
    told = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return F.array_join(F.concat(told(headings), told(siblings)), " · ")


def ink_bands(profile: Column, threshold: float = 0.02) -> Column:
    """How often a profile of ink rises to the threshold."""
    marked = F.transform(profile, lambda v: v >= threshold)
    return F.size(F.filter(F.zip_with(marked, F.concat(F.array(F.lit(False)), marked), lambda now, before: F.coalesce(now & ~before, F.lit(False))), lambda x: x))


def specialist(kind: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in SPECIALISTS.items() for x in kv)), kind)


# ---- a text within a text ----


def located(needle: Column, haystack: Column) -> Column:
    """Struct of start and end (from 0, exclusive) of the first place of the needle, with any white space between its letters if it isn't there as it is."""
    direct = F.instr(haystack, needle)
    bare = F.regexp_replace(needle, r"\s+", "")
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(haystack), F.lit(1))), lambda i: ~F.substr(haystack, i, F.lit(1)).rlike(r"^\s?$"))
    loose = F.instr(F.regexp_replace(haystack, r"\s+", ""), bare)
    found = F.when(direct > 0, F.struct((direct - 1).alias("start"), (direct - 1 + F.length(needle)).alias("end"))).when(
        (bare != "") & (loose > 0), F.struct((F.get(places, loose - 1) - 1).alias("start"), F.get(places, loose - 2 + F.length(bare)).alias("end"))
    )
    return F.when((needle != "") & (haystack != ""), found)


def realigned(spans: Column, text: Column, least: float = LEAST_ANCHORED) -> Column:
    """The spans (arrays of structs with text) placed in the text one after another; null if fewer than `least` of them are found."""
    told = F.filter(spans, lambda s: F.trim(s["text"]) != "")
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int,end:int>>").alias("found"))

    def step(a: Column, s: Column) -> Column:
        place = located(s["text"], F.substr(text, a["at"] + 1))["start"] + a["at"]
        end = place + F.length(s["text"])
        one = F.struct(s["text"].alias("text"), place.cast("int").alias("start"), end.cast("int").alias("end"))
        return F.when(place.isNotNull(), F.struct(end.cast("int").alias("at"), F.concat(a["found"], F.array(one)).alias("found"))).otherwise(a)

    found = F.aggregate(told, empty, step)["found"]
    return F.when((F.size(found) > 0) & (F.size(found) >= least * F.size(told)), found)


def clipped(spans: Column, start: Column, end: Column) -> Column:
    """The spans that touch a range, placed from its start; null if none does."""
    cut = F.transform(
        F.filter(spans, lambda s: (s["end"] > start) & (s["start"] < end)),
        lambda s: F.struct(s["text"].alias("text"), F.greatest(F.lit(0), s["start"] - start).alias("start"), (F.least(end, s["end"]) - start).alias("end")),
    )
    return F.when(F.size(cut) > 0, cut)


def median_size(spans: DataFrame, key: str, size: str) -> DataFrame:
    """The median of a size by key, the mean of the middle two where their number is even."""
    return spans.groupBy(key).agg(F.percentile(size, 0.5).alias("median"))


# ---- evidence and assets of a page ----


def page_evidence(regions: DataFrame) -> DataFrame:
    """A row of evidence for each region with text, with a stable id."""
    told = regions.withColumn("raw_text", T.tidy(F.coalesce("text", F.lit("")))).where("raw_text != ''")
    name = F.concat_ws("|", "doc_id", "page_num", "region_idx", "raw_text")
    return told.select("doc_id", "page_num", "region_idx", F.substring(F.sha2(name, 256), 1, 16).alias("evidence_id"), "raw_text", "x0", "y0", "x1", "y1")


def stored_once(assets: DataFrame, content: str, order: str) -> DataFrame:
    """Each different content once, by its first row, with an id of its digest."""
    named = assets.withColumn("digest", F.sha2(F.col(content), 256))
    first = named.groupBy("digest").agg(F.min_by(F.struct(*assets.columns), order).alias("a"), F.count(F.lit(1)).alias("uses"))
    return first.select(F.substring("digest", 1, 16).alias("asset_id"), "a.*", "uses")


def assigned_assets(blocks: DataFrame, assets: DataFrame, key: str, block_order: str, asset_order: str) -> DataFrame:
    """The n-th block without an asset gets the n-th asset that is not in use, within `key`."""
    n = lambda order: F.row_number().over(W.partitionBy(key).orderBy(order))
    free = assets.withColumn("n", n(asset_order)).select(key, "n", F.col(asset_order).alias("asset"))
    return blocks.withColumn("n", n(block_order)).join(free, [key, "n"]).select(key, block_order, "asset")
