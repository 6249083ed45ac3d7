"""Pieces of a page put together: formulas split over regions, spans to blocks, placed images, gaps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import layout

# ---- fixed values ----

SIGNS = "[=±√∫∑≤≥≠∞πΔ²³]"
PENDING = r"[+\-=±×·/^_<>]\s*$"
CLOSING = r"^\s*[)\]}]"
OPENING = r"[(\[{√]|\\frac|\\sqrt"
CONTINUES = r"^\s*[+\-−=±×·/^_<>)\]}]"
MONOSPACE = ("mono", "courier", "consolas", "menlo")
JOINABLE = ("formula", "text", "text_clean", "text_scanned", "unknown")
MOST_PROSE, ISOLATED_LETTERS, SIDE_GAP, LINE_GAP = 0.4, 14, 20.0, 8.0
PAGE = ["doc_id", "page_num"]


def _count(c: Column, letter: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(letter), F.lit("")))


def features(regions: DataFrame) -> DataFrame:
    """What of a region's text tells whether a formula goes on in the next one; balance: open less closed parentheses."""
    t = F.trim(F.coalesce("text", F.lit("")))
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    prose = F.when(words > 0, F.size(F.filter(F.split(t, r"\s+"), lambda w: w.rlike(r"^\p{L}{4,}$"))) / words).otherwise(0.0)
    balance = _count(t, "(") - _count(t, ")")
    signs = t.rlike(SIGNS) | t.rlike(PENDING) | (balance != 0) | t.rlike(CLOSING) | t.rlike(OPENING)
    isolated = (t != "") & (F.length(t) <= ISOLATED_LETTERS) & (prose == 0) & ~t.rlike("[=<>≤≥≠]") & t.rlike(SIGNS)
    return regions.select(
        *PAGE, "region_idx", "x0", "y0", "x1", "y1", t.alias("text"), signs.alias("signs"), isolated.alias("isolated"), prose.alias("prose"), balance.alias("balance"),
        (t.rlike(PENDING) | t.rlike(r"(?:√|\\sqrt)\s*$")).alias("pending"), t.rlike(CLOSING).alias("closing"), t.rlike(CONTINUES).alias("continues"),
    )


def _grouped_by(rows: DataFrame, order: list[str], group, columns: list[str]) -> DataFrame:
    """Adds `head`, the first of the rows that `group` puts together, for the pages that have a row with signs; others keep their own.

    The state of a fold decides, so a page is one row of arrays; most pages have no sign and stay out of it.
    """
    page = W.partitionBy(*PAGE)
    marked = rows.withColumn("hot", F.max("signs").over(page))
    listed = marked.where("hot").groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct(*order, *(c for c in columns if c not in order)))).alias("r"))

    def heads(pages: pd.Series) -> pd.Series:
        return pages.map(lambda r: group([dict(x) for x in r]))

    placed = listed.select(*PAGE, "r", F.posexplode(F.pandas_udf(heads, "array<int>")("r")).alias("k", "h"))
    found = placed.where("h >= 0").select(*PAGE, F.get("r", "k")["region_idx"].alias("region_idx"), F.get("r", "h")["region_idx"].alias("head"))
    return rows.join(found, [*PAGE, "region_idx"], "left").withColumn("head", F.coalesce("head", "region_idx"))


def _gap_down(a: dict, b: dict) -> float:
    return max(b["y0"] - a["y1"], a["y0"] - b["y1"], 0.0)


def _common_width(a: dict, b: dict) -> float:
    common, smaller = min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]), min(a["x1"] - a["x0"], b["x1"] - b["x0"])
    return common / smaller if common > 0 and smaller > 0 else 0.0


def _beside(a: dict, b: dict) -> bool:
    return min(a["y1"], b["y1"]) - max(a["y0"], b["y0"]) > -SIDE_GAP and max(b["x0"] - a["x1"], a["x0"] - b["x1"]) <= SIDE_GAP


def joined_while_open(rows: list[dict], gap: float = 40.0, overlap: float = 0.30) -> list[int]:
    """For each row the first of its group, -1 if it is in none. A group goes on while it is open and the next row, no prose, stands by it."""
    head, taken = [-1] * len(rows), 0
    told = [k for k, r in enumerate(rows) if r["text"]]
    for n, k in enumerate(told):
        if n < taken or not (rows[k]["signs"] or rows[k]["isolated"]):
            continue
        balance, pending, closing, alone, letters, end = rows[k]["balance"], rows[k]["pending"], rows[k]["closing"], rows[k]["isolated"], len(rows[k]["text"]), n
        for m in range(n + 1, len(told)):
            row, last = rows[told[m]], rows[told[end]]
            ends_open, begins_closed = pending or balance > 0, row["closing"] or row["balance"] < 0
            whole = not ends_open and not closing and balance >= 0
            goes_on = row["isolated"] or not whole and (ends_open or begins_closed)
            close = _gap_down(last, row) <= gap and _common_width(last, row) >= overlap or (row["isolated"] or alone) and _beside(last, row)
            if not goes_on or row["prose"] >= MOST_PROSE or not close:
                break
            letters += 1 + len(row["text"])
            balance, pending, alone, end = balance + row["balance"], row["pending"], alone and row["isolated"] and letters <= ISOLATED_LETTERS, m
        if end > n:
            taken = end + 1
            for m in range(n, end + 1):
                head[told[m]] = k
    return head


def formula_groups(regions: DataFrame) -> DataFrame:
    """Adds head: the first region of the formula that a region is a piece of, its own index for the rest."""
    columns = ["region_idx", "x0", "y0", "x1", "y1", "text", "signs", "isolated", "prose", "balance", "pending", "closing"]
    return _grouped_by(features(regions), ["region_idx"], joined_while_open, columns)


def merged(grouped: DataFrame) -> DataFrame:
    """Groups to one region each: the box around them, the texts in order, type formula for several, in order down the page."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("region_idx", "text"))), lambda r: r["text"])
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    made = grouped.groupBy(*PAGE, F.col("head").alias("region_idx")).agg(*box, F.trim(F.array_join(texts, " ")).alias("text"), F.count(F.lit(1)).alias("pieces"))
    down = F.row_number().over(W.partitionBy(*PAGE).orderBy("y0", "x0", "region_idx")) - 1
    return made.withColumn("ord", down).withColumn("type", F.when(F.col("pieces") > 1, "formula").otherwise("text"))


def merged_fragments(regions: DataFrame) -> DataFrame:
    """Lines of one display band first, then formulas that go on in the next region."""
    return merged(formula_groups(regions))


def joined_by_line(rows: list[dict], line_gap: float = LINE_GAP) -> list[int]:
    """The other rule: goes on while the text is open or the next row continues it, in the same or the next line and with a like font."""
    head, k = [-1] * len(rows), 0
    while k < len(rows):
        row = rows[k]
        balance, pending, end = row["balance"], row["pending"], k
        while row["type"] in JOINABLE and end + 1 < len(rows):
            last, after = rows[end], rows[end + 1]
            open_ = balance != 0 or pending or rows[k]["closing"]
            height = min(last["y1"] - last["y0"], after["y1"] - after["y0"])
            same_line = height > 0 and min(last["y1"], after["y1"]) - max(last["y0"], after["y0"]) > 0.5 * height
            next_line = 0 <= after["y0"] - last["y1"] <= line_gap
            sizes = last["size"], after["size"]
            like_font = not all(sizes) or abs(sizes[0] - sizes[1]) <= max(1.0, 0.15 * max(sizes))
            if after["type"] not in JOINABLE or not (open_ or after["continues"]) or not (same_line or next_line) or not like_font:
                break
            balance, pending, end = balance + after["balance"], after["pending"], end + 1
            if balance == 0 and not pending:
                break
        if end > k:
            head[k : end + 1] = [k] * (end + 1 - k)
        k = end + 1
    return head


def regrouped_fragments(regions: DataFrame) -> DataFrame:
    """Adds head by joined_by_line; regions need type and size (of the font, null if unknown)."""
    more = regions.select(*PAGE, "region_idx", "type", F.col("size").cast("double").alias("size"))
    rows = features(regions).join(more, [*PAGE, "region_idx"])
    return _grouped_by(rows, ["region_idx"], joined_by_line, ["region_idx", "type", "size", "x0", "y0", "x1", "y1", "text", "signs", "balance", "pending", "closing", "continues"])


# ---- regions from spans and images ----


def text_blocks(spans: DataFrame) -> DataFrame:
    """Spans (doc_id, page_num, block, line, ord, text, font, size, box) to a region a block: letters, density, mean size, lines, subtype."""
    order = F.struct("line", "ord")
    mono = F.exists(F.array(*map(F.lit, MONOSPACE)), lambda m: F.contains(F.lower("font"), m))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line", "ord", "text"))), lambda s: s["text"])
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("line") == F.col("first_line"), F.struct("ord", "text")))), lambda s: s["text"]), " ")
    lined = spans.withColumn("first_line", F.min("line").over(W.partitionBy(*PAGE, "block")))
    made = lined.groupBy(*PAGE, "block").agg(
        F.trim(F.array_join(texts, " ")).alias("text"), F.sum(F.length("text")).alias("total_chars"), F.avg("size").alias("mean"), F.count_distinct("line").alias("line_count"),
        F.bool_and(mono).alias("mono"), first.alias("first"), *(F.min(c).alias(c) for c in ("x0", "y0")), *(F.max(c).alias(c) for c in ("x1", "y1")), F.min(order).alias("o"),
    )
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    density = F.col("total_chars") / area
    subtype = F.when(F.col("mono") & (F.col("total_chars") >= 10), "code").when(T.starts_list(F.col("first")), "list").otherwise("")
    return made.where(area > 0).select(*PAGE, "block", "text", "x0", "y0", "x1", "y1", F.lit("text").alias("type"), F.least(density * 50, F.lit(1.0)).alias("confidence"), "total_chars", F.round(density, 4).alias("text_density"), F.round("mean", 1).alias("avg_font_size"), "line_count", subtype.alias("subtype"))


def placed_images(images: DataFrame) -> DataFrame:
    """Placements (doc_id, page_num, ord, xref, digest, box) once for each content and box rounded to a tenth; those without a reference or an area are none."""
    real = images.where((F.col("xref") > 0) & ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) > 0))
    key = F.coalesce(F.when(F.col("digest") != "", F.col("digest")), F.col("xref").cast("string"))
    boxed = real.withColumn("key", key).withColumns({f"r{c}": F.round(c, 1) for c in ("x0", "y0", "x1", "y1")})
    first = boxed.groupBy(*PAGE, "key", "rx0", "ry0", "rx1", "ry1").agg(F.min("ord").alias("ord"))
    return real.join(first.select(*PAGE, "ord"), [*PAGE, "ord"], "left_semi")


def page_regions(blocks: DataFrame, images: DataFrame, overlap: float = 0.60) -> DataFrame:
    """Text blocks, and those images that no other region covers by more than `overlap`, numbered in reading order."""
    box = ["x0", "y0", "x1", "y1"]
    texts = blocks.select(*PAGE, F.col("block").alias("own"), *box, F.lit("text").alias("type"), "text", "confidence")
    pictures = placed_images(images).select(*PAGE, F.col("ord").alias("own"), *box, F.lit("image").alias("type"), F.lit("").alias("text"), F.lit(1.0).alias("confidence"))
    n = F.row_number().over(W.partitionBy(*PAGE).orderBy("type", "own")).cast("int")
    every = texts.unionByName(pictures).withColumn("region_idx", n)
    met = layout.near_pairs(every.select(*PAGE, "region_idx", "type", *box), 0.0)
    hit = met.where((F.col("a_type") == "image") & (F.col("b_type") == "text") & (layout.contained_share("a_", "b_") > overlap)).select(*PAGE, F.col("a_region_idx").alias("region_idx")).distinct()
    left = every.join(hit, [*PAGE, "region_idx"], "left_anti")
    return left.join(layout.reading_order(left), [*PAGE, "region_idx"])


def gaps(regions: DataFrame, width: float, height: float, least_high: float = 20.0, least_wide: float = 30.0) -> DataFrame:
    """The empty rectangles between what the bands of a page cover: doc_id, page_num, x0, y0, x1, y1."""
    covered = layout.bands(regions).select(*PAGE, F.col("y0").alias("b0"), F.col("y1").alias("b1"), F.col("x1").alias("bx"))
    pages = regions.select(*PAGE).distinct()
    stops = covered.select(*PAGE, F.col("b1").alias("y")).unionByName(pages.select(*PAGE, F.lit(0.0).alias("y"))).unionByName(pages.select(*PAGE, F.lit(height).alias("y"))).distinct()
    down = stops.withColumn("y1", F.lead("y").over(W.partitionBy(*PAGE).orderBy("y"))).where(F.col("y1") - F.col("y") >= least_high).select(*PAGE, F.col("y").alias("y0"), "y1")
    # bands are apart and within the page, so a strip meets the one that ends where it ends, and no other
    inside = down.join(covered.withColumnRenamed("b1", "y1"), [*PAGE, "y1"]).where("b0 < y1").select(*PAGE, "y0", "y1", F.col("bx").alias("x"))
    sides = inside.unionByName(down.select(*PAGE, "y0", "y1", F.lit(0.0).alias("x"))).unionByName(down.select(*PAGE, "y0", "y1", F.lit(width).alias("x"))).distinct()
    across = sides.withColumn("x1", F.lead("x").over(W.partitionBy(*PAGE, "y0").orderBy("x"))).where(F.col("x1") - F.col("x") >= least_wide)
    return across.select(*PAGE, F.col("x").alias("x0"), "y0", "x1", "y1")
