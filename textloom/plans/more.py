"""More named queries: context, fragments, documents, coherence, LaTeX and verdicts over the driver's tables.

The SQL spells its words and limits out for itself, so that a wrong value in the library shows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import expressions as X
from textloom.functions import latex as L
from textloom.functions import maths, tables
from textloom.functions import semantics as S
from textloom.functions import text as T
from textloom.functions import vocabulary as V
from textloom.operators import blocks, coherence, context, formulas, fragments, layout
from textloom.operators import documents as D
from textloom.plans.catalog import _LINES, _REGIONS, ORACLE, documents, equations, query, table
from textloom.sources import render

#: Line items numbered within their order without ties.
_LI = "li AS (SELECT * REPLACE ((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice))::INT AS l_linenumber) FROM lineitem)"
_SPANS = f"{_LI}, s AS (SELECT l_orderkey AS doc_id, 0 AS page_num, l_linenumber AS ord, l_suppkey % 3 AS block, l_linenumber % 2 AS line, l_shipmode_text AS text, font, l_quantity AS size, l_linenumber * 10.0 AS x0, l_quantity AS y0, l_linenumber * 10.0 + l_tax * 100 AS x1, l_quantity + 5 AS y1 FROM (SELECT *, l_returnflag || ' ' || l_linestatus || '-' || l_partkey AS l_shipmode_text, CASE WHEN l_returnflag = 'A' THEN 'Courier New' ELSE 'Times' END AS font FROM li))"


def lines_of_orders(spark, sf_dir):
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    return table(spark, sf_dir, "lineitem").withColumn("l_linenumber", n)


def spans(spark, sf_dir):
    """Line items as spans of text: an order is a page, a supplier's remainder a block."""
    n = F.col("l_linenumber")
    return lines_of_orders(spark, sf_dir).select(
        F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_num"), n.alias("ord"), (F.col("l_suppkey") % 3).alias("block"), (n % 2).alias("line"),
        F.concat("l_returnflag", F.lit(" "), "l_linestatus", F.lit("-"), F.col("l_partkey").cast("string")).alias("text"), F.when(F.col("l_returnflag") == "A", "Courier New").otherwise("Times").alias("font"),
        F.col("l_quantity").alias("size"), (n * 10.0).alias("x0"), F.col("l_quantity").alias("y0"), (n * 10.0 + F.col("l_tax") * 100).alias("x1"), (F.col("l_quantity") + 5).alias("y1"),
    )


# ---- context ----


@query("agg8_median_sizes", "SELECT l_orderkey AS doc_id, median(l_quantity)::DOUBLE AS median FROM lineitem GROUP BY l_orderkey")
def agg8_median_sizes(spark, sf_dir):
    return context.median_size(spans(spark, sf_dir), "doc_id", "size")


@query("jon11_reduced_context", f"""WITH {_REGIONS}, t AS (SELECT *, trim(text) AS t FROM r),
p AS (SELECT a.doc_id, a.region_idx, b.region_idx AS other, b.t, greatest(a.y0 - b.y1, b.y0 - a.y1, 0.0) AS gap FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.region_idx <> b.region_idx AND abs(a.region_idx - b.region_idx) <= 12 WHERE b.t <> ''),
n AS (SELECT *, sum(length(t) + 1) OVER (PARTITION BY doc_id, region_idx ORDER BY gap, other ROWS UNBOUNDED PRECEDING) - 1 AS cost FROM p WHERE gap <= 120)
SELECT doc_id, 0 AS page_num, region_idx::INT AS region_idx, md5(string_agg(t, chr(10) ORDER BY gap, other)) AS digest FROM n WHERE cost <= 400 GROUP BY doc_id, region_idx""")
def jon11_reduced_context(spark, sf_dir):
    return context.reduced_context(layout.line_regions(documents(spark, sf_dir))).select("doc_id", "page_num", "region_idx", F.md5("context").alias("digest"))


_NAMES = "n AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS w FROM part)"


@query("jon16_located", f"WITH {_NAMES}, h AS (SELECT p_partkey, p_name AS needle, CASE p_partkey % 3 WHEN 0 THEN 'x ' || p_name WHEN 1 THEN 'x ' || replace(p_name, ' ', '  ') ELSE 'nothing here' END AS hay FROM n) SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE 2 END::INT AS start, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE length(hay) END::INT AS \"end\" FROM h")
def jon16_located(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    hay = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('x ', p_name) WHEN 1 THEN concat('x ', replace(p_name, ' ', '  ')) ELSE 'nothing here' END")
    return part.select("p_partkey", context.located(F.col("p_name"), hay).alias("at")).select("p_partkey", F.col("at.start").cast("int").alias("start"), F.col("at.end").cast("int").alias("end"))


@query("jon17_realigned", f"WITH {_NAMES} SELECT p_partkey, len(w)::INT AS n, (length(p_name) + 4)::INT AS last FROM n WHERE p_partkey % 2 = 0 AND len(list_filter(w, lambda x: x <> '')) > 0")
def jon17_realigned(spark, sf_dir):
    """The words of a name as spans, in a text that has the name after another word, or doesn't."""
    words = F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("text")))
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("... "), F.col("p_name"))).otherwise("0")
    found = table(spark, sf_dir, "part").select("p_partkey", context.realigned(words, text).alias("s")).where("s IS NOT NULL")
    return found.select("p_partkey", F.size("s").alias("n"), F.element_at("s", -1)["end"].alias("last"))


@query("jon18_clipped", "SELECT l_orderkey, count(*)::INT AS n, min(greatest(0, l_linenumber * 10 - 25))::INT AS first, max(least(45, l_linenumber * 10 + 8) - 25)::INT AS last FROM lineitem WHERE l_linenumber * 10 < 45 AND l_linenumber * 10 + 8 > 25 GROUP BY l_orderkey")
def jon18_clipped(spark, sf_dir):
    listed = F.sort_array(F.collect_list(F.struct((F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + 8).alias("end"), F.col("l_returnflag").alias("text"))))
    cut = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(context.clipped(listed, F.lit(25), F.lit(45)).alias("s")).where("s IS NOT NULL")
    return cut.select("l_orderkey", F.size("s").alias("n"), F.array_min(F.transform("s", lambda x: x["start"])).alias("first"), F.array_max(F.transform("s", lambda x: x["end"])).alias("last"))


@query("jon21_assigned_assets", f"WITH {_LI}, b AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM li WHERE l_returnflag = 'R'), a AS (SELECT l_orderkey, l_linenumber AS asset, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM li WHERE l_returnflag <> 'R') SELECT l_orderkey, l_linenumber, asset FROM b JOIN a USING (l_orderkey, n)")
def jon21_assigned_assets(spark, sf_dir):
    lines = lines_of_orders(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_returnflag")
    free = lines.where("l_returnflag != 'R'").select("l_orderkey", F.col("l_linenumber").alias("place"))
    return context.assigned_assets(lines.where("l_returnflag = 'R'"), free, "l_orderkey", "l_linenumber", "place")


@query("jon26_row_context", "SELECT l_orderkey, l_linenumber, 'flag · status · ' || l_returnflag || ' · ' || l_linestatus AS context FROM lineitem")
def jon26_row_context(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", context.row_context(F.array(F.lit("flag "), F.lit(" "), F.lit("status")), F.array("l_returnflag", F.lit(None).cast("string"), "l_linestatus")).alias("context"))


@query("cls12_ink_bands", f"WITH {_LI}, o AS (SELECT l_orderkey, l_linenumber, l_tax >= 0.04 AS dark FROM li), e AS (SELECT *, lag(dark) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS before FROM o) SELECT l_orderkey, count_if(dark AND NOT coalesce(before, false))::INT AS bands FROM e GROUP BY l_orderkey")
def cls12_ink_bands(spark, sf_dir):
    profile = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_tax"))), lambda x: x["l_tax"])
    return lines_of_orders(spark, sf_dir).groupBy("l_orderkey").agg(context.ink_bands(profile, 0.04).alias("bands"))


@query("cls13_specialists", "SELECT event_id, CASE event_type WHEN 'click' THEN 'regiao_formula' WHEN 'view' THEN 'regiao_imagem' END AS specialist FROM events")
def cls13_specialists(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "formula").when(F.col("event_type") == "view", "vector_complex").otherwise("blank")
    return table(spark, sf_dir, "events").select("event_id", context.specialist(kind).alias("specialist"))


@query("cls21_context_for", "SELECT event_id, CASE WHEN event_type = 'click' OR event_id % 4 = 0 THEN NULL ELSE event_type END AS context FROM events")
def cls21_context_for(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "embedded_image").otherwise("text")
    return table(spark, sf_dir, "events").select("event_id", context.context_for(kind, F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("event_type"))).alias("context"))


@query("cls22_unconfirmed", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END::INT AS n FROM conversations")
def cls22_unconfirmed(spark, sf_dir):
    description, around = F.concat(F.coalesce("text", F.lit("")), F.lit(" uma Cerejeira")), F.when(F.col("turn") % 2 == 0, "a CEREJEIRA em flor").otherwise("uma árvore")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(context.unconfirmed(description, around)).alias("n"))


@query("cls23_contradictions", "SELECT p_partkey, p_size % 3 = 0 OR p_partkey % 4 = 0 AS contradicts FROM part")
def cls23_contradictions(spark, sf_dir):
    """A claim that quotes a size twice, the same or another; or tells one value of the description and of the picture."""
    n = F.col("p_size").cast("string")
    other = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("‘"), n, F.lit("’"))).otherwise(F.concat(F.lit("'"), n, F.lit("1'")))
    claim = F.when(F.col("p_partkey") % 4 == 0, F.concat(n, F.lit(" na descrição e "), n, F.lit(" na imagem"))).otherwise(F.concat(F.lit('O texto diz "'), n, F.lit('" mas a figura diz '), other))
    return table(spark, sf_dir, "part").select("p_partkey", context.contradicts_itself(claim).alias("contradicts"))


@query("src12_page_evidence", f"WITH {_REGIONS} SELECT doc_id, region_idx::INT AS region_idx, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS raw_text FROM r WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''")
def src12_page_evidence(spark, sf_dir):
    return context.page_evidence(layout.line_regions(documents(spark, sf_dir))).select("doc_id", "region_idx", "raw_text")


@query("src22_stored_once", "SELECT substr(sha256(html), 1, 16) AS asset_id, min(page_id) AS page_id, count(*)::BIGINT AS uses FROM pages WHERE html IS NOT NULL GROUP BY html")
def src22_stored_once(spark, sf_dir):
    return context.stored_once(table(spark, sf_dir, "pages").where("html IS NOT NULL"), "html", "page_id").select("asset_id", "page_id", "uses")


# ---- fragments ----


@query("src7_text_blocks", f"""WITH {_SPANS}, b AS (SELECT doc_id, block, trim(string_agg(text, ' ' ORDER BY line, ord)) AS text, sum(length(text))::BIGINT AS total_chars, avg(size) AS mean, count(DISTINCT line)::BIGINT AS line_count, bool_and(font = 'Courier New') AS mono, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM s GROUP BY doc_id, block)
SELECT doc_id, block, text, total_chars, line_count, CASE WHEN mono AND total_chars >= 10 THEN 'code' ELSE '' END AS subtype FROM b WHERE (x1 - x0) * (y1 - y0) > 0""")
def src7_text_blocks(spark, sf_dir):
    return fragments.text_blocks(spans(spark, sf_dir)).select("doc_id", "block", "text", "total_chars", "line_count", "subtype")


_IMAGES = f"{_LI}, i AS (SELECT l_orderkey AS doc_id, 0 AS page_num, l_linenumber AS ord, l_suppkey % 4 AS xref, CASE WHEN l_returnflag = 'A' THEN '' ELSE l_returnflag END AS digest, 0.0 AS x0, (l_suppkey % 2) * 100.0 AS y0, CASE WHEN l_linestatus = 'F' THEN 50.04 ELSE 50.0 END AS x1, (l_suppkey % 2) * 100.0 + 50 AS y1 FROM li)"


def images(spark, sf_dir):
    y = (F.col("l_suppkey") % 2) * 100.0
    return lines_of_orders(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_num"), F.col("l_linenumber").alias("ord"), (F.col("l_suppkey") % 4).alias("xref"), F.when(F.col("l_returnflag") == "A", "").otherwise(F.col("l_returnflag")).alias("digest"), F.lit(0.0).alias("x0"), y.alias("y0"), F.when(F.col("l_linestatus") == "F", 50.04).otherwise(50.0).alias("x1"), (y + 50).alias("y1"))


@query("src8_placed_images", f"WITH {_IMAGES} SELECT doc_id, min(ord)::INT AS ord FROM i WHERE xref > 0 GROUP BY doc_id, CASE WHEN digest <> '' THEN digest ELSE xref::VARCHAR END, y0")
def src8_placed_images(spark, sf_dir):
    return fragments.placed_images(images(spark, sf_dir)).select("doc_id", F.col("ord").cast("int").alias("ord"))


@query("src9_gaps", """WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber * 100.0 + 40 AS b1, l_linenumber * 100.0 AS b0 FROM lineitem),
s AS (SELECT doc_id, b1 AS y FROM l UNION SELECT doc_id, 0.0 FROM l UNION SELECT doc_id, 1000.0 FROM l), d AS (SELECT doc_id, y AS y0, lead(y) OVER (PARTITION BY doc_id ORDER BY y) AS y1 FROM s),
o AS (SELECT d.*, EXISTS (SELECT 1 FROM l WHERE l.doc_id = d.doc_id AND b0 < y1 AND b1 > y0) AS hit FROM d WHERE y1 - y0 >= 20)
SELECT doc_id, 0.0::DOUBLE AS x0, y0::DOUBLE AS y0, CASE WHEN hit THEN 300.0 ELSE 600.0 END::DOUBLE AS x1, y1::DOUBLE AS y1 FROM o UNION ALL SELECT doc_id, 300.0::DOUBLE, y0::DOUBLE, 600.0::DOUBLE, y1::DOUBLE FROM o WHERE hit""")
def src9_gaps(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_num"), F.col("l_linenumber").alias("region_idx"), F.lit(0.0).alias("x0"), (F.col("l_linenumber") * 100.0).alias("y0"), F.lit(300.0).alias("x1"), (F.col("l_linenumber") * 100.0 + 40).alias("y1"))
    return fragments.gaps(rows, 600.0, 1000.0).select("doc_id", "x0", "y0", "x1", "y1")


# ---- documents ----


@query("txt48_screen_reader", "SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(coalesce(text, '') || chr(10) || chr(10) || chr(10) || 'x  y', '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS digest FROM conversations")
def txt48_screen_reader(spark, sf_dir):
    longer = F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n\nx\U0001f600  y"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(D.for_screen_reader(longer)).alias("digest"))


@query("cls26_structured", "SELECT conv_id, turn, (turn % 3 = 0) AS structured FROM conversations")
def cls26_structured(spark, sf_dir):
    text = F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), r"[|:<]", " "), F.when(F.col("turn") % 3 == 0, "\n Leitura : x").otherwise(" leitura : x"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", D.looks_structured(text).alias("structured"))


@query("win22_short_references", "WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '[verificacao incerta] A imagem mostra ' || p_name || ': detalhe. fim' WHEN 1 THEN p_name || '. fim' WHEN 2 THEN 'LATEX: x' ELSE 'a|b' END AS d, p_name FROM part) SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN 'Aparece novamente: ' || upper(substr(p_name, 1, 1)) || substr(p_name, 2) || '.' ELSE 'O mesmo elemento visual aparece novamente.' END AS said FROM t")
def win22_short_references(spark, sf_dir):
    told = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('[verificacao incerta] A imagem mostra ', p_name, ': detalhe. fim') WHEN 1 THEN concat(p_name, '. fim') WHEN 2 THEN 'LATEX: x' ELSE 'a|b' END")
    return table(spark, sf_dir, "part").select("p_partkey", coherence.short_reference(told).alias("said"))


@query("txt29_marked", "SELECT event_id, CASE event_type WHEN 'click' THEN 'Início de código-fonte:' || chr(10) || 'x' || chr(10) || 'Fim de código-fonte' WHEN 'view' THEN 'Início de dica:' || chr(10) || 'x' || chr(10) || 'Fim de dica' ELSE 'x' END AS text FROM events")
def txt29_marked(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "code_block").when(F.col("event_type") == "view", "callout_box").otherwise("text")
    return table(spark, sf_dir, "events").select("event_id", D.marked(F.lit("x"), kind, F.when(F.col("event_type") != "click", "tip")).alias("text"))


@query("txt46_described_parts", "SELECT p_partkey, i - 1 AS ord, k[i] AS kind, t[i] AS text FROM (SELECT p_partkey, ['h2', 'bullet', 'number', 'text', 'description', 'text', 'description'] AS k, [p_brand, p_name, p_type, 'antes', p_name, 'depois', p_brand || chr(10) || 'mais'] AS t FROM part), unnest(range(1, 8)) AS u(i)")
def txt46_described_parts(spark, sf_dir):
    text = F.concat(F.lit("## "), "p_brand", F.lit("\n\n- "), "p_name", F.lit("\n12. "), "p_type", F.lit("\nantes [Descrição: "), "p_name", F.lit("] depois\n\n\n[DESCRIÇÃO:  "), "p_brand", F.lit("\nmais ]"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(D.described_parts(text)).alias("ord", "p"))
    return parts.select("p_partkey", F.col("ord").cast("long").alias("ord"), "p.kind", "p.text")


@query("txt17_maths_cells", f"WITH {_LI}, l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS row, l_quantity > 25 AS maths FROM li) SELECT l_orderkey, row::INT AS row, 1 AS col FROM l WHERE maths")
def txt17_maths_cells(spark, sf_dir):
    line = F.array(F.lit("texto simples"), F.when(F.col("l_quantity") > 25, "x = 2").otherwise("palavra"))
    rows = F.concat(F.array(F.array(F.lit("y = 1"), F.lit("z = 3"))), F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("r")))), lambda x: x["r"]))
    return D.maths_cells(lines_of_orders(spark, sf_dir).groupBy("l_orderkey").agg(rows.alias("rows")), "l_orderkey")


@query("txt18_first_explanations", f"WITH {_LI}, b AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, l_returnflag AS name FROM li), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY ord) AS k FROM b) SELECT doc_id, ord, CASE WHEN k = 1 THEN 'porque ' || name END AS explanation, k > 1 AS suppressed FROM n")
def txt18_first_explanations(spark, sf_dir):
    flag = F.col("l_returnflag")
    rows = lines_of_orders(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), F.when(flag == "A", "").otherwise(flag).alias("latex"), flag.alias("source_text"), F.concat(F.lit("porque "), flag).alias("explanation"))
    return D.first_explanations(rows).select("doc_id", "ord", "explanation", "suppressed")


@query("txt16_paragraph_blocks", "SELECT p_partkey, u.part::INT AS part, u.type, u.text FROM (SELECT p_partkey, p_name, [{part: 0, type: 'paragraph', text: 'A soma é'}, {part: 1, type: 'math', text: 'x = ' || p_size}, {part: 2, type: 'paragraph', text: 'e cresce ' || p_name || '.'}] AS l FROM part), unnest(l) AS t(u)")
def txt16_paragraph_blocks(spark, sf_dir):
    text = F.concat(F.lit("A soma é x = "), F.col("p_size").cast("string"), F.lit(" e cresce "), "p_name", F.lit("."))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))
    return D.paragraph_blocks(rows, ["p_partkey"], "text").select("p_partkey", "part", "type", "text")


@query("txt19_canonical", "SELECT doc_id, 'Documento ' || doc_id AS title, length(coalesce(text, ''))::INT AS input_length FROM documents")
def txt19_canonical(spark, sf_dir):
    docs = documents(spark, sf_dir)
    given = docs.select("doc_id", "text", F.concat(F.lit("Documento "), F.col("doc_id").cast("string")).alias("title"))
    return D.canonical(blocks.parsed(docs), given).select("doc_id", "title", "input_length")


@query("txt21_sanitised", f"WITH {_LINES} SELECT doc_id, line_no::INT AS line_no, 'forte ' || md5(line) AS text FROM lines")
def txt21_sanitised(spark, sf_dir):
    lines = blocks.lines_of(documents(spark, sf_dir)).select("doc_id", "line_no", F.lit("paragraph").alias("type"), F.concat(F.lit("**forte** `"), F.md5("line"), F.lit("`")).alias("text"))
    return D.sanitised(lines).select("doc_id", "line_no", "text")


@query("src43_axes", "SELECT p_partkey, '<ul class=\"eixos-do-grafico\"><li>Eixo horizontal: ' || p_brand || ', em cm, de 0 a ' || p_size || '.</li></ul>' AS axes FROM part")
def src43_axes(spark, sf_dir):
    axis = F.struct(F.col("p_brand").alias("label"), F.lit("cm").alias("unit"), F.lit(0).alias("min"), F.col("p_size").alias("max"), F.lit(None).cast("int").alias("step"))
    return table(spark, sf_dir, "part").select("p_partkey", D.axes_list(F.create_map(F.lit("x"), axis)).alias("axes"))


@query("src36_any_text", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN props ELSE '' END AS text FROM events")
def src36_any_text(spark, sf_dir):
    tried = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(" ").alias("a"), F.when(F.col("event_id") % 3 != 2, F.col("props")).alias("b"))
    return tried.select("event_id", D.any_text("a", "b").alias("text"))


@query("src33_pending_reports", f"WITH {_LI}, p AS (SELECT l_orderkey AS doc_id, count(*) AS n, string_agg('  ' || k || '. x = ' || l_linenumber || chr(10) || '     status=' || l_linestatus || ' codigos=' || CASE WHEN l_returnflag = 'R' THEN 'R, S' ELSE '-' END, chr(10) ORDER BY l_linenumber) AS t FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM li) GROUP BY l_orderkey) SELECT doc_id, md5('PENDENCIAS DE PUBLICACAO' || chr(10) || repeat('=', 60) || chr(10) || chr(10) || 'Documento: d' || doc_id || chr(10) || 'Status: blocked' || chr(10) || 'Rotulo: ' || chr(10) || chr(10) || 'Este material NAO foi aprovado como versao acessivel final.' || chr(10) || 'Ele foi gerado apenas para revisao humana.' || chr(10) || chr(10) || 'EXPRESSOES AGUARDANDO REVISAO (' || n || ')' || chr(10) || repeat('-', 60) || chr(10) || t) AS digest FROM p")
def src33_pending_reports(spark, sf_dir):
    lines = lines_of_orders(spark, sf_dir)
    pending = lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("x = "), F.col("l_linenumber").cast("string")).alias("source_text"), F.col("l_linestatus").alias("review_status"), F.when(F.col("l_returnflag") == "R", F.array(F.lit("R"), F.lit("S"))).otherwise(F.array().cast("array<string>")).alias("codes"))
    decisions = lines.select(F.col("l_orderkey").alias("doc_id")).distinct().select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.lit("blocked").alias("status"), F.lit(None).cast("string").alias("label"), F.array().cast("array<string>").alias("blockers"))
    return D.pending_report(decisions, pending).select("doc_id", F.md5("report").alias("digest"))


# ---- coherence and verdicts ----


@query("agg21_lost_images", "SELECT l_orderkey AS doc_id, l_linenumber AS ord FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity <= 25")
def agg21_lost_images(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), F.when(F.col("l_returnflag") == "R", "image").otherwise("paragraph").alias("type"), (F.col("l_linestatus") != "F").alias("decorative"), F.when(F.col("l_quantity") > 25, "uma foto").alias("alt_text"), F.lit(" ").alias("long_description"), F.lit(None).cast("string").alias("text"))
    return coherence.lost_images(rows)


@query("agg19_coherence", "WITH f AS (SELECT l_orderkey AS doc_id, count_if(l_returnflag = 'R') AS errors, count_if(l_returnflag = 'A') AS warnings, sum(l_quantity)::BIGINT AS out_words, count(*) AS source_words FROM lineitem GROUP BY l_orderkey), r AS (SELECT *, round(out_words / source_words, 2) AS ratio FROM f) SELECT doc_id, errors::BIGINT AS errors, (warnings + (ratio > 4)::INT)::BIGINT AS warnings, ratio, errors = 0 AS coherent FROM r")
def agg19_coherence(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    found = lines.where("l_returnflag IN ('R', 'A')").select(F.col("l_orderkey").alias("doc_id"), F.lit("x").alias("check"), F.when(F.col("l_returnflag") == "R", "ERROR").otherwise("WARNING").alias("severity"))
    words = lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.sum("l_quantity").cast("long").alias("out_words"), F.count(F.lit(1)).alias("source_words"))
    return coherence.coherence(found, words)


@query("txt38_verdicts", "SELECT p_partkey, p_partkey % 3 = 0 AS same, CASE WHEN p_partkey % 3 = 0 THEN 'a' ELSE 'ambos' END AS keep, CASE WHEN p_partkey % 3 = 2 THEN 0.0 ELSE 0.9 END::DOUBLE AS confidence FROM part")
def txt38_verdicts(spark, sf_dir):
    """A name against itself broken off, with another number, or as it is."""
    a = F.concat(F.lit("valor "), F.col("p_size").cast("string"))
    b = F.when(F.col("p_partkey") % 3 == 0, F.concat(a, F.lit(" é igual a"))).when(F.col("p_partkey") % 3 == 1, F.concat(a, F.lit("1"))).otherwise(a)
    return table(spark, sf_dir, "part").select("p_partkey", coherence.verdict(a, b).alias("v")).select("p_partkey", "v.same", "v.keep", "v.confidence")


@query("txt39_read_verdicts", "SELECT event_id, event_id % 2 = 0 AS same, CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'a' ELSE 'ambos' END ELSE 'ambos' END AS keep, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE 0.75 END::DOUBLE AS confidence, event_type AS reason FROM events")
def txt39_read_verdicts(spark, sf_dir):
    e = F.col("event_id")
    answer = F.concat(F.lit("ruido\nMESMO: talvez\n mesmo: "), F.when(e % 2 == 0, "Sim").otherwise("nao"), F.lit("\nMANTER: "), F.when(e % 3 == 0, "a").otherwise("ambos"), F.lit("\nConfianca: "), F.when(e % 5 == 0, "muita").otherwise("0,75"), F.lit("\nMOTIVO: "), "event_type")
    return table(spark, sf_dir, "events").select("event_id", coherence.read_verdict(answer).alias("v")).select("event_id", "v.*")


@query("txt37_first_objects", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{\"a\":{\"b\":\"' || event_type || '\"},\"c\":[1]}' WHEN 1 THEN '{\"a\":[1,{\"b\":\"' || event_type || '\"}]}' END AS json FROM events")
def txt37_first_objects(spark, sf_dir):
    """A whole object within prose, one that is cut off, or none."""
    e = F.col("event_id") % 3
    text = F.when(e == 0, F.concat(F.lit('veja ```json {"c": [1], "a": {"b": "'), "event_type", F.lit('"}} e "x" {"d": 1}'))).when(e == 1, F.concat(F.lit('{"a": [1, {"b": "'), "event_type")).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", coherence.first_object(text).alias("json"))


@query("val32_unspoken_structures", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'frac' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN ',potencia' ELSE '' END AS missing FROM part")
def val32_unspoken_structures(spark, sf_dir):
    reading = F.concat(F.when(F.col("p_partkey") % 2 == 0, "x e y").otherwise("x sobre y"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(" ao Quadrado"))
    missing = coherence.unspoken_structures(F.lit(r"\frac{x}{y^2}"), reading)
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.when(F.array_contains(missing, "frac"), "frac").otherwise(""), F.when(F.array_contains(missing, "potencia"), ",potencia").otherwise("")).alias("missing"))


@query("val35_cells_against_context", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'discriminante' WHEN p_partkey % 3 = 1 THEN 'produto,ordinal' ELSE '' END AS broken FROM part")
def val35_cells_against_context(spark, sf_dir):
    k = F.col("p_partkey") % 3
    said, around = F.when(k == 0, "b ao quadrado").when(k == 1, "a segunda a").otherwise("delta é menos b"), F.when(k == 1, "duas vezes o coeficiente").when(k == 0, "o Discriminante").otherwise("o discriminante, oposto de b")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(coherence.against_context(said, around), ",").alias("broken"))


@query("val37_conflicts_with_text", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'expoente_divergente:3,' ELSE '' END || CASE WHEN p_size <> 7 THEN 'resultado_divergente:7' ELSE '' END AS conflicts FROM part")
def val37_conflicts_with_text(spark, sf_dir):
    around = F.concat(F.when(F.col("p_partkey") % 2 == 0, "elevado a três").otherwise("ao quadrado"), F.lit(" e é igual a sete"))
    found = coherence.conflicts_with_text(around, F.array(F.lit(2)), F.array(F.col("p_size").cast("int")))
    told = F.transform(found, lambda c: F.concat(c["kind"], F.lit(":"), c["value"].cast("string"), F.when(c["kind"] == "expoente_divergente", ",").otherwise("")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(told, "").alias("conflicts"))


@query("val38_formats_apart", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'raiz:omml' WHEN p_partkey % 3 = 0 THEN 'numero:' || p_size ELSE '' END AS apart FROM part")
def val38_formats_apart(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    mathml = F.concat(F.lit("<msqrt><mn>"), F.when((k % 2 != 0) & (k % 3 == 0), "x").otherwise(n), F.lit("</mn></msqrt>"))
    apart = coherence.formats_apart(F.concat(F.lit(r"\sqrt{"), n, F.lit("}")), mathml, F.when(k % 2 == 0, "<m:oMath/>").otherwise("<m:rad/>"), F.lit("raiz quadrada de"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(apart, ",").alias("apart"))


@query("exp46_forbidden", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'cadeia_de_igualdade,termos_alterados' WHEN 1 THEN 'operador_inserido' WHEN 2 THEN 'explicacao_na_fala,confianca_sem_evidencia,fala_sem_arvore' ELSE '' END AS broken FROM events")
def exp46_forbidden(spark, sf_dir):
    e = F.col("event_id") % 4
    none = F.array().cast("array<string>")
    source, span = F.when(e == 0, "a = b = 2").otherwise("a 2"), F.when(e == 0, "a = b").when(e == 1, "a + 2").when(e == 2, "").otherwise("a + 2")
    found = coherence.forbidden(source, span, F.when(e == 2, "Portanto é dois").otherwise(""), F.when(e == 3, F.array(F.lit("ok"))).otherwise(none), none, F.when(e == 2, 1.0).otherwise(0.5), F.lit(False), F.lit(""))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(found, ",").alias("broken"))


@query("val42_first_losses", f"WITH {_LI}, e AS (SELECT l_orderkey, l_linenumber, l_returnflag || l_linenumber AS stage, l_returnflag = 'R' OR l_quantity > 45 AS bad FROM li) SELECT l_orderkey, min_by(stage, l_linenumber) AS stage FROM e WHERE bad GROUP BY l_orderkey")
def val42_first_losses(spark, sf_dir):
    events = lines_of_orders(spark, sf_dir).select("l_orderkey", F.col("l_linenumber").alias("seq"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("stage"), (F.col("l_returnflag") == "R").alias("lost"), (F.col("l_quantity") > 45).cast("int").alias("issues"))
    return coherence.first_loss(events, "l_orderkey")


@query("agg16_rates", "WITH t AS (SELECT l_linenumber AS candidates, l_quantity > 20 AS complete, l_tax > 0.05 AS called, l_discount < 0.05 AS plausible, l_returnflag AS f, l_linestatus AS s, l_partkey % 50 AS h, l_suppkey % 2 AS w FROM lineitem), c AS (SELECT count(*) AS n FROM (SELECT h FROM t GROUP BY h HAVING count(DISTINCT w) > 1)) SELECT count(*)::BIGINT AS expressions, sum(candidates)::BIGINT AS math_candidates_total, round(avg(complete::INT), 4) AS math_parse_success_rate, round(avg(called::INT), 4) AS context_resolver_call_rate, round(avg((f = 'A')::INT), 4) AS symbol_loss_rate, round(avg((NOT plausible)::INT), 4) AS boundary_repair_rate, round(avg((f = 'R')::INT), 4) AS speech_validation_failure_rate, round(avg((f = 'N')::INT), 4) AS renderer_regression_rate, round(avg((s = 'O')::INT), 4) AS human_review_rate, (SELECT n FROM c)::BIGINT AS formula_consistency_conflicts FROM t")
def agg16_rates(spark, sf_dir):
    checks = F.when(F.col("l_returnflag") == "A", F.array(F.lit("validar_menos"), F.lit("outro"))).when(F.col("l_returnflag") == "R", F.array(F.lit("fala_com_lacuna"))).otherwise(F.array(F.lit("validar_tabela")))
    trails = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("candidates"), (F.col("l_quantity") > 20).alias("complete"), (F.col("l_tax") > 0.05).alias("context_called"), (F.col("l_discount") < 0.05).alias("plausible"), checks.alias("checks"),
        F.when(F.col("l_linestatus") == "O", "draft").otherwise("approved").alias("review_status"), (F.col("l_partkey") % 50).cast("string").alias("ast_hash"), (F.col("l_suppkey") % 2).cast("string").alias("speech"),
    )
    return coherence.rates(trails)


# ---- LaTeX and lines in words ----


@query("exp8_normalised", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'x^{' || p_size || '} \\pm \\sqrt{' || p_size || '}' WHEN 1 THEN 'y = \\frac{a + ' || p_size || '}{2b}' WHEN 2 THEN '\\left(x + 1\\right)^{2} + x_{12}' ELSE 'a \\geq ' || p_size || ' x^{2} + 1' END AS latex FROM part")
def exp8_normalised(spark, sf_dir):
    n = F.col("p_size").cast("string")
    raised = F.translate(n, "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")
    k = F.col("p_partkey") % 4
    source = F.when(k == 0, F.concat(F.lit("x"), raised, F.lit(" ± √"), n)).when(k == 1, F.concat(F.lit("y = (a + "), n, F.lit(")/2b"))).when(k == 2, F.lit("(x + 1)² + x₁₂")).otherwise(F.concat(F.lit("a ≥ "), n, F.lit(" x 2 + 1")))
    return table(spark, sf_dir, "part").select("p_partkey", L.normalised(source).alias("latex"))


@query("exp9_fractions", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '\\frac{a}{' || p_size || '} + \\frac{b}{c}' WHEN 1 THEN '\\frac{(a + b)(c)}{2}' ELSE '\\frac{\\frac{a}{b}}{' || p_size || '}' END AS latex FROM part WHERE p_partkey % 3 <> 1")
def exp9_fractions(spark, sf_dir):
    n = F.col("p_size").cast("string")
    source = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("a/"), n, F.lit(" + b / c"))).otherwise(F.concat(F.lit("a/b/"), n))
    return table(spark, sf_dir, "part").where("p_partkey % 3 != 1").select("p_partkey", L.slashes_as_fractions(source).alias("latex"))


@query("voc17_precedence", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 40 WHEN 1 THEN 45 WHEN 2 THEN 40 END::INT AS level FROM events")
def voc17_precedence(spark, sf_dir):
    sign = F.get(F.array(*map(F.lit, ("∪", "∩", "△", "+"))), (F.col("event_id") % 4).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", L.precedence(sign).alias("level"))


@query("voc18_spoken_lines", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'x ao quadrado mais três é igual a quinze' WHEN 1 THEN 'dois sobre três é menor ou igual a um' WHEN 2 THEN 'sem sinais' WHEN 3 THEN 'abre parênteses a mais b fecha parênteses vezes dois metros' ELSE 'alfa pertence a reais' END AS said FROM events")
def voc18_spoken_lines(spark, sf_dir):
    lines = ("x² + 3 = 15", "2/3 ≤ 1", "sem sinais", "(a + b) × 2 m", "α ∈ ℝ")
    line = F.get(F.array(*map(F.lit, lines)), (F.col("event_id") % 5).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", L.spoken_line(line).alias("said"))


@query("voc20_spoken_cells", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'um; dois' WHEN 1 THEN 'menos cinco' ELSE 'bem-vindo mais um' END AS said FROM events")
def voc20_spoken_cells(spark, sf_dir):
    cell = F.get(F.array(*map(F.lit, ("|1|2|", "-5", "bem-vindo + 1"))), (F.col("event_id") % 3).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", L.spoken_cell(cell).alias("said"))


@query("voc21_operators", "SELECT p_partkey, p_brand || ' mais guarda-chuva menos ' || p_size AS said FROM (SELECT * REPLACE (replace(p_brand, '#', '') AS p_brand) FROM part)")
def voc21_operators(spark, sf_dir):
    text = F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(" +  guarda-chuva - "), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", L.without_operators(text, aggressive=False).alias("said"))


@query("voc22_signs", f"WITH {_LINES} SELECT doc_id, line_no::INT AS line_no, line_no % 2 = 0 AS signs FROM lines WHERE regexp_matches(line, '^[a-zA-Z ]+$')")
def voc22_signs(spark, sf_dir):
    lines = blocks.lines_of(documents(spark, sf_dir)).where(F.col("line").rlike("^[a-zA-Z ]+$"))
    return lines.select("doc_id", "line_no", L.has_signs(F.concat("line", F.when(F.col("line_no") % 2 == 0, " ≥").otherwise(" e"))).alias("signs"))


# ---- trees ----


@query("exp48_known_formulas", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'bhaskara' WHEN 1 THEN 'discriminante' WHEN 2 THEN 'forma_geral' END AS known, CASE p_partkey % 4 WHEN 3 THEN 'A fórmula calcula v pela raiz quadrada de s.' END AS told FROM part")
def exp48_known_formulas(spark, sf_dir):
    source = F.get(F.array(*map(F.lit, (r"x = \frac{-b \pm \sqrt{\Delta}}{2a}", "Δ = b² - 4ac", "ax² + bx + c = 0", r"v = \sqrt{s}"))), (F.col("p_partkey") % 4).cast("int"))

    def known(sources: pd.Series) -> pd.DataFrame:
        trees = [X.parsed(s).tree for s in sources]
        return pd.DataFrame({"known": [S.known_formula(t) for t in trees], "told": [S.explanation(t) if S.known_formula(t) is None else None for t in trees]})

    rows = table(spark, sf_dir, "part").select("p_partkey", source.alias("source"))
    read = rows.select("source").distinct().withColumn("k", F.pandas_udf(known, "known string, told string")("source"))
    return rows.join(read, "source").select("p_partkey", "k.known", "k.told")


@query("val20_audits", "SELECT expr_id, true AS read FROM (SELECT p_partkey AS expr_id FROM part)")
def val20_audits(spark, sf_dir):
    def audit(sources: pd.Series) -> pd.Series:
        return sources.map(lambda s: S.audited(s)["source"] == s)

    rows = equations(spark, sf_dir)
    read = rows.select("source").distinct().withColumn("read", F.pandas_udf(audit, "boolean")("source"))
    return rows.join(read, "source").select("expr_id", "read")


@query("exp55_spoken_tables", f"WITH {_LI}, l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n, l_returnflag AS a, CASE WHEN l_quantity > 25 THEN 'texto' ELSE '' END AS b FROM li) SELECT l_orderkey, md5('Tabela com as colunas: marca, nota.' || chr(10) || string_agg('Linha ' || (n + 1) || '. marca: ' || a || '.' || CASE WHEN b <> '' THEN ' nota: ' || b || '.' ELSE '' END, chr(10) ORDER BY n)) AS digest FROM l GROUP BY l_orderkey")
def exp55_spoken_tables(spark, sf_dir):
    line = F.array(F.col("l_returnflag"), F.when(F.col("l_quantity") > 25, "texto").otherwise(" "))
    rows = F.concat(F.array(F.array(F.lit("marca"), F.lit("nota"))), F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("r")))), lambda x: x["r"]))
    return lines_of_orders(spark, sf_dir).groupBy("l_orderkey").agg(rows.alias("rows")).select("l_orderkey", F.md5(spoken_table(F.col("rows"))).alias("digest"))


def spoken_table(rows):
    """The headings in a sentence, then a line for each row with its headings; empty cells are left out."""
    said = F.transform(rows, lambda r: F.transform(r, lambda c: T.tidy(F.coalesce(c, F.lit("")))))
    names = F.get(said, F.lit(0))
    one = lambda name, cell: F.when(cell == "", F.lit(None)).when(F.coalesce(name, F.lit("")) == "", F.concat(cell, F.lit("."))).otherwise(F.concat(name, F.lit(": "), cell, F.lit(".")))
    line = lambda r, k: F.concat_ws(" ", F.concat(F.lit("Linha "), (k + 2).cast("string"), F.lit(".")), F.array_join(F.array_compact(F.zip_with(names, r, one)), " "))
    return F.when(F.size(said) == 0, "").otherwise(F.array_join(F.concat(F.array(F.concat(F.lit("Tabela com as colunas: "), F.array_join(names, ", "), F.lit("."))), F.transform(F.slice(said, 2, 1 << 20), line)), "\n"))


# ---- fragments of formulas: what goes on in the next line ----


@query("win14_formula_groups", f"WITH {_LI}, l AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM li) SELECT doc_id, k::INT AS region_idx, (CASE WHEN k % 2 = 1 THEN k - 1 ELSE k END)::INT AS head FROM l")
def win14_formula_groups(spark, sf_dir):
    """Each second line closes what the one before it leaves open."""
    return fragments.formula_groups(open_lines(spark, sf_dir)).select("doc_id", "region_idx", "head")


def open_lines(spark, sf_dir):
    k = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1
    rows = lines_of_orders(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_num"), k.alias("region_idx"))
    y = F.col("region_idx") * 12.0
    return rows.select("*", F.lit(0.0).alias("x0"), y.alias("y0"), F.lit(90.0).alias("x1"), (y + 10).alias("y1"), F.when(F.col("region_idx") % 2 == 0, "x = (a +").otherwise("b)").alias("text"), F.lit("text").alias("type"), F.lit(10.0).alias("size"))


@query("win16_merged_fragments", "WITH l AS (SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT doc_id, unnest(range(0, (n + 1) // 2))::INT AS ord, n FROM l")
def win16_merged_fragments(spark, sf_dir):
    made = fragments.merged_fragments(open_lines(spark, sf_dir))
    return made.select("doc_id", F.col("ord").cast("int").alias("ord"), F.sum("pieces").over(W.partitionBy("doc_id")).alias("n"))


@query("win17_regrouped_fragments", f"WITH {_LI}, l AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS k FROM li) SELECT doc_id, k::INT AS region_idx, (k - k % 2)::INT AS head FROM l")
def win17_regrouped_fragments(spark, sf_dir):
    return fragments.regrouped_fragments(open_lines(spark, sf_dir)).select("doc_id", "region_idx", "head")


@query("src6_page_regions")
def src6_page_regions(spark, sf_dir):
    made = fragments.page_regions(fragments.text_blocks(spans(spark, sf_dir)), images(spark, sf_dir))
    return made.select("doc_id", "region_idx", "type", "ord")


@query("voc5_unit_words", "SELECT p_partkey, CASE p_size WHEN 1 THEN 'um metro por segundo' ELSE '' END AS one, p_size <> 1 AS many FROM part")
def voc5_unit_words(spark, sf_dir):
    said = V.with_units_in_words(F.concat(F.col("p_size").cast("string"), F.lit(" m/s")))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") == 1, said).otherwise("").alias("one"), said.endswith(" metros por segundo").alias("many"))


@query("exp53_mixed_paragraphs", "SELECT expr_id, true AS whole FROM (SELECT p_partkey AS expr_id FROM part) WHERE true")
def exp53_mixed_paragraphs(spark, sf_dir):
    """The pieces of a paragraph in order are the paragraph."""
    rows = equations(spark, sf_dir).select("expr_id", F.concat(F.lit("Veja que "), "source", F.lit(" vale sempre.")).alias("text"))
    pieces = formulas.segmented(rows, ["expr_id"], "text").groupBy("expr_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "piece"))), lambda p: p["piece"]), "").alias("again"))
    return rows.join(pieces, "expr_id", "left").select("expr_id", (F.coalesce("again", "text") == F.col("text")).alias("whole"))


# ---- the same rows in SQL for queries of the catalog, and queries whose rows show both outcomes ----

ORACLE["agg1_reading_order"] = f"WITH {_REGIONS} SELECT doc_id, 0 AS page_num, region_idx::INT AS region_idx, (row_number() OVER (PARTITION BY doc_id ORDER BY y0, x0, region_idx) - 1)::INT AS ord FROM r"
ORACLE["agg6_joined_pieces"] = f"""WITH {_REGIONS}, t AS (SELECT doc_id, region_idx, region_idx - lag(region_idx) OVER (PARTITION BY doc_id ORDER BY region_idx) AS step FROM r WHERE length(text) > 0),
g AS (SELECT doc_id, region_idx, sum(CASE WHEN step <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY region_idx) AS run FROM t),
p AS (SELECT doc_id, region_idx, min(region_idx) OVER (PARTITION BY doc_id, run) AS piece FROM g)
SELECT r.doc_id, r.region_idx::INT AS region_idx, coalesce(piece, r.region_idx)::INT AS piece FROM r LEFT JOIN p ON r.doc_id = p.doc_id AND r.region_idx = p.region_idx"""
ORACLE["agg29_axis_order"] = "SELECT o_custkey, CASE WHEN count(DISTINCT year(o_orderdate)) >= 3 THEN 'temporal' ELSE 'nominal' END AS axis FROM orders GROUP BY o_custkey"
ORACLE["cls25_kept_content"] = """WITH t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations),
w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(translate(lower(coalesce(text, '')), 'áàâãäåéèêëíìîïóòôõöúùûüçñýÿ', 'aaaaaaeeeeiiiiooooouuuucnyy'), '[\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{4,}'))) AS a,
  list_distinct(list_filter(regexp_extract_all(translate(lower(after), 'áàâãäåéèêëíìîïóòôõöúùûüçñýÿ', 'aaaaaaeeeeiiiiooooouuuucnyy'), '[\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{4,}'))) AS b FROM t WHERE after IS NOT NULL)
SELECT conv_id, turn, len(a) = 0 OR len(list_filter(a, lambda x: NOT list_contains(b, x))) <= 0.25 * len(a) AS kept FROM w"""
ORACLE["jon22_overlaps"] = f"""WITH {_REGIONS}, q AS (SELECT *, y1 + 4 AS bottom FROM r),
p AS (SELECT a.doc_id, a.region_idx, b.region_idx AS other_idx, greatest(least(a.x1, b.x1), 0) * greatest(least(a.bottom, b.bottom) - greatest(a.y0, b.y0), 0) / nullif(a.x1 * 14, 0) AS share FROM q a JOIN q b ON a.doc_id = b.doc_id AND abs(a.region_idx - b.region_idx) = 1 WHERE a.region_idx % 2 = 0)
SELECT doc_id, 0 AS page_num, region_idx::INT AS region_idx, other_idx::INT AS other_idx, share FROM p WHERE share > 0.10"""


@query("txt23_noise_of_turns", "SELECT conv_id, turn, turn % 5 <> 4 AS noise FROM conversations")
def txt23_noise_of_turns(spark, sf_dir):
    """Page marks, a lone label, an illegible note and an empty line for four of five turns; a sentence for the fifth."""
    line = F.get(F.array(*map(F.lit, ("Página 3 de 10", "Gráfico colorido.", "conteúdo ilegível", "   ", "A casa fica na rua de baixo."))), (F.col("turn") % 5).cast("int"))
    line = F.when(F.col("turn") % 5 == 1, "Texto digitalizado.").otherwise(line)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_noise(line).alias("noise"))


@query("cls17_titles_of_parts", "SELECT p_partkey, p_partkey % 2 = 0 AND length(p_name) <= 90 AS title FROM part")
def cls17_titles_of_parts(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.upper("p_name"), F.lit(".")))
    return table(spark, sf_dir, "part").select("p_partkey", T.is_title(name).alias("title"))


@query("exp12_scripts_of_parts", "SELECT p_partkey, CASE WHEN p_size % 10 = p_size THEN 2 ELSE 1 END::INT AS n FROM part")
def exp12_scripts_of_parts(spark, sf_dir):
    text = F.concat(F.lit("se x"), F.col("p_size").cast("string"), F.lit(" = a1 e abc2 ou y_3"))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(formulas.script_candidates(text)).alias("n"))


@query("cls24_hedges_of_turns", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'provavelmente' WHEN turn % 3 = 1 THEN 'aparenta estar,como se' ELSE '' END AS hedges FROM conversations")
def cls24_hedges_of_turns(spark, sf_dir):
    text = F.get(F.array(*map(F.lit, ("Provavelmente é um gato, provavelmente.", "Aparenta estar como se dormisse", "É um gato."))), (F.col("turn") % 3).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(maths.hedges(text), ",").alias("hedges"))


@query("win10_sections_of_orders", f"""WITH {_LI}, h AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, (l_partkey % 4 + 1) AS level FROM li)
SELECT a.doc_id, a.ord::INT AS ord, a.level::INT AS level, max(b.ord)::INT AS parent_ord FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.ord < a.ord AND b.level < a.level AND NOT EXISTS (SELECT 1 FROM h c WHERE c.doc_id = a.doc_id AND c.ord > b.ord AND c.ord < a.ord AND c.level <= b.level) GROUP BY ALL""")
def win10_sections_of_orders(spark, sf_dir):
    rows = lines_of_orders(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), F.lit("heading").alias("type"), (F.col("l_partkey") % 4 + 1).cast("int").alias("level"), F.lit("x").alias("text"))
    return blocks.sections(rows).select("doc_id", "ord", "level", "parent_ord")


@query("agg11_differing_formulas", "SELECT l_partkey % 100 AS hash, count(DISTINCT l_returnflag)::BIGINT AS latex_forms, count(DISTINCT l_linestatus)::BIGINT AS speech_forms, count(*)::BIGINT AS n, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'BLOCKER' ELSE 'WARNING' END AS severity FROM lineitem GROUP BY l_partkey % 100 HAVING count(DISTINCT l_returnflag) > 1 OR count(DISTINCT l_linestatus) > 1")
def agg11_differing_formulas(spark, sf_dir):
    return formulas.occurrences_that_differ(table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 100).alias("hash"), F.col("l_returnflag").alias("latex"), F.col("l_linestatus").alias("speech")))


@query("txt27_slides_of_parts", "SELECT p_partkey, CASE WHEN p_size <= 20 THEN 'Slide ' || p_size || ' de 20 fim' ELSE p_size || '/20 fim' END || chr(10) || 'latex: 3/20' AS text FROM part")
def txt27_slides_of_parts(spark, sf_dir):
    text = F.concat(F.col("p_size").cast("string"), F.lit("/20 fim\nlatex: 3/20"))
    return table(spark, sf_dir, "part").select("p_partkey", T.slide_numbers(text, 20).alias("text"))


@query("txt22_labels_of_parts", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(substr(p_name, 1, 1)) || substr(p_name, 2) WHEN 1 THEN 'texto: ab' ELSE 'O texto: ' || p_name END AS text FROM part")
def txt22_labels_of_parts(spark, sf_dir):
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.lit("Texto digitalizado: "), "p_name")).when(k == 1, "texto: ab").otherwise(F.concat(F.lit("O texto: "), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.without_process_label(text).alias("text"))


@query("txt2_clean_parts", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' forte' || chr(10) || 'item' || chr(10) || 'x' ELSE '**' || p_name || '**' END AS text FROM part")
def txt2_clean_parts(spark, sf_dir):
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("## "), "p_name", F.lit(" **forte**\n- item\n```\n1. `x`\n"))).otherwise(F.concat(F.lit("**"), "p_name", F.lit("**")))
    clean = T.block_text(text, F.when(F.col("p_partkey") % 2 == 0, "paragraph").otherwise("code"))
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(clean, "\n+", "\n").alias("text"))


@query("exp38_latex", r"SELECT p_partkey AS expr_id, CASE p_partkey % 5 WHEN 0 THEN p_size || '{x}^{2} - ' || floor(p_retailprice)::INT || 'x + 1 = 0' WHEN 1 THEN 'y = \frac{' || p_size || ' + \sqrt{' || floor(p_retailprice)::INT || '}}{2a}' WHEN 2 THEN 'v = ' || p_size || '\ \mathrm{m/s}' ELSE p_size || ' \in \{1, 2, ' || floor(p_retailprice)::INT || '\}' END AS latex FROM part WHERE p_partkey % 5 < 4")
def exp38_latex(spark, sf_dir):
    rows = equations(spark, sf_dir).where("expr_id % 5 < 4")
    return formulas.processed(rows, "source").select("expr_id", "formula.latex")


@query("exp42_statuses", "SELECT p_partkey AS expr_id, p_partkey % 5 < 4 AS complete, CASE WHEN p_partkey % 5 < 4 THEN 'draft' ELSE 'needs_review' END AS status FROM part")
def exp42_statuses(spark, sf_dir):
    return formulas.processed(equations(spark, sf_dir), "source").select("expr_id", (F.col("expr_id") % 5 < 4).alias("complete"), "formula.status")


@query("exp34_speech", "WITH " + "o AS (SELECT * FROM (VALUES (1, 'um'), (2, 'dois'), (3, 'três'), (4, 'quatro'), (5, 'cinco'), (6, 'seis'), (7, 'sete'), (8, 'oito'), (9, 'nove')) t(n, w)) SELECT p_partkey AS expr_id, CASE WHEN p_partkey % 2 = 0 THEN w || ' vezes x ao quadrado, mais b é igual a zero' ELSE 'uma fração. No numerador: ' || w || ' menos b. No denominador: dois vezes a. Fim da fração' END AS speech FROM part JOIN o ON n = p_size % 9 + 1")
def exp34_speech(spark, sf_dir):
    n = (F.col("p_size") % 9 + 1).cast("string")
    source = F.when(F.col("p_partkey") % 2 == 0, F.concat(n, F.lit("x² + b = 0"))).otherwise(F.concat(F.lit(r"\frac{"), n, F.lit(" - b}{2a}")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("expr_id"), source.alias("source"))
    return formulas.processed(rows, "source").select("expr_id", "formula.speech")


@query("exp39_mathml", "SELECT p_partkey AS expr_id, '<mfrac><mn>' || p_size || '</mn><msup><mi>x</mi><mn>2</mn></msup></mfrac>' AS mathml FROM part")
def exp39_mathml(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("expr_id"), F.concat(F.lit(r"\frac{"), F.col("p_size").cast("string"), F.lit("}{x^2}")).alias("source"))
    return formulas.processed(rows, "source").select("expr_id", F.regexp_extract("formula.mathml", "(<mfrac>.*</mfrac>)", 1).alias("mathml"))


@query("exp29_kinds", "SELECT p_partkey AS expr_id, u.kind AS kind, u.n::BIGINT AS n FROM (SELECT p_partkey, [{kind: 'Relation', n: 1}, {kind: 'Add', n: 1}, {kind: 'Power', n: 1}, {kind: 'Symbol', n: 2}, {kind: 'Integer', n: 2}] AS l FROM part), unnest(l) AS t(u)")
def exp29_kinds(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("expr_id"), F.concat(F.lit("x² + y = "), F.col("p_size").cast("string")).alias("source"))
    nodes = formulas.tree_nodes(formulas.processed(rows, "source").select("expr_id", "formula.*"), "expr_id")
    return nodes.groupBy("expr_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("val1_issues", "SELECT p_partkey AS expr_id, CASE p_partkey % 3 WHEN 0 THEN 'BLOCKER:parenteses' ELSE '' END AS issues FROM part")
def val1_issues(spark, sf_dir):
    n = F.col("p_size").cast("string")
    source = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("((x + "), n, F.lit(")"))).otherwise(F.concat(F.lit("x² - "), n))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("expr_id"), source.alias("source"))
    return formulas.processed(rows, "source").select("expr_id", F.array_join(F.filter("formula.issues", lambda i: i.endswith("parenteses")), ",").alias("issues"))


@query("exp2_pieces", "SELECT p_partkey, u.ord::INT AS ord, u.maths, u.piece FROM (SELECT p_partkey, p_size, [{ord: 0, maths: false, piece: 'A função é '}, {ord: 1, maths: true, piece: 'f(x) = x² + ' || p_size}, {ord: 2, maths: false, piece: ' e cresce.'}] AS l FROM part), unnest(l) AS t(u)")
def exp2_pieces(spark, sf_dir):
    text = F.concat(F.lit("A função é f(x) = x² + "), F.col("p_size").cast("string"), F.lit(" e cresce."))
    return formulas.segmented(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), ["p_partkey"], "text")


@query("src48_chunks_of_orders", f"WITH {_LI}, c AS (SELECT l_orderkey AS doc_id, count(*) AS n FROM li GROUP BY l_orderkey) SELECT doc_id, ((n + 1) // 2)::BIGINT AS chunks, least(n, 2)::INT * 101 - 1 AS longest FROM c")
def src48_chunks_of_orders(spark, sf_dir):
    """Lines of a hundred letters: two fit into 210, with their line break."""
    text = F.array_join(F.transform(F.collect_list("l_linenumber"), lambda _: F.repeat(F.lit("x"), 100)), "\n")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(text.alias("text"))
    return render.chunks(rows, "doc_id", "text", 210).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max(F.length("chunk")).alias("longest"))


def typed_blocks(spark, sf_dir):
    """Blocks of orders: a heading, then paragraphs and list items."""
    n = F.col("l_linenumber")
    return lines_of_orders(spark, sf_dir).select(
        F.col("l_orderkey").alias("doc_id"), n.alias("ord"), F.when(n == 1, "heading").when(n % 2 == 0, "paragraph").otherwise("list").alias("type"), F.when(n == 1, 1).alias("level"),
        F.when((n == 1) | (n % 2 == 0), F.concat(F.lit("a < b "), "l_returnflag")).alias("text"), F.when((n > 1) & (n % 2 == 1), F.col("l_linestatus")).alias("item"),
        F.array().cast("array<array<string>>").alias("rows"), F.lit(None).cast("int").alias("start"),
    )


@query("src37_txt_of_orders", f"WITH {_LI} SELECT l_orderkey AS doc_id, string_agg(CASE WHEN l_linenumber = 1 OR l_linenumber % 2 = 0 THEN 'a < b ' || l_returnflag ELSE '- ' || l_linestatus END, chr(10) ORDER BY l_linenumber) AS txt FROM li GROUP BY l_orderkey")
def src37_txt_of_orders(spark, sf_dir):
    return render.txt(typed_blocks(spark, sf_dir))


@query("src41_html_of_orders", f"WITH {_LI} SELECT l_orderkey AS doc_id, md5('<!DOCTYPE html>' || chr(10) || '<html lang=\"pt-BR\"><head><meta charset=\"utf-8\"></head><body><nav><ol>' || '<li><a href=\"#s1\">a &lt; b ' || min_by(l_returnflag, l_linenumber) || '</a></li></ol></nav><main>' || chr(10) || string_agg(CASE WHEN l_linenumber = 1 THEN '<h1 id=\"s1\">a &lt; b ' || l_returnflag || '</h1>' WHEN l_linenumber % 2 = 0 THEN '<p>a &lt; b ' || l_returnflag || '</p>' ELSE '<ul><li>' || l_linestatus || '</li></ul>' END, chr(10) ORDER BY l_linenumber) || chr(10) || '</main></body></html>') AS digest FROM li GROUP BY l_orderkey")
def src41_html_of_orders(spark, sf_dir):
    return render.html(typed_blocks(spark, sf_dir)).select("doc_id", F.md5("html").alias("digest"))


@query("src47_ssml_of_orders", f"WITH {_LI} SELECT l_orderkey AS doc_id, md5('<speak>' || chr(10) || string_agg('  ' || CASE WHEN l_linenumber = 1 OR l_linenumber % 2 = 0 THEN 'a &lt; b ' || l_returnflag ELSE l_linestatus END || chr(10) || '  <break time=\"' || CASE WHEN l_linenumber = 1 THEN 700 ELSE 400 END || 'ms\"/>', chr(10) ORDER BY l_linenumber) || chr(10) || '</speak>') AS digest FROM li GROUP BY l_orderkey")
def src47_ssml_of_orders(spark, sf_dir):
    return render.ssml(typed_blocks(spark, sf_dir)).select("doc_id", F.md5("ssml").alias("digest"))


@query("txt36_repaired_events", "SELECT event_id, '{\"a\":[' || event_id || ',{\"b\":\"' || event_type || '\"}]}' AS json FROM events")
def txt36_repaired_events(spark, sf_dir):
    cut = F.concat(F.lit('{"a": ['), F.col("event_id").cast("string"), F.lit(', {"b": "'), "event_type", F.when(F.col("event_id") % 2 == 0, '"}').otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", tables.repaired_json(cut).alias("json"))


@query("win18_joined_names", "SELECT p_partkey, p_name || ' ' || lower(p_type) || chr(10) || 'Fim' AS text FROM part")
def win18_joined_names(spark, sf_dir):
    text = F.concat("p_name", F.lit("  \n "), F.lower("p_type"), F.lit("\nFim"))
    return table(spark, sf_dir, "part").select("p_partkey", tables.joined_lines(text).alias("text"))


@query("agg28_summaries_of_orders", "SELECT l_orderkey, CASE WHEN count(*) + 8 <= 10 THEN '' ELSE 'Tabela de ' || (count(*) + 7) || ' linhas e 2 colunas. Cada linha e identificada por Nome. As demais colunas trazem Valor. Cada celula cruza o nome da linha com o titulo da coluna.' END AS summary FROM lineitem GROUP BY l_orderkey")
def agg28_summaries_of_orders(spark, sf_dir):
    rows = F.concat(F.array(F.array(F.lit("Nome"), F.lit("Valor"))), F.array_repeat(F.array(F.lit("a"), F.lit("1")), 7), F.transform(F.collect_list("l_linenumber"), lambda n: F.array(F.lit("x"), n.cast("string"))))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(rows.alias("rows")).select("l_orderkey", tables.summary(F.col("rows")).alias("summary"))


@query("win13_runs_of_orders", f"WITH {_LI}, c AS (SELECT l_orderkey AS doc_id, l_linenumber AS k, l_returnflag = 'N' AS f FROM li), g AS (SELECT *, sum((NOT f)::INT) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM c) SELECT doc_id, 0 AS page_num, count(*)::BIGINT AS n, string_agg(k::VARCHAR, ',' ORDER BY k) AS regions FROM g WHERE f GROUP BY doc_id, run HAVING count(*) >= 2")
def win13_runs_of_orders(spark, sf_dir):
    rows = lines_of_orders(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_num"), F.col("l_linenumber").alias("region_idx"), (F.col("l_linenumber") * 12.0).alias("y0"), F.when(F.col("l_returnflag") == "N", "formula").otherwise("text").alias("class"))
    return layout.runs_of(rows, "formula").select("doc_id", "page_num", "n", F.array_join(F.transform("regions", lambda x: x.cast("string")), ",").alias("regions"))


@query("jon4_uncovered_tiles", f"WITH {_LI} SELECT l_orderkey AS doc_id, l_linenumber::INT AS region_idx FROM li WHERE l_returnflag <> 'R' AND NOT EXISTS (SELECT 1 FROM li b WHERE b.l_orderkey = li.l_orderkey AND b.l_returnflag = 'R' AND abs(b.l_linenumber - li.l_linenumber) = 1)")
def jon4_uncovered_tiles(spark, sf_dir):
    """Tiles 120 high, one each 100 points: each covers a sixth of its neighbours."""
    y = F.col("l_linenumber") * 100.0
    rows = lines_of_orders(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_num"), F.col("l_linenumber").alias("region_idx"), F.lit(0.0).alias("x0"), y.alias("y0"), F.lit(100.0).alias("x1"), (y + 120).alias("y1"), "l_returnflag")
    return layout.uncovered(rows.where("l_returnflag != 'R'").drop("l_returnflag"), rows.where("l_returnflag = 'R'").drop("l_returnflag")).select("doc_id", "region_idx")


@query("cls6_class_of_boxes", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'embedded_image' WHEN 1 THEN 'table' WHEN 2 THEN 'formula' ELSE 'text_clean' END AS class FROM part")
def cls6_class_of_boxes(spark, sf_dir):
    kind = F.get(F.array(*map(F.lit, ("image", "table", "formula", "text"))), (F.col("p_partkey") % 4).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit(1).alias("doc_id"), F.lit(0).alias("page_num"), F.col("p_partkey").alias("region_idx"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(60.0).alias("x1"), F.lit(10.0).alias("y1"), kind.alias("type"), F.lit("um texto bem comum de linha").alias("text"), F.lit(0.9).alias("confidence"))
    return layout.classified(rows).select("p_partkey", "class")


# ---- completed, audited and marked ----


@query("exp7_completed", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '(x + ' || p_size || ' ) = 0' WHEN 1 THEN 'x = ' || p_size ELSE '((x' END AS text, CASE p_partkey % 3 WHEN 2 THEN 'needs_review' ELSE 'draft' END AS status FROM part")
def exp7_completed(spark, sf_dir):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.lit("(x + "), n)).when(k == 1, F.concat(F.lit("x = "), n)).otherwise("((x")
    after = F.when(k == 0, F.array(F.lit(") = 0"), F.lit("y"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select("p_partkey", maths.completed(text, after).alias("c")).select("p_partkey", "c.text", "c.status")


@query("txt15_marker_blocks", """WITH b AS (SELECT p_partkey, p_name, p_type FROM part)
SELECT p_partkey AS doc_id, 1 AS line_no, 'list' AS type, p_name || '|b' AS content FROM b UNION ALL SELECT p_partkey, 6, 'code', 'x = 1' || chr(10) || p_type FROM b UNION ALL SELECT p_partkey, 10, 'callout', 'fica aberto' FROM b""")
def txt15_marker_blocks(spark, sf_dir):
    text = F.concat(F.lit("antes\nInício de lista:\n- "), "p_name", F.lit("\n* b\nFim de lista\nentre\nInício de código-fonte:\nx = 1\n"), "p_type", F.lit("\nFim de código-fonte\nInicio de dica:\nfica aberto"))
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"))
    made = D.marker_blocks(blocks.lines_of(docs))
    return made.select("doc_id", "line_no", "type", F.coalesce("text", F.array_join("items", "|")).alias("content"))


@query("val23_speech_signatures", "SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN 'b,x' ELSE 'a,y' END AS symbols, CASE p_partkey % 2 WHEN 0 THEN '2,5' ELSE '10' END AS numbers, CASE p_partkey % 2 WHEN 0 THEN '+,=,^' ELSE '-,/,√' END AS operators FROM part")
def val23_speech_signatures(spark, sf_dir):
    said = F.when(F.col("p_partkey") % 2 == 0, "x ao quadrado, mais b é igual a cinco").otherwise("raiz quadrada de a sobre y menos dez")
    told = table(spark, sf_dir, "part").select("p_partkey", coherence.speech_signature(said).alias("s"))
    return told.select("p_partkey", *(F.array_join(f"s.{n}", ",").alias(n) for n in ("symbols", "numbers", "operators")))


@query("val34_formula_audits", "SELECT p_partkey, p_partkey % 3 = 0 AS approved, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'perdido:y' ELSE 'mathml:raiz,leitura:sqrt' END AS problems FROM part")
def val34_formula_audits(spark, sf_dir):
    k = F.col("p_partkey") % 3
    none = F.array().cast("array<string>")
    audit = coherence.formula_audit(F.when(k == 1, F.array(F.lit("y"))).otherwise(none), F.when(k == 2, F.array(F.lit("raiz"))).otherwise(none), F.lit(r"\sqrt{x}"), F.when(k == 2, "x").otherwise("raiz quadrada de x"))
    return table(spark, sf_dir, "part").select("p_partkey", audit.alias("a")).select("p_partkey", "a.approved", F.array_join("a.problems", ",").alias("problems"))


@query("txt32_descriptions", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '[verificacao incerta] ' || upper(substr(p_name, 1, 1)) || substr(p_name, 2) WHEN 1 THEN upper(substr(p_name, 1, 1)) || substr(p_name, 2) ELSE '' END AS said FROM part")
def txt32_descriptions(spark, sf_dir):
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.lit("[verificacao incerta] A imagem mostra "), "p_name")).when(k == 1, F.concat(F.lit("["), "p_name", F.lit("]"))).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", coherence.described(text).alias("said"))


@query("exp54_processed_cells", f"WITH {_LI}, h AS (SELECT l_orderkey, l_linenumber AS row, l_returnflag AS flag, CASE WHEN l_quantity > 25 THEN 'x = 2' ELSE 'palavra' END AS cell FROM li) SELECT l_orderkey, row, 1 AS col, cell, 'marca · nota · ' || flag AS context, cell = 'x = 2' AS maths FROM h UNION ALL SELECT l_orderkey, row, 0, flag, 'marca · nota · ' || cell, false FROM h")
def exp54_processed_cells(spark, sf_dir):
    line = F.array(F.col("l_returnflag"), F.when(F.col("l_quantity") > 25, "x = 2").otherwise("palavra"))
    rows = F.concat(F.array(F.array(F.lit("marca"), F.lit("nota"))), F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("r")))), lambda x: x["r"]))
    tables_ = lines_of_orders(spark, sf_dir).groupBy("l_orderkey").agg(rows.alias("rows"))
    return D.processed_cells(tables_, "l_orderkey").where("row > 0").select("l_orderkey", "row", "col", "cell", "context", "maths")
