"""Named queries over the driver's tables and the SQL that gives the same rows.

Texts are documents' texts or their lines; a layout is derived from the lines; orders stand for conversions and events for
their history. Each query runs over its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import maths, tables
from textloom.functions import text as T
from textloom.functions import vocabulary as V
from textloom.operators import blocks, formulas, layout, reports, validators
from textloom.sources import render
from textloom.streaming import intake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# ---- SQL for the same expressions ----


def _words(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _fold(c: str) -> str:
    return f"translate(lower({c}), '{T.ACCENTED}', '{T.PLAIN}')"


def _tidy(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


_VOTES = ", ".join(f"len(list_filter(w, lambda x: x IN ({_words(v)})))" + (f" + CASE WHEN regexp_matches(text, '[{T.LATIN_ACCENTS}]') THEN 2 ELSE 0 END" if k == "pt" else "") + f" AS {k}" for k, v in T.LANGUAGE_WORDS.items())
_LANGUAGE_CTE = f"""v AS (SELECT doc_id, lang, source, text, len(w) AS words, {_VOTES} FROM (SELECT *, regexp_extract_all(lower(text), '[a-zà-ÿ]+') AS w FROM documents)),
d AS (SELECT *, CASE WHEN length({_tidy("text")}) < 12 OR words < 3 OR greatest(pt, en, es) = 0
  OR (pt = greatest(pt, en, es))::INT + (en = greatest(pt, en, es))::INT + (es = greatest(pt, en, es))::INT > 1 THEN ''
  WHEN pt = greatest(pt, en, es) THEN 'pt' WHEN en = greatest(pt, en, es) THEN 'en' ELSE 'es' END AS detected FROM v)"""
_LINES = "lines AS (SELECT doc_id, i - 1 AS line_no, trim(l[i]) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS t(i) WHERE trim(l[i]) <> '')"
_REGIONS = "r AS (SELECT doc_id, i - 1 AS region_idx, l[i] AS text, 0.0::DOUBLE AS x0, (i - 1) * 12.0::DOUBLE AS y0, length(l[i]) * 6.0::DOUBLE AS x1, (i - 1) * 12.0::DOUBLE + 10 AS y1 FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS t(i))"
_NOISE = " OR ".join(f"regexp_matches({_tidy('line')}, '(?i){p}')" for p in (T.PAGE_CHROME, T.ONLY_ILLEGIBLE, T.EMPTY_REFERENCE, T.DANGLING_LABEL, T.LONE_LABEL))
_LAYOUT = " + ".join(f"contains({_fold('text')}, '{p}')::INT" for p in T.LAYOUT_PHRASES)
_TOKENS = f"regexp_extract_all({_fold('text')}, '[\\p{{L}}\\p{{N}}_]+')"
_LEAKS = " OR ".join(f"regexp_matches(text, '(?i){p}')" for p in T.PROMPT_LEAKS)
_MARKDOWN = " OR ".join(f"regexp_matches(text, '{p}')" for p in T.MARKDOWN)


# ---- texts ----


@query("agg30_language", f"WITH {_LANGUAGE_CTE} SELECT doc_id, detected FROM d")
def agg30_language(spark, sf_dir):
    votes = documents(spark, sf_dir).select("doc_id", "text", T.language_votes(F.col("text")).alias("v"))
    return votes.select("doc_id", T.language(F.col("text"), F.col("v")).alias("detected"))


@query("slice_language_and_noise", f"WITH {_LANGUAGE_CTE}, {_LINES}, n AS (SELECT doc_id, count(*) AS lines, count_if({_NOISE}) AS noise FROM lines GROUP BY doc_id) SELECT source, d.lang, detected, count(*)::BIGINT AS docs, sum(coalesce(lines, 0))::BIGINT AS lines, sum(coalesce(noise, 0))::BIGINT AS noise FROM d LEFT JOIN n USING (doc_id) GROUP BY ALL")
def slice_language_and_noise(spark, sf_dir):
    """Which languages are taken for others, and how many lines of each source are noise."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda c: F.trim(c)), lambda x: x != "")
    one = documents(spark, sf_dir).select("source", "lang", "text", T.language_votes(F.col("text")).alias("v"), lines.alias("l"))
    rows = one.select("source", "lang", T.language(F.col("text"), F.col("v")).alias("detected"), F.size("l").alias("n"), F.size(F.filter("l", lambda x: T.is_noise(x))).alias("noise"))
    return rows.groupBy("source", "lang", "detected").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").cast("long").alias("lines"), F.sum("noise").cast("long").alias("noise"))


@query("txt1_sanitize", "SELECT doc_id, md5(trim(" + "regexp_replace(" * len(T.PROMPT_LEAKS) + "regexp_replace(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g'), '(?im)^\\s*(?:prompt|system|developer)\\s*:\\s*.*$', '', 'g')" + "".join(f", '(?i){p}', '[conteudo removido]', 'g')" for p in T.PROMPT_LEAKS) + ", ' ' || chr(9) || chr(10))) AS digest FROM documents")
def txt1_sanitize(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(T.sanitized(F.col("text"))).alias("digest"))


@query("txt2_block_text")
def txt2_block_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.block_text(F.col("text"), F.col("role")).alias("clean"))


@query("txt3_prompt_leaks", f"SELECT source, count_if({_LEAKS})::BIGINT AS leaks, count_if({_MARKDOWN})::BIGINT AS markdown, count(*)::BIGINT AS docs FROM documents GROUP BY source")
def txt3_prompt_leaks(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("source").agg(F.count_if(T.leaks_prompt(F.col("text"))).alias("leaks"), F.count_if(T.has_markdown(F.col("text"))).alias("markdown"), F.count(F.lit(1)).alias("docs"))


@query("txt5_technical_marks", "SELECT conv_id, turn, trim(regexp_replace(" + "replace(" * 3 + "text" + "".join(f", '{m}', '')" for m in T.TECHNICAL_MARKS) + ", '[ \\t]{2,}', ' ', 'g')) AS clean FROM conversations")
def txt5_technical_marks(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.without_technical_marks(F.col("text")).alias("clean"))


@query("txt6_internal_terms", f"SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(html, '(?i)({'|'.join(T.INTERNAL_TERMS)})'), lambda x: lower(x)))), ',') AS terms FROM pages")
def txt6_internal_terms(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(T.internal_terms(F.col("html")), ",").alias("terms"))


@query("txt22_process_labels", None)
def txt22_process_labels(spark, sf_dir):
    return blocks.lines_of(documents(spark, sf_dir)).select("doc_id", "line_no", F.md5(T.without_process_label(F.col("line"))).alias("digest"))


@query("txt23_noise", f"WITH {_LINES} SELECT doc_id, count(*)::BIGINT AS noise FROM lines WHERE {_NOISE} GROUP BY doc_id")
def txt23_noise(spark, sf_dir):
    return blocks.lines_of(documents(spark, sf_dir)).where(T.is_noise(F.col("line"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("noise"))


@query("txt24_layout_phrases", f"SELECT doc_id, ({_LAYOUT})::INT AS phrases, ({_LAYOUT}) >= 2 AS narrates FROM documents")
def txt24_layout_phrases(spark, sf_dir):
    n = T.layout_phrases(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", n.alias("phrases"), (n >= 2).alias("narrates"))


@query("txt26_numbers_and_terms", f"SELECT conv_id, turn, array_to_string(list_sort(list_concat(regexp_extract_all({_fold('text')}, '[0-9]+(?:[.,][0-9]+)?'), list_filter({_TOKENS}, lambda x: regexp_full_match(x, '{'|'.join(T.NUMBER_WORDS)}')))), '|') AS numbers, array_to_string(list_sort(list_distinct(list_filter({_TOKENS}, lambda x: regexp_full_match(x, '[a-z]{{4,}}')))), '|') AS terms FROM conversations")
def txt26_numbers_and_terms(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.numbers_of(F.col("text")), "|").alias("numbers"), F.array_join(T.terms_of(F.col("text")), "|").alias("terms"))


@query("txt27_slide_numbers")
def txt27_slide_numbers(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(T.slide_numbers(F.col("text"), 20)).alias("digest"))


_plain = "text"
for _a, _b in T.TYPOGRAPHY.items():
    _plain = f"replace({_plain}, '{_a.replace(chr(39), chr(39) * 2)}', '{_b.replace(chr(39), chr(39) * 2)}')"


@query("txt35_typography", f"SELECT conv_id, turn, lower(trim(regexp_replace({_plain}, '\\s+', ' ', 'g'))) AS plain FROM conversations")
def txt35_typography(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.plain_typography(F.col("text")).alias("plain"))


@query("txt42_decimals", "SELECT l_orderkey, l_linenumber, CASE WHEN regexp_full_match(trim(l_discount::VARCHAR), '-?[0-9]+\\.[0-9]+') THEN replace(trim(l_discount::VARCHAR), '.', ',') ELSE l_discount::VARCHAR END AS cell FROM lineitem")
def txt42_decimals(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.comma_decimal(F.col("l_discount").cast("string")).alias("cell"))


@query("txt44_language_codes", f"WITH {_LANGUAGE_CTE} SELECT doc_id, CASE lang WHEN 'en' THEN 'en-US' WHEN 'es' THEN 'es-ES' WHEN 'fr' THEN 'fr-FR' WHEN 'de' THEN 'de-DE' WHEN 'it' THEN 'it-IT' ELSE lang END AS code, lang <> '' AND detected <> '' AND lang <> detected AS marked FROM d")
def txt44_language_codes(spark, sf_dir):
    votes = documents(spark, sf_dir).select("doc_id", "text", "lang", T.language_votes(F.col("text")).alias("v"))
    return votes.select("doc_id", T.full_language_code(F.col("lang")).alias("code"), T.needs_language_mark(F.col("lang"), T.language(F.col("text"), F.col("v"))).alias("marked"))


@query("win21_fingerprints", f"SELECT count(*)::BIGINT AS docs, count(DISTINCT lower({_tidy('text')}))::BIGINT AS different FROM documents")
def win21_fingerprints(spark, sf_dir):
    return documents(spark, sf_dir).agg(F.count(F.lit(1)).alias("docs"), F.count_distinct(T.fingerprint(F.col("text"))).alias("different"))


@query("src20_file_names", "SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS name FROM pages")
def src20_file_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.file_name(F.col("url")).alias("name"))


@query("src19_hashes", "SELECT doc_id, sha256(text) AS digest FROM documents")
def src19_hashes(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha2(F.col("text"), 256).alias("digest"))


@query("cls7_formulas")
def cls7_formulas(spark, sf_dir):
    return blocks.lines_of(documents(spark, sf_dir)).where(T.looks_like_formula(F.col("line"))).select("doc_id", "line_no")


@query("cls17_titles", f"WITH {_LINES} SELECT doc_id, line_no::INT AS line_no FROM lines WHERE length(line) <= 90 AND NOT regexp_matches(line, '[.;!?]$') AND line = upper(line) AND regexp_matches(line, '\\p{{L}}')")
def cls17_titles(spark, sf_dir):
    return blocks.lines_of(documents(spark, sf_dir)).where(T.is_title(F.col("line"))).select("doc_id", "line_no")


@query("cls3_list_marks", f"WITH {_LINES} SELECT doc_id, count(*)::BIGINT AS n FROM lines WHERE {' OR '.join(f'''starts_with(line, '{p}')''' for p in T.LIST_STARTS)} OR (regexp_matches(line, '^[0-9][.)]') AND NOT regexp_matches(line, '^[0-9][.)][0-9]')) OR regexp_matches(line, '^\\p{{L}}[.)] ') GROUP BY doc_id")
def cls3_list_marks(spark, sf_dir):
    return blocks.lines_of(documents(spark, sf_dir)).where(T.starts_list(F.col("line"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("txt13_table_rows", f"WITH {_LINES} SELECT doc_id, count(*)::BIGINT AS n FROM lines WHERE contains(line, '|') AND (regexp_matches(line, '^\\|(.*\\|)?$') OR regexp_matches(line, '^[\\s|:-]+$') OR len(list_filter(string_split(line, '|'), lambda c: trim(c) = '')) = 0) GROUP BY doc_id")
def txt13_table_rows(spark, sf_dir):
    return blocks.lines_of(documents(spark, sf_dir)).where(T.is_table_row(F.col("line"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


# ---- blocks ----


@query("txt10_blocks")
def txt10_blocks(spark, sf_dir):
    return blocks.parsed(documents(spark, sf_dir)).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("rows")).alias("rows"))


@query("win10_sections")
def win10_sections(spark, sf_dir):
    return blocks.sections(blocks.parsed(documents(spark, sf_dir)))


@query("win9_skipped_levels", "WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, (o_orderkey % 4 + 1)::INT AS level FROM orders), p AS (SELECT *, lag(level, 1, 0) OVER (PARTITION BY doc_id ORDER BY ord) AS previous FROM o) SELECT doc_id, ord, level, previous FROM p WHERE level > previous + 1")
def win9_skipped_levels(spark, sf_dir):
    headings = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("level"))
    return blocks.skipped_levels(headings)


@query("win11_distinct_ids", "WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, o_orderpriority AS base, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM orders) SELECT doc_id, ord, base, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS id FROM o")
def win11_distinct_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("base"))
    return blocks.distinct_ids(rows, "base", "ord")


@query("win12_flow_runs", "WITH w AS (SELECT conv_id, turn, role, text, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM role AND role IS NOT NULL THEN 0 ELSE 1 END AS new FROM conversations), g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM w) SELECT conv_id AS doc_id, run::BIGINT AS run, min(role) AS role, min(turn) AS first, count(*)::BIGINT AS n, string_agg(text, ' ' ORDER BY turn) AS text FROM g GROUP BY conv_id, run")
def win12_flow_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "doc_id")
    return blocks.regrouped(rows, "role", "turn")


@query("win8_broken_order", "WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, (o_orderkey * 7 % 11)::INT AS page FROM orders), p AS (SELECT *, max(page) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM o) SELECT doc_id, ord, page, highest FROM p WHERE page < highest")
def win8_broken_order(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") * 7 % 11).cast("int").alias("page"))
    return blocks.broken_order(rows, "ord", "page")


@query("win20_first_of_content", f"WITH {_LINES}, f AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id, lower({_tidy('line')}) ORDER BY line_no) AS n FROM lines) SELECT doc_id, line_no::INT AS line_no FROM f WHERE n = 1")
def win20_first_of_content(spark, sf_dir):
    rows = blocks.lines_of(documents(spark, sf_dir)).withColumnRenamed("line", "text")
    return blocks.first_of_content(rows, "line_no").select("doc_id", "line_no")


@query("win7_repeats")
def win7_repeats(spark, sf_dir):
    return blocks.repeats(blocks.lines_of(documents(spark, sf_dir)).withColumnRenamed("line", "text"), "line_no")


@query("win1_pruned")
def win1_pruned(spark, sf_dir):
    rows = blocks.lines_of(documents(spark, sf_dir)).select("doc_id", "line_no", F.lit("paragraph").alias("type"), F.col("line").alias("text"))
    return blocks.pruned(rows, "line_no").select("doc_id", "line_no", F.md5("text").alias("digest"))


# ---- layout ----


@query("jon9_neighbours", f"WITH {_REGIONS}, c AS (SELECT a.doc_id, a.region_idx, b.region_idx AS neighbour_idx, greatest(a.y0 - b.y1, b.y0 - a.y1, 0.0)::DOUBLE AS gap, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS common, least(a.x1 - a.x0, b.x1 - b.x0) AS smaller FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.region_idx <> b.region_idx AND abs(a.region_idx - b.region_idx) <= 9), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, region_idx ORDER BY gap, neighbour_idx) AS rank FROM c WHERE gap <= 90 AND common > 0 AND common / CASE WHEN smaller = 0 THEN 1 ELSE smaller END >= 0.25) SELECT doc_id, 0 AS page_num, region_idx::INT AS region_idx, rank::INT AS rank, neighbour_idx::INT AS neighbour_idx, gap FROM k WHERE rank <= 4")
def jon9_neighbours(spark, sf_dir):
    return layout.neighbours(layout.line_regions(documents(spark, sf_dir)))


@query("cls4_dpi", f"WITH {_REGIONS}, s AS (SELECT doc_id, region_idx, least(x1 - x0, y1 - y0) AS short, greatest(x1 - x0, y1 - y0) AS long FROM r) SELECT doc_id, region_idx::INT AS region_idx, CASE WHEN short <= 0 OR long <= 0 THEN 200 ELSE floor(greatest(least(800 * 72.0 / short, 2200 * 72.0 / long, 900.0), 200.0)) END::INT AS dpi FROM s")
def cls4_dpi(spark, sf_dir):
    return layout.line_regions(documents(spark, sf_dir)).select("doc_id", "region_idx", layout.adaptive_dpi().alias("dpi"))


@query("cls6_classes")
def cls6_classes(spark, sf_dir):
    return layout.classified(layout.line_regions(documents(spark, sf_dir))).groupBy("doc_id", "class").agg(F.count(F.lit(1)).alias("n"))


@query("cls1_page_profiles", f"WITH {_REGIONS}, p AS (SELECT doc_id, sum(length(text))::BIGINT AS text_chars, least(1.0, sum((x1 - x0) * (y1 - y0)) / (600.0 * 800.0)) AS share FROM r GROUP BY doc_id) SELECT doc_id, 0 AS page_num, text_chars, (floor(share * 10000 + 0.5) / 10000)::DOUBLE AS coverage, 0::BIGINT AS image_count, CASE WHEN text_chars >= 8 AND share >= 0.001 THEN 'digital' ELSE 'scanned' END AS kind FROM p")
def cls1_page_profiles(spark, sf_dir):
    return layout.page_profiles(layout.line_regions(documents(spark, sf_dir)), 600.0, 800.0)


@query("agg5_bands", f"WITH {_REGIONS}, s AS (SELECT *, max(y1) OVER (PARTITION BY doc_id ORDER BY y0, x0, region_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r WHERE text <> ''), g AS (SELECT *, sum(CASE WHEN before IS NULL OR y0 > before + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY y0, x0, region_idx) AS band FROM s) SELECT doc_id, 0 AS page_num, band::BIGINT AS band, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*)::BIGINT AS n FROM g GROUP BY doc_id, band")
def agg5_bands(spark, sf_dir):
    return layout.bands(layout.line_regions(documents(spark, sf_dir)).where("text != ''"))


@query("agg1_reading_order")
def agg1_reading_order(spark, sf_dir):
    return layout.reading_order(layout.line_regions(documents(spark, sf_dir)))


# ---- reports ----

_HISTORY = "h AS (SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'processing' ELSE 'error' END AS status, o_totalprice AS seconds, o_orderdate AS created_at FROM orders)"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "processing").otherwise("error")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), status.alias("status"), F.col("o_totalprice").alias("seconds"), F.col("o_orderdate").alias("created_at"), F.lit(None).cast("string").alias("error"))


@query("agg17_statistics", f"WITH {_HISTORY} SELECT count(*)::BIGINT AS total, count_if(status = 'done')::BIGINT AS done, count_if(status = 'error')::BIGINT AS failed, round(coalesce(avg(seconds) FILTER (status = 'done'), 0), 1) AS mean_seconds FROM h")
def agg17_statistics(spark, sf_dir):
    return reports.statistics(history(spark, sf_dir))


@query("agg18_latest", f"WITH {_HISTORY} SELECT task_id, status, seconds, created_at, NULL::VARCHAR AS error FROM h ORDER BY created_at DESC, task_id LIMIT 10")
def agg18_latest(spark, sf_dir):
    return reports.latest(history(spark, sf_dir))


@query("str3_orphans", f"WITH {_HISTORY} SELECT CASE WHEN status = 'processing' AND created_at < TIMESTAMP '1998-01-01' - INTERVAL 1 HOUR THEN 'error' ELSE status END AS status, count(*)::BIGINT AS n FROM h GROUP BY 1")
def str3_orphans(spark, sf_dir):
    return reports.without_orphans(history(spark, sf_dir), F.lit("1998-01-01").cast("timestamp")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("agg15_gate", "WITH i AS (SELECT l_orderkey, CASE WHEN l_quantity >= 50 THEN 'BLOCKER' WHEN l_discount >= 0.1 THEN 'ERROR' WHEN l_tax >= 0.07 THEN 'WARNING' ELSE 'INFO' END AS severity FROM lineitem), c AS (SELECT l_orderkey, count_if(severity = 'BLOCKER')::BIGINT AS blocker, count_if(severity = 'ERROR')::BIGINT AS error, count_if(severity = 'WARNING')::BIGINT AS warning, count_if(severity = 'INFO')::BIGINT AS info FROM i GROUP BY l_orderkey) SELECT *, CASE WHEN blocker > 0 THEN 'blocked' WHEN error > 0 THEN 'needs_review' WHEN warning > 0 THEN 'publicavel_com_avisos' ELSE 'aprovado' END AS status, blocker = 0 AND error = 0 AS publish FROM c")
def agg15_gate(spark, sf_dir):
    severity = F.when(F.col("l_quantity") >= 50, "BLOCKER").when(F.col("l_discount") >= 0.1, "ERROR").when(F.col("l_tax") >= 0.07, "WARNING").otherwise("INFO")
    return reports.gate(table(spark, sf_dir, "lineitem").select("l_orderkey", severity.alias("severity")), "l_orderkey")


@query("agg12_conflicts", "SELECT l_partkey, count(DISTINCT l_returnflag)::BIGINT AS latex_forms, count(DISTINCT l_linestatus)::BIGINT AS speech_forms, count(*)::BIGINT AS n, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'BLOCKER' ELSE 'ERROR' END AS severity FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_returnflag) > 1 OR count(DISTINCT l_linestatus) > 1")
def agg12_conflicts(spark, sf_dir):
    return reports.conflicts(table(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag", "l_linestatus")


@query("agg20_expansion", "WITH t AS (SELECT conv_id, CASE WHEN role = 'user' THEN text ELSE '' END AS o, CASE WHEN role <> 'user' THEN text ELSE '' END AS p FROM conversations), c AS (SELECT conv_id, sum(len(list_filter(regexp_split_to_array(o, '\\s+'), lambda w: w <> '')))::BIGINT AS origin_words, sum(len(list_filter(regexp_split_to_array(p, '\\s+'), lambda w: w <> '')))::BIGINT AS output_words FROM t GROUP BY conv_id) SELECT *, CASE WHEN origin_words > 0 THEN round(output_words / origin_words, 2) ELSE 0.0 END::DOUBLE AS ratio, CASE WHEN origin_words > 0 THEN round(output_words / origin_words, 2) ELSE 0.0 END > 4 AS suspect FROM c")
def agg20_expansion(spark, sf_dir):
    user = F.col("role") == "user"
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.when(user, F.col("text")).otherwise("").alias("origin"), F.when(~user, F.col("text")).otherwise("").alias("output"))
    return reports.expansion(rows, "origin", "output", "conv_id")


@query("agg23_lost_words", "WITH w AS (SELECT conv_id AS key, role, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM conversations), a AS (SELECT DISTINCT key, word FROM w WHERE role = 'user'), b AS (SELECT DISTINCT key, word FROM w WHERE role <> 'user'), c AS (SELECT a.key, count(*)::BIGINT AS words, count_if(b.word IS NULL)::BIGINT AS lost FROM a LEFT JOIN b ON a.key = b.key AND a.word = b.word GROUP BY a.key) SELECT *, CASE WHEN lost / words > 0.20 THEN 'ERROR' WHEN lost / words >= 0.05 THEN 'WARNING' ELSE 'OK' END AS severity FROM c")
def agg23_lost_words(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), "role", "text")
    return reports.lost_words(turns.where("role = 'user'"), turns.where("role != 'user'"))


@query("agg25_chart_facts", "WITH p AS (SELECT o_custkey, year(o_orderdate)::INT AS yr, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2), s AS (SELECT *, lag(total) OVER (PARTITION BY o_custkey ORDER BY yr) AS b, max(total) OVER (PARTITION BY o_custkey) AS top FROM p), f AS (SELECT o_custkey, (arg_max(yr, total)) AS highest, max(total) AS high, arg_min(yr, total) AS lowest, min(total) AS low, coalesce(count_if(total > b), 0)::BIGINT AS rises, coalesce(count_if(total < b), 0)::BIGINT AS falls, count_if(top > 0 AND (top - total) / top <= 0.15)::BIGINT - 1 AS near_top, count(*)::BIGINT AS n FROM s GROUP BY o_custkey) SELECT *, CASE WHEN n < 2 THEN 'none' WHEN falls = 0 THEN 'rises' WHEN rises = 0 THEN 'falls' ELSE 'varies' END AS trend FROM f")
def agg25_chart_facts(spark, sf_dir):
    points = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("yr")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return reports.extremes(points, "o_custkey", order="yr", label="yr", value="total")


@query("str2_positions", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id)::BIGINT AS position FROM events WHERE event_type = (SELECT min(event_type) FROM events)")
def str2_positions(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kind = events.agg(F.min("event_type").alias("event_type"))
    waiting = events.join(F.broadcast(kind), "event_type").select("event_id", F.struct("ts", "event_id").alias("arrival"), F.date_trunc("hour", "ts").alias("bucket"))
    return reports.positions(waiting, "arrival").select("event_id", F.col("position").cast("long"))


@query("src23_ttl_cache", "WITH e AS (SELECT user_id, event_type, event_id, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events) SELECT event_id, before IS NOT NULL AND ts - before <= INTERVAL 3600 SECOND AS hit FROM e")
def src23_ttl_cache(spark, sf_dir):
    """Would a cache keyed by user and type, whose entries live an hour and are renewed, have had each event's answer?"""
    before = F.lag("ts").over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    events = table(spark, sf_dir, "events").withColumn("before", before)
    return events.select("event_id", (F.col("before").isNotNull() & (F.col("ts") - F.col("before") <= F.expr("INTERVAL 3600 SECONDS"))).alias("hit"))


# ---- formulas: made of the numbers of parts and lines ----


def equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """expr_id, source: a quadratic, a fraction, a quantity or a set, by the part's key."""
    n, m, k = F.col("p_size"), F.floor("p_retailprice").cast("int"), F.col("p_partkey") % 5
    source = F.when(k == 0, F.format_string("%dx² - %dx + 1 = 0", n, m)).when(k == 1, F.format_string("y = \\frac{%d + \\sqrt{%d}}{2a}", n, m)).when(k == 2, F.format_string("v = %d m/s", n)).when(k == 3, F.format_string("%d ∈ {1, 2, %d}", n, m)).otherwise(F.format_string("f(x) = %d(x + 1)(x - %d", n, m))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("expr_id"), source.alias("source"))


@query("exp42_formulas")
def exp42_formulas(spark, sf_dir):
    return formulas.processed(equations(spark, sf_dir), "source").select("expr_id", "source", "formula.*")


@query("exp29_tree_nodes")
def exp29_tree_nodes(spark, sf_dir):
    return formulas.tree_nodes(exp42_formulas(spark, sf_dir), "expr_id")


@query("agg16_formula_metrics")
def agg16_formula_metrics(spark, sf_dir):
    return formulas.metrics(exp42_formulas(spark, sf_dir))


@query("agg11_formula_index")
def agg11_formula_index(spark, sf_dir):
    return formulas.occurrences_that_differ(exp42_formulas(spark, sf_dir))


@query("exp2_segments")
def exp2_segments(spark, sf_dir):
    return formulas.segmented(blocks.lines_of(documents(spark, sf_dir)), ["doc_id", "line_no"], "line")


_WORDS_SQL = "ones AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{w}')" for k, w in enumerate(V.SMALL)) + ") t(n, w)), tens AS (SELECT * FROM (VALUES " + ", ".join(f"({k + 2}, '{w}')" for k, w in enumerate(V.TENS)) + ") t(n, w)), low AS (SELECT p_size AS n, CASE WHEN p_size < 20 THEN o.w WHEN p_size % 10 = 0 THEN t.w ELSE t.w || ' e ' || u.w END AS words, p_partkey FROM part LEFT JOIN ones o ON o.n = p_size LEFT JOIN tens t ON t.n = p_size // 10 LEFT JOIN ones u ON u.n = p_size % 10)"


@query("voc1_number_words", f"WITH {_WORDS_SQL} SELECT p_partkey, words FROM low")
def voc1_number_words(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", V.number_in_words(F.col("p_size")).alias("words"))


@query("voc4_text_in_words")
def voc4_text_in_words(spark, sf_dir):
    lines = blocks.lines_of(documents(spark, sf_dir)).where(F.col("line").rlike("[0-9]"))
    return lines.select("doc_id", "line_no", V.with_units_in_words(F.col("line")).alias("said"))


@query("exp12_script_candidates", f"WITH {_LINES} SELECT doc_id, line_no::INT AS line_no, len(list_filter(regexp_extract_all(line, '[A-Za-z0-9_]+'), lambda t: regexp_full_match(t, '[A-Za-z][0-9]')))::INT AS n FROM lines WHERE len(list_filter(regexp_extract_all(line, '[A-Za-z0-9_]+'), lambda t: regexp_full_match(t, '[A-Za-z][0-9]'))) > 0")
def exp12_script_candidates(spark, sf_dir):
    found = blocks.lines_of(documents(spark, sf_dir)).select("doc_id", "line_no", F.size(formulas.script_candidates(F.col("line"))).alias("n"))
    return found.where("n > 0")


_EQUATIONS = "e AS (SELECT p_partkey AS expr_id, CASE p_partkey % 5 WHEN 0 THEN p_size || 'x² - ' || floor(p_retailprice)::INT || 'x + 1 = 0' WHEN 1 THEN 'y = \\frac{' || p_size || ' + \\sqrt{' || floor(p_retailprice)::INT || '}}{2a}' WHEN 2 THEN 'v = ' || p_size || ' m/s' WHEN 3 THEN p_size || ' ∈ {1, 2, ' || floor(p_retailprice)::INT || '}' ELSE 'f(x) = ' || p_size || '(x + 1)(x - ' || floor(p_retailprice)::INT END AS source FROM part)"


@query("exp5_boundaries", f"WITH {_EQUATIONS} SELECT expr_id, length(replace(source, ')', '')) = length(replace(source, '(', '')) AS parentheses, length(replace(source, '}}', '')) = length(replace(source, '{{', '')) AS brackets, NOT regexp_matches(source, '[-+*/·×÷±]$') AS operands, NOT list_contains(list_transform(string_split(source, '='), lambda p: trim(p)), '') AS relation FROM e")
def exp5_boundaries(spark, sf_dir):
    return equations(spark, sf_dir).select("expr_id", maths.boundary(F.col("source")).alias("b")).select("expr_id", "b.parentheses", "b.brackets", "b.operands", "b.relation")


@query("exp6_expansion", f"WITH {_EQUATIONS} SELECT expr_id, CASE WHEN expr_id % 5 = 4 THEN source || ' )' ELSE source END AS text, (expr_id % 5 = 4)::INT AS used FROM e")
def exp6_expansion(spark, sf_dir):
    wide = maths.expanded(F.col("source"), F.array(F.lit(")"), F.lit("+ 1")))
    return equations(spark, sf_dir).select("expr_id", wide.alias("w")).select("expr_id", "w.text", "w.used")


@query("exp11_probability")
def exp11_probability(spark, sf_dir):
    return equations(spark, sf_dir).select("expr_id", maths.probability(F.col("source")).alias("probability"))


@query("exp19_likeness", f"WITH {_EQUATIONS}, t AS (SELECT expr_id, list_distinct(regexp_extract_all(regexp_replace(translate(lower(source), '⁰¹²³⁴⁵⁶⁷⁸⁹', '0123456789'), '[\\^_{{}}\\s]', '', 'g'), '[0-9]+|[a-z]+|[^\\p{{L}}\\p{{N}}_\\s]')) AS k FROM e) SELECT a.expr_id, len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k))) AS likeness FROM t a JOIN t b ON b.expr_id = a.expr_id + 5")
def exp19_likeness(spark, sf_dir):
    e = equations(spark, sf_dir)
    other = e.select((F.col("expr_id") - 5).alias("expr_id"), F.col("source").alias("other"))
    return e.join(other, "expr_id").select("expr_id", maths.likeness(F.col("source"), F.col("other")).alias("likeness"))


@query("val30_lost_terms", "WITH t AS (SELECT p_partkey, regexp_extract_all(lower(p_name), '[0-9]+|[a-z]+') AS a, regexp_extract_all(lower(p_type), '[0-9]+|[a-z]+') AS b FROM part), u AS (SELECT p_partkey, unnest(list_distinct(a)) AS term, a, b FROM t) SELECT p_partkey, term, (len(list_filter(a, lambda x: x = term)) - len(list_filter(b, lambda x: x = term)))::INT AS more FROM u WHERE len(list_filter(a, lambda x: x = term)) > len(list_filter(b, lambda x: x = term))")
def val30_lost_terms(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(maths.lost_terms(F.col("p_name"), F.col("p_type"))).alias("l")).select("p_partkey", "l.term", "l.more")


@query("cls24_hedges")
def cls24_hedges(spark, sf_dir):
    found = maths.hedges(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", found.alias("hedges")).where(F.size("hedges") > 0)


@query("cls25_kept_content")
def cls25_kept_content(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    after = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))
    return turns.withColumn("after", after).where("after IS NOT NULL").select("conv_id", "turn", T.kept_content(F.col("text"), F.col("after")).alias("kept"))


@query("txt40_glossary")
def txt40_glossary(spark, sf_dir):
    words = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split(F.lower("p_type"), " ")).alias("word"))
    return words.select("p_partkey", "word", tables.translated(F.col("word")).alias("t")).select("p_partkey", "word", "t.term", "t.known")


@query("agg28_table_summaries")
def agg28_table_summaries(spark, sf_dir):
    rows = blocks.parsed(documents(spark, sf_dir)).where("type = 'table' AND size(rows) > 0")
    return rows.select("doc_id", "ord", tables.summary(F.col("rows")).alias("summary"))


@query("agg29_axis_order")
def agg29_axis_order(spark, sf_dir):
    points = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_set(F.year("o_orderdate"))), lambda y: y.cast("string")).alias("labels"))
    return points.select("o_custkey", tables.axis_order(F.lit("x"), F.col("labels")).alias("axis"))


@query("txt36_json_repair")
def txt36_json_repair(spark, sf_dir):
    cut = F.expr("substring(props, 1, length(props) - event_id % 3)")
    return table(spark, sf_dir, "events").select("event_id", tables.repaired_json(cut).alias("json"))


@query("win18_joined_lines")
def win18_joined_lines(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(tables.joined_lines(F.col("text"))).alias("digest"))


@query("win13_runs")
def win13_runs(spark, sf_dir):
    return layout.runs_of(layout.classified(layout.line_regions(documents(spark, sf_dir))), "text_clean")


@query("agg6_joined_pieces")
def agg6_joined_pieces(spark, sf_dir):
    return layout.joined_pieces(layout.line_regions(documents(spark, sf_dir))).select("doc_id", "region_idx", "piece")


@query("jon22_overlaps")
def jon22_overlaps(spark, sf_dir):
    regions = layout.line_regions(documents(spark, sf_dir)).withColumn("y1", F.col("y1") + 4).withColumn("type", F.when(F.col("region_idx") % 2 == 0, "unknown").otherwise("text"))
    return layout.overlaps(regions, 0.10)


@query("jon4_uncovered")
def jon4_uncovered(spark, sf_dir):
    """Lines of clean text are the known regions; all others are candidates."""
    regions = layout.classified(layout.line_regions(documents(spark, sf_dir))).withColumn("y1", F.col("y0") + 200)
    known = F.col("class") == "text_clean"
    return layout.uncovered(regions.where(~known), regions.where(known)).select("doc_id", "region_idx")


@query("src37_txt")
def src37_txt(spark, sf_dir):
    return render.txt(blocks.parsed(documents(spark, sf_dir))).select("doc_id", F.md5("txt").alias("digest"))


@query("src41_html")
def src41_html(spark, sf_dir):
    return render.html(blocks.parsed(documents(spark, sf_dir))).select("doc_id", F.length("html").alias("letters"))


@query("src47_ssml")
def src47_ssml(spark, sf_dir):
    return render.ssml(blocks.parsed(documents(spark, sf_dir))).select("doc_id", F.length("ssml").alias("letters"))


@query("src48_chunks")
def src48_chunks(spark, sf_dir):
    return render.chunks(documents(spark, sf_dir), "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max(F.length("chunk")).alias("longest"))


@query("src50_pandoc")
def src50_pandoc(spark, sf_dir):
    return render.pandoc(blocks.parsed(documents(spark, sf_dir))).select("doc_id", F.length("pandoc").alias("letters"))


@query("str1_counts_by_hour", "SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def str1_counts_by_hour(spark, sf_dir):
    """The streaming count's expressions over the whole table at once; tests run them as a stream."""
    return intake.counts(table(spark, sf_dir, "events"), "ts", "event_type")


@query("val14_issue_ledger")
def val14_issue_ledger(spark, sf_dir):
    sources = equations(spark, sf_dir)
    records = formulas.processed(sources.select("source").where("source IS NOT NULL").distinct(), "source").select("source", "formula.*")
    # what is wrong with a source is wrong with each formula that has it
    found = sources.join(validators.of_records(records, "source").withColumnRenamed("object", "source"), "source")
    parts = [found.select(F.col("expr_id").cast("string").alias("object"), "check", "severity", "evidence"), validators.of_blocks(blocks.parsed(documents(spark, sf_dir)))]
    return validators.union(parts).groupBy("check", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("object").alias("objects"))


@query("val25_table_cells", "WITH a AS (SELECT l_orderkey AS table_id, l_linenumber AS row, l_returnflag AS text FROM lineitem), b AS (SELECT l_orderkey AS table_id, l_linenumber AS row, CASE WHEN l_quantity > 25 THEN l_returnflag ELSE 'x' END AS out FROM lineitem WHERE l_linenumber < 5) SELECT a.table_id::VARCHAR AS object, CASE WHEN out IS NULL THEN 'celula_perdida' ELSE 'celula_alterada' END AS \"check\", 'BLOCKER' AS severity, a.row || ',1' AS evidence FROM a LEFT JOIN b USING (table_id, row) WHERE out IS NULL OR text <> out")
def val25_table_cells(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row"), F.lit(1).alias("col"), F.col("l_returnflag").alias("text"), "l_quantity")
    output = cells.where("row < 5").withColumn("text", F.when(F.col("l_quantity") > 25, F.col("text")).otherwise("x"))
    return validators.of_tables(cells.drop("l_quantity"), output.drop("l_quantity"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slice_language_and_noise(spark, sf_dir)


from textloom.plans import more  # noqa: E402, F401  (adds its queries)
