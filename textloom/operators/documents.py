"""Canonical documents: paragraphs with formulas, clean blocks, one row a document, and what is written of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import context, formulas
from textloom.sources import render

# ---- fixed values ----

TECHNICAL = ("accessibilityAudit", "acessilia", "publicationDecision", "revisao_textual", "trilha", "metadata", "validation_issues", "review_status", "source_text", "uncertainties", "confidence", "source_hash", "review_events")
DEBUG_PROFILE = "developer_debug"
MARKERS = {
    "code_block": ("Início de código-fonte:", "Fim de código-fonte"), "list_block": ("Início de lista:", "Fim de lista"), "callout_box": ("Início de box:", "Fim de box"),
    "embedded_image": ("Início de imagem:", "Fim de imagem"), "formula": ("Início de fórmula:", "Fim de fórmula"),
}
CALLOUTS = {"note": "nota", "quote": "citação", "sidebar": "barra lateral", "warning": "aviso", "tip": "dica", "important": "importante"}
EMOJI = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{1F1E6}-\\x{1F1FF}\\x{FE0F}]+"
AXES = {"x": "Eixo horizontal", "y": "Eixo vertical"}
DRAFT = "_rascunho_nao_aprovado"


# ---- paragraphs and blocks ----


def paragraph_blocks(rows: DataFrame, key: list[str], column: str) -> DataFrame:
    """key, part, type (paragraph or math), text, flow: a paragraph cut into text and formulas. Text of signs alone goes with the next text; a flow has several parts."""
    pieces = formulas.segmented(rows, key, column).where(F.trim("piece") != "")
    after = W.partitionBy(*key).orderBy("ord").rowsBetween(W.currentRow, W.unboundedFollowing)
    speaks = F.col("maths") | F.col("piece").rlike(r"(?U)[\p{L}\p{N}]")
    goes_to = F.when(F.col("maths"), F.col("ord")).otherwise(F.min(F.when(speaks & ~F.col("maths"), F.col("ord"))).over(after))
    placed = pieces.withColumn("part", goes_to).where("part IS NOT NULL")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "piece"))), lambda p: p["piece"]), "")
    parts = placed.groupBy(*key, "part").agg(F.bool_or("maths").alias("maths"), said.alias("text"))
    several = F.count(F.lit(1)).over(W.partitionBy(*key)) > 1
    clean = F.when(F.col("maths"), F.trim("text")).otherwise(T.block_text(F.col("text"), F.lit("paragraph")))
    cut = parts.select(*key, "part", F.when(F.col("maths"), "math").otherwise("paragraph").alias("type"), clean.alias("text"), F.when(several, F.concat_ws("-", F.lit("fx"), *key)).alias("flow"))
    none = rows.join(parts.where("maths").select(*key).distinct(), key, "left_anti")
    whole = none.select(*key, F.lit(0).alias("part"), F.lit("paragraph").alias("type"), T.block_text(F.col(column), F.lit("paragraph")).alias("text"), F.lit(None).cast("string").alias("flow"))
    return cut.join(none.select(*key), key, "left_anti").unionByName(whole)


def maths_cells(tables: DataFrame, key: str, rows: str = "rows") -> DataFrame:
    """key, row, col of the cells with a formula, but for the headings."""
    cells = tables.select(key, F.posexplode(rows).alias("row", "cells")).where("row > 0").select(key, "row", F.posexplode("cells").alias("col", "cell"))
    found = formulas.segmented(cells.withColumn("cell", F.trim("cell")), [key, "row", "col"], "cell")
    return found.where("maths").select(key, "row", "col").distinct()


def first_explanations(blocks: DataFrame, order: str = "ord") -> DataFrame:
    """Adds suppressed: an explanation stays at the first place of its formula in a document (latex, else source_text) and is null after it."""
    name = F.trim(F.coalesce(F.when(F.trim("latex") != "", F.col("latex")), F.col("source_text"), F.lit("")))
    told = (F.coalesce("explanation", F.lit("")) != "") & (F.col("name") != "")
    n = F.sum(told.cast("int")).over(W.partitionBy("doc_id", "name").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    marked = blocks.withColumn("name", name).withColumn("suppressed", told & (n > 1))
    return marked.withColumn("explanation", F.when(~F.col("suppressed"), F.col("explanation"))).drop("name")


def sanitised(blocks: DataFrame) -> DataFrame:
    """The blocks with clean text, titles, descriptions, items and cells; code stays."""
    clean = lambda c, kind="paragraph": T.block_text(c, F.lit(kind))
    out = blocks.withColumn("text", F.when(F.col("type") != "code", T.block_text(F.col("text"), F.col("type"))).otherwise(F.col("text")))
    for name in ("title", "alt_text", "long_description", "item"):
        if name in blocks.columns:
            out = out.withColumn(name, clean(F.col(name)))
    if "items" in blocks.columns:
        out = out.withColumn("items", F.transform("items", clean))
    return out.withColumn("rows", F.transform("rows", lambda r: F.transform(r, clean))) if "rows" in blocks.columns else out


def canonical(blocks: DataFrame, given: DataFrame, page_blocks: DataFrame | None = None, language: str = "pt-BR", verbosity: str = "detailed") -> DataFrame:
    """One row a document: title, language, counts and its blocks in order as JSON. given: doc_id, text, title (null: the first heading of level 1).

    A document that has page_blocks has these instead of the blocks read from its text.
    """
    if page_blocks is not None:
        own = page_blocks.select("doc_id").distinct()
        blocks = blocks.join(own, "doc_id", "left_anti").unionByName(sanitised(page_blocks), allowMissingColumns=True)
    first = F.min_by("text", F.when((F.col("type") == "heading") & (F.col("level") == 1), F.col("ord")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.to_json(F.struct(*(c for c in blocks.columns if c != "doc_id"))).alias("b")))), lambda x: x["b"])
    made = blocks.groupBy("doc_id").agg(first.alias("inferred"), F.count(F.lit(1)).alias("block_count"), listed.alias("blocks"), F.count_if(F.col("type") == "heading").alias("section_count"))
    titled = F.coalesce(F.when(F.col("title") != "", F.col("title")), "inferred", F.lit("Documento acessível"))
    return given.join(made, "doc_id", "left").select(
        "doc_id", titled.alias("title"), F.lit(language).alias("language"), F.lit(verbosity).alias("verbosity"), F.length(F.coalesce("text", F.lit(""))).alias("input_length"),
        F.coalesce("block_count", F.lit(0)).alias("block_count"), F.coalesce("section_count", F.lit(0)).alias("section_count"), F.coalesce("blocks", F.array().cast("array<string>")).alias("blocks"),
    )


def canonical_json(documents: DataFrame) -> DataFrame:
    """doc_id, json: each document as one JSON object."""
    return documents.select("doc_id", F.to_json(F.struct(*documents.columns)).alias("json"))


def for_student(document: DataFrame, profile: str = "") -> DataFrame:
    """Without technical columns, except in the profile for debugging."""
    return document if profile == DEBUG_PROFILE else document.drop(*TECHNICAL)


def marked(text: Column, kind: Column, label: Column) -> Column:
    """The text between the marks of its class; a callout's label names its own."""
    begin, end = (F.create_map(*(F.lit(x) for k, m in MARKERS.items() for x in (k, m[n]))) for n in (0, 1))
    own = F.element_at(F.create_map(*(F.lit(x) for kv in CALLOUTS.items() for x in kv)), label)
    left = F.coalesce(F.concat(F.lit("Início de "), own, F.lit(":")), F.element_at(begin, kind))
    right = F.coalesce(F.concat(F.lit("Fim de "), own), F.element_at(end, kind))
    return F.when(kind.isin(*MARKERS), F.concat_ws("\n", left, text, right)).otherwise(text)


def described_parts(text: Column) -> Column:
    """Array of kind and text: headings of three levels, bullets, numbers, [DESCRIÇÃO: ...] and text, paragraph by paragraph."""
    mark = r"(?iu)\[DESCRIÇÃO:\s*(.*?)\]"
    part = lambda kind, value: F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.trim(value).alias("text"))

    def of_line(line: Column) -> Column:
        around, inside = F.split(line, mark), F.regexp_extract_all(line, F.lit(mark), F.lit(1))
        mixed = F.flatten(F.zip_with(around, inside, lambda a, d: F.array(part("text", F.coalesce(a, F.lit(""))), part("description", F.coalesce(d, F.lit(""))))))
        one = (
            F.when(line.rlike("^[-*] "), part("bullet", F.substring(line, 3, 1 << 30)))
            .when(line.rlike(r"^[0-9]+\.\s"), part("number", F.regexp_replace(line, r"^.*?\. ", "")))
            .otherwise(part("text", line))
        )
        return F.when(line.rlike(mark), F.filter(mixed, lambda p: p["text"] != "")).otherwise(F.array(one))

    def of_paragraph(p: Column) -> Column:
        whole = F.regexp_extract(p, r"(?isu)^\[DESCRIÇÃO:\s*(.*?)\]$", 1)
        level = F.length(F.regexp_extract(p, "^(#{1,3}) ", 1))
        lines = F.filter(F.transform(F.split(p, "\n"), lambda x: F.trim(x)), lambda x: x != "")
        heading = F.array(part(F.concat(F.lit("h"), level.cast("string")), F.regexp_replace(p, "^#{1,3} ", "")))
        return F.when(p.rlike(r"(?isu)^\[DESCRIÇÃO:\s*(.*?)\]$"), F.array(part("description", whole))).when(level > 0, heading).otherwise(F.flatten(F.transform(lines, of_line)))

    paragraphs = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return F.flatten(F.transform(paragraphs, of_paragraph))


def for_screen_reader(text: Column) -> Column:
    """Without emoji, at most one empty line, no runs of spaces."""
    out = F.regexp_replace(text, EMOJI, "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), "[ \t]{2,}", " "), r"^\s+|\s+$", "")


def looks_structured(text: Column) -> Column:
    """Has a row of a table, a line of LaTeX or reading, or MathML."""
    return text.rlike(r"(?m)^\s*\|.+\|\s*$") | text.rlike(r"(?mi)^\s*(?:LATEX|LEITURA)\s*:") | F.contains(text, F.lit("<math"))


def axes_list(axes: Column) -> Column:
    """HTML about the axes of a chart, a map of x and y to structs of label, unit, min, max, step; empty without any."""
    def item(name: str, title: str) -> Column:
        a = F.element_at(axes, F.lit(name))
        parts = F.array_compact(F.array(
            F.when(F.coalesce(a["label"], F.lit("")) != "", render._escaped(a["label"])),
            F.when(F.coalesce(a["unit"], F.lit("")) != "", F.concat(F.lit("em "), render._escaped(a["unit"]))),
            F.when(a["min"].isNotNull() & a["max"].isNotNull(), F.concat(F.lit("de "), a["min"].cast("string"), F.lit(" a "), a["max"].cast("string"))),
            F.when(a["step"].isNotNull(), F.concat(F.lit("intervalo "), a["step"].cast("string"))),
        ))
        return F.when(F.size(parts) > 0, F.concat(F.lit(f"<li>{title}: "), F.array_join(parts, ", "), F.lit(".</li>")))

    items = F.array_compact(F.array(*(item(k, t) for k, t in AXES.items())))
    return F.when(F.size(items) > 0, F.concat(F.lit('<ul class="eixos-do-grafico">'), F.array_join(items, ""), F.lit("</ul>"))).otherwise("")


def any_text(*texts: str) -> Column:
    """The first of the texts that isn't empty: what is used when reading a file in the usual ways fails."""
    return F.coalesce(*(F.when(F.trim(c) != "", F.col(c)) for c in texts), F.lit(""))


# ---- exports ----

FORMATS: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {"txt": (render.txt, "txt"), "html": (render.html, "html"), "ssml": (render.ssml, "ssml"), "pandoc": (render.pandoc, "pandoc")}


def artefacts(blocks: DataFrame, folder: str, formats: tuple[str, ...] = tuple(FORMATS), suffix: str = "") -> dict[str, tuple[str | None, str | None]]:
    """Write every format under `folder`; format to (path, None), or (None, error) for one that failed, which doesn't stop the others."""
    out: dict[str, tuple[str | None, str | None]] = {}
    for name in formats:
        path = f"{folder}/{name}{suffix}"
        try:
            make, column = FORMATS[name]
            render.written(make(blocks), column, path)
            out[name] = path, None
        except Exception as error:  # each format stands for itself, and the caller is told
            out[name] = None, f"{type(error).__name__}: {error}"
    return out


def pending_report(decisions: DataFrame, pending: DataFrame) -> DataFrame:
    """doc_id, report: what keeps a document from being published. decisions: doc_id, name, status, label, blockers; pending: doc_id, ord, source_text, review_status, codes."""
    bar, line = "=" * 60, "-" * 60
    one = F.concat(F.lit("  "), F.col("n").cast("string"), F.lit(". "), F.substring("source_text", 1, 120), F.lit("\n     status="), F.coalesce("review_status", F.lit("?")), F.lit(" codigos="), F.when(F.size("codes") > 0, F.array_join("codes", ", ")).otherwise("-"))
    numbered = pending.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("ord")))
    listed = numbered.groupBy("doc_id").agg(F.count(F.lit(1)).alias("count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", one.alias("t")))), lambda x: x["t"]), "\n").alias("expressions"))
    head = F.concat(F.lit(f"PENDENCIAS DE PUBLICACAO\n{bar}\n\nDocumento: "), F.col("name"), F.lit("\nStatus: "), F.coalesce("status", F.lit("?")), F.lit("\nRotulo: "), F.coalesce("label", F.lit("")), F.lit("\n\nEste material NAO foi aprovado como versao acessivel final.\nEle foi gerado apenas para revisao humana.\n"))
    blocked = F.when(F.size("blockers") > 0, F.concat(F.lit(f"BLOQUEADORES\n{line}\n  - "), F.array_join("blockers", "\n  - "), F.lit("\n")))
    waiting = F.when(F.col("count") > 0, F.concat(F.lit("EXPRESSOES AGUARDANDO REVISAO ("), F.col("count").cast("string"), F.lit(f")\n{line}\n"), F.col("expressions")))
    return decisions.join(listed, "doc_id", "left").select("doc_id", F.concat_ws("\n", head, blocked, waiting).alias("report"))


def review_package(blocks: DataFrame, decisions: DataFrame, pending: DataFrame, folder: str) -> dict[str, tuple[str | None, str | None]]:
    """Drafts in every format, and the report of what is pending."""
    out = artefacts(blocks, folder, suffix=DRAFT)
    path = f"{folder}/pendencias"
    render.written(pending_report(decisions, pending), "report", path)
    return out | {"pendencias": (path, None)}


def zipped(paths: list[str], target: str) -> str | None:
    """Local files that exist in one ZIP archive; None if there is none. For the outputs of a single document."""
    import zipfile
    from pathlib import Path

    there = [Path(p) for p in paths if p and Path(p).exists()]
    if not there:
        return None
    with zipfile.ZipFile(target, "w", compression=zipfile.ZIP_DEFLATED) as archive:
        for path in there:
            archive.write(path, arcname=path.name)
    return target


# ---- blocks between marks ----

BEGIN_MARK, END_MARK = r"(?iu)^in[íi]cio de (.+):$", r"(?iu)^fim de (.+)$"
MARKED_TYPES = {"lista": "list", "código-fonte": "code", "codigo-fonte": "code", "imagem": "image", "fórmula": "formula", "formula": "formula"}


def marker_blocks(lines: DataFrame) -> DataFrame:
    """doc_id, line_no (of the mark), type, name, text, items: what stands between "Início de X:" and "Fim de X" (or the next beginning, or the end). lines: doc_id, line_no, line.

    A begin opens an island of all lines after it; the first end of its own name closes it. Other names are callouts.
    """
    w = W.partitionBy("doc_id").orderBy("line_no")
    begins = F.regexp_extract("line", BEGIN_MARK, 1)
    marked = lines.withColumn("name", F.when(begins != "", F.lower(begins))).withColumn("island", F.count("name").over(w))
    inside = marked.where("island > 0").withColumn("own", F.first("name", ignorenulls=True).over(W.partitionBy("doc_id", "island").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    ended = F.max((F.lower(F.regexp_extract("line", END_MARK, 1)) == F.col("own")).cast("int")).over(W.partitionBy("doc_id", "island").orderBy("line_no"))
    kept = inside.withColumn("ended", ended).where("ended = 0")
    content = F.transform(F.array_sort(F.collect_list(F.when(F.col("name").isNull(), F.struct("line_no", "line")))), lambda x: x["line"])
    made = kept.groupBy("doc_id", "island").agg(F.min("line_no").alias("line_no"), F.min("own").alias("name"), content.alias("content"))
    kinds = F.create_map(*(F.lit(x) for kv in MARKED_TYPES.items() for x in kv))
    kind = F.coalesce(F.element_at(kinds, F.replace("name", F.lit(" "), F.lit("-"))), F.lit("callout"))
    items = F.transform("content", lambda c: T.block_text(F.regexp_replace(c, r"^[-*+]\s+", ""), F.lit("paragraph")))
    return made.withColumn("type", kind).select("doc_id", "line_no", "type", "name", F.when(F.col("type") != "list", F.array_join("content", "\n")).alias("text"), F.when(F.col("type") == "list", items).alias("items"))


def processed_cells(tables: DataFrame, key: str, rows: str = "rows") -> DataFrame:
    """key, row, col, cell, maths (has it a formula?), context (headings and the row's other cells): every cell with what stands around it."""
    cells = tables.select(key, F.get(rows, F.lit(0)).alias("headings"), F.posexplode(rows).alias("row", "cells")).select(key, "headings", "row", "cells", F.posexplode("cells").alias("col", "cell"))
    others = F.expr("filter(transform(cells, (c, i) -> IF(i = col, CAST(NULL AS STRING), c)), c -> c IS NOT NULL)")
    around = cells.select(key, "row", "col", "cell", context.row_context(F.col("headings"), others).alias("context"))
    maths = maths_cells(tables, key, rows).withColumn("maths", F.lit(True))
    return around.join(maths, [key, "row", "col"], "left").withColumn("maths", F.coalesce("maths", F.lit(False)))
