"""Blocks to text, HTML, SSML and Pandoc JSON: a string for each document, built from its blocks in order.

Blocks are rows of doc_id, ord, type, level, text, item, rows, start, as the line grammar gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T

PROFILES = {"html": ("basic", "detailed", "technical"), "developer_debug": ("basic", "detailed", "technical"), "pdf": ("basic", "detailed"), "docx": ("basic", "detailed"), "txt": ("basic",)}


def allowed(verbosity: Column, profile: str) -> Column:
    return F.coalesce(verbosity, F.lit("basic")).isin(*PROFILES[profile])


def transposed(rows: Column) -> Column:
    """A grid whose top row is of numbers and whose first column of words, each by half at least."""
    number = lambda c: F.regexp_replace(c, r"R\$|km/h|m²|[.,% -]", "").rlike("^[0-9]+$")
    top = F.slice(rows[0], 2, 1 << 20)
    labels = F.transform(F.slice(rows, 2, 1 << 20), lambda r: r[0])
    numbers = F.size(F.filter(top, number))
    words = F.size(F.filter(labels, lambda c: (c != "") & ~number(c)))
    half = lambda n: F.greatest(F.lit(1), F.floor(n / 2).cast("int"))
    return (F.size(rows) >= 2) & (F.size(rows[0]) >= 2) & (numbers >= half(F.size(top))) & (words >= half(F.size(labels)))


def table_lines(rows: Column) -> Column:
    """A line about the table, then one for each row with its headings; turned tables are read by columns."""
    body = F.slice(rows, 2, 1 << 20)
    pairs = lambda names, values: F.array_join(F.zip_with(names, values, lambda a, b: F.concat_ws(": ", a, b)), "; ")
    about = F.concat(F.lit("Tabela com "), F.size(body).cast("string"), F.lit(" registros e "), F.size(rows[0]).cast("string"), F.lit(" colunas. Cabeçalhos: "), F.array_join(rows[0], ", "), F.lit("."))
    straight = F.concat(F.array(about), F.transform(body, lambda r, i: F.concat(F.lit("Linha "), (i + 1).cast("string"), F.lit(": "), pairs(rows[0], r), F.lit("."))))
    names = F.transform(body, lambda r: r[0])
    turned_about = F.concat(F.lit("Tabela com "), (F.size(rows[0]) - 1).cast("string"), F.lit(" registros e "), F.size(rows).cast("string"), F.lit(" atributos. Eixo: "), rows[0][0], F.lit(". Séries: "), F.array_join(names, ", "), F.lit("."))
    turned = F.concat(F.array(turned_about), F.transform(F.slice(rows[0], 2, 1 << 20), lambda x, i: F.concat(rows[0][0], F.lit(" "), x, F.lit(" — "), pairs(names, F.transform(body, lambda r: F.get(r, i + 1))), F.lit("."))))
    empty = F.array(F.concat(F.lit("Tabela sem registros de dados. Cabeçalhos: "), F.array_join(rows[0], ", "), F.lit(".")))
    return F.when(F.size(rows) == 0, F.array().cast("array<string>")).when(F.size(rows) == 1, empty).when(transposed(rows), turned).otherwise(straight)


def joined_flow(parts: Column) -> Column:
    """Pieces in one line, no space before punctuation, doubled punctuation once."""
    return F.regexp_replace(F.regexp_replace(F.array_join(F.filter(F.transform(parts, lambda c: F.trim(c)), lambda p: p != ""), " "), r" ([.,;:!?)\]}%])", "$1"), r"([.,;:!?])\1+", "$1")


def _in_order(blocks: DataFrame, line: Column, name: str) -> DataFrame:
    """A document's lines in order, one string; a document is a row, as its text was."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda b: b["line"])
    return blocks.groupBy("doc_id").agg(F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n").alias(name))


def txt(blocks: DataFrame) -> DataFrame:
    line = F.when(F.col("type") == "table", F.array_join(table_lines(F.col("rows")), "\n")).when(F.col("type") == "list", F.concat(F.coalesce(F.concat(F.col("start").cast("string"), F.lit(". ")), F.lit("- ")), F.col("item"))).otherwise(T.without_technical_marks(F.col("text")))
    return _in_order(blocks, line, "txt")


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html(blocks: DataFrame, language: str = "pt-BR") -> DataFrame:
    cell = lambda tag, scope="": lambda c: F.concat(F.lit(f"<{tag}{scope}>"), _escaped(c), F.lit(f"</{tag}>"))
    row = lambda r, tag, scope="": F.concat(F.lit("<tr>"), F.array_join(F.transform(r, cell(tag, scope)), ""), F.lit("</tr>"))
    rows = F.col("rows")
    table = F.concat(F.lit("<table>"), row(rows[0], "th", ' scope="col"'), F.array_join(F.transform(F.slice(rows, 2, 1 << 20), lambda r: row(r, "td")), ""), F.lit("</table>"))
    level = F.col("level").cast("string")
    heading = F.concat(F.lit("<h"), level, F.lit(' id="s'), F.col("ord").cast("string"), F.lit('">'), _escaped(F.col("text")), F.lit("</h"), level, F.lit(">"))
    item = F.when(F.col("start").isNotNull(), F.concat(F.lit('<ol start="'), F.col("start").cast("string"), F.lit('"><li>'), _escaped(F.col("item")), F.lit("</li></ol>"))).otherwise(F.concat(F.lit("<ul><li>"), _escaped(F.col("item")), F.lit("</li></ul>")))
    line = F.when(F.col("type") == "heading", heading).when(F.col("type") == "list", item).when((F.col("type") == "table") & (F.size(rows) > 0), table).when(F.col("type") == "code", F.concat(F.lit("<pre><code>"), _escaped(F.col("text")), F.lit("</code></pre>"))).when(F.col("type") == "paragraph", F.concat(F.lit("<p>"), _escaped(F.col("text")), F.lit("</p>")))
    contents = F.array_join(F.transform(F.array_sort(F.filter(F.collect_list(F.when(F.col("type") == "heading", F.struct("ord", "text"))), lambda h: h.isNotNull())), lambda h: F.concat(F.lit('<li><a href="#s'), h["ord"].cast("string"), F.lit('">'), _escaped(h["text"]), F.lit("</a></li>"))), "")
    body, toc = _in_order(blocks, line, "body"), blocks.groupBy("doc_id").agg(contents.alias("toc"))
    page = F.concat(F.lit(f'<!DOCTYPE html>\n<html lang="{language}"><head><meta charset="utf-8"></head><body>'), F.when(F.col("toc") != "", F.concat(F.lit("<nav><ol>"), F.col("toc"), F.lit("</ol></nav>"))).otherwise(""), F.lit("<main>\n"), F.col("body"), F.lit("\n</main></body></html>"))
    return body.join(toc, "doc_id").select("doc_id", page.alias("html"))


def ssml(blocks: DataFrame) -> DataFrame:
    said = F.coalesce("text", "item", F.array_join(table_lines(F.col("rows")), " "))
    line = F.concat(F.lit("  "), _escaped(said), F.when(F.col("type") == "heading", '\n  <break time="700ms"/>').otherwise('\n  <break time="400ms"/>'))
    return _in_order(blocks.where(said != ""), line, "body").select("doc_id", F.concat(F.lit("<speak>\n"), F.col("body"), F.lit("\n</speak>")).alias("ssml"))


def pandoc(blocks: DataFrame) -> DataFrame:
    """Pandoc's JSON of headings, paragraphs, lists and code."""
    text = F.coalesce("text", "item", F.array_join(table_lines(F.col("rows")), " "))
    inline = F.array(F.struct(F.lit("Str").alias("t"), text.alias("c")))
    para = F.to_json(F.struct(F.lit("Para").alias("t"), inline.alias("c")))
    head = F.concat(F.lit('{"t":"Header","c":['), F.col("level").cast("string"), F.lit(',["",[],[]],'), F.to_json(inline), F.lit("]}"))
    block = F.when(F.col("type") == "heading", head).otherwise(para)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", block.alias("b")))), lambda x: x["b"])
    return blocks.groupBy("doc_id").agg(F.concat(F.lit('{"pandoc-api-version":[1,23],"meta":{},"blocks":['), F.array_join(parts, ","), F.lit("]}")).alias("pandoc"))


def chunks(texts: DataFrame, key: str, column: str, size: int = 1500) -> DataFrame:
    """Lines packed in order into pieces of fewer than `size` letters; a longer line is a piece. key, ord, chunk."""
    empty = F.array().cast("array<string>")

    def step(a: Column, line: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        fits = (F.size(a) > 0) & (F.length(last) + F.length(line) + 1 < size)
        grown = F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.concat(F.coalesce(last, F.lit("")), F.lit("\n"), line)))
        return F.when(fits, grown).otherwise(F.concat(a, F.array(line)))

    # of an empty array the last is null, which leaves `fits` false
    packed = F.aggregate(F.split(column, "\n"), empty, step)
    return texts.select(key, F.posexplode(packed).alias("ord", "chunk"))


def written(rows: DataFrame, column: str, path: str) -> None:
    """One text file a partition, a document a line, line breaks escaped; the sink for millions of documents."""
    rows.select("doc_id", F.to_json(F.struct("doc_id", column)).alias("value")).select("value").write.mode("overwrite").text(path)
