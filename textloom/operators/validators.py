"""The ledger of issues: what was lost or leaked, a row each: object, check, severity, evidence.

The checks of one table are an array of its rows; the ledger is their union, which gates and metrics group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.sources import render

#: A kind of node and the marks it leaves in LaTeX, MathML, OMML and speech: fixed values.
MARKS = {
    "Power": ("^{", "<msup>", "<m:sSup>", "quadrado|cubo|elevado"), "Subscript": ("_{", "<msub>", "<m:sSub>", ""), "Sqrt": (r"\sqrt", "<msqrt>|<mroot>", "<m:rad>", "raiz"),
    "Divide": (r"\frac", "<mfrac>", "<m:f>", "sobre|fração"), "PlusMinus": (r"\pm", "&#x00B1;", "±", "mais ou menos"),
}
ISSUES = "array<struct<check:string,severity:string,evidence:string>>"


def _issue(rows: DataFrame, key: Column, check: str, severity: str, bad: Column, evidence: Column) -> DataFrame:
    return _listed(rows, key, _found([(check, severity, bad, evidence)]))


def _found(checks: list[tuple[str, str, Column, Column]]) -> Column:
    """An array of what the checks (check, severity, bad, evidence) find in a row, so all of them read it once."""
    made = (F.when(bad, F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), evidence.cast("string").alias("evidence"))) for check, severity, bad, evidence in checks)
    return F.filter(F.array(*made), lambda i: i.isNotNull())


def _listed(rows: DataFrame, key: Column, found: Column) -> DataFrame:
    return rows.select(key.cast("string").alias("object"), F.explode(found).alias("i")).select("object", "i.*")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def of_formulas(records: DataFrame, key: str) -> DataFrame:
    """The checks of single formulas, from records with an array of `severity:check`."""
    return _listed(records, F.col(key), _own_issues())


def _own_issues() -> Column:
    return F.transform("issues", lambda i: F.struct(F.substring_index(i, ":", -1).alias("check"), F.substring_index(i, ":", 1).alias("severity"), F.col("source").cast("string").alias("evidence")))


def of_serialisations(records: DataFrame, key: str) -> DataFrame:
    """Kinds of nodes in a tree without their mark in one of the formats, and numbers that a format lacks."""
    return _listed(records, F.col(key), _found(_of_serialisations()))


def _of_serialisations() -> list[tuple[str, str, Column, Column]]:
    checks = []
    for kind, marks in MARKS.items():
        has = F.contains("ast_json", F.lit(f'"tipo": "{kind}"'))
        for name, mark in zip(("latex", "mathml", "omml", "speech"), marks, strict=True):
            if mark:
                there = reduce(Column.__or__, (F.contains(name, F.lit(m)) for m in mark.split("|")))
                checks.append((f"{kind}_{name}", "ERROR", has & ~there, F.col(name)))
    for name in ("latex", "mathml"):
        digits = F.transform(F.regexp_extract_all(name, F.lit("[0-9]+(?:[.,][0-9]+)?"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(".")))
        checks.append((f"numbers_{name}", "BLOCKER", F.size(F.array_except("numbers", digits)) > 0, F.array_join(F.array_except("numbers", digits), ", ")))
    return checks


def of_records(records: DataFrame, key: str) -> DataFrame:
    """The rows of of_formulas, of_serialisations and of_speech, with each record made and read once."""
    found = _found([*_of_serialisations(), *_of_speech()])
    return _listed(records, F.col(key), F.concat(F.coalesce(_own_issues(), F.array().cast(ISSUES)), found))


def of_blocks(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Layout told instead of read, leaks, Markdown left, headings that skip a level, tables whose rows differ in width."""
    key, text = F.concat_ws(":", "doc_id", order), F.coalesce("text", "item", F.lit(""))
    widths = F.array_distinct(F.transform("rows", lambda r: F.size(r)))
    heading, table = F.col("type") == "heading", F.col("type") == "table"
    # blocks.skipped_levels, over rows that aren't all headings
    before = F.last(F.when(heading, F.struct("level")), ignorenulls=True).over(W.partitionBy("doc_id").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    levels = rows.withColumn("previous", F.coalesce(before, F.struct(F.lit(0).alias("level")))["level"])
    return _listed(
        levels,
        key,
        _found(
            [
                ("narracao_de_layout", "WARNING", T.layout_phrases(text) >= 2, text),
                ("vazamento", "BLOCKER", T.leaks_prompt(text), text),
                ("termos_internos", "ERROR", F.size(T.internal_terms(text)) > 0, F.array_join(T.internal_terms(text), ", ")),
                ("markdown", "WARNING", (F.col("type") != "code") & T.has_markdown(text), text),
                ("tabela_irregular", "ERROR", table & (F.size(widths) > 1), F.array_join(F.transform(widths, lambda w: w.cast("string")), ", ")),
                ("tabela_vazia", "BLOCKER", table & (F.size("rows") == 0), F.lit("")),
                ("niveis", "WARNING", heading & (F.col("level") > F.col("previous") + 1), F.concat_ws(" > ", "previous", "level")),
            ]
        ),
    )


def of_profile(rows: DataFrame, profile: str) -> DataFrame:
    """Blocks whose verbosity the profile doesn't allow; rows: doc_id, ord, verbosity."""
    return _issue(rows, F.concat_ws(":", "doc_id", "ord"), "perfil", "ERROR", ~render.allowed(F.col("verbosity"), profile), F.col("verbosity"))


def of_tables(origin: DataFrame, output: DataFrame) -> DataFrame:
    """origin, output: table_id, row, col, text. Cells that are gone, new or changed."""
    both = origin.join(output.select("table_id", "row", "col", F.col("text").alias("out")), ["table_id", "row", "col"], "full")
    kind = F.when(F.col("out").isNull(), "celula_perdida").when(F.col("text").isNull(), "celula_nova").when(T.tidy(F.col("text")) != T.tidy(F.col("out")), "celula_alterada")
    bad = both.withColumn("check", kind).where("check IS NOT NULL")
    return bad.select(F.col("table_id").cast("string").alias("object"), "check", F.when(F.col("check") == "celula_nova", "WARNING").otherwise("BLOCKER").alias("severity"), F.concat_ws(",", "row", "col").alias("evidence"))


def of_speech(spoken: DataFrame, key: str) -> DataFrame:
    """Signs that are read instead of said, and English words; spoken: key, speech."""
    return _listed(spoken, F.col(key), _found(_of_speech()))


def _of_speech() -> list[tuple[str, str, Column, Column]]:
    english = F.filter(F.split(F.lower("speech"), r"\s+"), lambda w: w.isin("the", "of", "and", "equals", "plus", "minus", "times", "square", "root", "over"))
    return [
        ("simbolo_na_fala", "ERROR", F.col("speech").rlike(r"[²³¹⁰⁴-⁹₀-₉√±≥≤≠∑∫^_\\]"), F.col("speech")),
        ("idioma_da_fala", "WARNING", F.size(english) > 0, F.array_join(english, ", ")),
    ]


def equal_outputs(one: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """Documents whose outputs in two formats, but for white space, differ; each: doc_id, column."""
    both = one.select("doc_id", F.col(column).alias("a")).join(other.select("doc_id", F.col(column).alias("b")), "doc_id", "full")
    return _issue(both, F.col("doc_id"), "derivacao_unica", "ERROR", ~T.tidy(F.col("a")).eqNullSafe(T.tidy(F.col("b"))), F.col("b"))


def numbered(issues: DataFrame) -> DataFrame:
    """Adds how many issues of its check an object has had so far, for reports that show the first few."""
    return issues.withColumn("n", F.row_number().over(W.partitionBy("object", "check").orderBy("evidence")))
