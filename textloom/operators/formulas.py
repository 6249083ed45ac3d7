"""Formulas in columns: each different source is read once, in Arrow batches, and joined back."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import expressions as X
from textloom.functions import vocabulary as V

RECORD = (
    "ast_json string, hash string, signature string, complete boolean, latex string, mathml string, omml string, speech string, ssml string, "
    "symbols array<string>, numbers array<string>, operators array<string>, issues array<string>, status string, confidence double"
)
#: What a text must hold for a formula to be looked for; tested in the JVM, before any Python.
SIGNS = r"[=≥≤≠±√∫∑∈∉⊂⊆∪∩^⁰¹²³⁴-⁹₀-₉α-ωΑ-Ω]|\\[a-zA-Z]"


def processed(rows: DataFrame, column: str, mode: str = "estrutural") -> DataFrame:
    """rows with the record of the formula in `column`; null where that is null."""

    read = _reader(mode)
    sources = rows.select(column).where(F.col(column).isNotNull()).distinct()
    # sources are short, but each takes long: without a number of partitions a few tasks would read them all
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    different = sources.repartition(parts, column).withColumn("formula", read(column))
    return rows.join(different, column, "left")


def _reader(mode: str):
    def read(sources: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([X.processed(s, mode) for s in sources], columns=[c.split()[0] for c in RECORD.split(", ")])

    return F.pandas_udf(read, RECORD)


def tree_nodes(records: DataFrame, key: str) -> DataFrame:
    """key, node_id, parent_id, kind, value: the nodes of each tree in preorder; records: key, ast_json."""

    def rows(ast: pd.Series) -> pd.Series:
        def walk(node: dict, parent: int, out: list) -> list:
            own = len(out)
            out.append({"node_id": own, "parent_id": parent, "kind": node["tipo"], "value": node.get("valor")})
            for kid in node.get("filhos", ()):
                walk(kid, own, out)
            return out

        return ast.map(lambda a: walk(json.loads(a), -1, []))

    nodes = F.pandas_udf(rows, "array<struct<node_id:int,parent_id:int,kind:string,value:string>>")
    return records.select(key, F.explode(nodes("ast_json")).alias("n")).select(key, "n.*")


def segmented(rows: DataFrame, key: list[str], column: str) -> DataFrame:
    """Key, ord, maths, piece of the texts that hold a sign of maths; the pieces in order make up the text."""
    hot = rows.where(F.col(column).rlike(SIGNS))
    cut = _segmenter()
    return hot.select(*key, F.posexplode(cut(column)).alias("ord", "s")).select(*key, "ord", "s.maths", "s.piece")


def _segmenter():
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"maths": m, "piece": p} for m, p in X.segments(t)])

    return F.pandas_udf(cut, "array<struct<maths:boolean,piece:string>>")


def occurrences_that_differ(records: DataFrame) -> DataFrame:
    """Formulas with one hash of several LaTeX forms (a blocker) or several speeches (a warning)."""
    found = records.groupBy("hash").agg(F.count_distinct("latex").alias("latex_forms"), F.count_distinct("speech").alias("speech_forms"), F.count(F.lit(1)).alias("n"))
    return found.where("latex_forms > 1 OR speech_forms > 1").withColumn("severity", F.when(F.col("latex_forms") > 1, "BLOCKER").otherwise("WARNING"))


def metrics(records: DataFrame) -> DataFrame:
    """Counts and rates over all formulas: complete, with issues by severity, by status."""
    has = lambda severity: F.exists("issues", lambda i: i.startswith(severity))
    return records.agg(F.count(F.lit(1)).alias("formulas"), F.avg(F.col("complete").cast("double")).alias("complete_rate"), F.count_if(has("BLOCKER")).alias("blockers"), F.count_if(has("ERROR")).alias("errors"), F.count_if(F.col("status") == "needs_review").alias("to_review"), F.avg("confidence").alias("confidence"))


def script_candidates(text: Column) -> Column:
    """Letters with digits after them, which may be lost scripts; code words (with other letters around) left out."""
    return F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])([A-Za-z][0-9])(?![A-Za-z0-9_])"), F.lit(1))


def hypotheses(rows: DataFrame, candidate: str) -> DataFrame:
    """Four readings of a letter with a digit, scored by what stands around: rows need neighbours (formulas nearby), raised."""
    letter, digit = F.substring(candidate, 1, 1), F.substring(candidate, 2, 1)
    made = F.array(
        F.struct(F.lit(0).alias("o"), F.lit("power").alias("reading"), F.concat(letter, F.lit("^{"), digit, F.lit("}")).alias("latex")),
        F.struct(F.lit(1).alias("o"), F.lit("subscript").alias("reading"), F.concat(letter, F.lit("_{"), digit, F.lit("}")).alias("latex")),
        F.struct(F.lit(2).alias("o"), F.lit("product").alias("reading"), F.concat(letter, F.lit(r" \cdot "), digit).alias("latex")),
        F.struct(F.lit(3).alias("o"), F.lit("identifier").alias("reading"), F.col(candidate).alias("latex")),
    )
    spread = rows.select("*", F.explode(made).alias("h")).select("*", "h.*").drop("h")
    near = F.exists("neighbours", lambda n: F.contains(n, F.col("latex")))
    score = F.lit(0.2) + F.when(near & (F.col("reading") != "identifier"), 0.5).otherwise(0.0) + F.when((F.col("reading") == "power") & (F.col("raised") == "super"), 0.4).otherwise(0.0) + F.when((F.col("reading") == "subscript") & (F.col("raised") == "sub"), 0.4).otherwise(0.0)
    scored = spread.withColumn("score", F.least(score, F.lit(1.0)))
    best = F.max_by(F.struct("reading", "latex", "score"), F.struct("score", -F.col("o"))).alias("best")
    keys = [c for c in rows.columns if c not in ("neighbours", "raised")]
    chosen = scored.groupBy(*keys).agg(best).select(*keys, "best.*")
    return chosen.withColumn("decision", F.when((F.col("score") >= 0.9) & (F.col("reading") != "identifier"), "apply").when(F.col("score") >= 0.5, "pending").otherwise("leave"))
