"""Predicates and scores on the source of a formula, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import text as T

# ---- fixed values ----

BINARY_SIGNS = ("+", "-", "*", "/", "·", "×", "÷", "±")
RELATIONS = ("=", "≥", "≤", "≠", "<", ">")
MATHS_WORDS = (
    "equacao", "equacoes", "funcao", "funcoes", "resolver", "coeficiente", "coeficientes", "raiz", "raizes", "formula", "expressao", "grau",
    "discriminante", "polinomio", "termo", "calcular", "calculo", "substituir", "fatorar", "grafico", "parabola", "derivada", "integral",
)
CODE_WORDS = (
    "variavel", "vetor", "matriz", "array", "indice do array", "ponteiro", "funcao def", "retorna", "atribui", "armazena", "parametro",
    "coluna", "campo", "registro", "coordenada", "ponto",
)
HEDGES = ("como se", "parece estar", "aparenta estar", "prestes a", "provavelmente", "posição dinâmica", "posicao dinamica")


def _any_in(c: Column, words) -> Column:
    return reduce(Column.__or__, (F.contains(c, F.lit(w)) for w in words))


def _balance(c: Column, left: str, right: str) -> Column:
    return F.length(F.replace(c, F.lit(right), F.lit(""))) - F.length(F.replace(c, F.lit(left), F.lit("")))


def boundary(text: Column) -> Column:
    """Struct of what holds at the edges of a formula; plausible if all does."""
    t = F.trim(F.coalesce(text, F.lit("")))
    parentheses = _balance(t, "(", ")") == 0
    brackets = (_balance(t, "[", "]") == 0) & (_balance(t, "{", "}") == 0)
    radical = ~t.rlike(r"(?:√|\\sqrt)\s*(?:$|[)\]}=≥≤≠<>])")
    operands = ~reduce(Column.__or__, (t.endswith(s) for s in BINARY_SIGNS))
    # the first relation that occurs, in the order above, must have text on each side of each place
    sides = reduce(lambda c, r: c.when(F.contains(t, F.lit(r)), F.exists(F.split(t, f"\\{r}" if r in "<>=" else r), lambda p: F.trim(p) == "")), RELATIONS[1:], F.when(F.contains(t, F.lit("=")), F.exists(F.split(t, "="), lambda p: F.trim(p) == "")))
    relation = ~F.coalesce(sides, F.lit(False))
    ends = (t != "") & ~t.rlike(r"[\\^_]$")
    return F.struct(parentheses.alias("parentheses"), brackets.alias("brackets"), radical.alias("radical"), operands.alias("operands"), relation.alias("relation"), ends.alias("ends"), (parentheses & brackets & radical & operands & relation & ends).alias("plausible"))


def expanded(text: Column, neighbours: Column, most: int = 3) -> Column:
    """The text with as few of its next neighbours as make it plausible, `most` at most; struct of text, used, plausible."""
    start = F.struct(F.trim(text).alias("text"), F.lit(0).alias("used"), boundary(text)["plausible"].alias("plausible"))

    def step(a: Column, n: Column) -> Column:
        longer = F.trim(F.concat_ws(" ", a["text"], F.trim(n)))
        return F.when(a["plausible"] | (F.trim(n) == ""), a).otherwise(F.struct(longer.alias("text"), (a["used"] + 1).alias("used"), boundary(longer)["plausible"].alias("plausible")))

    return F.aggregate(F.slice(neighbours, 1, most), start, step)


def probability(text: Column, region: Column | None = None, neighbour: Column | None = None) -> Column:
    """How much a text looks like maths and not like code, 0 to 1."""
    t = F.coalesce(text, F.lit(""))
    plain = T.folded(t)
    points = lambda condition, n: F.when(condition, n).otherwise(0.0)
    tokens = F.size(F.regexp_extract_all(t, F.lit(r"\S+"), F.lit(0)))
    words = F.size(F.regexp_extract_all(t, F.lit("[A-Za-zÀ-ÿ]{4,}"), F.lit(0)))
    score = points(t.rlike("[=≥≤≠]"), 0.35) + points(t.rlike(r"[+\-−±×÷/]"), 0.15) + points(t.rlike("[0-9]") & t.rlike("[A-Za-z]"), 0.10)
    score += points((tokens > 0) & (words < 0.25 * tokens), 0.15) + points(_any_in(plain, MATHS_WORDS), 0.25) + points(t.rlike("[²³√±ΔΣ∫∑]"), 0.20)
    if region is not None:
        score += points(region == "formula", 0.30)
    if neighbour is not None:
        score += points(_any_in(T.folded(neighbour), MATHS_WORDS), 0.15)
    score += points(_any_in(plain, CODE_WORDS), -0.35) + points(t.rlike(r"\[[^\]]*\]|\(\)|;\s*$|def\s|=\s*\w+\("), -0.25)
    score += points(F.size(F.regexp_extract_all(t, F.lit("[A-Za-z]{4,}"), F.lit(0))) >= 4, -0.15)
    return F.when(t == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def tokens_of(text: Column) -> Column:
    flat = F.regexp_replace(F.translate(F.lower(text), "⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉", "01234567890123456789"), r"[\^_{}\s]", "")
    return F.array_distinct(F.regexp_extract_all(flat, F.lit(r"[0-9]+|[a-z]+|[^\w\s]"), F.lit(0)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of the tokens with scripts made flat."""
    x, y = tokens_of(a), tokens_of(b)
    every = F.size(F.array_union(x, y))
    return F.when(every > 0, F.size(F.array_intersect(x, y)) / every).otherwise(0.0)


def hedges(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"(?iu)\b({'|'.join(HEDGES)})\b"), F.lit(1)), lambda x: F.lower(x)))


def lost_terms(origin: Column, output: Column) -> Column:
    """Terms that the origin has more often than the output: struct of term and how many more."""
    terms = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[0-9]+|[a-z]+"), F.lit(0))
    count = lambda listed, t: F.size(F.filter(listed, lambda x: x == t))
    had, has = terms(origin), terms(output)
    more = F.transform(F.array_sort(F.array_distinct(had)), lambda t: F.struct(t.alias("term"), (count(had, t) - count(has, t)).alias("more")))
    return F.filter(more, lambda m: m["more"] > 0)


def completed(text: Column, neighbours: Column, most: int = 3) -> Column:
    """expanded, and the status that follows: draft if it became plausible, else needs_review."""
    wide = expanded(text, neighbours, most)
    return F.struct(wide["text"].alias("text"), wide["used"].alias("used"), F.when(wide["plausible"], "draft").otherwise("needs_review").alias("status"))
