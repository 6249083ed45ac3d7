"""Checks over whole documents and records, and verdicts that need no model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import tables
from textloom.functions import text as T
from textloom.operators import blocks as B

# ---- fixed values ----

MOST_EXPANSION = 4.0
OUTSIDE_TEXT = ("table", "math", "list", "code")
SPOKEN_MARKS = {"frac": (r"\\frac", ("fracao", "fração", "sobre", "dividido")), "sqrt": (r"\\sqrt", ("raiz",)), "potencia": (r"\^", ("quadrado", "cubo", "potencia", "potência", "elevado"))}
#: Structure: its mark in LaTeX, MathML, OMML and speech.
STRUCTURES = {
    "fracao": (r"\\frac", "<mfrac", "<m:f>", "fra[cç][aã]o|sobre"), "raiz": (r"\\sqrt", "<msqrt|<mroot", "<m:rad", "raiz"),
    "potencia": (r"\^", "<msup", "<m:sSup", "ao quadrado|ao cubo|elevado"), "indice": ("_", "<msub", "<m:sSub", "[íi]ndice|subscrito"),
}
#: What of a row's context asks for which words of a cell's speech.
CONTEXT_RULES = (
    ("discriminante", ("discriminante",), ("delta",)), ("oposto", ("oposto do coeficiente", "oposto de"), ("menos", "oposto")),
    ("duas_raizes", ("usando +", "uma usando", "mais ou menos"), ("mais ou menos",)), ("raiz", ("raiz quadrada do discriminante", "raiz quadrada de delta"), ("raiz quadrada",)),
    ("produto", ("duas vezes o coeficiente", "dobro do coeficiente"), ("vezes", "produto")), ("indices", ("possiveis solucoes", "as duas raizes", "solucoes da equacao"), ("um", "dois")),
)
ORDINALS = ("segunda", "segundo", "primeira", "primeiro", "terceira", "terceiro")
MATHS_CONTEXT = ("coeficiente", "componente", "formula", "expressao")
TEACHING_MARKS = ("por exemplo", "portanto", "concluimos", "concluímos", "aprenda", "esta formula serve", "esta fórmula serve", "usamos essa")
SYMBOL_CHECKS = ("validar_menos", "validar_expoentes", "validar_subscritos", "validar_radicandos", "validar_multiplicacao_implicita", "validar_cadeia_de_igualdade", "validar_termos_preservados")
SPEECH_CHECKS = ("fala_com_lacuna", "validar_cobertura_da_fala")
RENDERER_CHECKS = ("validar_derivacao_unica", "validar_tabela", "validar_serializacoes")
NAMED_EXPONENTS = {"ao quadrado": 2, "ao cubo": 3}
NUMBER_NAMES = ("zero", "um", "dois", "tres", "quatro", "cinco", "seis", "sete", "oito", "nove", "dez")


def _any_in(text: Column, words) -> Column:
    return reduce(Column.__or__, (F.contains(text, F.lit(w)) for w in words))


# ---- documents ----


def lost_images(blocks: DataFrame) -> DataFrame:
    """Images that aren't decorative and have no text of any kind: doc_id, ord."""
    said = reduce(Column.__or__, (F.trim(F.coalesce(c, F.lit(""))) != "" for c in ("alt_text", "long_description", "text")))
    return blocks.where((F.col("type") == "image") & ~F.coalesce("decorative", F.lit(False)) & ~said).select("doc_id", "ord")


def problems(blocks: DataFrame) -> DataFrame:
    """doc_id, check, severity, ord of a document's blocks: repeats, layout told, broken order, lost images. Blocks: doc_id, ord, page_number, type, text, decorative, alt_text, long_description."""
    told = blocks.where(~F.col("type").isin(*OUTSIDE_TEXT)).withColumn("text", F.coalesce("text", F.lit("")))
    kinds = {
        ("repeticao", "WARNING"): B.repeats(told, "ord").select("doc_id", "ord"),
        ("narracao_de_layout", "WARNING"): told.where(T.layout_phrases(F.col("text")) >= 2).select("doc_id", "ord"),
        ("ordem_de_leitura", "ERROR"): B.broken_order(told, "ord", "page_number").select("doc_id", "ord"),
        ("imagem_perdida", "ERROR"): lost_images(blocks),
    }
    return reduce(DataFrame.unionByName, (rows.select("doc_id", F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.col("ord").cast("long").alias("ord")) for (check, severity), rows in kinds.items()))


def coherence(found: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, errors, warnings, ratio, coherent. found: problems(); words: doc_id, out_words, source_words, a row a document."""
    by = found.groupBy("doc_id").agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") != "ERROR").alias("warnings"))
    ratio = F.when(F.col("source_words") > 0, F.round(F.col("out_words") / F.col("source_words"), 2)).otherwise(0.0)
    both = words.join(by, "doc_id", "left").withColumn("ratio", ratio)
    warned = F.coalesce("warnings", F.lit(0)) + (F.col("ratio") > MOST_EXPANSION).cast("int")
    errors = F.coalesce("errors", F.lit(0))
    return both.select("doc_id", errors.alias("errors"), warned.alias("warnings"), "ratio", (errors == 0).alias("coherent"))


# ---- verdicts ----


def verdict(a: Column, b: Column) -> Column:
    """Struct of same, keep (a, b, ambos) and confidence, from brokenness and numbers alone; confidence 0 if they don't tell."""
    x, y = T.brokenness(a), T.brokenness(b)
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"[0-9]+(?:[.,][0-9]+)?"), F.lit(0))
    differ = numbers(a) != numbers(b)
    keep = F.when(x > y, "b").when(x < y, "a").otherwise("ambos")
    return F.struct((x != y).alias("same"), keep.alias("keep"), F.when((x != y) | differ, 0.9).otherwise(0.0).alias("confidence"))


def read_verdict(answer: Column) -> Column:
    """Struct of same, keep, confidence and reason from lines of KEY: value; the last of a key counts, and what contradicts itself keeps both."""
    text = F.coalesce(answer, F.lit(""))
    value = lambda key: F.trim(F.regexp_extract(text, rf"(?ims)\A(?:.*^)?[ \t]*{key}[ \t]*:([^\n]*)", 1))
    keep, number = F.upper(value("MANTER")), F.replace(value("CONFIANCA"), F.lit(","), F.lit("."))
    same = F.lower(value("MESMO")).startswith("s")
    sure = F.coalesce(F.try_to_number(F.when(number.rlike(r"^[0-9]*\.?[0-9]+$"), number), F.lit("999999.999999")).cast("double"), F.lit(0.0))
    return F.struct(same.alias("same"), F.when(same & keep.isin("A", "B"), F.lower(keep)).otherwise("ambos").alias("keep"), F.least(F.lit(1.0), sure).alias("confidence"), F.substring(value("MOTIVO"), 1, 200).alias("reason"))


def _object(depth: int) -> str:
    """A regex for a JSON object of up to `depth` more levels within it, whatever stands in its strings."""
    return r'\{(?:"(?:[^"\\]|\\.)*"|[^{}"]' + ("|" + _object(depth - 1) if depth else "") + r")*+\}"


def first_object(text: Column) -> Column:
    """The first JSON object of a text, as JSON with sorted keys, closed where it was cut off; null if there is none."""
    clean = F.regexp_replace(text, "```(?:json)?", "")
    start = F.substr(clean, F.greatest(F.instr(clean, F.lit("{")), F.lit(1)))
    whole = F.regexp_extract(start, f"(?s)^({_object(8)})", 1)
    return F.when(F.contains(clean, F.lit("{")), F.coalesce(F.when(whole != "", F.to_json(F.try_parse_json(whole))), tables.repaired_json(F.trim(start))))


def short_reference(description: Column) -> Column:
    """What is said where a picture appears again: its kind, the description up to the first colon or point, if that is short and plain."""
    text = F.regexp_replace(F.trim(description), r"^\[verificacao incerta\]\s*", "")
    text = F.regexp_replace(text, "^A imagem (?:apresenta|mostra|contem) ", "")
    kind = F.trim(F.regexp_extract(text, r"(?s)^([^:.]*)", 1))
    plain = (kind != "") & (F.length(kind) <= 80) & ~kind.rlike(r"[|\\]") & ~F.upper(kind).isin("LATEX", "LEITURA")
    raised = F.concat(F.upper(F.substring(kind, 1, 1)), F.substring(kind, 2, 80))
    return F.when(plain, F.concat(F.lit("Aparece novamente: "), raised, F.lit("."))).otherwise("O mesmo elemento visual aparece novamente.")


# ---- formulas and their speech ----


def unspoken_structures(latex: Column, reading: Column) -> Column:
    """Structures of the LaTeX that the reading doesn't name."""
    low = F.lower(reading)
    missing = F.array(*(F.when(latex.rlike(mark) & ~_any_in(low, words), name) for name, (mark, words) in SPOKEN_MARKS.items()))
    return F.when(F.coalesce(latex, F.lit("")) == "", F.array().cast("array<string>")).when(F.coalesce(reading, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_compact(missing))


def formats_apart(latex: Column, mathml: Column, omml: Column, speech: Column) -> Column:
    """`structure:format` for each structure of the LaTeX that another format lacks, and `numero:n` for numbers that MathML lacks."""
    lacks = []
    for name, (mark, *others) in STRUCTURES.items():
        for kind, text, pattern in zip(("mathml", "omml", "fala"), (mathml, omml, speech), others, strict=True):
            lacks.append(F.when(latex.rlike("(?i)" + mark) & (text != "") & ~text.rlike("(?iu)" + pattern), f"{name}:{kind}"))
    digits = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)))
    numbers = F.transform(F.array_sort(F.array_except(digits(latex), digits(mathml))), lambda x: F.concat(F.lit("numero:"), x))
    return F.concat(F.array_compact(F.array(*lacks)), F.when(mathml != "", numbers).otherwise(F.array().cast("array<string>")))


def against_context(speech: Column, context: Column) -> Column:
    """The rules that a cell's speech breaks given its row: words that the context asks for, and ordinals where it is about formulas."""
    said, around = T.folded(F.coalesce(speech, F.lit(""))), T.folded(F.coalesce(context, F.lit("")))
    broken = [F.when(_any_in(around, clues) & ~_any_in(said, asked), name) for name, clues, asked in CONTEXT_RULES]
    return F.array_compact(F.array(*broken, F.when(_any_in(said, ORDINALS) & _any_in(around, MATHS_CONTEXT), "ordinal")))


def conflicts_with_text(around: Column, exponents: Column, results: Column) -> Column:
    """Struct of kind and the text's value for each exponent or result that the prose near a formula tells otherwise; exponents and results are arrays of the formula's."""
    text = T.folded(F.coalesce(around, F.lit("")))
    names = F.create_map(*(F.lit(x) for k, n in enumerate(NUMBER_NAMES) for x in (n, k)))
    value = lambda w: F.when(w.rlike("^[0-9]{1,9}$"), w.cast("int")).otherwise(F.element_at(names, w))
    told = F.concat(
        F.array_compact(F.array(*(F.when(F.contains(text, F.lit(phrase)), n) for phrase, n in NAMED_EXPONENTS.items()))),
        F.filter(F.transform(F.regexp_extract_all(text, F.lit("elevad[oa] a ([a-z0-9_]+)"), F.lit(1)), value), lambda v: v.isNotNull()),
    )
    equal = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"e\s+igual\s+a\s+([a-z0-9_]+)"), F.lit(1)), value), lambda v: v.isNotNull())
    one = lambda kind: lambda v: F.struct(kind.alias("kind") if isinstance(kind, Column) else F.lit(kind).alias("kind"), v.cast("int").alias("value"))
    wrong = F.filter(told, lambda v: (F.size(exponents) > 0) & ~F.array_contains(exponents, v))
    off = F.filter(equal, lambda v: ~F.array_contains(results, v))
    return F.concat(F.transform(wrong, one("expoente_divergente")), F.transform(off, one(F.when(F.size(results) == 0, "resultado_ausente_na_formula").otherwise("resultado_divergente"))))


def forbidden(source: Column, span: Column, speech: Column, evidence: Column, rejected: Column, confidence: Column, review: Column, node: Column) -> Column:
    """What a proposed reading of a formula must not do: shorten a chain of equalities, change digits or add signs without evidence, teach, be too sure, or speak without a tree."""
    n = lambda c, sign: F.length(c) - F.length(F.replace(c, F.lit(sign), F.lit("")))
    digits = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit("[0-9]"), F.lit(0)))
    more = reduce(Column.__or__, (n(span, s) > n(source, s) for s in ("+", "-", "±", "/", "=", "·")))
    none = F.size(evidence) == 0
    cases = {
        "cadeia_de_igualdade": (n(source, "=") >= 2) & (n(span, "=") < n(source, "=")), "termos_alterados": (span != "") & (digits(span) != digits(source)) & none & (F.size(rejected) == 0),
        "operador_inserido": more & none, "explicacao_na_fala": _any_in(F.lower(speech), TEACHING_MARKS), "confianca_sem_evidencia": (confidence >= 0.99) & ~review & none,
        "fala_sem_arvore": (speech != "") & (F.trim(node) == ""),
    }
    return F.array_compact(F.array(*(F.when(bad, name) for name, bad in cases.items())))


# ---- the trail of an expression ----


def first_loss(events: DataFrame, key: str = "region_id") -> DataFrame:
    """The first stage that lost something or has issues; events: key, seq, stage, lost (boolean), issues (count)."""
    bad = events.where(F.col("lost") | (F.col("issues") > 0))
    return bad.groupBy(key).agg(F.min_by("stage", "seq").alias("stage"))


def rates(trails: DataFrame) -> DataFrame:
    """The ten figures of the maths layer over trails: a row an expression with candidates, complete, context_called, plausible, checks, review_status, ast_hash, speech."""
    has = lambda checks: F.arrays_overlap("checks", F.array(*map(F.lit, checks)))
    rate = lambda condition: F.when(F.count(F.lit(1)) > 0, F.round(F.count_if(F.coalesce(condition, F.lit(False))) / F.count(F.lit(1)), 4)).otherwise(0.0)
    spoken = F.count_distinct(F.coalesce("speech", F.lit(""))).alias("n")
    apart = trails.where("ast_hash != ''").groupBy("ast_hash").agg(spoken).agg(F.count_if(F.col("n") > 1).alias("formula_consistency_conflicts"))
    figures = trails.agg(
        F.count(F.lit(1)).alias("expressions"), F.coalesce(F.sum("candidates"), F.lit(0)).alias("math_candidates_total"), rate(F.col("complete")).alias("math_parse_success_rate"),
        rate(F.col("context_called")).alias("context_resolver_call_rate"), rate(has(SYMBOL_CHECKS)).alias("symbol_loss_rate"), rate(~F.col("plausible")).alias("boundary_repair_rate"),
        rate(has(SPEECH_CHECKS)).alias("speech_validation_failure_rate"), rate(has(RENDERER_CHECKS)).alias("renderer_regression_rate"), rate(F.col("review_status").isin("draft", "needs_review")).alias("human_review_rate"),
    )
    return figures.join(F.broadcast(apart))  # a row each


# ---- speech and audits ----

#: What speech says of operators and numbers.
SPOKEN_OPERATORS = {
    "=": ("igual a",), ">=": ("maior ou igual",), "<=": ("menor ou igual",), "!=": ("diferente de",), ">": ("maior que",), "<": ("menor que",), "^": ("ao quadrado", "ao cubo", "elevado a"),
    "√": ("raiz quadrada",), "±": ("mais ou menos",), "/": ("sobre", "fracao", "dividido por", "numerador"), "+": ("mais",), "-": ("menos",),
}
SPOKEN_NUMBERS = {
    "0": "zero", "1": "um", "2": "dois", "3": "tres", "4": "quatro", "5": "cinco", "6": "seis", "7": "sete", "8": "oito", "9": "nove", "10": "dez", "11": "onze", "12": "doze",
    "13": "treze", "14": "quatorze", "15": "quinze", "20": "vinte", "30": "trinta", "100": "cem",
}
LETTER_A = r"vezes a\b|de a\b|coeficiente a\b|\ba vezes\b|\ba ao\b"
UNCERTAIN = "[verificacao incerta]"


def speech_signature(speech: Column) -> Column:
    """Struct of symbols, numbers and operators that a formula's speech names, each sorted; a, e and o are words unless said as factors."""
    said = T.folded(F.coalesce(speech, F.lit("")))
    words = F.split(said, "[^a-z0-9]+")
    letters = F.filter(words, lambda w: w.rlike("^[a-z]$") & ~w.isin("a", "e", "o"))
    symbols = F.concat(letters, F.when(said.rlike(LETTER_A), F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")))
    named = F.array_compact(F.array(*(F.when(F.array_contains(words, word), digit) for digit, word in SPOKEN_NUMBERS.items()), F.when(F.contains(said, F.lit("ao quadrado")), "2"), F.when(F.contains(said, F.lit("ao cubo")), "3")))
    operators = F.array_compact(F.array(*(F.when(_any_in(said, phrases), sign) for sign, phrases in SPOKEN_OPERATORS.items())))
    in_order = lambda c: F.array_sort(F.array_distinct(c))
    return F.struct(in_order(symbols).alias("symbols"), in_order(F.concat(named, F.filter(words, lambda w: w.rlike("^[0-9]+$")))).alias("numbers"), in_order(operators).alias("operators"))


def formula_audit(lost: Column, mathml_problems: Column, latex: Column, reading: Column) -> Column:
    """Struct of approved and problems: lost terms, what is wrong in the MathML, and structures that the reading doesn't name."""
    named = lambda kind, c: F.transform(c, lambda x: F.concat(F.lit(kind + ":"), x))
    found = F.concat(named("perdido", lost), named("mathml", mathml_problems), named("leitura", unspoken_structures(latex, reading)))
    return F.struct((F.size(found) == 0).alias("approved"), found.alias("problems"))


def described(description: Column) -> Column:
    """A description without outer brackets and forbidden beginnings; the mark of doubt stays in front."""
    text = F.trim(F.coalesce(description, F.lit("")))
    doubt = text.startswith(UNCERTAIN)
    body = F.when(doubt, F.ltrim(F.substring(text, len(UNCERTAIN) + 1, 1 << 30))).otherwise(text)
    clean = T.without_forbidden_start(T.without_outer_brackets(body))
    return F.when(text == "", description).when(doubt, F.concat(F.lit(UNCERTAIN + " "), clean)).otherwise(clean)
