"""LaTeX put into one form, and lines with signs of maths in words: ordered rewrites as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import vocabulary as V

# ---- fixed values ----

COMMANDS = {
    "±": r"\pm ", "√": r"\sqrt ", "≥": r"\geq ", "≤": r"\leq ", "≠": r"\neq ", "×": r"\times ", "÷": r"\div ", "·": r"\cdot ", "∑": r"\sum ", "∫": r"\int ",
    "∞": r"\infty ", "≈": r"\approx ", "Δ": r"\Delta ", "∆": r"\Delta ", "δ": r"\delta ", "π": r"\pi ", "α": r"\alpha ", "β": r"\beta ", "θ": r"\theta ", "µ": r"\mu ",
}
SUPER, SUB = "⁰¹²³⁴⁵⁶⁷⁸⁹", "₀₁₂₃₄₅₆₇₈₉"
DIGITS = "0123456789"
MOST_PASSES = 12
#: Signs and their words, in the order in which they are replaced: longer ones before their parts.
SPOKEN = {
    "√": " raiz quadrada de ", "∛": " raiz cúbica de ", "∜": " raiz quarta de ", "≠": " é diferente de ", "≥": " é maior ou igual a ", "≤": " é menor ou igual a ",
    "≈": " é aproximadamente igual a ", "≡": " é equivalente a ", "∝": " é proporcional a ", "=": " é igual a ", "<": " é menor que ", ">": " é maior que ", "±": " mais ou menos ",
    "∓": " menos ou mais ", "×": " vezes ", "·": " vezes ", "⋅": " vezes ", "÷": " dividido por ", "∙": " vezes ", "∉": " não pertence a ", "∈": " pertence a ", "∊": " pertence a ",
    "∍": " contém ", "∋": " contém ", "⊊": " está contido propriamente em ", "⊋": " contém propriamente ", "∖": " diferença de conjuntos ", "…": ", e assim por diante ",
    "...": ", e assim por diante ", "⊆": " está contido ou é igual a ", "⊇": " contém ou é igual a ", "⊂": " está contido em ", "⊃": " contém ", "∪": " união ", "∩": " interseção ",
    "∅": " conjunto vazio ", "∀": " para todo ", "∃!": " existe um único ", "∃": " existe ", "∄": " não existe ", "∧": " e ", "∨": " ou ", "¬": " não ", "ℕ": " naturais ", "ℝ": " reais ",
    "ℤ": " inteiros ", "ℚ": " racionais ", "ℂ": " complexos ", "⇒": " implica que ", "⇔": " se e somente se ", "→": " tende a ", "←": " recebe ", "↔": " equivale a ", "∞": " infinito ",
    "∑": " somatório de ", "∏": " produtório de ", "∫": " integral de ", "∂": " derivada parcial de ", "∇": " gradiente de ", "°": " graus ", "∠": " ângulo ", "∴": " portanto ", "∵": " porque ",
    "α": " alfa ", "β": " beta ", "γ": " gama ", "δ": " delta ", "ε": " épsilon ", "ζ": " zeta ", "η": " eta ", "θ": " teta ", "ι": " iota ", "κ": " capa ", "λ": " lambda ", "μ": " mi ",
    "ν": " ni ", "ξ": " csi ", "π": " pi ", "ρ": " rô ", "σ": " sigma ", "τ": " tau ", "υ": " úpsilon ", "φ": " fi ", "χ": " qui ", "ψ": " psi ", "ω": " ômega ", "Α": " alfa ", "Β": " beta ",
    "Γ": " gama ", "Δ": " delta ", "Θ": " teta ", "Λ": " lambda ", "Ξ": " csi ", "Π": " pi ", "Σ": " sigma ", "Φ": " fi ", "Ψ": " psi ", "Ω": " ômega ", "{": " abre chaves ",
    "}": " fecha chaves ", "[": " abre colchetes ", "]": " fecha colchetes ", "|": " barra ",
}
SPOKEN_COMMANDS = (
    (r"\\frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", " $1 sobre $2 "), (r"\\sqrt\s*\{([^{}]*)\}", " raiz quadrada de $1 "), (r"\\(?:times|cdot)", " vezes "), (r"\\div", " dividido por "), (r"\\pm", " mais ou menos "),
    (r"\\(?:leq|le)\b", " é menor ou igual a "), (r"\\(?:geq|ge)\b", " é maior ou igual a "), (r"\\neq", " é diferente de "), (r"\\in\b", " pertence a "), (r"\\forall", " para todo "),
    (r"\\exists", " existe "), (r"\\cup", " união "), (r"\\cap", " interseção "), (r"\\mathbb\s*\{\s*N\s*\}", " naturais "), (r"\\mathbb\s*\{\s*R\s*\}", " reais "), (r"\\mathbb\s*\{\s*Z\s*\}", " inteiros "),
    (r"\\lim", " limite "), (r"\\log", " logaritmo "), (r"\\to", " tende a "), (r"\\Delta", " delta "), (r"\\[a-zA-Z]+", " "),
)
SET_PRECEDENCE = {sign: level for sign, (_, _, level) in V.SETS.items()}


def _each(text: Column, rules) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, text)


def _signs(text: Column, words: dict[str, str]) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), words.items(), text)


def balanced(depth: int = 5) -> str:
    """A regex for a pair of parentheses with up to `depth` more within it; its inside is group 1 of the outermost."""
    inside = r"[^()]*+"
    for _ in range(depth):
        inside = rf"(?:[^()]++|\({inside}\))*+"
    return inside


def slashes_as_fractions(latex: Column) -> Column:
    """a/b as \\frac{a}{b}, from the left, with what is in parentheses or the run of letters and digits on each side; at most MOST_PASSES."""
    run, group = r"[A-Za-z0-9\\{}^_.]+", balanced()
    step = rf"^([^/]*?)(?:\((?<n>{group})\)|(?<m>{run}))\s*/\s*(?:\((?<d>{group})\)|(?<e>{run}))"
    once = lambda c: F.regexp_replace(c, step, "$1\\\\frac{${n}${m}}{${d}${e}}")
    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_PASSES)), latex, lambda c, _: once(c))


def normalised(latex: Column) -> Column:
    """Signs as commands, scripts as ^{} and _{}, raised digits that lost their place, slashes as fractions, bases of exponents in \\left( \\right)."""
    out = _signs(F.trim(latex), COMMANDS)
    out = _each(out, ((r"\\sqrt\s+\\([a-zA-Z]+)", r"\\sqrt{\\$1}"), (r"\\sqrt\s+([A-Za-z0-9]+)", r"\\sqrt{$1}")))
    for marks, sign in ((SUPER, "^"), (SUB, "_")):
        out = F.translate(F.regexp_replace(out, f"([{marks}]+)", f"{sign}{{$1}}"), marks, DIGITS)
    out = F.regexp_replace(out, r"(?<![\d^_{])(?<![A-Za-z]{3})([A-Za-z])\s+(\d)(?=\s*(?:[+\-=*/)\]]|$))", r"$1^{$2}")
    out = slashes_as_fractions(out)
    out = F.regexp_replace(out, rf"(?<!\\left)\(({balanced()})\)\s*\^", r"\\left($1\\right)^")
    return F.trim(F.regexp_replace(out, r"\s{2,}", " "))


# ---- lines in words ----


def has_signs(text: Column) -> Column:
    """A cheap look for anything that a line needs words for."""
    listed = "|".join("\\Q" + s + "\\E" for s in SPOKEN)
    fraction = r"(?U)(?<![\w/])[A-Za-zÀ-ÿ0-9]{1,12}\s*/\s*[A-Za-zÀ-ÿ0-9]{1,12}(?![\w/])"
    return text.rlike(rf"\\|{listed}|[{SUPER}{SUB}]") | text.rlike(fraction) | text.rlike(r"^\s*-?\d+(?:[.,]\d+)?\s*$") | text.rlike(r"(?iu)^\s*(?:(?:LATEX|LEITURA|MATHML|OMML|SPEECH)\s*:|(?:f[oó]rmula|express[aã]o)\s+matem[aá]tica\s*:)")


def _powers(text: Column) -> Column:
    runs = F.translate(F.regexp_replace(text, f"([{SUPER}]+)", " elevado a $1 "), SUPER, DIGITS)
    named = _each(runs, ((r" elevado a 2 ", " ao quadrado "), (r" elevado a 3 ", " ao cubo ")))
    return F.translate(F.regexp_replace(named, f"([{SUB}]+)", " índice $1 "), SUB, DIGITS)


def spoken_line(line: Column) -> Column:
    """A line in words: commands, scripts, signs, fractions, minus and plus, numbers with their units, parentheses; lines without signs stay."""
    return V.bound(line, lambda c: F.when(has_signs(c), _spoken(c)).otherwise(c))


def _spoken(line: Column) -> Column:
    several = line.rlike(r"\|.*\|")
    out = V.bound(line, lambda c: F.when(several, F.replace(c, F.lit("|"), F.lit("; "))).otherwise(c))
    out = _each(out, ((r"(?iu)^\s*(?:LATEX|LEITURA|MATHML|OMML|SPEECH)\s*:\s*", ""), (r"(?iu)^\s*(?:f[oó]rmula|express[aã]o)\s+matem[aá]tica\s*:\s*", "Fórmula: ")))
    out = V.bound(out, lambda c: F.when(F.contains(c, F.lit("\\")), F.translate(_each(c, SPOKEN_COMMANDS), "{}", "  ")).otherwise(c))
    out = _each(out, ((r"\^\s*\{?\s*2\s*\}?", " ao quadrado "), (r"\^\s*\{?\s*3\s*\}?", " ao cubo "), (r"\^\s*\{?\s*(-?\d+|[a-zA-Z])\s*\}?", " elevado a $1 "), (r"\b([A-Z])\s*→\s*([A-Z])\b", "$1 implica $2")))
    out = _signs(_powers(V.with_units_in_words(out)), SPOKEN)
    out = _each(out, (
        (r"\)\s*/\s*\(", ") sobre ("), (r"(?U)(?<![\w/])([A-Za-zÀ-ÿ0-9]{1,12})\s*/\s*([A-Za-zÀ-ÿ0-9]{1,12})(?![\w/])", "$1 sobre $2"), (r"(?U)(?<=[\w)])\s*[-−–]\s*(?=[\w(])", " menos "),
        (r"(?U)(?<![\w)])[-−–]\s*(?=[\w(])", " menos "), (r"\s*\+\s*", " mais "),
    ))
    out = _signs(V.with_numbers_in_words(out), {"(": " abre parênteses ", ")": " fecha parênteses "})
    return _each(T.tidy(out), ((r"\s+([,.;:!?])", "$1"), (r"([,.;:])\1+", "$1")))


def without_operators(text: Column, aggressive: bool = True) -> Column:
    """What is left of plus and minus in words; the hyphen of a word stays, and unless `aggressive` every other one that is no minus by its spaces."""
    plus = F.regexp_replace(text, r"\s*\+\s*", " mais ")
    kept = F.regexp_replace(plus, "(?<=[A-Za-zÀ-ÿ])-(?=[A-Za-zÀ-ÿ])", "\u0001")
    minus = F.replace(kept, F.lit("-"), F.lit(" menos ")) if aggressive else _each(kept, ((r"(?<=\s)-(?=\s)", " menos "), (r"(?U)(?<![\wÀ-ÿ])-(?=\d|[a-zA-Z]\b)", " menos ")))
    return F.trim(_each(F.replace(minus, F.lit("\u0001"), F.lit("-")), ((r"\s{2,}", " "), (r"\s+([.,;:!?])", "$1"))))


def spoken_cell(cell: Column) -> Column:
    """A table cell in words: as a line, then what is left of its operators and numbers."""
    said = V.with_units_in_words(without_operators(spoken_line(cell)))
    return F.regexp_replace(_each(said, ((r"\s{2,}", " "), (r"(?:;\s*)+", "; "))), "^[ ;]+|[ ;]+$", "")


def precedence(sign: Column) -> Column:
    """How strongly a set operator binds; null for other signs."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in SET_PRECEDENCE.items() for x in kv)), sign)
