"""What a formula's tree is about: known formulas, how it is built, letters that are prose, trees from their JSON and from MathML."""

from __future__ import annotations

import json
from xml.etree import ElementTree

from textloom.functions import expressions as X
from textloom.functions.expressions import Node

# ---- fixed values ----

NOTES = {
    "bhaskara": "A fórmula fornece as possíveis raízes de uma equação do segundo grau.",
    "discriminante": "O discriminante indica quantas raízes reais a equação possui.",
    "forma_geral": "É a forma geral da equação do segundo grau, com os coeficientes a, b e c.",
}
#: Known formulas, the kinds of nodes that their relation holds, and the letters.
KNOWN = (("bhaskara", {"Divide", "Sqrt", "PlusMinus"}, set()), ("discriminante", {"Subtract", "Power"}, {"a", "b", "c"}), ("forma_geral", {"Add", "Power"}, {"a", "b", "c"}))
CONTRACTIONS = {"de a ": "da ", "de o ": "do ", "de as ": "das ", "de os ": "dos "}
FEMININE = {"um": "uma", "dois": "duas"}
LETTERS_IN_A_ROW = 5


def known_formula(tree: Node) -> str | None:
    kinds, names = {n.kind for n in tree.walk()}, {n.value for n in tree.walk() if n.kind == "Symbol"}
    return next((name for name, has, letters in KNOWN if tree.kind == "Relation" and has <= kinds and letters <= names), None)


def _say(n: Node) -> str:
    return X.speech(n)[0]


def contracted(text: str) -> str:
    for apart, together in CONTRACTIONS.items():
        text = text.replace(apart, together)
    return text


def _product(n: Node) -> str:
    said = [_say(k) for k in n.kids]
    if len(said) == 2 and n.kids[0].kind in ("Integer", "Numero"):
        return f"{FEMININE.get(said[0], said[0])} vezes o coeficiente {said[1]}"
    return " vezes ".join(said)


#: How a part of a formula is named; a kind without a rule is said as it is.
PARTS = {
    "Group": lambda n: part_named(n.kids[0]),
    "PlusMinus": lambda n: contracted(f"{part_named(n.kids[0])}, seguido do operador mais ou menos e de {part_named(n.kids[1])}") if len(n.kids) > 1 else _say(n),
    "UnaryMinus": lambda n: f"o oposto de {_say(n.kids[0])}",
    "Sqrt": lambda n: f"a raiz quadrada de {_say(n.kids[0])}",
    "Multiply": _product,
    "Power": lambda n: f"{_say(n.kids[0])} elevado a {_say(n.kids[1])}",
    "Subtract": lambda n: f"a diferença entre {_say(n.kids[0])} e {_say(n.kids[1])}",
    "Add": lambda n: "a soma de " + ", ".join(map(_say, n.kids)),
}
#: How a whole formula is told by its kind, and for relations by the kind of their right side.
STORIES = {
    "Divide": lambda n: f"É uma fração. O numerador contém {part_named(n.kids[0])}. O denominador é {part_named(n.kids[1])}.",
    "Sqrt": lambda n: f"É a raiz quadrada de {_say(n.kids[0])}.",
}
RELATION_STORIES = {
    "Divide": lambda left, n: f"A fórmula calcula {left} por meio de uma fração. O numerador contém {part_named(n.kids[0])}. O denominador é {part_named(n.kids[1])}.",
    "Sqrt": lambda left, n: f"A fórmula calcula {left} pela raiz quadrada de {_say(n.kids[0])}.",
    **dict.fromkeys(("Symbol", "Integer", "Numero"), lambda left, n: ""),
}


def part_named(n: Node) -> str:
    return PARTS.get(n.kind, _say)(n)


def structure_told(n: Node) -> str:
    """How a formula is built; empty where that would only be its reading again."""
    if n.kind == "Relation" and len(n.kids) == 2:
        left, right = _say(n.kids[0]), n.kids[1]
        return RELATION_STORIES.get(right.kind, lambda a, b: f"A fórmula relaciona {a} com {part_named(b)}.")(left, right)
    return STORIES.get(n.kind, lambda x: f"A expressão é {part_named(x)}.")(n)


def explanation(tree: Node) -> str | None:
    """The note of a known formula and how it is built; None where there is nothing to tell beyond the reading."""
    known, told = known_formula(tree), contracted(structure_told(tree))
    bare = lambda t: "".join(c for c in t.lower() if c.isalnum())
    core = told.removeprefix("A expressão é ").removeprefix("A fórmula relaciona ")
    if known:
        return f"{NOTES[known]} {told}".strip()
    return told if told and bare(core) != bare(_say(tree)) else None


def prose_in_product(tree: Node) -> str | None:
    """The letters of a product with LETTERS_IN_A_ROW single letters one after another: a title that ran into the formula."""
    for n in tree.walk():
        row = "".join("x" if k.kind == "Symbol" and len(k.value) == 1 and k.value.isalpha() else " " for k in n.kids) if n.kind == "Multiply" else ""
        if "x" * LETTERS_IN_A_ROW in row:
            return "".join(k.value for k in n.kids if k.kind == "Symbol")[:40]
    return None


def from_json(text: str | None) -> Node | None:
    """The tree of `canonical`; None for anything else."""
    def node(d: dict) -> Node:
        return Node(d["tipo"], [node(k) for k in d.get("filhos", ())], d.get("valor"), list(d.get("operadores", ())))

    try:
        return node(json.loads(text))
    except (TypeError, KeyError, ValueError, AttributeError):
        return None


#: Elements of MathML as text that `parsed` reads: what stands for an element with its children's text.
MATHML_TEXT = {
    "mfrac": r"\frac{{{0}}}{{{1}}}", "msqrt": r"\sqrt{{{all}}}", "mroot": r"\sqrt[{1}]{{{0}}}", "msup": "{0}^{{{1}}}", "msub": "{0}_{{{1}}}",
    "munder": r"\lim_{{{under}}}", "mtext": " {all} ", "annotation": "", "annotation-xml": "",
}
MATHML_SIGNS = {"⁢": "", "⁡": "", "−": "-", "→": r"\to "}


def mathml_source(text: str | None) -> str | None:
    """MathML as a line that can be read as a formula again; None if it isn't well-formed."""
    def told(e) -> str:
        name, kids = e.tag.split("}")[-1], [told(k) for k in e]
        own = "".join(MATHML_SIGNS.get(c, c) for c in (e.text or "").strip())
        whole = own + "".join(kids)
        rule = MATHML_TEXT.get(name)
        under = "".join(told(k) for k in list(e)[1:]) if name == "munder" else ""
        return rule.format(*kids, all=whole, under=under) if rule is not None else whole

    try:
        return told(ElementTree.fromstring(text))
    except (TypeError, ElementTree.ParseError):
        return None


def from_mathml(text: str | None) -> Node | None:
    source = mathml_source(text)
    return X.parsed(source).tree if source else None


def unspoken(tree: Node, speech: str) -> list[str]:
    """Kinds of nodes whose words the speech lacks."""
    asked = {"Power": ("quadrado", "cubo", "elevado"), "Sqrt": ("raiz",), "Divide": ("sobre", "fração"), "PlusMinus": ("mais ou menos",), "Subtract": ("menos",), "UnaryMinus": ("menos", "oposto"), "Add": ("mais",)}
    kinds = {n.kind for n in tree.walk()}
    return sorted(kind for kind, words in asked.items() if kind in kinds and not any(w in speech for w in words))


def audited(source: str) -> dict:
    """One record of an expression's checks: tree, formats and speech, what is lost, and the verdict."""
    read = X.parsed(source)
    speech, _, gap = X.speech(read.tree)
    found = [f"{severity}:{check}" for check, severity in X.issues(source, read.tree, speech)]
    found += [f"ERROR:nao_falado_{kind}" for kind in unspoken(read.tree, speech)] + (["BLOCKER:texto_incorporado"] if prose_in_product(read.tree) else [])
    return {"source": source, "complete": read.complete, "speech": speech, "gap": gap, "known": known_formula(read.tree), "explanation": explanation(read.tree), "issues": found, "approved": read.complete and not gap and not found}
