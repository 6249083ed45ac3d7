"""Operators whose rows no SQL gives, against plain versions and small cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import expressions as X
from textloom.functions import latex as L
from textloom.functions import semantics as S
from textloom.functions import vocabulary as V
from textloom.operators import coherence, context, documents, fragments, layout

random = random.Random(5)


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


def cut_order(boxes, keys, depth=0):
    """Recursive XY-cut, plainly: the widest gap across (6) or down (18), across on ties."""
    def gap(axis, least):
        ends, best = None, (0.0, None)
        for lo, hi in sorted((boxes[k][axis], boxes[k][axis + 2]) for k in keys):
            if ends is not None and lo - ends > best[0]:
                best = (lo - ends, (lo + ends) / 2)
            ends = hi if ends is None else max(ends, hi)
        return best if best[0] >= least else (0.0, None)

    across, down = gap(1, 6.0), gap(0, 18.0)
    axis, middle = (1, across[1]) if across[0] >= down[0] else (0, down[1])
    if middle is None or depth >= 12:
        return sorted(keys, key=lambda k: (boxes[k][1], boxes[k][0], k))
    first = [k for k in keys if boxes[k][axis + 2] <= middle]
    return cut_order(boxes, first, depth + 1) + cut_order(boxes, [k for k in keys if k not in first], depth + 1)


def test_reading_order_against_plain_recursion(spark):
    rows, want = [], {}
    for page in range(12):
        boxes = []
        for _ in range(25):
            x, y = random.choice((0, 120, 260)) + random.random(), random.uniform(0, 700)
            boxes.append((x, y, x + random.uniform(20, 90), y + random.uniform(4, 30)))
        rows += [(page, 0, k, *b) for k, b in enumerate(boxes)] + [(page, 0, 99, None, None, None, None)]
        want[page] = [*cut_order(boxes, list(range(25))), 99]
    df = spark.createDataFrame(rows, "doc_id long, page_num int, region_idx int, x0 double, y0 double, x1 double, y1 double")
    found = {}
    for r in layout.reading_order(df).orderBy("doc_id", "ord").collect():
        found.setdefault(r.doc_id, []).append(r.region_idx)
    assert found == want


def test_components_of_links():
    links = [(random.randrange(300), random.randrange(300)) for _ in range(220)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    assert layout.smallest_of_component(links) == {x: top(x) for pair in links for x in pair}
    assert set(layout.smallest_of_component([(k, k + 1) for k in range(500)]).values()) == {0}


@pytest.mark.parametrize(("n", "words"), [("0", "zero"), ("21", "vinte e um"), ("100", "cem"), ("101", "cento e um"), ("2000", "dois mil"), ("1100", "mil e cem"), ("1234", "mil duzentos e trinta e quatro"), ("1200000", "um milhão e duzentos mil"), ("1000001", "um milhão e um"), ("1234567", "um milhão, duzentos e trinta e quatro mil, quinhentos e sessenta e sete"), ("1" + "0" * 21, "1" + "0" * 21)])
def test_digits_in_words(spark, n, words):
    assert one(spark, V.digits_in_words(F.lit(n))) == words


def test_numbers_in_words_are_those_of_speech(spark):
    numbers = [*range(0, 1300, 7), *(random.randrange(10**k) for k in range(1, 19) for _ in range(8)), -5, -1000]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", V.number_in_words(F.col("n")).alias("w")).collect()
    assert [(r.n, r.w) for r in rows if r.w != V.number_words(r.n)] == []


def test_texts_in_words(spark):
    assert one(spark, V.with_units_in_words(F.lit("1 m e 2,05 km/h, 50% de 1.234 kg"))) == "um metro e dois vírgula zero cinco quilômetros por hora, cinquenta por cento de mil duzentos e trinta e quatro quilogramas"
    assert one(spark, V.feminine(F.lit("vinte e um ou dois"))) == "vinte e uma ou duas"


def test_nested_parentheses_in_fractions(spark):
    assert one(spark, L.slashes_as_fractions(F.lit("((a+b)c + 1)/(2(d)) = x"))) == r"\frac{(a+b)c + 1}{2(d)} = x"
    assert one(spark, L.slashes_as_fractions(F.lit("/ x"))) == "/ x"


def test_trees_again_from_their_json_and_mathml():
    for source in (r"x = \frac{-b \pm \sqrt{\Delta}}{2a}", "ax² + bx + c = 0", "a_1 + 2 = y", r"\sqrt[3]{x}"):
        tree = X.parsed(source).tree
        assert S.from_json(X.canonical(tree)).plain() == tree.plain()
        assert X.symbols(S.from_mathml(X.mathml(tree))) == X.symbols(tree)
    assert S.from_json("[1]") is None and S.from_json(None) is None and S.from_mathml("<a") is None
    assert S.prose_in_product(X.parsed("abcdef + 1").tree) and not S.prose_in_product(X.parsed("abc + 1").tree)
    assert S.unspoken(X.parsed("x² + 1").tree, "x mais um") == ["Power"]
    assert S.audited("(x + 1")["approved"] is False and S.audited("x² + 1 = 0")["approved"] is True


def test_problems_of_documents(spark):
    same = "uma frase bastante longa que se repete no documento inteiro duas vezes"
    rows = [(1, 1, "paragraph", same, None, None, None), (1, 2, "paragraph", same + ".", None, None, None), (1, 3, "image", None, False, " ", None), (2, 1, "paragraph", "curto", None, None, None), (2, 2, "image", None, True, None, None), (2, 3, "image", None, None, None, "foto de um gato")]
    df = spark.createDataFrame(rows, "doc_id long, ord int, type string, text string, decorative boolean, alt_text string, long_description string")
    assert {(r.doc_id, r.check, r.ord) for r in coherence.problems(df.withColumn("page_number", 4 - F.col("ord"))).collect()} >= {(1, "ordem_de_leitura", 2), (2, "ordem_de_leitura", 2)}
    found = coherence.problems(df.withColumn("page_number", F.lit(1)))
    assert {(r.doc_id, r.check, r.ord) for r in found.collect()} == {(1, "repeticao", 2), (1, "imagem_perdida", 3)}
    words = spark.createDataFrame([(1, 30, 5), (2, 3, 0)], "doc_id long, out_words long, source_words long")
    assert {r.doc_id: (r.errors, r.warnings, r.ratio, r.coherent) for r in coherence.coherence(found, words).collect()} == {1: (1, 2, 6.0, False), 2: (0, 0, 0.0, True)}


def test_documents_and_their_exports(spark, tmp_path):
    blocks = spark.createDataFrame([(1, 1, "heading", 1, "Título", None, [], None), (1, 2, "paragraph", None, "**x** < y", None, [], None), (2, 1, "paragraph", None, "z", None, [], None)], "doc_id long, ord int, type string, level int, text string, item string, rows array<array<string>>, start int")
    given = spark.createDataFrame([(1, "abc", None), (2, None, "Dois"), (3, "", None)], "doc_id long, text string, title string")
    pages = spark.createDataFrame([(2, 1, "paragraph", "**da página**")], "doc_id long, ord int, type string, text string")
    made = {r.doc_id: r for r in documents.canonical(blocks, given, pages).collect()}
    assert (made[1].title, made[1].block_count, made[1].section_count, made[2].title, made[3].title, made[3].block_count) == ("Título", 2, 1, "Dois", "Documento acessível", 0)
    assert json.loads(made[2].blocks[0])["text"] == "da página"
    assert json.loads(documents.canonical_json(documents.canonical(blocks, given)).where("doc_id = 1").first().json)["title"] == "Título"
    assert documents.for_student(spark.createDataFrame([(1, "t", 0.5)], "doc_id long, text string, confidence double")).columns == ["doc_id", "text"]
    out = documents.artefacts(blocks, f"file://{tmp_path}/out", ("txt", "html", "nothing"))
    assert out["nothing"][0] is None and "KeyError" in out["nothing"][1] and out["txt"][1] is None
    assert spark.read.text(out["html"][0]).count() == 2
    decisions = spark.createDataFrame([(1, "a.pdf", "blocked", None, ["sem texto"])], "doc_id long, name string, status string, label string, blockers array<string>")
    pending = spark.createDataFrame([(1, 1, "x = 1", None, [])], "doc_id long, ord int, source_text string, review_status string, codes array<string>")
    package = documents.review_package(blocks, decisions, pending, f"file://{tmp_path}/package")
    assert "BLOQUEADORES" in json.loads(spark.read.text(package["pendencias"][0]).first().value)["report"] and package["txt"][0].endswith("txt_rascunho_nao_aprovado")
    (tmp_path / "a.txt").write_text("a")
    assert documents.zipped([str(tmp_path / "a.txt"), str(tmp_path / "none")], str(tmp_path / "z.zip")) and documents.zipped([], str(tmp_path / "y.zip")) is None


def test_formula_groups_by_hand(spark):
    texts = ["texto corrido sem sinais", "x = (a +", "b)", "e então segue prosa comum", "y = 2", "√", "x = √(", "outra frase qualquer de prosa)", "3)"]
    rows = [(1, 0, k, 0.0, 12.0 * k, 90.0, 12.0 * k + 10, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, page_num int, region_idx int, x0 double, y0 double, x1 double, y1 double, text string")
    heads = {r.region_idx: r["head"] for r in fragments.formula_groups(df).collect()}
    assert heads[2] == 1 and heads[0] == 0 and heads[3] == 3 and heads[7] == 7 and heads[4] == heads[5] == 4


def test_spans_and_verdicts_on_odd_values(spark):
    spans = F.array(F.struct(F.lit("a b").alias("text")), F.struct(F.lit(" ").alias("text")), F.struct(F.lit("cd").alias("text")))
    assert [(s.start, s.end) for s in one(spark, context.realigned(spans, F.lit("x a  b c d")))] == [(2, 5), (7, 9)]
    assert one(spark, context.realigned(spans, F.lit("nada"))) is None and one(spark, context.located(F.lit(""), F.lit("x"))) is None
    assert one(spark, coherence.first_object(F.lit("sem objeto"))) is None
    assert one(spark, coherence.read_verdict(F.lit(None).cast("string"))).asDict() == {"same": False, "keep": "ambos", "confidence": 0.0, "reason": ""}
    assert one(spark, documents.described_parts(F.lit(None).cast("string"))) == []
