import json

from pyspark.sql import functions as F

from textloom.functions import maths, tables
from textloom.operators import evidence


def test_tiers(spark):
    known = spark.createDataFrame([(1, 10, "A função f(x) = 2"), (1, 11, "Outra  linha"), (1, 12, "uma linha bem mais longa com funcao f x 2 dentro")], "doc_id long, evidence_id long, text string")
    asked = spark.createDataFrame([(1, 1, "A  função f(x) = 2"), (1, 2, "OUTRA LINHA!"), (1, 3, "longa com"), (1, 4, "nada disso"), (2, 5, "Outra linha")], "doc_id long, key long, text string")
    assert {r.key: (r.evidence_id, r.tier) for r in evidence.matched(asked, known).collect()} == {1: (10, 1), 2: (11, 2), 3: (12, 3)}


def test_boxes(spark):
    assets = spark.createDataFrame([(1, 1, 10.0, 10.0, 50.0, 50.0), (1, 2, 11.0, 10.0, 50.0, 51.0), (1, 3, 200.0, 1.0, 2.0, 3.0)], "doc_id long, asset_id long, x0 double, y0 double, x1 double, y1 double")
    boxes = spark.createDataFrame([(1, 7, 11.9, 10.0, 50.0, 50.5), (1, 8, 13.5, 10.0, 50.0, 50.0), (1, 9, 100.0, 0.0, 1.0, 1.0)], "doc_id long, key long, x0 double, y0 double, x1 double, y1 double")
    assert {r.key: r.asset_id for r in evidence.at_box(boxes, assets).collect()} == {7: 2}


def test_labels_fields_and_places(spark):
    df = spark.createDataFrame([("Section-Header", "LATEX: a\nLEITURA: b\nLATEX: c "), (None, "")], "l string, t string")
    rows = df.select(evidence.region_type(F.col("l")).alias("k"), evidence.latex_and_reading(F.col("t")).alias("f")).collect()
    assert [(r.k, r.f.latex, r.f.reading) for r in rows] == [("heading", "c", "b"), ("text", None, None)]
    d = spark.createDataFrame([(1.0, 6.0, 12.0), (-1.0, 6.0, 12.0), (1.0, 12.0, 12.0), (0.1, 6.0, 0.0)], "s double, f double, l double")
    assert [r[0] for r in d.select(evidence.digit_place(F.col("s"), F.col("f"), F.col("l"))).collect()] == ["super", "sub", "baseline", "baseline"]


def test_boundaries_and_ambiguities(spark):
    sources = ["x = 1", "(x", "x +", "= 3", "√", "", "x^", "a = = b", "√x + 1", "a + b / c + d"]
    df = spark.createDataFrame([(s,) for s in sources], "s string")
    assert [r[0] for r in df.select(maths.boundary(F.col("s"))["plausible"]).collect()] == [True, False, False, False, False, False, False, False, True, True]
    assert [r[0] for r in df.select(evidence.ambiguities(F.col("s"), F.lit(True))).collect()][-2:] == [["escopo_do_radical"], ["fracao_em_linha_unica"]]
    wide = spark.createDataFrame([("(x - 2)(x", ["- 3) = 0", "z"])], "t string, n array<string>").select(maths.expanded(F.col("t"), F.col("n")).alias("e")).first().e
    assert (wide.text, wide.used, wide.plausible) == ("(x - 2)(x - 3) = 0", 1, True)


def test_tables(spark):
    terms = ["Density (g/cm3)", "gold", "1.5", "xyz", "", "m/s2"]
    df = spark.createDataFrame([(t,) for t in terms], "t string")
    assert [(r[0].term, r[0].known) for r in df.select(tables.translated(F.col("t"))).collect()] == [("Densidade (g/cm³)", True), ("Ouro", True), ("1,5", True), ("xyz", False), ("", True), ("m/s²", True)]
    axes = spark.createDataFrame([("Ano", ["a", "b", "c"]), ("x", ["2019", "2020", "2021"]), ("x", ["1", "2", "3"]), ("x", ["3", "2", "1"]), ("Fase", ["x"])], "h string, l array<string>")
    assert [r[0] for r in axes.select(tables.axis_order(F.col("h"), F.col("l"))).collect()] == ["temporal", "temporal", "continuous", "nominal", "ordinal"]
    cut = spark.createDataFrame([('{"a": [1, {"b": "c',), ("[1]",), (None,), ('{"x\\\\": "y\\', ), ('{"q": "a \\" {", "r": [[2], {"s": 1},',), ("{]",)], "t string")
    found = [r[0] and json.loads(r[0]) for r in cut.select(tables.repaired_json(F.col("t"))).collect()]
    assert found == [{"a": [1, {"b": "c"}]}, None, None, {"x\\": "y"}, {"q": 'a " {', "r": [[2], {"s": 1}]}, None]
    texts = ["uma fra-\nse que\ncontinua aqui\nFim.", "um\ndois\ntres\nquatro", "fim.\ncomeça", "=== Pagina 3 ===\nabc", "a \t\n  b  \n", None]
    lines = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tables.joined_lines(F.col("t"))).collect()]
    assert lines == ["uma frase que\ncontinua aqui\nFim.", "um dois\ntres quatro", "fim.\ncomeça", "=== Pagina 3 ===\nabc", "a b\n", None]
