import random

from pyspark.sql import functions as F

from textloom.operators import blocks, formulas, layout, reports, validators
from textloom.plans import catalog
from textloom.sources import files, render, store
from textloom.streaming import intake

SF = "/root/testdata/sf0.001"


def boxes(spark, rows):
    return spark.createDataFrame([(1, 0, k, *map(float, b), "text", "x", 1.0) for k, b in enumerate(rows)], "doc_id long, page_num int, region_idx int, x0 double, y0 double, x1 double, y1 double, type string, text string, confidence double")


def test_near_pairs_against_all_pairs(spark):
    draw = random.Random(2)
    rows = [(x := draw.uniform(0, 400), y := draw.uniform(0, 900), x + draw.uniform(5, 200), y + draw.uniform(2, 300)) for _ in range(70)]
    found = {(r.a_region_idx, r.b_region_idx) for r in layout.near_pairs(boxes(spark, rows), 40.0).collect()}
    want = {(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if i != j and max(a[1] - b[3], b[1] - a[3], 0) <= 40}
    assert found == want
    assert layout.near_pairs(boxes(spark, rows), 40.0).count() == len(want)


def test_reading_order(spark):
    rows = [(0, 0, 100, 20), (150, 0, 250, 20), (0, 30, 100, 50), (150, 30, 250, 50)]
    order = [r.region_idx for r in layout.reading_order(boxes(spark, rows)).orderBy("ord").collect()]
    assert order == [0, 2, 1, 3]


def test_uncovered_and_overlaps(spark):
    known, new = boxes(spark, [(0, 0, 200, 200)]), boxes(spark, [(0, 0, 200, 190), (300, 0, 500, 200), (600, 0, 610, 10)])
    assert [r.region_idx for r in layout.uncovered(new, known).collect()] == [1]
    both = known.withColumn("region_idx", F.lit(9)).unionByName(new.withColumn("type", F.lit("unknown")))
    assert {(r.region_idx, r.other_idx) for r in layout.overlaps(both).collect()} == {(0, 9)}


def test_blocks(spark):
    text = "# Título\nTEXTO EM MAIUSCULAS\n- um\n2. dois\n| a | b |\n|---|---|\n| 1 | 2 |\nUma frase.\n```\n[imagem decorativa]"
    rows = blocks.parsed(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id", "ord").collect()
    assert [(r.type, r.level, r.text or r["item"], r.start) for r in rows] == [("heading", 1, "Título", None), ("heading", 2, "TEXTO EM MAIUSCULAS", None), ("list", None, "um", None), ("list", None, "dois", 2), ("table", None, None, None), ("paragraph", None, "Uma frase.", None), ("code", None, "```", None), ("image", None, None, None)]
    assert rows[4].rows == [["a", "b"], ["1", "2"]]


def test_sections(spark):
    rows = [(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 2), (1, 5, 4), (1, 6, 1)]
    df = spark.createDataFrame([(d, o, "heading", lv, str(o)) for d, o, lv in rows], "doc_id long, ord int, type string, level int, text string")
    parents, stack = {}, []
    for _, o, lv in rows:
        while stack and stack[-1][1] >= lv:
            stack.pop()
        parents[o] = stack[-1][0] if stack else None
        stack.append((o, lv))
    assert {r.ord: r.parent_ord for r in blocks.sections(df).collect()} == parents


def test_pruning(spark):
    long_ = "O triângulo retângulo tem catetos de três e quatro metros e hipotenusa de cinco metros no desenho"
    rows = [(1, 0, "paragraph", "Texto digitalizado: " + long_), (1, 1, "paragraph", "Página 2 de 9"), (1, 2, "table", "x"), (1, 3, "paragraph", long_ + "."), (1, 4, "paragraph", "outra coisa"), (1, 5, "paragraph", "Outra coisa!")]
    kept = blocks.pruned(spark.createDataFrame(rows, "doc_id long, ord long, type string, text string"), "ord").orderBy("ord").collect()
    assert [(r.ord, r.type) for r in kept] == [(3, "paragraph"), (2, "table"), (5, "paragraph")] or {r.ord for r in kept} == {2, 3, 5}


def test_formulas_and_nodes(spark):
    rows = spark.createDataFrame([(1, "x² = 4"), (2, "x² = 4"), (3, None), (4, "(")], "id int, source string")
    got = {r.id: r.formula for r in formulas.processed(rows, "source").collect()}
    assert got[1] == got[2] and got[3] is None and got[4].status == "needs_review" and got[1].latex == "{x}^{2} = 4"
    nodes = formulas.tree_nodes(formulas.processed(rows.where("id = 1"), "source").select("id", "formula.*"), "id").orderBy("node_id").collect()
    assert [(n.kind, n.parent_id) for n in nodes] == [("Relation", -1), ("Power", 0), ("Symbol", 1), ("Integer", 1), ("Integer", 0)]


def test_hypotheses(spark):
    rows = spark.createDataFrame([("x2", ["y = x^{2}"], "super"), ("a1", [], "sub"), ("b3", [], None)], "c string, neighbours array<string>, raised string")
    assert {r.c: (r.reading, r.decision) for r in formulas.hypotheses(rows, "c").collect()} == {"x2": ("power", "apply"), "a1": ("subscript", "pending"), "b3": ("power", "leave")}


def test_reports(spark):
    charts = spark.createDataFrame([(1, 1, "2019", 10.0), (1, 2, "2020", 12.0), (1, 3, "2021", 15.0)], "k int, o int, l string, v double")
    r = reports.extremes(charts, "k", order="o", label="l", value="v").first()
    assert (r.highest, r.lowest, r.trend, r.rises) == ("2021", "2019", "rises", 2)
    gate = reports.gate(spark.createDataFrame([(1, "error"), (2, "INFO"), (3, "Blocker"), (4, "WARNING")], "d int, severity string"), "d")
    assert {r.d: (r.status, r.publish) for r in gate.collect()} == {1: ("needs_review", False), 2: ("aprovado", True), 3: ("blocked", False), 4: ("publicavel_com_avisos", True)}


def test_files(spark, tmp_path):
    for name, data in {"a.pdf": b"%PDF-1.7", "b.pdf": b"no", "c.webp": b"RIFF0000WEBP", "d.webp": b"RIFF0000XXXX", "e.xyz": b"1", "noext": b"1", "f_acessivel.html": b"<p>", "g.html": b"x made-by-textloom"}.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.name: (r.code, r.own) for r in files.read(spark, str(tmp_path)).select("name", files.refusal().alias("code"), files.own_output("made-by-textloom").alias("own")).collect()}
    assert rows == {"a.pdf": (None, False), "b.pdf": ("UPLOAD-MAGIC-001", False), "c.webp": (None, False), "d.webp": ("UPLOAD-MAGIC-002", False), "e.xyz": ("UPLOAD-EXT-001", False), "noext": ("UPLOAD-EXT-000", False), "f_acessivel.html": (None, True), "g.html": (None, True)}


def test_store(spark, tmp_path):
    s = store.Store(spark, f"{tmp_path}/store")
    assert s.conversions().count() == 0
    s.append("conversions", spark.sql("SELECT 't1' task_id, 'a.pdf' file, TIMESTAMP '2024-01-01 10:00:00' created_at"))
    s.append("conversions", spark.sql("SELECT 't1' task_id, 'again' file, TIMESTAMP '2024-01-01 11:00:00' created_at"))
    s.append("conversions", spark.sql("SELECT 't1' task_id, 'done' status, 3.5D seconds, TIMESTAMP '2024-01-01 12:00:00' finished_at"))
    r = s.conversions().first()
    assert (r.file, r.status, r.seconds) == ("a.pdf", "done", 3.5)
    s.append("cache", spark.sql("SELECT 'k' key, 'old' payload, TIMESTAMP '2024-01-01 10:00:00' stored_at UNION ALL SELECT 'k', 'new', TIMESTAMP '2024-01-01 10:30:00'"))
    keys = spark.sql("SELECT 'k' key")
    assert s.cached(keys, 3600, F.lit("2024-01-01 11:00:00").cast("timestamp")).first().payload == "new"
    assert s.cached(keys, 60, F.lit("2024-01-01 11:00:00").cast("timestamp")).count() == 0


def test_rendering(spark):
    text = "# T <1>\n- um\n| a | b |\n| 1 | 2 |\nFim."
    parsed = blocks.parsed(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert render.txt(parsed).first().txt == "T <1>\n- um\nTabela com 1 registros e 2 colunas. Cabeçalhos: a, b.\nLinha 1: a: 1; b: 2.\nFim."
    html = render.html(parsed).first().html
    assert '<h1 id="s1">T &lt;1&gt;</h1>' in html and '<th scope="col">a</th>' in html and '<a href="#s1">' in html
    assert render.ssml(parsed).first().ssml.count("<break") == 4
    import json

    assert [b["t"] for b in json.loads(render.pandoc(parsed).first().pandoc)["blocks"]] == ["Header", "Para", "Para", "Para"]
    pieces = render.chunks(spark.createDataFrame([(1, "\n".join("x" * 400 for _ in range(10)))], "k int, t string"), "k", "t").collect()
    assert all(len(p.chunk) < 1500 for p in pieces) and sum(p.chunk.count("x") for p in pieces) == 4000


def test_streams(spark, tmp_path):
    rows = [("a", "2024-01-01 10:00:00", None, 0.1), ("a", "2024-01-01 10:05:00", "done", 1.0), ("b", "2024-01-01 10:00:00", None, 0.2), ("c", "2024-01-01 10:01:00", "cancelled", None), ("c", "2024-01-01 10:02:00", "done", 1.0)]
    spark.createDataFrame(rows, "task string, t string, status string, progress double").selectExpr("task", "CAST(t AS timestamp) ts", "status", "progress").coalesce(1).write.parquet(f"{tmp_path}/in")
    schema = "task string, ts timestamp, status string, progress double"
    query = intake.task_states(intake.files(spark, f"{tmp_path}/in", schema)).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", f"{tmp_path}/c1").start()
    query.processAllAvailable()
    spark.sql("SELECT 'z' task, TIMESTAMP '2024-01-01 15:00:00' ts, CAST(NULL AS string) status, 0D progress").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    query.processAllAvailable()
    query.stop()
    found = {}
    for r in spark.sql("SELECT * FROM states").collect():
        found.setdefault(r.task, []).append(r.status)
    assert found["a"][0] == "done" and found["c"][0] == "cancelled" and found["b"] == ["processing", "error"]
    events = intake.files(spark, f"{tmp_path}/in", schema, 10)
    once = intake.first_within(events, ["task"], "ts", 3600).writeStream.format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/c2").start()
    once.processAllAvailable()
    once.stop()
    assert spark.sql("SELECT task FROM once").count() == 4


def test_ledger(spark):
    records = formulas.processed(spark.createDataFrame([(1, "x² = \\frac{1}{2}"), (2, "(x = 3")], "k int, source string"), "source").select("k", "source", "formula.*")
    assert validators.of_serialisations(records, "k").count() == 0 and validators.of_speech(records, "k").count() == 0
    assert {(r.object, r.check) for r in validators.of_formulas(records, "k").collect()} == {("2", "parenteses")}
    broken = records.where("k = 1").withColumn("mathml", F.lit("<mn>1</mn>"))
    assert {r.check for r in validators.of_serialisations(broken, "k").collect()} == {"Power_mathml", "Divide_mathml", "numbers_mathml"}
    parsed = blocks.parsed(spark.createDataFrame([(1, "# A\n### B\nchain of thought\n|a|b|\n|1|"), (2, "limpo")], "doc_id long, text string"))
    assert {(r.object, r.check) for r in validators.of_blocks(parsed).collect()} == {("1:2", "niveis"), ("1:3", "vazamento"), ("1:4", "tabela_irregular")}
    rows = spark.createDataFrame([(1, 1, "technical"), (1, 2, None)], "doc_id int, ord int, verbosity string")
    assert [r.object for r in validators.of_profile(rows, "txt").collect()] == ["1:1"]
    a, b = spark.createDataFrame([(1, "x  y"), (2, "z")], "doc_id int, t string"), spark.createDataFrame([(1, "x y"), (3, "w")], "doc_id int, t string")
    assert {r.object for r in validators.equal_outputs(a, b, "t").collect()} == {"2", "3"}


def test_ledger_reads_a_record_once(spark):
    sources = [(1, "x² = \\frac{1}{2}"), (2, "(x = 3"), (3, "(x = 3"), (4, None)]
    records = formulas.processed(spark.createDataFrame(sources, "k int, source string"), "source").select("k", "source", "formula.*")
    broken = records.withColumns({"mathml": F.lit("<mn>1</mn>"), "speech": F.lit("x plus ²")})
    apart = validators.union([of(broken, "k") for of in (validators.of_formulas, validators.of_serialisations, validators.of_speech)])
    assert sorted(map(tuple, validators.of_records(broken, "k").collect())) == sorted(map(tuple, apart.collect()))
    levels = [("heading", None), ("heading", 3), ("paragraph", None), ("heading", 5), ("heading", 6), ("code", None)]
    rows = spark.createDataFrame([(1, k, t, n, "x", None, None) for k, (t, n) in enumerate(levels)], "doc_id int, ord int, type string, level int, text string, item string, rows array<array<string>>")
    skipped = {(r.object, r.evidence) for r in validators.of_blocks(rows).where("check = 'niveis'").collect()}
    assert skipped == {(f"1:{r.ord}", f"{r.previous} > {r.level}") for r in blocks.skipped_levels(rows.where("type = 'heading'")).collect()} == {("1:3", "3 > 5")}


def test_issue_ledger_makes_its_inputs_once(spark):
    plan = catalog.val14_issue_ledger(spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("documents.parquet") == 1, plan
