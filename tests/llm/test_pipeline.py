import pytest

from tests.llm import brute


def test_stages_and_their_effects(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    from textloom.llm.shared import kept

    columns, now = docs.columns, docs
    for name, stage in pipeline.STAGES[:-1]:
        before, now = now, kept(stage(spark, now, sf), "stage")
        assert now.columns == columns
        was, has = ({r.doc_id: r.text for r in x.collect()} for x in (before, now))
        assert set(has) <= set(was) and len(has) > 0.7 * len(was)
        if name == "near duplicates":
            assert set(has) == set(brute.classes(list(was.items())).values())
        elif name == "repeated passages":
            assert brute.repeats(list(has.items())) == {}
            hit = brute.repeats(list(was.items()))
            assert all(has.get(i) == t for i, t in was.items() if i not in hit) or len([i for i, t in was.items() if i not in hit and has.get(i) != t]) < 20
        elif name == "decontamination":
            assert set(has) == {x[0] for x in brute.contamination(list(was.items()), items) if not x[2]}
    pieces = pipeline.STAGES[-1][1](spark, now, sf)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in now.select("doc_id").collect()}


def test_stages_on_odd_rows_and_columns(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from pyspark.sql import functions as F

    from textloom.llm.shared import kept

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    long_ = " ".join(f"wort{k % 977} und{k % 389}" for k in range(60_000))
    odd = [(None, None), (None, ""), (None, "ein kurzer sauberer text ohne kennung"), (90_001, None), (90_002, "   "), (90_003, long_), (90_004, "ein kurzer sauberer text mit kennung"), (90_005, "?! ...")]
    more = spark.createDataFrame([(i, t, "de", "odd", len(t or "")) for i, t in odd], docs.schema)
    now = docs.unionByName(more).select("*", F.lit("x").alias("words"), F.lit(1).alias("key"), F.lit(2.5).alias("row"), F.lit("y").alias("repeats_0"), F.lit("z").alias("kept_id"))
    columns = now.columns
    for _, stage in pipeline.STAGES[:-1]:
        now = kept(stage(spark, now, sf), "stage")
        assert now.columns == columns
        found = now.where("source = 'odd'").select("doc_id", "text").collect()
        assert {"ein kurzer sauberer text ohne kennung", "ein kurzer sauberer text mit kennung", long_} <= {r.text for r in found}
        assert sum(r.doc_id is None for r in found) == 3
    pieces = pipeline.STAGES[-1][1](spark, now, sf)
    assert pieces.where("doc_id IS NULL").count() >= 3 and pieces.where("doc_id = 90003").agg(F.sum("length")).first()[0] > 60_000


def test_stages_on_an_empty_table(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
