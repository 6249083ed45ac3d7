import gc
import random
import time
from pathlib import Path

from pyspark.sql import functions as F

from tests.llm import brute
from textloom.llm import components, jaccard_join, shared, substring
from textloom.llm.shingles import ngrams

random = random.Random(7)
VOCABULARY = ["".join(random.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]


def text(n):
    return [random.choice(VOCABULARY) for _ in range(n)]


def edited(w, n):
    w = list(w)
    for _ in range(n):
        w[random.randrange(len(w))] = random.choice(VOCABULARY)
    return w


def corpus():
    docs, base = [], [text(150) for _ in range(12)]
    for k, b in enumerate(base):
        docs += [b] + [edited(b, random.choice([0, 1, 2, 3, 6])) for _ in range(60 if k == 0 else k % 4)]
    docs += [text(random.choice([1, 3, 4, 5, 20])) for _ in range(40)] + [["same"], ["same"], []]
    random.shuffle(docs)
    return [(i, " ".join(w)) for i, w in enumerate(docs)] + [(9000, None), (9001, "?! ..."), (9002, "")]


def test_near_duplicates_are_those_of_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, id int, words string").repartition(5)
    rows = jaccard_join.near_duplicates(df).collect()
    assert {r.doc_id: r.class_id for r in rows} == brute.classes(docs)
    kept = {r.doc_id for r in jaccard_join.first_of_class(df).collect()}
    assert kept == set(brute.classes(docs).values())


def test_links_in_large_buckets_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PART", 20)
    monkeypatch.setattr(jaccard_join, "MET", 2)
    base = text(150)
    docs = [(i, " ".join(edited(base, i % 4))) for i in range(120)] + [(200 + i, " ".join(text(60))) for i in range(20)]
    sets = {}
    for i, t in docs:  # one of each text
        sets.setdefault(t, (i, brute.shingles(t)))
    want = {t: sum(len(own & x) / len(own | x) >= 0.8 for k, x in sets.values() if k != i) for t, (i, own) in sets.items()}
    rows = {r.doc_id: r for r in jaccard_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert max(want.values()) > jaccard_join.SMALL
    assert {i: rows[i].n_links for i, _ in docs} == {i: want[t] for i, t in docs}
    assert {i: r.class_id for i, r in rows.items()} == brute.classes(docs)


def test_near_duplicates_of_odd_tables(spark):
    assert jaccard_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A, b; c d e F"), (3, "a b c d e g"), (4, "a b"), (5, "a b")]
    found = {r.doc_id: r.class_id for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_documents_without_an_id_stay(spark):
    w = " ".join(text(40))
    rows = [(None, w, 1), (None, " ".join(text(40)), 2), (3, w, 3), (4, w, 4), (None, None, 5), (None, w, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    found = [(r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(df).collect()]
    assert sorted(found, key=str) == sorted([(None, None, 0)] * 4 + [(3, 3, 0), (4, 3, 0)], key=str)
    assert sorted(r.n for r in jaccard_join.first_of_class(df).collect()) == [1, 2, 3, 5, 6]


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.8, 0.999), (0.5, 0.99), (0.95, 0.9)):
        bands, rows = jaccard_join.bands_for(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (12, 11), (7, 7)] + [(100 + k, 101 + k) for k in range(40)]
    found = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {k: found[k] for k in (1, 2, 3, 4, 10, 11, 12)} == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10}
    assert all(found[100 + k] == 100 for k in range(41))


def test_compact_windows_are_nodes_of_the_tree(monkeypatch):
    monkeypatch.setattr(substring, "CHUNK", 64)
    grams = ngrams(substring.hashed([w.encode() for w in text(200)]), 5)
    values = grams.astype("uint32") * substring.functions_of(0)[:, None]
    want = set()  # at each place the least values of each band's functions
    for p in range(len(grams) - 46 + 1):
        for band in range(substring.BANDS):
            want.add((band, *(int(values[band * substring.ROWS + r, p : p + 46].min()) for r in range(substring.ROWS)), p))
    keys, starts, ends = substring.overlaps(grams, 46)
    covered = [p for s, e in zip(starts, ends, strict=True) for p in range(s, e)]
    assert sorted(covered) == sorted(p for *_, p in want)
    by_place = {}
    for key, s, e in zip(keys.tolist(), starts, ends, strict=True):
        for p in range(s, e):
            by_place.setdefault(p, set()).add(key)
    by_values = {}
    for *values_of, p in want:
        by_values.setdefault(tuple(values_of), []).append(p)
    for places in by_values.values():  # equal least values, equal signature
        assert set.intersection(*(by_place[p] for p in places))


def planted(words, edits, n, between=0):
    """n groups of documents with a passage that differs in `edits` words; `between`: a smaller document has 30 words of it."""
    docs, pairs = [], []
    for _ in range(n):
        passage = text(words)
        if between:
            docs.append(text(40) + passage[: words // 2 + 5] + text(40))
        docs += [text(60) + passage + text(60), text(60) + edited(passage, edits) + text(60)]
        pairs.append(len(docs) - 1)
    return [(i, " ".join(w)) for i, w in enumerate(docs)], pairs


def test_edited_passages_are_found_at_any_length(spark):
    cases = [(50, 1), (60, 1), (80, 1), (100, 2), (150, 3), (200, 4)]
    for between in (0, 1):
        docs, want = [], {}
        for case in cases:
            rows, last = planted(*case, 60, between)
            want[case] = [len(docs) + i for i in last]
            docs += [(len(docs) + i, t) for i, t in rows]
        found = {}
        for r in substring.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect():
            found.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        for (words, edits), ids in want.items():
            hit = sum(len(found.get(i, set()) & set(range(60, 60 + words))) >= 0.8 * words for i in ids)
            assert hit >= 0.9 * len(ids), (words, edits, between, hit)
            assert all(len(found.get(i, set()) - set(range(60, 60 + words))) <= 5 for i in ids)


def passages():
    shared, line, long_ = text(70), text(40), text(200)
    docs = [text(100) + shared + text(90), text(30) + shared, text(200), text(60) + line + text(60), line + text(80), text(20) + shared[:55], long_ + text(20), text(10) + long_]
    docs += [text(40) + line + text(50) for _ in range(8)] + [text(80) + edited(long_, 2), text(49), text(5)]
    return [(i, " ".join(w)) for i, w in enumerate(docs)] + [(500, None), (501, "")]


def test_passages_are_those_of_brute_force(spark):
    docs = passages()
    df = spark.createDataFrame([(i, t, 0, 1) for i, t in docs], "doc_id long, text string, words int, spans int").repartition(3)
    found, near = {}, brute.repeats(docs)
    for r in substring.repeated_passages(df).collect():
        assert r.ref_doc_id < r.doc_id and r.end_word - r.start_word >= 50
        found.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    for doc, hit in near.items():
        assert hit <= found[doc]
    assert set(found) == set(near) | {max(i for i, t in docs if t and len(t.split()) == 280)}
    left = {r.doc_id: r.text for r in substring.without_repeats(df).collect()}
    assert brute.repeats([(i, t) for i, t in left.items() if t]) == {}
    for i, t in docs:
        if i not in found:
            assert left[i] == t


def test_common_lines_shorter_than_a_passage_lose_no_passage(spark):
    line, deep = text(45), text(6)
    docs = [(i, " ".join(text(30) + line + (deep if i >= 30 else text(6)) + text(30))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id for r in substring.repeated_passages(df).collect()} == set(brute.repeats(docs))


def test_edited_passages_in_a_large_group_are_found(spark):
    """Each two documents have one long line; 40 pairs also have an edited passage around it that the smallest document hasn't."""
    line = text(42)
    docs = [(0, text(60) + line + text(60))]
    for k in range(40):
        before, after = text(40), text(40)
        docs += [(2 * k + 1, text(20) + before + line + after + text(20)), (2 * k + 2, text(20) + before + edited(line, 1) + after + text(20))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(3)
    rows = [(i, i % 2, substring.hashed([x.encode() for x in w]).tobytes()) for i, w in docs]
    want = {(2 * k + 1, 2 * k + 2) for k in range(40)}
    within = {p for part in (0, 1) for p in substring.partners([r for r in rows if r[1] == part], part, part, 50, 0.8)}
    assert within | set(substring.partners(rows, 0, 1, 50, 0.8)) == want
    # one group of all: the same pairs through Spark, dealt into parts of 7
    many = spark.createDataFrame([(5, i, 0, len(w) - 49, 12) for i, w in docs], "key long, doc_id long, start int, end int, parts int")
    assert {tuple(r) for r in substring.met_in_parts(many, df, 50, 0.8).collect()} == want


def test_longer_passages_around_one_of_the_smallest_document_are_found(spark):
    docs = []
    for _ in range(40):
        shared, more = text(60), text(10)
        docs += [(len(docs) + k, " ".join(text(30) + w + text(30))) for k, w in enumerate((shared, shared + more, shared + more))]
    found = {}
    for row in substring.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect():
        found.setdefault(row.doc_id, set()).update(range(row.start_word, row.end_word))
    assert [] == [doc for doc, hit in brute.repeats(docs).items() if not hit <= found.get(doc, set())]


def test_files_of_shuffles_go_between_the_steps(spark, monkeypatch):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    drop, seen = substring.drop_shuffles, []

    def watched(session):
        before = files()
        drop(session)
        until = time.time() + 10
        while files() >= before and time.time() < until:
            time.sleep(0.1)
        seen.append((before, files()))

    monkeypatch.setattr(substring, "drop_shuffles", watched)
    substring.repeated_passages(spark.createDataFrame(passages(), "doc_id long, text string").repartition(3))
    assert len(seen) == 1 and all(after < before for before, after in seen), seen


def tables_left(spark, made):
    """Names of the tables that are in the work folder after made(), and weren't before."""
    top = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(top.glob("textloom-*"))
    made()
    return {p.name.split("-")[1] for p in set(top.glob("textloom-*")) - before}


def test_only_results_stay_on_disk(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 4)
    monkeypatch.setattr(jaccard_join, "PART", 8)
    df = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    assert tables_left(spark, lambda: jaccard_join.near_duplicates(df)) == {"classes"}
    df = spark.createDataFrame(passages(), "doc_id long, text string").repartition(3)
    assert tables_left(spark, lambda: substring.repeated_passages(df)) == {"repeats"}


def test_shuffles_of_dropped_frames_go_though_python_has_not_collected(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    shared.drop_shuffles(spark)
    time.sleep(1)
    gc.disable()
    try:
        before = files()
        spark.range(1000).groupBy((F.col("id") % 50).alias("key")).count().where("count > 0").checkpoint()
        spark.range(3).count()
        assert files() > before
        shared.drop_shuffles(spark)
        until = time.time() + 10
        while files() > before and time.time() < until:
            time.sleep(0.1)
        assert files() <= before
    finally:
        gc.enable()


def test_passages_of_odd_tables(spark):
    assert substring.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    w = " ".join(text(80))
    df = spark.createDataFrame([(1, w), (1, w), (2, w.upper()), (3, w + "\n" + w)], "doc_id long, text string")
    assert {r.doc_id for r in substring.repeated_passages(df).collect()} == {2, 3}
    assert {r.doc_id for r in substring.without_repeats(df).collect()} == {1}


def test_cut_words():
    assert substring.cut_words("One, two three; four. Five", [{"s": 1, "e": 3}]) == "One, ; four. Five".replace("; ", "; ")
    assert substring.cut_words("Àb cd", [{"s": 0, "e": 2}]) is None
