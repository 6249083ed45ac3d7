import hashlib
import random

import numpy as np
import pytest

from tests.llm import brute
from textloom.llm import bitsliced, decontamination, licenses, warc

random = random.Random(3)
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "über", "ñu"]


def some(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def test_decontamination_against_brute_force(spark):
    items = [(i, some(n)) for i, n in enumerate((25, 10, 9, 3, 1, 40))] + [(6, None), (7, "..."), (None, "alpha beta"), (1, some(12)), (8, "ZETA, eta? theta"), (9, "zeta eta theta")]
    docs = [(i, some(random.choice([0, 1, 2, 5, 30, 200]))) for i in range(60)]
    docs += [(100, None), (101, "!!"), (102, some(50) + " " + items[0][1].upper().replace(" ", " - ") + " " + some(4)), (103, items[5][1]), (103, items[5][1]), (104, "Zeta ETA theta")]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, items string, row int").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.contaminated(d, b).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in rows) == sorted((a, n, h, tuple(i)) for a, n, h, i in brute.contamination(docs, items))
    for r in decontamination.digest(decontamination.contaminated(d, b)).collect():
        found = next(x for x in brute.contamination(docs, items) if x[0] == r.doc_id)
        assert (r.n_items, r.items_sha256, r.contaminated) == (len(found[3]), hashlib.sha256(",".join(found[3]).encode()).hexdigest(), found[2] > 0)
    kept = {r.doc_id for r in decontamination.clean(d, b).collect()}
    assert kept == {x[0] for x in brute.contamination(docs, items) if not x[2]}


def test_decontamination_without_items_or_documents(spark):
    docs, none = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r["items"]) for r in decontamination.contaminated(docs, none).collect()] == [(3, 0, [])]
    assert decontamination.contaminated(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    assert decontamination.clean(docs, none).count() == 1


def test_decontamination_judges_documents_without_an_id_by_their_text(spark):
    item = some(12)
    docs = spark.createDataFrame([(None, "x " + item, 1), (None, "clean", 2), (None, None, 3), (4, item, 4), (5, "clean", 5)], "doc_id long, text string, n int")
    assert sorted(r.n for r in decontamination.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()) == [2, 3, 5]


def test_decontamination_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    items, docs = [(1, some(12))], [(k, some(40)) for k in range(9)]
    docs.append((50, "x " + items[0][1]))
    rows = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_hit) for r in rows) == sorted((a, h) for a, _, h, _ in brute.contamination(docs, items))


def test_decontamination_by_shuffle_is_that_in_place(spark, monkeypatch):
    letters = [a + b + c for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    items = [(k, " ".join(random.choice(letters) for _ in range(20))) for k in range(9_500)]
    long_ = [random.choice(letters) for _ in range(60_000)]
    for k in range(0, 9_500, 100):
        at = random.randrange(len(long_) - 20)
        long_[at : at + 20] = items[k][1].split()
    docs = [(1, " ".join(long_)), (2, None), (2, items[7][1]), (2, items[7][1]), (None, items[8][1]), (3, "")] + [(10 + k, " ".join(random.choice(letters) for _ in range(50))) for k in range(30)]
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 100_000)
    monkeypatch.setattr(decontamination, "BROADCAST_SHINGLES", 100_000)
    df, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert decontamination.item_windows(b, 10).count() > 100_000
    found = decontamination.contaminated(df, b)
    exchanges = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line]
    rows = found.collect()
    assert exchanges and not any("w#" in line for line in exchanges)
    want = brute.contamination(docs, items)
    assert sorted(((r.doc_id or 0), r.n_words, r.n_hit, tuple(r["items"])) for r in rows) == sorted(((a or 0), n, h, tuple(i)) for a, n, h, i in want)
    assert max(x[2] for x in want) > 1500


BASE = {("gnu", "general", "public", "license"): "gpl", ("apache", "license"): "apache", ("cc", "by"): "cc-by", ("mit", "license"): "mit"}


def test_license_base_places(spark):
    bits = ["gnu general public license", "Apache-License", "CC BY", "cc by-nc 4.0", "MIT  license,", "mit", "license", "word", "apache", "licence", "released under the mit license", "gnu"]
    docs = [(i, " ".join(random.choice(bits) for _ in range(random.choice([0, 1, 5, 80])))) for i in range(60)] + [(100, None), (101, ""), (102, "mit license " * 2000)]
    rows = {r.doc_id: r for r in licenses.summary(licenses.scan(spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, words int"))).collect()}
    for i, t in docs:
        w, r = brute.words(t), rows[i]
        found = sorted((k, label) for phrase, label in BASE.items() for k in range(len(w)) if tuple(w[k : k + len(phrase)]) == phrase)
        assert (r.n_words, r.n_base) == (len(w), len(found))
        assert (r.first_word, r.last_word) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(r.labels.split(","))))


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under the MIT License.", "mit"),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
        ("licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        ("gnu lesser general public license v2.1", "lgpl"),
        ("Mozilla Public License 2.0", "mpl-2.0"),
        ("a plain text with a license to drive", ""),
    ],
)
def test_license_labels(spark, text, labels):
    assert licenses.summary(licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first().labels == labels


def spellings(parts):
    """Every text that a rule's regex matches."""
    from re import _constants as c

    out = [""]
    for op, arg in parts:
        if op is c.LITERAL:
            one = [chr(arg)]
        elif op is c.IN:
            one = [chr(x) for _, x in arg]
        elif op is c.BRANCH:
            one = [x for branch in arg[1] for x in spellings(branch)]
        elif op is c.SUBPATTERN:
            one = spellings(arg[3])
        elif op is c.MAX_REPEAT:
            assert arg[:2] == (0, 1)
            one = ["", *spellings(arg[2])]
        else:
            raise ValueError(op)
        out = [a + b for a in out for b in one]
    return out


def test_every_spelling_of_a_license_rule_passes_its_gate():
    from re import _parser

    listed = [(regex, keyword) for _, regex, keyword in licenses.NAMES] + [(regex, keyword) for _, regex, keyword, _ in licenses.NOTICES]
    assert [] == [(keyword, text) for regex, keyword in listed for text in spellings(_parser.parse(regex)) if keyword not in text.split(" ")]


@pytest.mark.parametrize(("text", "label"), [("Zero-Clause BSD", "0bsd"), ("the Unlicence", "unlicense"), ("Do What The Fuck You Want To Public License", "wtfpl"), ("CreativeML Open RAIL-M", "openrail"), ("licensed under GPL2", "gpl-2.0"), ("Apache2", "apache-2.0"), ("FreeBSD", "bsd-2-clause")])
def test_license_spellings_without_the_usual_keyword(spark, text, label):
    assert licenses.summary(licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first().labels == label


def test_license_suppression_by_brute_force(spark):
    text = "released under the mit license or mit license and licensed under cc by nc sa 4 0 international"
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    import re

    spaced, every = f" {text} ", []
    for _, regex, keyword, rank, k in licenses.rules():
        if keyword in text.split():
            every += [(spaced[: m.start()].count(" ") - 1, spaced[: m.end()].count(" ") - 1, rank, k) for m in re.finditer(regex, spaced)]
    stay = [d for d in every if not any(e != d and e[0] <= d[0] and d[1] <= e[1] and (e[2] > d[2] or e[2] == d[2] and (e[:2] != d[:2] or e[3] < d[3])) for e in every)]
    assert sorted((d["first"], d["last"], d["rank"], d["rule"]) for d in row["kept"]) == sorted(stay)
    assert len(licenses.rules()) > 300


def test_top_k_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bitsliced, "BLOCK", 70)
    monkeypatch.setattr(bitsliced, "QUERIES", 3)
    rng = np.random.default_rng(5)
    vectors = [(i, rng.normal(size=9).round(2).tolist()) for i in range(300)] + [(i, [0.5] * 9) for i in range(300, 330)]
    vectors += [(400, None), (401, [1.0, None] + [0.0] * 7), (450, [float("nan")] + [0.0] * 8), (451, [float("inf")] * 9), (500, [1.0, 2.0]), (501, [-1.0, 2.0]), (None, [0.1] * 9), (550, [300.0, -300.0] + [0.0] * 7)]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, score int").repartition(3)
    folder = f"file://{tmp_path}/index"
    bitsliced.build_index(df, folder)
    rows = bitsliced.search(spark, folder, df.where("vec_id % 50 = 0"), 5).collect()
    good = {i: [int(np.floor(256 * x)) for x in v] for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q in (i for i in good if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(scores[:5])}
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in rows} == want


def test_top_k_of_components_of_any_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bitsliced, "BLOCK", 20)
    rng = np.random.default_rng(6)
    vectors = [(i, rng.normal(size=4).round(2).tolist()) for i in range(60)] + [(100 + i, (rng.normal(size=4) * 10.0 ** (4 + i)).tolist()) for i in range(20)]
    vectors += [(150, [1e308, -1e308, 3.0, 70_000.5]), (151, [1.7e308, 1.0, 0.0, 0.0]), (152, [-1.7e308, 1.0, 0.0, 0.0]), (200, [65_536.25, -0.1, 0.0, 1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    folder = f"file://{tmp_path}/index"
    bitsliced.build_index(df, folder)
    rows = bitsliced.search(spark, folder, df.where("vec_id % 50 = 0"), 5).collect()
    good = {i: [(lambda a, b: 256 * a // b)(*x.as_integer_ratio()) for x in v] for i, v in vectors}
    most, want = (1 << 63) - 1, set()
    for q in (i for i in good if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)
        want |= {(q, k + 1, i, max(-most, min(most, -s))) for k, (s, i) in enumerate(scores[:5])}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in rows} == want


def test_top_k_of_repeated_query_rows(spark, tmp_path):
    rng = np.random.default_rng(7)
    vectors = [(i, rng.normal(size=4).round(2).tolist()) for i in range(1, 40)]
    asked = [(0, [1.0, 2.0, -1.0, 0.5]), (0, [1.0, 2.0, -1.0, 0.5]), (50, [1.0, 0.0, 0.0, 0.0]), (50, [-1.0, 0.0, 0.0, 1.0])]
    folder = f"file://{tmp_path}/index"
    bitsliced.build_index(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), folder)
    rows = bitsliced.search(spark, folder, spark.createDataFrame(asked, "vec_id long, embedding array<double>"), 5).collect()
    good, want = {i: [int(np.floor(256 * x)) for x in v] for i, v in vectors}, []
    for q, v in asked:
        scores = sorted((-sum(a * int(256 * b) for a, b in zip(x, v)), i) for i, x in good.items())
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in rows) == sorted(want)


def test_top_k_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    bitsliced.build_index(df, f"file://{tmp_path}/none")
    assert bitsliced.search(spark, f"file://{tmp_path}/none", df, 5).count() == 0


def test_warc_round_trip(spark, tmp_path):
    warc.register(spark)
    big, other = "é" * 600 + "\r\n\r\nWARC/1.1\r\n", "y" * 999
    rows = [(1, "http://a/\r\nx", big), (2, None, big), (3, "http://b", None), (4, "http://c", ""), (5, "http://d", other), (6, "http://e", other), (7, "http://f", big), (8, "http://g", "z" * 300_000), (8, "http://g", "z" * 300_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    folder = f"file://{tmp_path}/archives"
    warc.records_of(pages).write.format("warc").mode("append").save(folder)
    found = spark.read.format("warc").option("payload", "verify").load(folder).select("*", warc.page_of("record_id").alias("page_id"), warc.page_of("refers_to").alias("to")).collect()
    assert len(found) == len(rows)
    for r in found:
        _, url, html = next(x for x in rows if x[0] == r.page_id)
        data = (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert r.target_uri == (url and url.replace("\r\n", " "))
        assert (r.record_type, r.to) == (("revisit", 7) if r.page_id in (1, 2) else ("response", None))
        assert bytes(r.payload or b"") == (b"" if r.record_type == "revisit" else data)
    read = spark.read.format("warc").option("payload", "false").load(folder)
    assert read.where("record_type = 'revisit'").count() == 2 and read.where("target_uri LIKE 'http://d%'").count() == 1
    assert read.where("payload IS NOT NULL").count() == 0
    assert spark.read.format("warc").load(f"file://{tmp_path}/nothing").count() == 0


def test_warc_of_an_empty_table_and_of_rows_that_share_an_id(spark, tmp_path, monkeypatch):
    warc.register(spark)
    pages = spark.createDataFrame([(1, "http://a", "x" * 2000), (1, "http://b", "y"), (None, None, None), (2, "http://c", "x" * 2000)], "page_id long, url string, html string")
    warc.records_of(pages.limit(0)).write.format("warc").mode("append").save(f"file://{tmp_path}/none")
    assert spark.read.format("warc").load(f"file://{tmp_path}/none").count() == 0
    for most in (0, 100):
        monkeypatch.setattr(warc, "MOST_DIGESTS", most)
        folder = f"file://{tmp_path}/some{most}"
        warc.records_of(pages).write.format("warc").mode("append").save(folder)
        rows = spark.read.format("warc").load(folder).collect()
        assert len({r.record_id for r in rows}) == 4
        assert {r.refers_to for r in rows} - {None} == {r.record_id for r in rows if r.target_uri == "http://c"}


def test_warc_passes_over_broken_records_and_reads_below_folders(tmp_path):
    import gzip

    row = {"payload": b"page", "record_type": "response", "payload_bytes": 4, "payload_digest": "00" * 20, "date": "d", "target_uri": "u", "refers_to": None}
    good = [warc.record(row | {"record_id": f"<x:{k}>"}) for k in range(3)]
    no_length = good[1].replace(b"Content-Length: ", b"Content-Length: x", 2)
    odd_digest = good[1].replace(b"sha1:", b"sha1:!")
    nested = tmp_path / "2020" / "01"
    nested.mkdir(parents=True)
    (nested / "a.warc").write_bytes(b"".join([good[0], no_length, odd_digest, good[2], b"WARC/1.1\r\nWARC-Type: resp"]))
    (nested / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, [good[0], no_length, b"WARC/1.1\r\n", odd_digest, good[2]])))
    (nested / "c.warc.gz").write_bytes(b"".join(map(warc.member, [good[0], no_length, b"WARC/1.1\r\n", odd_digest, good[2]])))
    for path, n in ((tmp_path, 9), (nested / "a.warc", 3), (nested / "b.warc.gz", 3), (nested / "c.warc.gz", 3)):
        reader = warc.WarcReader({"path": str(path)})
        read = [r for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
        assert sorted(r["record_id"] for r in read) == sorted(["<x:0>", "<x:1>", "<x:2>"] * (n // 3))
        assert {r["payload"] for r in read} == {b"page"} and {r["payload_digest"][:6] for r in read} == {"000000", "sha1:!"}


def test_warc_readers_skip_and_read_foreign_files(tmp_path):
    import gzip

    row = {"payload": b"p" * 200_000 + b"\r\n\r\n", "record_type": "response", "payload_bytes": 200_004, "payload_digest": "00" * 20, "date": "d", "target_uri": "u", "refers_to": None}
    records = [warc.record(row | {"record_id": f"<x:{k}>"}) for k in range(4)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(warc.member, records)))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "c.warc").write_bytes(b"".join(records))
    assert gzip.decompress((tmp_path / "a.warc.gz").read_bytes()) == b"".join(records)
    for payload, length in (("true", 200_004), ("false", 0)):
        reader = warc.WarcReader({"path": str(tmp_path), "payload": payload})
        read = [r for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
        assert len(read) == 12 and {(r["payload_bytes"], len(r["payload"] or b"")) for r in read} == {(200_004, length)}
