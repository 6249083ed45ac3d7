import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from textloom.llm import packing, token_files
from textloom.llm.tokens import TextEncoder

ODD = ["", "a  b", "a   b  ", "\n\n\nx \n y", "ΑΣ ΟΔΟΣ", "don't IT'S  \t x", "İstanbul ½ ² a_b", "é é <|endoftext|> x", "x\xa0y\x85z", "日本 x", " a\n b \n", "foo \n", "12 345, 6.7 'll", "\x01\x1c x", "Über ÉCOLE naïve"]
ROWS = [(3, "The quick brown fox"), (1, None), (2, ""), (5, "word " * 3000), (5, "The quick brown fox"), (None, "no id"), (9, "Ünïcödé ñandú 日本")]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_the_library(name, spark):
    own, whole = TextEncoder(public_tokenizers.path(name), most=50), Tokenizer.from_file(public_tokenizers.path(name))
    texts = ODD + [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text in texts:
        assert own.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids, text[:80]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_every_character_are_those_of_the_library(name):
    own, whole = TextEncoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    own.left = 0
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{c}a{c} {c}B{c}{c}\n" for c in every[k : k + 8]) for k in range(0, 0x900, 8)]
    texts += ["".join(f"{c}a {c}" for c in every[k : k + 40]) for k in range(0x800, 0x30000, 40)] + ["".join(every[k : k + 200]) for k in range(0x30000, len(every), 200)]
    for text, ids in zip(texts, whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode(text).tolist() == ids.ids, text


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_random_texts_are_those_of_the_library(name):
    own, whole = TextEncoder(public_tokenizers.path(name), most=500), Tokenizer.from_file(public_tokenizers.path(name))
    random = np.random.default_rng(3)
    letters = [*(chr(c) for c in range(0x600) if c), "\u0300", "\u0301", "\u0323", "\u2028", "\u3000", "\ufeff", "\u200d", "日", "𝒳", "ﬁ", "가", *" \n\t'stredASDΣς" * 8]
    texts = ["".join(letters[k] for k in random.integers(0, len(letters), 12)) for _ in range(30_000)]
    for text, ids in zip(texts, whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode(text).tolist() == ids.ids, text


def test_pieces_of_latin_words_need_no_rules(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    text = "Über ÉCOLE naïve, don't 12 x=3; ßtraße Œuvre ŉ ſ ıĿŁ... (ÀÖ) señor!? " + "".join(f"{chr(c)}a{chr(c)} B{chr(c)}. " for c in range(0xC0, 0x180) if c not in (0xD7, 0xF7, 0x130))
    own, asked = TextEncoder(path), []
    by_library = own._by_library
    monkeypatch.setattr(own, "_by_library", lambda t: asked.append(t) or by_library(t))
    assert own.encode(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert asked == ["(ÀÖ)"]


def test_another_result_of_the_core_is_not_taken():
    own, whole = (x(public_tokenizers.path("byte_bpe_50k.json")) for x in (TextEncoder, Tokenizer.from_file))

    class Other:
        def encode_to_numpy(self, text, disallowed_special):
            return np.zeros(3, "<u4")

    own.core = Other()
    for _ in range(2):
        assert own.encode("one text").tolist() == whole.encode("one text", add_special_tokens=False).ids


def expected(name, end):
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    return [(i, [*whole.encode(t or "", add_special_tokens=False).ids, end]) for i, t in ROWS]


@pytest.mark.parametrize("bits", [1, 3, 13, 16, 17, 32])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(1).integers(0, 1 << bits, 1001, dtype=np.uint64).astype("<u4")
    data = token_files.packed(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (token_files.unpacked(data, 1001, bits) == ids).all()


def test_token_files(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(i, t, "x") for i, t in ROWS], "doc_id long, text string, ids string").repartition(3)
    folder = f"file://{tmp_path}/files"
    token_files.write_token_files(docs, path, 2, folder)
    rows = token_files.read_token_files(spark, folder).orderBy("start").collect()
    want = expected("word_bpe_49k.json", 2)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 5, 5, 9]
    assert [r.start for r in rows] == list(np.cumsum([0, *(r.n_tokens for r in rows)])[:-1])
    found = sorted((r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in rows)
    assert found == sorted((i or 0, ids) for i, ids in want)


def test_token_file_random_access(tmp_path):
    ids = [np.arange(n, dtype="<u4") % 5000 for n in (3, 0, 40_000, 7)]
    with open(tmp_path / "a.ids", "wb") as sink:
        writer = token_files.Writer(sink, 13)
        for k, x in enumerate(ids):
            writer.add(k, x)
        writer.close()
    with open(tmp_path / "a.ids", "rb") as source:
        reader = token_files.Reader(source)
        for k in (2, 0, 3, 1):
            assert (reader.document(k) == ids[k]).all()


def test_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    token_files.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), 2, f"file://{tmp_path}/none")
    assert token_files.read_token_files(spark, f"file://{tmp_path}/none").count() == 0
    assert packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 0).count() == 0


def test_packing(spark):
    docs = spark.createDataFrame([(i, t, 0) for i, t in ROWS], "doc_id long, text string, start int").repartition(3)
    rows = packing.with_crc(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, 1024)).collect()
    want = expected("byte_bpe_50k.json", 0)
    assert sum(r.length for r in rows) == sum(len(ids) for _, ids in want)
    filled = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, parts in filled.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 1024 or k == max(filled)
    ids = dict((i, x) for i, x in want if i in (3, 9, 1))
    for r in rows:
        if r.doc_id in ids:
            assert r.ids_crc32 == brute.crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])


def test_crc_of_packing_is_that_of_the_ids(spark):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    row = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 0).withColumn("c", F.crc32("ids")).first()
    assert row.c == brute.crc(np.frombuffer(row.ids, "<u4"))
