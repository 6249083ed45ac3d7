import math
import random
import zlib

import numpy as np

from tests.conftest import SF
from textloom.llm import language, toxicity

random = random.Random(11)


def test_language_by_hand(spark):
    texts = {"en": "the cat is in the house with all of the dogs and ", "fr": "le chat est dans la maison avec tous les chiens et ", "de": "die katze ist in dem haus mit allen hunden und "}
    pages = []
    for k in range(120):
        lang = ("en", "fr", "de")[k % 3]
        words = texts[lang].split()
        random.shuffle(words)
        mark = f' lang="{lang}-XX"' if k % 5 else ""
        pages.append((k, f"https://{lang}{k % 4}.site.{'com' if lang == 'en' else lang}:80/p/{k}", f"<html{mark}><head><script>the the the</script></head><body><p>{' '.join(words * 3)}</p></body></html>"))
    pages += [(900, None, None), (901, "https://fr1.site.fr/x", None), (902, "nonsense", "<html></html>"), (903, "http://unknown.xx/", '<html lang="de">'), (903, "http://unknown.xx/", '<html lang="de">')]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, host string").repartition(3)
    rows = language.identified(df, ("de", "en", "fr")).collect()
    assert len(rows) == len(pages)
    found = {r.page_id: r for r in rows}
    assert all(found[k].language == ("en", "fr", "de")[k % 3] for k in range(120))
    assert found[901].language == "fr" and found[903].language == "de" and found[900].text_language is None
    assert all(1 / 3 <= r.posterior <= 1 + 1e-12 for r in rows)
    assert language.identified(df.limit(0), ("de", "en")).count() == 0


def test_language_posterior_is_the_formula(spark):
    rows = [(0, "http://a.b.com/", None, "de"), (1, "http://a.b.com/", None, None)]
    page = lambda lang, word: f'<html lang="{lang}"><p>{word * 40}</p></html>' if lang else f"<html><p>{word * 40}</p></html>"
    pages = [(k, f"http://h{k % 2}.b.com/", page(("de", "en")[k % 2], ("ach ", "the ")[k % 2])) for k in range(20)]
    df = spark.createDataFrame(pages + [(r[0] + 100, r[1], r[2]) for r in rows], "page_id long, url string, html string")
    found = {r.page_id: r for r in language.identified(df, ("de", "en"), strength=20.0).collect()}
    share = (10 + 1) / (20 + 2)
    assert math.isclose(share, 0.5) and math.isclose(found[100].posterior, 0.5) and found[100].language == "de"


def fused(rows, languages, strength):
    """The fusion in plain Python: rows of page_id, declared, suffix, domain, host, text, said."""
    counts = lambda key, value: [sum(r.said == x and (key is None or r[key] == value) for r in rows) for x in languages]
    totals, size = counts(None, None), len(languages)
    n, out = sum(totals), []
    whole = [(c + 1) / (n + size) for c in totals]
    drawn = lambda own, above: [(c + strength * p) / (sum(own) + strength) for c, p in zip(own, above)]

    def likelihood(key, value):
        own = counts(key, value)
        if value is None or not sum(own):
            return [0.0] * size
        share = (sum(own) + 1) / (n + 1)
        return [math.log((c + strength * share) / (t + strength)) for c, t in zip(own, totals)]

    for r in rows:
        prior = drawn(counts("host", r.host), drawn(counts("domain", r.domain), whole))
        sums = [t + math.log(p) + d + s for t, p, d, s in zip(r.text, prior, likelihood("declared", r.declared), likelihood("suffix", r.suffix or None))]
        weights = [math.exp(x - max(sums)) for x in sums]
        out.append((r.page_id, r.host, languages[sums.index(max(sums))], 1 / sum(weights)))
    return out


def test_language_fusion_is_that_of_plain_python(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").limit(150)
    odd = [(9001, None, None), (9002, "http://x.co.uk/a", '<html lang="xx"><p>日本語の文章がここにあります。とても長い文章です。</p>'), (9003, "http://y.co.uk", "<p>the cat and the dog of the house</p>"), (9003, "http://y.co.uk", None), (9004, "nonsense", '<html lang="fr">')]
    df = pages.unionByName(spark.createDataFrame(odd, "page_id long, url string, html string"))
    languages = (*language.LANGUAGES, "other")
    evidence = language.text_evidence(df, language.trained(df, languages, "other"), languages, 30, "other").collect()
    want = sorted(fused(evidence, languages, 20.0))
    got = sorted((r.page_id, r.host, r.language, r.posterior) for r in language.identified(df, other="other").collect())
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(math.isclose(a[3], b[3], rel_tol=1e-9) for a, b in zip(got, want))
    assert {x[2] for x in got if x[0] == 9002} == {"other"}


def test_registered_names():
    assert [language.domain_of(h) for h in ("a.b.example.co.uk", "www.example.com", "com.br", "x.com.br", "host", "")] == ["example.co.uk", "example.com", "com.br", "x.com.br", "host", ""]


def test_trigram_counts_and_restored_words(spark):
    docs = spark.createDataFrame([(1, "stupid idiot moron scum trash pathetic worthless loser man and"), (2, None), (3, "")], "doc_id long, text string")
    counts = toxicity.trigram_counts(docs)
    text = "  stupid idiot moron scum trash pathetic worthless loser man and  "
    code = lambda c: toxicity.LETTERS.index(c) + 1 if c in toxicity.LETTERS else 0
    brute = {}
    for t in (text, "    ", "    "):
        for a, b, c in zip(t, t[1:], t[2:]):
            k = (code(a) * toxicity.SIZE + code(b)) * toxicity.SIZE + code(c)
            brute[k] = brute.get(k, 0) + 1
    assert counts == brute
    decoder = toxicity.Decoder(counts)
    for raw, clean in (("1d10t", "idiot"), ("m0r0n", "moron"), ("s t u p i d", "stupid"), ("s-t-u-p-i-d", "stupid"), ("$cum", "scum"), ("tr@sh", "trash"), ("p4th3tic", "pathetic"), ("looooser", "loser")):
        assert decoder.restored(f"man {raw} and") == f"man {clean} and"
    assert decoder.restored(None) == "" and decoder.restored("Plain Text") == "plain text"


def viterbi_by_force(decoder, span):
    paths = [("", 0.0)]
    for options in decoder.lattice(span):
        paths = [(t + s, c + e) for t, c in paths for s, e in options]

    def whole(text, cost):
        state = 0
        for ch in text + " ":
            step = state * toxicity.SIZE + (toxicity.LETTERS.index(ch) + 1 if ch in toxicity.LETTERS else 0)
            cost, state = cost + decoder.cost(step), step % toxicity.SIZE**2
        return cost

    return min((whole(t, c), t) for t, c in paths)[1]


def test_viterbi_finds_the_best_path(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    decoder = toxicity.Decoder(toxicity.trigram_counts(docs))
    for span in ("1d10t", "4ppl3$", "b00ook", "h3ll000", "$t@r7s", "s.t.u.p"):
        assert decoder.decoded(span) == viterbi_by_force(decoder, span)


def test_toxicity_learns_from_the_other_folds_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = {r.doc_id: r for r in toxicity.scored(docs, labels).select("doc_id", "held_out", "score", "predicted").collect()}
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    changed = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(CAST(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    again = {r.doc_id: r.score for r in toxicity.scored(docs, changed).select("doc_id", "score").collect()}
    assert all(again[i] == r.score for i, r in rows.items())
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(rows[i].predicted, t) for i, t in truth.items() if rows[i].held_out]
    assert sum(p and not t for p, t in held) <= 2


def test_toxicity_of_odd_tables(spark):
    words = ["idiot", "scum", "moron"]
    good = [(i, f"a kind word about the weather {i % 7}", "x") for i in range(60)]
    bad = [(100 + i, f"you {words[i % 3]} go away {i % 5}", "y") for i in range(30)]
    docs = spark.createDataFrame(good + bad + [(500, None, "z"), (501, "", "z"), (None, "you 1d10t", "z"), (502, "YOU M0R0N " * 3000, "z"), (502, "fine", "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 0) for i, *_ in good] + [(i, 1) for i, *_ in bad] + [(999, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity.scored(docs.drop("score"), labels).collect()
    assert len(rows) == docs.count()
    assert all(r.predicted == 1 for r in rows if r.doc_id and 100 <= r.doc_id < 130)
    assert all(r.predicted == 0 for r in rows if r.doc_id in (500, 501) or r.doc_id is not None and r.doc_id < 60)
    assert len({r.score for r in rows if r.doc_id in (500, 501)}) == 1
    assert all(r.held_out for r in rows if r.doc_id is None)
    flat = toxicity.scored(docs.drop("score"), labels.limit(0)).collect()
    assert len({r.score for r in flat}) == 1 and flat[0].predicted == 0
    assert toxicity.scored(docs.limit(0), labels).count() == 0
    left = toxicity.clean(docs, labels)
    assert left.columns == docs.columns and {r.score for r in left.collect()} <= {"x", "z"}


def test_logistic_regression_separates():
    w, b = toxicity.logistic([[0], [0], [], [1], []] * 20, np.array([1, 1, 0, 0, 0] * 20, float), 2)
    assert b < 0 < w[0] + b and w[1] < w[0]
