"""The queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bitsliced, decontamination, jaccard_join, language, licenses, packing, substring, token_files, toxicity, warc
from textloom.llm.shared import table, work_folder


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    warc.register(spark)
    folder = work_folder(spark, "archives")
    warc.records_of(table(spark, sf_dir, "pages"), "page_id", 1000).write.format("warc").mode("append").save(folder)
    found = spark.read.format("warc").option("payload", "verify").load(folder)
    return found.select(warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("refers_to"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "pages"), language.LANGUAGES, other="other")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "bit-sliced")
    vectors = table(spark, sf_dir, "embeddings")
    bitsliced.build_index(vectors, folder, 256)
    return bitsliced.search(spark, folder, vectors.where("vec_id % 50 = 0"), 5, 256)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, folder)
    return token_files.read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), 20_000)
    return scores.select("doc_id", "held_out", "score", "predicted")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0, 1024)
    return packing.with_crc(pieces)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents"), least=50, threshold=0.8)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), n=5, threshold=0.8, recall=0.9999)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_warc": op2_warc,
    "op3_language_id": op3_language_id,
    "op4_exact_topk": op4_exact_topk,
    "op5_license_scan": op5_license_scan,
    "op6_token_files": op6_token_files,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_jaccard_join": op10_jaccard_join,
}

#: A text's words: A-Z to a-z, then what the pattern takes.
def _sql_words(column: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"regexp_extract_all(translate({column}, '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


ORACLE: dict[str, str] = {
    "op1_decontamination": f"""
WITH item AS (SELECT item_id, {_sql_words("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT item_id, unnest(list_transform(range(0, greatest(len(w) - 9, 1)), lambda i: array_to_string(w[i + 1 : i + 10], ' '))) AS k, least(len(w), 10) AS n FROM item WHERE len(w) > 0),
doc AS (SELECT doc_id, coalesce({_sql_words("text")}, []) AS w FROM documents),
place AS (SELECT doc_id, len(w) AS n_words, n, unnest(range(0, len(w) - n + 1)) AS p, w FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT doc_id, p, win.n, item_id FROM place JOIN win ON win.n = place.n AND win.k = array_to_string(w[p + 1 : p + place.n], ' ')),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op2_warc": """
WITH own AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
first AS (SELECT payload_digest, max(page_id) AS first_id FROM own WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
FROM own LEFT JOIN first USING (payload_digest)""",
    "op4_exact_topk": """
WITH own AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
             WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score FROM own a JOIN own b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5""",
}
