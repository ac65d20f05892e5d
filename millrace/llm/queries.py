"""The thin queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, langid, licenses, packing, quality, secrets, simhash, suffix_dedup, token_counts, topk
from millrace.llm.common import table, texts


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def fold(n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # a row without an id is in no fold: nothing is learned from it
    model = langid.train(docs.filter(fold(4) != 2).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"))
    return langid.identify(docs, model).select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(texts(docs), labels.filter(fold(5) != 0).select(F.col("doc_id").cast("long").alias("doc_id"), "quality"))
    return quality.score_quality(docs, model).select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.find_secrets(docs, secrets.train(texts(docs))).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_scored", "n_cnn", "n_added")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


_OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

_OP7 = """
WITH low AS (
  SELECT doc_id, row_number() OVER () AS d,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
  FROM items, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS u(i)
  WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT d, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM low, sizes, unnest(generate_series(1, len(w) - n + 1)) AS u(i)
), hits AS (SELECT d, i, n, item_id FROM places JOIN windows USING (n, win)),
words AS (
  SELECT d, count(DISTINCT i + k) AS n_hit
  FROM (SELECT DISTINCT d, i, n FROM hits), unnest(generate_series(0, n - 1)) AS u(k) GROUP BY d
), found AS (
  SELECT d, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT d, item_id FROM hits) GROUP BY d
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM low LEFT JOIN words USING (d) LEFT JOIN found USING (d)
"""

_OP5 = """
WITH t AS (SELECT row_number() OVER () AS d, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (
  SELECT d, doc_id, i, substr(x, 2 * i + 1, 100) AS s
  FROM t, unnest(generate_series(0, CAST(len(x) / 2 AS BIGINT) - 50)) AS u(i)
),
f AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s HAVING count(*) > 1),
r AS (SELECT d, i FROM w JOIN f USING (s) WHERE low < doc_id OR (doc_id IS NULL AND low IS NOT NULL)),
g AS (SELECT d, i, CASE WHEN i - lag(i) OVER (PARTITION BY d ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM r),
n AS (SELECT d, i, sum(new) OVER (PARTITION BY d ORDER BY i) AS k FROM g),
spans AS (SELECT d, k, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY d, k),
kept AS (
  SELECT d, a AS upto, coalesce(lag(b) OVER (PARTITION BY d ORDER BY a), 0) AS since FROM spans
  UNION ALL
  SELECT t.d, CAST(len(t.x) / 2 AS BIGINT), coalesce(max(b), 0) FROM t LEFT JOIN spans USING (d) GROUP BY t.d, t.x
),
out AS (SELECT kept.d, string_agg(substr(x, 2 * since + 1, 2 * (upto - since)), '' ORDER BY since) AS h FROM kept JOIN t USING (d) GROUP BY kept.d)
SELECT t.doc_id, CAST(len(t.x) / 2 AS BIGINT) AS n_bytes, CAST((len(t.x) - len(coalesce(out.h, ''))) / 2 AS BIGINT) AS n_removed,
       (SELECT count(*) FROM spans WHERE spans.d = t.d) AS n_spans, sha256(unhex(coalesce(out.h, ''))) AS kept_sha256
FROM t LEFT JOIN out USING (d)
"""

ORACLES: dict[str, str] = {"op4_exact_top_k": _OP4, "op5_suffix_dedup": _OP5, "op7_decontamination": _OP7}


def oracle_sql() -> dict[str, str]:
    return ORACLES
