"""Named queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import common, decontaminate, html_text, lbl, mtree, near, pii, quality, token_counts, trie_bpe, warc

#: the vocabulary that the token queries use
TOKENIZER = corpus_pipeline.TOKENIZER
CONTEXT_LIMIT = 2048
GOOD = corpus_pipeline.GOOD


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document; a cache of its own, so that each run counts all."""
    cache = f"{common.shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    out = token_counts.token_counts(common.read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), cache)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > CONTEXT_LIMIT).alias("over_limit"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labels outside the held-out fold."""
    docs = common.read(spark, sf_dir, "documents")
    model = quality.train(docs, common.read(spark, sf_dir, "labels"), common.fold("doc_id", 4) != 2)
    return quality.score(docs, model).select("doc_id", F.coalesce(common.fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans, and with them disclosing terms."""
    found = pii.spans(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of the ids and of the decoded text."""
    return trie_bpe.digests(common.read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and each benchmark item that it holds."""
    return decontaminate.hits(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best neighbours of each vector whose id 20 divides."""
    return mtree.top_k(common.read(spark, sf_dir, "embeddings"), 20, F.col("id") % 20 == 0)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(common.read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and unigram scores of every document, learnt outside the held-out fold."""
    held_out = common.fold("doc_id", 7) == 2
    out = lbl.scores(common.read(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near duplicates that each document belongs to."""
    return near.components(common.read(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives, read back and assembled into captures."""
    path = f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(common.read(spark, sf_dir, "pages"), path)
    return warc.captures(spark, path, with_payload=False).select(
        F.col("page_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("record.kind").alias("record_type"),
        F.col("refers_to_page").cast("long").alias("refers_to"),
    )


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) AND a.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""


OP7_SQL = """
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT r, doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS g FROM w
), e AS (
  SELECT r, len(g) AS n, unnest(g) AS x FROM s
), p AS (
  SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.x = b.x AND a.r <> b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), c(r, m) AS (
  SELECT r, r FROM s UNION SELECT p.b, c.m FROM c JOIN p ON p.a = c.r
)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE (SELECT min(t.doc_id) FROM c JOIN s t ON t.r = c.m WHERE c.r = s.r) END AS component_id
FROM s
"""

OP8_SQL = """
WITH h AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages
), d AS (
  SELECT page_id, payload_bytes, translate(
      to_base(CAST('0x' || substr(x, 1, 10) AS BIGINT), 32, 8) || to_base(CAST('0x' || substr(x, 11, 10) AS BIGINT), 32, 8)
        || to_base(CAST('0x' || substr(x, 21, 10) AS BIGINT), 32, 8) || to_base(CAST('0x' || substr(x, 31, 10) AS BIGINT), 32, 8),
      '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
  FROM h
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CAST(CASE WHEN page_id IS DISTINCT FROM top THEN top END AS BIGINT) AS refers_to
FROM m
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_pii": op2_pii,
        "op3_bpe": op3_bpe,
        "op4_html_text": op4_html_text,
        "op5_token_counts": op5_token_counts,
        "op6_lm_scores": op6_lm_scores,
        "op7_near_duplicates": op7_near_duplicates,
        "op8_warc": op8_warc,
        "op9_decontaminate": op9_decontaminate,
        "op10_top_k": op10_top_k,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_near_duplicates": OP7_SQL, "op8_warc": OP8_SQL, "op10_top_k": OP10_SQL}
