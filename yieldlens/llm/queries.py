"""Registered queries of the training-data operators, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, divergence, filter_audit, html_text, language_model, line_dedup, packing, quality, shards,
               simhash, token_counts, topk, warc)

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


def op2_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op3_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_html_text(spark, sf_dir):
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


def op5_shards(spark, sf_dir):
    return shards.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op6_topk(spark, sf_dir):
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op7_warc(spark, sf_dir):
    return (warc.pages_through_archives(table(spark, sf_dir, "pages"))
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def op8_line_dedup(spark, sf_dir):
    return (line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")))


def op9_token_counts(spark, sf_dir):
    return token_counts.apply_edits(table(spark, sf_dir, "documents"), token_counts.sample_edits(F.col("text")),
                                    public_tokenizers.path(BYTE_BPE))


def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op11_lm_scores(spark, sf_dir):
    return language_model.score(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_packing, op3_decontamination, op4_html_text, op5_shards, op6_topk,
                                   op7_warc, op8_line_dedup, op9_token_counts, op10_quality, op11_lm_scores,
                                   op12_filter_audit, op13_divergence)}

_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

ORACLES = {
    "op6_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT * FROM v WHERE vec_id % 20 = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM q JOIN v ON q.vec_id <> v.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op7_warc": f"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex),
d AS (
  SELECT p.*, f.first, list_transform(range(8), lambda i: CAST('0x' || substr(p.hex, 5 * i + 1, 5) AS BIGINT)) AS q
  FROM p JOIN f USING (hex))
SELECT page_id, payload_bytes,
       array_to_string(list_transform(q, lambda n:
         substr('{_B32}', ((n >> 15) & 31) + 1, 1) || substr('{_B32}', ((n >> 10) & 31) + 1, 1) ||
         substr('{_B32}', ((n >> 5) & 31) + 1, 1) || substr('{_B32}', (n & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d""",
    "op8_line_dedup": f"""
WITH l AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (
  SELECT *, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT k.*, owner IS NULL OR owner = doc_id AS stays FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (stays), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
    "op12_filter_audit": """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS low FROM d),
m AS (
  SELECT doc_id, part,
         [len(words) < 50,
          100 * len(list_distinct(words)) < 65 * len(words),
          100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
          regexp_matches(t, '[#$%&*|]'),
          coalesce(doc_id > low, false)] AS fails
  FROM w),
l AS (
  SELECT doc_id, coalesce(max(quality), 0) = 1 AS good, coalesce(max(toxic), 0) = 1 AS bad
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
g AS (
  SELECT part, fails, coalesce(good, false) AS good, coalesce(bad, false) AS bad, count(*) AS n
  FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(range(1, 6)) AS f),
o AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS o
  FROM f a JOIN f b ON b.f <> a.f JOIN f c ON c.f NOT IN (a.f, b.f) JOIN f d ON d.f NOT IN (a.f, b.f, c.f)
  JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
s AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
x AS (
  SELECT part, o, step, o[step] AS f, n, good, bad, fails[o[step]] AS own,
         len(list_filter(o[1:step - 1], lambda k: fails[k])) > 0 AS late,
         len(list_filter(fails, lambda k: k)) AS n_fails
  FROM g CROSS JOIN s),
r AS (
  SELECT part, o, step, f,
         sum(CASE WHEN NOT own AND NOT late THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN own AND NOT late THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN own AND late THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN own AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN own AND NOT late AND good THEN n ELSE 0 END) AS good_lost,
         sum(CASE WHEN own AND NOT late AND bad THEN n ELSE 0 END) AS toxic_lost
  FROM x GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda k: substr('ABCDE', k, 1)), '') AS filter_order,
       CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r""",
    "op13_divergence": """
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
w AS (
  SELECT row, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
q AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (total + 2 * v) AS q FROM k JOIN v USING (lang)),
g AS (SELECT DISTINCT lang, source FROM d),
z AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
  FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT lang, source, sum(n) AS total FROM z GROUP BY ALL),
p AS (
  SELECT lang, source, term, n, 1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (s.total + 2 * v) AS p
  FROM z JOIN s USING (lang, source) JOIN v USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN pairs ON pairs.lang = g.lang AND pairs.source = g.source AND pairs.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
         CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM u)
SELECT * FROM r WHERE part = 'pair' OR rank <= 10""",
}
