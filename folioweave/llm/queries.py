"""The queries of this subpackage: thin layers that apply each operator to its whole table and derive the digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.llm import bpe, packing, quality_classifier, quality_rules, secrets, sharding, simhash, topk, toxicity, warc
from folioweave.session import prepare, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "source", "text")
    judged = quality_rules.verdicts(quality_rules.with_facts(docs).drop("text"))
    return judged.select("doc_id", *(F.col("facts")[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")), "kept")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(prepare(spark), sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held = toxicity.held_out("doc_id", 5, 0)
    model = toxicity.fit(docs, labels, ~held)
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(prepare(spark), sf_dir, "pages")
    records = warc.round_trip(pages, with_payload=False)
    return records.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    coded = bpe.encode_decode(docs, vocabulary("byte_bpe_50k.json"))
    return coded.select(F.col("key").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    found, name = secrets.with_spans(docs)
    joined = lambda part: F.array_join(F.transform(F.col(name)[part], lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(F.col(name)["base"], lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    packed = packing.pack(docs, vocabulary("word_bpe_49k.json"), with_ids=False)
    return packed.select(F.col("key").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(prepare(spark), sf_dir, "documents"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(prepare(spark), sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    dealt = sharding.shard(docs)
    return dealt.select("doc_id", sharding.row_bytes("text").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(prepare(spark), sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held = toxicity.held_out("doc_id", 3, 1)
    model = quality_classifier.fit(docs, labels, ~held)
    return quality_classifier.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_toxicity, op3_warc, op4_bpe, op5_secret_scans, op6_packing, op7_simhash, op8_exact_top_k, op9_sharding, op10_quality_classifier)}


OP1_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS words FROM documents),
win AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
pos AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
lines AS (SELECT r, count(*) AS n_lines, count(DISTINCT line) AS n_distinct FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]') GROUP BY r),
f AS (SELECT w.r, doc_id, source, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_lines - n_distinct, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM w LEFT JOIN pos USING (r) LEFT JOIN lines USING (r)),
x AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, (100 * n_symbols > 25 * n_words OR 100 * n_dup_lines > 70 * n_lines) AS lenient,
  (100 * n_symbols > 10 * n_words)::INT AS s1, (100 * n_dup_lines > 30 * n_lines)::INT AS s2, (100 * n_repeat_words > 20 * n_words)::INT AS s3 FROM f),
h AS (SELECT source, count(*) AS n, sum(s1) AS k1, sum(s2) AS k2, sum(s3) AS k3 FROM x GROUP BY source),
m AS (SELECT count(*) AS hs, sum(n)::DOUBLE AS ds, sum(n * n::DOUBLE) AS sq, sum(k1)::DOUBLE AS t1, sum(k1 * (k1 / n)) AS q1, sum(k2)::DOUBLE AS t2, sum(k2 * (k2 / n)) AS q2, sum(k3)::DOUBLE AS t3, sum(k3 * (k3 / n)) AS q3 FROM h),
b AS (SELECT hs, ds, (ds - sq / ds) / (hs - 1) AS size, t1 / ds AS m1, (q1 - t1 / ds * t1) / (hs - 1) AS b1, (t1 - q1) / (ds - hs) AS w1, t2 / ds AS m2, (q2 - t2 / ds * t2) / (hs - 1) AS b2, (t2 - q2) / (ds - hs) AS w2, t3 / ds AS m3, (q3 - t3 / ds * t3) / (hs - 1) AS b3, (t3 - q3) / (ds - hs) AS w3 FROM m),
p AS (SELECT m1, m2, m3, CASE WHEN hs < 2 OR ds = hs OR b1 <= w1 THEN 1e6 ELSE least(1e6, greatest(2, size * w1 / (b1 - w1))) END AS c1, CASE WHEN hs < 2 OR ds = hs OR b2 <= w2 THEN 1e6 ELSE least(1e6, greatest(2, size * w2 / (b2 - w2))) END AS c2, CASE WHEN hs < 2 OR ds = hs OR b3 <= w3 THEN 1e6 ELSE least(1e6, greatest(2, size * w3 / (b3 - w3))) END AS c3 FROM b),
v AS (SELECT source, greatest((k1 + m1 * c1) / (n + c1), (k2 + m2 * c2) / (n + c2), (k3 + m3 * c3) / (n + c3)) > 0.5 AS suspect FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT lenient AND NOT (suspect AND s1 + s2 + s3 > 0)) AS kept
FROM x JOIN v ON x.source IS NOT DISTINCT FROM v.source
"""

OP3_SQL = """
WITH h AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS x FROM pages),
g AS (SELECT page_id, strlen(t)::BIGINT AS payload_bytes, x, max(page_id) OVER (PARTITION BY x) AS top, count(*) OVER (PARTITION BY x) AS n FROM h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(x || '0', 1 + (5 * i // 4)::INT, 2))::INT >> (3 - 5 * i % 4)::INT) & 31)::INT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM top OR top IS NULL OR n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM top OR n = 1 THEN NULL ELSE top END AS refers_to
FROM g
"""

OP8_SQL = """
WITH q AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, CASE WHEN len(a.v) = 0 THEN 0 ELSE list_inner_product(a.v, b.v)::BIGINT END AS score FROM q a JOIN q b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE a.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op3_warc": OP3_SQL, "op8_exact_top_k": OP8_SQL}
