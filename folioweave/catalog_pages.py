"""Queries of provider results, text layers, captions, page reviews, covers, markers and selections, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.catalog import FLAT, KINDS, LINES, kinds_of, lines_of, query, quoted
from folioweave.operators import pages as W
from folioweave.session import prepare, table
from folioweave.streaming import state as X

# Provider results as JSON: pages of 25 lines, blocks in reverse order of documents with odd ids, one rule broken in some.
BLOCK_SQL = """raw AS (SELECT doc_id, line_no, text, (line_no - 1) // 25 + 1 AS page_number, (line_no - 1) % 25 AS row, row_number() OVER (PARTITION BY doc_id, (line_no - 1) // 25 ORDER BY line_no) - 1 AS place FROM lines WHERE text <> ''),
made AS (SELECT *, CASE WHEN doc_id % 2 = 1 THEN 1000 - line_no END AS given, CASE WHEN doc_id % 9 = 4 AND line_no = 1 THEN 1.5::DOUBLE ELSE (line_no % 100) / 100.0::DOUBLE END AS confidence, 100 + 8 * least(100, length(text)) + CASE WHEN doc_id % 9 = 3 AND line_no = 1 THEN 1000 ELSE 0 END AS right_,
 CASE line_no % 5 WHEN 0 THEN 'Title' WHEN 1 THEN ' TEXT ' WHEN 2 THEN '' ELSE 'figure' END AS type FROM raw),
judged AS (SELECT doc_id, page_number, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY coalesce(given, place), place) - 1 AS ord, CASE WHEN type = '' THEN 'unknown' ELSE lower(trim(type)) END AS kind, text, confidence, 0.1::DOUBLE AS l, (row * 80) / 2000.0::DOUBLE AS top, right_ / 1000.0::DOUBLE AS r, (row * 80 + 80) / 2000.0::DOUBLE AS bottom,
 CASE WHEN doc_id % 9 = 2 AND page_number = 1 THEN 'page_index' WHEN doc_id % 9 = 5 AND page_number = 1 THEN 'page_range' WHEN doc_id % 9 = 6 AND page_number = 1 THEN 'dimensions' WHEN confidence > 1 THEN 'confidence' WHEN right_ > 1000 THEN 'bbox' END AS issue FROM made)"""


def provider_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, d = F.col("line_no"), F.col("doc_id") % 9
    lines = lines_of(spark, sf_dir).where("text <> ''").withColumn("page", F.expr("(line_no - 1) div 25 + 1"))
    box = F.array(F.lit(100), (n - 1) % 25 * 80, 100 + 8 * F.least(F.lit(100), F.length("text")) + F.when((d == 3) & (n == 1), 1000).otherwise(0), (n - 1) % 25 * 80 + 80).cast("array<double>")
    kind = F.when(n % 5 == 0, "Title").when(n % 5 == 1, " TEXT ").when(n % 5 == 2, "").otherwise("figure")
    block = F.struct("line_no", kind.alias("type"), "text", F.when((d == 4) & (n == 1), 1.5).otherwise((n % 100).cast("double") / 100).alias("confidence"), F.when(F.col("doc_id") % 2 == 1, 1000 - n).alias("order"), box.alias("bbox"))
    pages = lines.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    first = F.col("page") == 1
    page = F.struct(F.col("page").alias("page_number"), (F.col("page") - F.when((d == 2) & first, 2).otherwise(1)).alias("page_index"), F.struct(F.when((d == 5) & first, 2).otherwise(1).alias("page_start"), F.lit(100_000).alias("page_end")).alias("source_page_range"), F.lit(1000).alias("width"), F.when((d == 6) & first, 0).otherwise(2000).alias("height"), "blocks")
    return pages.groupBy("doc_id").agg(F.to_json(F.collect_list(page)).alias("raw_result"))


@query(f"WITH {LINES}, {BLOCK_SQL} SELECT doc_id, page_number, ord, kind, sha256(text) AS text_sha256, confidence, l, top, r, bottom FROM judged WHERE doc_id NOT IN (SELECT doc_id FROM judged WHERE issue IS NOT NULL)")
def provider_blocks(spark, sf_dir):
    good = W.provider_blocks(provider_results(spark, sf_dir)).where("accepted")
    return good.select("doc_id", "page_number", "ord", "kind", F.sha2("text", 256).alias("text_sha256"), "confidence", "l", "top", "r", "bottom")


@query(f"WITH {LINES}, {BLOCK_SQL} SELECT doc_id, issue, count(*) AS n FROM judged WHERE issue IS NOT NULL GROUP BY ALL")
def provider_rejects(spark, sf_dir):
    return W.provider_blocks(provider_results(spark, sf_dir)).where("issue IS NOT NULL").groupBy("doc_id", "issue").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LINES} SELECT doc_id, line_no, CASE WHEN line_no % 11 IN (3, 7) THEN NULL WHEN line_no % 6 = 0 THEN NULL ELSE 'figure title' END AS kind, CASE WHEN line_no % 11 IN (3, 7) OR line_no % 6 = 0 THEN NULL ELSE [1.0::DOUBLE, line_no, 20.5::DOUBLE, line_no + 3] END AS bbox, CASE WHEN line_no % 11 IN (3, 7) OR line_no % 6 = 0 THEN NULL ELSE 0.25::DOUBLE END AS confidence,
CASE WHEN line_no % 11 IN (3, 7) THEN NULL WHEN line_no % 6 = 0 THEN 'plain ' || line_no || chr(10) || 'more' ELSE 'first ' || line_no || chr(10) || chr(10) || '  second' END AS text, CASE line_no % 11 WHEN 3 THEN 'bbox' WHEN 7 THEN 'confidence' END AS error FROM lines""")
def provider_entries(spark, sf_dir):
    n = F.col("line_no")
    whole = F.concat(F.lit("####\nLabel: figure title \nbbox: [1, "), n, F.lit(", 20.5 "), n + 3, F.lit("]\nscore: 0.25\ncontent: first "), n, F.lit("\n\n  second\n###\nblock id: 7\nleft out"))
    broken = F.when(n % 11 == 3, "bbox: 1, 2, three, 4").when(n % 11 == 7, "score: high")
    entry = F.coalesce(broken, F.when(n % 6 == 0, F.concat(F.lit("plain "), n, F.lit("\n##\nmore"))), whole)
    return W.parsed_entries(lines_of(prepare(spark), sf_dir).select("doc_id", "line_no", entry.alias("entry"))).select("doc_id", "line_no", "parsed.*")


@query("""SELECT page_id, CASE WHEN page_id % 10 IN (0, 1) THEN 'invalid_evidence' WHEN page_id % 10 = 2 THEN 'inline' WHEN html IS NULL THEN 'invalid_evidence' WHEN page_id % 10 = 3 THEN 'size_mismatch' WHEN page_id % 10 = 4 THEN 'checksum_mismatch' ELSE 'artifact' END AS outcome FROM pages""")
def artifact_outcomes(spark, sf_dir):
    k, b = F.col("page_id") % 10, F.col("html").cast("binary")
    rows = table(spark, sf_dir, "pages").select("page_id", F.when(k.isin(0, 2), "{}").alias("inline"), F.when(~k.isin(1, 2), b).alias("content"), F.when(k == 3, F.octet_length(b) + 1).when(k == 5, None).otherwise(F.octet_length(b)).alias("size"), F.when(k == 4, "00").when(k == 6, None).otherwise(F.upper(F.sha2(b, 256))).alias("sha256"))
    return W.artifacts(rows).select("page_id", "outcome")


LAYER = "CASE doc_id % 12 WHEN 1 THEN coalesce(text, '') || repeat(chr(1) || chr(9) || 'x' || chr(10), 40) WHEN 2 THEN coalesce(text, '') || chr(65533) WHEN 3 THEN repeat(chr(8203), 60) || coalesce(text, '') ELSE text END"


@query(f"""WITH t AS (SELECT doc_id, (doc_id % 11) / 10.0::DOUBLE AS coverage, coalesce({LAYER}, '') AS t FROM documents),
l AS (SELECT *, greatest(1, length(t)) AS n, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '[ \\t\\n\\r\\f\\v]+', '', 'g')), lambda x: x <> '') AS ls FROM t),
m AS (SELECT doc_id, coverage, length(regexp_replace(t, '[ \\t\\n\\r\\f\\v]+', '', 'g')) AS chars, len(ls) AS lines, CASE WHEN t = '' THEN 0 ELSE round(1 - (length(t) - length(regexp_replace(replace(replace(replace(t, ' ', 'x'), chr(10), 'x'), chr(9), 'x'), '[\\p{{Cc}}\\p{{Cf}}\\p{{Co}}\\p{{Cs}}\\p{{Z}}]', '', 'g'))) / n::DOUBLE, 6) END AS printable,
 CASE WHEN t = '' THEN 1 ELSE round((length(t) - length(regexp_replace(t, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'))) / n::DOUBLE, 6) END AS control, length(t) - length(replace(t, chr(65533), '')) AS replaced, round((len(ls) - len(list_distinct(ls))) / greatest(1, len(ls))::DOUBLE, 6) AS repeated FROM l)
SELECT *, CASE WHEN chars < 120 THEN 'too_sparse' WHEN lines < 4 THEN 'line_count_too_low' WHEN coverage > 0.8::DOUBLE THEN 'image_dominates' WHEN printable < 0.98::DOUBLE THEN 'printability_failed' WHEN control > 0.01::DOUBLE THEN 'control_characters_failed' WHEN replaced > 0 THEN 'replacement_characters_failed' WHEN repeated > 0.25 THEN 'duplicate_lines_failed' ELSE 'accepted' END AS reason FROM m""")
def text_health(spark, sf_dir):
    extra = F.when(F.col("doc_id") % 12 == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("\x01\tx\n" * 40))).when(F.col("doc_id") % 12 == 2, F.concat(F.coalesce("text", F.lit("")), F.lit("\ufffd"))).when(F.col("doc_id") % 12 == 3, F.concat(F.lit("\u200b" * 60), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    return W.text_health(table(spark, sf_dir, "documents").select("doc_id", extra.alias("text"), ((F.col("doc_id") % 11).cast("double") / 10).alias("coverage")))


LEADS = ("图 3：", "表IV", "Figure 12. ", "Tableau 1", "注：", "NOTE: ", "注意 ", "remark﹕", "table\u30007", "  Fig. 2", "")
LEAD = "CASE line_no % 11 " + " ".join(f"WHEN {i} THEN {quoted(x)}" for i, x in enumerate(LEADS)) + " END"


@query(f"""WITH {KINDS}, t AS (SELECT doc_id, line_no, kind, {LEAD} || text AS text FROM kinds), f AS (SELECT doc_id, line_no, kind, {FLAT} AS flat FROM t)
SELECT doc_id, line_no, kind = 'caption' OR regexp_matches(flat, {quoted(W.CAPTION_CJK)}) OR regexp_matches(flat, {quoted(W.CAPTION_EN)}) OR regexp_matches(flat, {quoted(W.NOTE)}) AS atomic FROM f""")
def captions_and_notes(spark, sf_dir):
    k = kinds_of(spark, sf_dir)
    lead = F.lit(None).cast("string")
    for i, x in enumerate(LEADS):
        lead = F.when(F.col("line_no") % len(LEADS) == i, x).otherwise(lead)
    return k.select("doc_id", "line_no", W.caption_or_note(F.concat(lead, F.col("text")), F.col("kind")).alias("atomic"))


REVIEW_NODES = "doc_id, page, kind, CASE WHEN line_no % 23 = 0 THEN 'degraded' ELSE 'complete' END AS state, CASE WHEN line_no % 67 = 5 THEN 2 END AS toc_level, raw_kind AS observed_kind, CASE WHEN line_no % 41 = 7 THEN 'An Overview of it' ELSE text END AS text"


@query(f"""WITH {KINDS}, n AS (SELECT {REVIEW_NODES} FROM kinds), o AS (SELECT doc_id, page, CASE WHEN line_no % 53 = 9 THEN 'Table_Of_Contents' ELSE raw_kind END AS observed_kind, confidence FROM kinds),
e AS (SELECT DISTINCT doc_id, page, min(page) OVER (PARTITION BY doc_id) AS a, max(page) OVER (PARTITION BY doc_id) AS b FROM kinds),
r AS (SELECT doc_id, page, 'first_page' AS reason FROM e WHERE page = a UNION SELECT doc_id, page, 'last_page' FROM e WHERE page = b UNION SELECT doc_id, page, 'heading_candidate_page' FROM n WHERE kind IN ('title', 'heading') UNION SELECT doc_id, page, 'unknown_node_page' FROM n WHERE kind = 'unknown'
 UNION SELECT doc_id, page, 'degraded_node_page' FROM n WHERE state = 'degraded' UNION SELECT doc_id, page, 'toc_page' FROM n WHERE toc_level IS NOT NULL UNION SELECT doc_id, page, 'summary_page' FROM n WHERE regexp_matches(lower(observed_kind), 'abstract|summary|overview') OR regexp_matches(lower(text), '摘要|概要|abstract|summary|overview')
 UNION SELECT doc_id, page, 'low_ocr_confidence_page' FROM o WHERE confidence < 0.8::DOUBLE UNION SELECT doc_id, page, 'heading_candidate_page' FROM o WHERE regexp_matches(lower(observed_kind), 'title|heading') UNION SELECT doc_id, page, 'toc_page' FROM o WHERE regexp_matches(lower(observed_kind), 'toc|table_of_contents') UNION SELECT doc_id, page, 'summary_page' FROM o WHERE regexp_matches(lower(observed_kind), 'abstract|summary|overview')),
p AS (SELECT doc_id, page, string_agg(reason, ',' ORDER BY reason) AS reasons, min(list_position(['first_page', 'last_page', 'toc_page', 'summary_page', 'heading_candidate_page', 'unknown_node_page', 'degraded_node_page', 'low_ocr_confidence_page'], reason) - 1)::INT AS priority FROM r GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority, page) - 1 AS place FROM p""")
def review_pages(spark, sf_dir):
    k = kinds_of(spark, sf_dir)
    nodes = k.select(F.expr(f"struct({REVIEW_NODES})").alias("x")).select("x.*")
    seen = k.select("doc_id", "page", F.when(F.col("line_no") % 53 == 9, "Table_Of_Contents").otherwise(F.col("raw_kind")).alias("observed_kind"), "confidence")
    return W.review_pages(nodes, seen)


@query(f"""WITH {KINDS}, n AS (SELECT doc_id, page, CASE WHEN doc_id % 3 = 0 AND line_no > 1 THEN 'figure' WHEN line_no % 5 = 4 THEN 'footer' ELSE kind END AS kind, CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 9) ELSE text END AS text FROM kinds WHERE doc_id % 3 > 0 OR line_no < 9),
a AS (SELECT doc_id, count(*) AS n, sum(length(trim(text))) AS chars, max((kind IN ('title', 'heading'))::INT) AS heads, max((kind IN ('paragraph', 'list', 'list_item', 'table', 'formula', 'code', 'quote', 'reference'))::INT) AS bad FROM n WHERE page = 0 AND kind NOT IN ('header', 'footer', 'footnote') GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 7 IN (1, 2) THEN true WHEN doc_id % 7 = 3 THEN false ELSE n <= 8 AND bad = 0 AND chars <= 160 AND heads = 1 END AS is_cover FROM a""")
def reviewed_covers(spark, sf_dir):
    n, d = F.col("line_no"), F.col("doc_id")
    k = kinds_of(spark, sf_dir).where((d % 3 > 0) | (n < 9))
    nodes = k.select("doc_id", "page", F.when((d % 3 == 0) & (n > 1), "figure").when(n % 5 == 4, "footer").otherwise(F.col("kind")).alias("kind"), F.when(d % 3 == 0, F.substring("text", 1, 9)).otherwise(F.col("text")).alias("text"))
    # Of several reviews the most confident counts; those under the limit do not.
    made = F.expr("CASE doc_id % 7 WHEN 1 THEN array(struct('cover' AS role, 0.9D AS confidence), struct('body' AS role, 0.86D AS confidence)) WHEN 2 THEN array(struct('cover' AS role, 0.85D AS confidence)) WHEN 3 THEN array(struct('body' AS role, 0.95D AS confidence), struct('cover' AS role, 0.9D AS confidence)) WHEN 4 THEN array(struct('cover' AS role, 0.84D AS confidence)) WHEN 5 THEN array(struct('full_page_figure' AS role, 0.99D AS confidence)) END")
    reviews = k.select("doc_id").distinct().select("doc_id", F.lit(0).alias("page"), F.explode(made).alias("v")).select("doc_id", "page", "v.role", "v.confidence")
    return W.covers(nodes, reviews)


@query("""SELECT page_id, regexp_replace(trim(url), '[^\\p{L}\\p{N}._-]', '-', 'g') AS token, repeat('#', least(6, greatest(1, page_id % 9 - 1))::INT) || ' ' || trim(url) AS heading, '$%$%$%' || page_id || '$%$%$%' AS image FROM pages""")
def markers(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", W.safe_token(F.col("url")).alias("token"), W.heading_marker(F.col("url"), (F.col("page_id") % 9 - 1).cast("int")).alias("heading"), W.image_marker(F.col("page_id").cast("string")).alias("image"))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, json_extract_string(props, '$.k')::BIGINT % 5 AS expected, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT event_id, user_id, i, coalesce(expected = 0, false) AS accepted, coalesce(expected = 0, false)::BIGINT AS version FROM e WHERE i = 1
 UNION ALL SELECT e.event_id, e.user_id, e.i, coalesce(e.expected = f.version % 5, false), f.version + coalesce(e.expected = f.version % 5, false)::BIGINT FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT event_id, user_id, accepted, version FROM f""")
def selection_events(spark, sf_dir):
    return X.selection_events(table(prepare(spark), sf_dir, "events"))
