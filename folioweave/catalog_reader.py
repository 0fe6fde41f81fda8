"""Queries of reader states, chunks and counts, scopes, splits, fragments and polls, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.catalog import GROUPS, KINDS, NODES, groups_of, kinds_of, lines_of, query, quoted
from folioweave.operators import graph as G
from folioweave.operators import reader as D
from folioweave.operators import text as T
from folioweave.session import table

# Fixed value: the end of a line of contents.
LINE_END = r"(?:[.．·]{2,}|…+)\s*[（(]?\s*\d{1,4}\s*[）)]?\s*$"
UNIT_OF = "CASE WHEN doc_id % 5 = 0 THEN 'no_usable_semantic_content' WHEN doc_id % 7 = 0 THEN 'unavailable' WHEN doc_id % 3 = 0 OR page % 3 = 1 THEN 'complete' WHEN page % 3 = 2 THEN 'degraded' ELSE 'unavailable' END"


@query(f"""WITH {KINDS}, u AS (SELECT DISTINCT doc_id, page, {UNIT_OF} AS state FROM kinds), c AS (SELECT doc_id, count(*) AS units, count(*) FILTER (state = 'complete') AS n_complete, count(*) FILTER (state = 'degraded') AS n_degraded, count(*) FILTER (state = 'no_usable_semantic_content') AS n_no_usable_semantic_content, count(*) FILTER (state = 'unavailable') AS n_unavailable FROM u GROUP BY doc_id)
SELECT *, CASE WHEN n_no_usable_semantic_content = units THEN 'no_usable_semantic_content' WHEN n_unavailable = units THEN 'unavailable' WHEN n_complete = units THEN 'ready' ELSE 'degraded' END AS state FROM c""")
def document_states(spark, sf_dir):
    return D.document_states(kinds_of(spark, sf_dir).select("doc_id", "page", F.expr(UNIT_OF).alias("state")).distinct())


STATED = "CASE line_no % 5 WHEN 0 THEN 'complete' WHEN 1 THEN 'degraded' WHEN 2 THEN 'recovered' WHEN 3 THEN 'unavailable' END"
CODED = "CASE line_no % 4 WHEN 0 THEN 'asset_missing' WHEN 1 THEN 'Page_Unavailable' WHEN 2 THEN 'text_missing' ELSE 'low_quality' END"


@query(f"""WITH {KINDS} SELECT doc_id, line_no, CASE {STATED} WHEN 'complete' THEN 'ready' WHEN 'degraded' THEN 'degraded' WHEN 'recovered' THEN 'degraded' WHEN 'unavailable' THEN 'unavailable' END AS state, CASE WHEN upper({CODED}) LIKE '%ASSET%' THEN 'asset_unavailable' WHEN upper({CODED}) LIKE '%UNAVAILABLE%' OR upper({CODED}) LIKE '%MISSING%' THEN 'content_unavailable' ELSE 'content_degraded' END AS warning FROM kinds""")
def node_states(spark, sf_dir):
    return kinds_of(spark, sf_dir).select("doc_id", "line_no", D.mapped(F.expr(STATED), D.NODE_STATES).alias("state"), D.warning_code(F.expr(CODED)).alias("warning"))


@query(f"""WITH {KINDS}, p AS (SELECT DISTINCT doc_id, page, 'p' || page AS location FROM kinds WHERE page % 4 <> 2), r AS (SELECT *, row_number() OVER w AS place FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
a AS (SELECT doc_id, page AS next_page, location AS next_location FROM r WHERE place = 2) SELECT doc_id, page, location, next_page IS NOT NULL AS has_more, next_page, next_location FROM r LEFT JOIN a USING (doc_id) WHERE place <= 1""")
def page_chunk(spark, sf_dir):
    pages = kinds_of(spark, sf_dir).where("page % 4 <> 2").select("doc_id", "page", F.concat(F.lit("p"), "page").alias("location")).distinct()
    return D.page_chunk(pages, 0, 1)


@query(f"""WITH {KINDS}, b AS (SELECT doc_id, page, CASE kind WHEN 'figure' THEN 'image' WHEN 'table' THEN 'table' WHEN 'paragraph' THEN 'text' ELSE kind END AS type, text AS content FROM kinds)
SELECT doc_id, count(DISTINCT page) AS pages, count(*) FILTER (type = 'text') AS text_blocks, count(*) FILTER (type IN ('image', 'table')) AS image_blocks, coalesce(sum(length(content)) FILTER (type = 'text'), 0)::BIGINT AS characters FROM b GROUP BY doc_id""")
def book_status(spark, sf_dir):
    kind = F.when(F.col("kind") == "figure", "image").when(F.col("kind") == "paragraph", "text").otherwise(F.col("kind"))
    return D.book_status(kinds_of(spark, sf_dir).select("doc_id", "page", kind.alias("type"), F.col("text").alias("content")))


# Nodes with the units (of two lines) and observations (lines) that they lie on.
PLACED = GROUPS + """,
seen AS (SELECT doc_id, 'o' || line_no AS observation, (line_no - 1) // 2 AS unit, text, line_no FROM lines WHERE text <> ''),
held AS (SELECT n.doc_id, n.group_no, s.observation, s.unit, s.text, row_number() OVER (PARTITION BY n.doc_id, n.group_no ORDER BY s.line_no) - 1 AS place FROM numbered n JOIN seen s USING (doc_id, line_no))"""


def placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = lines_of(spark, sf_dir).where("text <> ''")
    seen = lines.select("doc_id", F.concat(F.lit("o"), "line_no").alias("observation"), F.expr("(line_no - 1) div 2").alias("unit"), "text", F.array(F.concat(F.lit("e"), "line_no")).alias("evidences"))
    span = F.sequence("first_line", "last_line")
    nodes = groups_of(spark, sf_dir).select("doc_id", F.col("group_no").alias("node"), F.array_distinct(F.transform(span, lambda x: F.floor((x - 1) / 2))).alias("units"), F.transform(span, lambda x: F.concat(F.lit("o"), x)).alias("observations"), F.array(F.concat(F.lit("e"), "first_line")).alias("evidences"))
    return nodes, seen


@query(f"WITH {PLACED} SELECT doc_id, group_no AS node, place, unit, text FROM held WHERE (doc_id, group_no) IN (SELECT (doc_id, group_no) FROM held GROUP BY doc_id, group_no HAVING count(DISTINCT unit) > 1)")
def cross_page_fragments(spark, sf_dir):
    return D.fragments(*placed(spark, sf_dir))


@query(f"""WITH {PLACED}, s AS (SELECT doc_id, observation, 'e' || line_no AS evidence FROM seen WHERE unit % 2 = 0), n AS (SELECT doc_id, group_no, count(DISTINCT unit) FILTER (unit % 2 = 0) AS units, count(*) FILTER (unit % 2 = 0) AS observations, 'e' || min(line_no) AS evidence FROM (SELECT h.*, substr(observation, 2)::BIGINT AS line_no FROM held h) GROUP BY ALL),
e AS (SELECT doc_id, evidence FROM s UNION SELECT doc_id, evidence FROM n WHERE units > 0)
SELECT doc_id, 'node ' || group_no AS item, units::BIGINT AS units, observations FROM n WHERE units > 0 UNION ALL SELECT doc_id, observation, NULL, NULL FROM s UNION ALL SELECT doc_id, evidence, NULL, NULL FROM e""")
def scoped_graph(spark, sf_dir):
    nodes, seen = placed(spark, sf_dir)
    evidence = seen.select("doc_id", F.concat(F.lit("e"), F.substring("observation", 2, 20)).alias("evidence"), "unit", "observation")
    units = seen.where("unit % 2 = 0").select("doc_id", "unit").distinct()
    here, watched, known = D.scoped(nodes, seen, evidence, units)
    none = F.lit(None).cast("long")
    out = here.select("doc_id", F.concat(F.lit("node "), "node").alias("item"), F.size("units").cast("long").alias("units"), F.size("observations").cast("long").alias("observations"))
    return out.unionByName(watched.select("doc_id", F.col("observation").alias("item"), none.alias("units"), none.alias("observations"))).unionByName(known.select("doc_id", F.col("evidence").alias("item"), none.alias("units"), none.alias("observations")))


BLOCKED = NODES + """,
given AS (SELECT doc_id, node, ord, parent_node, CASE WHEN ord % 3 = 0 THEN 'unknown' ELSE kind END AS kind, CASE WHEN ord % 4 = 1 THEN 'degraded' ELSE 'complete' END AS state,
 CASE ord % 5 WHEN 0 THEN 'One .... 3' || chr(10) || ' ' || chr(10) || '  Two …… (12) ' WHEN 1 THEN 'One ··7' || chr(10) || 'Two' WHEN 2 THEN 'Only .. 4' WHEN 3 THEN 'A ..1' || chr(10) || 'B ..2' || chr(10) || 'C ．．3' ELSE repeat('x', 250) || '..1' || chr(10) || 'B ..2' END AS text, 0.25::DOUBLE AS top, CASE WHEN ord % 7 = 0 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END AS bottom FROM nodes)"""


@query(f"""WITH {BLOCKED}, l AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls, (doc_id, node) IN (SELECT (doc_id, parent_node) FROM given WHERE parent_node IS NOT NULL) AS is_parent FROM given),
f AS (SELECT *, (kind = 'unknown' OR state = 'degraded') AND NOT is_parent AND len(ls) >= 2 AND len(list_filter(ls, lambda x: length(x) > 240 OR NOT regexp_matches(x, {quoted(LINE_END)}))) = 0 AS fits FROM l),
x AS (SELECT *, unnest(range(0, CASE WHEN fits THEN len(ls) ELSE 1 END)) AS i FROM f)
SELECT doc_id, CASE WHEN fits THEN node || ':toc-line:' || lpad((i + 1)::VARCHAR, 3, '0') ELSE node END AS node, row_number() OVER (PARTITION BY doc_id ORDER BY ord, node, i) - 1 AS ord, parent_node, CASE WHEN fits THEN 'unknown' ELSE kind END AS kind, CASE WHEN fits THEN 'degraded' ELSE state END AS state, CASE WHEN fits THEN ls[i + 1] ELSE text END AS text,
 CASE WHEN fits AND bottom > top THEN top + (bottom - top) / len(ls) * i ELSE top END AS top, CASE WHEN fits AND bottom > top AND i < len(ls) - 1 THEN top + (bottom - top) / len(ls) * (i + 1) ELSE bottom END AS bottom FROM x""")
def contents_presplit(spark, sf_dir):
    o = F.col("ord")
    n = G.nodes(T.heading_tree(groups_of(spark, sf_dir)))
    made = F.when(o % 5 == 0, "One .... 3\n \n  Two …… (12) ").when(o % 5 == 1, "One ··7\nTwo").when(o % 5 == 2, "Only .. 4").when(o % 5 == 3, "A ..1\nB ..2\nC ．．3").otherwise("x" * 250 + "..1\nB ..2")
    given = n.select("doc_id", "node", "ord", "parent_node", F.when(o % 3 == 0, "unknown").otherwise(F.col("kind")).alias("kind"), F.when(o % 4 == 1, "degraded").otherwise("complete").alias("state"), made.alias("text"), F.lit(0.25).alias("top"), F.when(o % 7 == 0, 0.25).otherwise(0.75).alias("bottom"))
    return D.presplit(given, LINE_END)


@query("""WITH RECURSIVE t AS (SELECT 0.0::DOUBLE AS due, 2.0::DOUBLE AS step, 1 AS k UNION ALL SELECT due + least(step, 1800 - due), least(step * 1.5::DOUBLE, 10), k + 1 FROM t WHERE due + least(step, 1800 - due) < 1800),
j AS (SELECT o_orderkey AS job, (o_custkey * 7 % 2400)::DOUBLE AS done, CASE o_custkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'expired' ELSE 'completed' END AS status FROM orders), f AS (SELECT j.job, min(k) AS k FROM j JOIN t ON t.due >= j.done GROUP BY j.job)
SELECT j.job, coalesce(f.k, (SELECT max(k) FROM t))::BIGINT AS polls, coalesce(t.due, (SELECT max(due) FROM t)) AS last_poll, CASE WHEN f.k IS NULL THEN 'timed_out' ELSE status END AS outcome FROM j LEFT JOIN f USING (job) LEFT JOIN t ON t.k = f.k""")
def polled_jobs(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS job", "cast(o_custkey * 7 % 2400 AS double) AS done", "CASE o_custkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'expired' ELSE 'completed' END AS status")
    return D.polled(jobs, D.poll_times(2.0, 1.5, 10.0, 1800.0))
