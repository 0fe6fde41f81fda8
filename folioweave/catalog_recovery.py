"""Queries of the recovery chain and of page blocks, pages and provider states, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.catalog import ASSIGNED, KINDS, LEVEL, ORDERED, WINDOWED, kinds_of, lines_of, query, quoted
from folioweave.operators import blocks as B
from folioweave.operators import recovery as Y
from folioweave.operators import text as T
from folioweave.session import table
from folioweave.sources import bindings as S


# Window results that disagree: odd windows call a text's first line a title, each fifth line a list, each seventh an item.
def window_results(lines: DataFrame) -> DataFrame:
    odd, n = F.col("w") % 2 == 1, F.col("line_no")
    votes = T.window_votes(lines)
    kind = F.when(n == 1, "title").when(odd & (n % 5 == 0), "list").when((n % 7 == 0) | (n % 7 == 1), "list_item").when(odd & (n % 11 == 0), "paragraph").otherwise(F.col("kind"))
    return votes.select("doc_id", "line_no", "w", kind.alias("kind"), (F.col("starts_new") | (odd & (n % 3 == 0))).alias("starts_new"), F.when(kind == "heading", F.when(odd, F.lit(3)).otherwise(F.col("level"))).alias("level"))


VOTED = WINDOWED + """,
results AS (SELECT doc_id, line_no, w, kind, starts_new OR (w % 2 = 1 AND line_no % 3 = 0) AS starts_new, CASE WHEN kind = 'heading' THEN CASE WHEN w % 2 = 1 THEN 3 ELSE level END END AS level FROM
 (SELECT doc_id, line_no, w, starts_new, level, CASE WHEN line_no = 1 THEN 'title' WHEN w % 2 = 1 AND line_no % 5 = 0 THEN 'list' WHEN line_no % 7 IN (0, 1) THEN 'list_item' WHEN w % 2 = 1 AND line_no % 11 = 0 THEN 'paragraph' ELSE kind END AS kind FROM votes)),
counted AS (SELECT doc_id, line_no, kind, starts_new, level, count(*) AS n, min(w) AS w FROM results GROUP BY ALL),
chosen AS (SELECT doc_id, line_no, text, c.kind, c.starts_new, c.level FROM (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY doc_id, line_no ORDER BY n DESC, w) = 1) c JOIN lines USING (doc_id, line_no))"""
DEMOTED = VOTED + """,
labels_of AS (SELECT *, regexp_replace(text, '^[\\t-\\r\\x1c- \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+|[\\t-\\r\\x1c- \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+$', '', 'g') AS key FROM chosen),
gapped AS (SELECT *, (line_no - lag(line_no) OVER (PARTITION BY doc_id, key ORDER BY line_no) >= 2)::INT AS gap FROM labels_of WHERE key <> '' AND length(key) <= 160 AND kind IN ('title', 'heading', 'paragraph', 'header', 'unknown')),
repeats AS (SELECT doc_id, line_no, count(*) OVER p AS times, sum(gap) OVER p AS gaps, coalesce(min(line_no) FILTER (kind = 'title') OVER p, min(line_no) OVER p) AS keeper FROM gapped WINDOW p AS (PARTITION BY doc_id, key)),
demoted AS (SELECT c.doc_id, c.line_no, c.text, CASE WHEN r.line_no IS NULL THEN kind ELSE 'header' END AS kind, starts_new OR r.line_no IS NOT NULL AS starts_new, CASE WHEN r.line_no IS NULL THEN level END AS level
 FROM chosen c LEFT JOIN (SELECT * FROM repeats WHERE times >= 3 AND gaps >= 2 AND line_no <> keeper) r USING (doc_id, line_no))"""
RECOVERED = DEMOTED + """,
run AS (SELECT *, (starts_new OR coalesce(NOT (lag(kind) OVER o = kind AND lag(level) OVER o IS NOT DISTINCT FROM level AND line_no - lag(line_no) OVER o = 1), true))::INT AS new FROM demoted WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)),
grouped AS (SELECT doc_id, g - 1 AS ord, min(line_no) AS first_line, max(line_no) AS last_line, max(kind) AS kind, max(level) AS level FROM (SELECT *, (sum(new) OVER (PARTITION BY doc_id ORDER BY line_no))::BIGINT AS g FROM run) GROUP BY ALL),
heads AS (SELECT doc_id, ord, coalesce(level, 1) AS level FROM grouped WHERE kind IN ('title', 'heading')),
parents AS (SELECT g.doc_id, g.ord, max(h.ord) AS head FROM grouped g LEFT JOIN heads h ON h.doc_id = g.doc_id AND h.ord < g.ord AND (g.kind NOT IN ('title', 'heading') OR h.level < coalesce(g.level, 1)) GROUP BY ALL),
lists AS (SELECT doc_id, ord, max(CASE WHEN kind = 'list' THEN ord END) OVER p AS listed, max(CASE WHEN kind NOT IN ('list', 'list_item') THEN ord END) OVER p AS closed FROM grouped WINDOW p AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
nodes AS (SELECT g.doc_id, g.ord, g.kind, CASE WHEN g.kind IN ('title', 'heading') THEN coalesce(g.level, 1) END AS level, CASE WHEN g.kind = 'list_item' AND listed > coalesce(closed, -1) THEN listed ELSE head END AS parent, a.start, b.stop, substr(body, (a.start + 1)::BIGINT, (b.stop - a.start)::BIGINT) AS text
 FROM grouped g JOIN parents USING (doc_id, ord) JOIN lists USING (doc_id, ord) JOIN lines a ON a.doc_id = g.doc_id AND a.line_no = g.first_line JOIN lines b ON b.doc_id = g.doc_id AND b.line_no = g.last_line JOIN books ON books.doc_id = g.doc_id)"""


def demoted_of(lines: DataFrame) -> DataFrame:
    chosen = T.assignment_vote(window_results(lines)).drop("votes")
    return T.demoted(chosen.join(lines.select("doc_id", "line_no", "text"), ["doc_id", "line_no"]))


@query(f"WITH {VOTED} SELECT doc_id, line_no, kind, starts_new, level FROM chosen")
def disputed_vote(spark, sf_dir):
    return T.assignment_vote(window_results(lines_of(spark, sf_dir))).drop("votes")


@query(f"WITH {DEMOTED} SELECT doc_id, line_no, kind, starts_new, level FROM demoted")
def demoted_lines(spark, sf_dir):
    return demoted_of(lines_of(spark, sf_dir)).drop("text")


@query(f"WITH {RECOVERED} SELECT doc_id, ord, kind, level, parent, start, stop, sha256(text) AS text_sha256 FROM nodes")
def txt_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of(spark, sf_dir)
    nodes = T.recovered_nodes(T.line_groups(demoted_of(lines)), S.books(spark, sf_dir), lines)
    return nodes.select("doc_id", "ord", "kind", "level", "parent", "start", "stop", F.sha2("text", 256).alias("text_sha256"))


TYPE = "CASE " + " ".join(f"WHEN flat IN ({', '.join(map(quoted, v))}) THEN '{k}'" for k, v in Y.ALIASES.items()) + " WHEN flat = '' THEN 'text' ELSE flat END"


@query(f"""WITH {KINDS}, f AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(lower(trim(CASE line_no % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Page Num' WHEN 2 THEN '  Spread-Sheet ' WHEN 3 THEN '!!' ELSE raw_kind END)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS flat FROM kinds),
g AS (SELECT doc_id, line_no, coalesce(flat, 'text') AS flat FROM f) SELECT doc_id, line_no, {TYPE} AS block_type FROM g""")
def block_types(spark, sf_dir):
    n = F.col("line_no") % 6
    raw = F.when(n == 0, None).when(n == 1, "Page Num").when(n == 2, "  Spread-Sheet ").when(n == 3, "!!").otherwise(F.col("raw_kind"))
    return kinds_of(spark, sf_dir).select("doc_id", "line_no", Y.block_type(raw).alias("block_type"))


TITLE_TEXT = "CASE line_no % 4 WHEN 0 THEN 'PART IV ' || text WHEN 1 THEN '第二章 ' || text WHEN 2 THEN 'Section 12 ' || text ELSE text END"


@query(f"""WITH {KINDS}, t AS (SELECT doc_id, line_no, {TITLE_TEXT} AS text FROM kinds WHERE kind IN ('title', 'heading'))
SELECT doc_id, line_no, CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY line_no) = 1 OR regexp_matches(text, {quoted(Y.LEVEL_ONE)}) THEN 1 WHEN regexp_matches(text, {quoted(Y.LEVEL_TWO)}) THEN 2 ELSE 3 END AS level FROM t""")
def legacy_levels(spark, sf_dir):
    titles = kinds_of(spark, sf_dir).where("kind IN ('title', 'heading')").select("doc_id", "line_no", F.expr(TITLE_TEXT).alias("text"))
    return Y.legacy_levels(titles)


LISTED = "CASE WHEN line_no % 19 = 3 THEN 'list' WHEN line_no % 19 IN (4, 6, 7) THEN 'list_item' ELSE kind END"


@query(f"""WITH {ORDERED}, k AS (SELECT doc_id, line_no, ord, page, {LISTED} AS kind, text FROM ordered),
b AS (SELECT *, CASE WHEN kind = 'title' THEN 1 WHEN kind = 'heading' THEN {LEVEL} END AS level FROM k),
h AS (SELECT b.doc_id, b.ord, max(p.ord) AS head FROM b LEFT JOIN b p ON p.doc_id = b.doc_id AND p.ord < b.ord AND p.kind IN ('title', 'heading') AND (b.kind NOT IN ('title', 'heading') OR p.level < b.level) GROUP BY ALL),
c AS (SELECT b.*, max(CASE WHEN kind = 'list' THEN ord END) OVER p AS listed, max(CASE WHEN kind NOT IN ('list', 'list_item') THEN ord END) OVER p AS closed, max(CASE WHEN kind IN ('figure', 'table') THEN ord END) OVER p AS shown,
 max(CASE WHEN kind NOT IN ('figure', 'table', 'caption') THEN ord END) OVER p AS mid FROM b WINDOW p AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT c.doc_id, c.line_no, c.ord, c.kind, c.level, CASE WHEN c.kind = 'list_item' AND listed > coalesce(closed, -1) THEN listed WHEN c.kind = 'caption' AND v.page = c.page AND shown > coalesce(mid, -1) THEN shown ELSE head END AS parent
FROM c JOIN h USING (doc_id, ord) LEFT JOIN b v ON v.doc_id = c.doc_id AND v.ord = c.shown""")
def block_parents(spark, sf_dir):
    ordered = B.reading_order(kinds_of(spark, sf_dir)).withColumn("kind", F.expr(LISTED))
    level = F.when(F.col("kind") == "title", F.lit(1)).when(F.col("kind") == "heading", T.level_of(F.col("text")))
    return Y.block_parents(ordered.withColumn("level", level))


BOX = ("(doc_id * 7 + line_no * 13) % 1400 - 10 AS x1", "(line_no * 17) % 900 AS y1", "(doc_id * 7 + line_no * 13) % 1400 + 60 AS x2", "(line_no * 17) % 900 + 600 AS y2")


@query(f"WITH {ASSIGNED}, b AS (SELECT doc_id, line_no, {', '.join(BOX)} FROM lines) SELECT *, (x2 > 1200 OR y2 > 1200 OR x1 < -5 OR y1 < -5) AS suspicious FROM b")
def suspicious_boxes(spark, sf_dir):
    return Y.suspicious_boxes(lines_of(spark, sf_dir).selectExpr("doc_id", "line_no", *BOX), 1000, 1000)


@query(f"""WITH {KINDS}, p AS (SELECT *, max(CASE WHEN kind = 'title' THEN bottom END) OVER (PARTITION BY doc_id, page) AS title_end FROM (SELECT doc_id, line_no, page, top, bottom, CASE WHEN line_no % 4 = 0 THEN 'Running head' ELSE text END AS text, CASE WHEN line_no % 50 = 3 THEN 'title' WHEN kind = 'heading' THEN 'title' ELSE kind END AS kind FROM kinds)),
i AS (SELECT *, regexp_replace(regexp_replace(translate(text, '　', ' '), '[ \t\n\r\f\v]+', ' ', 'g'), '^ | $', '', 'g') AS key FROM p WHERE kind IN ('paragraph', 'title') AND bottom <= 1 AND (bottom <= 0.08 OR top >= 0.92)),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS times FROM i WHERE key <> '')
SELECT doc_id, line_no, times, (((top + bottom) / 2 < 0.18 OR (top + bottom) / 2 > 0.82) AND NOT coalesce(title_end > 0 AND top >= title_end, false) AND times >= 2) AS goes FROM n""")
def band_removals(spark, sf_dir):
    n = F.col("line_no")
    k = kinds_of(spark, sf_dir).withColumn("text", F.when(n % 4 == 0, "Running head").otherwise(F.col("text"))).withColumn("kind", F.when(n % 50 == 3, "title").when(F.col("kind") == "heading", "title").otherwise(F.col("kind")))
    return Y.band_removals(k)


PAGES = (
    "l_orderkey AS doc_id",
    "l_linenumber * 2 - l_partkey % 2 AS page_number",
    "l_linenumber * 2 - l_partkey % 2 - CASE WHEN l_suppkey % 9 = 0 THEN 2 ELSE 1 END AS page_index",
    "l_linenumber * 2 - l_partkey % 2 - 1 - CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE 0 END AS local_page_index",
    "1 AS range_start",
    "10 + l_suppkey % 5 - CASE WHEN l_partkey % 31 = 0 THEN 20 ELSE 0 END AS range_end",
)


@query(f"""WITH p AS (SELECT {', '.join(PAGES)} FROM lineitem),
w AS (SELECT doc_id, page_number, CASE WHEN page_number < 1 OR page_index < 0 OR local_page_index < 0 OR range_start < 1 OR range_end < range_start THEN 'invalid_range' WHEN page_index <> page_number - 1 THEN 'index_mismatch' WHEN page_number < range_start OR page_number > range_end THEN 'outside_range' WHEN local_page_index <> page_number - range_start THEN 'local_mismatch' END AS issue FROM p),
e AS (SELECT DISTINCT doc_id, unnest(range(range_start, range_end + 1)) AS page_number FROM p WHERE range_end >= range_start)
SELECT * FROM w WHERE issue IS NOT NULL UNION ALL SELECT doc_id, page_number, 'duplicate_page' FROM p GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT doc_id, page_number, 'missing_page' FROM e ANTI JOIN p USING (doc_id, page_number)""")
def page_map(spark, sf_dir):
    numbers = ("page_number", "page_index", "local_page_index", "range_start", "range_end")
    return Y.page_map(table(spark, sf_dir, "lineitem").selectExpr(*PAGES).select("doc_id", *(F.col(c).cast("long").alias(c) for c in numbers)))


@query("""WITH j AS (SELECT event_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'partial_failed' ELSE 'lost' END AS status, user_id % 9 - 1 AS done, CASE WHEN user_id % 4 > 0 THEN user_id % 11 - 1 END AS total FROM events)
SELECT *, CASE status WHEN 'queued' THEN 'queued' WHEN 'running' THEN 'running' WHEN 'completed' THEN 'provider_completed' WHEN 'partial_failed' THEN 'provider_partial_failed' WHEN 'failed' THEN 'failed' END AS state, status IN ('completed', 'partial_failed', 'failed', 'expired') AS is_final, (status = 'lost' OR coalesce(done, 0) < 0 OR coalesce(total, 0) < 0) AS malformed FROM j""")
def provider_states(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").selectExpr("event_id", "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'partial_failed' ELSE 'lost' END AS status", "user_id % 9 - 1 AS done", "CASE WHEN user_id % 4 > 0 THEN user_id % 11 - 1 END AS total")
    return Y.provider_states(jobs)
