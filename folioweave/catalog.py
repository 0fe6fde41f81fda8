"""All queries over the driver's tables, by name, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioweave.operators import assembly as A
from folioweave.operators import blocks as B
from folioweave.operators import graph as G
from folioweave.operators import refine as R
from folioweave.operators import review as V
from folioweave.operators import text as T
from folioweave.session import prepare, table
from folioweave.sources import bindings as S
from folioweave.sources import payloads as P
from folioweave.streaming import state as X

FLAGSHIP = "line_groups"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.line_index(S.books(spark, sf_dir))


def groups_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.line_groups(T.assignments(lines_of(spark, sf_dir)))


def kinds_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.semantic_kind(S.blocks(lines_of(spark, sf_dir)))


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# Common table expressions of the oracles.
LINES = S.BOOKS_SQL + r""",
cut AS (SELECT doc_id, string_split_regex(body, '\r\n|\r|\n') AS t, regexp_extract_all(body, '\r\n|\r|\n') AS s FROM books),
idx AS (SELECT doc_id, unnest(range(1, len(t) + 1)) AS line_no, t, s FROM cut),
lines AS (SELECT doc_id, line_no, text, sep_end - size AS start, sep_end - size + length(text) AS stop, sep_end FROM (SELECT *, (sum(size) OVER (PARTITION BY doc_id ORDER BY line_no))::BIGINT AS sep_end FROM
 (SELECT doc_id, line_no::BIGINT AS line_no, t[line_no] AS text, length(t[line_no]) + coalesce(length(s[line_no]), 0) AS size FROM idx)))"""
NUMBER = f"regexp_extract(text, {quoted(T.HEADING)}, 1)"
LEVEL = f"(CASE WHEN regexp_matches(text, {quoted(T.CHAPTER)}) THEN 1 WHEN {NUMBER} <> '' THEN least(length({NUMBER}) - length(replace({NUMBER}, '.', '')) + 1, 6) ELSE 2 END)::INT"
ASSIGNED = LINES + f""",
kinded AS (SELECT doc_id, line_no, text, CASE WHEN regexp_matches(text, {quoted(T.HEADING)}) OR regexp_matches(text, {quoted(T.CHAPTER)}) THEN 'heading' WHEN regexp_matches(text, {quoted(T.CAPTION)}) THEN 'caption' WHEN regexp_matches(text, {quoted(T.LIST_ITEM)}) THEN 'list_item' ELSE 'paragraph' END AS kind,
 coalesce(regexp_matches(lag(text) OVER (PARTITION BY doc_id ORDER BY line_no), {quoted(T.TERMINAL)}), true) AS after FROM lines),
assigned AS (SELECT doc_id, line_no, text, kind, (kind <> 'paragraph' OR after) AS starts_new, CASE WHEN kind = 'heading' THEN {LEVEL} END AS level FROM kinded WHERE text <> '')"""
WINDOWED = ASSIGNED + """,
win AS (SELECT doc_id, line_no, text, unnest(range(greatest(0, ceil((line_no - 80) / 68.0)::BIGINT), least((line_no - 1) // 68, last) + 1)) AS w FROM (SELECT *, greatest(0, ceil((max(line_no) OVER (PARTITION BY doc_id) - 80) / 68.0)::BIGINT) AS last FROM lines)),
votes AS (SELECT doc_id, line_no, w, kind, starts_new OR line_no = first AS starts_new, level FROM (SELECT doc_id, line_no, w, min(line_no) OVER (PARTITION BY doc_id, w) AS first FROM win WHERE text <> '') JOIN assigned USING (doc_id, line_no))"""
GROUPS = ASSIGNED + """,
flagged AS (SELECT *, (starts_new OR coalesce(NOT (lag(kind) OVER o IS NOT DISTINCT FROM kind AND lag(level) OVER o IS NOT DISTINCT FROM level AND line_no - lag(line_no) OVER o = 1), true))::INT AS new FROM assigned WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)),
numbered AS (SELECT *, (sum(new) OVER (PARTITION BY doc_id ORDER BY line_no))::BIGINT AS group_no FROM flagged),
groups AS (SELECT doc_id, group_no, min(line_no) AS first_line, max(line_no) AS last_line, max(kind) AS kind, max(level) AS level FROM numbered GROUP BY doc_id, group_no)"""
TREE = GROUPS + """,
tree AS (SELECT g.doc_id, g.group_no, g.kind, g.level, max(p.group_no) AS parent FROM groups g LEFT JOIN groups p ON g.doc_id = p.doc_id AND p.group_no < g.group_no AND p.kind = 'heading' AND (g.kind <> 'heading' OR p.level < g.level) GROUP BY ALL)"""
NODES = TREE + """,
nodes AS (SELECT doc_id, 'n_' || substr(sha256(doc_id || chr(31) || group_no), 1, 24) AS node, CASE WHEN parent IS NOT NULL THEN 'n_' || substr(sha256(doc_id || chr(31) || parent), 1, 24) END AS parent_node, kind, level, group_no AS ord FROM tree)"""
PATHS = TREE.replace("books AS", "RECURSIVE books AS", 1) + """,
walk AS (SELECT doc_id, group_no, [group_no] AS path FROM tree WHERE parent IS NULL UNION ALL SELECT t.doc_id, t.group_no, list_append(w.path, t.group_no) FROM tree t JOIN walk w ON t.doc_id = w.doc_id AND t.parent = w.group_no),
placed AS (SELECT doc_id, group_no, (len(path) - 1)::BIGINT AS depth, row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS node_order FROM walk)"""
LABEL = "translate(lower(trim(raw_kind)), ' -', '__')"
KIND = "CASE " + " ".join(f"WHEN {LABEL} IN ({', '.join(quoted(x) for x in v.split())}) THEN '{k}'" for k, v in B.KINDS.items()) + " ELSE 'unknown' END"
KINDS = LINES + ",\n" + S.BLOCKS_SQL + f""",
kinds AS (SELECT *, {KIND} AS kind, {LABEL} IN ({', '.join(map(quoted, B.FURNITURE))}) AS furniture FROM blocks)"""
ORDERED = KINDS + """,
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, top, line_no) - 1 AS ord FROM kinds WHERE NOT furniture)"""
FLAT = r"regexp_replace(regexp_replace(translate(text, '　', ' '), '[ \t\n\r\f\v]+', ' ', 'g'), '^ | $', '', 'g')"


@query(f"WITH {LINES} SELECT doc_id, line_no, start, stop, sep_end, text FROM lines")
def line_index(spark, sf_dir):
    return lines_of(spark, sf_dir).select("doc_id", "line_no", "start", "stop", "sep_end", "text")


@query(f"""WITH RECURSIVE {LINES},
fold AS (SELECT doc_id, line_no, 1::BIGINT AS unit, line_no AS first, start AS begin, sep_end FROM lines WHERE line_no = 1
 UNION ALL SELECT l.doc_id, l.line_no, CASE WHEN l.line_no - f.first >= {T.UNIT_LINES} OR l.sep_end - f.begin > {T.UNIT_CHARS} THEN f.unit + 1 ELSE f.unit END, CASE WHEN l.line_no - f.first >= {T.UNIT_LINES} OR l.sep_end - f.begin > {T.UNIT_CHARS} THEN l.line_no ELSE f.first END,
 CASE WHEN l.line_no - f.first >= {T.UNIT_LINES} OR l.sep_end - f.begin > {T.UNIT_CHARS} THEN l.start ELSE f.begin END, l.sep_end FROM fold f JOIN lines l ON l.doc_id = f.doc_id AND l.line_no = f.line_no + 1)
SELECT doc_id, unit, min(line_no) AS first_line, max(line_no) AS last_line, max(sep_end) - min(begin) AS chars FROM fold GROUP BY doc_id, unit""")
def source_units(spark, sf_dir):
    return T.source_units(lines_of(spark, sf_dir))


@query(f"WITH {LINES} SELECT doc_id, printf('L%06d', line_no) AS line_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS obs_order, text FROM lines WHERE text <> ''")
def observations(spark, sf_dir):
    return T.observations(lines_of(spark, sf_dir))


@query(f"WITH {WINDOWED} SELECT doc_id, line_no, w FROM win")
def line_windows(spark, sf_dir):
    return T.line_windows(lines_of(spark, sf_dir)).select("doc_id", "line_no", "w")


@query(f"WITH {ASSIGNED} SELECT doc_id, line_no, kind, starts_new, level FROM assigned")
def line_assignments(spark, sf_dir):
    return T.assignments(lines_of(spark, sf_dir)).drop("text")


@query(f"""WITH {WINDOWED}, counted AS (SELECT doc_id, line_no, kind, starts_new, level, count(*) AS votes, min(w) AS w FROM votes GROUP BY ALL)
SELECT doc_id, line_no, kind, starts_new, level, votes FROM counted QUALIFY row_number() OVER (PARTITION BY doc_id, line_no ORDER BY votes DESC, w) = 1""")
def assignment_vote(spark, sf_dir):
    return T.assignment_vote(T.window_votes(lines_of(spark, sf_dir)))


@query(f"""WITH {WINDOWED}, per AS (SELECT doc_id, line_no, sum(n - 1) AS twice FROM (SELECT doc_id, line_no, w, count(*) AS n FROM votes GROUP BY ALL) GROUP BY ALL)
SELECT doc_id, count(*) AS n_lines, count(twice) AS n_covered, sum((twice IS NULL)::INT)::BIGINT AS n_missing, coalesce(sum(twice), 0)::BIGINT AS n_twice FROM (SELECT * FROM lines WHERE text <> '') LEFT JOIN per USING (doc_id, line_no) GROUP BY doc_id""")
def window_coverage(spark, sf_dir):
    lines = lines_of(spark, sf_dir)
    return T.window_coverage(lines, T.window_votes(lines))


@query(f"""WITH {ASSIGNED}, k AS (SELECT *, trim(text) AS key FROM assigned WHERE length(trim(text)) <= 160 AND kind IN ('heading', 'paragraph')),
g AS (SELECT *, (line_no - lag(line_no) OVER (PARTITION BY doc_id, key ORDER BY line_no) >= 2)::INT AS gap FROM k),
a AS (SELECT doc_id, line_no, key, count(*) OVER p AS times, sum(gap) OVER p AS gaps, min(line_no) OVER p AS keeper FROM g WINDOW p AS (PARTITION BY doc_id, key))
SELECT doc_id, line_no, key, times, keeper FROM a WHERE times >= 3 AND gaps >= 2 AND line_no <> keeper""")
def running_headers(spark, sf_dir):
    return T.running_headers(T.assignments(lines_of(spark, sf_dir)))


@query(f"WITH {GROUPS} SELECT * FROM groups")
def line_groups(spark, sf_dir):
    return groups_of(spark, sf_dir)


@query(f"WITH {TREE} SELECT * FROM tree")
def heading_tree(spark, sf_dir):
    return T.heading_tree(groups_of(spark, sf_dir))


@query(f"""WITH {LINES}, f AS (SELECT doc_id, line_no, {FLAT} AS flat FROM lines)
SELECT doc_id, line_no, flat, regexp_matches(flat, {quoted(T.TERMINAL)}) AS terminal, regexp_matches(flat, {quoted(T.HEADING_LIKE)}) AS heading_like, regexp_matches(flat, {quoted(T.CAPTION)}) AS caption, regexp_matches(flat, {quoted(T.TOC_LINE)}) AS toc_line FROM f""")
def text_flags(spark, sf_dir):
    return T.text_flags(lines_of(spark, sf_dir))


@query(r"""SELECT doc_id, length(t)::BIGINT AS chars, sha256(t) AS sha, regexp_matches(t, '[\x00-\x08\x0B-\x1F]') AS rejected FROM (SELECT doc_id, regexp_replace(text, '\r\n|\r', chr(10), 'g') AS t FROM documents)""")
def normalized_text(spark, sf_dir):
    return T.normalize_text(table(spark, sf_dir, "documents"), "text")


@query(f"WITH {KINDS} SELECT doc_id, line_no, kind, furniture FROM kinds")
def semantic_kind(spark, sf_dir):
    return kinds_of(spark, sf_dir).select("doc_id", "line_no", "kind", "furniture")


@query(f"WITH {ORDERED} SELECT doc_id, line_no, page, ord FROM ordered")
def reading_order(spark, sf_dir):
    return B.reading_order(kinds_of(spark, sf_dir)).select("doc_id", "line_no", "page", "ord")


@query(f"WITH {KINDS} SELECT doc_id, line_no, kind, CASE WHEN kind = 'title' THEN 1 ELSE {LEVEL} END AS level FROM kinds WHERE kind IN ('title', 'heading')")
def heading_levels(spark, sf_dir):
    return B.heading_levels(kinds_of(spark, sf_dir))


TOC_BODY = "h || ' ..... ' || (1 + doc_id % 300) || chr(10) || chr(10) || 'Part ' || (doc_id % 7) || '  ' || (2 + doc_id % 300) || chr(10) || 'plain'"


@query(f"""WITH {S.BOOKS_SQL}, b AS (SELECT doc_id, string_split(body, chr(10))[1] AS h FROM books), x AS (SELECT doc_id, {TOC_BODY} AS body FROM b),
l AS (SELECT doc_id, list_filter(list_transform(string_split(body, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS ls FROM x),
k AS (SELECT * FROM l WHERE len(list_filter(ls, lambda s: regexp_matches(s, {quoted(T.TOC_LINE)}))) >= 2)
SELECT doc_id, printf('toc:%04d', i) AS item_id, ls[i] AS item FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM k)""")
def toc_items(spark, sf_dir):
    head = S.books(spark, sf_dir).select("doc_id", F.split("body", "\n")[0].alias("h"))
    body = F.concat("h", F.lit(" ..... "), 1 + F.col("doc_id") % 300, F.lit("\n\nPart "), F.col("doc_id") % 7, F.lit("  "), 2 + F.col("doc_id") % 300, F.lit("\nplain"))
    return B.toc_items(head.select("doc_id", body.alias("body")), "body")


PX = "greatest(0, least(1000, round_even({} * 1000, 0)::INT))"


@query(f"""WITH {KINDS}, b AS (SELECT doc_id, line_no, raw_kind, confidence, {PX.format('l')} AS x1, {PX.format('top')} AS y1, {PX.format('r')} AS x2, {PX.format('bottom')} AS y2 FROM kinds)
SELECT doc_id, line_no, x1, y1, x2, y2, (least(x2 - x1, y2 - y1) >= CASE WHEN {LABEL} IN ('figure', 'table') THEN 12 ELSE 8 END AND confidence >= 0.5) AS passes, (y2 <= 80 OR y1 >= 920) AS in_band FROM b""")
def boxes(spark, sf_dir):
    return B.boxes(kinds_of(spark, sf_dir))


@query(f"""WITH {KINDS}, c AS (SELECT doc_id, page, line_no AS cap, top AS ct, bottom AS cb, l AS cl, r AS cr, CASE WHEN starts_with({LABEL}, 'table') THEN 'table' ELSE 'figure' END AS wants FROM kinds WHERE kind = 'caption'),
v AS (SELECT doc_id, page, line_no AS visual, kind AS wants, top, bottom, l, r FROM kinds WHERE kind IN ('figure', 'table')),
p AS (SELECT doc_id, cap, visual, greatest(0, ct - bottom, top - cb) AS gap, greatest(0, least(cr, r) - greatest(cl, l)) / greatest(1e-9, least(cr - cl, r - l)) AS overlap, abs((cl + cr) / 2 - (l + r) / 2) AS center FROM c JOIN v USING (doc_id, page, wants)),
s AS (SELECT doc_id, cap, visual, round(gap + 0.35 * center + 0.05 * (1 - least(1.0, overlap)), 6) AS score FROM p WHERE gap <= 0.18 AND (overlap >= 0.40 OR center <= 0.16)),
o AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY doc_id, cap ORDER BY score, visual))
SELECT doc_id, cap, visual, score, coalesce(nxt - score < 0.025, false) AS ambiguous FROM o WHERE place = 1""")
def caption_join(spark, sf_dir):
    return B.caption_join(kinds_of(spark, sf_dir))


@query(f"""WITH {ORDERED}, f AS (SELECT doc_id, line_no, kind, text, page, top, lag(kind) OVER o AS pk, lag(text) OVER o AS pt, lag(page) OVER o AS pp, lag(bottom) OVER o AS pb, lag(line_no) OVER o AS pl FROM ordered WINDOW o AS (PARTITION BY doc_id ORDER BY ord))
SELECT doc_id, line_no, pl AS prev_line, pt || CASE WHEN regexp_matches(right(pt, 1), '[一-鿿]') OR regexp_matches(left(text, 1), '[一-鿿]') THEN '' ELSE ' ' END || text AS joined FROM f
WHERE kind = 'paragraph' AND pk = 'paragraph' AND page = pp + 1 AND pb >= 0.82 AND top <= 0.18 AND NOT regexp_matches(pt, {quoted(B.SENTENCE_END)})""")
def para_merge(spark, sf_dir):
    return B.para_merge(B.reading_order(kinds_of(spark, sf_dir)))


@query(f"""WITH {KINDS}, i AS (SELECT doc_id, line_no, {FLAT} AS key FROM kinds WHERE bottom <= 0.08 OR top >= 0.92)
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS times FROM i WHERE key <> '') WHERE times >= 2""")
def header_footer(spark, sf_dir):
    return B.repeated_band_text(kinds_of(spark, sf_dir))


@query(f"""WITH {LINES}, p AS (SELECT doc_id, text, count(*) AS n FROM lines WHERE trim(text) <> '' GROUP BY ALL), a AS (SELECT doc_id, sum(length(text) * n)::BIGINT AS chars, sum(n)::BIGINT AS lines, sum(n - 1) AS dup, sum(contains(text, chr(65533))::INT) AS bad FROM p GROUP BY doc_id)
SELECT doc_id, chars, lines, CASE WHEN chars < 120 THEN 'sparse' WHEN lines < 4 THEN 'few_lines' WHEN bad > 0 THEN 'replacement' WHEN dup / lines > 0.25 THEN 'duplicate_lines' ELSE 'ok' END AS reason FROM a""")
def native_health(spark, sf_dir):
    return B.native_health(lines_of(spark, sf_dir))


@query(f"WITH {NODES} SELECT *, row_number() OVER (PARTITION BY doc_id, coalesce(parent_node, '<root>') ORDER BY ord, node) - 1 AS sibling FROM nodes")
def sibling_order(spark, sf_dir):
    return G.sibling_order(G.nodes(T.heading_tree(groups_of(spark, sf_dir))))


BROKEN = "SELECT doc_id, CASE WHEN doc_id % 11 = 3 THEN 'n_same' ELSE node END AS node, CASE WHEN doc_id % 7 = 2 AND ord = 2 THEN 'n_gone' WHEN doc_id % 7 = 3 AND ord = 2 THEN node ELSE parent_node END AS parent_node, kind, level, ord FROM nodes WHERE doc_id % 11 <> 3 OR parent_node IS NULL"


@query(f"""WITH {NODES}, b AS ({BROKEN}),
i AS (SELECT b.doc_id, CASE WHEN b.parent_node = b.node THEN 'self_parent' WHEN p.node IS NULL THEN 'missing_parent' WHEN p.ord >= b.ord THEN 'order_inversion' END AS code FROM b LEFT JOIN b p ON b.doc_id = p.doc_id AND b.parent_node = p.node WHERE b.parent_node IS NOT NULL
 UNION ALL SELECT doc_id, 'repeated_id' FROM (SELECT doc_id, node, count(*) AS c FROM b GROUP BY ALL) WHERE c > 1)
SELECT doc_id, code, count(*) AS issues FROM i WHERE code IS NOT NULL GROUP BY ALL""")
def graph_issues(spark, sf_dir):
    n = G.nodes(T.heading_tree(groups_of(spark, sf_dir)))
    d, o = F.col("doc_id"), F.col("ord")
    broken = n.where((d % 11 != 3) | F.col("parent_node").isNull()).select(
        "doc_id", F.when(d % 11 == 3, "n_same").otherwise(F.col("node")).alias("node"), F.when((d % 7 == 2) & (o == 2), "n_gone").when((d % 7 == 3) & (o == 2), F.col("node")).otherwise(F.col("parent_node")).alias("parent_node"), "kind", "level", "ord"
    )
    return G.validate(broken)


@query(f"WITH {PATHS} SELECT * FROM placed")
def preorder(spark, sf_dir):
    return G.preorder(T.heading_tree(groups_of(spark, sf_dir)))


@query(f"""WITH {GROUPS} SELECT g.doc_id, row_number() OVER (PARTITION BY g.doc_id ORDER BY group_no) - 1 AS nav_order, coalesce(nullif(trim(text), ''), 'Untitled heading') AS label, coalesce(level, 1) AS level FROM groups g JOIN lines l ON g.doc_id = l.doc_id AND g.first_line = l.line_no WHERE kind = 'heading'""")
def navigation(spark, sf_dir):
    lines = lines_of(spark, sf_dir)
    return G.navigation(T.line_groups(T.assignments(lines)), lines)


@query(f"WITH {PATHS} SELECT doc_id, group_no, node_order, total > 15 AS has_more FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total FROM placed) WHERE node_order >= 5 AND node_order < 15")
def content_page(spark, sf_dir):
    return G.content_page(G.preorder(T.heading_tree(groups_of(spark, sf_dir))), 5, 10)


@query(f"WITH {PATHS} SELECT doc_id, group_no, (node_order // 10) * 10 AS window_start FROM placed")
def content_around(spark, sf_dir):
    return G.content_around(G.preorder(T.heading_tree(groups_of(spark, sf_dir))), 10)


STATE = "CASE WHEN toxic = 1 THEN 'unavailable' WHEN quality = 0 THEN 'degraded' ELSE 'complete' END"


@query(f"""SELECT source, count(*) FILTER (state = 'complete') AS n_complete, count(*) FILTER (state = 'degraded') AS n_degraded, count(*) FILTER (state = 'unavailable') AS n_unavailable,
CASE WHEN count(*) FILTER (state = 'unavailable') = count(*) THEN 'unavailable' WHEN count(*) FILTER (state = 'complete') = count(*) THEN 'complete' ELSE 'degraded' END AS state FROM (SELECT source, {STATE} AS state FROM documents JOIN labels USING (doc_id)) GROUP BY source""")
def recovery_summary(spark, sf_dir):
    units = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return G.recovery_summary(units.withColumn("state", G.recovery_states(units)), "source")


@query(f"""WITH {KINDS}, p AS (SELECT doc_id, page, max((kind IN ('heading', 'title'))::INT) AS h, max((kind = 'unknown')::INT) AS u, min(confidence) AS c FROM kinds GROUP BY ALL),
e AS (SELECT *, min(page) OVER (PARTITION BY doc_id) AS a, max(page) OVER (PARTITION BY doc_id) AS b FROM p),
r AS (SELECT doc_id, page, list_filter(list_sort([CASE WHEN page = a THEN 'first_page' END, CASE WHEN page = b THEN 'last_page' END, CASE WHEN h = 1 THEN 'heading' END, CASE WHEN u = 1 THEN 'unknown' END, CASE WHEN c < 0.8 THEN 'low_ocr' END]), lambda x: x IS NOT NULL) AS rs FROM e),
q AS (SELECT doc_id, page, rs, list_min(list_transform(rs, lambda x: list_position(['first_page', 'last_page', 'heading', 'unknown', 'degraded', 'low_ocr'], x) - 1))::INT AS priority FROM r WHERE len(rs) > 0)
SELECT doc_id, page, array_to_string(rs, ',') AS reasons, priority, (row_number() OVER (PARTITION BY doc_id ORDER BY priority, page) - 1) // 16 AS batch FROM q""")
def page_reasons(spark, sf_dir):
    return G.page_reasons(kinds_of(spark, sf_dir))


@query(f"""WITH {KINDS}, e AS (SELECT doc_id, min(page) AS a, max(page) AS b FROM kinds GROUP BY doc_id)
SELECT doc_id, a AS page, CASE WHEN a = b THEN 'first_and_last' ELSE 'first' END AS boundary FROM e UNION ALL SELECT doc_id, b, 'last' FROM e WHERE a <> b""")
def boundary_pages(spark, sf_dir):
    return G.boundary_pages(kinds_of(spark, sf_dir))


OPS_SQL = NODES + """,
ops AS (SELECT doc_id, node, 'reclassify' AS op, CASE WHEN ord % 2 = 0 THEN 'heading' ELSE 'paragraph' END AS value, (80 + doc_id % 20) / 100.0::DOUBLE AS confidence FROM nodes WHERE ord % 3 = 0
 UNION ALL SELECT doc_id, node, 'reclassify', 'heading', 0.95::DOUBLE FROM nodes WHERE ord % 6 = 0 OR ord % 9 = 0
 UNION ALL SELECT doc_id, node, 'set_level', (1 + ord % 4)::VARCHAR, 0.92::DOUBLE FROM nodes WHERE ord % 4 = 0),
merged AS (SELECT doc_id, node, op, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS value, count(DISTINCT value) > 1 AS conflict, max(confidence) AS confidence FROM ops GROUP BY doc_id, node, op)"""


def ops_of(n: DataFrame) -> DataFrame:
    o, c = F.col("ord"), F.lit(0.95)
    a = n.where(o % 3 == 0).select("doc_id", "node", F.lit("reclassify").alias("op"), F.when(o % 2 == 0, "heading").otherwise("paragraph").alias("value"), ((80 + F.col("doc_id") % 20) / 100.0).alias("confidence"))
    b = n.where((o % 6 == 0) | (o % 9 == 0)).select("doc_id", "node", F.lit("reclassify").alias("op"), F.lit("heading").alias("value"), c.alias("confidence"))
    d = n.where(o % 4 == 0).select("doc_id", "node", F.lit("set_level").alias("op"), (1 + o % 4).cast("string").alias("value"), F.lit(0.92).alias("confidence"))
    return a.unionByName(b).unionByName(d)


@query(f"WITH {OPS_SQL} SELECT * FROM merged")
def patch_merge(spark, sf_dir):
    return G.patch_merge(ops_of(G.nodes(T.heading_tree(groups_of(spark, sf_dir)))))


@query(f"""WITH {OPS_SQL}, fit AS (SELECT doc_id, node, max(value) FILTER (op = 'reclassify') AS nk, max(CASE WHEN op = 'set_level' THEN value::INT END) AS nl FROM merged WHERE NOT conflict AND confidence >= 0.90 GROUP BY ALL)
SELECT n.doc_id, n.node, coalesce(nk, kind) AS kind, CASE WHEN coalesce(nk, kind) = 'heading' THEN coalesce(nl, level, 1) END AS level, (nk IS NOT NULL OR nl IS NOT NULL) AS changed FROM nodes n LEFT JOIN fit USING (doc_id, node)""")
def patch_apply(spark, sf_dir):
    n = G.nodes(T.heading_tree(groups_of(spark, sf_dir)))
    return G.patch_apply(n, G.patch_merge(ops_of(n)))


@query(f"""WITH {KINDS}, f AS (SELECT doc_id, count(*) AS nodes, sum(length(text))::BIGINT AS chars, max((kind IN ('title', 'heading'))::INT) AS h, max((kind IN ('table', 'figure', 'list', 'code'))::INT) AS x FROM kinds WHERE page = 0 AND NOT furniture GROUP BY doc_id)
SELECT doc_id, nodes, chars, (nodes <= 8 AND chars <= 160 AND h = 1 AND x = 0) AS is_cover FROM f""")
def cover_page(spark, sf_dir):
    return G.cover_page(kinds_of(spark, sf_dir))


@query("""WITH c AS (SELECT l_orderkey AS table_id, l_linenumber % 3 AS r, l_suppkey % 4 AS c, 1 + l_partkey % 2 AS rowspan, 1 + l_suppkey % 2 AS colspan FROM lineitem),
p AS (SELECT table_id, unnest(range(r, r + rowspan)) AS row, c, colspan FROM c), q AS (SELECT table_id, row, unnest(range(c, c + colspan)) AS col FROM p)
SELECT table_id, row::BIGINT AS row, col::BIGINT AS col, count(*) AS claims FROM q GROUP BY ALL HAVING count(*) > 1""")
def table_occupancy(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS table_id", "cast(l_linenumber % 3 AS bigint) AS r", "cast(l_suppkey % 4 AS bigint) AS c", "1 + l_partkey % 2 AS rowspan", "1 + l_suppkey % 2 AS colspan")
    return G.table_occupancy(cells)


@query("""WITH r AS (SELECT page_id // 4 AS asset, page_id AS rendition, CASE page_id % 4 WHEN 0 THEN 'thumbnail' WHEN 1 THEN 'original' WHEN 2 THEN 'normalized' ELSE 'ocr_source' END AS role, page_id % 3 AS declared, page_id % 5 <> 2 AS available, CASE WHEN page_id % 7 = 0 THEN 'bad' ELSE 'src_' || substr(sha256(url), 1, 32) END AS ref FROM pages)
SELECT asset, rendition, role FROM r WHERE available AND regexp_full_match(ref, 'src_[0-9a-f]{32}') QUALIFY row_number() OVER (PARTITION BY asset ORDER BY CASE role WHEN 'normalized' THEN 0 WHEN 'original' THEN 1 WHEN 'thumbnail' THEN 2 ELSE 3 END, declared, rendition) = 1""")
def rendition_pick(spark, sf_dir):
    p = table(spark, sf_dir, "pages").selectExpr("page_id div 4 AS asset", "page_id AS rendition", "CASE page_id % 4 WHEN 0 THEN 'thumbnail' WHEN 1 THEN 'original' WHEN 2 THEN 'normalized' ELSE 'ocr_source' END AS role", "page_id % 3 AS declared", "page_id % 5 <> 2 AS available", "CASE WHEN page_id % 7 = 0 THEN 'bad' ELSE concat('src_', substr(sha2(url, 256), 1, 32)) END AS ref")
    return G.rendition_pick(p)


@query(f"WITH {GROUPS}, e AS (SELECT *, CASE WHEN kind = 'heading' THEN repeat('#', level) || ' ' WHEN kind IN ('paragraph', 'list_item') THEN '' END AS marker FROM groups) SELECT doc_id, group_no, marker, CASE WHEN marker IS NULL THEN upper(kind) || '_NOT_PROJECTED' END AS loss FROM e")
def stream_projection(spark, sf_dir):
    return G.stream_projection(groups_of(spark, sf_dir))


STATUS_SQL = "CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'cancelled' END"


@query(f"""WITH s AS (SELECT event_id, user_id, ts, {STATUS_SQL} AS status FROM events), b AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM s)
SELECT event_id, user_id, before, status, CASE WHEN before IS NULL THEN status = 'created' ELSE before || '>' || status IN ({', '.join(map(quoted, X.ALLOWED))}) END AS allowed FROM b""")
def run_transitions(spark, sf_dir):
    return X.run_transitions(table(spark, sf_dir, "events"))


@query("""WITH RECURSIVE e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, json_extract_string(props, '$.k')::BIGINT % 5 AS expected, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, day, i, (expected = 0)::BIGINT AS version FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.day, e.i, f.version + (e.expected = f.version % 5)::BIGINT FROM f JOIN e ON e.user_id = f.user_id AND e.day = f.day AND e.i = f.i + 1)
SELECT user_id, day, max(i) AS n_events, max(version) AS version FROM f GROUP BY user_id, day""")
def selection_replay(spark, sf_dir):
    return X.selection_replay(table(spark, sf_dir, "events"))


@query("""WITH RECURSIVE e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, json_extract_string(props, '$.k')::BIGINT % 5 AS expected, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, day, i, coalesce(expected = 0, false)::BIGINT AS hit, coalesce(expected = 0, false)::BIGINT AS version FROM e WHERE i = 1
 UNION ALL SELECT e.user_id, e.day, e.i, coalesce(e.expected = f.version % 5, false)::BIGINT, f.version + coalesce(e.expected = f.version % 5, false)::BIGINT FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, day, count(*) AS n_events, sum(hit)::BIGINT AS accepted, max(version) AS version FROM f GROUP BY user_id, day""")
def selection_history(spark, sf_dir):
    return X.selection_history(table(spark, sf_dir, "events"))


@query("""SELECT event_id, user_id, coalesce(ts <= granted + INTERVAL 20 MINUTE, false) AS alive FROM (SELECT *, last_value(CASE WHEN event_type = 'click' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS granted FROM events) WHERE event_type = 'view'""")
def grant_replay(spark, sf_dir):
    return X.grant_replay(table(spark, sf_dir, "events"))


@query(f"""WITH {KINDS}, p AS (SELECT doc_id, page, sum(length(text) * 1000)::BIGINT AS px FROM kinds GROUP BY ALL), u AS (SELECT doc_id, page, (sum(px) OVER o)::BIGINT AS used, count(*) OVER o AS n FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY page))
SELECT doc_id, page, used, (used <= 5000000 AND n <= 4) AS admitted FROM u""")
def page_budget(spark, sf_dir):
    pages = kinds_of(spark, sf_dir).groupBy("doc_id", "page").agg(F.sum(F.length("text") * 1000).alias("px"))
    return X.page_budget(pages, 5_000_000, 4)


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_activity(spark, sf_dir):
    return X.hourly_activity(table(spark, sf_dir, "events"))


@query("SELECT source, lang, count(*) AS books, sum(length(text))::BIGINT AS chars, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY source, lang")
def bookshelf(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("books"), F.sum(F.length("text")).cast("long").alias("chars"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


# Refinement.
OUTLINE = ASSIGNED + f""",
cands AS (SELECT doc_id, line_no, level, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM assigned WHERE kind = 'heading'),
owin AS (SELECT doc_id, line_no, unnest(range(greatest(0, ceil((i - {R.OUTLINE_WINDOW - 1}) / 100.0)::BIGINT), least(i // 100, greatest(0, ceil((n - {R.OUTLINE_WINDOW}) / 100.0)::BIGINT)) + 1)) AS w, level FROM cands),
ovotes AS (SELECT doc_id, line_no, w, least(6, level + (CASE WHEN (line_no + w) % 3 = 0 THEN 1 ELSE 0 END))::INT AS level FROM owin),
outline AS (SELECT doc_id, line_no, level, votes FROM (SELECT doc_id, line_no, level, count(*) AS votes, min(w) AS w FROM ovotes GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id, line_no ORDER BY votes DESC, w, level) = 1)"""


def outline_votes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window votes: the default level, one lower in a third of the windows."""
    lower = F.when((F.col("line_no") + F.col("w")) % 3 == 0, 1).otherwise(0)
    return R.outline_windows(T.assignments(lines_of(spark, sf_dir))).withColumn("level", F.least(F.lit(6), F.col("level") + lower).cast("int"))


@query(f"WITH {OUTLINE} SELECT doc_id, line_no, level, w FROM owin")
def outline_windows(spark, sf_dir):
    return R.outline_windows(T.assignments(lines_of(spark, sf_dir)))


@query(f"WITH {OUTLINE} SELECT * FROM outline")
def outline_vote(spark, sf_dir):
    return R.outline_vote(outline_votes_of(spark, sf_dir))


@query(f"WITH {OUTLINE} SELECT doc_id, line_no, a.kind, coalesce(o.level, a.level)::INT AS level FROM assigned a LEFT JOIN outline o USING (doc_id, line_no)")
def outline_applied(spark, sf_dir):
    return R.apply_outline(T.assignments(lines_of(spark, sf_dir)), R.outline_vote(outline_votes_of(spark, sf_dir)))


TOC_LINES = "repeat(' ', line_no % 3) || CASE WHEN line_no % 4 = 0 THEN 'x ' ELSE '' END || '第' || line_no || '章 ' || substr(text, 1, 10 + 30 * (line_no % 5)) || '  卷' || line_no || ' ' || substr(text, 1, 20)"


@query(f"""WITH {LINES}, t AS (SELECT doc_id, line_no, {TOC_LINES} AS t FROM lines WHERE text <> ''),
c AS (SELECT doc_id, line_no, string_split(regexp_replace(t, '(^|\\s)({R.MARKER})', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS p FROM t WHERE length(t) <= {R.TOC_LINE_CHARS}),
u AS (SELECT doc_id, line_no, unnest(range(1, len(p) + 1)) AS i, p FROM c),
s AS (SELECT doc_id, line_no, trim(p[i]) AS entry, list_sum(list_transform(p[:i], lambda x: length(x)))::BIGINT - length(p[i]) + length(p[i]) - length(ltrim(p[i])) AS start FROM u WHERE length(trim(p[i])) > 0),
k AS (SELECT *, count(*) OVER l AS n, max(length(entry)) OVER l AS longest, bool_and(regexp_matches(entry, '^({R.MARKER})')) OVER l AS marked, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY start)::INT AS entry_no FROM s WINDOW l AS (PARTITION BY doc_id, line_no))
SELECT doc_id, line_no, entry_no, start, start + length(entry) AS stop, entry FROM k WHERE n >= 2 AND longest <= {R.TOC_ENTRY_CHARS} AND marked""")
def compact_toc(spark, sf_dir):
    lines = lines_of(spark, sf_dir).where("text <> ''")
    made = F.expr(TOC_LINES.replace("repeat(' ', line_no % 3)", "repeat(' ', int(line_no % 3))").replace("30 * (line_no % 5)", "30 * int(line_no % 5)"))
    return R.compact_toc(lines.withColumn("text", made))


WRAPPED = f"(ends_with(b, '-') OR regexp_matches(f, {quoted(R.RIGHT_PUNCTUATION)}) OR regexp_matches(b, '{R.CJK}$') OR regexp_matches(f, '^{R.CJK}'))"
PARAS = LINES + f""",
flat AS (SELECT doc_id, line_no, {FLAT} AS f FROM lines),
near AS (SELECT *, lag(f) OVER o AS b, lead(f) OVER o AS a FROM flat WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)),
joint AS (SELECT doc_id, line_no, coalesce(b = '' OR regexp_matches(b, {quoted(T.TERMINAL)}), true) AS new, coalesce(a <> '' AND NOT regexp_matches(f, {quoted(T.TERMINAL)}), false) AS goes_on, f, CASE WHEN {WRAPPED} THEN '' ELSE ' ' END AS glue FROM near WHERE f <> ''),
piece AS (SELECT doc_id, line_no, (sum(new::INT) OVER (PARTITION BY doc_id ORDER BY line_no))::BIGINT AS para, CASE WHEN new THEN '' ELSE glue END || CASE WHEN goes_on AND ends_with(f, '-') THEN left(f, length(f) - 1) ELSE f END AS piece FROM joint),
paras AS (SELECT doc_id, para, trim(string_agg(piece, '' ORDER BY line_no)) AS text FROM piece GROUP BY doc_id, para)"""


@query(f"WITH {PARAS} SELECT * FROM paras")
def wrapped_paragraphs(spark, sf_dir):
    return R.paragraphs(lines_of(spark, sf_dir))


@query(f"""WITH {PARAS}, n AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY para) AS norm FROM paras GROUP BY doc_id), x AS (SELECT doc_id, body AS raw, norm, length(regexp_replace(body, '[^一-鿿]', '', 'g')) AS c, length(regexp_replace(norm, '[^一-鿿]', '', 'g')) AS d FROM books JOIN n USING (doc_id))
SELECT doc_id, length(raw)::BIGINT AS raw_chars, length(norm)::BIGINT AS normalized_chars, CASE WHEN length(norm) < 0.75 * length(raw) OR (c > 2 AND d < 0.75 * c) THEN 'raw' ELSE 'normalized' END AS chosen FROM x""")
def safe_choice(spark, sf_dir):
    paras = R.paragraphs(lines_of(spark, sf_dir)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("para", "text"))).alias("p"))
    both = S.books(spark, sf_dir).join(paras.select("doc_id", F.array_join(F.col("p.text"), "\n").alias("norm")), "doc_id")
    return R.safe_choice(both, "body", "norm")


DECOR = "page_header Page-Footer number aside_text text".split()


@query(f"""WITH {KINDS}, d AS (SELECT doc_id, line_no, line_no % 5 AS k, (top + bottom) / 2 AS c FROM kinds)
SELECT doc_id, line_no, CASE k WHEN 0 THEN 'header' WHEN 1 THEN 'footer' WHEN 3 THEN 'footnote' ELSE CASE WHEN c <= 0.2 THEN 'header' ELSE 'footer' END END AS kind, (k <> 2 OR c <= 0.2 OR c >= 0.8) AS sure FROM d WHERE k < 4""")
def presentation_kind(spark, sf_dir):
    named = F.element_at(F.array(*map(F.lit, DECOR)), (F.col("line_no") % 5 + 1).cast("int"))
    return R.presentation_kind(kinds_of(spark, sf_dir).withColumn("raw_kind", named))


@query(f"""WITH {KINDS}, b AS (SELECT doc_id, line_no, row_number() OVER (w ORDER BY line_no) - 1 AS i, count(*) OVER w AS n, min(top) OVER w AS t, max(bottom) OVER w - min(top) OVER w AS h FROM kinds WINDOW w AS (PARTITION BY doc_id, page, line_no // 7))
SELECT doc_id, line_no, t + h * i / n AS slice_top, t + h * (i + 1) / n AS slice_bottom FROM b""")
def toc_slices(spark, sf_dir):
    return R.toc_slices(kinds_of(spark, sf_dir).withColumn("box", F.struct("page", F.expr("line_no div 7"))))


@query(f"""WITH {ORDERED}, i AS (SELECT *, sum((kind <> 'caption')::INT) OVER (PARTITION BY doc_id, page ORDER BY ord) AS island FROM ordered),
h AS (SELECT *, coalesce(max(line_no) FILTER (kind IN ('figure', 'table')) OVER (PARTITION BY doc_id, page, island), line_no) AS owner FROM i)
SELECT doc_id, owner AS line_no, max(CASE WHEN owner = line_no THEN CASE WHEN kind = 'caption' THEN 'paragraph' ELSE kind END END) AS kind, min(l) AS l, min(top) AS top, max(r) AS r, max(bottom) AS bottom,
 coalesce(string_agg(text, ' ' ORDER BY ord) FILTER (kind = 'caption' AND owner <> line_no), '') AS caption FROM h GROUP BY doc_id, owner""")
def caption_absorb(spark, sf_dir):
    return R.caption_absorb(B.reading_order(kinds_of(spark, sf_dir)))


@query(f"""WITH {KINDS}, v AS (SELECT doc_id, page, kind, line_no, l, top, r, bottom FROM kinds WHERE kind IN ('figure', 'table')),
c AS (SELECT doc_id, page, kind, 'r' || line_no AS id, l, top + 0.005::DOUBLE * (line_no % 4) AS top, r, bottom FROM v),
p AS (SELECT c.doc_id, c.id, v.line_no AS keeper, greatest(0.0::DOUBLE, least(c.r, v.r) - greatest(c.l, v.l)) AS w, greatest(0.0::DOUBLE, least(c.bottom, v.bottom) - greatest(c.top, v.top)) AS h, (c.r - c.l) * (c.bottom - c.top) AS x, (v.r - v.l) * (v.bottom - v.top) AS y FROM c JOIN v USING (doc_id, page, kind)),
m AS (SELECT doc_id, id, keeper, w * h / least(x, y) AS containment, least(x, y) / greatest(x, y) AS ratio FROM p WHERE least(x, y) > 0)
SELECT doc_id, id, keeper FROM m WHERE containment >= 0.92 AND ratio >= 0.45 QUALIFY row_number() OVER (PARTITION BY doc_id, id ORDER BY containment DESC, ratio DESC, keeper) = 1""")
def duplicate_visuals(spark, sf_dir):
    box = ("l", "top", "r", "bottom")
    v = kinds_of(spark, sf_dir).where("kind IN ('figure', 'table')").select("doc_id", "page", "kind", F.col("line_no").alias("id"), F.col("line_no").alias("ord"), *box)
    shifted = v.select("doc_id", "page", "kind", F.concat(F.lit("r"), "id").alias("id"), "l", (F.col("top") + 0.005 * (F.col("ord") % 4)).alias("top"), "r", "bottom")
    return R.duplicate_visuals(v, shifted)


# Assembly of text.
CONTENTS = "CASE line_no % 7 WHEN 0 THEN line_no || '章' WHEN 1 THEN trim(substr(text, 1, 20)) || ' ..... ' || line_no WHEN 2 THEN trim(substr(text, 1, 20)) || '   ' || line_no WHEN 3 THEN trim(substr(text, 1, 20)) || ' - ' || line_no WHEN 4 THEN '章节文字（' || line_no || '）' WHEN 5 THEN '目 录' ELSE CASE WHEN line_no % 2 = 0 THEN '杂音' ELSE '四字杂音' END END"


def sql_any(x: str, *patterns: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {quoted(p)})" for p in patterns) + ")"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[ \t　]+|[ \t　]+$', '', 'g')"


def sql_title(x: str, pattern: str) -> str:
    flat = FLAT.replace("translate(text,", f"translate(regexp_extract({x}, {quoted(pattern)}, 1),")
    return sql_strip(f"regexp_replace({flat}, {quoted(A.LEADER + '+$')}, '')")


def sql_match(x: str) -> str:
    return sql_any(x, A.CONTENTS_HEADING, A.TITLE_LIKE, A.LEADER_LINE, A.SPACED_LINE, A.DASH_LINE, A.PAREN_LINE)


def sql_noise(x: str) -> str:
    return f"({x} = '' OR (NOT {sql_any(x, A.CONTENTS_HEADING, A.TITLE_LIKE, A.PAGE_TOKEN, '[A-Za-z0-9]')} AND {sql_any(x, A.NOISE_CJK)}))"


PAREN_TITLE = sql_title("t", A.PAREN_LINE)
ENTRY = (
    f"CASE WHEN {sql_any('t', A.CONTENTS_HEADING)} THEN '目录' WHEN {sql_any('t', A.TITLE_LIKE)} THEN t WHEN {sql_noise('t')} THEN '' WHEN {sql_any('t', A.PAREN_LINE)} THEN CASE WHEN {PAREN_TITLE} = '' OR {sql_noise(PAREN_TITLE)} THEN '' ELSE {PAREN_TITLE} || '...' || regexp_extract(t, {quoted(A.PAREN_LINE)}, 2) END "
    + " ".join(f"WHEN {sql_any('t', p)} THEN CASE WHEN {sql_title('t', p)} = '' THEN t ELSE {sql_title('t', p)} || '...' || regexp_extract(t, {quoted(p)}, 2) END" for p in (A.SPACED_LINE, A.DASH_LINE, A.LEADER_LINE))
    + " ELSE t END"
)
CONTENTS_ROWS = LINES + f""",
src AS (SELECT doc_id, (line_no - 1) // 6 AS block, line_no, {CONTENTS} AS text FROM lines),
cl AS (SELECT doc_id, block, line_no, t FROM (SELECT *, {sql_strip('text')} AS t FROM src) WHERE t <> ''),
ce AS (SELECT doc_id, block, line_no, t, lead(t) OVER (PARTITION BY doc_id, block ORDER BY line_no) AS nxt, {ENTRY} AS entry FROM cl)"""


def contents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(spark, sf_dir).select("doc_id", F.expr("(line_no - 1) div 6").alias("block"), "line_no", F.expr(CONTENTS).alias("text"))


@query(f"WITH {CONTENTS_ROWS} SELECT doc_id, line_no, entry FROM ce")
def contents_entries(spark, sf_dir):
    return contents_of(spark, sf_dir).select("doc_id", "line_no", A.contents_entry(A.strip(F.col("text"))).alias("entry"))


@query(f"""WITH {CONTENTS_ROWS}, c AS (SELECT doc_id, block, count(*) AS n_lines, sum({sql_match('t')}::INT)::BIGINT AS matches, bool_or({sql_any('t', A.CONTENTS_HEADING, A.LEADER_LINE, A.SPACED_LINE, A.DASH_LINE, A.PAREN_LINE)}) AS one FROM cl GROUP BY ALL)
SELECT doc_id, block, n_lines, matches, CASE WHEN n_lines = 1 THEN one ELSE matches >= greatest(2, n_lines // 2) END AS is_contents FROM c""")
def contents_vote(spark, sf_dir):
    return A.contents_vote(contents_of(spark, sf_dir))


@query(f"""WITH RECURSIVE {CONTENTS_ROWS},
r AS (SELECT doc_id, block, entry, row_number() OVER (PARTITION BY doc_id, block ORDER BY line_no) AS i, {sql_match('entry')} AS s, coalesce({sql_match('nxt')}, false) AND ({sql_noise('entry')} OR ({sql_any('entry', A.INLINE_NOISE_CJK)} AND NOT {sql_any('entry', A.TITLE_LIKE)})) AS g FROM ce WHERE entry <> ''),
f AS (SELECT doc_id, block, i, entry, false AS gone, false AS a, s AS b FROM r WHERE i = 1
 UNION ALL SELECT r.doc_id, r.block, r.i, r.entry, r.g AND (f.a OR f.b), CASE WHEN r.g AND (f.a OR f.b) THEN f.a ELSE f.b END, CASE WHEN r.g AND (f.a OR f.b) THEN f.b ELSE r.s END FROM f JOIN r ON r.doc_id = f.doc_id AND r.block = f.block AND r.i = f.i + 1)
SELECT doc_id, block, row_number() OVER (PARTITION BY doc_id, block ORDER BY i) AS entry_no, entry FROM f WHERE NOT gone""")
def contents_block(spark, sf_dir):
    return A.contents_block(contents_of(spark, sf_dir))


# The contents operators over whole texts: a book's own lines as they are, and made contents lines, uncut, beside some.
BOOK_BODY = "body || CASE doc_id % 3 WHEN 0 THEN chr(10) || t || ' ..... ' || (1 + doc_id % 300) || chr(10) || 'Part ' || (doc_id % 7) || '  ' || (2 + doc_id % 300) WHEN 1 THEN chr(10) || t || ' ..... ' || (1 + doc_id % 300) ELSE '' END"


def with_made(spark: SparkSession, sf_dir: str, made: str, where: str) -> DataFrame:
    """Whole lines under even numbers and, where ``where`` holds, a made line after them."""
    both = F.filter(F.array(F.struct((2 * F.col("line_no")).alias("line_no"), "text"), F.when(F.expr(where), F.struct((2 * F.col("line_no") + 1).alias("line_no"), F.expr(made).alias("text")))), lambda x: x.isNotNull())
    return lines_of(spark, sf_dir).select("doc_id", F.expr("(line_no - 1) div 6").alias("block"), F.explode(both).alias("x")).select("doc_id", "block", "x.line_no", "x.text")


@query(SQL["toc_items"].replace(f"b AS (SELECT doc_id, string_split(body, chr(10))[1] AS h FROM books), x AS (SELECT doc_id, {TOC_BODY} AS body FROM b)", f"b AS (SELECT doc_id, body, string_split(body, chr(10))[2] AS t FROM books), x AS (SELECT doc_id, {BOOK_BODY} AS body FROM b)"))
def toc_items_whole(spark, sf_dir):
    made = BOOK_BODY.replace("chr(10)", r"'\n'")
    return B.toc_items(S.books(spark, sf_dir).withColumn("t", F.split("body", "\n")[1]).select("doc_id", F.expr(made).alias("body")), "body")


WHOLE_CONTENTS = CONTENTS.replace("substr(text, 1, 20)", "text")
CUT_ROWS = f"SELECT doc_id, (line_no - 1) // 6 AS block, line_no, {CONTENTS} AS text FROM lines"
WHOLE_ROWS = f"SELECT doc_id, (line_no - 1) // 6 AS block, 2 * line_no AS line_no, text FROM lines UNION ALL SELECT doc_id, (line_no - 1) // 6, 2 * line_no + 1, {WHOLE_CONTENTS} FROM lines WHERE (line_no - 1) // 6 % 3 = 0"


def whole_contents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_made(spark, sf_dir, WHOLE_CONTENTS, "(line_no - 1) div 6 % 3 = 0")


@query(SQL["contents_entries"].replace(CUT_ROWS, WHOLE_ROWS))
def contents_entries_whole(spark, sf_dir):
    return whole_contents_of(spark, sf_dir).select("doc_id", "line_no", A.strip(F.col("text")).alias("line")).where("line <> ''").select("doc_id", "line_no", A.contents_entry(F.col("line")).alias("entry"))


@query(SQL["contents_vote"].replace(CUT_ROWS, WHOLE_ROWS))
def contents_vote_whole(spark, sf_dir):
    return A.contents_vote(whole_contents_of(spark, sf_dir))


@query(SQL["contents_block"].replace(CUT_ROWS, WHOLE_ROWS))
def contents_block_whole(spark, sf_dir):
    return A.contents_block(whole_contents_of(spark, sf_dir))


WHOLE_TOC_LINES = TOC_LINES.replace("substr(text, 1, 10 + 30 * (line_no % 5))", "text").replace("substr(text, 1, 20)", "text")


@query(SQL["compact_toc"].replace(f"SELECT doc_id, line_no, {TOC_LINES} AS t FROM lines WHERE text <> ''", f"SELECT doc_id, 2 * line_no AS line_no, text AS t FROM lines UNION ALL SELECT doc_id, 2 * line_no + 1, {WHOLE_TOC_LINES} FROM lines WHERE text <> ''"))
def compact_toc_whole(spark, sf_dir):
    return R.compact_toc(with_made(spark, sf_dir, WHOLE_TOC_LINES.replace("repeat(' ', line_no % 3)", "repeat(' ', int(line_no % 3))"), "text <> ''"))


FORCED = ", ".join(map(quoted, A.FORCED))


@query(f"""WITH {ORDERED},
frag AS (SELECT doc_id, ord, CASE WHEN kind IN ('title', 'heading') THEN 'title' WHEN kind = 'caption' THEN 'caption' WHEN kind = 'figure' THEN 'image' WHEN kind = 'table' THEN 'table' ELSE 'text' END AS type, trim(coalesce(text, '')) AS text, page, {PX.format('l')} AS x1, {PX.format('top')} AS y1, {PX.format('bottom')} AS y2 FROM ordered),
prev AS (SELECT *, lag(type) OVER o AS pt, lag(text) OVER o AS p, lag(page) OVER o AS pp, lag(x1) OVER o AS px, lag(y1) OVER o AS py1, lag(y2) OVER o AS py2 FROM frag WHERE type IN ('image', 'table') OR text <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY ord)),
brk AS (SELECT doc_id, ord, type, text, p, coalesce(pt IN ({FORCED}) OR type IN ({FORCED}) OR {sql_any('p', T.TERMINAL)} OR {sql_any('p', T.HEADING_LIKE)} OR {sql_any('text', T.HEADING_LIKE)}
 OR CASE WHEN pp <> page THEN py2 / 1000 < 0.88 OR y1 / 1000 > 0.18 ELSE greatest(0, y1 - py2) > greatest(4, floor(greatest(1, py2 - py1, y2 - y1) * 0.08)) OR abs(x1 - px) > 25 OR length(p) < 12 END, true) AS new FROM prev),
num AS (SELECT *, (sum(new::INT) OVER o)::BIGINT AS out_no, NOT coalesce(lead(new) OVER o, true) AS goes_on FROM brk WINDOW o AS (PARTITION BY doc_id ORDER BY ord)),
pc AS (SELECT doc_id, ord, out_no, type, CASE WHEN new OR {WRAPPED.replace('(b,', '(p,').replace('(f,', '(text,')} THEN '' ELSE ' ' END || CASE WHEN goes_on AND ends_with(text, '-') THEN left(text, length(text) - 1) ELSE text END AS piece FROM num)
SELECT * FROM (SELECT doc_id, out_no, max_by(type, ord) AS kind, trim(string_agg(piece, '' ORDER BY ord)) AS text FROM pc GROUP BY doc_id, out_no) WHERE text <> ''""")
def output_lines(spark, sf_dir):
    o = B.reading_order(kinds_of(spark, sf_dir))
    px = lambda c: F.bround(F.col(c) * 1000, 0).cast("int").alias
    kind = F.when(F.col("kind").isin("title", "heading"), "title").when(F.col("kind") == "caption", "caption").when(F.col("kind") == "figure", "image").when(F.col("kind") == "table", "table").otherwise("text")
    return A.output_lines(o.select("doc_id", "ord", "line_no", kind.alias("type"), "text", "page", px("l")("x1"), px("top")("y1"), px("r")("x2"), px("bottom")("y2"), F.lit(1000).alias("page_width"), F.lit(1000).alias("page_height")))


@query(f"""WITH RECURSIVE {ORDERED}, b AS (SELECT doc_id, ord, line_no, page, trim(text) AS text, CASE WHEN kind = 'paragraph' THEN 'text' ELSE kind END AS kind FROM ordered),
n AS (SELECT *, lag(text) OVER o AS p, coalesce(kind = 'text' AND lag(kind) OVER o = 'text' AND lag(text) OVER o <> '' AND NOT {sql_any('lag(text) OVER o', A.CONTINUED_END)} AND {sql_any('text', A.CONTINUED_START)}, false) AS c FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY ord)),
f AS (SELECT doc_id, ord, line_no AS head, page AS hp, text AS piece FROM n WHERE ord = 0
 UNION ALL SELECT n.doc_id, n.ord, CASE WHEN n.c AND n.page <> f.hp THEN f.head ELSE n.line_no END, CASE WHEN n.c AND n.page <> f.hp THEN f.hp ELSE n.page END,
 CASE WHEN n.c AND n.page <> f.hp THEN CASE WHEN {sql_any('n.p', A.CJK + '$')} AND {sql_any('n.text', '^' + A.CJK)} THEN '' ELSE ' ' END ELSE '' END || n.text FROM f JOIN n ON n.doc_id = f.doc_id AND n.ord = f.ord + 1)
SELECT doc_id, head, count(*) AS n_parts, string_agg(piece, '' ORDER BY ord) AS text FROM f GROUP BY doc_id, head HAVING count(*) > 1""")
def cross_page_text(spark, sf_dir):
    o = B.reading_order(kinds_of(spark, sf_dir))
    return A.cross_page_text(o.select("doc_id", "ord", "line_no", "page", "text", F.when(F.col("kind") == "paragraph", "text").otherwise(F.col("kind")).alias("kind")))


@query(f"""WITH RECURSIVE {LINES}, b AS (SELECT doc_id, line_no, (line_no - 1) // 25 AS page, CASE WHEN line_no % 25 < 2 THEN 'table' ELSE 'text' END AS kind, CASE WHEN line_no % 4 = 1 THEN 'T' || line_no ELSE '' END AS caption FROM lines),
n AS (SELECT *, coalesce(kind = 'table' AND lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) = 'table' AND caption = '', false) AS c FROM b),
f AS (SELECT doc_id, line_no, kind, page, line_no AS head, page AS hp, caption AS note FROM n WHERE line_no = 1
 UNION ALL SELECT n.doc_id, n.line_no, n.kind, n.page, CASE WHEN n.c AND n.page <> f.hp THEN f.head ELSE n.line_no END, CASE WHEN n.c AND n.page <> f.hp THEN f.hp ELSE n.page END,
 CASE WHEN n.c AND n.page <> f.hp THEN ' [continued from p' || f.hp || ' to p' || n.page || ']' ELSE n.caption END FROM f JOIN n ON n.doc_id = f.doc_id AND n.line_no = f.line_no + 1)
SELECT doc_id, head, count(*) AS n_parts, trim(string_agg(note, '' ORDER BY line_no)) AS caption, max(line_no) AS continuation FROM f WHERE kind = 'table' GROUP BY doc_id, head HAVING count(*) > 1""")
def cross_page_tables(spark, sf_dir):
    lines = lines_of(spark, sf_dir)
    return A.cross_page_tables(lines.select("doc_id", F.col("line_no").alias("ord"), "line_no", F.expr("(line_no - 1) div 25").alias("page"), F.expr("CASE WHEN line_no % 25 < 2 THEN 'table' ELSE 'text' END").alias("kind"), F.expr("CASE WHEN line_no % 4 = 1 THEN 'T' || line_no ELSE '' END").alias("caption")))


NATIVE = {"page": "(line_no - 1) // 25", "x0": "(100 + CASE WHEN line_no % 5 = 0 THEN 40 ELSE 0 END)::DOUBLE", "y0": "(40 * ((line_no - 1) % 25))::DOUBLE", "y1": "(40 * ((line_no - 1) % 25) + CASE WHEN line_no % 9 = 0 THEN 2 ELSE 30 END)::DOUBLE", "x1": "(500 + 20 * (line_no % 3))::DOUBLE", "font": "(10 + CASE WHEN line_no % 13 = 0 THEN 2 WHEN line_no % 11 = 0 THEN 0.5 ELSE 0 END)::DOUBLE"}
NATIVE_KINDS = LINES + f""",
nat AS (SELECT doc_id, line_no, trim(text) AS text, {', '.join(f'{v} AS {k}' for k, v in NATIVE.items())} FROM lines),
nb AS (SELECT *, quantile_cont(font, 0.5) OVER (PARTITION BY doc_id, page) AS body FROM nat),
nk AS (SELECT *, CASE WHEN y0 >= 880 AND {sql_any('text', A.NATIVE_NUMBER)} THEN 'number' WHEN length(text) <= 80 AND (font >= body * 1.10::DOUBLE OR (abs((x0 + x1) / 2 - 500) <= 180 AND font >= body * 1.03::DOUBLE)) THEN 'paragraph_title' ELSE 'text' END AS kind FROM nb)"""


def native_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = (F.expr(v.replace("//", "div")).alias(k) for k, v in NATIVE.items())
    return lines_of(spark, sf_dir).select("doc_id", "line_no", "text", *made, F.lit(1000.0).alias("width"), F.lit(1000.0).alias("height"))


@query(f"WITH {NATIVE_KINDS} SELECT doc_id, line_no, kind, body FROM nk")
def native_kinds(spark, sf_dir):
    return A.native_kinds(native_of(spark, sf_dir)).select("doc_id", "line_no", "kind", "body")


FITS = f"(n.kind = 'text' AND f.kind = 'text' AND n.y0 - f.y1 <= greatest(1, n.y1 - n.y0, f.y1 - f.y0) * 1.15::DOUBLE AND NOT (n.ind AND {sql_any('f.text', A.NATIVE_END)}))"


@query(f"""WITH RECURSIVE {NATIVE_KINDS},
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS i, x0 >= coalesce(min(x0) FILTER (kind = 'text') OVER (PARTITION BY doc_id, page), 0) + 25 AS ind FROM nk WHERE text <> ''),
f AS (SELECT doc_id, page, i, 0::BIGINT AS block, kind, 1::BIGINT AS n_lines, y0, y1, text FROM n WHERE i = 1
 UNION ALL SELECT n.doc_id, n.page, n.i, CASE WHEN {FITS} THEN f.block ELSE f.block + 1 END, n.kind, CASE WHEN {FITS} THEN f.n_lines + 1 ELSE 1 END, CASE WHEN {FITS} THEN least(f.y0, n.y0) ELSE n.y0 END, CASE WHEN {FITS} THEN greatest(f.y1, n.y1) ELSE n.y1 END,
 CASE WHEN {FITS} THEN f.text || CASE WHEN {sql_any('right(f.text, 1)', A.NATIVE_CJK)} OR {sql_any('left(n.text, 1)', A.NATIVE_CJK)} THEN '' ELSE ' ' END || n.text ELSE n.text END FROM f JOIN n ON n.doc_id = f.doc_id AND n.page = f.page AND n.i = f.i + 1)
SELECT doc_id, page, block, kind, n_lines, y0, y1, text FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, page, block ORDER BY i DESC) = 1""")
def native_paragraphs(spark, sf_dir):
    return A.native_paragraphs(native_of(spark, sf_dir))


# Review and sources.
@query("""WITH p AS (SELECT l_orderkey AS doc_id, 1 + (l_linenumber * l_suppkey) % 7 AS page FROM lineitem), c AS (SELECT doc_id, page, count(*) AS n FROM p GROUP BY ALL),
a AS (SELECT doc_id, sum(n)::BIGINT AS observed, min(page) AS first_page, max(page) AS last_page, list(page) AS ps, coalesce(list_sort(list(page) FILTER (n > 1)), []) AS twice FROM c GROUP BY doc_id),
m AS (SELECT *, list_filter(range(1, 8), lambda x: NOT list_contains(ps, x)) AS gone FROM a)
SELECT doc_id, observed, first_page, last_page, array_to_string(gone, ',') AS missing, array_to_string(twice, ',') AS duplicates, len(gone) = 0 AND len(twice) = 0 AS valid FROM m""")
def page_summary(spark, sf_dir):
    pages = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", "1 + (l_linenumber * l_suppkey) % 7 AS page", "7 AS expected")
    return V.page_summary(pages)


VOTES = "CASE WHEN event_type IN ('view', 'purchase', 'click') THEN 'accept' ELSE 'revise' END"


@query(f"""WITH v AS (SELECT user_id AS doc_id, strftime(ts, '%Y-%m-%d') AS crop, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS k, event_id, (85 + event_id % 20) / 100::DOUBLE AS conf, {VOTES} = 'accept' AND event_id % 20 >= 5 AS ok FROM events),
c AS (SELECT doc_id, crop, bool_or(ok) FILTER (k = 1) AS a, bool_or(ok) FILTER (k = 2) AS b, bool_or(ok) FILTER (k = 3) AS c FROM v GROUP BY ALL),
l AS (SELECT *, 6 - coalesce(sum(CASE WHEN a THEN 0 WHEN coalesce(b, false) THEN 2 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY crop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over FROM c),
s AS (SELECT doc_id, crop, CASE WHEN a THEN 'single_accept' WHEN left_over < 1 THEN 'adverse_unconfirmed' WHEN b IS NULL THEN 'confirmation_failed' WHEN NOT b THEN 'confirmed_adverse' WHEN left_over < 2 THEN 'split_budget_exhausted' WHEN c IS NULL THEN 'tie_break_failed' WHEN c THEN 'majority_accept' ELSE 'majority_adverse' END AS status FROM l),
u AS (SELECT *, CASE WHEN status IN ('single_accept', 'adverse_unconfirmed', 'confirmation_failed') THEN 1 WHEN starts_with(status, 'majority') THEN 3 ELSE 2 END::BIGINT AS n_votes, status IN ('single_accept', 'majority_accept') AS accepted FROM s)
SELECT doc_id, crop, n_votes, status, accepted, max_by(event_id, conf * 1000 - k) AS chosen FROM u JOIN v USING (doc_id, crop) WHERE k <= n_votes AND ok = accepted GROUP BY ALL""")
def consensus(spark, sf_dir):
    w = Window.partitionBy("doc_id", "crop").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.date_format("ts", "yyyy-MM-dd").alias("crop"), "ts", "event_id", F.expr(VOTES).alias("decision"), F.expr("(85 + event_id % 20) / cast(100 AS double)").alias("confidence"))
    return V.consensus(e.select("doc_id", "crop", F.row_number().over(w).alias("vote_no"), F.col("event_id").alias("vote_id"), "decision", "confidence"))


SIDE = "[greatest(0, g - {r}) + 1:g]", "[g + 2:least(255, g + {r}) + 1]"


@query(f"""WITH p AS (SELECT l_returnflag || l_linestatus AS image, ((l_quantity::INT * round(l_discount * 100)::INT) % 256)::INT AS gray FROM lineitem), c AS (SELECT image, gray, count(*) AS n FROM p GROUP BY ALL),
h AS (SELECT image, list(n ORDER BY g) AS h, sum(n) AS px FROM (SELECT i.image, g, coalesce(n, 0)::DOUBLE AS n FROM (SELECT DISTINCT image FROM c) i CROSS JOIN (SELECT unnest(range(256))::INT AS g) x LEFT JOIN c ON c.image = i.image AND c.gray = g) GROUP BY image),
s AS (SELECT image, h, px, list_transform(range(256), lambda g: list_sum(list_transform(range(-8, 9), lambda d: ({[*V.kernel()]}::DOUBLE[])[d + 9] * h[greatest(0, least(255, g + d)) + 1]))) AS s FROM h),
r AS (SELECT image, h, px, s, g, s[g + 1] AS c FROM s CROSS JOIN (SELECT unnest(range(3, 253))::INT AS g)),
k AS (SELECT image, g AS gray, list_sum(h[greatest(0, g - 4) + 1:least(255, g + 4) + 1]) / px AS support, greatest(0, c - greatest(list_min(s{SIDE[0].format(r=16)}), list_min(s{SIDE[1].format(r=16)}))) / c AS prominence, c / px AS density FROM r
 WHERE c > 0 AND c >= list_max(s{SIDE[0].format(r=3)}) AND c >= list_max(s{SIDE[1].format(r=3)}) AND (c > list_min(s{SIDE[0].format(r=3)}) OR c > list_min(s{SIDE[1].format(r=3)}))),
q AS (SELECT *, support >= 0.001 AND prominence >= 0.08 AND density >= 0.0001 AS qualified FROM k)
SELECT image, gray, round(support, 6) AS support, round(prominence, 6) AS prominence, round(density, 6) AS density, qualified, coalesce(gray = min(gray) FILTER (qualified) OVER (PARTITION BY image), false) AS anchor FROM q""")
def dark_peaks(spark, sf_dir):
    return V.dark_peaks(table(spark, sf_dir, "lineitem").selectExpr("l_returnflag || l_linestatus AS image", "(int(l_quantity) * int(round(l_discount * 100))) % 256 AS gray"))


@query("""WITH i AS (SELECT conv_id AS context, CASE WHEN conv_id % 9 = 4 THEN 0 ELSE turn END AS item, repeat(coalesce(text, ''), CASE WHEN conv_id % 5 = 0 THEN 200 ELSE 1 END) AS text FROM conversations), g AS (SELECT context, item, count(*) AS n, sum(length(text)) AS c FROM i GROUP BY ALL)
SELECT context, sum(n)::BIGINT AS items, sum(c)::BIGINT AS chars, CASE WHEN max(n) > 1 THEN 'repeated_ids' WHEN sum(n) > 100 THEN 'too_many_items' WHEN sum(c) > 60000 THEN 'too_large' ELSE 'ok' END AS verdict FROM g GROUP BY context""")
def context_check(spark, sf_dir):
    items = table(spark, sf_dir, "conversations").selectExpr("conv_id AS context", "CASE WHEN conv_id % 9 = 4 THEN 0 ELSE turn END AS item", "repeat(coalesce(text, ''), CASE WHEN conv_id % 5 = 0 THEN 200 ELSE 1 END) AS text")
    return V.context_check(items)


def prints(source: str) -> str:
    return f"SELECT doc_id, count(*) AS n_nodes, sum(('0x' || substr(sha256(concat_ws(chr(31), node, coalesce(parent_node, 'None'), kind, coalesce(level::VARCHAR, 'None'), ord::VARCHAR)), 1, 12))::BIGINT)::HUGEINT::VARCHAR AS print FROM {source} GROUP BY doc_id"


@query(f"WITH {NODES} {prints('nodes')}")
def graph_fingerprint(spark, sf_dir):
    return V.fingerprint(G.nodes(T.heading_tree(groups_of(spark, sf_dir))))


@query(f"""WITH {NODES}, old AS ({prints('nodes')}), came AS (SELECT * REPLACE (CASE WHEN doc_id % 5 = 1 THEN coalesce(level, 0) + 1 ELSE level END AS level) FROM nodes), new AS ({prints('came')})
SELECT n.doc_id, CASE WHEN o.print IS NULL THEN 'created' WHEN o.print = n.print THEN 'existing' ELSE 'conflict' END AS outcome FROM new n LEFT JOIN (SELECT * FROM old WHERE doc_id % 3 <> 0) o USING (doc_id)""")
def candidate_create(spark, sf_dir):
    n = G.nodes(T.heading_tree(groups_of(spark, sf_dir)))
    return V.create_outcome(n.where("doc_id % 3 <> 0"), n.withColumn("level", F.expr("CASE WHEN doc_id % 5 = 1 THEN coalesce(level, 0) + 1 ELSE level END")))


@query(f"WITH {OUTLINE} SELECT doc_id, line_no, level FROM outline WHERE line_no = 1 AND level <> 1")
def title_rule(spark, sf_dir):
    assigned = T.assignments(lines_of(spark, sf_dir)).withColumn("kind", F.when(F.col("line_no") == 1, "title").otherwise(F.col("kind")))
    return V.title_demotions(assigned, R.outline_vote(outline_votes_of(spark, sf_dir)))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 < 4 THEN sha256(text) END AS sha, CASE WHEN text IS NOT NULL THEN CASE doc_id % 5 WHEN 1 THEN 'utf-8-sig' WHEN 2 THEN 'utf-16' WHEN 3 THEN 'utf-16' ELSE 'utf-8' END END AS encoding, CASE WHEN text IS NULL THEN 'missing' WHEN doc_id % 5 = 4 THEN 'nul' END AS error FROM documents""")
def decoded_text(spark, sf_dir):
    raw = F.expr("CASE doc_id % 5 WHEN 1 THEN concat(unhex('EFBBBF'), encode(text, 'UTF-8')) WHEN 2 THEN concat(unhex('FFFE'), encode(text, 'UTF-16LE')) WHEN 3 THEN concat(unhex('FEFF'), encode(text, 'UTF-16BE')) WHEN 4 THEN concat(unhex('00'), encode(text, 'UTF-8')) ELSE encode(text, 'UTF-8') END")
    read = table(prepare(spark), sf_dir, "documents").select("doc_id", P.decoded(raw).alias("d"))
    return read.select("doc_id", F.sha2("d.text", 256).alias("sha"), "d.encoding", "d.error")


@query("""SELECT event_id, '{"a":"' || event_type || '","k":' || replace(props, ' ', '') || ',"m":[1,{"Token":' || event_id % 3 || ',"b":null}],"z":' || user_id || '}' AS json, 'Token' AS unsafe FROM events""")
def canonical_payloads(spark, sf_dir):
    payload = F.concat(F.lit('{ "z": '), "user_id", F.lit(', "a": "'), "event_type", F.lit('", "m": [1, {"Token": '), F.expr("event_id % 3"), F.lit(', "b": null}], "k": '), "props", F.lit("}"))
    read = table(prepare(spark), sf_dir, "events").select("event_id", P.canonical_json(payload).alias("c"))
    return read.select("event_id", "c.json", F.array_join("c.unsafe", ",").alias("unsafe"))


@query("""WITH p AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'bad' ELSE 'src_' || substr(sha256(url || page_id), 1, 32) END AS ref, html FROM pages)
SELECT ref, strlen(html)::BIGINT AS bytes, CASE WHEN page_id % 7 = 0 THEN 'bad_reference' WHEN page_id % 5 = 1 THEN 'mismatch' WHEN page_id % 2 = 1 THEN 'stored' WHEN page_id % 6 = 0 THEN 'exists' ELSE 'same' END AS outcome FROM p""")
def object_put(spark, sf_dir):
    p = table(spark, sf_dir, "pages").selectExpr("page_id", "CASE WHEN page_id % 7 = 0 THEN 'bad' ELSE concat('src_', substr(sha2(concat(url, page_id), 256), 1, 32)) END AS ref", "html")
    held = p.where("page_id % 2 = 0 AND page_id % 7 <> 0").selectExpr("ref", "cast(CASE WHEN page_id % 6 = 0 THEN concat(html, 'x') ELSE html END AS binary) AS content")
    came = p.selectExpr("ref", "cast(html AS binary) AS content", "CASE WHEN page_id % 5 = 1 THEN octet_length(html) + 1 END AS expected_size", "sha2(html, 256) AS expected_sha")
    return P.put_outcome(held, came)


# The other modules of queries register theirs here.
from folioweave import catalog_graph, catalog_pages, catalog_reader, catalog_recovery  # noqa: E402, F401
