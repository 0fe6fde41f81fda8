"""Queries of gates, graph issues, stored candidates, selections, runs, grants and patches, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.catalog import LINES, NODES, groups_of, lines_of, query
from folioweave.operators import gates as K
from folioweave.operators import graph as G
from folioweave.operators import integrity as I
from folioweave.operators import patches as Z
from folioweave.operators import text as T
from folioweave.session import scratch_path, table

KEYS = "l_orderkey, l_linenumber"


def measures(spark: SparkSession, sf_dir: str, features: dict[str, tuple[str, int]]) -> DataFrame:
    """Measures of pages made of the columns of ``lineitem``: whole numbers over a scale."""
    t = table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", *((F.expr(x).cast("double") / scale).alias(name) for name, (x, scale) in features.items()))


def measures_sql(features: dict[str, tuple[str, int]]) -> str:
    return f"m AS (SELECT {KEYS}, " + ", ".join(f"({x})::DOUBLE / {scale} AS {name}" for name, (x, scale) in features.items()) + " FROM lineitem)"


def pair(prefix: str) -> F.Column:
    return F.struct(*(F.col(f"{prefix}_{x}").alias(x) for x in ("edges", "dark", "lines", "white", "std", "range")))


IMAGES = {
    "b_edges": ("l_partkey % 40", 200), "a_edges": ("l_partkey % 40 + l_suppkey % 21 - 10", 200), "b_dark": ("l_orderkey % 30", 100), "a_dark": ("l_orderkey % 30 + l_suppkey % 9", 100),
    "b_lines": ("l_linenumber * 3", 1), "a_lines": ("l_linenumber * 2 + l_suppkey % 5", 1), "b_white": ("70 + l_partkey % 20", 100), "a_white": ("70 + l_suppkey % 31", 100),
    "b_std": ("l_partkey % 90", 10), "a_std": ("l_suppkey % 90", 10), "b_range": ("l_partkey % 120", 5), "a_range": ("l_suppkey % 110", 5), "retention": ("50 + l_orderkey % 50", 100),
    "perspective": ("l_partkey % 3", 2), "distortion": ("l_suppkey % 14", 1000), "deskew": ("l_orderkey % 3", 2), "angle": ("l_partkey % 300 - 150", 100), "residual": ("l_suppkey % 200 - 100", 100), "confidence": ("l_orderkey % 100", 100),
}
SAFE = "(CASE WHEN b_edges <= 1e-9 THEN CASE WHEN a_edges <= 1e-9 THEN 1.0 ELSE 10.0 END ELSE a_edges / b_edges END BETWEEN {} AND {} AND a_dark <= greatest(b_dark * 1.70::DOUBLE, b_dark + 0.025::DOUBLE) AND (b_lines < 5 OR a_lines >= floor(b_lines * {}::DOUBLE)))"


@query(f"""WITH {measures_sql(IMAGES)}, g AS (SELECT *, {SAFE.format(0.55, 1.65, 0.5)} AS safe, perspective >= 1 AS p, deskew >= 1 AS d, (deskew < 1 OR abs(residual) <= 0.12::DOUBLE OR abs(residual) + 0.05::DOUBLE < abs(angle) OR confidence < 0.20::DOUBLE) AS better FROM m)
SELECT {KEYS}, CASE WHEN NOT p AND NOT d THEN 'geometry_not_required' WHEN safe AND ((p AND distortion >= 0.006::DOUBLE) OR (d AND better)) THEN 'accepted' WHEN NOT safe THEN 'content_guard_rejected' WHEN d AND NOT better THEN 'deskew_not_improved' ELSE 'geometry_not_material' END AS reason FROM g""")
def geometry_gate(spark, sf_dir):
    d = F.struct((F.col("perspective") >= 1).alias("perspective"), "distortion", (F.col("deskew") >= 1).alias("deskew"), "angle", "residual", "confidence")
    return measures(spark, sf_dir, IMAGES).select("l_orderkey", "l_linenumber", K.geometry_gate(pair("b"), pair("a"), d).alias("reason"))


@query(f"""WITH {measures_sql(IMAGES)}, g AS (SELECT *, retention >= 0.70::DOUBLE AND {SAFE.format(0.6, 1.45, 0.6)} AND NOT (a_white > 0.985::DOUBLE AND b_white < 0.80::DOUBLE) AS safe,
 ((a_std <= b_std * 0.92::DOUBLE AND b_std - a_std >= 0.40::DOUBLE) OR (a_range <= b_range * 0.90::DOUBLE AND b_range - a_range >= 2) OR a_white >= b_white + 0.02::DOUBLE) AS better FROM m)
SELECT {KEYS}, CASE WHEN safe AND better THEN 'accepted' WHEN NOT safe THEN 'content_guard_rejected' ELSE 'no_material_background_improvement' END AS reason FROM g""")
def background_gate(spark, sf_dir):
    return measures(spark, sf_dir, IMAGES).select("l_orderkey", "l_linenumber", K.background_gate(pair("b"), pair("a"), F.col("retention")).alias("reason"))


CROPS = {"shape": ("l_partkey % 11", 1), "edges": ("l_partkey % 130", 1), "retention": ("l_suppkey % 30", 100), "ink": ("l_orderkey % 9", 1000), "ink_after": ("l_suppkey % 5", 2000), "std": ("l_partkey % 12", 1), "std_after": ("l_suppkey % 16", 3)}


@query(f"""WITH {measures_sql(CROPS)} SELECT {KEYS}, CASE WHEN shape = 0 THEN 'dimension_mismatch' WHEN std_after < 2 AND (std >= 6 OR ink >= 0.003::DOUBLE OR edges >= 64) THEN 'near_blank_or_solid_output'
WHEN edges >= 64 AND ink >= 0.003::DOUBLE AND retention < 0.12::DOUBLE AND CASE WHEN ink <= 1e-9 THEN 1 ELSE ink_after / ink END < 0.12::DOUBLE THEN 'catastrophic_combined_content_loss' ELSE 'catastrophic_gate_passed' END AS reason FROM m""")
def catastrophic_gate(spark, sf_dir):
    m = F.struct("edges", "retention", "ink", "ink_after", "std", "std_after")
    return measures(spark, sf_dir, CROPS).select("l_orderkey", "l_linenumber", K.catastrophic_gate(F.col("shape") != 0, m).alias("reason"))


REVIEWS = "l_orderkey, l_linenumber, CASE l_partkey % 5 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'reject' WHEN 2 THEN NULL ELSE 'accept' END AS decision, CASE WHEN l_suppkey % 7 > 0 THEN l_suppkey % 25 + 80 END AS c, l_orderkey % 6 > 0 AS improved, l_orderkey % 5 > 0 AS preserved, l_partkey % 8 = 0 AS added, CASE WHEN l_partkey % 9 > 3 THEN l_partkey % 9 = 4 END AS removed"


@query(f"""SELECT {KEYS}, CASE WHEN c IS NULL THEN 'semantic_gate_invalid_confidence' WHEN decision = 'uncertain' THEN 'semantic_gate_uncertain' WHEN decision IS DISTINCT FROM 'accept' THEN 'semantic_gate_rejected' WHEN c < 90 THEN 'semantic_gate_low_confidence'
WHEN NOT improved OR NOT preserved OR added OR coalesce(removed, false) THEN 'semantic_gate_integrity_flags_failed' ELSE 'semantic_gate_accepted' END AS reason FROM (SELECT {REVIEWS} FROM lineitem)""")
def semantic_gate(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.expr(f"struct({REVIEWS})").alias("r")).select("r.*")
    return r.select("l_orderkey", "l_linenumber", K.semantic_gate(F.col("decision"), F.col("c") / 100.0, [F.col("improved"), F.col("preserved")], [F.col("added"), F.col("removed")]).alias("reason"))


SHARES = {"chars": ("l_partkey % 160", 1), "coverage": ("l_suppkey % 100", 100), "saturated": ("l_orderkey % 20", 100), "component": ("l_partkey % 50", 1000), "p90": ("60 + l_suppkey % 50", 1), "white": ("l_partkey % 100", 100), "joined": ("l_suppkey % 90", 100), "border": ("l_orderkey % 100", 100)}


@query(f"""WITH {measures_sql(SHARES)} SELECT {KEYS}, chars >= 80 AND coverage < 0.55::DOUBLE AS born_digital, saturated >= 0.12::DOUBLE OR (saturated >= 0.05::DOUBLE AND component >= 0.025::DOUBLE AND p90 >= 85) AS colour_critical, white >= 0.5 AND joined >= 0.45::DOUBLE AND border >= 0.8::DOUBLE AS clean_white FROM m""")
def page_gates(spark, sf_dir):
    c = F.col
    return measures(spark, sf_dir, SHARES).select("l_orderkey", "l_linenumber", K.born_digital(c("chars"), c("coverage")).alias("born_digital"), K.colour_critical(c("saturated"), c("component"), c("p90")).alias("colour_critical"), K.clean_white(c("white"), c("joined"), c("border")).alias("clean_white"))


LAYOUTS = {"chars": ("l_partkey % 1500", 1), "blocks": ("l_suppkey % 20", 1), "whitespace": ("l_orderkey % 100", 100), "coverage": ("l_partkey % 90", 100), "dominant": ("l_suppkey % 70", 100), "font_ratio": ("l_orderkey % 50", 10), "prose": ("l_partkey % 80", 100), "dispersion": ("l_suppkey % 50", 100), "orientation": ("(l_orderkey % 5) * 90", 1), "confidence": ("80 + l_suppkey % 20", 100), "n_lines": ("l_orderkey % 40", 1), "role": ("l_partkey % 8", 1)}
ROLE = "CASE role WHEN 0 THEN 'cover' WHEN 1 THEN 'back_cover' WHEN 2 THEN 'title_page' WHEN 3 THEN 'chapter_divider' WHEN 4 THEN 'full_page_figure' WHEN 5 THEN 'full_page_chart' WHEN 6 THEN 'body' END"


@query(f"""WITH {measures_sql(LAYOUTS)}, r AS (SELECT {KEYS}, list_filter([CASE WHEN l_linenumber = 1 THEN 'first_physical_page' END, CASE WHEN l_linenumber = 7 THEN 'last_physical_page' END, CASE WHEN chars <= 240 AND blocks <= 8 AND whitespace >= 0.45::DOUBLE THEN 'sparse_text_high_whitespace' END,
 CASE WHEN coverage >= 0.55::DOUBLE OR dominant >= 0.48::DOUBLE THEN 'dominant_visual_region' END, CASE WHEN font_ratio >= 2 AND prose <= 0.35::DOUBLE THEN 'large_title_low_prose' END, CASE WHEN dispersion >= 0.25 AND prose <= 0.35::DOUBLE THEN 'dispersed_non_body_layout' END, CASE WHEN orientation IN (90, 180, 270) THEN 'discrete_orientation' END], lambda x: x IS NOT NULL) AS rs,
 CASE WHEN {ROLE} IS NULL OR {ROLE} = 'body' THEN 'role_not_presentation' WHEN confidence < 0.9::DOUBLE THEN 'classification_below_confidence_threshold' WHEN prose >= 0.55::DOUBLE OR (chars >= 1200 AND n_lines >= 18) THEN 'local_continuous_prose_conflict' ELSE 'presentation_page_confirmed' END AS routing FROM m)
SELECT {KEYS}, array_to_string(rs, ',') AS reasons, len(rs) > 0 AS candidate, routing FROM r""")
def presentation_pages(spark, sf_dir):
    m = measures(spark, sf_dir, LAYOUTS)
    names = ("chars", "blocks", "whitespace", "coverage", "dominant", "font_ratio", "prose", "dispersion", "orientation")
    reasons = K.presentation_reasons({k: F.col(k) for k in names}, F.col("l_linenumber") == 1, F.col("l_linenumber") == 7)
    routing = K.skip_reading(F.expr(ROLE), F.col("confidence"), F.col("prose"), F.col("chars"), F.col("n_lines"))
    return m.select("l_orderkey", "l_linenumber", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) > 0).alias("candidate"), routing.alias("routing"))


# A graph with each kind of damage, by the remainder of the document's id.
def damaged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    d, n, o = F.col("doc_id") % 13, F.col("line_no"), F.col("ord")
    lines = lines_of(spark, sf_dir).where("text <> ''")
    unit = F.concat(F.lit("u"), F.expr("(line_no - 1) div 50"))
    units = lines.select("doc_id", unit.alias("unit"), F.expr("(line_no - 1) div 50").alias("source_order")).distinct()
    units = units.unionByName(units.where((d == 1) & (F.col("unit") == "u0")))
    own, ev = F.concat(F.lit("o"), n), F.concat(F.lit("e"), n)
    observations = lines.select("doc_id", own.alias("observation"), F.when((d == 2) & (n == 1), "gone").otherwise(unit).alias("unit"), F.when((d == 3) & (n % 40 == 2), "u99").otherwise(F.when((d == 2) & (n == 1), "gone").otherwise(unit)).alias("anchor_unit"), F.array(F.when((d == 4) & (n == 1), "e0").otherwise(ev)).alias("evidences"))
    evidence = lines.select("doc_id", ev.alias("evidence"), F.when((d == 5) & (n == 1), "gone").otherwise(unit).alias("unit"), F.when((d == 6) & (n == 1), "o0").otherwise(own).alias("observation"))
    evidence = evidence.unionByName(evidence.where((d == 7) & (F.col("evidence") == "e1")))
    node = lambda k: T.node_id("n", F.col("doc_id"), F.lit(k))
    base = G.nodes(T.heading_tree(groups_of(spark, sf_dir)))
    parent = F.when((d == 8) & (o == 2), F.col("node")).when((d == 9) & (o == 2), "gone").when((d == 10) & (o == 1), node(2)).when((d == 10) & (o == 2), node(1)).otherwise(F.col("parent_node"))
    lits = lambda *v: F.array(*map(F.lit, v))
    nodes = base.select("doc_id", "node", parent.alias("parent_node"), F.when((d == 12) & (o == 1), lits("u0", "gone")).otherwise(lits("u0")).alias("units"), F.when((d == 0) & (o == 1), lits("u7")).otherwise(lits("u0")).alias("anchor_units"), F.when((d == 1) & (o == 1), lits("o1", "o-1")).otherwise(lits("o1")).alias("observations"), F.when((d == 2) & (o == 1), lits("e0")).otherwise(lits("e1")).alias("evidences"), "ord")
    return units, observations, nodes.unionByName(nodes.where((d == 11) & (o == 1))).drop("ord"), evidence


NODE = "'n_' || substr(sha256(doc_id || chr(31) || {}), 1, 24)"
DAMAGED = NODES.replace("books AS", "RECURSIVE books AS", 1) + f""",
full_lines AS (SELECT doc_id, line_no, doc_id % 13 AS d, 'u' || ((line_no - 1) // 50) AS unit FROM lines WHERE text <> ''),
units0 AS (SELECT DISTINCT doc_id, d, unit, (line_no - 1) // 50 AS source_order FROM full_lines), units AS (SELECT * FROM units0 UNION ALL SELECT * FROM units0 WHERE d = 1 AND unit = 'u0'),
obs AS (SELECT doc_id, 'o' || line_no AS observation, CASE WHEN d = 2 AND line_no = 1 THEN 'gone' ELSE unit END AS unit, CASE WHEN d = 3 AND line_no % 40 = 2 THEN 'u99' WHEN d = 2 AND line_no = 1 THEN 'gone' ELSE unit END AS anchor_unit, CASE WHEN d = 4 AND line_no = 1 THEN 'e0' ELSE 'e' || line_no END AS ev FROM full_lines),
ev0 AS (SELECT doc_id, d, 'e' || line_no AS evidence, CASE WHEN d = 5 AND line_no = 1 THEN 'gone' ELSE unit END AS unit, CASE WHEN d = 6 AND line_no = 1 THEN 'o0' ELSE 'o' || line_no END AS observation FROM full_lines), evid AS (SELECT * FROM ev0 UNION ALL SELECT * FROM ev0 WHERE d = 7 AND evidence = 'e1'),
n0 AS (SELECT doc_id, doc_id % 13 AS d, ord, node, CASE WHEN doc_id % 13 = 8 AND ord = 2 THEN node WHEN doc_id % 13 = 9 AND ord = 2 THEN 'gone' WHEN doc_id % 13 = 10 AND ord = 1 THEN {NODE.format(2)} WHEN doc_id % 13 = 10 AND ord = 2 THEN {NODE.format(1)} ELSE parent_node END AS parent_node FROM nodes),
bad AS (SELECT * FROM n0 UNION ALL SELECT * FROM n0 WHERE d = 11 AND ord = 1),
top AS (SELECT DISTINCT doc_id, node FROM n0 WHERE parent_node IS NULL OR parent_node = node OR (doc_id, parent_node) NOT IN (SELECT (doc_id, node) FROM n0)),
reached AS (SELECT doc_id, node FROM top UNION SELECT n0.doc_id, n0.node FROM n0 JOIN reached r ON n0.doc_id = r.doc_id AND n0.parent_node = r.node)"""


@query(f"""WITH {DAMAGED}, i AS (
 SELECT doc_id, 'duplicate_unit' AS code FROM units GROUP BY doc_id, unit HAVING count(*) > 1 UNION ALL SELECT doc_id, 'duplicate_source_order' FROM units GROUP BY doc_id, source_order HAVING count(*) > 1
 UNION ALL SELECT doc_id, 'duplicate_observation' FROM obs GROUP BY doc_id, observation HAVING count(*) > 1 UNION ALL SELECT doc_id, 'duplicate_node' FROM bad GROUP BY doc_id, node HAVING count(*) > 1 UNION ALL SELECT doc_id, 'duplicate_evidence' FROM evid GROUP BY doc_id, evidence HAVING count(*) > 1
 UNION ALL SELECT doc_id, 'observation_unit_missing' FROM obs ANTI JOIN units USING (doc_id, unit) UNION ALL SELECT o.doc_id, 'observation_evidence_missing' FROM obs o WHERE NOT EXISTS (FROM evid e WHERE e.doc_id = o.doc_id AND e.evidence = o.ev) UNION ALL SELECT doc_id, 'observation_anchor_outside' FROM obs WHERE anchor_unit <> unit
 UNION ALL SELECT doc_id, 'node_unit_missing' FROM bad WHERE d = 12 AND ord = 1 UNION ALL SELECT doc_id, 'node_observation_missing' FROM bad WHERE d = 1 AND ord = 1 UNION ALL SELECT doc_id, 'node_evidence_missing' FROM bad WHERE d = 2 AND ord = 1 UNION ALL SELECT doc_id, 'node_anchor_outside' FROM bad WHERE d = 0 AND ord = 1
 UNION ALL SELECT b.doc_id, 'parent_missing' FROM bad b WHERE parent_node <> node AND NOT EXISTS (FROM n0 WHERE n0.doc_id = b.doc_id AND n0.node = b.parent_node) UNION ALL SELECT doc_id, 'self_parent' FROM bad WHERE parent_node = node
 UNION ALL SELECT doc_id, 'cycle' FROM (SELECT DISTINCT doc_id, node FROM n0) ANTI JOIN reached USING (doc_id, node)
 UNION ALL SELECT doc_id, 'evidence_unit_missing' FROM evid ANTI JOIN units USING (doc_id, unit) UNION ALL SELECT doc_id, 'evidence_observation_missing' FROM evid ANTI JOIN obs USING (doc_id, observation))
SELECT doc_id, code, count(*) AS issues FROM i GROUP BY ALL""")
def graph_codes(spark, sf_dir):
    return I.graph_codes(*damaged(spark, sf_dir))


CHAIN_SQL = LINES.replace("books AS", "RECURSIVE books AS", 1) + """,
walk AS (SELECT doc_id, line_no AS node, 0::BIGINT AS depth FROM lines WHERE line_no = 1 UNION ALL SELECT l.doc_id, l.line_no, w.depth + 1 FROM lines l JOIN walk w ON l.doc_id = w.doc_id AND w.node = l.line_no - 1 - (l.line_no % 3 = 0 AND l.line_no > 2)::INT)"""


@query(f"WITH {CHAIN_SQL} SELECT doc_id, node, depth FROM walk")
def chain_depths(spark, sf_dir):
    n = F.col("line_no")
    return G.depths(lines_of(spark, sf_dir).select("doc_id", n.alias("node"), F.when(n > 1, n - 1 - ((n % 3 == 0) & (n > 2)).cast("long")).alias("parent_node")))


@query(f"""WITH {NODES}, g AS (SELECT doc_id, ord, kind, level, parent FROM (SELECT doc_id, group_no AS ord, kind, level, parent FROM tree)), own AS (SELECT doc_id, group_no AS ord, list(line_no ORDER BY line_no) AS lines FROM numbered GROUP BY ALL)
SELECT doc_id, count(*) AS nodes, sum(len(lines))::BIGINT AS lines, sha256(string_agg(ord || ':' || kind || ':' || coalesce(level::VARCHAR, '') || ':' || coalesce(parent::VARCHAR, '') || ':' || array_to_string(lines, ' '), ';' ORDER BY ord)) AS digest FROM g JOIN own USING (doc_id, ord) GROUP BY doc_id""")
def stored_graph(spark, sf_dir):
    groups = groups_of(spark, sf_dir)
    nodes = T.heading_tree(groups).withColumnRenamed("group_no", "ord")
    owned = groups.select("doc_id", F.col("group_no").alias("ord"), F.posexplode(F.sequence("first_line", "last_line")).alias("place", "line_no"))
    folder = scratch_path(spark, "candidate")
    I.store(nodes, owned, folder)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    row = lambda x: F.concat_ws(":", text(x["ord"]), x["kind"], text(x["level"]), text(x["parent"]), F.array_join(F.transform(x["lines"], lambda y: y.cast("string")), " "))
    found = I.scan(spark, folder)
    return found.select("doc_id", F.size("nodes").cast("long").alias("nodes"), F.aggregate("nodes", F.lit(0).cast("long"), lambda a, x: a + F.size(x["lines"])).alias("lines"), F.sha2(F.array_join(F.transform("nodes", row), ";"), 256).alias("digest"))


CANDIDATES = "o_orderkey AS doc_id, 'c' || (o_orderkey % 997) AS candidate"
HELD = "o_orderkey AS doc_id, 'c' || (o_orderkey % 997 + o_custkey % 2) AS candidate, CASE o_custkey % 3 WHEN 0 THEN 'ingest' WHEN 1 THEN 'reprocess' ELSE 'user' END AS actor, o_custkey % 5 + 1 AS version"


@query(f"""WITH c AS (SELECT {CANDIDATES} FROM orders), s AS (SELECT {HELD} FROM orders WHERE o_custkey % 4 > 0), j AS (SELECT c.doc_id, c.candidate, s.candidate AS held, version, CASE WHEN s.candidate IS NULL THEN 'created' WHEN s.candidate = c.candidate THEN 'unchanged' WHEN actor <> 'user' THEN 'promoted' ELSE 'preserved' END AS disposition FROM c LEFT JOIN s USING (doc_id))
SELECT doc_id, candidate, disposition, CASE WHEN disposition IN ('created', 'promoted') THEN candidate ELSE held END AS selected, (coalesce(version, 0) + (disposition IN ('created', 'promoted'))::INT)::BIGINT AS version FROM j""")
def selection_disposition(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return I.disposition(orders.selectExpr("o_orderkey AS doc_id", "concat('c', o_orderkey % 997) AS candidate"), orders.where("o_custkey % 4 > 0").selectExpr("o_orderkey AS doc_id", "concat('c', o_orderkey % 997 + o_custkey % 2) AS candidate", "CASE o_custkey % 3 WHEN 0 THEN 'ingest' WHEN 1 THEN 'reprocess' ELSE 'user' END AS actor", "cast(o_custkey % 5 + 1 AS bigint) AS version"))


@query("""WITH c AS (SELECT o_orderkey AS candidate, o_orderkey % 50 AS owner, o_orderstatus AS state FROM orders), s AS (SELECT l_orderkey % 50 + (l_partkey % 9 = 0)::INT AS doc_id, l_orderkey + (l_suppkey % 11 = 0)::INT * 100000000 AS candidate, l_orderkey + (l_suppkey % 7 = 0)::INT AS asked FROM lineitem)
SELECT doc_id, candidate, outcome, CASE WHEN outcome = 'ok' THEN state END AS state FROM (SELECT s.*, c.state, CASE WHEN owner IS NULL THEN 'candidate_missing' WHEN owner <> doc_id THEN 'candidate_mismatch' WHEN asked <> candidate THEN 'selection_changed' ELSE 'ok' END AS outcome FROM s LEFT JOIN c USING (candidate))""")
def selected_candidate(spark, sf_dir):
    c = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS candidate", "o_orderkey % 50 AS doc_id", "o_orderstatus AS state")
    s = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 50 + cast(l_partkey % 9 = 0 AS int) AS doc_id", "l_orderkey + cast(l_suppkey % 11 = 0 AS int) * 100000000 AS candidate", "l_orderkey + cast(l_suppkey % 7 = 0 AS int) AS asked")
    return I.selected(c, s, F.col("asked"))


@query("""WITH a AS (SELECT event_id AS pos, event_id % 4000 AS run, event_id % 40 AS doc_id, CASE WHEN event_id % 4000 % 3 > 0 THEN event_id % 4000 % 700 END AS key, CASE WHEN event_id % 12000 < 8000 THEN 'a' ELSE 'b' END AS payload FROM events),
f AS (SELECT *, row_number() OVER w > 1 AS again, first({'doc_id': doc_id, 'key': key, 'payload': payload}) OVER w AS fst FROM a WINDOW w AS (PARTITION BY run ORDER BY pos)),
k AS (SELECT *, row_number() OVER w > 1 AS again2, first({'run': run, 'payload': payload}) OVER w AS fst2 FROM f WHERE NOT again AND key IS NOT NULL WINDOW w AS (PARTITION BY doc_id, key ORDER BY pos))
SELECT pos, run, doc_id, CASE WHEN NOT again THEN 'created' WHEN fst = {'doc_id': doc_id, 'key': key, 'payload': payload} OR (fst.key IS NULL AND key IS NULL AND fst.doc_id = doc_id AND fst.payload = payload) THEN 'idempotent' ELSE 'conflict' END AS outcome FROM f WHERE again OR key IS NULL
UNION ALL SELECT pos, run, doc_id, CASE WHEN NOT again2 THEN 'created' WHEN fst2 = {'run': run, 'payload': payload} THEN 'idempotent' ELSE 'conflict' END FROM k""")
def run_creation(spark, sf_dir):
    asked = table(spark, sf_dir, "events").selectExpr("event_id AS pos", "event_id % 4000 AS run", "event_id % 40 AS doc_id", "CASE WHEN event_id % 4000 % 3 > 0 THEN event_id % 4000 % 700 END AS key", "CASE WHEN event_id % 12000 < 8000 THEN 'a' ELSE 'b' END AS payload")
    return I.create_runs(asked)


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place FROM events WHERE event_type = 'signup'")
def run_list(spark, sf_dir):
    return I.listed(table(spark, sf_dir, "events").where("event_type = 'signup'"), "user_id", "ts", "event_id").select("user_id", "event_id", "place")


@query("""WITH n AS (SELECT *, sum((event_type = 'click')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events),
s AS (SELECT *, first(CASE WHEN event_type = 'click' THEN ts END) OVER w AS granted, max((event_type = 'error')::INT) OVER w AS revoked, sum((event_type = 'view')::INT) OVER w AS used FROM n WINDOW w AS (PARTITION BY user_id, g ORDER BY ts, event_id))
SELECT event_id, user_id, g::BIGINT AS "grant", CASE WHEN g = 0 THEN 'not_found' WHEN revoked = 1 THEN 'revoked' WHEN ts >= granted + INTERVAL 3 DAY THEN 'expired' WHEN used > 1 THEN 'exhausted' ELSE 'authorized' END AS outcome FROM s WHERE event_type = 'view'""")
def grant_lifecycle(spark, sf_dir):
    what = F.when(F.col("event_type") == "click", "grant").when(F.col("event_type") == "error", "revoke").when(F.col("event_type") == "view", "retrieve")
    return I.grants(table(spark, sf_dir, "events").withColumn("what", what), most=1, minutes=3 * 24 * 60)


REVIEWED = NODES + """,
given AS (SELECT doc_id, node, ord, CASE WHEN ord % 5 = 0 THEN 'unknown' WHEN ord % 7 = 0 THEN 'list_item' ELSE kind END AS kind, level, parent_node, 'text ' || ord AS text, CASE WHEN ord % 6 = 0 THEN 'degraded' ELSE 'complete' END AS state, CASE WHEN ord % 4 > 0 THEN (ord % 10) / 10.0::DOUBLE END AS ocr, ord % 3 = 0 AS split FROM nodes)"""
OPS = (
    ("ord % 2 = 0", "20", "set_toc_level", "NULL", "1 + ord % 4", "NULL", "80 + ord % 15"),
    ("ord % 3 <> 1", "21", "reclassify_node", "CASE ord % 4 WHEN 0 THEN 'heading' WHEN 1 THEN 'list_item' WHEN 2 THEN 'title' ELSE 'paragraph' END", "CASE WHEN ord % 8 = 0 THEN 3 END", "NULL", "86 + ord % 9"),
    ("ord % 4 = 1", "22", "set_parent", "CASE ord % 3 WHEN 0 THEN node WHEN 1 THEN 'gone' END", "NULL", "NULL", "88 + ord % 7"),
    ("ord % 9 = 4", "23", "suppress_as_artifact", "NULL", "NULL", "NULL", "89 + ord % 5"),
    ("ord % 5 > 1", "24", "correct_text", "concat('new ', ord)", "NULL", "CASE WHEN ord % 11 > 0 THEN concat('text ', ord) ELSE 'other' END", "88 + ord % 8"),
    ("ord % 6 = 1", "25", "add_warning", "'look'", "NULL", "NULL", "85 + ord % 10"),
    ("ord % 7 = 2", "26", "reclassify_node", "'unknown'", "NULL", "NULL", "95"),
    ("ord % 2 = 1", "27", "set_toc_level", "NULL", "2", "NULL", "90"),
)
OPS_OF = " UNION ALL ".join(f"SELECT doc_id, node, ord * 100 + {pos} AS pos, '{op}' AS op, {value} AS value, ({level})::INT AS level, {original} AS original, ({c})::DOUBLE / 100 AS confidence FROM given WHERE {when}" for when, pos, op, value, level, original, c in OPS)
ORDERED_OPS = REVIEWED + f""",
ops AS ({OPS_OF}), targets AS (SELECT doc_id, node FROM given WHERE kind = 'unknown' OR state = 'degraded'),
marked AS (SELECT o.*, min(CASE WHEN op = 'reclassify_node' THEN pos END) OVER (PARTITION BY o.doc_id, o.node) AS first, t.node IS NOT NULL AS target FROM ops o LEFT JOIN targets t USING (doc_id, node)),
steps AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN target AND op = 'set_toc_level' AND pos < first THEN first ELSE pos END, coalesce(target AND op = 'set_toc_level' AND pos < first, false), pos) - 1 AS step FROM marked)"""


def reviewed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, operations and nodes to review."""
    n = G.nodes(T.heading_tree(groups_of(spark, sf_dir)))
    given = n.selectExpr("doc_id", "node", "ord", "CASE WHEN ord % 5 = 0 THEN 'unknown' WHEN ord % 7 = 0 THEN 'list_item' ELSE kind END AS kind", "level", "parent_node", "concat('text ', ord) AS text", "CASE WHEN ord % 6 = 0 THEN 'degraded' ELSE 'complete' END AS state", "CASE WHEN ord % 4 > 0 THEN cast(ord % 10 AS double) / 10 END AS ocr", "ord % 3 = 0 AS split")
    each = F.array(*(F.when(F.expr(when), F.expr(f"named_struct('pos', ord * 100 + {pos}, 'op', '{op}', 'value', cast({value} AS string), 'level', cast({level} AS int), 'original', cast({original} AS string), 'confidence', cast({c} AS double) / 100)")) for when, pos, op, value, level, original, c in OPS))
    ops = given.select("doc_id", "node", F.explode(F.array_compact(each)).alias("o")).select("doc_id", "node", "o.*")
    return given, ops, Z.unresolved(given)


@query(f"WITH {REVIEWED} SELECT doc_id, node, array_to_string(list_filter([CASE WHEN kind = 'unknown' THEN 'unknown_kind' END, CASE WHEN state = 'degraded' THEN 'degraded_recovery_state' END], lambda x: x IS NOT NULL), ',') AS reasons FROM given WHERE kind = 'unknown' OR state = 'degraded'")
def unresolved_nodes(spark, sf_dir):
    return reviewed(spark, sf_dir)[2].select("doc_id", "node", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {ORDERED_OPS} SELECT doc_id, node, pos, op, step FROM steps")
def patch_order(spark, sf_dir):
    _, ops, targets = reviewed(spark, sf_dir)
    return Z.ordered(ops, targets).select("doc_id", "node", "pos", "op", "step")


DONE = "(x.outcome = 'applied' AND x.op = '{}')"
FOLDED = ORDERED_OPS.replace("books AS", "RECURSIVE books AS", 1) + """,
checked AS (SELECT s.doc_id, s.node, s.step, s.op, s.value, s.level AS new_level, s.original, s.confidence, s.value IS NULL OR k.node IS NOT NULL AS has_parent, row_number() OVER (PARTITION BY s.doc_id, s.node ORDER BY step) AS i FROM steps s LEFT JOIN given k ON k.doc_id = s.doc_id AND k.node = s.value),
fold AS (SELECT doc_id, node, 0::BIGINT AS i, kind, level::INT AS level, parent_node, text, NULL::INT AS toc_level, state, 0 AS warnings, NULL::BOOLEAN AS reclassified, ocr, NULL::VARCHAR AS op, NULL::VARCHAR AS value, NULL::VARCHAR AS outcome FROM given
 UNION ALL SELECT x.doc_id, x.node, x.i, CASE WHEN """ + DONE.format("reclassify_node") + " THEN x.value WHEN " + DONE.format("suppress_as_artifact") + " THEN 'unknown' ELSE x.kind END, CASE WHEN " + DONE.format("reclassify_node") + " THEN CASE x.value WHEN 'heading' THEN coalesce(x.new_level, x.level, 2) WHEN 'title' THEN x.new_level END WHEN " + DONE.format("suppress_as_artifact") + " THEN NULL ELSE x.level END, CASE WHEN " + DONE.format("set_parent") + " THEN x.value ELSE x.parent_node END, CASE WHEN " + DONE.format("correct_text") + " THEN x.value ELSE x.text END, CASE WHEN " + DONE.format("set_toc_level") + " THEN x.new_level ELSE x.toc_level END, CASE WHEN " + DONE.format("suppress_as_artifact") + " THEN 'degraded' ELSE x.state END, x.warnings + " + DONE.format("add_warning") + """::INT, CASE WHEN x.op = 'reclassify_node' THEN x.outcome = 'applied' ELSE x.reclassified END, x.ocr, x.op, x.value, x.outcome FROM
 (SELECT f.doc_id, f.node, f.kind, f.level, f.parent_node, f.text, f.toc_level, f.state, f.warnings, f.reclassified, f.ocr, c.i, c.op, c.value, c.new_level, CASE c.op WHEN 'correct_text' THEN CASE WHEN c.confidence <= 0.90::DOUBLE THEN 'model_confidence_not_strictly_above_threshold' WHEN f.ocr IS NULL THEN 'source_ocr_confidence_missing' WHEN f.ocr >= 0.80::DOUBLE THEN 'source_ocr_confidence_not_strictly_below_threshold' WHEN coalesce(f.text, '') IS DISTINCT FROM c.original THEN 'original_text_differs' ELSE 'applied' END
  WHEN 'set_toc_level' THEN CASE WHEN f.kind <> 'list_item' AND NOT coalesce(f.reclassified, true) THEN 'dependent_reclassification_not_applied' WHEN c.confidence < 0.85::DOUBLE THEN 'below_threshold' WHEN f.kind <> 'list_item' THEN 'not_a_list_item' ELSE 'applied' END
  ELSE CASE WHEN c.confidence < 0.90::DOUBLE THEN 'below_threshold' WHEN c.op = 'set_parent' AND c.value = f.node THEN 'own_parent' WHEN c.op = 'set_parent' AND NOT c.has_parent THEN 'parent_missing' ELSE 'applied' END END AS outcome
  FROM fold f JOIN checked c ON c.doc_id = f.doc_id AND c.node = f.node AND c.i = f.i + 1) x),
after AS (SELECT f.*, log FROM fold f JOIN (SELECT doc_id, node, max(i) AS i, coalesce(string_agg(op || ':' || outcome, ',' ORDER BY i) FILTER (i > 0), '') AS log FROM fold GROUP BY ALL) USING (doc_id, node, i))"""


@query(f"WITH {FOLDED} SELECT doc_id, node, kind, level, parent_node, text, toc_level, state, warnings, log FROM after")
def patch_fold(spark, sf_dir):
    given, ops, targets = reviewed(spark, sf_dir)
    after = Z.applied(given, Z.ordered(ops, targets))
    return after.withColumn("log", F.array_join(F.transform("log", lambda x: F.concat_ws(":", x["op"], x["outcome"])), ","))


@query(f"""WITH {FOLDED}, r AS (SELECT doc_id, node, bool_or(op = 'reclassify_node' AND outcome = 'applied' AND value <> 'unknown') AS resolved FROM fold GROUP BY ALL)
SELECT g.doc_id, g.node, coalesce(resolved, false) AS resolved, CASE WHEN resolved AND split THEN 'complete' WHEN resolved THEN g.state ELSE a.state END AS state FROM given g JOIN r USING (doc_id, node) JOIN after a ON a.doc_id = g.doc_id AND a.node = g.node WHERE g.kind = 'unknown' OR g.state = 'degraded'""")
def patch_finalized(spark, sf_dir):
    given, ops, targets = reviewed(spark, sf_dir)
    before = given.join(targets.select("doc_id", "node"), ["doc_id", "node"], "left_semi")
    return Z.finalized(before, Z.applied(given, Z.ordered(ops, targets)))


@query(f"""WITH {ORDERED_OPS}, a AS (SELECT doc_id, node, count(*) AS n FROM ops WHERE op IN ('reclassify_node', 'suppress_as_artifact') GROUP BY ALL)
SELECT * FROM (SELECT coalesce(t.doc_id, a.doc_id) AS doc_id, coalesce(t.node, a.node) AS node, CASE WHEN t.node IS NULL THEN 'outside_scope' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' END AS issue FROM targets t FULL JOIN a ON a.doc_id = t.doc_id AND a.node = t.node) WHERE issue IS NOT NULL""")
def patch_coverage(spark, sf_dir):
    _, ops, targets = reviewed(spark, sf_dir)
    return Z.coverage(targets, ops.where("op IN ('reclassify_node', 'suppress_as_artifact')"))
