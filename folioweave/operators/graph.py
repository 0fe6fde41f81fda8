"""Document graphs: order, validation, recovery states, refinement patches and reader queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.operators.text import node_id
from folioweave.session import materialize

# Review reasons by priority, thresholds, page and batch sizes.
REASONS = ("first_page", "last_page", "heading", "unknown", "degraded", "low_ocr")
LOW_OCR, STRUCTURE_CONFIDENCE, TOC_CONFIDENCE = 0.80, 0.90, 0.85
BATCH = 16
COVER_NODES, COVER_CHARS = 8, 160


def nodes(tree: DataFrame) -> DataFrame:
    """Nodes with hashed ids from a tree of groups: (doc_id, node, parent_node, kind, level, ord)."""
    ident = lambda c: node_id("n", F.col("doc_id"), F.col(c))
    return tree.select("doc_id", ident("group_no").alias("node"), F.when(F.col("parent").isNotNull(), ident("parent")).alias("parent_node"), "kind", "level", F.col("group_no").alias("ord"))


def sibling_order(n: DataFrame) -> DataFrame:
    """Dense order from 0 under each parent; roots are siblings of each other."""
    w = Window.partitionBy("doc_id", F.coalesce("parent_node", F.lit("<root>"))).orderBy("ord", "node")
    return n.withColumn("sibling", (F.row_number().over(w) - 1).cast("long"))


def preorder(tree: DataFrame) -> DataFrame:
    """Depth and preorder place of the nodes of a heading tree, by one window.

    A parent there is always the latest open heading, so preorder is the order of the groups; a heading of level k is open
    where none of a lower or equal level came after it, so a node's depth is the number of levels that are open for it.
    """
    w = Window.partitionBy("doc_id").orderBy("group_no").rowsBetween(Window.unboundedPreceding, -1)
    heads, level = F.col("kind").isin("title", "heading"), F.coalesce("level", F.lit(1))
    last = [F.max(F.when(heads & (level == k), F.col("group_no"))).over(w) for k in range(1, 7)]
    seen = tree.select("*", *(x.alias(f"last{k}") for k, x in enumerate(last, 1)))
    own, depth = F.when(heads, level).otherwise(7), F.lit(0)
    for k in range(1, 7):
        lower = F.greatest(F.lit(-1), *(F.coalesce(F.col(f"last{j}"), F.lit(-1)) for j in range(1, k)), F.lit(-1))
        depth = depth + ((own > k) & F.col(f"last{k}").isNotNull() & (F.col(f"last{k}") > lower)).cast("long")
    # An item of an open list is one deeper than the list, which is no heading.
    depth = depth + ((F.col("kind") == "list_item") & F.col("parent").isNotNull() & (F.col("parent") > F.greatest(F.lit(-1), *(F.coalesce(F.col(f"last{k}"), F.lit(-1)) for k in range(1, 7))))).cast("long")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("group_no")) - 1
    return seen.select("doc_id", "group_no", depth.alias("depth"), place.cast("long").alias("node_order"))


def depths(n: DataFrame, most_rounds: int = 64) -> DataFrame:
    """Rows (doc_id, node, depth) for parents of any kind and depth; null where a node's way up does not end (a cycle).

    Pointers are doubled: each round joins a node's farthest known ancestor with that one's, so a depth of d takes log2 d
    rounds, each written. A parent that is missing ends the way. A chain of n nodes ends after log2 n rounds; what still
    moves then is on or under a cycle.
    """
    ids = n.select("doc_id", "node").distinct()
    found = ids.select("doc_id", F.col("node").alias("parent_node"), F.lit(True).alias("is_there"))
    up = n.select("doc_id", "node", "parent_node").join(found, ["doc_id", "parent_node"], "left").select("doc_id", "node", F.when(F.col("is_there"), F.col("parent_node")).alias("far"))
    # Of a repeated id, the smallest parent counts.
    now = materialize(up.groupBy("doc_id", "node").agg(F.min("far").alias("far")).withColumn("depth", F.col("far").isNotNull().cast("long")), "depths")
    longest = now.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(min(most_rounds, max(1, int(longest).bit_length()))):
        if now.where("far IS NOT NULL").isEmpty():
            break
        far = now.select("doc_id", F.col("node").alias("far"), F.col("far").alias("farther"), F.col("depth").alias("more"))
        now = materialize(now.join(far, ["doc_id", "far"], "left").select("doc_id", "node", F.col("farther").alias("far"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "depths")
    return now.select("doc_id", "node", F.when(F.col("far").isNull(), F.col("depth")).alias("depth"))


def validate(n: DataFrame) -> DataFrame:
    """Violations by document and code: missing parents, self-parents, parents that come later, repeated ids."""
    par = n.select(F.col("doc_id").alias("d"), F.col("node").alias("p"), F.col("ord").alias("p_ord"))
    joined = n.where("parent_node IS NOT NULL").join(par, (F.col("doc_id") == F.col("d")) & (F.col("parent_node") == F.col("p")), "left")
    code = F.when(F.col("parent_node") == F.col("node"), "self_parent").when(F.col("p").isNull(), "missing_parent").when(F.col("p_ord") >= F.col("ord"), "order_inversion")
    links = joined.select("doc_id", code.alias("code")).where("code IS NOT NULL")
    twice = n.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id", F.lit("repeated_id").alias("code"))
    return links.unionByName(twice).groupBy("doc_id", "code").agg(F.count(F.lit(1)).alias("issues"))


def navigation(tree: DataFrame, lines: DataFrame) -> DataFrame:
    """Headings in order with label (or a fallback) and level."""
    first = tree.where("kind = 'heading'").join(lines.select("doc_id", F.col("line_no").alias("first_line"), "text"), ["doc_id", "first_line"])
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("group_no")) - 1
    return first.select("doc_id", order.cast("long").alias("nav_order"), F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.lit("Untitled heading")).alias("label"), F.coalesce("level", F.lit(1)).alias("level"))


def content_page(ordered: DataFrame, start: int, limit: int) -> DataFrame:
    """A page of each document's nodes from ``start``, with whether more follow."""
    total = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    return ordered.withColumn("total", total).where((F.col("node_order") >= start) & (F.col("node_order") < start + limit)).select("doc_id", "group_no", "node_order", (F.col("total") > start + limit).alias("has_more"))


def content_around(ordered: DataFrame, limit: int) -> DataFrame:
    """The start of the window that holds each node."""
    return ordered.select("doc_id", "group_no", (F.floor(F.col("node_order") / limit) * limit).cast("long").alias("window_start"))


def recovery_states(labels: DataFrame) -> Column:
    return F.when(F.col("toxic") == 1, "unavailable").when(F.col("quality") == 0, "degraded").otherwise("complete")


def recovery_summary(units: DataFrame, key: str) -> DataFrame:
    """State counts and the overall state of each group of units."""
    n = {s: F.count(F.when(F.col("state") == s, 1)) for s in ("complete", "degraded", "unavailable")}
    total = F.count(F.lit(1))
    overall = F.when(n["unavailable"] == total, "unavailable").when(n["complete"] == total, "complete").otherwise("degraded")
    return units.groupBy(key).agg(*(c.alias(f"n_{s}") for s, c in n.items()), overall.alias("state"))


def page_reasons(blocks: DataFrame) -> DataFrame:
    """Why each page is reviewed (sorted reasons), its priority, its place among the document's pages, its batch."""
    pages = blocks.groupBy("doc_id", "page").agg(F.max(F.col("kind").isin("heading", "title").cast("int")).alias("h"), F.max((F.col("kind") == "unknown").cast("int")).alias("u"), F.min("confidence").alias("c"))
    w = Window.partitionBy("doc_id")
    tests = {"first_page": F.col("page") == F.min("page").over(w), "last_page": F.col("page") == F.max("page").over(w), "heading": F.col("h") == 1, "unknown": F.col("u") == 1, "low_ocr": F.col("c") < LOW_OCR}
    marked = pages.select("doc_id", "page", F.array_sort(F.array_compact(F.array(*(F.when(t, F.lit(r)) for r, t in tests.items())))).alias("reasons")).where(F.size("reasons") > 0)
    rank = F.create_map(*(x for i, r in enumerate(REASONS) for x in (F.lit(r), F.lit(i))))
    ranked = marked.withColumn("priority", F.array_min(F.transform("reasons", lambda r: rank[r])))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("priority", "page")) - 1
    return ranked.select("doc_id", "page", F.array_join("reasons", ",").alias("reasons"), "priority", F.floor(place / BATCH).cast("long").alias("batch"))


def boundary_pages(blocks: DataFrame) -> DataFrame:
    ends = blocks.groupBy("doc_id").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    return ends.select("doc_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("page"), "a", "b").select("doc_id", "page", F.when(F.col("a") == F.col("b"), "first_and_last").when(F.col("page") == F.col("a"), "first").otherwise("last").alias("boundary"))


def patch_merge(ops: DataFrame) -> DataFrame:
    """One row per (doc_id, node, op): the value, or a conflict where patches disagree."""
    same = ops.groupBy("doc_id", "node", "op").agg(F.count_distinct(F.coalesce("value", F.lit("\u0000"))).alias("values"), F.min("value").alias("value"), F.max("confidence").alias("confidence"))
    return same.select("doc_id", "node", "op", F.when(F.col("values") == 1, F.col("value")).alias("value"), (F.col("values") > 1).alias("conflict"), "confidence")


def patch_apply(n: DataFrame, merged: DataFrame) -> DataFrame:
    """Kinds and levels after the merged operations that reach their threshold; conflicts change nothing."""
    fit = merged.where(~F.col("conflict") & (F.col("confidence") >= F.when(F.col("op") == "set_toc_level", TOC_CONFIDENCE).otherwise(STRUCTURE_CONFIDENCE)))
    wide = fit.groupBy("doc_id", "node").agg(F.max(F.when(F.col("op") == "reclassify", F.col("value"))).alias("new_kind"), F.max(F.when(F.col("op") == "set_level", F.col("value").cast("int"))).alias("new_level"))
    joined = n.join(wide, ["doc_id", "node"], "left")
    kind = F.coalesce("new_kind", "kind")
    return joined.select("doc_id", "node", kind.alias("kind"), F.when(kind == "heading", F.coalesce("new_level", "level", F.lit(1))).alias("level"), (F.col("new_kind").isNotNull() | F.col("new_level").isNotNull()).alias("changed"))


def cover_page(kinds: DataFrame) -> DataFrame:
    """Whether each document's first page reads as a cover: few nodes, little text, a heading, no tables or figures."""
    first = kinds.where("page = 0 AND NOT furniture").groupBy("doc_id").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.length("text")).alias("chars"), F.max(F.col("kind").isin("title", "heading").cast("int")).alias("h"), F.max(F.col("kind").isin("table", "figure", "list", "code").cast("int")).alias("x"))
    return first.select("doc_id", "nodes", "chars", ((F.col("nodes") <= COVER_NODES) & (F.col("chars") <= COVER_CHARS) & (F.col("h") == 1) & (F.col("x") == 0)).alias("is_cover"))


def table_occupancy(cells: DataFrame) -> DataFrame:
    """Grid places of each table that two cells or more claim."""
    rows = cells.select("table_id", F.explode(F.expr("sequence(r, r + rowspan - 1)")).alias("row"), "c", "colspan")
    places = rows.select("table_id", "row", F.explode(F.expr("sequence(c, c + colspan - 1)")).alias("col"))
    return places.groupBy("table_id", "row", "col").agg(F.count(F.lit(1)).alias("claims")).where("claims > 1")


def rendition_pick(renditions: DataFrame) -> DataFrame:
    """The first eligible rendition of each asset by role priority, declared order and id."""
    role = F.when(F.col("role") == "normalized", 0).when(F.col("role") == "original", 1).when(F.col("role") == "thumbnail", 2).otherwise(3)
    w = Window.partitionBy("asset").orderBy(role, "declared", "rendition")
    return renditions.where("available AND ref RLIKE '^src_[0-9a-f]{32}$'").withColumn("place", F.row_number().over(w)).where("place = 1").select("asset", "rendition", "role")


def stream_projection(groups: DataFrame) -> DataFrame:
    """Stream entries of groups, with a loss code where a kind has no entry."""
    entry = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "))).when(F.col("kind").isin("paragraph", "list_item"), "")
    return groups.select("doc_id", "group_no", entry.alias("marker"), F.when(entry.isNull(), F.concat(F.upper("kind"), F.lit("_NOT_PROJECTED"))).alias("loss"))
