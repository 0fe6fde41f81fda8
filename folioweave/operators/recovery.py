"""From window results to nodes, and from page blocks to nodes: lists, captions, levels, labels, ranges, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.operators.text import inline_whitespace

# Patterns of legacy heading levels, aliases of block labels, limits of boxes and bands.
LEVEL_ONE = r"(?i)^\s*(?:第[一二三四五六七八九十百千万\d]+[编册篇卷]|PART\s+[IVX\d]+)"
LEVEL_TWO = r"(?i)^\s*(?:第[一二三四五六七八九十百千万\d]+[章节]|[一二三四五六七八九十百千万]、|\d+\.\s|Chapter\s+\d+|Section\s+\d+)"
ALIASES = {
    "text": ("text", "paragraph", "body", "body_text", "content", "list", "abstract", "algorithm", "formula", "equation", "formula_number", "equation_number", "aside_text", "sidebar", "marginal_note", "reference"),
    "caption": ("caption",),
    "header": ("header", "page_header"),
    "footer": ("footer", "page_footer"),
    "title": ("title", "heading", "section", "doc_title", "document_title", "para_title", "paragraph_title", "headline", "section_title"),
    "toc": ("toc", "catalog", "contents", "table_of_contents", "directory"),
    "image": ("image", "figure", "picture", "photo", "graphic", "illustration", "artwork", "diagram", "chart", "graph", "screenshot", "seal", "stamp"),
    "table": ("table", "tabular", "spreadsheet", "grid"),
    "page_number": ("page_number", "page_num", "pagenumber"),
    "references": ("references", "bibliography"),
    "footnotes": ("footnotes", "footnote"),
    "header_image": ("header_image",),
    "footer_image": ("footer_image",),
}
OVERFLOW, NEGATIVE = 1.2, -5
MIDDLE_TOP, MIDDLE_BOTTOM = 0.18, 0.82
PROVIDER_STATES = {"queued": "queued", "running": "running", "completed": "provider_completed", "partial_failed": "provider_partial_failed", "failed": "failed", "expired": "expired"}
FINAL_STATES = ("completed", "partial_failed", "failed", "expired")


def block_type(raw: Column) -> Column:
    """The canonical type of a block label; a label without an alias stands for itself, an empty one is text."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(raw, F.lit("text")))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    out = F.when(flat == "", "text").otherwise(flat)
    for kind, labels in ALIASES.items():
        out = F.when(flat.isin(*labels), kind).otherwise(out)
    return out


def legacy_levels(titles: DataFrame) -> DataFrame:
    """Levels of titles by place and pattern: the first of a document 1, volumes and parts 1, chapters and sections 2, others 3."""
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) == 1
    level = F.when(first | F.col("text").rlike(LEVEL_ONE), 1).when(F.col("text").rlike(LEVEL_TWO), 2).otherwise(3)
    return titles.select("doc_id", "line_no", level.alias("level"))


def block_parents(ordered: DataFrame) -> DataFrame:
    """Parents of body blocks in reading order. Titles and headings hang on the latest earlier one of a lower level; list items
    on the list that is open (lists and items keep it open); captions on the last visual, if it is on their page and only
    captions lie between; the rest on the latest heading."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    heads = F.col("kind").isin("title", "heading")
    latest = {k: F.max(F.when(heads & (F.col("level") <= k), F.col("ord"))).over(w) for k in range(1, 7)}
    listed = F.max(F.when(F.col("kind") == "list", F.col("ord"))).over(w)
    closed = F.max(F.when(~F.col("kind").isin("list", "list_item"), F.col("ord"))).over(w)
    shown = F.max(F.when(F.col("kind").isin("figure", "table"), F.struct("ord", "page"))).over(w)
    between = F.max(F.when(~F.col("kind").isin("figure", "table", "caption"), F.col("ord"))).over(w)
    visual = F.when((shown["page"] == F.col("page")) & (shown["ord"] > F.coalesce(between, F.lit(-1))), shown["ord"])
    out = F.when((F.col("kind") == "list_item") & (listed > F.coalesce(closed, F.lit(-1))), listed)
    out = out.when(F.col("kind") == "caption", F.coalesce(visual, latest[6])).when(~heads, latest[6])
    for k in range(2, 7):
        out = out.when(F.col("level") == k, latest[k - 1])
    return ordered.select("doc_id", "line_no", "ord", "kind", "level", out.alias("parent"))


def suspicious_boxes(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes (x1, y1, x2, y2) that overflow the page by a fifth or start well before it."""
    wrong = (F.col("x2") > int(width * OVERFLOW)) | (F.col("y2") > int(height * OVERFLOW)) | (F.col("x1") < NEGATIVE) | (F.col("y1") < NEGATIVE)
    return boxes.withColumn("suspicious", wrong)


def band_removals(blocks: DataFrame, header: float = 0.08, footer: float = 0.92) -> DataFrame:
    """Paragraphs and titles in the header and footer bands, with the times their text recurs in the bands of the document
    and whether they go: repeated, outside the middle of the page, and not below its lowest title."""
    title_end = F.max(F.when(F.col("kind") == "title", F.col("bottom"))).over(Window.partitionBy("doc_id", "page"))
    placed = blocks.withColumn("title_end", title_end).withColumn("key", inline_whitespace(F.col("text")))
    inside = placed.where(F.col("kind").isin("paragraph", "title") & (F.col("bottom") <= 1) & ((F.col("bottom") <= header) | (F.col("top") >= footer)) & (F.col("key") != ""))
    times = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "key"))
    center = (F.col("top") + F.col("bottom")) / 2
    outside = (center < MIDDLE_TOP) | (center > MIDDLE_BOTTOM)
    below = F.coalesce((F.col("title_end") > 0) & (F.col("top") >= F.col("title_end")), F.lit(False))
    return inside.withColumn("times", times).select("doc_id", "line_no", "times", (outside & ~below & (F.col("times") >= 2)).alias("goes"))


def page_map(pages: DataFrame) -> DataFrame:
    """Rows (doc_id, page_number, issue): pages whose numbers contradict each other, repeated ones, and missing ones.

    ``pages`` has page_number, page_index, local_page_index, range_start and range_end. Missing are the numbers of all
    ranges of a document that no page has.
    """
    bad = (
        F.when((F.col("page_number") < 1) | (F.col("page_index") < 0) | (F.col("local_page_index") < 0) | (F.col("range_start") < 1) | (F.col("range_end") < F.col("range_start")), "invalid_range")
        .when(F.col("page_index") != F.col("page_number") - 1, "index_mismatch")
        .when((F.col("page_number") < F.col("range_start")) | (F.col("page_number") > F.col("range_end")), "outside_range")
        .when(F.col("local_page_index") != F.col("page_number") - F.col("range_start"), "local_mismatch")
    )
    wrong = pages.select("doc_id", "page_number", bad.alias("issue")).where("issue IS NOT NULL")
    twice = pages.groupBy("doc_id", "page_number").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "page_number", F.lit("duplicate_page").alias("issue"))
    expected = pages.where("range_end >= range_start").select("doc_id", F.explode(F.sequence("range_start", "range_end")).alias("page_number")).distinct()
    missing = expected.join(pages.select("doc_id", "page_number"), ["doc_id", "page_number"], "left_anti").select("doc_id", "page_number", F.lit("missing_page").alias("issue"))
    return wrong.unionByName(twice).unionByName(missing)


def provider_states(jobs: DataFrame) -> DataFrame:
    """``jobs`` (status, done, total) with lifecycle state, whether it is final, and whether the progress is malformed."""
    state = F.lit(None).cast("string")
    for name, to in PROVIDER_STATES.items():
        state = F.when(F.col("status") == name, to).otherwise(state)
    malformed = state.isNull() | (F.coalesce("done", F.lit(0)) < 0) | (F.coalesce("total", F.lit(0)) < 0)
    return jobs.withColumn("state", state).withColumn("is_final", F.coalesce(F.col("status").isin(*FINAL_STATES), F.lit(False))).withColumn("malformed", malformed)
