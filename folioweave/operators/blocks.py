"""Layout blocks: kinds, furniture, order, levels, boxes, captions, merges and health gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.operators.text import TOC_LINE, inline_whitespace, level_of

# Labels of each node kind, furniture labels, and limits.
KINDS = {
    "title": "doc_title document_title title",
    "heading": "heading paragraph_title section_title headline para_title",
    "paragraph": "text paragraph body body_text abstract",
    "list": "list",
    "list_item": "list_item bullet",
    "figure": "image figure picture photo chart diagram graphic illustration",
    "table": "table tabular",
    "caption": "caption figure_caption figure_title figure_note table_caption table_title",
    "formula": "formula equation isolate_formula display_formula inline_formula formula_number",
    "footnote": "footnote vision_footnote table_footnote",
    "reference": "reference references reference_content",
    "code": "code code_block algorithm",
}
FURNITURE = "number page_number header page_header header_image footer page_footer footer_image aside_text sidebar marginal_note".split()
SENTENCE_END = r"""[。！？!?；;：:][ \t]*[\]\[）)】》〉」』”’"']*[ \t]*$"""
CJK = r"[一-鿿]"
MERGE_BOTTOM, MERGE_TOP = 0.82, 0.18
CAPTION_GAP, CAPTION_OVERLAP, CAPTION_CENTER, CAPTION_MARGIN = 0.18, 0.40, 0.16, 0.025
HEADER_BAND, FOOTER_BAND = 0.08, 0.92


def label(raw: Column) -> Column:
    return F.translate(F.lower(F.trim(raw)), " -", "__")


def semantic_kind(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``kind`` (unknown where no label set holds the label) and ``furniture``."""
    kind = F.lit("unknown")
    for name, labels in KINDS.items():
        kind = F.when(label(F.col("raw_kind")).isin(labels.split()), name).otherwise(kind)
    return blocks.withColumn("kind", kind).withColumn("furniture", label(F.col("raw_kind")).isin(FURNITURE))


def reading_order(kinds: DataFrame) -> DataFrame:
    """Body blocks numbered from 0 by page, then top, then line."""
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "top", "line_no")) - 1
    return kinds.where(~F.col("furniture")).withColumn("ord", order.cast("long"))


def heading_levels(kinds: DataFrame) -> DataFrame:
    level = F.when(F.col("kind") == "title", F.lit(1)).otherwise(level_of(F.col("text")))
    return kinds.where(F.col("kind").isin("title", "heading")).select("doc_id", "line_no", "kind", level.alias("level"))


def toc_items(texts: DataFrame, body: str) -> DataFrame:
    """Items of the texts that look like a table of contents: two lines or more with a leader and a page numeral."""
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    marked = texts.select("doc_id", lines.alias("lines")).where(F.size(F.filter("lines", lambda x: x.rlike(TOC_LINE))) >= 2)
    items = marked.select("doc_id", F.posexplode("lines").alias("i", "item"))
    return items.select("doc_id", F.format_string("toc:%04d", F.col("i") + 1).alias("item_id"), "item")


def boxes(blocks: DataFrame, size: int = 1000) -> DataFrame:
    """Pixel boxes clipped to the page, rounded half to even; with side, confidence and band predicates."""
    px = lambda c: F.bround(F.col(c) * size, 0).cast("int")
    clip = lambda c: F.greatest(F.lit(0), F.least(F.lit(size), px(c)))
    out = blocks.select("doc_id", "line_no", "raw_kind", "confidence", clip("l").alias("x1"), clip("top").alias("y1"), clip("r").alias("x2"), clip("bottom").alias("y2"))
    least = F.when(label(F.col("raw_kind")).isin("figure", "table"), 12).otherwise(8)
    passes = (F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) >= least) & (F.col("confidence") >= 0.5)
    band = (F.col("y2") <= int(size * HEADER_BAND)) | (F.col("y1") >= int(size * FOOTER_BAND))
    return out.select("doc_id", "line_no", "x1", "y1", "x2", "y2", passes.alias("passes"), band.alias("in_band"))


def caption_join(kinds: DataFrame) -> DataFrame:
    """The visual of each caption on its page by distance, where the second best is worse by a margin.

    A join within (document, page): a page holds 25 blocks at most, so no group of pairs grows with the input.
    """
    caps = kinds.where("kind = 'caption'").select("doc_id", "page", F.col("line_no").alias("cap"), F.col("top").alias("ct"), F.col("bottom").alias("cb"), F.col("l").alias("cl"), F.col("r").alias("cr"), F.when(label(F.col("raw_kind")).startswith("table"), "table").otherwise("figure").alias("wants"))
    visuals = kinds.where("kind IN ('figure', 'table')").select("doc_id", "page", F.col("line_no").alias("visual"), F.col("kind").alias("wants"), "top", "bottom", "l", "r")
    gap = F.greatest(F.lit(0.0), F.col("ct") - F.col("bottom"), F.col("top") - F.col("cb"))
    overlap = F.greatest(F.lit(0.0), F.least("cr", "r") - F.greatest("cl", "l")) / F.greatest(F.lit(1e-9), F.least(F.col("cr") - F.col("cl"), F.col("r") - F.col("l")))
    center = F.abs((F.col("cl") + F.col("cr")) / 2 - (F.col("l") + F.col("r")) / 2)
    pairs = caps.join(visuals, ["doc_id", "page", "wants"]).select("doc_id", "page", "cap", "visual", gap.alias("gap"), overlap.alias("overlap"), center.alias("center"))
    pairs = pairs.where((F.col("gap") <= CAPTION_GAP) & ((F.col("overlap") >= CAPTION_OVERLAP) | (F.col("center") <= CAPTION_CENTER)))
    score = F.round(F.col("gap") + 0.35 * F.col("center") + 0.05 * (1 - F.least(F.lit(1.0), F.col("overlap"))), 6)
    w = Window.partitionBy("doc_id", "cap").orderBy("score", "visual")
    ranked = pairs.withColumn("score", score).withColumn("place", F.row_number().over(w)).withColumn("next", F.lead("score").over(w))
    return ranked.where("place = 1").select("doc_id", "cap", "visual", "score", F.coalesce(F.col("next") - F.col("score") < CAPTION_MARGIN, F.lit(False)).alias("ambiguous"))


def para_merge(ordered: DataFrame) -> DataFrame:
    """Paragraphs that go on from the page before: rows (doc_id, line_no, prev_line, joined)."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    prev = {c: F.lag(c).over(w).alias(f"p_{c}") for c in ("kind", "text", "page", "bottom", "line_no")}
    flat = ordered.select("doc_id", "line_no", "kind", "text", "page", "top", *prev.values())
    fits = (F.col("kind") == "paragraph") & (F.col("p_kind") == "paragraph") & (F.col("page") == F.col("p_page") + 1) & (F.col("p_bottom") >= MERGE_BOTTOM) & (F.col("top") <= MERGE_TOP) & ~F.col("p_text").rlike(SENTENCE_END)
    cjk = F.substring("p_text", -1, 1).rlike(CJK) | F.substring("text", 1, 1).rlike(CJK)
    return flat.where(fits).select("doc_id", "line_no", F.col("p_line_no").alias("prev_line"), F.concat("p_text", F.when(cjk, "").otherwise(" "), "text").alias("joined"))


def repeated_band_text(blocks: DataFrame) -> DataFrame:
    """Blocks in the header or footer band whose flattened text recurs in the bands of its document."""
    inside = blocks.where((F.col("bottom") <= HEADER_BAND) | (F.col("top") >= FOOTER_BAND)).select("doc_id", "line_no", inline_whitespace(F.col("text")).alias("key")).where("key <> ''")
    times = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "key"))
    return inside.withColumn("times", times).where("times >= 2")


def native_health(lines: DataFrame) -> DataFrame:
    """The first reason that speaks against a text layer, or ok."""
    per = lines.where("trim(text) <> ''").groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n"))
    agg = per.groupBy("doc_id").agg(F.sum(F.length("text") * F.col("n")).alias("chars"), F.sum("n").alias("lines"), F.sum(F.col("n") - 1).alias("dup"), F.sum((F.col("text").contains("�")).cast("long")).alias("bad"))
    reason = F.when(F.col("chars") < 120, "sparse").when(F.col("lines") < 4, "few_lines").when(F.col("bad") > 0, "replacement").when(F.col("dup") / F.col("lines") > 0.25, "duplicate_lines").otherwise("ok")
    return agg.select("doc_id", "chars", "lines", reason.alias("reason"))
