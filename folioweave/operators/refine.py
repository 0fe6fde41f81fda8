"""Refinement of recovered structure: outline levels, compact contents lines, wrapped text, furniture, visuals.

Defined cases: null texts read as empty ones; ties are broken by the order that each docstring names; empty tables
give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.operators.blocks import label
from folioweave.operators.text import TERMINAL, inline_whitespace

# The rules' patterns and limits.
MARKER = "第[〇零一二三四五六七八九十百千万两0-9]+[章节卷部篇]|卷[〇零一二三四五六七八九十百千万两0-9]+"
RIGHT_PUNCTUATION = r"^[,.;:!?%)\]】》、，。！？；：]"
CJK = "[一-鿿]"
OUTLINE_WINDOW, OUTLINE_OVERLAP = 120, 20
TOC_LINE_CHARS, TOC_ENTRY_CHARS = 240, 120
HEADER_LABELS, FOOTER_LABELS = ("page_header", "header", "header_image"), ("page_footer", "footer", "footer_image")
NUMBER_LABELS, ASIDE_LABELS = ("number", "page_number"), ("aside_text", "sidebar", "marginal_note")
NUMBER_TOP, NUMBER_BOTTOM = 0.20, 0.80
CONTAINED, AREA_RATIO = 0.92, 0.45
SAFE_SHARE, SAFE_CJK = 0.75, 2


def outline_windows(assigned: DataFrame, size: int = OUTLINE_WINDOW, overlap: int = OUTLINE_OVERLAP) -> DataFrame:
    """Rows (doc_id, line_no, level, w): headings in overlapping windows; the last window ends at the last heading."""
    step = size - overlap
    doc = Window.partitionBy("doc_id")
    i = F.row_number().over(doc.orderBy("line_no")) - 1
    placed = assigned.where("kind IN ('title', 'heading')").select("doc_id", "line_no", "level", i.alias("i"), F.count(F.lit(1)).over(doc).alias("n"))
    low = F.greatest(F.lit(0), F.ceil((F.col("i") - (size - 1)) / step))
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - size) / step))
    return placed.select("doc_id", "line_no", "level", F.explode(F.sequence(low, F.least(F.floor(F.col("i") / step), last))).alias("w"))


def outline_vote(votes: DataFrame) -> DataFrame:
    """The most frequent level of each heading over its windows; ties go to the earliest window, then the lowest level."""
    counted = votes.groupBy("doc_id", "line_no", "level").agg(F.count(F.lit(1)).alias("votes"), F.min("w").alias("w"))
    best = F.row_number().over(Window.partitionBy("doc_id", "line_no").orderBy(F.desc("votes"), "w", "level"))
    return counted.withColumn("place", best).where("place = 1").select("doc_id", "line_no", "level", "votes")


def apply_outline(assigned: DataFrame, levels: DataFrame) -> DataFrame:
    """Levels of headings replaced by the outline's, where it has one; other lines keep theirs."""
    new = levels.select("doc_id", "line_no", F.col("level").alias("new_level"))
    level = F.when(F.col("kind").isin("title", "heading"), F.coalesce("new_level", "level")).otherwise(F.col("level"))
    return assigned.join(new, ["doc_id", "line_no"], "left").select("doc_id", "line_no", "kind", level.cast("int").alias("level"))


def compact_toc(lines: DataFrame, text: str = "text") -> DataFrame:
    """Entries of lines that hold a whole table of contents: rows (doc_id, line_no, entry_no, start, stop, entry).

    Such a line has at most 240 characters, starts with a marker and has two markers or more, each entry at most 120
    characters. Spans count code points of the line and leave outer white space out.
    """
    parts = F.split(F.col(text), rf"(?<!\S)(?={MARKER})")
    cut = lines.where(F.length(text) <= TOC_LINE_CHARS).select("doc_id", "line_no", F.posexplode(parts).alias("i", "part"))
    line = Window.partitionBy("doc_id", "line_no")
    before = F.coalesce(F.sum(F.length("part")).over(line.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cut.withColumn("before", before).where(F.length(F.trim("part")) > 0)
    entry, lead = F.trim("part"), F.length("part") - F.length(F.ltrim("part"))
    entries = placed.select("doc_id", "line_no", entry.alias("entry"), (F.col("before") + lead).alias("start"))
    checked = entries.select("*", F.count(F.lit(1)).over(line).alias("n"), F.max(F.length("entry")).over(line).alias("longest"), F.min(F.col("entry").rlike(f"^(?:{MARKER})")).over(line).alias("marked"), F.row_number().over(line.orderBy("start")).alias("entry_no"))
    kept = checked.where((F.col("n") >= 2) & (F.col("longest") <= TOC_ENTRY_CHARS) & F.col("marked"))
    return kept.select("doc_id", "line_no", "entry_no", F.col("start").cast("long").alias("start"), (F.col("start") + F.length("entry")).cast("long").alias("stop"), "entry")


def glue(left: Column, right: Column) -> Column:
    """What stands between two wrapped lines; a hyphen at the end of ``left`` is dropped by the caller."""
    close = left.endswith("-") | right.rlike(RIGHT_PUNCTUATION) | left.rlike(CJK + "$") | right.rlike("^" + CJK)
    return F.when(close, "").otherwise(" ")


def paragraphs(lines: DataFrame) -> DataFrame:
    """Rows (doc_id, para, text): wrapped lines joined; an empty line or a terminal mark ends a paragraph.

    The joint of two lines depends on these two alone, so paragraphs are islands and not a fold.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    flat = lines.select("doc_id", "line_no", inline_whitespace(F.col("text")).alias("flat"))
    before, after = F.lag("flat").over(order), F.lead("flat").over(order)
    new = F.coalesce((before == "") | before.rlike(TERMINAL), F.lit(True))
    goes_on = F.coalesce((after != "") & ~F.col("flat").rlike(TERMINAL), F.lit(False))
    marked = flat.select("doc_id", "line_no", "flat", new.alias("new"), goes_on.alias("goes_on"), F.when(new, "").otherwise(glue(before, F.col("flat"))).alias("glue")).where("flat <> ''")
    body = F.when(F.col("goes_on") & F.col("flat").endswith("-"), F.expr("left(flat, length(flat) - 1)")).otherwise(F.col("flat"))
    numbered = marked.select("doc_id", "line_no", F.concat("glue", body).alias("piece"), F.sum(F.col("new").cast("long")).over(order).alias("para"))
    pieces = numbered.groupBy("doc_id", "para").agg(F.array_sort(F.collect_list(F.struct("line_no", "piece"))).alias("pieces"))
    return pieces.select("doc_id", "para", F.trim(F.array_join(F.col("pieces.piece"), "")).alias("text"))


def safe_choice(texts: DataFrame, raw: str, normalized: str) -> DataFrame:
    """``raw`` or ``normalized``: the raw text wins where the other lost a quarter of its characters or of its CJK ones."""
    cjk = lambda c: F.length(F.regexp_replace(F.col(c), "[^一-鿿]", ""))
    short = F.length(normalized) < SAFE_SHARE * F.length(raw)
    lost = (cjk(raw) > SAFE_CJK) & (cjk(normalized) < SAFE_SHARE * cjk(raw))
    return texts.select("doc_id", F.length(raw).cast("long").alias("raw_chars"), F.length(normalized).cast("long").alias("normalized_chars"), F.when(short | lost, "raw").otherwise("normalized").alias("chosen"))


def presentation_kind(blocks: DataFrame) -> DataFrame:
    """Header, footer or footnote of each furniture block; page numbers by the centre of their box, else footer."""
    name, center = label(F.col("raw_kind")), (F.col("top") + F.col("bottom")) / 2
    kind = F.when(name.isin(*HEADER_LABELS), "header").when(name.isin(*FOOTER_LABELS), "footer").when(name.isin(*NUMBER_LABELS), F.when(center <= NUMBER_TOP, "header").otherwise("footer")).when(name.isin(*ASIDE_LABELS), "footnote")
    sure = ~name.isin(*NUMBER_LABELS) | F.coalesce((center <= NUMBER_TOP) | (center >= NUMBER_BOTTOM), F.lit(False))
    return blocks.select("doc_id", "line_no", kind.alias("kind"), sure.alias("sure")).where("kind IS NOT NULL")


def toc_slices(items: DataFrame) -> DataFrame:
    """Boxes shared by the items of a ``box`` cut into equal horizontal slices in line order."""
    box = Window.partitionBy("doc_id", "box")
    i, n = F.row_number().over(box.orderBy("line_no")) - 1, F.count(F.lit(1)).over(box)
    top, height = F.min("top").over(box), F.max("bottom").over(box) - F.min("top").over(box)
    return items.select("doc_id", "line_no", (top + height * i / n).alias("slice_top"), (top + height * (i + 1) / n).alias("slice_bottom"))


def caption_absorb(ordered: DataFrame) -> DataFrame:
    """Captions straight after a visual of their page become part of it: its box grows, their texts are joined.

    Other captions are paragraphs. Rows (doc_id, line_no, kind, l, top, r, bottom, caption).
    """
    page = Window.partitionBy("doc_id", "page").orderBy("ord")
    heads = ordered.withColumn("island", F.sum((F.col("kind") != "caption").cast("long")).over(page))
    head = F.first(F.when(F.col("kind").isin("figure", "table"), F.col("line_no"))).over(Window.partitionBy("doc_id", "page", "island").orderBy("ord"))
    own = heads.withColumn("owner", F.coalesce(head, F.col("line_no")))
    is_cap = F.col("kind") == "caption"
    texts = F.array_sort(F.collect_list(F.when(is_cap & (F.col("owner") != F.col("line_no")), F.struct("ord", "text"))))
    kind = F.max(F.when(F.col("owner") == F.col("line_no"), F.when(is_cap, "paragraph").otherwise(F.col("kind"))))
    return own.groupBy("doc_id", F.col("owner").alias("line_no")).agg(kind.alias("kind"), F.min("l").alias("l"), F.min("top").alias("top"), F.max("r").alias("r"), F.max("bottom").alias("bottom"), F.array_join(texts["text"], " ").alias("caption"))


def duplicate_visuals(native: DataFrame, candidates: DataFrame) -> DataFrame:
    """The native visual that keeps the place of each near-contained candidate of its document, page and kind.

    Ties in containment go to the larger area ratio, then the smaller order. The join is within a page.
    """
    box = ("l", "top", "r", "bottom")
    a = native.select("doc_id", "page", "kind", F.col("id").alias("keeper"), F.col("ord").alias("keeper_ord"), *(F.col(c).alias(f"n_{c}") for c in box))
    width = F.greatest(F.lit(0.0), F.least("r", "n_r") - F.greatest("l", "n_l"))
    height = F.greatest(F.lit(0.0), F.least("bottom", "n_bottom") - F.greatest("top", "n_top"))
    mine, other = (F.col("r") - F.col("l")) * (F.col("bottom") - F.col("top")), (F.col("n_r") - F.col("n_l")) * (F.col("n_bottom") - F.col("n_top"))
    smaller, larger = F.least(mine, other), F.greatest(mine, other)
    pairs = candidates.join(a, ["doc_id", "page", "kind"]).where(smaller > 0).select("doc_id", "id", "keeper", "keeper_ord", (width * height / smaller).alias("containment"), (smaller / larger).alias("ratio"))
    fit = pairs.where((F.col("containment") >= CONTAINED) & (F.col("ratio") >= AREA_RATIO))
    best = F.row_number().over(Window.partitionBy("doc_id", "id").orderBy(F.desc("containment"), F.desc("ratio"), "keeper_ord"))
    return fit.withColumn("place", best).where("place = 1").select("doc_id", "id", "keeper")
