"""From blocks to readable text: contents lines, paragraph breaks, cross-page merges, native lines.

Defined cases: null texts read as empty ones; ties in order go to the smaller line number; empty tables give empty
results. Folds run within one page or one contents block, never within a group that grows with the input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.operators.refine import glue
from folioweave.operators.text import HEADING_LIKE, TERMINAL, inline_whitespace

# Patterns of contents lines, limits of paragraph breaks and of native lines.
LEADER = r"[\.．。·•・‧⋯…\-—–_─━﹣－ \t　]"
LEADER_LINE = rf"^(.+?[^ \t　])[ \t　]*{LEADER}{{2,}}[ \t　]*(\d+)$"
SPACED_LINE = r"^(.+?[^ \t　])[ \t　]{2,}(\d+)$"
DASH_LINE = r"^(.+?[^ \t　])[ \t　]+[\-—–﹣－][ \t　]+(\d+)$"
PAREN_LINE = r"^(.*[一-鿿].*?[^ \t　])[ \t　]*([（(][0-9０-９]+[）)])$"
CONTENTS_HEADING = r"^目[ \t　]*录$"
TITLE_LIKE = r"^(?:目录|前言|序言?|后记|附录|[一二三四五六七八九十百千万0-9]+[篇章节部卷]|[一-鿿]{2,12}(?:篇|章|节|部))$"
PAGE_TOKEN = r"(?:[（(][0-9０-９]+[）)]|[0-9０-９]+)$"
NOISE_CJK, INLINE_NOISE_CJK = r"^[一-鿿]{1,3}$", r"^[一-鿿]{1,4}$"
FORCED = ("title", "toc", "caption", "image", "table")
IMAGES, TRAILING = ("image", "table"), ("title", "toc")
PAGE_BOTTOM, PAGE_TOP = 0.88, 0.18
LEAST_GAP, GAP_SHARE, LEAST_INDENT, INDENT_SHARE, LEAST_LINE = 4, 0.08, 18, 0.025, 12
CONTINUED_END, CONTINUED_START = r"[。！？.!?…]$", r"^[a-z一-鿿0-9]"
CJK = "[一-鿿]"
NATIVE_NUMBER = r"^(?:\d{1,4}|[IVXLCDMivxlcdm]{1,8})$"
NATIVE_FOOT, NATIVE_CENTRE, NATIVE_TITLE, NATIVE_CENTRED, NATIVE_CHARS = 0.88, 0.18, 1.10, 1.03, 80
NATIVE_GAP, NATIVE_INDENT, NATIVE_INDENT_SHARE = 1.15, 8.0, 0.025
NATIVE_END, NATIVE_CJK = r"[。！？!?；;：:]$", "[　-〿㐀-鿿]"


def strip(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^[ \t　]+|[ \t　]+$", "")


#: What the last character must be for a pattern to match: looked at first, as the patterns go back and forth over long lines.
LAST = {LEADER_LINE: "[0-9]", SPACED_LINE: "[0-9]", DASH_LINE: "[0-9]", PAREN_LINE: "[)）]"}


def any_rlike(text: Column, *patterns: str) -> Column:
    return reduce(lambda a, b: a | b, (F.substring(text, -1, 1).rlike(LAST[p]) & text.rlike(p) if p in LAST else text.rlike(p) for p in patterns))


def contents_match(line: Column) -> Column:
    """Whether a stripped line is a contents entry, the contents heading or a title-like word."""
    return any_rlike(line, CONTENTS_HEADING, TITLE_LIKE, LEADER_LINE, SPACED_LINE, DASH_LINE, PAREN_LINE)


def contents_noise(line: Column) -> Column:
    """Blank, or up to three ideographs that are no heading, title or page token."""
    return (line == "") | (~any_rlike(line, CONTENTS_HEADING, TITLE_LIKE, PAGE_TOKEN, "[A-Za-z0-9]") & line.rlike(NOISE_CJK))


def contents_entry(line: Column) -> Column:
    """A stripped contents line as ``title...page``; titles stay, noise is empty, other lines are left as they are."""
    title = lambda p: strip(F.regexp_replace(inline_whitespace(F.regexp_extract(line, p, 1)), f"{LEADER}+$", ""))
    bracketed = F.when((title(PAREN_LINE) == "") | contents_noise(title(PAREN_LINE)), "").otherwise(F.concat(title(PAREN_LINE), F.lit("..."), F.regexp_extract(line, PAREN_LINE, 2)))
    out = F.when(line.rlike(CONTENTS_HEADING), "目录").when(line.rlike(TITLE_LIKE), line).when(contents_noise(line), "").when(any_rlike(line, PAREN_LINE), bracketed)
    for p in (SPACED_LINE, DASH_LINE, LEADER_LINE):
        out = out.when(any_rlike(line, p), F.when(title(p) == "", line).otherwise(F.concat(title(p), F.lit("..."), F.regexp_extract(line, p, 2))))
    return out.otherwise(line)


def contents_vote(blocks: DataFrame) -> DataFrame:
    """Rows (doc_id, block, n_lines, matches, is_contents): a block of several lines is contents where half of them match
    and two do; a single line must be the heading or carry a page."""
    line = strip(F.col("text"))
    marked = blocks.select("doc_id", "block", line.alias("line")).where("line <> ''")
    single = any_rlike(F.col("line"), CONTENTS_HEADING, LEADER_LINE, SPACED_LINE, DASH_LINE, PAREN_LINE)
    agg = marked.groupBy("doc_id", "block").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(contents_match(F.col("line")).cast("long")).alias("matches"), F.max(single).alias("single"))
    verdict = F.when(F.col("n_lines") == 1, F.col("single")).otherwise(F.col("matches") >= F.greatest(F.lit(2), F.floor(F.col("n_lines") / 2)))
    return agg.select("doc_id", "block", "n_lines", "matches", verdict.alias("is_contents"))


def contents_block(blocks: DataFrame) -> DataFrame:
    """Rows (doc_id, block, entry_no, entry): the entries kept of each contents block.

    A short run of ideographs between structured lines goes. That looks at the last two *kept* entries, so the lines
    of one block are folded in order with two flags as the state.
    """
    order = Window.partitionBy("doc_id", "block").orderBy("line_no")
    lines = blocks.select("doc_id", "block", "line_no", strip(F.col("text")).alias("line")).where("line <> ''").withColumn("next", F.lead("line").over(order))
    entry = contents_entry(F.col("line"))
    rows = lines.select("doc_id", "block", "line_no", entry.alias("entry"), F.coalesce(contents_match(F.col("next")), F.lit(False)).alias("structured_next"))
    e = F.col("entry")
    short = contents_noise(e) | (e.rlike(INLINE_NOISE_CJK) & ~e.rlike(TITLE_LIKE))
    ready = rows.where("entry <> ''").select("doc_id", "block", F.struct("line_no", "entry", contents_match(e).alias("structured"), (short & F.col("structured_next")).alias("may_go")).alias("x"))
    lists = ready.groupBy("doc_id", "block").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    zero = F.expr("named_struct('kept', cast(array() as array<string>), 'a', false, 'b', false)")

    def step(s: Column, x: Column) -> Column:
        gone = x["may_go"] & (s["a"] | s["b"])
        return F.when(gone, s).otherwise(F.struct(F.concat(s["kept"], F.array(x["entry"])).alias("kept"), s["b"].alias("a"), x["structured"].alias("b")))

    kept = lists.select("doc_id", "block", F.posexplode(F.aggregate("xs", zero, step)["kept"]).alias("i", "entry"))
    return kept.select("doc_id", "block", (F.col("i") + 1).cast("long").alias("entry_no"), "entry")


def fragments(segments: DataFrame) -> DataFrame:
    """Non-blank lines of the segments' texts in order, with ``frag``; blank images stay, as they end a paragraph.

    ``segments`` has doc_id, ord, line_no, type, text, page, x1, y1, x2, y2, page_width, page_height.
    """
    parts = F.when(F.col("type").isin(*IMAGES), F.array(F.coalesce("text", F.lit("")))).otherwise(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != ""))
    cut = segments.select(*(c for c in segments.columns if c != "text"), F.posexplode(parts).alias("part", "piece"))
    return cut.withColumn("text", F.trim("piece")).withColumn("frag", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "part")))


def breaks_before(frags: DataFrame) -> DataFrame:
    """``frags`` with ``breaks``: whether a fragment starts an output line, from it and the one before alone."""
    w = Window.partitionBy("doc_id").orderBy("frag")
    p = {c: F.lag(c).over(w) for c in ("type", "text", "page", "x1", "y1", "x2", "y2", "page_width", "page_height")}
    terminal = p["text"].rlike(TERMINAL)
    headed = p["text"].rlike(HEADING_LIKE) | F.col("text").rlike(HEADING_LIKE) | (p["type"] == "header") | (F.col("type") == "header")
    forced = p["type"].isin(*FORCED) | F.col("type").isin(*FORCED)
    goes_over = ~terminal & ~headed & (p["page_height"] > 0) & (F.col("page_height") > 0) & (p["y2"] / p["page_height"] >= PAGE_BOTTOM) & (F.col("y1") / F.col("page_height") <= PAGE_TOP)
    gap = F.greatest(F.lit(0), F.col("y1") - p["y2"])
    tall = F.greatest(F.lit(1), p["y2"] - p["y1"], F.col("y2") - F.col("y1"))
    indent = F.when(p["page_width"] > 0, F.abs(F.col("x1") - p["x1"])).otherwise(0)
    near = (gap <= F.greatest(F.lit(LEAST_GAP), F.floor(tall * GAP_SHARE))) & (indent <= F.greatest(F.lit(LEAST_INDENT), F.floor(p["page_width"] * INDENT_SHARE)))
    prose = p["type"].isin("text", "paragraph") & F.col("type").isin("text", "paragraph") & (F.length(p["text"]) >= LEAST_LINE)
    joined = F.when(p["page"] != F.col("page"), goes_over).otherwise(~terminal & ~headed & near & prose)
    return frags.withColumn("breaks", F.coalesce((F.col("part") > 0) | forced | ~joined, F.lit(True)))


def output_lines(segments: DataFrame) -> DataFrame:
    """Rows (doc_id, out_no, kind, text): the lines of each document's assembled text; blank ones are left out."""
    w = Window.partitionBy("doc_id").orderBy("frag")
    marked = breaks_before(fragments(segments))
    goes_on = ~F.coalesce(F.lead("breaks").over(w), F.lit(True))
    left = F.lag("text").over(w)
    ready = marked.select("doc_id", "frag", "type", "text", F.sum(F.col("breaks").cast("long")).over(w).alias("out_no"), goes_on.alias("goes_on"), F.when(F.col("breaks"), "").otherwise(glue(left, F.col("text"))).alias("glue"))
    body = F.when(F.col("goes_on") & F.col("text").endswith("-"), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    pieces = ready.groupBy("doc_id", "out_no").agg(F.max_by("type", "frag").alias("kind"), F.array_sort(F.collect_list(F.struct("frag", F.concat("glue", body).alias("piece")))).alias("p"))
    return pieces.select("doc_id", "out_no", "kind", F.trim(F.array_join(F.col("p.piece"), "")).alias("text")).where("text <> ''")


def merge_runs(blocks: DataFrame, continues: Column) -> DataFrame:
    """``blocks`` with ``head``: the line number of the block that each becomes part of.

    A block joins the one before where ``continues`` holds and its page is not the head's. As pages do not fall, the
    blocks on a run's first page each stay alone, and all later ones join the last of these: islands, no fold.
    """
    w = Window.partitionBy("doc_id").orderBy("ord")
    runs = blocks.withColumn("run", F.sum((~F.coalesce(continues, F.lit(False))).cast("long")).over(w))
    first = F.min("page").over(Window.partitionBy("doc_id", "run"))
    heads = runs.withColumn("alone", F.col("page") == first)
    return heads.withColumn("head", F.last(F.when(F.col("alone"), F.col("line_no")), ignorenulls=True).over(w))


def cross_page_text(blocks: DataFrame) -> DataFrame:
    """Rows (doc_id, head, n_parts, text) of the texts that go on over a page: no end mark before, a lower-case letter,
    digit or ideograph after."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    flat = blocks.withColumn("text", F.trim("text"))
    before = F.lag("text").over(w)
    continues = (F.lag("kind").over(w) == "text") & (F.col("kind") == "text") & (before != "") & ~before.rlike(CONTINUED_END) & F.col("text").rlike(CONTINUED_START)
    sep = F.when(before.rlike(CJK + "$") & F.col("text").rlike("^" + CJK), "").otherwise(" ")
    runs = merge_runs(flat.withColumn("sep", sep), continues)
    piece = F.concat(F.when(F.col("alone"), "").otherwise(F.col("sep")), "text")
    merged = runs.groupBy("doc_id", "head").agg(F.count(F.lit(1)).alias("n_parts"), F.array_sort(F.collect_list(F.struct("ord", piece.alias("piece")))).alias("p"))
    return merged.where("n_parts > 1").select("doc_id", "head", "n_parts", F.array_join(F.col("p.piece"), "").alias("text"))


def cross_page_tables(blocks: DataFrame) -> DataFrame:
    """Rows (doc_id, head, n_parts, caption, continuation) of tables that go on in uncaptioned tables of later pages."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    continues = (F.lag("kind").over(w) == "table") & (F.col("kind") == "table") & (F.coalesce("caption", F.lit("")) == "")
    runs = merge_runs(blocks, continues)
    own = F.max(F.when(F.col("alone"), F.struct(F.coalesce("caption", F.lit("")).alias("caption"), "page")))
    rest = F.array_sort(F.collect_list(F.when(~F.col("alone"), F.struct("ord", "page", "line_no"))))
    merged = runs.where("kind = 'table'").groupBy("doc_id", "head").agg(F.count(F.lit(1)).alias("n_parts"), own.alias("own"), rest.alias("rest")).where("n_parts > 1")
    notes = F.array_join(F.transform("rest", lambda x: F.concat(F.lit(" [continued from p"), F.col("own.page"), F.lit(" to p"), x["page"], F.lit("]"))), "")
    return merged.select("doc_id", "head", "n_parts", F.trim(F.concat("own.caption", notes)).alias("caption"), F.element_at("rest", -1)["line_no"].alias("continuation"))


def native_kinds(lines: DataFrame) -> DataFrame:
    """``lines`` (doc_id, page, line_no, text, x0, y0, x1, y1, font, width, height) with ``kind`` against the page's median font."""
    body = F.coalesce(F.percentile(F.when(F.col("font") > 0, F.col("font")), F.lit(0.5)).over(Window.partitionBy("doc_id", "page")), F.lit(1.0))
    font, text = F.coalesce("font", F.lit(0.0)), F.trim(F.coalesce("text", F.lit("")))
    centred = F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("width") / 2) <= F.col("width") * NATIVE_CENTRE
    title = (F.length(text) <= NATIVE_CHARS) & ((font >= F.col("body") * NATIVE_TITLE) | (centred & (font >= F.col("body") * NATIVE_CENTRED)))
    number = (F.col("y0") >= F.col("height") * NATIVE_FOOT) & text.rlike(NATIVE_NUMBER)
    return lines.withColumn("body", body).withColumn("kind", F.when(number, "number").when(title, "paragraph_title").otherwise("text")).withColumn("text", text)


def native_paragraphs(lines: DataFrame) -> DataFrame:
    """Rows (doc_id, page, block, kind, n_lines, y0, y1, text): text lines merged while the gap is small.

    The height that the gap is held against is that of the growing block, so a page's lines are folded in order.
    """
    kinds = native_kinds(lines).where("text <> ''")
    left = F.coalesce(F.min(F.when(F.col("kind") == "text", F.col("x0"))).over(Window.partitionBy("doc_id", "page")), F.lit(0.0))
    indented = F.col("x0") >= left + F.greatest(F.lit(NATIVE_INDENT), F.col("width") * NATIVE_INDENT_SHARE)
    x = F.struct("line_no", "kind", "text", "y0", "y1", indented.alias("indented"))
    pages = kinds.select("doc_id", "page", x.alias("x")).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    zero = F.expr("cast(array() as array<struct<kind:string,n_lines:bigint,y0:double,y1:double,text:string>>)")

    def step(out: Column, x: Column) -> Column:
        p = F.element_at(F.when(F.size(out) > 0, out), -1)
        high = F.greatest(F.lit(1.0), x["y1"] - x["y0"], p["y1"] - p["y0"])
        fits = F.coalesce((x["kind"] == "text") & (p["kind"] == "text") & (x["y0"] - p["y1"] <= high * NATIVE_GAP) & ~(x["indented"] & p["text"].rlike(NATIVE_END)), F.lit(False))
        sep = F.when(F.substring(p["text"], -1, 1).rlike(NATIVE_CJK) | F.substring(x["text"], 1, 1).rlike(NATIVE_CJK), "").otherwise(" ")
        grown = F.struct(p["kind"].alias("kind"), (p["n_lines"] + 1).alias("n_lines"), F.least(p["y0"], x["y0"]).alias("y0"), F.greatest(p["y1"], x["y1"]).alias("y1"), F.concat(p["text"], sep, x["text"]).alias("text"))
        own = F.struct(x["kind"].alias("kind"), F.lit(1).cast("long").alias("n_lines"), x["y0"].alias("y0"), x["y1"].alias("y1"), x["text"].alias("text"))
        return F.when(fits, F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(out, F.array(own)))

    blocks = pages.select("doc_id", "page", F.posexplode(F.aggregate("xs", zero, step)).alias("i", "b"))
    return blocks.select("doc_id", "page", F.col("i").cast("long").alias("block"), "b.*")
