"""Text lines: index, windows, votes, running headers, groups, hierarchy, and scalar text rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEWLINE = r"\r\n|\r|\n"
# The rules' patterns and limits.
HEADING = r"^[ \t]*(\d+(\.\d+)*)[ \t.:：、-]+"
CHAPTER = r"^[ \t]*第[^ \t]{1,12}[章节篇部卷]"
CJK_SECTION = r"^[ \t]*[一二三四五六七八九十百]+[、.．][ \t]*"
LIST_ITEM = r"^[-*•][ \t]"
CAPTION = r"^(Figure|Fig\.|Table)[ \t]*\d+"
TERMINAL = r"""[。！？!?；;：:…\.][”’"')\]】》）]*$"""
HEADING_LIKE = r"^(第[一二三四五六七八九十百千万0-9]+[章节篇部卷]|[0-9]+[\.、)]|[（(]?[一二三四五六七八九十0-9]+[）)])"
TOC_LINE = r"^[ \t]*.+?(\.{2,}|…{2,}|·{2,}|[ \t]{2,})[ \t]*[0-9０-９IVXLCDMivxlcdm一二三四五六七八九十百千]+[ \t]*$"
WINDOW, OVERLAP = 80, 12
UNIT_LINES, UNIT_CHARS = 200, 12_000
HEADER_CHARS, HEADER_TIMES, HEADER_GAPS = 160, 3, 2
HEADER_KINDS = ("title", "heading", "paragraph", "header", "unknown")
#: White space as Python strips it.
SPACE = r"[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def line_index(texts: DataFrame, body: str = "body") -> DataFrame:
    """Rows (doc_id, line_no, text, start, stop, sep_end): all lines with their code-point offsets.

    A final newline gives a last empty line; an empty text one line; a null text none; texts that share a doc_id are
    indexed each by itself. Offsets are added up within the row, in blocks of about the root of the number of lines, so
    nothing is shuffled and a text of n lines takes n ** 1.5 additions.
    """
    cut = texts.select("doc_id", F.split(body, NEWLINE, -1).alias("t"), F.regexp_extract_all(F.col(body), F.lit(NEWLINE), F.lit(0)).alias("s"))
    sized = cut.withColumn("size", F.transform("t", lambda x, i: F.length(x) + F.coalesce(F.length(F.get("s", i)), F.lit(0)))).withColumn("step", F.ceil(F.sqrt(F.size("t"))).cast("int"))
    blocks = F.expr("transform(sequence(0, (size(t) - 1) div step), k -> aggregate(slice(size, k * step + 1, step), 0L, (a, x) -> a + x))")
    bases = F.expr("aggregate(blocks, named_struct('at', 0L, 'out', cast(array() as array<bigint>)), (a, x) -> named_struct('at', a.at + x, 'out', concat(a.out, array(a.at))), a -> a.out)")
    based = sized.withColumn("blocks", blocks).withColumn("bases", bases)
    starts = F.expr("transform(t, (x, i) -> bases[i div step] + aggregate(slice(size, (i div step) * step + 1, i % step), 0L, (a, y) -> a + y))")
    lines = based.select("doc_id", F.posexplode(F.arrays_zip("t", starts.alias("start"), "size")).alias("i", "x"))
    return lines.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), F.col("x.t").alias("text"), F.col("x.start").alias("start"), (F.col("x.start") + F.length("x.t")).cast("long").alias("stop"), (F.col("x.start") + F.col("x.size")).cast("long").alias("sep_end"))


def source_units(lines: DataFrame, most_lines: int = UNIT_LINES, most_chars: int = UNIT_CHARS) -> DataFrame:
    """Greedy partition of each text's lines: rows (doc_id, unit, first_line, last_line, chars).

    The cut depends on the unit before, so each text's line ends are folded in order within one row.
    """
    ends = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "start", "sep_end"))).alias("ends"))
    zero = F.expr("named_struct('units', cast(array() as array<struct<first_line:bigint,last_line:bigint,begin:bigint,finish:bigint>>), 'first', 1L, 'last', 0L, 'begin', 0L, 'finish', 0L)")

    def step(a: Column, x: Column) -> Column:
        full = (a["last"] >= a["first"]) & ((x["line_no"] - a["first"] >= most_lines) | (x["sep_end"] - a["begin"] > most_chars))
        done = F.concat(a["units"], F.array(F.struct(a["first"].alias("first_line"), a["last"].alias("last_line"), a["begin"].alias("begin"), a["finish"].alias("finish"))))
        return F.struct(F.when(full, done).otherwise(a["units"]).alias("units"), F.when(full, x["line_no"]).otherwise(a["first"]).alias("first"), x["line_no"].alias("last"), F.when(full, x["start"]).otherwise(a["begin"]).alias("begin"), x["sep_end"].alias("finish"))

    def finish(a: Column) -> Column:
        return F.concat(a["units"], F.array(F.struct(a["first"].alias("first_line"), a["last"].alias("last_line"), a["begin"].alias("begin"), a["finish"].alias("finish"))))

    units = ends.select("doc_id", F.posexplode(F.aggregate("ends", zero, step, finish)).alias("unit", "u"))
    return units.select("doc_id", (F.col("unit") + 1).cast("long").alias("unit"), "u.first_line", "u.last_line", (F.col("u.finish") - F.col("u.begin")).alias("chars"))


def observations(lines: DataFrame) -> DataFrame:
    """Non-empty lines with dense order and line ids."""
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1
    return lines.where("text <> ''").select("doc_id", F.format_string("L%06d", "line_no").alias("line_id"), order.cast("long").alias("obs_order"), "text")


def line_windows(lines: DataFrame, size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Rows (doc_id, line_no, w): the overlapping windows that each line lies in; the last ends at the last line."""
    step, i = size - overlap, F.col("line_no") - 1
    n = F.max("line_no").over(Window.partitionBy("doc_id"))
    last = F.greatest(F.lit(0), F.ceil((n - size) / step))
    counted = lines.withColumn("last", last)
    low = F.greatest(F.lit(0), F.ceil((i - (size - 1)) / step))
    return counted.select("doc_id", "line_no", "text", F.explode(F.sequence(low, F.least(F.floor(i / step), F.col("last")))).alias("w"))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")


def kind_of(text: Column) -> Column:
    return F.when(text.rlike(HEADING) | text.rlike(CHAPTER), "heading").when(text.rlike(CAPTION), "caption").when(text.rlike(LIST_ITEM), "list_item").otherwise("paragraph")


def level_of(text: Column) -> Column:
    """Heading level: chapter 1, dotted numbers by their dots up to 6, CJK sections and others 2."""
    number = F.regexp_extract(text, HEADING, 1)
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    return F.when(text.rlike(CHAPTER), 1).when(number != "", F.least(dots + 1, F.lit(6))).otherwise(2).cast("int")


def assignments(lines: DataFrame) -> DataFrame:
    """Kind, start flag and level of each non-empty line, by the default rules."""
    before = F.lag("text").over(Window.partitionBy("doc_id").orderBy("line_no"))
    kind = kind_of(F.col("text"))
    starts = (kind != "paragraph") | F.coalesce(before.rlike(TERMINAL), F.lit(True))
    return lines.select("doc_id", "line_no", "text", kind.alias("kind"), starts.alias("starts_new"), F.when(kind == "heading", level_of(F.col("text"))).alias("level")).where("text <> ''")


def window_votes(lines: DataFrame) -> DataFrame:
    """One vote per line and window; a window's first non-empty line starts a node."""
    placed = line_windows(lines).where("text <> ''").select("doc_id", "line_no", "w")
    first = F.min("line_no").over(Window.partitionBy("doc_id", "w"))
    return placed.withColumn("first", first).join(assignments(lines), ["doc_id", "line_no"]).select("doc_id", "line_no", "w", "kind", (F.col("starts_new") | (F.col("line_no") == F.col("first"))).alias("starts_new"), "level")


def assignment_vote(votes: DataFrame) -> DataFrame:
    """The most frequent (kind, starts_new, level) of each line; ties go to the vote of the earliest window."""
    counted = votes.groupBy("doc_id", "line_no", "kind", "starts_new", "level").agg(F.count(F.lit(1)).alias("votes"), F.min("w").alias("w"))
    best = F.row_number().over(Window.partitionBy("doc_id", "line_no").orderBy(F.desc("votes"), "w"))
    return counted.withColumn("place", best).where("place = 1").select("doc_id", "line_no", "kind", "starts_new", "level", "votes")


def window_coverage(lines: DataFrame, votes: DataFrame) -> DataFrame:
    """Per text: non-empty lines, lines with votes, lines without, duplicate votes of one window."""
    per = votes.groupBy("doc_id", "line_no", "w").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id", "line_no").agg(F.sum(F.col("n") - 1).alias("twice"))
    joined = lines.where("text <> ''").join(per, ["doc_id", "line_no"], "left")
    return joined.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count("twice").alias("n_covered"), F.sum(F.col("twice").isNull().cast("long")).alias("n_missing"), F.coalesce(F.sum("twice"), F.lit(0)).alias("n_twice"))


def repeated_labels(assigned: DataFrame) -> DataFrame:
    """Lines that recur as running labels: equal stripped short lines of an eligible kind, three times or more, two gaps or
    more of two lines; with how often, and the one that stays (the first title, else the first)."""
    same = Window.partitionBy("doc_id", "key")
    lines = assigned.withColumn("key", stripped(F.col("text"))).where((F.col("key") != "") & (F.length("key") <= HEADER_CHARS) & F.col("kind").isin(*HEADER_KINDS))
    gaps = lines.withColumn("gap", (F.col("line_no") - F.lag("line_no").over(same.orderBy("line_no")) >= 2).cast("int"))
    keeper = F.coalesce(F.min(F.when(F.col("kind") == "title", F.col("line_no"))).over(same), F.min("line_no").over(same))
    seen = gaps.select("doc_id", "line_no", "key", F.count(F.lit(1)).over(same).alias("times"), F.sum("gap").over(same).alias("gaps"), keeper.alias("keeper"))
    return seen.where((F.col("times") >= HEADER_TIMES) & (F.col("gaps") >= HEADER_GAPS))


def running_headers(assigned: DataFrame) -> DataFrame:
    """The lines that are demoted to headers."""
    return repeated_labels(assigned).where(F.col("line_no") != F.col("keeper")).select("doc_id", "line_no", "key", "times", "keeper")


def demoted(assigned: DataFrame) -> DataFrame:
    """``assigned`` with running headers as headers that start a node and have no level."""
    headers = running_headers(assigned).select("doc_id", "line_no", F.lit(True).alias("is_header"))
    joined = assigned.join(headers, ["doc_id", "line_no"], "left")
    header = F.coalesce("is_header", F.lit(False))
    return joined.select("doc_id", "line_no", "text", F.when(header, "header").otherwise(F.col("kind")).alias("kind"), (F.col("starts_new") | header).alias("starts_new"), F.when(~header, F.col("level")).alias("level"))


def line_groups(assigned: DataFrame) -> DataFrame:
    """Gaps and islands: runs of lines of one kind and level without an empty line or a start between."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    new = (~(F.lag("kind").over(w).eqNullSafe(F.col("kind")) & F.lag("level").over(w).eqNullSafe(F.col("level")) & (F.col("line_no") - F.lag("line_no").over(w) == 1))) | F.col("starts_new")
    flagged = assigned.withColumn("new", F.coalesce(new, F.lit(True)).cast("long"))
    numbered = flagged.withColumn("group_no", F.sum("new").over(w))
    return numbered.groupBy("doc_id", "group_no").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.max("kind").alias("kind"), F.max("level").alias("level"))


def heading_tree(groups: DataFrame) -> DataFrame:
    """Parent of each group. Titles and headings (level 1 without one) hang on the latest earlier one of a lower level; list
    items on the open list, if one is open; all others on the latest heading. A list is open until another kind follows."""
    w = Window.partitionBy("doc_id").orderBy("group_no").rowsBetween(Window.unboundedPreceding, -1)
    heads, level = F.col("kind").isin("title", "heading"), F.coalesce("level", F.lit(1))
    latest = {k: F.max(F.when(heads & (level <= k), F.col("group_no"))).over(w) for k in range(1, 7)}
    listed = F.max(F.when(F.col("kind") == "list", F.col("group_no"))).over(w)
    closed = F.max(F.when(~F.col("kind").isin("list", "list_item"), F.col("group_no"))).over(w)
    open_list = F.when((F.col("kind") == "list_item") & (listed > F.coalesce(closed, F.lit(-1))), listed)
    parent = F.when(~heads, F.coalesce(open_list, latest[6]))
    for k in range(2, 7):
        parent = parent.when(level == k, latest[k - 1])
    return groups.select("doc_id", "group_no", "kind", "level", parent.alias("parent"))


def recovered_nodes(groups: DataFrame, texts: DataFrame, lines: DataFrame, body: str = "body") -> DataFrame:
    """Groups as nodes: place, kind, level, parent's place, span and text, cut from the body."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("group_no")) - 1
    tree = heading_tree(groups.withColumn("group_no", place.cast("long"))).withColumnRenamed("group_no", "ord")
    spans = groups.select("doc_id", place.cast("long").alias("ord"), "first_line", "last_line")
    first = lines.select("doc_id", F.col("line_no").alias("first_line"), "start")
    last = lines.select("doc_id", F.col("line_no").alias("last_line"), "stop")
    placed = tree.join(spans, ["doc_id", "ord"]).join(first, ["doc_id", "first_line"]).join(last, ["doc_id", "last_line"]).join(texts.select("doc_id", body), "doc_id")
    level = F.when(F.col("kind").isin("title", "heading"), F.coalesce("level", F.lit(1)))
    return placed.select("doc_id", "ord", "kind", level.alias("level"), "parent", "start", "stop", F.expr(f"substring({body}, cast(start + 1 AS int), cast(stop - start AS int))").alias("text"))


def inline_whitespace(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.translate(text, "　", " "), r"[ \t\n\r\f\u000B]+", " "), "^ | $", "")


def text_flags(lines: DataFrame) -> DataFrame:
    """Whitespace-normalised line with the terminal, heading-like, caption and contents-line predicates."""
    t = F.col("flat")
    return lines.select("doc_id", "line_no", inline_whitespace(F.col("text")).alias("flat")).select("doc_id", "line_no", "flat", t.rlike(TERMINAL).alias("terminal"), t.rlike(HEADING_LIKE).alias("heading_like"), t.rlike(CAPTION).alias("caption"), t.rlike(TOC_LINE).alias("toc_line"))


def node_id(prefix: str, *parts: Column) -> Column:
    """Prefix and the first 24 hex digits of the SHA-256 of the parts, parted by U+001F; a null part reads None."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\u001f", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts)), 256), 1, 24))


def normalize_text(texts: DataFrame, text: str) -> DataFrame:
    """Newlines unified; ``rejected`` where control characters other than newline and tab remain."""
    flat = F.regexp_replace(F.col(text), "\r\n|\r", "\n")
    return texts.select("doc_id", F.length(flat).cast("long").alias("chars"), F.sha2(flat, 256).alias("sha"), flat.rlike(r"[\x00-\x08\x0B-\x1F]").alias("rejected"))
