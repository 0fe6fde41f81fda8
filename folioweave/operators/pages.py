"""Pages and their texts: provider results, text layers, captions, reasons for review, covers, references and markers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.operators.text import inline_whitespace

# Limits of text layers, patterns of captions and notes, reasons by priority, tokens and roles.
LEAST_CHARS, LEAST_LINES, MOST_COVERAGE, PRINTABLE, CONTROL, REPEATED = 120, 4, 0.80, 0.98, 0.01, 0.25
CAPTION_CJK = r"^\s*(?:图|表)\s*[0-9一二三四五六七八九十百千IVXivx]+(?:\s|[：:.\-、，,]|$)"
CAPTION_EN = r"(?i)^\s*(?:Figure|Table)\s*\d+(?:\s|[：:.\-、，,]|$)"
NOTE = r"(?i)^\s*(?:注[：:﹕]?|注意[：:﹕]|备注[：:﹕]|说明[：:﹕]|注\s*\d+[\.）)：:﹕]|Note[：:﹕]|Remark[：:﹕])"
REASONS = ("first_page", "last_page", "toc_page", "summary_page", "heading_candidate_page", "unknown_node_page", "degraded_node_page", "low_ocr_confidence_page")
SUMMARY_KINDS = ("abstract", "summary", "overview", "chapter_summary", "executive_summary")
SUMMARY_TEXTS = ("摘要", "概要", "内容概要", "abstract", "summary", "overview")
NOT_COVERS = ("back_cover", "title_page", "copyright_page", "body")
COVER_KINDS_OUT = ("paragraph", "list", "list_item", "table", "formula", "code", "quote", "reference")
LOW_READING, ROLE_CONFIDENCE, COVER_NODES, COVER_CHARS = 0.80, 0.85, 8, 160

BLOCK = "struct<type:string,block_label:string,text:string,block_content:string,confidence:double,score:double,`order`:bigint,bbox:array<double>,block_bbox:array<double>,metadata:struct<label:string>>"
PAGE = f"array<struct<page_number:bigint,page_index:bigint,local_page_index:bigint,source_page_range:struct<page_start:bigint,page_end:bigint>,width:double,height:double,blocks:array<{BLOCK}>>>"


def provider_blocks(results: DataFrame, raw: str = "raw_result") -> DataFrame:
    """Blocks of provider results (JSON pages), in order, with the first rule that each page or block breaks as ``issue``.

    A document is accepted by ``accepted`` if none of its pages and blocks breaks one. Rows without a block stand for pages
    without blocks. A block's place is its order, or its place in the input where it has none.
    """
    pages = results.select("doc_id", F.explode(F.from_json(raw, PAGE)).alias("p"))
    numbered = pages.select("doc_id", "p.*").withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "page_number")))
    start, end = F.col("source_page_range.page_start"), F.col("source_page_range.page_end")
    page_issue = (
        F.when(F.col("page_number").isNull() | (F.col("page_number") < 1), "page_number")
        .when(F.col("same") > 1, "duplicate_page")
        .when(F.col("page_index") != F.col("page_number") - 1, "page_index")
        .when((start > end) | (F.col("page_number") < start) | (F.col("page_number") > end), "page_range")
        .when(F.col("local_page_index") != F.col("page_number") - start, "local_page_index")
        .when(F.coalesce(F.col("width") <= 0, F.lit(True)) | F.coalesce(F.col("height") <= 0, F.lit(True)), "dimensions")
    )
    each = numbered.withColumn("page_issue", page_issue).select("doc_id", "page_number", "page_issue", "width", "height", F.posexplode_outer("blocks").alias("place", "b"))
    box, confidence = F.coalesce("b.bbox", "b.block_bbox"), F.coalesce("b.confidence", "b.score")
    x1, y1, x2, y2 = (F.get(box, k) for k in range(4))
    wide, high = (F.nullif(F.col(c), F.lit(0.0)) for c in ("width", "height"))
    inside = (F.size(box) == 4) & (x1 >= 0) & (x1 < x2) & (x2 <= F.col("width")) & (y1 >= 0) & (y1 < y2) & (y2 <= F.col("height"))
    block_issue = F.when(F.col("b.order") < 0, "order").when((confidence < 0) | (confidence > 1), "confidence").when(~F.coalesce(inside, F.lit(False)), "bbox")
    kind = F.lower(F.trim(F.coalesce(F.nullif("b.metadata.label", F.lit("")), F.nullif("b.type", F.lit("")), F.nullif("b.block_label", F.lit("")), F.lit("unknown"))))
    at = F.row_number().over(Window.partitionBy("doc_id", "page_number").orderBy(F.coalesce("b.order", F.col("place").cast("long")), "place")) - 1
    out = each.withColumn("issue", F.coalesce("page_issue", F.when(F.col("b").isNotNull(), block_issue))).select(
        "doc_id", "page_number", at.cast("long").alias("ord"), F.when(kind == "", "unknown").otherwise(kind).alias("kind"), F.coalesce("b.text", "b.block_content").alias("text"), confidence.alias("confidence"),
        (x1 / wide).alias("l"), (y1 / high).alias("top"), (x2 / wide).alias("r"), (y2 / high).alias("bottom"), "issue",
    )
    return out.withColumn("accepted", F.count("issue").over(Window.partitionBy("doc_id")) == 0)


KEYED = re.compile(r"^([A-Za-z_][\w -]*):\s*(.*)$")


def parse_entry(text: str | None) -> tuple[str | None, list[float] | None, float | None, str | None, str | None]:
    """Type, box, confidence, text and error of one entry in lines of ``key: value``; rulers of # are left out, lines after
    a content key belong to it, and lines of an entry without any key are its text."""
    kind, box, confidence, content, key, known = None, None, None, [], None, False
    for raw in (text or "").splitlines():
        line = raw.strip()
        if line and set(line) == {"#"}:
            continue
        m = KEYED.match(raw)
        if not m:
            if key in ("content", "text", "markdown") or (line and not known):
                content.append(raw)
            continue
        key, value = m[1].strip().lower().replace(" ", "_"), m[2]
        known |= key in ("label", "type", "block_label", "category", "bbox", "box", "coordinate", "content", "text", "markdown", "confidence", "score")
        if key in ("label", "type", "block_label", "category"):
            kind = value.strip() or None
        elif key in ("bbox", "box", "coordinate"):
            try:
                box = [float(x) for x in re.split(r"[,\s]+", value.strip().strip("[]()")) if x]
            except ValueError:
                return None, None, None, None, "bbox"
            if len(box) != 4 or not all(abs(x) < float("inf") for x in box):
                return None, None, None, None, "bbox"
        elif key in ("content", "text", "markdown"):
            content.append(value)
        elif key in ("confidence", "score"):
            try:
                confidence = float(value.strip())
            except ValueError:
                return None, None, None, None, "confidence"
    return kind, box, confidence, "\n".join(content).strip("\n") or None, None


def parsed_entries(entries: DataFrame, entry: str = "entry") -> DataFrame:
    """``entries`` with the struct ``parsed`` (kind, bbox, confidence, text, error)."""

    def parse(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([parse_entry(t) for t in batch], columns=["kind", "bbox", "confidence", "text", "error"])

    parse.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return entries.withColumn("parsed", F.pandas_udf(parse, "kind string, bbox array<double>, confidence double, text string, error string")(F.col(entry)))


def artifacts(rows: DataFrame) -> DataFrame:
    """Outcome of taking in results (inline, content, size, sha256): exactly one source, and bytes as declared."""
    both = F.col("inline").isNotNull() == F.col("content").isNotNull()
    out = F.when(both, "invalid_evidence").when(F.col("content").isNull(), "inline").when(F.col("size") != F.octet_length("content"), "size_mismatch").when(F.lower("sha256") != F.sha2("content", 256), "checksum_mismatch")
    return rows.withColumn("outcome", out.otherwise("artifact"))


def text_health(texts: DataFrame) -> DataFrame:
    """The first reason that speaks against a text layer (text, coverage), in seven steps, or that it is accepted; with its measures."""
    t, n = F.coalesce("text", F.lit("")), F.greatest(F.lit(1), F.length(F.coalesce("text", F.lit(""))))
    count = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(x, r"\s+", "")), lambda x: x != "")
    m = texts.select(
        "doc_id", "coverage", F.length(F.regexp_replace(t, r"\s+", "")).alias("chars"), F.size(lines).alias("lines"),
        F.when(F.length(t) == 0, 0.0).otherwise(F.round(1 - count(r"[\p{Cc}\p{Cf}\p{Co}\p{Cs}\p{Zl}\p{Zp}\p{Zs}&&[^ \n\t]]") / n, 6)).alias("printable"),
        F.when(F.length(t) == 0, 1.0).otherwise(F.round(count(r"[\x00-\x08\x0B\x0C\x0E-\x1F]") / n, 6)).alias("control"),
        count("�").alias("replaced"), F.round((F.size(lines) - F.size(F.array_distinct(lines))) / F.greatest(F.lit(1), F.size(lines)), 6).alias("repeated"),
    )
    reason = (
        F.when(F.col("chars") < LEAST_CHARS, "too_sparse").when(F.col("lines") < LEAST_LINES, "line_count_too_low").when(F.col("coverage") > MOST_COVERAGE, "image_dominates").when(F.col("printable") < PRINTABLE, "printability_failed")
        .when(F.col("control") > CONTROL, "control_characters_failed").when(F.col("replaced") > 0, "replacement_characters_failed").when(F.col("repeated") > REPEATED, "duplicate_lines_failed").otherwise("accepted")
    )
    return m.select("doc_id", "coverage", *(F.col(c).cast("long").alias(c) for c in ("chars", "lines", "replaced")), "printable", "control", "repeated", reason.alias("reason"))


def caption_or_note(text: Column, kind: Column) -> Column:
    flat = inline_whitespace(text)
    return (kind == "caption") | flat.rlike(CAPTION_CJK) | flat.rlike(CAPTION_EN) | flat.rlike(NOTE)


def review_pages(nodes: DataFrame, observations: DataFrame) -> DataFrame:
    """Pages to review: sorted reasons, the first by priority, and the document's order of them.

    ``nodes`` (doc_id, page, kind, state, toc_level, observed_kind, text); ``observations`` (doc_id, page, observed_kind,
    confidence).
    """
    has = lambda c, tokens: F.lit(False) if not tokens else _any([F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(x)) for x in tokens])
    observed = F.lower(F.coalesce("observed_kind", F.lit("")))
    node_tests = {
        "heading_candidate_page": F.col("kind").isin("title", "heading"), "unknown_node_page": F.col("kind") == "unknown", "degraded_node_page": F.col("state") == "degraded",
        "toc_page": F.col("toc_level").isNotNull(), "summary_page": has(F.col("observed_kind"), SUMMARY_KINDS) | has(F.col("text"), SUMMARY_TEXTS),
    }
    seen_tests = {
        "low_ocr_confidence_page": F.col("confidence") < LOW_READING, "heading_candidate_page": F.contains(observed, F.lit("title")) | F.contains(observed, F.lit("heading")),
        "toc_page": F.contains(observed, F.lit("toc")) | F.contains(observed, F.lit("table_of_contents")), "summary_page": has(F.col("observed_kind"), SUMMARY_KINDS),
    }
    reasons = lambda tests: F.explode(F.array_compact(F.array(*(F.when(t, F.lit(r)) for r, t in tests.items()))))
    w = Window.partitionBy("doc_id")
    ends = observations.select("doc_id", "page").distinct().select("doc_id", "page", F.min("page").over(w).alias("a"), F.max("page").over(w).alias("b"))
    edge = ends.select("doc_id", "page", reasons({"first_page": F.col("page") == F.col("a"), "last_page": F.col("page") == F.col("b")}).alias("reason"))
    found = edge.unionByName(nodes.select("doc_id", "page", reasons(node_tests).alias("reason"))).unionByName(observations.select("doc_id", "page", reasons(seen_tests).alias("reason")))
    pages = found.groupBy("doc_id", "page").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    rank = F.create_map(*(F.lit(x) for i, r in enumerate(REASONS) for x in (r, i)))
    ranked = pages.withColumn("priority", F.array_min(F.transform("reasons", lambda r: rank[r])))
    place = F.row_number().over(w.orderBy("priority", "page")) - 1
    return ranked.select("doc_id", "page", F.array_join("reasons", ",").alias("reasons"), "priority", place.cast("long").alias("place"))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def covers(nodes: DataFrame, reviews: DataFrame) -> DataFrame:
    """Whether each document's first page is its cover: as its most confident review of 0.85 or more says, else few nodes, little
    text, a heading and none of the kinds that covers lack. Furniture and carriers of reviews are no nodes here."""
    first = nodes.where("page = 0 AND kind NOT IN ('header', 'footer', 'footnote')")
    agg = first.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.trim(F.coalesce("text", F.lit(""))))).alias("chars"), F.max((F.col("kind").isin("title", "heading")).cast("int")).alias("heads"), F.max(F.col("kind").isin(*COVER_KINDS_OUT).cast("int")).alias("out"))
    best = reviews.where("page = 0").groupBy("doc_id").agg(F.max_by("role", F.struct("confidence", "role")).alias("role"), F.max("confidence").alias("confidence"))
    sure = F.coalesce(F.col("confidence") >= ROLE_CONFIDENCE, F.lit(False))
    rule = (F.col("n") <= COVER_NODES) & (F.col("out") == 0) & (F.col("chars") <= COVER_CHARS) & (F.col("heads") == 1)
    return agg.join(best, "doc_id", "left").select("doc_id", F.when(sure & (F.col("role") == "cover"), True).when(sure & F.col("role").isin(*NOT_COVERS), False).otherwise(rule).alias("is_cover"))


def safe_token(value: Column) -> Column:
    """A value fit for ids: all but letters, digits, dots, underscores and hyphens become hyphens."""
    return F.regexp_replace(F.trim(value), r"[^\p{L}\p{N}._-]", "-")


def heading_marker(text: Column, level: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), F.greatest(F.lit(1), level))), F.lit(" "), F.trim(text))


def image_marker(ident: Column) -> Column:
    return F.concat(F.lit("$%$%$%"), ident, F.lit("$%$%$%"))
