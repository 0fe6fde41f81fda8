"""Reader states, page chunks and counts; scopes, splits and fragments of graphs; polls of provider jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States that readers see, limits of chunks, the end of a contents line, intervals of polls in seconds.
NODE_STATES = {"complete": "ready", "degraded": "degraded", "recovered": "degraded", "unavailable": "unavailable"}
UNIT_STATES = {"complete": "ready", "degraded": "degraded", "no_usable_semantic_content": "no_usable_semantic_content", "unavailable": "unavailable"}
PAGE_LIMIT, MOST_PAGES = 20, 50
LINE_CHARS = 240


def mapped(value: Column, states: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in states.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def warning_code(code: Column) -> Column:
    up = F.upper(code)
    return F.when(F.contains(up, F.lit("ASSET")), "asset_unavailable").when(F.contains(up, F.lit("UNAVAILABLE")) | F.contains(up, F.lit("MISSING")), "content_unavailable").otherwise("content_degraded")


def document_states(units: DataFrame) -> DataFrame:
    """What readers see of each document: counts of its units by state, and one state for all. ``units`` (doc_id, state)."""
    n, total = {s: F.count(F.when(F.col("state") == s, 1)) for s in UNIT_STATES}, F.count(F.lit(1))
    empty, gone = n["no_usable_semantic_content"], n["unavailable"]
    overall = F.when(empty == total, "no_usable_semantic_content").when(gone == total, "unavailable").when(n["complete"] == total, "ready").otherwise("degraded")
    return units.groupBy("doc_id").agg(total.alias("units"), *(n[s].alias(f"n_{s}") for s in UNIT_STATES), overall.alias("state"))


def page_chunk(pages: DataFrame, start: int, limit: int = PAGE_LIMIT) -> DataFrame:
    """The pages (doc_id, page, location) from ``start`` on, ``limit`` at most, with whether more follow and where. A page's place is its
    rank, so gaps in the numbers cost nothing."""
    if not 1 <= limit <= MOST_PAGES:
        raise ValueError(f"limit must be 1 to {MOST_PAGES}")
    w = Window.partitionBy("doc_id").orderBy("page")
    ranked = pages.where(F.col("page") >= start).withColumn("place", F.row_number().over(w))
    after = F.max(F.when(F.col("place") == limit + 1, F.struct("page", "location"))).over(Window.partitionBy("doc_id"))
    seen = ranked.withColumn("after", after).where(F.col("place") <= limit)
    return seen.select("doc_id", "page", "location", F.col("after").isNotNull().alias("has_more"), F.col("after.page").alias("next_page"), F.col("after.location").alias("next_location"))


def scoped(nodes: DataFrame, observations: DataFrame, evidence: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph of some ``units`` (doc_id, unit): their observations; nodes that touch them, cut to them; and the evidence that these
    name, or that is of such a unit or observation."""
    seen = observations.join(units, ["doc_id", "unit"], "left_semi")
    kept = units.groupBy("doc_id").agg(F.collect_set("unit").alias("scope"))
    here = nodes.join(kept, "doc_id").withColumn("units", F.filter("units", lambda x: F.array_contains("scope", x))).where(F.size("units") > 0).drop("scope")
    known = seen.groupBy("doc_id").agg(F.collect_set("observation").alias("known"))
    here = here.join(known, "doc_id", "left").withColumn("observations", F.filter("observations", lambda x: F.coalesce(F.array_contains("known", x), F.lit(False)))).drop("known")
    named = seen.select("doc_id", F.explode("evidences").alias("evidence")).unionByName(here.select("doc_id", F.explode("evidences").alias("evidence"))).distinct()
    by = [evidence.join(named, ["doc_id", "evidence"], "left_semi"), evidence.join(units, ["doc_id", "unit"], "left_semi"), evidence.join(seen.select("doc_id", "observation").distinct(), ["doc_id", "observation"], "left_semi").select(evidence.columns)]
    return here, seen, by[0].unionByName(by[1]).unionByName(by[2]).distinct()


def presplit(nodes: DataFrame, line_end: str) -> DataFrame:
    """Nodes with unresolved blocks of contents lines split into their lines, numbered anew: unknown, degraded, with the box sliced.

    ``nodes`` (doc_id, node, ord, parent_node, kind, state, text, top, bottom). A block is split if it is no parent, has two
    lines or more, none long, and all end as ``line_end`` says.
    """
    parents = nodes.where("parent_node IS NOT NULL").select("doc_id", F.col("parent_node").alias("node"), F.lit(True).alias("is_parent")).distinct()
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    joined = nodes.join(parents, ["doc_id", "node"], "left").withColumn("lines", lines)
    open_ = (F.col("kind") == "unknown") | (F.col("state") == "degraded")
    fits = open_ & F.col("is_parent").isNull() & (F.size("lines") >= 2) & F.forall("lines", lambda x: (F.length(x) <= LINE_CHARS) & x.rlike(line_end))
    parts = joined.withColumn("fits", fits).select("*", F.posexplode(F.when(F.col("fits"), F.col("lines")).otherwise(F.array("text"))).alias("i", "line"))
    n, height = F.size("lines"), F.col("bottom") - F.col("top")
    sliced = F.col("fits") & (height > 0)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "node", "i")) - 1
    return parts.select(
        "doc_id", F.when(F.col("fits"), F.concat("node", F.lit(":toc-line:"), F.lpad((F.col("i") + 1).cast("string"), 3, "0"))).otherwise(F.col("node")).alias("node"), order.cast("long").alias("ord"), "parent_node",
        F.when(F.col("fits"), "unknown").otherwise(F.col("kind")).alias("kind"), F.when(F.col("fits"), "degraded").otherwise(F.col("state")).alias("state"), F.when(F.col("fits"), F.col("line")).otherwise(F.col("text")).alias("text"),
        F.when(sliced, F.col("top") + height / n * F.col("i")).otherwise(F.col("top")).alias("top"), F.when(sliced & (F.col("i") < n - 1), F.col("top") + height / n * (F.col("i") + 1)).otherwise(F.col("bottom")).alias("bottom"),
    )


def fragments(nodes: DataFrame, observations: DataFrame) -> DataFrame:
    """The pieces of nodes that lie on several units, in the order of their observations. ``nodes`` (doc_id, node, units,
    observations)."""
    split = nodes.where(F.size("units") > 1).select("doc_id", "node", F.posexplode("observations").alias("place", "observation"))
    return split.join(observations.select("doc_id", "observation", "unit", "text"), ["doc_id", "observation"]).select("doc_id", "node", F.col("place").cast("long").alias("place"), "unit", "text")


def book_status(blocks: DataFrame) -> DataFrame:
    """Counts of a book's text and picture blocks and of its characters. ``blocks`` (doc_id, type, content, page)."""
    text = F.col("type") == "text"
    return blocks.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"), F.count(F.when(text, 1)).alias("text_blocks"), F.count(F.when(F.col("type").isin("image", "table"), 1)).alias("image_blocks"), F.coalesce(F.sum(F.when(text, F.length("content"))), F.lit(0)).cast("long").alias("characters"))


def poll_times(first: float, factor: float, longest: float, deadline: float, most: int | None = None) -> list[float]:
    """The times of all polls: growing intervals up to ``longest``, none at or beyond the deadline, ``most`` at most."""
    out, at, interval = [], 0.0, first
    while at < deadline and (most is None or len(out) < most):
        out.append(at)
        at, interval = at + min(interval, deadline - at), min(interval * factor, longest)
    return out


def polled(jobs: DataFrame, times: list[float]) -> DataFrame:
    """``jobs`` (job, done, status) polled at ``times`` until one finds them done: polls, the time of the last, and the outcome.

    The times are a parameter, a few hundred by the deadline, and the same for all jobs.
    """
    at = F.array(*map(F.lit, times))
    late = F.filter(at, lambda t: t >= F.col("done"))
    found = F.size(late) > 0
    return jobs.select("job", F.when(found, F.size(at) - F.size(late) + 1).otherwise(F.size(at)).cast("long").alias("polls"), F.when(found, F.get(late, 0)).otherwise(F.element_at(at, -1)).alias("last_poll"), F.when(found, F.col("status")).otherwise("timed_out").alias("outcome"))
