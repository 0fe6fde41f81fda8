"""Review and evidence: page summaries, consensus votes, histogram anchors, context checks, graph fingerprints.

Defined cases: null pages are not observed; a vote without confidence counts as the lowest; empty tables give empty
results.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Limits of votes, peaks and contexts.
ACCEPT_CONFIDENCE, MOST_VOTES, CALL_BUDGET = 0.90, 3, 6
SIGMA, REACH = 2.0, 8
PEAK_RADIUS, SUPPORT_RADIUS, PROMINENCE_RADIUS = 3, 4, 16
LEAST_SUPPORT, LEAST_PROMINENCE, LEAST_DENSITY = 0.0010, 0.08, 0.00010
CONTEXT_ITEMS, CONTEXT_CHARS = 100, 60_000


def page_summary(pages: DataFrame) -> DataFrame:
    """Per document: observed pages, first, last, missing and duplicate ones of ``expected``, and whether all is well."""
    seen = pages.where("page IS NOT NULL").groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"), F.max("expected").alias("expected"))
    twice = F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col("page"))))
    agg = seen.groupBy("doc_id").agg(F.sum("n").alias("observed"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.collect_list("page").alias("pages"), F.max("expected").alias("expected"), twice.alias("twice"))
    missing = F.when(F.col("expected") >= 1, F.array_except(F.sequence(F.lit(1).cast("long"), F.col("expected").cast("long")), "pages")).otherwise(F.expr("cast(array() as array<bigint>)"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return agg.withColumn("gone", missing).select("doc_id", "observed", "first_page", "last_page", text(F.col("gone")).alias("missing"), text(F.col("twice")).alias("duplicates"), ((F.size("gone") == 0) & (F.size("twice") == 0)).alias("valid"))


def consensus(votes: DataFrame, budget: int = CALL_BUDGET) -> DataFrame:
    """Rows (doc_id, crop, n_votes, status, accepted, chosen) from votes (doc_id, crop, vote_no, vote_id, decision, confidence).

    A first accept stands. An adverse first vote asks for a second, a split for a third, two accepts win. The calls
    of a document's crops, in order, share a budget. What a crop would ask for does not depend on the budget, so the
    budget left is a running sum and no replay.
    """
    ok = (F.col("decision") == "accept") & (F.coalesce("confidence", F.lit(0.0)) >= ACCEPT_CONFIDENCE)
    v = votes.where(F.col("vote_no") <= MOST_VOTES).withColumn("ok", F.coalesce(ok, F.lit(False)))
    at = {k: F.max(F.when(F.col("vote_no") == k, F.col("ok"))).alias(f"ok{k}") for k in (1, 2, 3)}
    crops = v.groupBy("doc_id", "crop").agg(*at.values()).where("ok1 IS NOT NULL")
    wants = F.when(F.col("ok1"), 0).when(F.coalesce("ok2", F.lit(False)), 2).otherwise(1)
    before = F.coalesce(F.sum(wants).over(Window.partitionBy("doc_id").orderBy("crop").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = crops.withColumn("left", F.greatest(F.lit(0), budget - before))
    status = (
        F.when(F.col("ok1"), "single_accept").when(F.col("left") < 1, "adverse_unconfirmed").when(F.col("ok2").isNull(), "confirmation_failed").when(~F.col("ok2"), "confirmed_adverse")
        .when(F.col("left") < 2, "split_budget_exhausted").when(F.col("ok3").isNull(), "tie_break_failed").when(F.col("ok3"), "majority_accept").otherwise("majority_adverse")
    )
    decided = left.withColumn("status", status)
    used = F.when(F.col("status").isin("single_accept", "adverse_unconfirmed", "confirmation_failed"), 1).when(F.col("status").isin("majority_accept", "majority_adverse"), 3).otherwise(2)
    final = decided.select("doc_id", "crop", "status", used.cast("long").alias("n_votes"), F.col("status").isin("single_accept", "majority_accept").alias("accepted"))
    best = F.row_number().over(Window.partitionBy("doc_id", "crop").orderBy(F.coalesce("confidence", F.lit(-1.0)).desc(), "vote_no"))
    fit = v.join(final, ["doc_id", "crop"]).where((F.col("vote_no") <= F.col("n_votes")) & (F.col("ok") == F.col("accepted")))
    return fit.withColumn("place", best).where("place = 1").select("doc_id", "crop", "n_votes", "status", "accepted", F.col("vote_id").alias("chosen"))


def kernel(sigma: float = SIGMA, reach: int = REACH) -> list[float]:
    raw = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    return [x / sum(raw) for x in raw]


def dark_peaks(pixels: DataFrame) -> DataFrame:
    """Rows (image, gray, support, prominence, density, qualified, anchor) of the peaks of each image's smoothed histogram.

    ``pixels`` has (image, gray) with grays of 0 to 255. Counts combine before the shuffle; each image is then one
    array of 256 bins, so windows over bins are slices. ``anchor`` marks the darkest qualified peak.
    """
    bins = pixels.where("gray BETWEEN 0 AND 255").groupBy("image", F.col("gray").cast("int").alias("gray")).agg(F.count(F.lit(1)).alias("n"))
    per = bins.groupBy("image").agg(F.map_from_entries(F.collect_list(F.struct("gray", "n"))).alias("m"), F.sum("n").alias("pixels"))
    grays = F.sequence(F.lit(0), F.lit(255))
    hist = per.select("image", "pixels", F.transform(grays, lambda g: F.coalesce(F.element_at("m", g), F.lit(0)).cast("double")).alias("h"))
    weights = F.array(*map(F.lit, kernel()))
    at = lambda a, i: F.element_at(a, i + 1)
    offsets = F.sequence(F.lit(-REACH), F.lit(REACH))
    blur = lambda g: F.aggregate(offsets, F.lit(0.0), lambda s, d: s + at(weights, d + REACH) * at(F.col("h"), F.greatest(F.lit(0), F.least(F.lit(255), g + d))))
    smooth = hist.select("image", "pixels", "h", F.transform(grays, blur).alias("s"))
    inner = F.sequence(F.lit(PEAK_RADIUS), F.lit(255 - PEAK_RADIUS))
    rows = smooth.select("*", F.explode(inner).alias("gray")).withColumn("c", at(F.col("s"), F.col("gray")))
    g = F.col("gray")
    left = lambda r: F.slice("s", F.greatest(F.lit(0), g - r) + 1, F.least(g, F.lit(r)))
    right = lambda r: F.slice("s", g + 2, F.least(255 - g, F.lit(r)))
    near = (F.col("c") > 0) & (F.col("c") >= F.array_max(left(PEAK_RADIUS))) & (F.col("c") >= F.array_max(right(PEAK_RADIUS)))
    falls = (F.col("c") > F.array_min(left(PEAK_RADIUS))) | (F.col("c") > F.array_min(right(PEAK_RADIUS)))
    lo, hi = F.greatest(F.lit(0), g - SUPPORT_RADIUS), F.least(F.lit(255), g + SUPPORT_RADIUS)
    support = F.aggregate(F.slice("h", lo + 1, hi - lo + 1), F.lit(0.0), lambda a, x: a + x) / F.col("pixels")
    saddle = F.greatest(F.array_min(left(PROMINENCE_RADIUS)), F.array_min(right(PROMINENCE_RADIUS)))
    peaks = rows.where(near & falls).select("image", "gray", support.alias("support"), (F.greatest(F.lit(0.0), F.col("c") - saddle) / F.col("c")).alias("prominence"), (F.col("c") / F.col("pixels")).alias("density"))
    fit = peaks.withColumn("qualified", (F.col("support") >= LEAST_SUPPORT) & (F.col("prominence") >= LEAST_PROMINENCE) & (F.col("density") >= LEAST_DENSITY))
    darkest = F.min(F.when(F.col("qualified"), F.col("gray"))).over(Window.partitionBy("image"))
    return fit.select("image", "gray", *(F.round(c, 6).alias(c) for c in ("support", "prominence", "density")), "qualified", F.coalesce(F.col("gray") == darkest, F.lit(False)).alias("anchor"))


def context_check(items: DataFrame) -> DataFrame:
    """Per context: items, characters, and the first rule it breaks (repeated ids, too many items, too large) or ok."""
    ids = items.groupBy("context", "item").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    agg = ids.groupBy("context").agg(F.sum("n").alias("items"), F.sum("chars").alias("chars"), F.max("n").alias("most"))
    verdict = F.when(F.col("most") > 1, "repeated_ids").when(F.col("items") > CONTEXT_ITEMS, "too_many_items").when(F.col("chars") > CONTEXT_CHARS, "too_large").otherwise("ok")
    return agg.select("context", "items", "chars", verdict.alias("verdict"))


def fingerprint(nodes: DataFrame) -> DataFrame:
    """Rows (doc_id, n_nodes, print): an order-free fingerprint of each graph, summed from 48 bits of its rows' hashes."""
    row = F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("node", "parent_node", "kind", "level", "ord")))
    part = F.conv(F.substring(F.sha2(row, 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(part).cast("string").alias("print"))


def create_outcome(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows (doc_id, outcome): created where no graph is stored, existing where it is equal, else conflict."""
    old = fingerprint(stored).select("doc_id", F.col("print").alias("old"))
    joined = fingerprint(incoming).join(old, "doc_id", "left")
    return joined.select("doc_id", F.when(F.col("old").isNull(), "created").when(F.col("old") == F.col("print"), "existing").otherwise("conflict").alias("outcome"))


def title_demotions(assigned: DataFrame, outline: DataFrame) -> DataFrame:
    """Document titles that an outline pass would move from level one: rows (doc_id, line_no, level)."""
    titles = assigned.where("kind = 'title'").select("doc_id", "line_no")
    return titles.join(outline, ["doc_id", "line_no"]).where("level <> 1").select("doc_id", "line_no", "level")
