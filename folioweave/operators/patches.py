"""Refinement patches: unresolved nodes, order of operations, their application with an audit, and the answers they must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Confidences from which operations are applied; text corrections need more than theirs, and a worse source.
STRUCTURE, TOC_LEVEL, TEXT, TEXT_SOURCE = 0.90, 0.85, 0.90, 0.80


def unresolved(nodes: DataFrame) -> DataFrame:
    """Nodes to review, with the reasons in order: of unknown kind, or degraded."""
    reasons = F.array_compact(F.array(F.when(F.col("kind") == "unknown", "unknown_kind"), F.when(F.col("state") == "degraded", "degraded_recovery_state")))
    return nodes.select("doc_id", "node", reasons.alias("reasons")).where(F.size("reasons") > 0)


def ordered(ops: DataFrame, targets: DataFrame) -> DataFrame:
    """``ops`` (doc_id, node, pos, op) with ``step``, their order. Of nodes to review, a contents level that comes before the node's
    first reclassification waits until right after it; all others keep their place."""
    first = F.min(F.when(F.col("op") == "reclassify_node", F.col("pos"))).over(Window.partitionBy("doc_id", "node"))
    marked = ops.withColumn("first", first).join(targets.select("doc_id", "node", F.lit(True).alias("is_target")), ["doc_id", "node"], "left")
    waits = F.coalesce("is_target", F.lit(False)) & (F.col("op") == "set_toc_level") & (F.col("pos") < F.col("first"))
    at = F.when(F.coalesce(waits, F.lit(False)), F.col("first")).otherwise(F.col("pos"))
    step = F.row_number().over(Window.partitionBy("doc_id").orderBy(at, F.coalesce(waits, F.lit(False)), "pos")) - 1
    return marked.withColumn("step", step.cast("long")).drop("first", "is_target")


START = "named_struct('kind', kind, 'level', level, 'parent_node', parent_node, 'text', text, 'toc_level', cast(null as int), 'state', state, 'warnings', 0, 'reclassified', cast(null as boolean), 'log', cast(array() as array<struct<step:bigint,op:string,value:string,outcome:string>>))"
OUTCOME = f"""CASE WHEN x.op = 'correct_text' THEN CASE WHEN x.confidence <= {TEXT} THEN 'model_confidence_not_strictly_above_threshold' WHEN ocr IS NULL THEN 'source_ocr_confidence_missing'
  WHEN ocr >= {TEXT_SOURCE} THEN 'source_ocr_confidence_not_strictly_below_threshold' WHEN NOT coalesce(a.text, '') <=> x.original THEN 'original_text_differs' ELSE 'applied' END
 WHEN x.op = 'set_toc_level' AND a.kind <> 'list_item' AND NOT coalesce(a.reclassified, true) THEN 'dependent_reclassification_not_applied'
 WHEN x.confidence < CASE WHEN x.op = 'set_toc_level' THEN {TOC_LEVEL} ELSE {STRUCTURE} END THEN 'below_threshold'
 WHEN x.op = 'set_toc_level' AND a.kind <> 'list_item' THEN 'not_a_list_item' WHEN x.op = 'set_parent' AND x.value = node THEN 'own_parent' WHEN x.op = 'set_parent' AND NOT x.has_parent THEN 'parent_missing' ELSE 'applied' END"""


def applied(nodes: DataFrame, ops: DataFrame) -> DataFrame:
    """``nodes`` after their operations in the order of ``step``, with ``log``: each operation's outcome.

    ``nodes`` (doc_id, node, kind, level, parent_node, text, state, ocr); ``ops`` (doc_id, node, step, op, value, level, original,
    confidence). A node's operations are few, and are folded within its row; an operation that cannot be done is refused
    in the log and changes nothing.
    """
    known = nodes.select("doc_id", F.col("node").alias("value"), F.lit(True).alias("is_node"))
    checked = ops.join(known, ["doc_id", "value"], "left").withColumn("has_parent", F.col("value").isNull() | F.coalesce("is_node", F.lit(False)))
    per = checked.groupBy("doc_id", "node").agg(F.array_sort(F.collect_list(F.struct("step", "op", "value", F.col("level").alias("new_level"), "original", "confidence", "has_parent"))).alias("ops"))
    joined = nodes.join(per, ["doc_id", "node"], "left")
    done = f"({OUTCOME}) = 'applied' AND x.op = "
    step = f"""named_struct(
 'kind', CASE WHEN {done}'reclassify_node' THEN x.value WHEN {done}'suppress_as_artifact' THEN 'unknown' ELSE a.kind END,
 'level', CASE WHEN {done}'reclassify_node' THEN CASE WHEN x.value = 'heading' THEN coalesce(x.new_level, a.level, 2) WHEN x.value = 'title' THEN x.new_level END WHEN {done}'suppress_as_artifact' THEN null ELSE a.level END,
 'parent_node', CASE WHEN {done}'set_parent' THEN x.value ELSE a.parent_node END,
 'text', CASE WHEN {done}'correct_text' THEN x.value ELSE a.text END,
 'toc_level', CASE WHEN {done}'set_toc_level' THEN x.new_level ELSE a.toc_level END,
 'state', CASE WHEN {done}'suppress_as_artifact' THEN 'degraded' ELSE a.state END,
 'warnings', a.warnings + CASE WHEN {done}'add_warning' THEN 1 ELSE 0 END,
 'reclassified', CASE WHEN x.op = 'reclassify_node' THEN ({OUTCOME}) = 'applied' ELSE a.reclassified END,
 'log', concat(a.log, array(named_struct('step', x.step, 'op', x.op, 'value', x.value, 'outcome', {OUTCOME}))))"""
    folded = joined.withColumn("z", F.expr(f"aggregate(coalesce(ops, array()), {START}, (a, x) -> {step})"))
    return folded.select("doc_id", "node", *(F.col("z")[c].alias(c) for c in ("kind", "level", "parent_node", "text", "toc_level", "state", "warnings", "log")))


def coverage(targets: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows (doc_id, node, issue): targets without an answer or with several, and answers to what is no target."""
    given = answers.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("n"))
    both = targets.select("doc_id", "node", F.lit(True).alias("asked")).join(given, ["doc_id", "node"], "full")
    issue = F.when(F.col("asked").isNull(), "outside_scope").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return both.select("doc_id", "node", issue.alias("issue")).where("issue IS NOT NULL")


def finalized(before: DataFrame, after: DataFrame) -> DataFrame:
    """Review outcome of each node of ``before`` (doc_id, node, state, split): resolved if a reclassification to a known kind was
    applied. A resolved split line is complete, another resolved node keeps the state from before, the rest that from after."""
    joined = before.join(after.select("doc_id", "node", F.col("state").alias("state_after"), "log"), ["doc_id", "node"])
    resolved = F.exists("log", lambda x: (x["op"] == "reclassify_node") & (x["outcome"] == "applied") & (x["value"] != "unknown"))
    return joined.select("doc_id", "node", resolved.alias("resolved"), F.when(resolved & F.col("split"), "complete").when(resolved, F.col("state")).otherwise(F.col("state_after")).alias("state"))
