"""Bindings of the document operators to the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.session import table


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, body): each document under a numbered heading that recurs, with a caption and a list item."""
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    head = F.concat(F.expr("1 + doc_id div 100"), F.lit("."), F.col("doc_id") % 10, F.lit(" "), F.translate(F.substring(F.coalesce("text", F.lit("")), 1, 30), "\n", " "))
    n = F.lit("\n")
    body = F.concat(head, n, F.coalesce("text", F.lit("")), n, n, head, n, F.lit("Figure "), F.col("doc_id") % 9 + 1, F.lit(": "), F.substring(head, 1, 20), n, F.lit("- item "), F.col("doc_id"), n, head)
    return d.select("doc_id", body.alias("body"))


BOOKS_SQL = """books AS (SELECT doc_id, h || chr(10) || t || chr(10) || chr(10) || h || chr(10) || 'Figure ' || (doc_id % 9 + 1) || ': ' || substr(h, 1, 20) || chr(10) || '- item ' || doc_id || chr(10) || h AS body
 FROM (SELECT doc_id, coalesce(text, '') AS t, (1 + doc_id // 100) || '.' || (doc_id % 10) || ' ' || replace(substr(coalesce(text, ''), 1, 30), chr(10), ' ') AS h FROM documents WHERE doc_id IS NOT NULL))"""


def blocks(lines: DataFrame) -> DataFrame:
    """Layout blocks from numbered lines: 25 rows a page, boxes from row and length, kinds by place."""
    row, n = (F.col("line_no") - 1) % 25, F.col("line_no")
    kind = F.when(n % 17 == 5, "figure").when(n % 17 == 6, "Figure-Caption").when(n % 17 == 11, "table").when(n % 17 == 12, "table caption").when(row == 24, "page number").when((n == 1), "doc_title").when(n % 13 == 0, "section title").otherwise("text")
    return lines.select("doc_id", "line_no", F.col("text"), F.expr("(line_no - 1) div 25").alias("page"), kind.alias("raw_kind"), (row / 25.0).alias("top"), ((row + 1) / 25.0).alias("bottom"), F.lit(0.1).alias("l"), (0.1 + 0.8 * F.least(F.lit(1.0), F.length("text") / 80.0)).alias("r"), (((F.col("doc_id") * 31 + n) % 100) / 100.0).alias("confidence"))


BLOCKS_SQL = """blocks AS (SELECT doc_id, line_no, text, (line_no - 1) // 25 AS page, CASE WHEN line_no % 17 = 5 THEN 'figure' WHEN line_no % 17 = 6 THEN 'Figure-Caption' WHEN line_no % 17 = 11 THEN 'table' WHEN line_no % 17 = 12 THEN 'table caption'
 WHEN (line_no - 1) % 25 = 24 THEN 'page number' WHEN line_no = 1 THEN 'doc_title' WHEN line_no % 13 = 0 THEN 'section title' ELSE 'text' END AS raw_kind,
 ((line_no - 1) % 25) / 25.0::DOUBLE AS top, ((line_no - 1) % 25 + 1) / 25.0::DOUBLE AS bottom, 0.1::DOUBLE AS l, 0.1::DOUBLE + 0.8::DOUBLE * least(1.0::DOUBLE, length(text) / 80.0::DOUBLE) AS r, ((doc_id * 31 + line_no) % 100) / 100.0::DOUBLE AS confidence FROM lines)"""


def any_of(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
