"""From raw documents to packed training sequences, as a row of stages over Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.llm import packing, quality_rules, secrets, simhash, toxicity
from folioweave.llm.queries import vocabulary
from folioweave.session import fresh, prepare, scratch_path, table


#: A short text is no bad one here, as short pieces pack well: texts without a word go, and all that fail other rules.
RULES = quality_rules.Rules(min_words=1)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    prepare(spark)
    judged = quality_rules.judge(docs, rules=RULES)
    return judged.where(F.col(judged.columns[-1])).select(*(F.col(f"`{c}`") for c in docs.columns))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half; the model learns from the labelled ones that are not held out."""
    prepare(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out("doc_id", 5, 0))
    scored = toxicity.score(docs, model)
    return scored.where(F.col(scored.columns[-1]) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    prepare(spark)
    return simhash.keep_first(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets masked in the text and ``n_chars`` counted anew where the text changed."""
    prepare(spark)
    before = fresh(docs, "text_before")
    masked = secrets.masked(docs.withColumn(before, F.col("text")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("text").eqNullSafe(F.col(before)), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return masked.select(*(F.col(f"`{c}`") for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their token ids and their places in sequences."""
    prepare(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json")).withColumnRenamed("key", "doc_id")


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("simhash", near_duplicate_stage),
    ("secret_scans", secrets_stage),
    ("packing", packing_stage),
]

#: Tokenizers, trained models and hashes of shingles are beyond SQL; tests/llm/test_pipeline.py holds each stage against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
