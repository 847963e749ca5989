"""The corpus pipeline: STAGES in order, each written as Parquet and read again by the next.

In every stage rows without an id or with a repeated one are rows of their own, in the order of ids (none last), then of text hashes; a
null text counts as empty; texts are read whole; extra columns pass through (the last stage returns its own); an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickcast.llm import common, exact_dedup, line_quality, near_dedup, packing, phrases


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field takes for bad go. It learns from all labels of the table."""
    model = line_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return line_quality.keep_good(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal texts stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return near_dedup.drop_near_duplicates(docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under repeated windows go; documents stay, with the text that is left and its length."""
    own = common.numbered(docs)
    kept = phrases.remove_repeats(own.select(F.col(common.ROW).alias("doc_id"), "text"), with_text=True).select(F.col("doc_id").alias(common.ROW), F.col("kept_text").alias("text"))
    rest = own.drop("text", "n_chars").join(kept, common.ROW)
    return rest.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of every document, each with its sequence and offset."""
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("substring", substring), ("packing", packing_stage)]

#: Learned scores, token ids and linear-programming patterns are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, out, sf_dir)
        if name != STAGES[-1][0]:
            out = common.written(out, f"pipeline-{name}")
    return out
