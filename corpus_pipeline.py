"""The corpus pipeline: documents in, packed windows of token ids out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as
the next one's docs. All but the last keep the columns of documents. Null, empty and very long texts, ties,
repeated rows and ids, empty tables and further columns are treated as the operators' docstrings say: an
empty table gives an empty table, and no stage needs ids to be unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import decontamination, line_dedup, ngram_jaccard, packing, quality, tokens
from kinweave.llm.storage import Scratch, private, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps; those without a word go."""
    return quality.score_quality(spark, docs, table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier places have; what is left empty by that goes.

    What a near copy has of its own, round its edits, stays in pieces, as any text that is found once.
    """
    cleaned = line_dedup.dedup_lines(spark, docs)
    cleaned = cleaned.where(~((F.col("n_removed") > 0) & (F.trim(F.coalesce("text", F.lit(""))) == "")))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cleaned.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, one row: the first by doc_id (nulls last), else any.

    Rows are told apart by their place in a written copy, so neither repeated nor missing ids matter: of
    identical rows one stays, and a text isn't dropped because another of its id is a copy.
    """
    scratch, (row, first) = Scratch(spark, "near"), private(docs.columns, "row", "first")
    numbered = scratch.keep(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = ngram_jaccard.jaccard_groups(spark, numbered.select(F.col(row).alias("doc_id"), "text"))
    groups = scratch.keep(groups.select(F.col("doc_id").alias(row), "component_id"), "groups")
    several = groups.join(groups.where(f"{row} <> component_id").select("component_id").distinct(), "component_id")
    named = several.join(numbered.select(row, F.col("doc_id").cast("long").alias(first)), row)
    kept = named.groupBy("component_id").agg(F.min(F.struct(F.col(first).isNull(), first, row))[row].alias(row)).select(row)
    return numbered.join(several.select(row).join(kept, row, "left_anti"), row, "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontamination.find_passages(spark, docs, table(spark, sf_dir, "benchmark")).where(F.size("hits") == 0).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 1024 tokens."""
    return packing.pack_documents(docs, tokens.default_path())


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL can't express the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs, was = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, at = scratch.write(stage(spark, docs, sf_dir), name)
        if was:  # read by no later plan
            scratch.drop(was)
        was = at
    return STAGES[-1][1](spark, docs, sf_dir)
