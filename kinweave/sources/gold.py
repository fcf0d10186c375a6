"""Gold files: labelled articles, and alias pairs with the people to seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLES = "id string, comment string, url string, title string, author string, body_text string, people array<string>, relationships array<struct<source: string, target: string, type_keywords: array<string>, note: string>>"
PAIRS = "comment string, canonical_seed array<struct<canonical_name: string, seed_aliases: array<string>>>, pairs array<struct<surface: string, expected: string, expected_stage: string, comment: string>>"


def gold_articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ARTICLES).json(path, multiLine=True)


def gold_edges(articles: DataFrame) -> DataFrame:
    """Gold edges as evaluate.score_edges takes them."""
    rows = articles.select(F.col("id").alias("article_id"), F.posexplode("relationships").alias("pos", "e"))
    return rows.select("article_id", F.lit("gold").alias("side"), "pos", "e.source", "e.target", F.array_join("e.type_keywords", "\x1f").alias("said"))


def alias_pairs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(seeds: canonical_name, surface; pairs: seq, surface, expected, expected_stage)."""
    raw = spark.read.schema(PAIRS).json(path, multiLine=True)
    seeds = raw.select(F.explode("canonical_seed").alias("s")).select("s.canonical_name", F.explode("s.seed_aliases").alias("surface"))
    pairs = raw.select(F.posexplode("pairs").alias("seq", "p")).select("seq", "p.surface", "p.expected", "p.expected_stage")
    return seeds, pairs
