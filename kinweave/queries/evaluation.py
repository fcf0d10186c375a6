"""Queries of scores: quality stands for gold and toxic for what is predicted; small gold edges are literal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators import evaluate
from kinweave.plans.evaluation import evaluate_resolver
from kinweave.queries.registry import query, table

_PRF = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0.0 END AS recall, CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1"


@query(f"""SELECT lang, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM (SELECT *, {_PRF} FROM (
 SELECT lang, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn
 FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY GROUPING SETS ((lang), ())))""")
def a9_a10_prf_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    hit = lambda q, t: ((F.col("quality") == q) & (F.col("toxic") == t)).cast("long")
    got = evaluate.total(rows.select("lang", hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn")), ["lang"])
    return got.select("lang", "tp", "fp", "fn", *(F.round(x, 9).alias(x) for x in ("precision", "recall", "f1")))


_SETS = "WITH d AS (SELECT doc_id, list_distinct(string_split(text, ' ')) AS p, list_distinct(string_split(lower(text), ' ')) AS g FROM documents), c AS (SELECT doc_id, len(list_intersect(p, g)) AS tp, len(p) - len(list_intersect(p, g)) AS fp, len(g) - len(list_intersect(p, g)) AS fn FROM d) "


@query(_SETS + f"SELECT doc_id, tp, fp, fn, round(f1, 9) AS f1 FROM (SELECT *, {_PRF} FROM c)")
def a8_prf_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("p"), F.split(F.lower("text"), " ").alias("g"))
    return evaluate.with_scores(docs.select("doc_id", *evaluate.score_sets(F.col("p"), F.col("g")))).select("doc_id", "tp", "fp", "fn", F.round("f1", 9).alias("f1"))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE lang IS NOT DISTINCT FROM g) AS names_right, count(*) FILTER (WHERE quality IS NOT DISTINCT FROM toxic) AS stages_right,
 round(avg((lang IS NOT DISTINCT FROM g)::INT), 9) AS name_accuracy, round(avg((quality IS NOT DISTINCT FROM toxic)::INT), 9) AS stage_accuracy
 FROM (SELECT CASE WHEN d.doc_id % 10 = 0 THEN NULL ELSE lang END AS lang, CASE WHEN d.doc_id % 10 = 0 THEN NULL WHEN d.doc_id % 4 = 0 THEN 'en' ELSE lang END AS g, quality, toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id)""")
def a11_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    known = F.when(F.col("doc_id") % 10 != 0, F.col("lang"))
    pairs = rows.select(known.alias("expected"), F.when((F.col("doc_id") % 4 == 0) & known.isNotNull(), F.lit("en")).otherwise(known).alias("got"), F.col("quality").alias("expected_stage"), F.col("toxic").alias("got_stage"))
    got = evaluate.accuracy(pairs)
    return got.select("n", "names_right", "stages_right", F.round("name_accuracy", 9).alias("name_accuracy"), F.round("stage_accuracy", 9).alias("stage_accuracy"))


def _edges(spark: SparkSession) -> DataFrame:
    rows = [
        ("a", "predicted", 0, "Dr. Jane Doe", "John Roe", "Criticizes"),
        ("a", "predicted", 1, "Jane Doe", "John Roe", "criticizes"),
        ("a", "predicted", 2, "Jane Doe", "Ann Poe", "strongly supports"),
        ("a", "predicted", 3, "李", "Ann Poe", "supports"),
        ("a", "gold", 0, "Jane Doe", "John Roe", "criticizes\x1fcriticises"),
        ("a", "gold", 1, "Jane Doe", "Ann Poe", "support"),
        ("a", "gold", 2, "Ann Poe", "Jane Doe", "hires"),
        ("b", "predicted", 0, "Max Moe", "Ann Poe", "funds"),
    ]
    return spark.createDataFrame(rows, "article_id string, side string, pos int, source string, target string, said string")


@query("SELECT article_id, tp, fp, fn, precision::DOUBLE AS precision, recall::DOUBLE AS recall, f1::DOUBLE AS f1 FROM (VALUES ('a', 1, 2, 2, 0.333333333, 0.333333333, 0.333333333), ('b', 0, 1, 0, 0.0, 0.0, 0.0)) AS t(article_id, tp, fp, fn, precision, recall, f1)")
def e2_edges_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.score_edges(_edges(spark), fuzzy=False))


@query("SELECT article_id, tp, fp, fn, precision::DOUBLE AS precision, recall::DOUBLE AS recall, f1::DOUBLE AS f1 FROM (VALUES ('a', 2, 1, 1, 0.666666667, 0.666666667, 0.666666667), ('b', 0, 1, 0, 0.0, 0.0, 0.0)) AS t(article_id, tp, fp, fn, precision, recall, f1)")
def e2_edges_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.score_edges(_edges(spark), fuzzy=True))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("article_id", *(F.col(x).cast("int").alias(x) for x in ("tp", "fp", "fn")), *(F.round(x, 9).cast("double").alias(x) for x in ("precision", "recall", "f1")))


@query("""SELECT * FROM (VALUES ('a', 'matched', 0, 'Jane Doe', 'John Roe', 'criticizes|criticises', 'Criticizes'), ('a', 'matched', 1, 'Jane Doe', 'Ann Poe', 'support', 'strongly supports'),
 ('a', 'extra', 0, 'Jane Doe', 'John Roe', NULL, 'criticizes'), ('a', 'extra', 1, '李', 'Ann Poe', NULL, 'supports'), ('a', 'missed', 0, 'Ann Poe', 'Jane Doe', 'hires', NULL), ('b', 'extra', 0, 'Max Moe', 'Ann Poe', NULL, 'funds')) AS t(article_id, label, pos, source, target, keywords, said)""")
def e3_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.edge_diff(_edges(spark))


@query("""SELECT * FROM (VALUES (0, 'Dr. Sam Altman', 'Sam Altman', 'alias'), (1, 'Sam Altmann', 'Sam Altman', 'levenshtein'), (2, 'Sam  Altmann', 'Sam Altman', 'alias'),
 (3, 'Altman', 'Sam Altman', 'subname'), (4, 'Anthony', NULL, 'none'), (5, 'Bill Gates', NULL, 'none')) AS t(seq, surface, got, got_stage)""")
def e4_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([(x, x) for x in ("Sam Altman", "Anthony Ha", "Anthony Garcia")], "canonical_name string, surface string")
    asked = ("Dr. Sam Altman", "Sam Altmann", "Sam  Altmann", "Altman", "Anthony", "Bill Gates")
    pairs = spark.createDataFrame([(i, x, None, None) for i, x in enumerate(asked)], "seq int, surface string, expected string, expected_stage string")
    return evaluate_resolver(seeds, pairs).select("seq", "surface", "got", "got_stage")
