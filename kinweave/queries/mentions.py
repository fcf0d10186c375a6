"""Queries of what depends on the order of mentions, over events: a type is an article, props.k a token, a user a person."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators.ordered import contested_running, recent_owner
from kinweave.queries.registry import query, table

_E = "WITH e AS (SELECT event_type AS article_id, (CAST(json_extract_string(props, '$.k') AS BIGINT) % 10) AS token, user_id AS person_id, event_id, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events), "
_C = _E + "c AS (SELECT *, len(list_distinct(list(person_id) OVER (PARTITION BY article_id, token ORDER BY seq ROWS UNBOUNDED PRECEDING))) AS owners FROM e) "


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long") % 10
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("article_id"), k.alias("token"), F.struct("ts", "event_id").alias("seq"), F.col("user_id").alias("person_id"))


@query(_C + "SELECT event_id, owners::BIGINT AS owners, owners >= 2 AS contested FROM c")
def w1_contested_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contested_running(_mentions(spark, sf_dir)).select("event_id", F.col("owners").cast("long").alias("owners"), "contested")


@query(_C + "SELECT event_id, last_value(CASE WHEN owners >= 2 THEN person_id END IGNORE NULLS) OVER (PARTITION BY article_id, token ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS recent FROM c")
def w2_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent_owner(contested_running(_mentions(spark, sf_dir))).select("event_id", "recent")


@query("""WITH e AS (SELECT event_type AS article_id, (CAST(json_extract_string(props, '$.k') AS BIGINT) % 10) AS token, user_id AS person_id, event_id, ts FROM events),
s AS (SELECT DISTINCT token, person_id FROM e WHERE person_id < 3),
u AS (SELECT article_id, token, person_id, event_id, 1 AS real, ts FROM e UNION ALL SELECT DISTINCT e.article_id, s.token, s.person_id, -1, 0, NULL FROM e JOIN s ON e.token = s.token)
SELECT event_id, owners::BIGINT AS owners FROM (SELECT event_id, real, len(list_distinct(list(person_id) OVER (PARTITION BY article_id, token ORDER BY real, ts, event_id RANGE UNBOUNDED PRECEDING))) AS owners FROM u) WHERE real = 1""")
def w1_contested_with_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _mentions(spark, sf_dir)
    given = rows.where("person_id < 3").select("token", "person_id").distinct()
    return contested_running(rows, given).select("event_id", F.col("owners").cast("long").alias("owners"))
