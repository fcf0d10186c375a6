"""What depends on order, as window expressions: contested tokens, recency, frontiers, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def contested_running(mentions: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """Mentions (article_id, token, seq, person_id) with the token's owners so far, this one included.

    ``snapshot`` (token, person_id) counts as seen before each article. Owners are counted by marking the
    first mention of each, so no window holds a set.
    """
    rows = mentions.withColumn("__real", F.lit(True))
    if snapshot is not None:
        given = rows.select("article_id", "token").distinct().join(snapshot.distinct(), "token").withColumns({"seq": F.lit(None).cast(mentions.schema["seq"].dataType), "__real": F.lit(False)})
        rows = rows.unionByName(given, allowMissingColumns=True)
    own = W.partitionBy("article_id", "token", "person_id").orderBy(F.col("seq").asc_nulls_first())
    run = W.partitionBy("article_id", "token").orderBy(F.col("seq").asc_nulls_first())
    first = F.when(F.row_number().over(own) == 1, 1).otherwise(0)
    rows = rows.withColumn("__first", first).withColumn("owners", F.sum("__first").over(run.rangeBetween(W.unboundedPreceding, 0)))
    return rows.where("__real").drop("__real", "__first").withColumn("contested", F.col("owners") >= 2)


def recent_owner(mentions: DataFrame) -> DataFrame:
    """With contested mentions: the person of the last contested mention of the token before this one."""
    w = W.partitionBy("article_id", "token").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return mentions.withColumn("recent", F.last(F.when(F.col("contested"), F.col("person_id")), ignorenulls=True).over(w))


def frontier(chunks: DataFrame, *, failed: str = "failed") -> DataFrame:
    """Chunks (article_id, chunk_idx, failed) before their article's first failing one."""
    stop = chunks.where(failed).groupBy("article_id").agg(F.min("chunk_idx").alias("stop"))
    return chunks.join(stop, "article_id", "left").where(F.col("stop").isNull() | (F.col("chunk_idx") < F.col("stop"))).drop("stop")


def chunk_of(position: str, size: int) -> Column:
    return F.floor(F.col(position) / size).cast("long")
