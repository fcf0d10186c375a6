"""Read queries of the graph: counts, pages, details, and the roll-ups of a rescan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.config import between
from kinweave.operators.filters import touching


def health(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("ok").alias("status"))


def counts(people: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row; each table counts as its partitions are read, and only the counts meet."""
    one = people.agg(F.count("*").alias("people"), F.lit(0).cast("long").alias("relationships"))
    return one.unionByName(relationships.agg(F.lit(0).cast("long").alias("people"), F.count("*").alias("relationships"))).agg(F.sum("people").alias("people"), F.sum("relationships").alias("relationships"))


def with_aliases(people: DataFrame, aliases: DataFrame) -> DataFrame:
    """People with their sorted aliases; those without have an empty list."""
    each = aliases.groupBy("person_id").agg(F.sort_array(F.collect_set("surface_form")).alias("aliases"))
    return people.join(each, "person_id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def total_pages(total: Column, page_size: int) -> Column:
    return F.when(total > 0, F.ceil(total / page_size)).otherwise(F.lit(0)).cast("long")


def page_info(people: DataFrame, page: int, page_size: int) -> DataFrame:
    between("page", page, 1)
    between("page_size", page_size, 1, 200)
    return people.agg(F.count("*").alias("total")).select("total", F.lit(page).cast("long").alias("page"), F.lit(page_size).cast("long").alias("page_size"), total_pages(F.col("total"), page_size).alias("total_pages"))


def people_page(people: DataFrame, aliases: DataFrame, page: int = 1, page_size: int = 20) -> DataFrame:
    """A page by canonical name. Only the page's people are joined with their aliases."""
    between("page", page, 1)
    between("page_size", page_size, 1, 200)
    some = people.select("person_id", "canonical_name").orderBy("canonical_name", "person_id").offset((page - 1) * page_size).limit(page_size)
    return with_aliases(some, aliases.join(F.broadcast(some.select("person_id")), "person_id", "left_semi"))  # a page has 200 rows at most


def people_after(people: DataFrame, aliases: DataFrame, last: tuple[str, str] | None, page_size: int = 20) -> DataFrame:
    """The page after (canonical_name, person_id): deep pages without a scan of those before."""
    between("page_size", page_size, 1, 200)
    rest = people if last is None else people.where((F.col("canonical_name") >= last[0]) & ((F.col("canonical_name") > last[0]) | (F.col("person_id") > last[1])))  # the first part reaches the scan
    return people_page(rest, aliases, 1, page_size)


def person_details(ids: DataFrame, people: DataFrame, aliases: DataFrame, relationships: DataFrame, provenance: DataFrame, articles: DataFrame) -> DataFrame:
    """For each asked person_id that there is: the person, aliases, and every touching edge with both names and provenance."""
    ids = ids.select("person_id").distinct()
    edges = touching(relationships, ids)
    name = lambda s: people.select(F.col("person_id").alias(f"{s}_person_id"), F.col("canonical_name").alias(f"{s}_person_name"))
    edges = edges.join(name("source"), "source_person_id", "left").join(name("target"), "target_person_id", "left")
    quoted = provenance.join(edges.select("rel_id"), "rel_id", "left_semi").join(articles.select("article_id", F.col("url").alias("article_url"), F.col("title").alias("article_title")), "article_id")
    quotes = quoted.groupBy("rel_id").agg(F.sort_array(F.collect_list(F.struct("article_id", "article_url", "article_title", "quote"))).alias("provenance"))
    empty = F.from_json(F.lit("[]"), "array<struct<article_id:string,article_url:string,article_title:string,quote:string>>")
    edges = edges.join(quotes, "rel_id", "left").withColumn("provenance", F.coalesce("provenance", empty))
    shown = F.struct(F.col("rel_id").alias("id"), "source_person_id", "source_person_name", "target_person_id", "target_person_name", "relation_type", F.coalesce("explanation", F.lit("")).alias("explanation"), "provenance")
    ends = edges.select(F.explode(F.array_distinct(F.array("source_person_id", "target_person_id"))).alias("person_id"), shown.alias("e")).join(ids, "person_id", "left_semi")
    listed = ends.groupBy("person_id").agg(F.sort_array(F.collect_list("e")).alias("relationships"))
    out = with_aliases(people.join(ids, "person_id", "left_semi"), aliases).join(listed, "person_id", "left")
    return out.select("person_id", "canonical_name", "aliases", "bio", F.coalesce("relationships", F.filter(F.array(F.lit(None).cast(listed.schema["relationships"].dataType.elementType)), lambda x: x.isNotNull())).alias("relationships"))


def article_by_url(articles: DataFrame, url: str) -> DataFrame:
    return articles.where(F.col("url") == url)


def rescan_rollup(summaries: DataFrame) -> DataFrame:
    """Summaries (article_url, status, relationships_stored, error) of one rescan in a row."""
    done = (F.col("status") == "processed") & F.col("error").isNull()
    return summaries.agg(
        F.count_if(done).alias("articles_processed"),
        F.count_if((F.col("status") == "already_exists") & F.col("error").isNull()).alias("articles_skipped"),
        F.coalesce(F.sum(F.when(done, F.col("relationships_stored"))), F.lit(0)).cast("long").alias("relationships_stored"),
        F.sort_array(F.collect_list(F.when(F.col("error").isNotNull(), F.concat_ws(": ", "article_url", "error")))).alias("errors"),
    )


def rescan_delta(before: DataFrame, after: DataFrame, rollup: DataFrame) -> DataFrame:
    """The roll-up with new people and relationships (never negative) and whether it is complete. One row each."""
    zero = F.lit(0).cast("long")
    grown = after.unionByName(before.select((-F.col("people")).alias("people"), (-F.col("relationships")).alias("relationships")))
    told = rollup.unionByName(grown.agg(F.sum("people").alias("people"), F.sum("relationships").alias("relationships")), allowMissingColumns=True)
    return told.agg(
        F.max("articles_processed").alias("articles_processed"),
        F.max("articles_skipped").alias("articles_skipped"),
        F.greatest(zero, F.max("people")).alias("new_people"),
        F.greatest(zero, F.max("relationships")).alias("new_relationships"),
        F.when(F.max(F.size("errors")) > 0, "partial").otherwise("complete").alias("status"),
    )
