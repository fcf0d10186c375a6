"""Keyed writes as functions from tables to tables: first writer wins, ids depend on keys, deletes cascade.

Every function takes the table as it is and the rows to add or the keys to remove, and returns the whole
new table. Committing it is the store's part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.schemas import stable_id


def first_by(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in an order: an aggregate with partial sums, so a hot key is no large task."""
    others = [c for c in rows.columns if c not in keys]
    ranked = F.struct(*(F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)), *others)
    best = rows.groupBy(*keys).agg(F.min(ranked).alias("first"))
    return best.select(*(F.col(c) if c in keys else F.col(f"first.{c}").alias(c) for c in rows.columns))


def new_rows(table: DataFrame, rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Of the rows whose key the table lacks, the first of each key.

    The table is cut down to the rows' keys first: a batch is small next to it, so Spark can send the
    batch's keys to the table's scan instead of shuffling the table.
    """
    there = table.select(*keys).join(rows.select(*keys).distinct(), keys, "left_semi")
    fresh = first_by(rows.join(there, keys, "left_anti"), keys, order)
    return fresh.select(*table.columns)


def insert_new(table: DataFrame, rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The table and its new rows."""
    return table.unionByName(new_rows(table, rows, keys, order))


def new_people(people: DataFrame, names: DataFrame) -> DataFrame:
    """Get or create by exact canonical name (canonical_name, and bio if there): what is created."""
    bio = F.col("bio") if "bio" in names.columns else F.lit(None).cast("string")
    rows = names.where("canonical_name is not null").select(stable_id("canonical_name").alias("person_id"), "canonical_name", bio.alias("bio"))
    return new_rows(people, rows, ["canonical_name"], ["person_id", F.coalesce("bio", F.lit(""))])


def new_aliases(aliases: DataFrame, rows: DataFrame, order: list[Column | str] = ("seq",)) -> DataFrame:
    """surface_form belongs to the first person that claims it, for ever. The empty form isn't kept."""
    rows = rows.where(F.coalesce("surface_form", F.lit("")) != "").withColumn("alias_id", stable_id("surface_form"))
    return new_rows(aliases, rows, ["surface_form"], [*order, "person_id"])


def new_articles(articles: DataFrame, rows: DataFrame, order: list[Column | str] = ("seq",)) -> DataFrame:
    """By url: a row that is there stays untouched."""
    rows = rows.withColumn("article_id", stable_id("url")).withColumn("chunks_processed", F.lit(0))
    return new_rows(articles, rows, ["url"], [*order, "body_hash"])


def new_relationships(relationships: DataFrame, rows: DataFrame, order: list[Column | str] = ("seq",)) -> DataFrame:
    """By source, target and type, in its case: the first explanation stays."""
    keys = ["source_person_id", "target_person_id", "relation_type"]
    rows = rows.withColumn("rel_id", stable_id(*keys))
    return new_rows(relationships, rows, keys, [*order, F.coalesce("explanation", F.lit(""))])


def new_provenance(provenance: DataFrame, rows: DataFrame, order: list[Column | str] = ("seq",)) -> DataFrame:
    """By relationship and article: the first quote stays. Its id is made last, from the keys, and isn't carried."""
    keys = ["rel_id", "article_id"]
    fresh = new_rows(provenance.drop("prov_id"), rows, keys, [*order, F.coalesce("quote", F.lit(""))])
    return fresh.withColumn("prov_id", stable_id(*keys)).select(*provenance.columns)


def _whole(find):
    """The function that returns the table with what ``find`` returns added."""

    def add(table: DataFrame, rows: DataFrame, *order) -> DataFrame:
        return table.unionByName(find(table, rows, *order))

    add.__doc__ = f"The table after: {find.__doc__}"
    return add


add_people, add_aliases, add_articles, add_relationships, add_provenance = map(_whole, (new_people, new_aliases, new_articles, new_relationships, new_provenance))


def advance(articles: DataFrame, progress: DataFrame) -> DataFrame:
    """Sets chunks_processed from progress (article_id, chunks_processed); unknown articles are passed over."""
    new = progress.groupBy("article_id").agg(F.max("chunks_processed").alias("__new"))
    return articles.join(new, "article_id", "left").withColumn("chunks_processed", F.coalesce("__new", "chunks_processed")).select(*articles.columns)


def orphans(relationships: DataFrame, provenance: DataFrame, affected: DataFrame | None = None) -> DataFrame:
    """Of the affected relationships (rel_id), or all, those without any provenance."""
    asked = relationships if affected is None else relationships.join(affected.select("rel_id").distinct(), "rel_id", "left_semi")
    return asked.join(provenance.select("rel_id").distinct(), "rel_id", "left_anti")


def reset_changes(articles: DataFrame, relationships: DataFrame, provenance: DataFrame, resets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a reset of ``resets`` (article_id, body_hash, sentences_per_chunk, total_chunks) changes.

    The articles' new rows, the rel_id of relationships that go, and the prov_id or (rel_id, article_id)
    rows of provenance that go: the articles' own, and the relationships that only it supported. Only
    affected relationships are looked at. People and aliases stay, and so do the articles' other fields.
    """
    ids = resets.select("article_id").distinct()
    gone_provenance = provenance.join(ids, "article_id", "left_semi").select(*provenance.columns)
    affected = gone_provenance.select("rel_id").distinct()
    rest = provenance.join(affected, "rel_id", "left_semi").join(ids, "article_id", "left_anti")
    gone = orphans(relationships, rest, affected).select("rel_id")
    new = resets.groupBy("article_id").agg(*(F.first(c).alias(f"__{c}") for c in ("body_hash", "sentences_per_chunk", "total_chunks")))
    rows = articles.join(new, "article_id")
    for c in ("body_hash", "sentences_per_chunk", "total_chunks"):
        rows = rows.withColumn(c, F.col(f"__{c}"))
    return rows.withColumn("chunks_processed", F.lit(0)).select(*articles.columns), gone, gone_provenance


def reset_articles(articles: DataFrame, relationships: DataFrame, provenance: DataFrame, resets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New (articles, relationships, provenance) after a reset, as whole tables."""
    rows, _, _ = reset_changes(articles, relationships, provenance, resets)
    ids = resets.select("article_id").distinct()
    # whole tables are read once: a relationship goes if it had provenance and all of it goes
    told = provenance.select("rel_id", "article_id").join(ids.withColumn("__gone", F.lit(True)), "article_id", "left")
    gone = told.groupBy("rel_id").agg(F.min(F.coalesce("__gone", F.lit(False))).alias("all")).where("all").select("rel_id")
    return articles.join(ids, "article_id", "left_anti").select(*articles.columns).unionByName(rows), relationships.join(gone, "rel_id", "left_anti").select(*relationships.columns), provenance.join(ids, "article_id", "left_anti").select(*provenance.columns)


def delete_people(people: DataFrame, aliases: DataFrame, relationships: DataFrame, provenance: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """People go, and with them their aliases, their edges either way, and those edges' provenance."""
    ids = ids.select("person_id").distinct()
    edges = relationships.join(ids.withColumnRenamed("person_id", "source_person_id"), "source_person_id", "left_anti")
    edges = edges.join(ids.withColumnRenamed("person_id", "target_person_id"), "target_person_id", "left_anti").select(*relationships.columns)
    return people.join(ids, "person_id", "left_anti"), aliases.join(ids, "person_id", "left_anti").select(*aliases.columns), edges, provenance.join(edges.select("rel_id"), "rel_id", "left_semi").select(*provenance.columns)


def delete_articles(articles: DataFrame, provenance: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles go with their provenance; edges stay."""
    ids = ids.select("article_id").distinct()
    return articles.join(ids, "article_id", "left_anti"), provenance.join(ids, "article_id", "left_anti").select(*provenance.columns)
