"""Extractions without organisations, and the report of what went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.names import is_organisation
from kinweave.functions.text import let


def filter_extraction(df: DataFrame, people: str = "people", relationships: str = "relationships") -> DataFrame:
    """Drops flagged people and edges with a flagged end; adds dropped_people (sorted, distinct) and dropped_relationships."""
    names = F.concat(F.transform(people, lambda p: p["name"]), F.flatten(F.transform(relationships, lambda e: F.array(e["source_person"], e["target_person"]))))
    # each distinct name is judged once, and all that follows is made from it in one expression
    found = let(F.filter(F.array_distinct(names), is_organisation), lambda bad: _parted(F.col(people), F.col(relationships), bad))
    out = df.withColumn("__x", F.explode(F.array(found)))
    return out.withColumns({c: F.col("__x")[c] for c in ("dropped_people", "dropped_relationships")} | {people: F.col("__x.people"), relationships: F.col("__x.relationships")}).drop("__x")


def _parted(people: Column, relationships: Column, bad: Column) -> Column:
    isin = lambda x: F.exists(bad, lambda y: y.eqNullSafe(x))
    bad_edge = lambda e: isin(e["source_person"]) | isin(e["target_person"])
    return F.struct(
        F.sort_array(bad).alias("dropped_people"),
        F.transform(F.filter(relationships, bad_edge), lambda e: F.struct(e["source_person"], e["target_person"], e["relation_type"])).alias("dropped_relationships"),
        F.filter(people, lambda p: ~isin(p["name"])).alias("people"),
        F.filter(relationships, lambda e: ~bad_edge(e)).alias("relationships"),
    )


def of_sources(df: DataFrame, source_ids: list[str] | None, column: Column | str = "source_id") -> DataFrame:
    """Rows of some sources; none or an empty list means all."""
    return df.where((F.col(column) if isinstance(column, str) else column).isin(*source_ids)) if source_ids else df


def touching(edges: DataFrame, people: DataFrame) -> DataFrame:
    """Edges with either end in ``people`` (person_id): two equi-joins instead of one disjunctive join, each edge once."""
    ids = people.select("person_id").distinct()
    out = edges.join(ids.withColumnRenamed("person_id", "source_person_id"), "source_person_id", "left_semi")
    into = edges.join(ids.withColumnRenamed("person_id", "target_person_id"), "target_person_id", "left_semi")
    return out.unionByName(into.join(ids.withColumnRenamed("person_id", "source_person_id"), "source_person_id", "left_anti"))
