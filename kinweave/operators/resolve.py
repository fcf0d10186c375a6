"""Resolution of names against a frozen alias table, stage by stage over sets.

``aliases`` holds surface_form (normalised, unique), person_id and canonical_name. Each stage sees only
what the stages before it left. Ties of the best similarity go to the smallest surface_form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.names import ACCEPT, CANDIDATE, long_tokens, normalize
from kinweave.operators.fuzzy import sharing_pairs, similar_pairs, subname_pairs


def exact_matches(norms: DataFrame, aliases: DataFrame) -> DataFrame:
    found = norms.join(aliases.withColumnRenamed("surface_form", "norm"), "norm")
    return found.select("norm", "person_id", "canonical_name", F.lit("alias").alias("stage"), F.lit(1.0).alias("similarity"))


def close_matches(norms: DataFrame, aliases: DataFrame, least: float = ACCEPT) -> DataFrame:
    """The most similar alias of each name, at least ``least``."""
    pairs = similar_pairs(norms, aliases, least)
    best = pairs.groupBy("norm").agg(F.min(F.struct((-F.col("similarity")).alias("minus"), "surface_form")).alias("m"))
    best = best.select("norm", F.col("m.surface_form").alias("surface_form"), (-F.col("m.minus")).alias("similarity"))
    return best.join(aliases, "surface_form").select("norm", "person_id", "canonical_name", F.lit("levenshtein").alias("stage"), "similarity")


def subname_candidates(norms: DataFrame, aliases: DataFrame) -> DataFrame:
    """norm, n_people, people (sorted ids) of the people that a name may be short for."""
    pairs = subname_pairs(norms, aliases).join(aliases, "surface_form")
    return pairs.groupBy("norm").agg(F.sort_array(F.collect_set("person_id")).alias("people")).withColumn("n_people", F.size("people"))


def llm_candidates(norms: DataFrame, aliases: DataFrame) -> DataFrame:
    """norm, candidates: distinct canonical names that are similar enough to ask about or share a long token."""
    near = similar_pairs(norms, aliases, CANDIDATE).where(F.col("similarity") < ACCEPT).select("norm", "surface_form")
    pairs = near.unionByName(sharing_pairs(norms, aliases)).distinct().join(aliases, "surface_form")
    return pairs.groupBy("norm").agg(F.sort_array(F.collect_set("canonical_name")).alias("candidates"))


def resolve_names(mentions: DataFrame, aliases: DataFrame, *, name: str = "surface", recency: DataFrame | None = None, chosen: DataFrame | None = None) -> DataFrame:
    """Every distinct name with norm, person_id, canonical_name, stage and, where one is asked, candidates.

    ``recency`` (token, person_id) breaks ties of short names; ``chosen`` (norm, canonical_name) holds a
    chooser's picks, which count only if they are candidates. Stages: alias, levenshtein, subname, llm;
    ambiguous and none have no person.
    """
    names = mentions.select(F.col(name).alias("surface")).distinct().withColumn("norm", normalize("surface"))
    norms = names.select("norm").where("norm <> ''").distinct()
    exact = exact_matches(norms, aliases)
    rest = norms.join(exact, "norm", "left_anti")
    close = close_matches(rest, aliases)
    rest = rest.join(close, "norm", "left_anti")
    short = subname_candidates(rest, aliases)
    people = aliases.select("person_id", "canonical_name").distinct()
    one = short.where("n_people = 1").select("norm", F.col("people")[0].alias("person_id")).join(people, "person_id")
    many = short.where("n_people > 1")
    if recency is not None:
        last = many.select("norm", "people", F.explode(long_tokens(F.col("norm"))).alias("token")).join(recency, "token")
        last = last.where(F.array_contains("people", F.col("person_id"))).groupBy("norm").agg(F.collect_set("person_id").alias("p")).where(F.size("p") == 1)
        last = last.select("norm", F.col("p")[0].alias("person_id")).join(people, "person_id")
        one = one.unionByName(last, allowMissingColumns=True)
        many = many.join(last, "norm", "left_anti")
    one = one.select("norm", "person_id", "canonical_name", F.lit("subname").alias("stage"), F.lit(None).cast("double").alias("similarity"))
    rest = rest.join(short, "norm", "left_anti")
    asked = llm_candidates(rest, aliases)
    done = exact.unionByName(close).unionByName(one)
    if chosen is not None:
        picked = asked.join(chosen, "norm").where(F.array_contains("candidates", F.col("canonical_name"))).join(people, "canonical_name")
        done = done.unionByName(picked.select("norm", "person_id", "canonical_name", F.lit("llm").alias("stage"), F.lit(None).cast("double").alias("similarity")))
    out = names.join(done, "norm", "left").join(many.select("norm", F.lit("ambiguous").alias("open")), "norm", "left").join(asked, "norm", "left")
    stage = F.coalesce("stage", "open", F.lit("none"))
    return out.select("surface", "norm", "person_id", "canonical_name", stage.alias("stage"), "similarity", F.when(stage == "none", F.col("candidates")).alias("candidates"))


def token_owners(aliases: DataFrame) -> DataFrame:
    """token, owners (sorted distinct person ids), contested (two owners or more)."""
    rows = aliases.select("person_id", F.explode(long_tokens(F.col("surface_form"))).alias("token"))
    return rows.groupBy("token").agg(F.sort_array(F.collect_set("person_id")).alias("owners")).withColumn("contested", F.size("owners") >= 2)
