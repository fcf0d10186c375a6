"""Queries of resolution: part names are the aliases; surfaces are those names, shortened, misspelt and turned round."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators import fuzzy, resolve
from kinweave.operators.resolve_state import merge_across, resolve_articles
from kinweave.plans.shared import kept
from kinweave.queries.registry import query, table
from kinweave.queries.text import normal_sql

_BASE = f"""WITH aliases AS (SELECT DISTINCT p_name AS surface_form, 'p_' || p_name AS person_id, upper(p_name) AS canonical_name FROM part),
surfaces AS (SELECT surface_form AS surface FROM aliases UNION SELECT left(surface_form, length(surface_form) - 1) FROM aliases UNION SELECT string_split(surface_form, ' ')[2] FROM aliases
  UNION SELECT string_split(surface_form, ' ')[2] || ' ' || string_split(surface_form, ' ')[1] FROM aliases UNION SELECT 'Dr. ' || upper(surface_form) FROM aliases UNION SELECT 'zq ' || string_split(surface_form, ' ')[1] FROM aliases UNION SELECT '' ),
names AS (SELECT surface, {normal_sql('surface')} AS norm FROM surfaces), norms AS (SELECT DISTINCT norm FROM names WHERE norm <> ''),
pairs AS (SELECT n.norm, a.*, 1.0 - levenshtein(n.norm, a.surface_form)::DOUBLE / greatest(length(n.norm), length(a.surface_form), 1) AS sim,
  list_filter(string_split(n.norm, ' '), lambda x: length(x) >= 4) AS toks FROM norms n, aliases a),
best AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY sim DESC, surface_form) AS rn FROM pairs),
sub AS (SELECT norm, list_sort(list_distinct(list(person_id))) AS people FROM pairs WHERE len(toks) > 0 AND list_has_all(string_split(surface_form, ' '), toks) GROUP BY norm),
cand AS (SELECT norm, list_sort(list_distinct(list(canonical_name))) AS candidates FROM pairs WHERE (sim >= 0.5 AND sim < 0.8) OR (sim < 0.8 AND list_has_any(list_filter(string_split(surface_form, ' '), lambda x: length(x) >= 4), toks)) GROUP BY norm) """


def aliases_of(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, d, "part").select(name.alias("surface_form"), F.concat(F.lit("p_"), name).alias("person_id"), F.upper(name).alias("canonical_name")).distinct()


def surfaces_of(aliases: DataFrame) -> DataFrame:
    f, w = F.col("surface_form"), F.split("surface_form", " ")
    forms = F.array(f, F.left(f, F.length(f) - 1), w[1], F.concat_ws(" ", w[1], w[0]), F.concat(F.lit("Dr. "), F.upper(f)), F.concat(F.lit("zq "), w[0]), F.lit(""))
    return aliases.select(F.explode(forms).alias("surface")).distinct()


@query(_BASE + "SELECT norm, person_id, canonical_name FROM norms JOIN aliases ON norm = surface_form")
def j2_exact_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = aliases_of(spark, sf_dir)
    norms = surfaces_of(aliases).select(resolve.normalize("surface").alias("norm")).where("norm <> ''").distinct()
    return resolve.exact_matches(norms, aliases).select("norm", "person_id", "canonical_name")


def _norms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    aliases = aliases_of(spark, d)
    return surfaces_of(aliases).select(resolve.normalize("surface").alias("norm")).where("norm <> ''").distinct(), aliases


@query(_BASE + "SELECT norm, surface_form, round(sim, 9) AS similarity FROM pairs WHERE sim >= 0.8")
def j3_fuzzy_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    norms, aliases = _norms(spark, sf_dir)
    return fuzzy.similar_pairs(norms, aliases, 0.8).select("norm", "surface_form", F.round("similarity", 9).alias("similarity"))


@query(_BASE + "SELECT norm, surface_form, round(sim, 9) AS similarity FROM pairs WHERE sim >= 0.5")
def j3_fuzzy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    norms, aliases = _norms(spark, sf_dir)
    return fuzzy.similar_pairs(norms, aliases, 0.5).select("norm", "surface_form", F.round("similarity", 9).alias("similarity"))


@query(_BASE + "SELECT norm, surface_form FROM pairs WHERE len(toks) > 0 AND list_has_all(string_split(surface_form, ' '), toks)")
def j4_subname_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.subname_pairs(*_norms(spark, sf_dir))


@query(_BASE + "SELECT norm, surface_form FROM pairs WHERE list_has_any(list_filter(string_split(surface_form, ' '), lambda x: length(x) >= 4), toks)")
def j5_sharing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.sharing_pairs(*_norms(spark, sf_dir))


@query(_BASE + "SELECT norm, person_id, round(sim, 9) AS similarity FROM best WHERE rn = 1 AND sim >= 0.8 AND norm NOT IN (SELECT surface_form FROM aliases)")
def r2_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    norms, aliases = _norms(spark, sf_dir)
    rest = norms.join(aliases.select(F.col("surface_form").alias("norm")), "norm", "left_anti")
    return resolve.close_matches(rest, aliases).select("norm", "person_id", F.round("similarity", 9).alias("similarity"))


@query(_BASE + "SELECT norm, len(people)::INT AS n_people, array_to_string(people, '|') AS people FROM sub")
def r25_subname_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.subname_candidates(*_norms(spark, sf_dir)).select("norm", "n_people", F.array_join("people", "|").alias("people"))


@query(_BASE + "SELECT norm, array_to_string(candidates, '|') AS candidates FROM cand WHERE norm NOT IN (SELECT norm FROM pairs WHERE sim >= 0.8)")
def r3_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    norms, aliases = _norms(spark, sf_dir)
    close = fuzzy.similar_pairs(norms, aliases, 0.8).select("norm").distinct()
    return resolve.llm_candidates(norms.join(close, "norm", "left_anti"), aliases).select("norm", F.array_join("candidates", "|").alias("candidates"))


_ALL = _BASE + """SELECT n.surface, n.norm,
 CASE WHEN n.norm = '' THEN NULL WHEN b.sim >= 0.8 THEN b.person_id WHEN len(sub.people) = 1 THEN sub.people[1] END AS person_id,
 CASE WHEN n.norm = '' THEN 'none' WHEN b.surface_form = n.norm THEN 'alias' WHEN b.sim >= 0.8 THEN 'levenshtein' WHEN len(sub.people) = 1 THEN 'subname' WHEN len(sub.people) > 1 THEN 'ambiguous' ELSE 'none' END AS stage
 FROM names n LEFT JOIN best b ON b.norm = n.norm AND b.rn = 1 LEFT JOIN sub ON sub.norm = n.norm"""


@query(_ALL)
def r_resolve_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = aliases_of(spark, sf_dir)
    return resolve.resolve_names(surfaces_of(aliases), aliases).select("surface", "norm", "person_id", "stage")


@query(_BASE + """, rec AS (SELECT token, 'p_' || pick AS person_id FROM (VALUES ('plate', 'new plate'), ('gear', 'large gear'), ('rod', 'hot rod')) AS t(token, pick))
SELECT sub.norm, r.person_id FROM sub JOIN rec r ON list_contains(string_split(sub.norm, ' '), r.token) AND list_contains(sub.people, r.person_id)
WHERE len(people) > 1 AND sub.norm NOT IN (SELECT norm FROM pairs WHERE sim >= 0.8) AND length(r.token) >= 4""")
def r26_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = aliases_of(spark, sf_dir)
    rec = spark.createDataFrame([("plate", "p_new plate"), ("gear", "p_large gear"), ("rod", "p_hot rod")], "token string, person_id string")
    got = resolve.resolve_names(surfaces_of(aliases), aliases, recency=rec)
    plain = resolve.resolve_names(surfaces_of(aliases), aliases).where("stage = 'ambiguous'").select("surface")
    return got.join(plain, "surface").where("stage = 'subname'").select("norm", "person_id").distinct()


@query("SELECT token, array_to_string(list_sort(list_distinct(list(p))), '|') AS owners, count(DISTINCT p) >= 2 AS contested FROM (SELECT 'p_' || p_name AS p, unnest(list_filter(string_split(p_name, ' '), lambda x: length(x) >= 4)) AS token FROM part) GROUP BY token")
def a3_a4_token_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.token_owners(aliases_of(spark, sf_dir)).select("token", F.array_join("owners", "|").alias("owners"), "contested")


@query()
def r4_article_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as articles that mention their parts by name, every second time by the last word alone."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    named = lines.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    surface = F.when(F.col("l_partkey") % 2 == 1, F.get(F.split("p_name", " "), F.lit(1))).otherwise(F.col("p_name"))
    mentions = named.select(F.col("l_orderkey").cast("string").alias("article_id"), F.lit(0).alias("chunk_idx"), F.lit("1person").alias("kind"), F.col("l_partkey").cast("int").alias("pos"), surface.alias("surface"))
    return resolve_articles(mentions, aliases_of(spark, sf_dir)).select("article_id", "pos", "surface", "canonical_name", "stage", "new_person")


_ACROSS = (
    _BASE.replace("WITH aliases", "WITH RECURSIVE aliases", 1)
    + """, n AS (SELECT surface, norm, md5(surface) AS pl, list_filter(string_split(norm, ' '), lambda x: length(x) >= 4) AS mine FROM names),
forms AS (SELECT norm AS form, min(pl) AS since, arg_min(surface, pl) AS owner FROM n WHERE norm <> '' GROUP BY norm),
e AS (SELECT surface AS p, norm, mine, form, since, owner, 1.0 - levenshtein(norm, form)::DOUBLE / greatest(length(norm), length(form), 1) AS s FROM n JOIN forms ON since < pl AND owner <> surface WHERE norm <> ''),
same AS (SELECT p, owner AS r FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY s DESC, form) AS rn FROM e WHERE s >= 0.8 - 1e-9) WHERE rn = 1),
walk AS (SELECT p, r, 0 AS d FROM same UNION ALL SELECT w.p, s.r, d + 1 FROM walk w JOIN same s ON w.r = s.p),
fst AS (SELECT p, arg_max(r, d) AS r FROM walk GROUP BY p),
short AS (SELECT e.p, min(coalesce(f.r, e.owner)) AS r FROM e LEFT JOIN fst f ON f.p = e.owner WHERE e.p NOT IN (SELECT p FROM fst) AND len(mine) > 0 AND list_has_all(string_split(form, ' '), mine)
  GROUP BY e.p HAVING count(DISTINCT coalesce(f.r, e.owner)) = 1),
links AS (SELECT p, r FROM fst UNION ALL SELECT p, r FROM short),
walk2 AS (SELECT p, r, 0 AS d FROM links UNION ALL SELECT w.p, s.r, d + 1 FROM walk2 w JOIN links s ON w.r = s.p),
ends AS (SELECT p, arg_max(r, d) AS r FROM walk2 GROUP BY p)
SELECT surface, coalesce(r, surface) AS canonical_name, r IS NULL AS new_person FROM n LEFT JOIN ends ON p = surface"""
)


@query(_ACROSS)
def r4_across_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article for each surface, none of which is known: who they are to each other."""
    surfaces = surfaces_of(aliases_of(spark, sf_dir))
    mentions = surfaces.select(F.md5("surface").alias("article_id"), F.lit(0).alias("chunk_idx"), F.lit("1person").alias("kind"), F.lit(0).alias("pos"), "surface")
    none = aliases_of(spark, sf_dir).limit(0)
    found = kept(resolve_articles(mentions, none))
    return merge_across(found, none).select("surface", "canonical_name", "new_person")
