"""Queries of text preparation, filters and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import names, text
from kinweave.operators import extract, filters
from kinweave.operators.ordered import chunk_of
from kinweave.queries.registry import query, table

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SENTENCES_SQL = rf"""list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, {_WS})), lambda x: x <> '')"""
NORMAL_SQL = r"""trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(strip_accents({0}), '[^\x00-\x7F]', '', 'g'), '(?i)\b(mr|mrs|ms|dr|prof|sir|dame|lord|lady|rev|gen|col|capt|sgt|cpl|pvt|jr|sr)\.?\b', ' ', 'g')), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"""


def normal_sql(x: str) -> str:
    return NORMAL_SQL.replace("{0}", x)


@query(f"SELECT doc_id, len(s) AS n_sentences, coalesce(list_sum(list_transform(s, lambda x: length(x))), 0)::BIGINT AS total_chars, md5(array_to_string(s, chr(31))) AS digest FROM (SELECT doc_id, {SENTENCES_SQL} AS s FROM documents)")
def t1_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", text.sentences("text").alias("s"))
    total = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), total.alias("total_chars"), F.md5(F.array_join("s", "\x1f")).alias("digest"))


@query(f"""SELECT doc_id, (i // 5)::BIGINT AS chunk_idx, md5(string_agg(x, ' ' ORDER BY i)) AS digest, count(*) AS n_sentences
FROM (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) - 1 AS i FROM (SELECT doc_id, {SENTENCES_SQL} AS s FROM documents)) GROUP BY doc_id, i // 5""")
def t2_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", text.sentences("text").alias("s"))
    rows = s.select("doc_id", F.size("s").alias("n"), F.posexplode(text.chunks("s", 5)).alias("chunk_idx", "chunk"))
    return rows.select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.md5("chunk").alias("digest"), F.least(F.lit(5), F.col("n") - 5 * F.col("chunk_idx")).cast("long").alias("n_sentences"))


@query(f"SELECT doc_id, (CASE WHEN doc_id % 7 = 0 THEN 5 ELSE doc_id % 7 END)::INT AS size, ceil(len(s) / (CASE WHEN doc_id % 7 = 0 THEN 5 ELSE doc_id % 7 END))::BIGINT AS n_chunks FROM (SELECT doc_id, {SENTENCES_SQL} AS s FROM documents)")
def t3_chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text.chunk_size(F.col("doc_id") % 7).alias("size"), text.sentences("text").alias("s"))
    return rows.select("doc_id", "size", F.size(text.chunks(F.col("s"), F.col("size"))).cast("long").alias("n_chunks"))


@query(f"SELECT doc_id, len(s) AS n_sentences, ceil(len(s) / 5)::BIGINT AS n_chunks, sha256(text) AS body_hash FROM (SELECT doc_id, text, {SENTENCES_SQL} AS s FROM documents)")
def t4_body_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text.body_hash("text").alias("body_hash"), text.sentences("text").alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.size(text.chunks("s", 5)).cast("long").alias("n_chunks"), "body_hash")


@query("""SELECT doc_id, md5(concat_ws(chr(10), CASE WHEN doc_id % 3 = 2 THEN 'Title: ' || source END, CASE WHEN doc_id % 2 = 0 THEN 'Author: ' || lang END,
  'URL: http://news.example/' || doc_id, 'Excerpt (' || (doc_id % 4 + 1) || '/9):', text)) AS digest FROM documents""")
def t5_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("doc_id") % 3 == 2, F.col("source")).when(F.col("doc_id") % 3 == 1, F.lit(""))
    author = F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    said = text.message(title, author, F.concat(F.lit("http://news.example/"), F.col("doc_id").cast("string")), F.col("text"), F.col("doc_id") % 4, F.lit(9))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(said).alias("digest"))


@query(f"SELECT doc_id, md5({normal_sql('text')}) AS digest FROM documents")
def t6_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(names.normalize("text")).alias("digest"))


@query(rf"SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS digest FROM documents")
def t7_match_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(names.match_form("text")).alias("digest"))


@query("SELECT token, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(string_split(p_name, ' '), lambda x: length(x) >= 4))) AS token FROM part) GROUP BY token")
def t8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.explode(names.long_tokens(F.col("p_name"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, (i // 3)::BIGINT AS chunk_id, count(*) AS n FROM (SELECT doc_id, generate_subscripts(s, 1) - 1 AS i FROM (SELECT doc_id, {SENTENCES_SQL} AS s FROM documents)) GROUP BY ALL")
def w3_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.sentences("text")).alias("pos", "sentence"))
    return rows.groupBy("doc_id", chunk_of("pos", 3).alias("chunk_id")).agg(F.count("*").alias("n"))


_CASES = ("OpenAI", "Staff  Writer", "N/A", "Acme Corp.", "Jane Doe", "Foo Holdings;", "Dr. OpenAI", "OpenAI.", "  ", "The Board", "X", "Ximena Lopez")
_ORGS = ", ".join(f"'{x}'" for x in names.ORGANISATIONS + names.PLACEHOLDERS)
_SUFF = ", ".join(f"'{x}'" for x in names.SUFFIXES)


def _org_sql(x: str) -> str:
    low = rf"trim(regexp_replace(lower(coalesce({x}, '')), '\s+', ' ', 'g'))"
    return rf"({low} = '' OR {low} IN ({_ORGS}) OR regexp_replace(list_extract(string_split({low}, ' '), -1), '[.,;:!?]+$', '') IN ({_SUFF}))"


_NAME_SQL = "CASE doc_id % 3 WHEN 0 THEN [{}][(doc_id // 3 % {})::INT + 1] WHEN 1 THEN text ELSE text || ' Inc.' END".format(", ".join(f"'{x}'" for x in _CASES), len(_CASES))


def _name():
    case = F.element_at(F.array(*map(F.lit, _CASES)), (F.floor(F.col("doc_id") / 3) % len(_CASES) + 1).cast("int"))
    return F.when(F.col("doc_id") % 3 == 0, case).when(F.col("doc_id") % 3 == 1, F.col("text")).otherwise(F.concat("text", F.lit(" Inc.")))


@query(f"SELECT doc_id, name, {_org_sql('name')} AS flagged FROM (SELECT doc_id, {_NAME_SQL} AS name FROM documents)")
def f1_org_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", _name().alias("name")).select("doc_id", "name", names.is_organisation("name").alias("flagged"))


@query(f"""WITH n AS (SELECT doc_id, {_NAME_SQL} AS a, 'Jane Doe' AS b, lang || ' Corp.' AS c FROM documents),
p AS (SELECT doc_id, unnest([a, b, c]) AS x FROM n), e AS (SELECT doc_id, a AS s, b AS t FROM n UNION ALL SELECT doc_id, b, c FROM n UNION ALL SELECT doc_id, b, b FROM n),
bad AS (SELECT doc_id, x FROM p WHERE {_org_sql('x')} UNION SELECT doc_id, x FROM (SELECT doc_id, unnest([s, t]) AS x FROM e) WHERE {_org_sql('x')})
SELECT n.doc_id, (SELECT count(*) FROM p WHERE p.doc_id = n.doc_id AND NOT {_org_sql('x')}) AS n_people,
 (SELECT count(*) FROM e WHERE e.doc_id = n.doc_id AND NOT {_org_sql('s')} AND NOT {_org_sql('t')}) AS n_edges,
 (SELECT string_agg(x, '|' ORDER BY x) FROM bad WHERE bad.doc_id = n.doc_id) AS dropped FROM n""")
def f2_filter_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _name().alias("a"), F.lit("Jane Doe").alias("b"), F.concat("lang", F.lit(" Corp.")).alias("c"))
    edge = lambda s, t: F.struct(F.col(s).alias("source_person"), F.col(t).alias("target_person"), F.lit("knows").alias("relation_type"))
    rows = docs.select("doc_id", F.array(*(F.struct(F.col(x).alias("name")) for x in "abc")).alias("people"), F.array(edge("a", "b"), edge("b", "c"), edge("b", "b")).alias("relationships"))
    got = filters.filter_extraction(rows)
    return got.select("doc_id", F.size("people").cast("long").alias("n_people"), F.size("relationships").cast("long").alias("n_edges"), F.array_join("dropped_people", "|").alias("dropped"))


_KEYS = ["standard", " Promo ", "med"]


@query("""SELECT p_partkey, lower(trim(said)) IN ('standard', 'promo', 'med') AS strict,
 (contains(lower(trim(said)), 'standard') OR contains(lower(trim(said)), 'promo') OR contains(lower(trim(said)), 'med')) AS fuzzy
FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN ' ' || p_type ELSE 'is ' || p_type END AS said FROM part)""")
def f5_f6_relation_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), "p_type")).otherwise(F.concat(F.lit("is "), "p_type"))
    keys = F.array(*map(F.lit, _KEYS))
    return table(spark, sf_dir, "part").select("p_partkey", names.relation_matches(said, keys, fuzzy=False).alias("strict"), names.relation_matches(said, keys, fuzzy=True).alias("fuzzy"))


@query(r"""SELECT event_id, CAST(json_extract_string(j, '$.k') AS BIGINT) AS k FROM (SELECT event_id, nullif(regexp_extract(CASE WHEN event_id % 5 = 0 THEN 'no answer' ELSE 'Sure!' || chr(10) || props || chr(10) || 'Anything else?' END, '(?s)(\{.*\})', 1), '') AS j FROM events)""")
def x3_json_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 5 == 0, F.lit("no answer")).otherwise(F.concat(F.lit("Sure!\n"), "props", F.lit("\nAnything else?")))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(extract.json_in(raw), "k BIGINT")["k"].alias("k"))


@query()
def x4_extract_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("article_id"), F.concat(F.lit("http://news.example/"), F.col("doc_id").cast("string")).alias("url"), F.lit(None).cast("string").alias("title"), "lang", F.initcap("source").alias("author"), text.chunks(text.sentences("text"), 5).alias("chunks"))
    return extract.extract_chunks(extract.messages(docs), extract.RuleClient()).select("article_id", "chunk_idx", F.size("people").alias("n_people"), F.size("relationships").alias("n_edges"), "error")


@query("""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, ' '), lambda x: trim(replace(x, chr(160), ' '), ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i), ', ') AS author FROM s""")
def s8_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.split("text", " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.distinct_names(listed), ", ").alias("author"))


@query("""SELECT conv_id, turn, role, rn_text FROM (SELECT conv_id, turn, role, md5(text) AS rn_text, row_number() OVER (PARTITION BY conv_id, lower(trim(role)) ORDER BY turn) AS rn FROM conversations) WHERE rn = 1""")
def a2_merge_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.md5("text").alias("rn_text"))
    return extract.merge_first_wins(rows, ["conv_id"], F.lower(F.trim("role")), ["turn"]).select("conv_id", "turn", "role", "rn_text")


@query(f"SELECT count(*) AS n, count(DISTINCT lang) AS langs, list_aggregate(list_sort(array_agg(DISTINCT nm)), 'string_agg', '|') AS shown FROM (SELECT lang, {normal_sql('source || lang')} AS nm FROM documents) WHERE nm <> ''")
def a16_distinct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", names.normalize(F.concat("source", "lang")).alias("nm")).where("nm <> ''")
    return rows.agg(F.count("*").alias("n"), F.countDistinct("lang").alias("langs"), F.array_join(F.sort_array(F.collect_set("nm")), "|").alias("shown"))
