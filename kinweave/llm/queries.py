"""The queries op1 to op10 and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import binary_ids, decontamination, license_scan, line_dedup, ngram_jaccard, packing, pii, quality, tokens, url_filter, vector_dedup
from kinweave.llm.storage import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    said = F.transform("licences", lambda x: F.concat_ws(":", x["licence"], x["start"], x["end"]))
    return found.select(
        "doc_id",
        F.size("licences").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["licence"]))), ",").alias("licences"),
        F.array_max(F.transform("licences", lambda x: x["dice"])).alias("best_dice"),
        F.array_join(said, ",").alias("spans"),
    )


@query
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_groups(spark, table(spark, sf_dir, "documents"))


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokens.default_path())


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "score", "content_score", "meta_score", "kept")


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(spark, table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


ORACLES["op5_line_dedup"] = r"""
WITH pieces AS (
  SELECT doc_id, p, length(p) AS n, k, len(ps) AS many FROM (
    SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS k, ps FROM (
      SELECT doc_id, string_split(replace(regexp_replace(text, '([.!?])( +)', '\1\2' || chr(1), 'g'), chr(10), chr(10) || chr(1)), chr(1)) AS ps
      FROM documents WHERE text IS NOT NULL))
), lines AS (
  SELECT doc_id, k, sum(n) OVER (PARTITION BY doc_id ORDER BY k) - n AS a,
    CASE WHEN k = many THEN p WHEN ends_with(p, chr(10)) THEN left(p, -1) ELSE regexp_replace(p, ' +$', '') END AS s, n
  FROM pieces
), wins AS (
  SELECT doc_id, a, a + sum(n) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS b,
    s || chr(10) || lead(s) OVER w || chr(10) || lead(s, 2) OVER w AS win
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), tokens AS (
  SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS k, chars FROM (
    SELECT doc_id, regexp_extract_all(text, '[ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r]+') AS ts, length(text) AS chars FROM documents WHERE text IS NOT NULL)
), words AS (
  SELECT doc_id, k, chars, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY k) - length(w) AS a, w, length(w) AS n
  FROM (SELECT *, translate(regexp_replace(t, '^[ \t\n\x0B\f\r]+', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM tokens)
), keyed AS (
  SELECT *, (unicode(w[1]) * 7 + unicode(w[n // 2 + 1]) * 31 + unicode(w[n]) * 127 + n * 8191) % 1009 AS key, count(*) OVER (PARTITION BY doc_id) AS total FROM words
), begins AS (
  SELECT DISTINCT doc_id, least % 100000000 AS k FROM (
    SELECT doc_id, k, total, min(key::BIGINT * 100000000 + k) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 18 FOLLOWING) AS least FROM keyed)
  WHERE k + 18 <= total
), spans AS (
  SELECT doc_id, k, a, coalesce(lead(a, 14) OVER w, chars) AS b, total,
    string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 13 FOLLOWING) AS run
  FROM keyed WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), later AS (
  SELECT doc_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, a) AS rn FROM wins
    WHERE win IS NOT NULL AND regexp_matches(win, '[^ \t\n\x0B\f\r]')) WHERE rn > 1
  UNION ALL
  SELECT doc_id, a, b FROM (SELECT doc_id, a, b, row_number() OVER (PARTITION BY run ORDER BY doc_id, a) AS rn
    FROM spans JOIN begins USING (doc_id, k) WHERE k + 13 <= total) WHERE rn > 1
), marked AS (
  SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM later
), islands AS (
  SELECT doc_id, min(a) AS a, max(b) AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM marked) GROUP BY doc_id, g
), gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS past FROM islands
), kept AS (
  SELECT g.doc_id, sum(b - a) AS gone, string_agg(substr(text, past::BIGINT + 1, (a - past)::BIGINT), '' ORDER BY a) || substr(any_value(text), max(b)::BIGINT + 1) AS rest
  FROM gaps g JOIN documents d ON d.doc_id = g.doc_id GROUP BY g.doc_id
), counted AS (SELECT doc_id, count(*) AS n FROM pieces GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0) AS n_lines, coalesce(gone, 0)::BIGINT AS n_removed,
  length(CASE WHEN gone > 0 THEN rest ELSE d.text END) AS kept_chars, md5(CASE WHEN gone > 0 THEN rest ELSE d.text END) AS kept_md5
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN counted c ON c.doc_id = d.doc_id
"""


#: The rules of the query's contract.
URL_RULES = (
    url_filter.host_rule("allow", "com", "/"),
    url_filter.host_rule("block", "example.com", "/en/"),
    url_filter.host_rule("allow", "www.example.com", "/en/"),
    url_filter.host_rule("block", "net", "/es/"),
    url_filter.host_rule("block", "net", "/fr/"),
    *url_filter.list_rules(url_filter.BLOCK_LIST),
)


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_of_documents(spark, table(spark, sf_dir, "documents"))


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_passages(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_distinct(F.sort_array(F.transform("hits", lambda x: x["item_id"])))
    return found.select(
        "doc_id",
        F.size("hits").cast("long").alias("n_hits"),
        (F.size("hits") > 0).alias("contaminated"),
        F.array_join(items.cast("array<string>"), ",").alias("item_ids"),
        F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["words"]).alias("n_words"),
        F.array_join(F.transform(F.sort_array("hits"), lambda x: F.concat_ws(":", x["item_id"], x["start"], x["words"], x["equal"])), ",").alias("spans"),
    )


@query
def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_groups(spark, table(spark, sf_dir, "embeddings"))


@query
def op10_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = binary_ids.write_ids(spark, table(spark, sf_dir, "documents"), tokens.default_path())
    return binary_ids.read_ids(spark, files, digest=True)


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op2_ngram_jaccard"] = (
    r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array({low}, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE []::VARCHAR[] END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 75 * (na.n + nb.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
""".replace("{low}", _LOW)
)
ORACLES["op6_url_filter"] = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), h AS (SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, '.' || coalesce(host, '') AS dotted, coalesce(host, '') || coalesce(path, '') AS t FROM u),
j AS (
  SELECT page_id, host, path,
    CASE WHEN ends_with(dotted, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN ends_with(dotted, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN ends_with(dotted, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN ends_with(dotted, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN ends_with(dotted, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule,
    CASE WHEN regexp_matches(t, '(?i)/login/') THEN '/login/' WHEN regexp_matches(t, '(?i)/login$') THEN '/login|'
      WHEN regexp_matches(t, '(?i)/signin/') THEN '/signin/' WHEN regexp_matches(t, '(?i)/signin$') THEN '/signin|'
      WHEN regexp_matches(t, '(?i)/wp-admin/') THEN '/wp-admin/'
      WHEN regexp_matches(t, '(?i)(?:[^a-z0-9]|^)casino(?:[^a-z0-9]|$)') THEN '^casino^' WHEN regexp_matches(t, '(?i)(?:[^a-z0-9]|^)porn(?:[^a-z0-9]|$)') THEN '^porn^'
      WHEN regexp_matches(t, '(?i)(?:[^a-z0-9]|^)viagra(?:[^a-z0-9]|$)') THEN '^viagra^' WHEN regexp_matches(t, '(?i)(?:[^a-z0-9]|^)xxx(?:[^a-z0-9]|$)') THEN '^xxx^'
      WHEN regexp_matches(t, '(?i)^(?:[^/]*\.)?doubleclick\.net(?:[^a-z0-9]|$)') THEN '||doubleclick.net^' END AS pattern
  FROM h
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL OR pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern FROM j
"""
ORACLES["op8_decontamination"] = r"""
WITH dd AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\pP\pS\pZ\p{Cc}]+'), lambda x: x <> '') AS ws FROM documents),
ii AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\pP\pS\pZ\p{Cc}]+'), lambda x: x <> '') AS ws FROM benchmark),
dw AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p, len(ws) AS n FROM dd),
iw AS (SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS q, len(ws) AS m FROM ii WHERE len(ws) >= 8),
g AS (SELECT doc_id, item_id, p - q AS d, m, n, list(q) AS qs FROM dw JOIN iw ON dw.w = iw.w GROUP BY doc_id, item_id, p - q, m, n HAVING count(*) >= ceil(0.75 * least(16, m))),
s AS (SELECT *, least(16, m) AS k, unnest(range(greatest(0, -d), least(m, n - d) - least(16, m) + 1)) AS s FROM g),
f AS (SELECT doc_id, item_id, d, k, qs, min(s) AS lo, max(s) + k AS hi FROM s WHERE len(list_filter(qs, lambda q: q >= s AND q < s + k)) >= ceil(0.75 * k) GROUP BY doc_id, item_id, d, k, qs),
x AS (SELECT doc_id, item_id, d, list_filter(qs, lambda q: q >= lo AND q < hi) AS inside FROM f),
y AS (SELECT doc_id, item_id, d + list_min(inside) AS start, list_max(inside) - list_min(inside) + 1 AS words, len(inside) AS equal FROM x)
SELECT t.doc_id, count(y.item_id) AS n_hits, count(y.item_id) > 0 AS contaminated, coalesce(array_to_string(list_sort(list_distinct(list(y.item_id))), ','), '') AS item_ids,
  coalesce(sum(y.words), 0)::BIGINT AS n_words, coalesce(string_agg(concat_ws(':', y.item_id, y.start, y.words, y.equal), ',' ORDER BY y.item_id, y.start, y.words, y.equal), '') AS spans
FROM documents t LEFT JOIN y ON y.doc_id = t.doc_id GROUP BY t.doc_id
"""
ORACLES["op9_vector_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
x AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, x.b FROM r JOIN x ON r.b = x.a),
c AS (SELECT a, count(*) AS n FROM x GROUP BY a)
SELECT t.vec_id, coalesce(any_value(c.n), 0) AS n_links, min(r.b) AS component_id, t.vec_id = min(r.b) AS kept
FROM embeddings t JOIN r ON r.a = t.vec_id LEFT JOIN c ON c.a = t.vec_id GROUP BY t.vec_id
"""
