"""Queries of sources: routing, listings, links, bodies, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import text
from kinweave.queries.registry import query, table
from kinweave.sources.html import Layout, parse_articles, parse_listings, tag
from kinweave.sources.registry import Registry, Source, listing_urls, route_by_table

_HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1))"


def _sources() -> Registry:
    out = Registry()
    for k, x in enumerate(("blog", "www", "example.org", "m.")):
        out.register(Source(x, f"https://{x}.site.example/topic" + "/" * (k % 3), request_delay=0.5 * k))
    out.register(Source("blog", "https://news.example/blog/"))
    return out


@query(f"SELECT page_id, CASE WHEN contains({_HOST}, 'blog') THEN 'blog' WHEN contains({_HOST}, 'www') THEN 'www' WHEN contains({_HOST}, 'example.org') THEN 'example.org' WHEN contains({_HOST}, 'm.') THEN 'm.' END AS source_id FROM pages")
def s3_route_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route_by_table(table(spark, sf_dir, "pages"), _sources().table(spark)).select("page_id", "source_id")


@query("SELECT * FROM (VALUES (0, 'blog', 'https://news.example/blog/'), (1, 'www', 'https://www.site.example/topic/'), (2, 'example.org', 'https://example.org.site.example/topic//'), (3, 'm.', 'https://m..site.example/topic')) AS t(priority, source_id, topic_url)")
def s2_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources().table(spark).select("priority", "source_id", "topic_url")


@query("""SELECT source_id, page::INT AS page, CASE WHEN page <= 1 THEN topic ELSE topic || 'page/' || page || '/' END AS url
FROM (VALUES ('blog', 'https://news.example/blog/'), ('www', 'https://www.site.example/topic/'), ('example.org', 'https://example.org.site.example/topic/'), ('m.', 'https://m..site.example/topic/')) AS t(source_id, topic), range(1, 21) AS r(page)""")
def s4_listing_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing_urls(_sources().table(spark), 20).select("source_id", "page", "url")


@query(r"""WITH l AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<a [^>]*href="([^"]+)"', 1) AS hrefs FROM pages),
u AS (SELECT page_id, list_distinct(list_transform(hrefs, lambda x: CASE WHEN starts_with(x, 'http') THEN x ELSE 'https://site.example' || (CASE WHEN starts_with(x, '/') THEN x ELSE '/' || x END) END)) AS urls FROM l)
SELECT page_id, len(urls) AS n_links, array_to_string(list_sort(urls), ' ') AS links FROM u""")
def s5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("url"), "html")
    got = parse_listings(pages, "https://site.example/", Layout(listing=tag("a", attr="href")))
    return got.select(F.col("url").cast("long").alias("page_id"), F.size("urls").cast("long").alias("n_links"), F.array_join(F.sort_array("urls"), " ").alias("links"))


@query(r"""WITH x AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '(?s)<(script|style|nav|aside|figure)[^>]*>.*?</(script|style|nav|aside|figure)>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
p AS (SELECT page_id, string_split(regexp_replace(h, '<p(\s[^>]*)?>', chr(1), 'g'), chr(1))[2:] AS ps FROM x),
c AS (SELECT page_id, list_transform(ps, lambda s: trim(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(s, '(?s)^(.*?)(?:</p>|</article>|</div>|</body>|<(?:div|ul|ol|table|pre|section|footer|header|h[1-6]|blockquote)[\s>]|$)', 1), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&'), ' ' || chr(9) || chr(10) || chr(13) || chr(160))) AS ts FROM p)
SELECT page_id, len(ts) AS n_lines, md5(trim(array_to_string(ts, chr(10)), ' ' || chr(9) || chr(10) || chr(13) || chr(160))) AS body FROM c WHERE trim(array_to_string(ts, chr(10)), ' ' || chr(10)) <> ''""")
def s12_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("url"), "html")
    got = parse_articles(pages, "store")
    raw = got.select(F.col("url").cast("long").alias("page_id"), "body_text")
    return raw.select("page_id", F.size(F.split("body_text", "\n")).cast("long").alias("n_lines"), F.md5("body_text").alias("body"))


_ISO = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')"
_LONG = "strftime(o_orderdate, '%B ') || day(o_orderdate) || ', ' || year(o_orderdate)"


def _written():
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    long = F.date_format("o_orderdate", "MMMM d, yyyy")
    return iso, long


@query(f"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate WHEN 2 THEN date_trunc('day', o_orderdate) WHEN 3 THEN date_trunc('day', o_orderdate) END AS published FROM orders""")
def s9_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso, long = _written()
    k = F.col("o_orderkey") % 5
    when = text.published_at(F.when(k == 0, iso).otherwise(F.lit("soon")), F.when(k == 1, iso), F.when(k == 2, long), F.when(k == 3, F.concat(F.lit("By Jane, "), long, F.lit(" at noon"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", when.alias("published"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate WHEN o_orderkey % 3 = 1 THEN o_orderdate - INTERVAL 2 HOUR END AS at FROM orders")
def s10_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, iso = F.col("o_orderkey") % 3, _written()[0]
    raw = F.when(k == 0, iso).when(k == 1, F.regexp_replace(iso, "Z$", "+02:00")).otherwise(F.concat(F.lit("x"), iso))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.iso_time(raw).alias("at"))


@query("SELECT o_orderkey, date_trunc('day', o_orderdate) AS at FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 2 = 1")
def s11_long_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("on "), _written()[1])).otherwise(F.lit("Foo 99, 1990"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.long_date(raw).alias("at"))


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' END, ''), nullif(CASE WHEN doc_id % 3 = 0 THEN source END, ''), lang) AS title, md5(trim(replace(chr(160) || text || chr(10), chr(160), ' '), ' ' || chr(9) || chr(10) || chr(13))) AS cleaned FROM documents")
def s7_s13_first_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = text.first_filled(F.when(F.col("doc_id") % 2 == 0, F.lit("")), F.when(F.col("doc_id") % 3 == 0, F.col("source")), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", title.alias("title"), F.md5(text.clean(F.concat(F.lit(" "), "text", F.lit("\n")))).alias("cleaned"))


@query("SELECT page_id, url FROM pages WHERE url = (SELECT min(url) FROM pages)")
def s16_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.where(F.col("url") == pages.agg(F.min("url")).first()[0]).select("page_id", "url")
