import json
import time

import pytest
from pyspark.sql import functions as F

from kinweave.sources.gold import alias_pairs, gold_articles, gold_edges
from kinweave.sources.html import Layout, article_fields, listing_links, parse, parse_articles, parse_listings
from kinweave.sources.registry import PageStore, Registry, Source, fetch_politely, listing_urls, route_by_table

LISTING = '<a class="loop-card__title-link" href="https://n.example/two/">B</a><a class="loop-card__title-link" href="https://n.example/one/">A</a><a class="loop-card__title-link" href="https://n.example/one/">A</a>'
FALLBACK = '<h2><a href="https://n.example/three/">C</a></h2><h3><a href="/four/">D</a></h3><p><a href="/no">no</a></p>'
ARTICLE = '<h1 class="article__title">Sam Returns</h1><a class="article__author-name">Jane Doe</a><time class="article__date" datetime="2024-01-15T10:30:00">January 15, 2024</time><div class="article-content"><p>First one.</p><p>Second one.</p><script>bad()</script><nav>noise</nav></div>'
PODCAST = '<div class="wp-block-techcrunch-podcast-single-hero__inner"><h1 class="wp-block-techcrunch-podcast-single-hero__title">Cast</h1><div class="wp-block-techcrunch-podcast-single-hero__meta"><a class="wp-block-tc23-author-card-name__link">Ann Poe</a> <a class="wp-block-tc23-author-card-name__link">Max Moe</a> <a class="wp-block-tc23-author-card-name__link">ann poe</a><span>May 22, 2026</span></div></div><div class="article-content"><p>Talk.</p></div>'
META = '<meta property="article:published_time" content="2026-05-22T09:00:00+00:00">'


def pages(spark, **html):
    return spark.createDataFrame(list(html.items()), "url string, html string")


def test_listings(spark):
    got = {r.url: r.urls for r in parse_listings(pages(spark, a=LISTING, b=FALLBACK, c=None, d=""), "https://n.example/").collect()}
    assert got == {"a": ["https://n.example/two/", "https://n.example/one/"], "b": ["https://n.example/three/", "https://n.example/four/"], "c": [], "d": []}


def test_articles(spark):
    df = pages(spark, std=ARTICLE, pod=META + PODCAST, free=PODCAST, main="<main><p>One.</p><p>Two.</p></main>", none='<h1 class="article__title">x</h1>', null=None)
    got = {r.url: r for r in parse_articles(df, "s").collect()}
    assert set(got) == {"std", "pod", "free", "main"}
    assert (got["std"].title, got["std"].author, str(got["std"].published_at), got["std"].body_text) == ("Sam Returns", "Jane Doe", "2024-01-15 10:30:00", "First one.\nSecond one.")
    assert (got["pod"].title, got["pod"].author, str(got["pod"].published_at)) == ("Cast", "Ann Poe, Max Moe", "2026-05-22 09:00:00")
    assert str(got["free"].published_at) == "2026-05-22 00:00:00"
    assert got["main"].body_text == "One.\nTwo." and got["main"].title is None


def test_malformed_markup():
    assert article_fields("<p><b>a<br><p>b</div></p><script>var t='</p>';</script><p>c", Layout())["body"] == "a\nb\nc"
    assert listing_links(None, Layout()) == [] and parse("<<<>>&amp;").text()


def test_routing_and_listing_urls(spark):
    reg = Registry()
    reg.register(Source("news", "https://news.example/topic", request_delay=0))
    reg.register(Source("new", "https://new.example/t//"))
    reg.register(Source("news", "https://news.example/other/"))
    assert reg.get("news").topic_url.endswith("other/") and list(reg.all()) == ["news", "new"]
    df = spark.createDataFrame([("https://NEWS.example/1",), ("https://renew.example/",), ("https://x.example/news",), ("nonsense",), (None,)], "url string")
    assert [r.source_id for r in route_by_table(df, reg.table(spark)).collect()] == ["news", "new", None, None, None]
    assert [r.url for r in listing_urls(reg.table(spark), 2).orderBy("priority", "page").collect()] == ["https://news.example/other/", "https://news.example/other/page/2/", "https://new.example/t/", "https://new.example/t/page/2/"]


def test_polite_fetch_serialises_a_host(spark):
    df = spark.createDataFrame([(f"http://h.example/{i}",) for i in range(4)], "url string")

    def fetch(url):
        if url.endswith("3"):
            raise OSError("gone")
        return f"{time.time()}"

    got = {r.url[-1]: r for r in fetch_politely(df, fetch, delay=0.2, partitions=3).collect()}
    times = sorted(float(got[k].html) for k in "012")
    assert all(b - a >= 0.19 for a, b in zip(times, times[1:], strict=False)) and got["3"].error == "gone"


def test_page_store_source(spark, tmp_path):
    pages(spark, **{"https://n.example/t/": LISTING, "https://n.example/t/page/2/": FALLBACK, "x": "y"}).write.parquet(str(tmp_path / "p"))
    spark.dataSource.register(PageStore)
    got = spark.read.format("kinweave_pages").options(path=str(tmp_path / "p"), topic_url="https://n.example/t", pages=3).load()
    assert [(r.page, r.url) for r in got.orderBy("page").collect()] == [(1, "https://n.example/t/"), (2, "https://n.example/t/page/2/")]


def test_gold_files(spark, tmp_path):
    article = {"id": "g1", "comment": "c", "url": "u", "title": "t", "author": "a", "body_text": "b", "people": ["Ann Poe"], "relationships": [{"source": "Ann Poe", "target": "Max Moe", "type_keywords": ["hire", "employ"], "note": "n"}, {"source": "x", "target": "y", "type_keywords": ["z"]}]}
    (tmp_path / "a.json").write_text(json.dumps([article], indent=1))
    (tmp_path / "p.json").write_text(json.dumps({"comment": "c", "canonical_seed": [{"canonical_name": "Ann Poe", "seed_aliases": ["Ann Poe", "A. Poe"]}], "pairs": [{"surface": "Ann", "expected": None, "expected_stage": "none"}]}))
    edges = gold_edges(gold_articles(spark, str(tmp_path / "a.json"))).orderBy("pos").collect()
    assert [(e.source, e.said) for e in edges] == [("Ann Poe", "hire\x1femploy"), ("x", "z")]
    seeds, pairs = alias_pairs(spark, str(tmp_path / "p.json"))
    assert seeds.count() == 2 and pairs.first()["expected"] is None
    assert pairs.select(F.count("*")).first()[0] == 1


def test_bad_page(spark):
    with pytest.raises(ValueError):
        route_by_table(spark.range(1).select(F.lit("u").alias("url")), spark.range(3).select(F.col("id").alias("priority"), F.lit("x").alias("source_id")), most=2)
