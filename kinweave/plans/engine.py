"""The engine: processing and rescanning articles into a store, and reading the graph."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.config import Settings, between, settings
from kinweave.functions.text import message
from kinweave.operators import reads
from kinweave.operators.extract import Client, RuleClient, extract_chunks
from kinweave.operators.filters import of_sources
from kinweave.operators.resolve_state import Chooser
from kinweave.plans.incremental import apply_extractions, pending_chunks, plan_work
from kinweave.plans.shared import shared_dir
from kinweave.plans.store import Store
from kinweave.schemas import CHUNK_EXTRACTION
from kinweave.sources.html import parse_articles, parse_listings
from kinweave.sources.registry import Registry, fetch_politely, listing_urls


class Engine:
    def __init__(self, spark: SparkSession, store: Store, *, client: Client | None = None, chooser: Chooser | None = None, registry: Registry | None = None, config: Settings | None = None) -> None:
        self.spark, self.store, self.client, self.chooser = spark, store, client or RuleClient(), chooser
        self.registry, self.config = registry or Registry(), config or settings()
        self._temp, self._made = shared_dir(spark), []

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self._temp}/engine-{uuid.uuid4().hex}-{name}"
        df.write.parquet(at)
        self._made.append(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def process(self, articles: DataFrame, *, sentences_per_chunk: int | None = None, batch: tuple[str, int] | None = None, max_parallel: int | None = None, strict: bool = False) -> DataFrame:
        """Processes articles (url, title, author, published_at, body_text, source) and commits once; a summary for each url.

        ``max_parallel`` bounds the tasks that ask the client, by default as configured; 0 asks as widely
        as the cluster shuffles, for bulk loads.

        Extractions are kept in the store by article, body and chunk, so a batch that dies before its
        commit, or runs again, doesn't ask for them again.
        """
        between("sentences_per_chunk", sentences_per_chunk, 1)
        base, before = self.store.version(), len(self._made)
        if batch and self.store.has_batch(*batch):
            return self.spark.createDataFrame([], "article_url string, article_id string, title string, people_resolved long, relationships_stored long, extraction_error string, status string, chunks_processed int, total_chunks int, error string")
        tables = self.store.tables(base)
        sized = articles.withColumn("size", F.lit(sentences_per_chunk or self.config.sentences_per_chunk))
        plan = self._keep(plan_work(sized, tables["articles"], default_size=self.config.sentences_per_chunk), "plan")
        cache = self._extractions()
        rows = pending_chunks(plan, cache).withColumnRenamed("sentences_per_chunk", "chunk_size")
        said = rows.withColumn("message", message(F.col("title"), F.col("author"), F.col("url"), F.col("chunk"), F.col("chunk_idx"), F.col("total_chunks")))
        tasks = self.config.max_parallel_articles if max_parallel is None else max_parallel
        said = said.repartition(tasks, "article_id") if tasks else said.repartition("article_id")
        got = extract_chunks(said, self.client, stop=True).join(rows.select("article_id", "chunk_idx", "body_hash", "chunk_size"), ["article_id", "chunk_idx"])
        fresh = self._keep(got.select("article_id", "body_hash", "chunk_size", "chunk_idx", "people", "relationships", "error"), "fresh")
        fresh.where("error is null").write.mode("append").parquet(f"{self.store.root}/extractions")
        known = plan.where("outcome <> 'done' and not drift").select("article_id", "body_hash", F.col("sentences_per_chunk").alias("chunk_size"), "start_idx")
        asked = self._extractions().join(known, ["article_id", "body_hash", "chunk_size"]).where("chunk_idx >= start_idx").drop("start_idx")
        every = asked.dropDuplicates(["article_id", "body_hash", "chunk_size", "chunk_idx"])
        every = self._keep(every.unionByName(fresh.where("error is not null")), "every")
        c = self.config
        new, summary = apply_extractions(tables, plan, every, keep=self._keep, strict=strict, use_recency=c.resolver_recency_enabled, use_chooser=c.resolver_llm_fallback_enabled, chooser=self.chooser)
        summary = self._keep(summary, "summary")
        self.store.commit(new, batch=batch, base=base)
        for at in self._made[before:-1]:  # all but the summary's
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        del self._made[before:]
        return summary

    def _extractions(self) -> DataFrame:
        at = f"{self.store.root}/extractions"
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(CHUNK_EXTRACTION).parquet(at) if there else self.spark.createDataFrame([], CHUNK_EXTRACTION)

    def submit(self, url: str, fetch: Callable[[str], str | None], *, sentences_per_chunk: int | None = None) -> DataFrame:
        """One article: article_id, url, title, people_found, relationships_found, status."""
        if not url.startswith(("http://", "https://")):
            raise ValueError(f"{url} isn't an http or https URL")
        asked = self.spark.createDataFrame([(url,)], "url string")
        source = asked.select(self.registry.for_url("url").alias("s")).first()["s"]
        if source is None:
            raise ValueError(f"no source for {url}")
        pages = self._keep(fetch_politely(asked, fetch, delay=0), "page")
        articles = parse_articles(pages, source, self.registry.get(source).layout)
        out = self.process(articles, sentences_per_chunk=sentences_per_chunk)
        row = out.first()
        if row is None or row["error"]:
            raise RuntimeError(f"{url}: " + (row["error"] if row else "no article was got"))
        return out.select("article_id", F.col("article_url").alias("url"), "title", F.col("people_resolved").alias("people_found"), F.col("relationships_stored").alias("relationships_found"), "status")

    def rescan(self, fetch: Callable[[str], str | None], *, pages: int | None = None, sentences_per_chunk: int | None = None, source_ids: list[str] | None = None, max_parallel: int | None = None) -> DataFrame:
        """Listing pages of the sources, their articles, and one row about it all. One page's or article's error is its own."""
        pages = self.config.default_pages if pages is None else pages
        between("pages", pages, 1, 20)
        between("max_parallel", max_parallel, 1, 50)
        parallel = max_parallel or self.config.max_parallel_articles
        before = self._keep(reads.counts(self.store.table("people"), self.store.table("relationships")), "before")
        summaries = None
        for source in self.registry.all().values():  # a handful of sites
            if source_ids and source.source_id not in source_ids:
                continue
            sites = of_sources(self.registry.table(self.spark), [source.source_id])
            lists = self._keep(fetch_politely(listing_urls(sites, pages).select("url"), fetch, delay=0), "lists")
            found = parse_listings(lists, source.site_root or source.topic_url, source.layout).select(F.explode("urls").alias("url"))
            found = self._keep(found.groupBy("url").agg(F.count("*").alias("times")), "urls")
            got = self._keep(fetch_politely(found, fetch, delay=source.request_delay, partitions=parallel), "pages")
            articles = parse_articles(got, source.source_id, source.layout)
            done = self.process(articles, sentences_per_chunk=sentences_per_chunk, max_parallel=parallel).select("article_url", "status", "relationships_stored", "error")
            lost = found.join(done.withColumnRenamed("article_url", "url"), "url", "left_anti").join(got.select("url", "error"), "url", "left")
            lost = lost.select(F.col("url").alias("article_url"), F.lit(None).cast("string").alias("status"), F.lit(0).cast("long").alias("relationships_stored"), F.coalesce("error", F.lit("no article was got")).alias("error"))
            again = found.where("times > 1").select(F.col("url").alias("article_url"), F.lit("already_exists").alias("status"), F.lit(0).cast("long").alias("relationships_stored"), F.lit(None).cast("string").alias("error"))
            part = done.unionByName(lost).unionByName(again)
            summaries = part if summaries is None else summaries.unionByName(part)
        if summaries is None:
            summaries = self.spark.createDataFrame([], "article_url string, status string, relationships_stored long, error string")
        after = reads.counts(self.store.table("people"), self.store.table("relationships"))
        return reads.rescan_delta(before, after, reads.rescan_rollup(summaries)).withColumn("pages_crawled", F.lit(pages))

    def people(self, page: int = 1, page_size: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(items, page info)."""
        size = page_size or self.config.default_page_size
        people = self.store.table("people")
        return reads.people_page(people, self.store.table("aliases"), page, size), reads.page_info(people, page, size)

    def person(self, person_id: str) -> DataFrame:
        """One row, or none if there is no such person."""
        t = self.store.tables()
        ids = self.spark.createDataFrame([(person_id,)], "person_id string")
        return reads.person_details(ids, t["people"], t["aliases"], t["relationships"], t["provenance"], t["articles"])

    def article(self, url: str) -> DataFrame:
        return reads.article_by_url(self.store.table("articles"), url)

    def health(self) -> DataFrame:
        return reads.health(self.spark)

