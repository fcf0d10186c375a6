"""Sources: a registry, routing of URLs, listing pages, and a polite reader of a page store."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.request import Request, urlopen

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kinweave.sources.html import Layout

USER_AGENT, TIMEOUT = "Mozilla/5.0 (compatible; kinweave/1.0)", 30


@dataclass(frozen=True)
class Source:
    """A site: its id, its topic's listing, and the layout of its pages."""

    source_id: str
    topic_url: str
    site_root: str = ""
    request_delay: float = 1.5
    layout: Layout = field(default_factory=Layout)

    def listing_url(self, page: int) -> str:
        topic = self.topic_url.rstrip("/") + "/"
        return topic if page <= 1 else f"{topic}page/{page}/"


class Registry:
    """Sources by id, in the order of their first registration; registering an id again replaces it."""

    def __init__(self) -> None:
        self._held: dict[str, Source] = {}

    def register(self, source: Source) -> None:
        self._held[source.source_id] = source

    def get(self, source_id: str) -> Source | None:
        return self._held.get(source_id)

    def all(self) -> dict[str, Source]:
        return dict(self._held)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, s.source_id, s.topic_url, float(s.request_delay)) for k, s in enumerate(self._held.values())]
        return spark.createDataFrame(rows, "priority int, source_id string, topic_url string, request_delay double")

    def for_url(self, url: Column | str) -> Column:
        return route(url, list(self._held))


def host_of(url: Column | str) -> Column:
    return F.lower(F.try_parse_url(F.col(url) if isinstance(url, str) else url, F.lit("HOST")))


def route(url: Column | str, source_ids: list[str]) -> Column:
    """The first source whose id the URL's host holds, anywhere in it; null if none."""
    host = host_of(url)
    return F.coalesce(*(F.when(F.contains(host, F.lit(x.lower())), F.lit(x)) for x in source_ids)) if source_ids else F.lit(None).cast("string")


def route_by_table(urls: DataFrame, sources: DataFrame, *, most: int = 10_000) -> DataFrame:
    """``urls`` with source_id, from a table of sources (priority, source_id) of at most ``most`` rows."""
    rows = sources.select("priority", "source_id").orderBy("priority").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} sources")
    return urls.withColumn("source_id", route("url", [r["source_id"] for r in rows]))


def listing_urls(sources: DataFrame, pages: int) -> DataFrame:
    """source_id, page, url of the first listing pages."""
    topic = F.concat(F.regexp_replace("topic_url", "/+$", ""), F.lit("/"))
    rows = sources.select("priority", "source_id", topic.alias("topic"), F.explode(F.sequence(F.lit(1), F.lit(pages))).alias("page"))
    return rows.select("priority", "source_id", "page", F.when(F.col("page") <= 1, F.col("topic")).otherwise(F.concat("topic", F.lit("page/"), F.col("page").cast("string"), F.lit("/"))).alias("url"))


def http_fetch(url: str) -> str | None:
    """The page at a URL, redirects followed; raises on any error. For ``fetch_politely`` and the engine."""
    with urlopen(Request(url, headers={"User-Agent": USER_AGENT}), timeout=TIMEOUT) as answer:
        return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")


def fetch_politely(urls: DataFrame, fetch: Callable[[str], str | None], *, delay: float, partitions: int | None = None) -> DataFrame:
    """url, html, error of each URL. A host's pages are got by one task, one after another, with a pause before each."""

    def run(batches):
        import pandas as pd

        last: dict[str, float] = {}
        for rows in batches:
            html, errors = [], []
            for url, host in zip(rows["url"], rows["host"], strict=True):
                wait = last.get(host, -1e9) + delay - time.monotonic()
                if wait > 0:
                    time.sleep(wait)
                try:
                    html.append(fetch(url))
                    errors.append(None)
                except Exception as e:  # one page's failure is its own
                    html.append(None)
                    errors.append(str(e) or type(e).__name__)
                last[host] = time.monotonic()
            yield pd.DataFrame({"url": rows["url"], "html": html, "error": errors})

    placed = urls.select("url", F.coalesce(host_of("url"), F.lit("")).alias("host"))
    placed = placed.repartition(partitions, "host") if partitions else placed.repartition("host")
    return placed.mapInPandas(run, "url string, html string, error string")


class PageStore(DataSource):
    """spark.read.format("kinweave_pages"): url and html of stored pages for listing pages 1..pages of a source.

    Options: path (Parquet of url, html that the driver can list), topic_url, pages. A partition is a listing page.
    """

    @classmethod
    def name(cls) -> str:
        return "kinweave_pages"

    def schema(self) -> str:
        return "page int, url string, html string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


@dataclass
class ListingPage(InputPartition):
    number: int

    def __init__(self, number: int) -> None:
        super().__init__(number)
        self.number = number


class PageReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.source = Source("store", options.get("topic_url", "http://localhost/"))
        self.pages = int(options.get("pages", "1"))

    def partitions(self) -> list[ListingPage]:
        return [ListingPage(n) for n in range(1, self.pages + 1)]

    def read(self, partition: ListingPage) -> Iterator[tuple]:
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        url = self.source.listing_url(partition.number)
        for batch in ds.dataset(self.path).to_batches(columns=["url", "html"], filter=pc.field("url") == url):
            for row in batch.to_pylist():
                yield (partition.number, row["url"], row["html"])
