"""Extraction of people and relationships: clients, JSON recovery, merging, per chunk and per article."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.text import firsts, message, strip
from kinweave.operators.filters import filter_extraction
from kinweave.operators.upserts import first_by
from kinweave.schemas import EXTRACTION_DDL

PEOPLE_RULES = (
    "List the people that the excerpt names, by the fullest name it gives, and how they are related. "
    "Only human beings count: no companies, teams, products or public bodies. "
    "Where an organisation acts, name the person who answers for it if the excerpt does; else leave the relation out. "
    "The author reports on the people that the article is about. "
    "Quote the words that show each relation."
)
ALIAS_RULES = "Say which of the candidates the name means, word for word, or null if none."


class Client(Protocol):
    """Anything that answers a system prompt and a message with JSON of a schema."""

    def complete(self, system: str, user: str, schema: str) -> str: ...


class RuleClient:
    """A deterministic client without a network: capitalised word pairs are people, verbs between them relations."""

    _NAME = re.compile(r"\b([A-Z][\w'’-]+(?: [A-Z][\w'’-]+)+)\b")
    _VERB = re.compile(r"^\W*(?:\w+\W+){0,3}?(\w+(?:ed|es|s))\b")

    def complete(self, system: str, user: str, schema: str) -> str:
        excerpt = user.partition("):\n")[2] or user
        people, edges = [], []
        author = re.search(r"^Author: (.+)$", user, re.MULTILINE)
        for line in re.split(r"(?<=[.!?])\s+", excerpt):
            found = list(self._NAME.finditer(line))
            people += [{"name": m[1], "role": None} for m in found]
            for a, b in zip(found, found[1:], strict=False):
                if verb := self._VERB.match(line[a.end() : b.start()]):
                    edges.append({"source_person": a[1], "target_person": b[1], "relation_type": verb[1], "explanation": line, "supporting_quote": line})
        if author and people:
            people.append({"name": author[1], "role": "author"})
            edges.append({"source_person": author[1], "target_person": people[0]["name"], "relation_type": "reports on", "explanation": "", "supporting_quote": ""})
        return json.dumps({"people": people, "relationships": edges})


class PromptedClient:
    """For models without schema support: the schema goes into the prompt. ``send`` takes (system, user) and returns text."""

    def __init__(self, send: Callable[[str, str], str]) -> None:
        self.send = send

    def complete(self, system: str, user: str, schema: str) -> str:
        return recover_json(self.send(f"{system}\nAnswer with one JSON object of this schema alone: {schema}", user))


class HostedClient:
    """For services that hold answers to a schema: ``send`` takes (system, user, schema)."""

    def __init__(self, send: Callable[[str, str, str], str]) -> None:
        self.send = send

    def complete(self, system: str, user: str, schema: str) -> str:
        return self.send(system, user, schema)


def recover_json(raw: str) -> str:
    """From the first brace to the last; ValueError where there is none."""
    a, b = raw.find("{"), raw.rfind("}")
    if a < 0 or b < a:
        raise ValueError("no JSON object in the answer")
    return raw[a : b + 1]


def alias_chooser(client: Client) -> Callable[[str, list[str]], str | None]:
    """A chooser for the resolver that asks a client; an answer that isn't a candidate is none."""

    def choose(name: str, candidates: list[str]) -> str | None:
        said = json.loads(recover_json(client.complete(ALIAS_RULES, f"Name: {name}\nCandidates:\n" + "\n".join(f"- {c}" for c in candidates), "canonical_name STRING")))
        return said.get("canonical_name") if said.get("canonical_name") in candidates else None

    return choose


def json_in(raw: Column | str) -> Column:
    """The same as an expression: null where there is no object."""
    return F.nullif(F.regexp_extract(F.col(raw) if isinstance(raw, str) else raw, r"(?s)(\{.*\})", 1), F.lit(""))


def parse_extraction(raw: Column | str) -> Column:
    """The extraction in a raw answer, lists empty where missing.

    Null where there is no JSON object, or where an item lacks what it must have: a person a name, a
    relationship both ends, type, explanation and quote. Empty strings are there.
    """
    got = F.from_json(json_in(raw), f"people ARRAY<STRUCT<name: STRING, role: STRING>>, relationships {EXTRACTION_DDL.split('relationships ')[1]}")
    lacks = lambda x, *keys: F.coalesce(F.exists(x, lambda y: F.exists(F.array(y.isNull(), *(y[k].isNull() for k in keys)), lambda z: z)), F.lit(False))
    wrong = lacks(got["people"], "name") | lacks(got["relationships"], "source_person", "target_person", "relation_type", "explanation", "supporting_quote")
    people, edges = F.coalesce(got["people"], F.array()), F.coalesce(got["relationships"], F.array())
    return F.when(got.isNotNull() & json_in(raw).isNotNull() & ~wrong, F.struct(people.alias("people"), edges.alias("relationships")))


def _why(raw: Column | str) -> Column:
    return F.when(json_in(raw).isNull(), F.lit("no JSON object in the answer")).otherwise(F.lit("the answer lacks required fields"))


def extract_raw(chunks: DataFrame, client: Client, *, stop: bool = False) -> DataFrame:
    """Chunks (article_id, chunk_idx, message) with raw answers; a client's exception becomes error.

    With ``stop``, an article's chunks are asked in order by one task, and none after its first error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed: set[str] = set()
        for rows in batches:
            rows = rows[~rows["article_id"].isin(failed)]
            raw, errors, asked = [], [], []
            for article, user in zip(rows["article_id"], rows["message"], strict=True):
                asked.append(article not in failed)
                if not asked[-1]:
                    continue
                try:
                    raw.append(client.complete(PEOPLE_RULES, user, EXTRACTION_DDL))
                    errors.append(None)
                except Exception as e:  # any failure is that chunk's error
                    raw.append(None)
                    errors.append(str(e) or type(e).__name__)
                    if stop:
                        failed.add(article)
            rows = rows[asked]
            yield pd.DataFrame({"article_id": rows["article_id"], "chunk_idx": rows["chunk_idx"], "raw": raw, "error": errors})

    chunks = chunks.select("article_id", "chunk_idx", "message")
    if stop:
        chunks = chunks.sortWithinPartitions("article_id", "chunk_idx")  # the caller has put an article's chunks together
    return chunks.mapInPandas(run, "article_id string, chunk_idx int, raw string, error string")


def _key(*xs: Column) -> Column:
    return F.concat_ws("\u0001", *(F.lower(strip(F.coalesce(x, F.lit("")))) for x in xs))


def merge_lists(people: Column, relationships: Column) -> tuple[Column, Column]:
    """First of each person and of each edge without case and outer white space, in order."""

    return firsts(people, lambda p: _key(p["name"])), firsts(relationships, lambda e: _key(e["source_person"], e["target_person"], e["relation_type"]))


def merge_first_wins(rows: DataFrame, group: list[str], key: Column, order: list[str]) -> DataFrame:
    """The first row of each group and key by ``order``: merging over rows."""
    return first_by(rows.withColumn("__key", key), [*group, "__key"], list(order)).drop("__key")


def messages(articles: DataFrame) -> DataFrame:
    """Articles (article_id, url, title, author, chunks) to one message for each chunk."""
    total = F.size("chunks")
    rows = articles.select("article_id", "url", "title", "author", total.alias("total"), F.posexplode("chunks").alias("chunk_idx", "chunk"))
    return rows.select("article_id", "chunk_idx", message(F.col("title"), F.col("author"), F.col("url"), F.col("chunk"), F.col("chunk_idx"), F.col("total")).alias("message"))


def extract_chunks(chunks: DataFrame, client: Client, *, stop: bool = False) -> DataFrame:
    """Per chunk: article_id, chunk_idx, people, relationships, dropped lists, error."""
    got = extract_raw(chunks, client, stop=stop).withColumn("x", parse_extraction("raw"))
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("x").isNull(), _why("raw"))
    people, edges = merge_lists(F.col("x.people"), F.col("x.relationships"))
    none_p, none_e = (F.from_json(F.lit("[]"), t.split(" ", 1)[1]) for t in (EXTRACTION_DDL.split(", relationships")[0], "relationships" + EXTRACTION_DDL.split(", relationships")[1]))
    rows = got.select("article_id", "chunk_idx", F.coalesce(people, none_p).alias("people"), F.coalesce(edges, none_e).alias("relationships"), error.alias("error"))
    return filter_extraction(rows)


def extract_articles(chunks: DataFrame, articles: DataFrame, client: Client) -> DataFrame:
    """Per article: failed chunks are passed over, merged and filtered once; all failed, or a blank body, is an error."""
    got = extract_raw(chunks, client).withColumn("x", parse_extraction("raw"))
    got = got.withColumn("error", F.coalesce("error", F.when(F.col("x").isNull(), _why("raw"))))
    ordered = F.sort_array(F.collect_list(F.struct("chunk_idx", "x")))
    each = got.groupBy("article_id").agg(ordered.alias("o"), F.count("error").alias("failed"), F.count("*").alias("n"), F.min_by("error", "chunk_idx").alias("why"))
    people, edges = merge_lists(F.flatten(F.transform("o", lambda c: c["x"]["people"])), F.flatten(F.transform("o", lambda c: c["x"]["relationships"])))
    each = each.withColumn("o", F.filter("o", lambda c: c["x"].isNotNull()))
    each = filter_extraction(each.select("article_id", people.alias("people"), edges.alias("relationships"), F.when(F.col("failed") == F.col("n"), F.concat(F.lit("all chunks failed: "), F.coalesce("why", F.lit("")))).alias("error")))
    out = articles.select("article_id", (F.coalesce(strip("body_text"), F.lit("")) == "").alias("blank")).join(each, "article_id", "left")
    return out.withColumn("error", F.when(F.col("blank"), F.lit("empty article body")).otherwise(F.col("error"))).drop("blank")
