"""Resolution that keeps state in mention order: an article at a time, or all articles as one sequence.

Set-wise resolution can't see aliases and people that earlier mentions of the same article made. Here a
function replays each article's mentions in order. Articles share nothing but the alias snapshot, so they
run in parallel; the people that they make are then resolved against each other by sets, the earliest
article first (``merge_across``). A row is one article, which its own text bounds; the strict mode, one
group of all mentions, is for audits and fixtures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.functions.names import ACCEPT, CANDIDATE, long_tokens, normalize, py_long_tokens, py_normalize, py_similarity
from kinweave.operators.fuzzy import sharing_pairs, similar_pairs, subname_pairs
from kinweave.plans.shared import kept

Chooser = Callable[[str, list[str]], str | None]
RESOLVED = "article_id string, chunk_idx int, kind string, pos int, surface string, person_id string, canonical_name string, stage string, new_person boolean, new_alias string"

ARROW = pa.schema([(x.split()[0], {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[x.split()[1]]) for x in RESOLVED.split(", ")])
TOGETHER = 64  # articles as Python objects at a time


def person_key(canonical_name: str) -> str:
    """As schemas.stable_id of the canonical name."""
    return hashlib.sha256(canonical_name.encode()).hexdigest()


@dataclass
class Memory:
    """Aliases, token owners and recency, as mentions change them."""

    aliases: dict[str, tuple[str, str]] = field(default_factory=dict)
    owners: dict[str, set[str]] = field(default_factory=dict)
    recency: dict[str, str] = field(default_factory=dict)
    use_recency: bool = True
    use_chooser: bool = True
    chooser: Chooser | None = None

    def seed_owners(self) -> None:
        for form, (person, _) in self.aliases.items():
            for token in py_long_tokens(form):
                self.owners.setdefault(token, set()).add(person)

    def note(self, person: str, canonical_name: str) -> None:
        """Marks the person as owner of the name's long tokens, and as latest where there are others."""
        for token in py_long_tokens(py_normalize(canonical_name)):
            held = self.owners.setdefault(token, set())
            held.add(person)
            if len(held) > 1:
                self.recency[token] = person

    def find(self, raw: str) -> tuple[str, str, str] | None:
        """(person_id, canonical_name, stage), or nothing; remembers what a stage after the first decides."""
        norm = py_normalize(raw)
        if not norm:
            return None
        if norm in self.aliases:
            return (*self.aliases[norm], "alias")
        best, short, asked, mine = (0.0, None), {}, {}, py_long_tokens(norm)
        least = CANDIDATE if self.use_chooser and self.chooser is not None else ACCEPT
        for form in sorted(self.aliases):
            owner, score = self.aliases[form], 0.0
            if abs(len(norm) - len(form)) <= (1 - least) * max(len(norm), len(form)) + 1e-9:  # else lengths alone put it below
                score = py_similarity(norm, form)
            if score >= ACCEPT:
                best = (score, owner) if score > best[0] else best
                continue
            if mine and mine <= set(form.split()):
                short[owner[0]] = owner
            if score >= CANDIDATE or mine & py_long_tokens(form):
                asked.setdefault(owner[1], owner)
        if best[1]:
            return self._keep(norm, best[1], "levenshtein")
        if len(short) == 1:
            return self._keep(norm, next(iter(short.values())), "subname")
        if short:
            latest = {self.recency[t] for t in mine if t in self.recency} & short.keys() if self.use_recency else set()
            return self._keep(norm, short[latest.pop()], "subname") if len(latest) == 1 else None
        if not asked or not self.use_chooser or self.chooser is None:
            return None
        try:
            answer = self.chooser(raw, list(asked))
        except Exception:  # a chooser's failure is no answer
            return None
        return self._keep(norm, asked[answer], "llm") if answer in asked else None

    def _keep(self, norm: str, owner: tuple[str, str], stage: str) -> tuple[str, str, str]:
        self.aliases.setdefault(norm, owner)
        return (*owner, stage)

    def find_or_make(self, raw: str) -> tuple[str, str, str, bool, str | None]:
        """find, else a new person of that name; then bookkeeping. The last items: is it new, and the alias that was added."""
        norm = py_normalize(raw)
        known, got = norm in self.aliases, self.find(raw)
        made = got is None
        if made:
            got = (person_key(raw), raw, "none")
            if norm:
                self.aliases.setdefault(norm, got[:2])
        self.note(got[0], got[1])
        return (*got, made, norm if norm and not known else None)


def resolve_in_order(rows: Iterable[tuple], memory: Memory) -> Iterator[tuple]:
    """Mentions (article_id, chunk_idx, kind, pos, surface): people first, then ends of relationships that the chunk hasn't seen."""
    seen: dict[str, tuple] = {}
    chunk = None
    for row in sorted(rows, key=lambda r: r[1:4]):
        if row[1] != chunk:
            seen, chunk = {}, row[1]
        got = seen.get(row[4]) if row[2] != "1person" else None
        if got is None:
            got = memory.find_or_make(row[4])
            seen[row[4]] = (*got[:3], False, None)
        yield (*row, *got)


def mentions_of(extractions: DataFrame) -> DataFrame:
    """Mentions of chunk extractions (article_id, chunk_idx, people, relationships) in the order they resolve in."""
    people = extractions.select("article_id", "chunk_idx", F.posexplode("people").alias("pos", "p")).select("article_id", "chunk_idx", F.lit("1person").alias("kind"), "pos", F.col("p.name").alias("surface"))
    ends = extractions.select("article_id", "chunk_idx", F.posexplode("relationships").alias("pos", "e"))
    ends = ends.select("article_id", "chunk_idx", F.lit("2end").alias("kind"), F.explode(F.array(F.struct((F.col("pos") * 2).alias("pos"), F.col("e.source_person").alias("surface")), F.struct((F.col("pos") * 2 + 1).alias("pos"), F.col("e.target_person").alias("surface")))).alias("x"))
    return people.unionByName(ends.select("article_id", "chunk_idx", "kind", "x.pos", "x.surface"))


def resolve_articles(mentions: DataFrame, aliases: DataFrame, *, most_aliases: int = 200_000, strict: bool = False, use_recency: bool = True, use_chooser: bool = True, chooser: Chooser | None = None) -> DataFrame:
    """Mentions with their people. Each article starts from the aliases it can need.

    An article of the parallel mode gets the aliases that set-wise search finds for its names and two owners
    of each token that a found person has, never the whole table. The strict mode sends the table, if it is small.
    """
    mentions = mentions.select("article_id", "chunk_idx", "kind", "pos", "surface")
    fresh = lambda given: Memory({f: (p, c) for f, p, c in given}, use_recency=use_recency, use_chooser=use_chooser, chooser=chooser)
    columns = [x.split()[0] for x in RESOLVED.split(", ")]

    def run(rows: Iterable[tuple], given: Iterable[tuple]) -> Iterator[tuple]:
        memory = fresh(given)
        if use_recency:
            memory.seed_owners()
        return resolve_in_order(rows, memory)

    if strict:
        held = [tuple(r) for r in aliases.select("surface_form", "person_id", "canonical_name").limit(most_aliases + 1).collect()]
        if len(held) > most_aliases:
            raise ValueError(f"strict order needs an alias table of at most {most_aliases} rows")
        order = mentions.select("article_id").distinct().withColumn("n", F.dense_rank().over(W.orderBy("article_id")))
        ranked = mentions.join(order, "article_id").withColumn("chunk_idx", (F.col("n") * 1_000_000 + F.col("chunk_idx")).cast("int"))
        whole = lambda rows: pd.DataFrame(list(run(rows[columns[:5]].itertuples(index=False, name=None), held)), columns=columns)
        out = ranked.withColumn("g", F.lit(0).cast("long")).groupBy("g").applyInPandas(whole, RESOLVED)
        return out.withColumn("chunk_idx", F.col("chunk_idx") % 1_000_000)
    seeds = relevant_aliases(mentions, aliases, chooser=use_chooser and chooser is not None)
    said = mentions.groupBy("article_id").agg(F.collect_list(F.struct("chunk_idx", "kind", "pos", "surface")).alias("said"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                made = []
                for row in batch.slice(at, TOGETHER).to_pylist():
                    rows = ((row["article_id"], m["chunk_idx"], m["kind"], m["pos"], m["surface"]) for m in row["said"])
                    made += run(rows, ((x["f"], x["p"], x["c"]) for x in row["seeds"] or ()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), ARROW.types, strict=True)], schema=ARROW)

    return said.join(seeds, "article_id", "left").select("article_id", "said", "seeds").mapInArrow(each, RESOLVED)


def relevant_aliases(mentions: DataFrame, aliases: DataFrame, *, chooser: bool = False) -> DataFrame:
    """article_id, seeds: the aliases on which any decision about the article's names depends.

    Those are similar aliases; of the people that a name may be short for, two tell that it is ambiguous, and
    recency may pick those that the article names otherwise; of a token's owners, two tell that it is
    contested. With a chooser, also all candidates that it may be shown.
    """
    names = mentions.select("article_id", normalize("surface").alias("norm")).where("norm <> ''").distinct()
    pairs = similar_pairs(names, aliases, CANDIDATE if chooser else ACCEPT).select("norm", "surface_form")
    if chooser:
        pairs = pairs.unionByName(sharing_pairs(names, aliases))
    short = subname_pairs(names, aliases).join(aliases.select("surface_form", "person_id"), "surface_form")
    two = short.groupBy("norm").agg(F.min(F.struct("person_id", "surface_form")).alias("a"), F.max(F.struct("person_id", "surface_form")).alias("b"))
    two = two.select("norm", F.explode(F.array("a.surface_form", "b.surface_form")).alias("surface_form"))
    found = names.join(pairs.unionByName(two).distinct(), "norm").select("article_id", "surface_form").distinct().join(aliases, "surface_form")
    people = found.select("article_id", "person_id").distinct()
    named = names.join(short, "norm").join(people, ["article_id", "person_id"]).select("article_id", "surface_form").distinct().join(aliases, "surface_form")
    token = found.select("article_id", F.explode(long_tokens(normalize("canonical_name"))).alias("token")).distinct()
    owners = aliases.select("surface_form", "person_id", F.explode(long_tokens(F.col("surface_form"))).alias("token"))
    owners = owners.groupBy("token").agg(F.min(F.struct("person_id", "surface_form")).alias("a"), F.max(F.struct("person_id", "surface_form")).alias("b"))
    owners = token.join(owners, "token").select("article_id", F.explode(F.array("a.surface_form", "b.surface_form")).alias("surface_form")).distinct().join(aliases, "surface_form")
    wanted = found.unionByName(named).unionByName(owners).distinct()
    return wanted.groupBy("article_id").agg(F.sort_array(F.collect_set(F.struct(F.col("surface_form").alias("f"), F.col("person_id").alias("p"), F.col("canonical_name").alias("c")))).alias("seeds"))


def _roots(links: DataFrame, keep) -> DataFrame:
    """person_id, root: where each link (person_id, root) ends. Links lead to earlier people, so they end."""
    n = -1
    while True:
        links = keep(links, "links")
        next_ = links.select(F.col("person_id").alias("root"), F.col("root").alias("onward"))
        jumped = links.join(next_, "root", "left").select("person_id", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved"))
        jumped = keep(jumped, "jumped")
        n = jumped.where("moved").count()
        links = jumped.select("person_id", "root")
        if not n:
            return links


def merge_across(resolved: DataFrame, aliases: DataFrame, *, keep=lambda df, name: kept(df)) -> DataFrame:
    """``resolved`` with the people that articles made apart brought together, as if the articles had come in order.

    A new person is the one to whom an earlier article's mention gave an equal form; else the one with the
    most similar earlier form, at least ``ACCEPT`` (ties: the smallest form); else, if the name is short for
    earlier forms of one person alone and for none of ``aliases``, that person. Forms of different articles
    belong to the first that claims them. An article's own decisions stay. ``resolved`` is read several times.
    """
    place = F.struct("article_id", "chunk_idx", "kind", "pos")
    made = resolved.where("new_person").groupBy("person_id").agg(F.min(F.struct(place.alias("at"), "canonical_name")).alias("m"))
    made = keep(made.select("person_id", F.col("m.at").alias("at"), F.col("m.canonical_name").alias("canonical_name"), normalize("m.canonical_name").alias("norm")), "made")
    if made.limit(2).count() < 2:
        return resolved
    forms = resolved.where("new_alias is not null").groupBy(F.col("new_alias").alias("form")).agg(F.min(F.struct(place.alias("at"), F.col("person_id").alias("owner"))).alias("m"))
    forms = keep(forms.select("form", F.col("m.at").alias("since"), F.col("m.owner").alias("owner")), "forms")
    named = made.where("norm <> ''")
    earlier = (F.col("since") < F.col("at")) & (F.col("owner") != F.col("person_id"))
    exact = named.join(forms, F.col("norm") == F.col("form")).where(earlier).select("person_id", F.col("owner").alias("root"))
    rest = named.join(exact, "person_id", "left_anti")
    close = rest.join(similar_pairs(rest, forms, ACCEPT, b="form"), "norm").join(forms, "form").where(earlier)
    close = close.groupBy("person_id").agg(F.min(F.struct((-F.col("similarity")).alias("minus"), "form", "owner")).alias("m")).select("person_id", F.col("m.owner").alias("root"))
    same = _roots(exact.unionByName(close), keep)
    rest = named.join(same, "person_id", "left_anti")
    owned = forms.join(same.withColumnRenamed("person_id", "owner"), "owner", "left").withColumn("owner", F.coalesce("root", "owner")).drop("root")
    short = rest.join(subname_pairs(rest, aliases).select("norm").distinct(), "norm", "left_anti")
    short = short.join(subname_pairs(short, owned, b="form"), "norm").join(owned, "form").where(earlier)
    short = short.groupBy("person_id").agg(F.min("owner").alias("root"), F.max("owner").alias("other")).where("root = other").select("person_id", "root")
    moved = keep(_roots(same.unionByName(short), keep), "moved").join(made.select(F.col("person_id").alias("root"), F.col("canonical_name").alias("root_name")), "root", "left")
    out = resolved.join(moved, "person_id", "left")
    changed = {"canonical_name": F.coalesce("root_name", "canonical_name"), "new_person": F.col("new_person") & F.col("root").isNull(), "person_id": F.coalesce("root", "person_id")}
    return out.select(*(changed.get(c, F.col(c)).alias(c) for c in resolved.columns))
