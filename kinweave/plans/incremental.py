"""The work plan of a batch of articles against what is stored, and what its chunks add to the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.text import body_hash, chunk_size, chunks, sentences
from kinweave.operators import upserts
from kinweave.operators.ordered import frontier
from kinweave.operators.resolve_state import Chooser, mentions_of, merge_across, resolve_articles
from kinweave.plans.store import Change
from kinweave.schemas import stable_id


def plan_work(incoming: DataFrame, stored: DataFrame, *, default_size: int = 5) -> DataFrame:
    """One row for each url of ``incoming`` (url, title, author, published_at, body_text, source, size).

    outcome: new; done (complete, or a legacy row without a chunk count); reset (the body has changed);
    resume; start (known without progress). The stored chunk size wins over the asked one unless the
    article is new or reset. chunks holds the text from the start on; start_idx is the first to run.
    """
    first = upserts.first_by(incoming, ["url"], ["body_text", "title"])
    asked = first.withColumns({"asked": chunk_size("size", default_size), "new_hash": body_hash("body_text"), "parts": sentences("body_text"), "article_id": stable_id("url")})
    old = stored.select("url", *(F.col(c).alias(f"s_{c}") for c in ("body_hash", "sentences_per_chunk", "total_chunks", "chunks_processed", "title")), F.lit(True).alias("known"))
    both = asked.join(old, "url", "left")
    outcome = (
        F.when(F.col("known").isNull(), "new")
        .when(F.col("s_total_chunks").isNull(), "done")
        .when(~F.col("s_body_hash").eqNullSafe(F.col("new_hash")), "reset")
        .when(F.col("s_chunks_processed") >= F.col("s_total_chunks"), "done")
        .when(F.col("s_chunks_processed") > 0, "resume")
        .otherwise("start")
    )
    both = both.withColumn("outcome", outcome).withColumn("fresh", F.col("outcome").isin("new", "reset"))
    size = F.when(F.col("fresh"), F.col("asked")).otherwise(F.coalesce("s_sentences_per_chunk", "asked"))
    both = both.withColumn("sentences_per_chunk", size).withColumn("chunks", chunks(F.col("parts"), F.col("sentences_per_chunk")))
    both = both.withColumn("drift", ~F.col("fresh") & (F.col("outcome") != "done") & (F.size("chunks") != F.col("s_total_chunks")))
    return both.select("article_id", "url", "title", "author", "published_at", "source", F.col("new_hash").alias("body_hash"), "sentences_per_chunk", "chunks", F.size("chunks").alias("total_chunks"), F.when(F.col("outcome") == "resume", F.col("s_chunks_processed")).otherwise(F.lit(0)).alias("start_idx"), "outcome", "drift")


def pending_chunks(plan: DataFrame, extracted: DataFrame | None = None) -> DataFrame:
    """Chunks to extract: from start_idx on, without those that an earlier run has extracted already."""
    rows = plan.where((F.col("outcome") != "done") & ~F.col("drift")).select("article_id", "url", "title", "author", "body_hash", "sentences_per_chunk", "total_chunks", "start_idx", F.posexplode("chunks").alias("chunk_idx", "chunk"))
    rows = rows.where(F.col("chunk_idx") >= F.col("start_idx"))
    if extracted is not None:
        done = extracted.where("error is null").select("article_id", "body_hash", F.col("chunk_size").alias("sentences_per_chunk"), "chunk_idx")
        rows = rows.join(done, ["article_id", "body_hash", "sentences_per_chunk", "chunk_idx"], "left_anti")
    return rows


def apply_extractions(tables: dict[str, DataFrame], plan: DataFrame, extractions: DataFrame, *, keep=lambda df, name: df, strict: bool = False, use_recency: bool = True, use_chooser: bool = True, chooser: Chooser | None = None, persist_recency_aliases: bool = True) -> tuple[dict[str, Change], DataFrame]:
    """Each table's change, and a summary for each url, from the chunks of ``extractions`` (article_id, chunk_idx, people, relationships, error).

    Only chunks before an article's first error count. ``keep`` may write a DataFrame that several plans
    read. Names resolve article by article against the aliases as they were, and the people that articles
    of the batch made against each other, the earlier by article_id first.
    """
    resets = plan.where("outcome = 'reset' and not drift").select("article_id", "body_hash", "sentences_per_chunk", "total_chunks")
    reset_rows, gone_edges, gone_provenance = upserts.reset_changes(tables["articles"], tables["relationships"], tables["provenance"], resets)
    gone_edges = keep(tables["relationships"].join(gone_edges, "rel_id", "left_semi").select(*tables["relationships"].columns), "gone_edges")
    gone_provenance = keep(gone_provenance, "gone_provenance")
    fresh = plan.where("outcome = 'new' and not drift").withColumn("seq", F.lit(0))
    made = upserts.new_articles(tables["articles"], fresh.select("url", "title", "author", "published_at", "source", "body_hash", "sentences_per_chunk", "total_chunks", "seq"))
    going_on = tables["articles"].join(plan.where("outcome in ('resume', 'start')").select("article_id"), "article_id", "left_semi").select(*tables["articles"].columns)

    good = keep(frontier(extractions.withColumn("failed", F.col("error").isNotNull())).drop("failed"), "good")
    snapshot = tables["aliases"].join(tables["people"].select("person_id", "canonical_name"), "person_id").select("surface_form", "person_id", "canonical_name")
    resolved = keep(resolve_articles(mentions_of(good), snapshot, strict=strict, use_recency=use_recency, use_chooser=use_chooser, chooser=chooser), "resolved")
    if not strict:
        resolved = keep(merge_across(resolved, snapshot, keep=keep), "merged")
    people = upserts.new_people(tables["people"], resolved.where("new_person").select("canonical_name"))
    claimed = resolved.where("new_alias is not null")
    if not persist_recency_aliases:
        claimed = claimed.where((F.col("stage") != "subname") | F.contains("new_alias", F.lit(" ")))
    order = ["article_id", "chunk_idx", "kind", "pos"]
    aliases = upserts.new_aliases(tables["aliases"], claimed.select(F.col("new_alias").alias("surface_form"), "person_id", *order), order)

    told = good.select("article_id", "chunk_idx", F.posexplode("relationships").alias("pos", "e"))
    end = lambda name, k: resolved.where("kind = '2end'").where(F.col("pos") % 2 == k).select("article_id", "chunk_idx", F.floor(F.col("pos") / 2).cast("int").alias("pos"), F.col("person_id").alias(name))
    rows = told.join(end("source_person_id", 0), ["article_id", "chunk_idx", "pos"]).join(end("target_person_id", 1), ["article_id", "chunk_idx", "pos"])
    rows = rows.select("source_person_id", "target_person_id", F.col("e.relation_type").alias("relation_type"), F.col("e.explanation").alias("explanation"), F.col("e.supporting_quote").alias("quote"), "article_id", "chunk_idx", "pos")
    rows = keep(rows.withColumn("rel_id", stable_id("source_person_id", "target_person_id", "relation_type")), "edges")
    place = ["article_id", "chunk_idx", "pos"]
    left_edges = tables["relationships"].join(gone_edges.select("rel_id"), "rel_id", "left_anti").select(*tables["relationships"].columns)
    left_provenance = tables["provenance"].join(gone_provenance.select("prov_id"), "prov_id", "left_anti").select(*tables["provenance"].columns)
    edges = upserts.new_relationships(left_edges, rows.select("source_person_id", "target_person_id", "relation_type", "explanation", *place), place)
    provenance = upserts.new_provenance(left_provenance, rows.select("rel_id", "article_id", "quote", "chunk_idx", "pos"), ["chunk_idx", "pos"])
    progress = good.groupBy("article_id").agg((F.max("chunk_idx") + 1).alias("chunks_processed"))
    made, patched = upserts.advance(made, progress), upserts.advance(going_on.unionByName(reset_rows), progress)

    persons = resolved.where("kind = '1person'").groupBy("article_id").agg(F.countDistinct("person_id").alias("people_resolved"))
    stored = rows.groupBy("article_id").agg(F.count("*").alias("relationships_stored"))
    wrong = extractions.where("error is not null").groupBy("article_id").agg(F.min(F.struct("chunk_idx", "error")).alias("w"))
    zero = F.lit(0).cast("long")
    out = plan.join(persons, "article_id", "left").join(stored, "article_id", "left").join(wrong, "article_id", "left").join(good.groupBy("article_id").agg((F.max("chunk_idx") + 1).alias("upto")), "article_id", "left")
    summary = out.select(
        F.col("url").alias("article_url"),
        "article_id",
        "title",
        F.coalesce("people_resolved", zero).alias("people_resolved"),
        F.coalesce("relationships_stored", zero).alias("relationships_stored"),
        F.when(F.col("w").isNotNull(), F.concat(F.lit("chunk "), (F.col("w.chunk_idx") + 1).cast("string"), F.lit(": "), F.col("w.error"))).alias("extraction_error"),
        F.when(F.col("outcome") == "done", "already_exists").otherwise("processed").alias("status"),
        F.coalesce("upto", "start_idx").alias("chunks_processed"),
        "total_chunks",
        F.when(F.col("drift"), F.lit("chunk count has changed")).alias("error"),
    )
    changes = {
        "people": Change(added=people),
        "aliases": Change(added=aliases),
        "articles": Change(added=made, replaced=patched),
        "relationships": Change(added=edges, removed=gone_edges),
        "provenance": Change(added=provenance, removed=gone_provenance),
    }
    return changes, summary
