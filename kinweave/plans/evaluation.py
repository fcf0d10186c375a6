"""Scores of an extractor on gold articles and of the resolver on alias pairs, with reports."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.names import py_normalize
from kinweave.functions.text import chunks, sentences
from kinweave.operators import evaluate
from kinweave.operators.extract import Client, extract_articles, messages
from kinweave.operators.resolve_state import Chooser, Memory, person_key
from kinweave.sources.gold import gold_edges


@dataclass
class ExtractorScores:
    """people, strict and fuzzy: per article and, with a null article_id, in all; diff: edges by label."""

    people: DataFrame
    strict: DataFrame
    fuzzy: DataFrame
    diff: DataFrame


def evaluate_extractor(gold: DataFrame, client: Client, *, sentences_per_chunk: int = 10) -> ExtractorScores:
    """Extracts each gold article whole and compares people and edges."""
    articles = gold.select(F.col("id").alias("article_id"), "url", "title", "author", "body_text", chunks(sentences("body_text"), sentences_per_chunk).alias("chunks"))
    got = extract_articles(messages(articles), articles, client)
    both = gold.select(F.col("id").alias("article_id"), F.col("people").alias("gold")).join(got, "article_id")
    names = F.coalesce(F.transform("people", lambda p: p["name"]), F.array().cast("array<string>"))
    people = both.select("article_id", *evaluate.score_sets(evaluate.normal_set(names), evaluate.normal_set(F.col("gold"))))
    told = got.select("article_id", F.posexplode("relationships").alias("pos", "e")).select("article_id", F.lit("predicted").alias("side"), "pos", F.col("e.source_person").alias("source"), F.col("e.target_person").alias("target"), F.col("e.relation_type").alias("said"))
    edges = told.unionByName(gold_edges(gold))
    by = ["article_id"]
    return ExtractorScores(evaluate.total(people, by), evaluate.total(evaluate.score_edges(edges, fuzzy=False), by), evaluate.total(evaluate.score_edges(edges, fuzzy=True), by), evaluate.edge_diff(edges))


def evaluate_resolver(seeds: DataFrame, pairs: DataFrame, *, chooser: Chooser | None = None) -> DataFrame:
    """pairs (seq, surface, expected, expected_stage) with got and got_stage, resolved in order with aliases kept between them.

    ``seeds`` (canonical_name, surface) are the people that are known. Both are small gold tables: one
    group, because each pair depends on those before it.
    """
    known = [(r["canonical_name"], r["surface"]) for r in seeds.orderBy("canonical_name", "surface").collect()]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        memory = Memory({py_normalize(s): (person_key(c), c) for c, s in known}, chooser=chooser)
        rows = rows.sort_values("seq")
        found = [memory.find(s) for s in rows["surface"]]
        return rows.assign(got=[f and f[1] for f in found], got_stage=[f[2] if f else "none" for f in found])[["seq", "surface", "expected", "expected_stage", "got", "got_stage"]]

    return pairs.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(run, "seq int, surface string, expected string, expected_stage string, got string, got_stage string")


def report(scores: ExtractorScores, *, show_diff: bool = False) -> str:
    """Precision, recall and F1 by article and in all, as text."""
    lines = []
    for name in ("people", "strict", "fuzzy"):
        lines.append(f"{name:<28}   tp   fp   fn  precision  recall  f1")
        for r in getattr(scores, name).orderBy(F.col("article_id").asc_nulls_last()).collect():  # a row for each gold article
            lines.append(f"{r['article_id'] or 'TOTAL':<28} {r['tp']:>4} {r['fp']:>4} {r['fn']:>4}  {r['precision']:>9.3f} {r['recall']:>7.3f} {r['f1']:.3f}")
    if show_diff:
        for r in scores.diff.orderBy("article_id", "label", "pos").collect():
            lines.append(f"{r['article_id']} {r['label']}: {r['source']} -> {r['target']} [{r['keywords'] or ''}] {r['said'] or ''}")
    return "\n".join(lines)


def resolver_report(results: DataFrame) -> str:
    lines = [f"{'ok ' if r['expected'] == r['got'] and r['expected_stage'] == r['got_stage'] else 'NO '} {r['surface']!r}: {r['got']} by {r['got_stage']}, expected {r['expected']} by {r['expected_stage']}" for r in results.orderBy("seq").collect()]
    total = evaluate.accuracy(results).first()
    return "\n".join([*lines, f"names {total['names_right']}/{total['n']}, stages {total['stages_right']}/{total['n']}"])


