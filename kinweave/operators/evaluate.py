"""Precision, recall and F1 over sets and edges, differences, and the resolver's accuracy."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.names import normalize, py_normalize


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")


def with_scores(df: DataFrame) -> DataFrame:
    """tp, fp, fn with precision, recall and f1; 0 where a denominator is 0."""
    tp, fp, fn = (F.col(x).cast("double") for x in ("tp", "fp", "fn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return df.withColumns({"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)})


def score_sets(predicted: Column, gold: Column) -> list[Column]:
    """tp, fp, fn of two arrays taken as sets."""
    p, g = F.array_distinct(predicted), F.array_distinct(gold)
    return [F.size(F.array_intersect(p, g)).cast("long").alias("tp"), F.size(F.array_except(p, g)).cast("long").alias("fp"), F.size(F.array_except(g, p)).cast("long").alias("fn")]


def normal_set(names: Column) -> Column:
    """Distinct normalised names without empties."""
    return F.array_distinct(F.filter(F.transform(names, normalize), lambda x: x != ""))


def total(df: DataFrame, by: list[str]) -> DataFrame:
    """Micro-averages: counts summed by group and over all (group null), then scored."""
    return with_scores(df.rollup(*by).agg(*(F.sum(x).alias(x) for x in ("tp", "fp", "fn"))))


def _strict(said: str, words: list[str]) -> bool:
    return any(said.lower().strip() == w.lower().strip() for w in words)


def _fuzzy(said: str, words: list[str]) -> bool:
    return any(w.lower().strip() in said.lower().strip() for w in words)


def match_edges(predicted: list[tuple[str, str, str]], gold: list[tuple[str, str, list[str]]], test) -> Iterator[tuple[int, int | None]]:
    """Predicted places with the gold place each takes: the first that fits and is free."""
    free = dict(enumerate((py_normalize(s), py_normalize(t), words) for s, t, words in gold))
    for k, (s, t, said) in enumerate(predicted):
        ends = py_normalize(s), py_normalize(t)
        hit = next((i for i, g in free.items() if g[:2] == ends and test(said, g[2])), None)
        if hit is not None:
            del free[hit]
        yield k, hit


def _edge_lists(rows: pd.DataFrame) -> tuple[list, list]:
    rows = rows.sort_values("pos", kind="stable")
    pick = lambda side: list(rows[rows.side == side][["source", "target", "said"]].itertuples(index=False, name=None))
    return pick("predicted"), [(s, t, (w or "").split("\x1f")) for s, t, w in pick("gold")]


def score_edges(edges: DataFrame, *, fuzzy: bool) -> DataFrame:
    """Per article of edges (article_id, side predicted|gold, pos, source, target, said): tp, fp, fn.

    said is the relation type, or the gold edge's keywords joined by U+001F. Predicted edges with an end
    that normalises to nothing don't count; gold edges all do.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        predicted, gold = _edge_lists(rows)
        predicted = [e for e in predicted if py_normalize(e[0]) and py_normalize(e[1])]
        tp = sum(hit is not None for _, hit in match_edges(predicted, gold, _fuzzy if fuzzy else _strict))
        return pd.DataFrame([{"article_id": rows.article_id.iloc[0], "tp": tp, "fp": len(predicted) - tp, "fn": len(gold) - tp}])

    return with_scores(edges.groupBy("article_id").applyInPandas(run, "article_id string, tp long, fp long, fn long"))


def edge_diff(edges: DataFrame) -> DataFrame:
    """article_id, label (matched, missed, extra), source, target, keywords, said, in order of each label.

    Keywords are taken as they stand and empty ends aren't left out, unlike in the scores.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        predicted, gold = _edge_lists(rows)
        plain = lambda said, words: any(w.lower() in said.lower() for w in words)
        out, taken = [], set()
        for k, hit in match_edges(predicted, gold, plain):
            s, t, said = predicted[k]
            if hit is None:
                out.append(("extra", s, t, None, said))
            else:
                taken.add(hit)
                out.append(("matched", gold[hit][0], gold[hit][1], "|".join(gold[hit][2]), said))
        out += [("missed", s, t, "|".join(w), None) for i, (s, t, w) in enumerate(gold) if i not in taken]
        frame = pd.DataFrame(out, columns=["label", "source", "target", "keywords", "said"])
        frame.insert(0, "article_id", rows.article_id.iloc[0])
        frame.insert(2, "pos", frame.groupby("label").cumcount())
        return frame

    return edges.groupBy("article_id").applyInPandas(run, "article_id string, label string, pos int, source string, target string, keywords string, said string")


def accuracy(pairs: DataFrame) -> DataFrame:
    """Of pairs (expected, expected_stage, got, got_stage): shares of right names and stages; nulls compare as values."""
    share = lambda a, b: F.avg(F.col(a).eqNullSafe(F.col(b)).cast("double"))
    return pairs.agg(F.count("*").alias("n"), F.count_if(F.col("expected").eqNullSafe(F.col("got"))).alias("names_right"), F.count_if(F.col("expected_stage").eqNullSafe(F.col("got_stage"))).alias("stages_right"), share("expected", "got").alias("name_accuracy"), share("expected_stage", "got_stage").alias("stage_accuracy"))
