"""Similarity joins of short strings by edit distance, as equi-joins that lose no pair.

A pair of at least ``least`` similarity differs by at most (1 - least) of the longer length. If the right
string is cut into one segment more than that allows edits, one segment is found unchanged in the left
string, near its place. Segments therefore meet in an equi-join; a bounded edit distance and the exact
test follow. An exact place and length in the key cost rows with the cube of the length, so strings longer
than ``PLACED`` meet on the segment and the order of their length alone. Below ``SEGMENTED`` the segments become too short to tell strings apart, and strings meet
by length instead: the right side's length, dealt out over salts so that common lengths don't make one
large task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.names import long_tokens, py_similarity, tokens
from kinweave.functions.text import let

SEGMENTED, PLACED = 0.7, 32
_EPS = 1e-9


def _similar(a: str, b: str, least: float) -> Column:
    la, lb = F.length(a), F.length(b)
    longest = F.greatest(la, lb, F.lit(1)).cast("double")
    bound = F.floor(longest * (1 - least) + _EPS).cast("int")
    return let(F.call_function("levenshtein", F.col(a), F.col(b), bound), lambda near: F.when(near >= 0, F.lit(1.0) - near / longest))


def similar_pairs(left: DataFrame, right: DataFrame, least: float, *, a: str = "norm", b: str = "surface_form", salts: int = 16) -> DataFrame:
    """Distinct (a, b, similarity) of strings of both sides that are at least ``least`` similar."""
    ls, rs = left.select(a).where(F.length(a) > 0).distinct(), right.select(b).where(F.length(b) > 0).distinct()
    if least >= SEGMENTED:
        short, long = _by_segments(ls, rs, least, a, b)
        return short.withColumn("similarity", _similar(a, b, least)).where(F.col("similarity") >= least).unionByName(_tested(long, least, a, b))
    else:
        lengths = F.sequence(F.ceil(F.length(a) * least - _EPS).cast("int"), F.floor(F.length(a) / least + _EPS).cast("int"))
        asked = ls.select(a, F.explode(lengths).alias("size"), F.pmod(F.xxhash64(a), F.lit(salts)).alias("salt"))
        held = rs.select(b, F.length(b).alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
        pairs = asked.join(held, ["size", "salt"]).select(a, b)
    return pairs.withColumn("similarity", _similar(a, b, least)).where(F.col("similarity") >= least)


def _edits(size: Column, least: float) -> Column:
    """How many edits may part a string of that size from any partner."""
    return F.floor(F.floor(size / least + _EPS) * (1 - least) + _EPS).cast("int")


def _begin(i: Column) -> Column:
    return F.floor(i * F.col("size") / (F.col("k") + 1)).cast("int")


def _segments(rs: DataFrame, least: float, b: str) -> DataFrame:
    """b, size, i, segment: one segment more than edits."""
    held = rs.select(b, F.length(b).alias("size"), _edits(F.length(b), least).alias("k"))
    held = held.select(b, "size", "k", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    i = F.col("i")
    return held.select(b, "size", "i", F.substring(b, _begin(i) + 1, _begin(i + 1) - _begin(i)).alias("segment"))


def _by_segments(ls: DataFrame, rs: DataFrame, least: float, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """Pairs with b up to ``PLACED`` long, and those with longer ones."""
    held = _segments(rs.where(F.length(b) <= PLACED), least, b)
    low, high = F.ceil(F.length(a) * least - _EPS).cast("int"), F.least(F.floor(F.length(a) / least + _EPS).cast("int"), F.lit(PLACED))
    asked = ls.where(low <= high).select(a, F.explode(F.sequence(low, high)).alias("size"))
    asked = asked.withColumn("k", _edits(F.col("size"), least)).select(a, "size", "k", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    first, width = _begin(F.col("i")), _begin(F.col("i") + 1) - _begin(F.col("i"))
    low, high = F.greatest(F.lit(0), first - F.col("k")), F.least(F.length(a) - width, first + F.col("k"))
    asked = asked.select(a, "size", "i", width.alias("width"), F.explode(F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))).alias("at"))
    asked = asked.select(a, "size", "i", F.substring(a, F.col("at") + 1, F.col("width")).alias("segment")).distinct()
    placed = asked.join(held, ["size", "i", "segment"]).select(a, b)
    return placed.distinct(), _by_long_segments(ls, rs.where(F.length(b) > PLACED), min(least, 0.95), a, b)


def _by_long_segments(ls: DataFrame, rs: DataFrame, least: float, a: str, b: str) -> DataFrame:
    """Pairs of which a holds a segment of b, longer than ``PLACED``, at any place: rows follow the strings' length.

    Strings are hashed until they have met; equal hashes only add pairs to test.
    """
    step = math.log(1.001 / least)  # partners' lengths are one order apart at most
    order = lambda x: F.floor(F.log(F.length(x)) / step).cast("int")
    part = (1 - least) / least
    widths = range(math.floor(1 / (part + 1 / (PLACED + 1))), math.ceil(1 / (part - (1 - least) / (PLACED + 1))) + 1)  # of all segments of such strings
    grams = lambda x: [F.regexp_extract_all(x, F.lit(f"(?s)(?=(.{{{w}}}))"), F.lit(1)) for w in widths]  # noqa: E731  all, in the time of one scan
    ls, rs = ls.where(F.length(a) / least + _EPS > PLACED).withColumn("of_a", F.xxhash64(a)), rs.withColumn("of_b", F.xxhash64(b))
    cut = lambda g: F.transform(F.sequence(F.lit(0), F.col("k")), lambda i: F.get(F.get(g, _begin(i + 1) - _begin(i) - widths[0]), _begin(i)))
    held = rs.select("of_b", b, order(b).alias("order"), F.length(b).alias("size"), _edits(F.length(b), least).alias("k"))
    held = held.select("of_b", "order", F.explode_outer(F.array_distinct(let(F.array(*grams(F.col(b))), cut))).alias("segment"))
    asked = ls.select("of_a", order(a).alias("size"), F.explode_outer(F.array_distinct(F.concat(*grams(F.col(a))))).alias("segment"))
    asked = asked.select("of_a", "segment", F.explode(F.array(*(F.col("size") + F.lit(x) for x in (-1, 0, 1)))).alias("order"))
    met = asked.join(held, ["order", "segment"]).select("of_a", "of_b").distinct()
    pairs = met.join(ls.select("of_a", a), "of_a").join(rs.select("of_b", b), "of_b")
    return pairs.select("of_a", "of_b", a, b)


def _tested(pairs: DataFrame, least: float, a: str, b: str) -> DataFrame:
    """Pairs of long strings that are similar enough: few bytes and much work, so a fixed number of tasks shares them."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pylist()
                near = [(x[a], x[b], py_similarity(x[a], x[b])) for x in part if abs(len(x[a]) - len(x[b])) <= max(len(x[a]), len(x[b])) * (1 - least) + _EPS]
                found = [x for x in near if x[2] >= least]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=[a, b, "similarity"])

    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(tasks, "of_a", "of_b").select(a, b).mapInArrow(test, f"`{a}` string, `{b}` string, similarity double")


def subname_pairs(left: DataFrame, right: DataFrame, *, a: str = "norm", b: str = "surface_form") -> DataFrame:
    """(a, b) where all long tokens of a, one at least, are tokens of b: a count over an equi-join on tokens."""
    mine = left.select(a).distinct().withColumn("t", long_tokens(F.col(a)))
    asked = mine.select(a, F.size("t").alias("wanted"), F.explode("t").alias("token"))
    held = right.select(b).distinct().select(b, F.explode(F.array_distinct(tokens(F.col(b)))).alias("token"))
    return asked.join(held, "token").groupBy(a, b).agg(F.count("*").alias("met"), F.max("wanted").alias("wanted")).where("met = wanted").select(a, b)


def sharing_pairs(left: DataFrame, right: DataFrame, *, a: str = "norm", b: str = "surface_form") -> DataFrame:
    """Distinct (a, b) that share a long token."""
    asked = left.select(a).distinct().select(a, F.explode(long_tokens(F.col(a))).alias("token"))
    held = right.select(b).distinct().select(b, F.explode(long_tokens(F.col(b))).alias("token"))
    return asked.join(held, "token").select(a, b).distinct()
