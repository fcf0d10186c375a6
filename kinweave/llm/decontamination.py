"""Benchmark passages in documents, found by spaced seeds and verified with substitutions allowed.

A mask looks at some words of a span and ignores the others, so a passage with substituted words still
has spans whose looked-at words are whole. The hashes of all spans of the benchmark items are joined with
those of the documents in the scan of the documents: the items' hashes are an index that is sent to the
tasks, in slices of at most ``SLICE_CHARS`` of benchmark text (one scan for each slice), so no broadcast
grows with the benchmark. Around a hit, the item and the document are compared word by word: a document
is contaminated where ``WINDOW`` aligned words (or a shorter item whole) have at least ``LEAST_SHARE`` of
their words in common, which holds for 12 equal words in a row as well as for one substitution in four. The masks are chosen by
enumeration: whichever words are substituted in a window that passes, of 8 to 16 words, one mask fits.

Words are runs of letters and digits, without regard to case. Items of fewer than ``LEAST_WORDS`` words,
null items and null texts match nothing; very long texts are searched whole. All columns of the documents
stay, whatever their names, but one named hits, which is replaced; repeated rows are judged one by one. An
empty table of documents gives an empty table, an empty benchmark no hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.shingles import _PLACES, mix, texts_words
from kinweave.llm.storage import Scratch
from kinweave.llm.tokens import release, slices

MASKS = ("111011", "11001011", "11111", "101111", "11110001", "10100111", "11010101")
WINDOW, LEAST_SHARE, LEAST_WORDS, SLICE_CHARS = 16, 0.75, 8, 1 << 24
HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("words", T.LongType()), T.StructField("equal", T.LongType())]))
_HITS_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("words", pa.int64()), ("equal", pa.int64())]))


def _seeds(words: np.ndarray, mask: tuple[int, ...], span: int) -> np.ndarray:
    n = max(len(words) - span + 1, 0)
    out = np.full(n, np.uint64(span), dtype=np.uint64)
    for k in mask:
        out += words[k : k + n] * _PLACES[k]
    return mix(out)


class SeedIndex:
    """The spans of all items under all masks, by hash."""

    def __init__(self, items: list[tuple[int | None, str | None]], masks: tuple[str, ...] = MASKS) -> None:
        words, at = texts_words([x for _, x in items], letters=True)
        self.ids = [x for x, _ in items]
        self.words = [words[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.masks = [(tuple(i for i, x in enumerate(m) if x == "1"), len(m)) for m in masks]
        shortest = min(len(m) for m in masks)
        self.masks += [(tuple(range(n)), n) for n in range(LEAST_WORDS, shortest)]  # short items, whole
        hashes, owners, places = [], [], []
        for which, own in enumerate(self.words):
            if len(own) < LEAST_WORDS:
                continue
            for mask, span in self.masks:
                if span >= shortest or span == len(own):
                    got = _seeds(own, mask, span)
                    hashes.append(got)
                    owners.append(np.full(len(got), which))
                    places.append(np.arange(len(got)))
        flat = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hashes = flat[order]
        self.owners = np.concatenate(owners)[order] if hashes else np.zeros(0, dtype=np.int64)
        self.places = np.concatenate(places)[order] if hashes else np.zeros(0, dtype=np.int64)
        self.shift = np.uint64(64 - max(10, min(26, 4 + len(flat).bit_length())))
        self.there = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.there[self.hashes >> self.shift] = True

    def diagonals(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Distinct (item, first word of the item's in the stream, text of the hit) of all hits."""
        items, firsts, texts = [], [], []
        for mask, span in self.masks:
            got = _seeds(words, mask, span)
            place = np.flatnonzero(self.there[got >> self.shift])
            low, high = (np.searchsorted(self.hashes, got[place], side) for side in ("left", "right"))
            many = high - low
            entry = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(many) else np.zeros(0, dtype=np.int64)
            items.append(self.owners[entry])
            firsts.append(np.repeat(place, many) - self.places[entry])
            texts.append(np.searchsorted(ends, np.repeat(place, many), "right") - 1)
        return np.unique(np.stack([np.concatenate(items), np.concatenate(firsts), np.concatenate(texts)]), axis=1)

    def verify(self, item: int, words: np.ndarray, first: int) -> tuple[int, int, int] | None:
        """(first word, words, equal words) of what an alignment shares, from the first good window to the last."""
        own = self.words[item]
        a, b = max(0, -first), min(len(own), len(words) - first)
        window = min(WINDOW, len(own))
        if b - a < window:
            return None
        equal = own[a:b] == words[first + a : first + b]
        sums = np.concatenate([[0], np.cumsum(equal)])
        good = np.flatnonzero(sums[window:] - sums[:-window] >= np.ceil(LEAST_SHARE * window))
        if not len(good):
            return None
        inside = np.flatnonzero(equal[good[0] : good[-1] + window]) + good[0]
        return first + a + int(inside[0]), int(inside[-1] - inside[0] + 1), len(inside)

    def hits(self, texts: list[str | None]) -> list[list[dict]]:
        words, at = texts_words(texts, letters=True)
        out: list[list[dict]] = [[] for _ in texts]
        ends = at.tolist()
        for item, first, doc in self.diagonals(words, at).T.tolist():
            # a seed lies in one text, or is of no worth
            found = self.verify(item, words[ends[doc] : ends[doc + 1]], first - ends[doc])
            if found:
                out[doc].append({"item_id": self.ids[item], "start": found[0], "words": found[1], "equal": found[2]})
        return out


def find_passages(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, masks: tuple[str, ...] = MASKS, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` with ``hits``: the benchmark items found and where, by word."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-chars // SLICE_CHARS))
    scratch = scratch or Scratch(spark, "passages")
    kept = [x for x in docs.columns if x != "hits"]
    schema = T.StructType([*(docs.schema[x] for x in kept), T.StructField("hits", HITS)])
    out = docs.select(*kept).withColumn("hits", F.lit(None).cast(HITS))
    for k in range(count):
        some = [(x["item_id"], x["text"]) for x in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect()]  # at most about SLICE_CHARS
        sent = spark.sparkContext.broadcast(SeedIndex(sorted(some, key=lambda x: (x[0] is not None, x[0] or 0, x[1])), masks))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                found = []
                for _, texts in slices(batch.column("text"), 4096, 1 << 21):
                    found += index.hits(texts)
                held = batch.column("hits").to_pylist()
                merged = pa.array([(x or []) + y for x, y in zip(held, found, strict=True)], _HITS_ARROW)
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), merged], names=[*kept, "hits"])
            release()

        out = out.mapInArrow(search, schema)
        if k < count - 1:
            out = scratch.keep(out, f"slice{k}")
    return out
