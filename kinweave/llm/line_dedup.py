"""Removal of repeated passages by overlapping three-line windows.

A line is what line feeds part; a line is parted again after every sentence end, so that a passage inside
a paragraph has lines of its own. Every three consecutive lines of a document are a window, hashed to 96
bits, but for windows of blank lines. A passage may begin and end in mid-sentence, so runs of ``RUN`` words
are windows too: a run begins at the leftmost smallest key of every ``NEAR`` words in a row, which depends on
the words nearby alone, so every passage of ``2 * NEAR - 2 + RUN`` = 50 words holds a run, the same one
wherever it stands. Of a window that is found at several places anywhere, the first place, by doc_id and
position, stays; what later places cover, merged, is cut out of the text, and the rest stays as it is.

Null text stays null and has no lines; empty text has one blank line; a document of fewer than three lines
has no window of lines, and one of fewer than ``RUN`` words no run. Very long texts are treated like any
other. Rows of equal doc_id and text are one document: they get the same decision. Of different texts under one
doc_id any may count as the first; that choice is written before it is used. Rows without a doc_id are
told apart by 128 bits of their text's hash, 64 of which take the id's place in the order. An empty table gives an empty table. Extra columns stay as
they are, whatever their names; columns named n_lines and n_removed are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.shingles import mix, word_hashes
from kinweave.llm.storage import Scratch, private
from kinweave.llm.tokens import parts, release

NEAR, RUN = 19, 14
_CUT = re.compile(r"\n|(?<=[.!?]) +")
_BLANK = " \t\n\v\f\r"
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def lines_of(text: str) -> tuple[list[str], list[int]]:
    """The lines, and where each begins (and the text's end)."""
    lines, begins = [], [0]
    for m in _CUT.finditer(text):
        lines.append(text[begins[-1] : m.start()])
        begins.append(m.end())
    return [*lines, text[begins[-1] :]], [*begins, len(text)]


def place(first, end, run: int):
    """A place as one number, in order of its first character: 31 bits each for that and the size."""
    return first << 32 | (end - first) << 1 | run


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows of three lines: each line is hashed once, to 128 bits, and three are mixed."""
    lines, begins = lines_of(text)
    if len(lines) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros((0, 2), dtype=np.int64)
    each = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines]), dtype="<u8").reshape(-1, 2)
    some = np.array([bool(x.strip(_BLANK)) for x in lines])
    at = np.flatnonzero(some[:-2] | some[1:-1] | some[2:])
    mixed = mix(mix(mix(each[at]) + each[at + 1]) + each[at + 2])
    ends = np.array(begins)
    return place(ends[at], ends[at + 3], 0), mixed.view(np.int64)


def _beginnings(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The words that begin runs: of every ``NEAR`` words in a row of one text, the leftmost smallest."""
    n = len(keys)
    reach = np.ones(n, dtype=np.int64)
    for left in (True, False):
        alive = np.ones(n, dtype=bool)
        for k in range(1, NEAR):
            a, b = keys[:-k], keys[k:]
            near = np.zeros(n, dtype=bool)
            same = owner[:-k] == owner[k:]
            if left:
                near[k:] = same & (a > b)
            else:
                near[: max(n - k, 0)] = same & (b >= a)
            alive &= near
            reach += alive
    return np.flatnonzero(reach >= NEAR)


def word_keys(chars: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A small number for each word, of its length and its first, middle and last character."""
    low = chars + 32 * ((chars >= 65) & (chars <= 90)).astype(np.uint32)
    first, middle, last = (low[firsts + x].astype(np.int64) for x in (0, sizes // 2, sizes - 1))
    return (first * 7 + middle * 31 + last * 127 + sizes * 8191) % 1009


def runs_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every run of words: its text, its place in that, and 128 bits of hash."""
    coded = "\n".join(texts)
    chars = np.frombuffer(coded.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    apart = np.append((chars == 32) | ((chars >= 9) & (chars <= 13)), True)
    firsts = np.flatnonzero(~apart & np.concatenate([[True], apart[:-1]]))
    sizes = np.flatnonzero(apart & np.concatenate([[False], ~apart[:-1]])) - firsts
    hashes, _ = word_hashes(coded.encode("utf-8", "surrogatepass"))
    begins = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])
    owner = np.searchsorted(begins, firsts, "right") - 1
    at = _beginnings(word_keys(chars, firsts, sizes), owner)
    at = at[at + RUN <= len(hashes)]
    at = at[owner[at] == owner[at + RUN - 1]]
    text = owner[at]
    ends = np.minimum(np.append(firsts, begins[-1])[at + RUN], begins[text + 1] - 1)
    digest = []
    for base in _BASES:
        up = np.full(len(hashes) + 1, base, dtype=np.uint64)
        down = np.full(len(hashes) + 1, pow(base, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes * up[:-1], dtype=np.uint64)])
        digest.append(mix((sums[at + RUN] - sums[at]) * down[at]))
    return text, place(firsts[at] - begins[text], ends - begins[text], 1), np.stack(digest, axis=1).view(np.int64)


def repeats(owner: np.ndarray, places: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which windows their own text holds at an earlier place, too."""
    out = np.zeros(len(owner), dtype=bool)
    if not len(owner):
        return out
    key = hashes[:, 0] + owner * np.int64(0x1E3779B97F4A7C15)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    some = order[np.append(same, False) | np.insert(same, 0, False)]
    some = some[np.lexsort((places[some], hashes[some, 1], hashes[some, 0], owner[some]))]
    a, b = some[:-1], some[1:]
    out[b] = (owner[a] == owner[b]) & (hashes[a] == hashes[b]).all(axis=1)
    return out


def without(text: str, places: list[int]) -> tuple[str, int]:
    """The text without what the places cover, and how many characters that is."""
    out, at, gone = [], 0, 0
    for x in sorted(places):
        first, end = x >> 32, (x >> 32) + ((x & 0xFFFFFFFF) >> 1)
        if first > at:
            out.append(text[at:first])
        gone += max(0, end - max(first, at))
        at = max(at, end)
    return "".join([*out, text[at:]]), gone


def dedup_lines(spark: SparkSession, docs: DataFrame, *, scratch: Scratch | None = None) -> DataFrame:
    """The columns of ``docs`` with repeated passages gone from text, n_lines, and n_removed (characters)."""
    scratch = scratch or Scratch(spark, "lines")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in parts(batch, "text", 512, 1 << 20):
                some = some.filter(some["text"].is_valid())
                texts = some["text"].to_pylist()
                owners, places, digests = [], [], []
                for k, text in enumerate(texts):
                    at, found = windows_of(text)
                    owners.append(np.full(len(at), k))
                    places.append(at)
                    digests.append(found)
                runs, at, more = runs_of(texts) if texts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64))
                both = np.concatenate([*digests, more])
                both[:, 1] >>= 32
                owner, at = np.concatenate([*owners, runs]).astype(np.int64), np.concatenate([*places, at])
                at = np.where(repeats(owner, at, both), ~at, at)
                hashes, owner = (pa.array(np.ascontiguousarray(both[:, 0])), pa.array(both[:, 1].astype(np.int32))), pa.array(owner)
                yield pa.RecordBatch.from_arrays([*hashes, some["name"].take(owner), some["mark"].take(owner), pa.array(at)], names=["h1", "h2", "name", "mark", "place"])
        release()

    who, what = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")), F.xxhash64(F.lit(1), F.col("text"))
    every = docs.select(who.alias("name"), what.alias("mark"), "text").mapInArrow(windows, "h1 long, h2 int, name long, mark long, place long")
    found, found_at = scratch.write(every, "windows")
    # places below 0 are repeats within a text; of the others a text has one for each window, so numbers that hash aggregates can hold say which text is first
    single = found.where("place >= 0")
    first = single.groupBy("h1", "h2").agg(F.min("name").alias("least"), F.min_by("mark", "name").alias("least_mark"), F.count("*").alias("n")).where("n > 1").drop("n")
    first, first_at = scratch.write(first, "repeated")
    # merge joins at every size: what is shuffled then grows as the input does, and Spark can split hot windows
    later = single.join(first.hint("merge"), ["h1", "h2"]).where("name <> least or mark <> least_mark").select("name", "mark", "place")
    later = later.unionByName(found.where("place < 0").select("name", "mark", F.bitwise_not("place").alias("place")))
    later, later_at = scratch.write(later.groupBy("name", "mark").agg(F.sort_array(F.collect_set("place")).alias("places")), "later")
    scratch.drop(found_at)
    scratch.drop(first_at)

    fields = [x for x in docs.schema.fields if x.name not in ("text", "n_lines", "n_removed")]
    name, mark, places = private(docs.columns, "name", "mark", "places")
    keyed = docs.withColumns({name: who, mark: what})
    joined = keyed.join(later.withColumnsRenamed({"name": name, "mark": mark, "places": places}).hint("merge"), [name, mark], "left")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, places = batch.column(len(fields)), batch.column(len(fields) + 1)
            cuts = pc.add(pc.count_substring(column, "\n"), pc.count_substring_regex(column, "[.!?] +"))
            totals = pc.fill_null(pc.add(cuts, 1).cast(pa.int64()), 0)
            touched = np.flatnonzero(places.is_valid().to_numpy(zero_copy_only=False))
            done = [without(column[i].as_py(), places[i].as_py()) for i in touched.tolist()]
            gone = np.zeros(batch.num_rows, dtype=np.int64)
            gone[touched] = [x for _, x in done]
            changed = np.zeros(batch.num_rows, dtype=bool)
            changed[touched] = True
            texts = pc.replace_with_mask(column.cast(pa.string()), pa.array(changed), pa.array([x for x, _ in done], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], texts, totals, pa.array(gone)], names=[*(x.name for x in fields), "text", "n_lines", "n_removed"])
        release()

    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    scratch.sweep(later_at)
    out = joined.select(*(x.name for x in fields), "text", places).mapInArrow(rebuild, schema)
    return out.select(*(x for x in docs.columns if x not in ("n_lines", "n_removed")), "n_lines", "n_removed")
