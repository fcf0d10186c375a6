"""N-gram Jaccard self-join by vertical partitioning, and the groups that its links form.

The global order of shingles is cut into fragments. Every document's set is cut with it, and a fragment's
task, which sees all of a fragment's shingles, counts what it can alone; sums over fragments give a
document's or a pair's figure:

1. Fragments count each shingle's documents. A document with under ``percent`` % of shared shingles
   can't link and leaves. Equal sets become one class; fragments count again over classes.
2. A class's prefix, its rarest shingles, holds one of any partner's. Each prefix shingle's most typical
   class is a leader; leader pairs are verified and linked classes form first clusters.
3. Classes of different clusters that share a prefix shingle, and whose lengths and positions allow
   enough overlap, are candidates, all of them. Classes of one cluster are connected already, so no link
   between different groups is lost and the pairs inside a group of near copies are never listed.
4. A pair's overlap is the sum of its partial overlaps, counted fragment by fragment.

Sets of shingle hashes stand for the sets of shingles (58 bits or more of a 64-bit hash). Long lists of one
shingle are dealt out as tiles, so no task holds an unbounded list. Null or empty text: an empty set,
linked with nothing. Rows are told apart by their place, so repeated ids and rows are fine; a null doc_id
is in no way smallest. Very long texts count whole; an empty table gives no row. Extra columns, whatever their
names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.components import connected_components
from kinweave.llm.shingles import shingle_sets
from kinweave.llm.storage import Scratch, deal, plan_bytes, shuffle_width
from kinweave.llm.tokens import release, slices

_U = np.uint64
_META = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("n", "<u4"), ("set", "V16")])
_PIECES = "frag int, block long, low binary, high binary, local binary, df binary, meta binary"
_PIECES_ARROW = pa.schema([("frag", pa.int32()), ("block", pa.int64()), *((x, pa.binary()) for x in ("low", "high", "local", "df", "meta"))])
_SETS = "key long, doc_id long, n long, digest binary, own long, typical double, grams binary, prefix array<long>"
_SETS_ARROW = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("own", pa.int64()), ("typical", pa.float64()), ("grams", pa.binary()), ("prefix", pa.list_(pa.int64()))])
_SEGMENTS, _TILE = 8, 512  # segments: a power of two up to 8


def _cut(bits: int, block: int, metas: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
    """A block's sets as one piece for each fragment that it has shingles of, and a piece about its documents."""
    grams = np.concatenate(sets) if sets else np.zeros(0, dtype=_U)
    local = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(x) for x in sets])
    frag = (grams >> _U(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
    order = np.argsort(frag, kind="stable")
    frag, rest, local = frag[order], (grams[order] << _U(bits)) >> _U(16), local[order]
    begins = np.flatnonzero(np.diff(frag.astype(np.int64), prepend=-1))
    ends = np.append(begins[1:], len(frag))
    low, high = (rest & _U(0xFFFFFFFF)).astype("<u4"), (rest >> _U(32)).astype("<u2")
    rows = [(int(frag[a]), block, low[a:b].tobytes(), high[a:b].tobytes(), local[a:b].tobytes(), None, None) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
    rows.append((block % (1 << bits), block, None, None, None, None, metas.tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), _PIECES_ARROW, strict=True)], schema=_PIECES_ARROW)


def _joined(frag: int, low: bytes, high: bytes, bits: int) -> np.ndarray:
    rest = np.frombuffer(low, "<u4").astype(_U) | (np.frombuffer(high, "<u2").astype(_U) << _U(32))
    return (_U(frag) << _U(64 - bits)) | ((rest << _U(16)) >> _U(bits))


def _block_ids() -> Iterator[int]:
    task = TaskContext.get().partitionId()
    return iter(range(task << 16, (task + 1) << 16))


def _text_pieces(docs: DataFrame, words: int, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _block_ids()
        for batch in batches:
            for first, texts in slices(batch.column(1), 1 << 13, 1 << 21):
                sets = shingle_sets(texts, words)
                metas = np.zeros(len(texts), dtype=_META)
                for k, (name, got) in enumerate(zip(batch.column(0).slice(first, len(texts)).to_pylist(), sets, strict=True)):
                    metas[k] = (name is not None, name or 0, len(got), xxhash.xxh3_128_digest(got.tobytes()))
                yield _cut(bits, next(ids), metas, sets)
        release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PIECES)


def _class_pieces(classes: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _block_ids()
        for batch in batches:
            rows, many, held = [], 0, list(zip(*(batch.column(i) for i in range(3)), strict=True))
            for k, (key, n, grams) in enumerate(held):
                rows.append((key.as_py(), n.as_py(), np.frombuffer(grams.as_py(), dtype="<u8")))
                many += len(rows[-1][2])
                if many >= 1 << 19 or k == len(held) - 1 or len(rows) >= 1 << 13:
                    metas = np.array([(1, a, b, b"") for a, b, _ in rows], dtype=_META)
                    yield _cut(bits, next(ids), metas, [x for *_, x in rows])
                    rows, many = [], 0

    return classes.select("key", "n", "grams").mapInArrow(run, _PIECES)


def _shared(pieces: DataFrame, width: int, bits: int) -> DataFrame:
    """In each fragment, the shingles that two sets or more have, with their counts, for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def count() -> pa.RecordBatch:
            rest = np.concatenate([np.frombuffer(x[2], "<u4").astype(_U) | (np.frombuffer(x[3], "<u2").astype(_U) << _U(32)) for x in held])
            _, inverse, counts = np.unique(rest, return_inverse=True, return_counts=True)
            df = counts[inverse]
            rows, at = [], 0
            for frag, block, low, high, local in held:
                own = df[at : at + len(local) // 2]
                at += len(own)
                if len(keep := np.flatnonzero(own > 1)):
                    rows.append((frag, block, np.frombuffer(low, "<u4")[keep].tobytes(), np.frombuffer(high, "<u2")[keep].tobytes(), np.frombuffer(local, "<u2")[keep].tobytes(), own[keep].astype("<u4").tobytes(), None))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, _PIECES_ARROW, strict=True)], schema=_PIECES_ARROW)

        for batch in batches:
            for row in zip(*(batch.column(i) for i in (0, 1, 2, 3, 4, 6)), strict=True):
                frag, block, low, high, local, meta = (x.as_py() for x in row)
                if held and held[0][0] != frag:
                    yield count()
                if meta is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((frag, block, None, None, None, None, meta), _PIECES_ARROW, strict=True)], schema=_PIECES_ARROW)
                else:
                    held.append((frag, block, low, high, local))
        if held:
            yield count()
        release()

    return deal(pieces, width, "frag").sortWithinPartitions("frag").mapInArrow(run, _PIECES)


def _kept(shared: DataFrame, width: int, bits: int, percent: int, *, classes: bool) -> DataFrame:
    """One row for each set; those with enough shared shingles for a link have them, and their prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def sets() -> pa.RecordBatch:
            block = held[0][1]
            metas = np.frombuffer(next(x[6] for x in held if x[6] is not None), dtype=_META)
            parts = [x for x in held if x[6] is None]
            if parts:
                grams = np.concatenate([_joined(x[0], x[2], x[3], bits) for x in parts])
                local = np.concatenate([np.frombuffer(x[4], "<u2") for x in parts])
                df = np.concatenate([np.frombuffer(x[5], "<u4") for x in parts])
                counts = np.bincount(local, minlength=len(metas))
                keep = (100 * counts >= percent * metas["n"].astype(np.int64))[local]
                grams, local, df = grams[keep], local[keep], df[keep]
                order = np.lexsort((grams, df, local))
                grams, local, df = grams[order], local[order], df[order]
                begins = np.searchsorted(local, np.arange(len(metas) + 1))
            else:
                begins = np.zeros(len(metas) + 1, dtype=np.int64)
            rows = []
            for k, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)):
                n = int(metas["n"][k])
                name = int(metas["doc_id"][k]) if metas["known"][k] else None
                key, doc_id = (name, None) if classes else (block << 16 | k, name)
                if b == a:
                    rows.append((key, doc_id, n, metas["set"][k].tobytes(), None, None, None, None))
                    continue
                own = n - (b - a)
                prefix = max(n - -(-percent * n // 100) + 1 - own, 0) if classes else 0
                rows.append((key, doc_id, n, metas["set"][k].tobytes(), own, float(df[a:b].sum() / n), np.sort(grams[a:b]).astype("<u8").tobytes(), grams[a : a + prefix].astype(np.int64)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, _SETS_ARROW, strict=True)], schema=_SETS_ARROW)

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                row = tuple(x.as_py() for x in row)
                if held and held[0][1] != row[1]:
                    yield sets()
                held.append(row)
        if held:
            yield sets()
        release()

    return shared.repartition(width, "block").sortWithinPartitions("block").mapInArrow(run, _SETS)


def _segments(classes: DataFrame) -> DataFrame:
    """key, segment, grams: each class's shared shingles, cut into a few fragments of the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, parts, out = [], [], []
            for key, grams in zip(batch.column(0), batch.column(1), strict=True):
                grams = np.frombuffer(grams.as_py(), dtype="<u8")
                cuts = np.searchsorted(grams, [_U(k << 61) for k in range(1, _SEGMENTS)])
                for k, part in enumerate(np.split(grams, cuts)):
                    keys.append(key.as_py())
                    parts.append(k)
                    out.append(part.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(parts, pa.int32()), pa.array(out, pa.binary())], names=["key", "segment", "grams"])

    return classes.select("key", "grams").mapInArrow(run, "key long, segment int, grams binary")


def _overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """a, b, overlap: partial overlaps of pairs (a, b), counted in each segment and summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = sorted((np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")), key=len)
                at = np.searchsorted(y, x)
                counts.append(int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["a", "b", "part"])

    left = segments.select(F.col("key").alias("a"), "segment", F.col("grams").alias("x"))
    right = segments.select(F.col("key").alias("b"), "segment", F.col("grams").alias("y"))
    both = pairs.join(left, "a").join(right, ["b", "segment"]).select("a", "b", "x", "y")
    return both.mapInArrow(run, "a long, b long, part long").groupBy("a", "b").agg(F.sum("part").alias("overlap"))


def _links(pairs: DataFrame, segments: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, na, nb), those similar enough."""
    counted = _overlaps(pairs.select("a", "b"), segments).join(sizes.select(F.col("key").alias("a"), F.col("n").alias("na")), "a")
    counted = counted.join(sizes.select(F.col("key").alias("b"), F.col("n").alias("nb")), "b")
    return counted.where(F.col("overlap") * 100 >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b")


def _cross_pairs(entries: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs of different clusters under one prefix shingle that lengths and positions allow."""

    def pairs_of(rows: np.ndarray) -> np.ndarray:
        t = percent / 100
        rows = rows[np.argsort(rows["n"], kind="stable")]
        n, room = rows["n"].astype(np.float64), (rows["n"] - rows["p"]).astype(np.float64)
        most = room * (1 + t) / t - n + 1e-6  # a partner of more shingles needs a larger overlap than this place leaves
        low = np.searchsorted(n, np.ceil(n * t - 1e-6), "left")
        high = np.searchsorted(n, np.minimum(n, most), "right")
        found = []
        for i in np.flatnonzero(high > low).tolist():
            j = np.arange(low[i], min(int(high[i]), i))
            j = j[(most[j] >= n[i]) & (rows["cluster"][j] != rows["cluster"][i])]
            if rows["i"][i] != rows["j"][i]:
                j = j[rows["side"][j] != rows["side"][i]]
            if len(j):
                found.append(np.stack([np.minimum(rows["key"][j], rows["key"][i]), np.maximum(rows["key"][j], rows["key"][i])], axis=1))
        return np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)

    kind = np.dtype([("gram", "i8"), ("i", "i8"), ("j", "i8"), ("side", "i8"), ("key", "i8"), ("n", "i8"), ("p", "i8"), ("cluster", "i8")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, found, many = np.zeros(0, dtype=kind), [], 0

        def flush() -> pa.RecordBatch:
            got = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), dtype=np.int64)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

        for batch in batches:
            rows = np.zeros(batch.num_rows, dtype=kind)
            for k, name in enumerate(kind.names):
                rows[name] = batch.column(k).to_numpy(zero_copy_only=False)
            rows = np.concatenate([rest, rows])
            change = np.flatnonzero((np.diff(rows["gram"]) != 0) | (np.diff(rows["i"]) != 0) | (np.diff(rows["j"]) != 0)) + 1
            for a, b in zip([0, *change[:-1].tolist()], change.tolist(), strict=False):
                found.append(pairs_of(rows[a:b]))
                many += len(found[-1])
            rest = rows[change[-1] :] if len(change) else rows
            if many > 1 << 20:
                yield flush()
                many = 0
        if len(rest):
            found.append(pairs_of(rest))
        yield flush()

    tiles = F.greatest(F.ceil(F.col("many") / _TILE), F.lit(1)).cast("long")
    side = F.pmod(F.xxhash64("key"), F.col("tiles"))
    dealt = entries.withColumn("tiles", tiles).withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    dealt = dealt.select("gram", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "key", "n", "p", "cluster")
    return dealt.repartition(width, "gram", "i", "j").sortWithinPartitions("gram", "i", "j").mapInArrow(run, "a long, b long").distinct()


def jaccard_groups(spark: SparkSession, docs: DataFrame, *, words: int = 5, percent: int = 75, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    scratch = scratch or Scratch(spark, "jaccard")
    width = shuffle_width(spark)
    bits = min(24, max(10, (8 * width - 1).bit_length(), (plan_bytes(docs) >> 21).bit_length()))
    rows, rows_at = scratch.write(_kept(_shared(_text_pieces(docs, words, bits), width, bits), width, bits, percent, classes=False), "sets")

    some = rows.where("grams is not null")
    heads, _ = scratch.write(some.groupBy("digest", "n").agg(F.min("key").alias("rep")), "heads")
    members, _ = scratch.write(some.select("key", "doc_id", "n", "digest").join(heads, ["digest", "n"]).select("key", "doc_id", "n", "rep"), "members")
    one_each = some.select("key", "n", "grams").join(heads.select(F.col("rep").alias("key")), "key")
    kept, _ = scratch.write(_kept(_shared(_class_pieces(one_each, bits), width, bits), width, bits, percent, classes=True).where("grams is not null"), "classes")
    segments, _ = scratch.write(_segments(kept), "segments")

    entries = kept.select("key", "n", "own", "typical", F.posexplode("prefix").alias("at", "gram")).select("gram", "key", "n", (F.col("own") + F.col("at")).alias("p"), "typical")
    leaders, _ = scratch.write(entries.groupBy("gram").agg(F.max(F.struct("typical", (-F.col("key")).alias("minus"), "n")).alias("m"), F.count("*").alias("c")).where("c > 1").select("gram", (-F.col("m.minus")).alias("b"), F.col("m.n").alias("nb")), "leaders")
    fits = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (F.col("a") != F.col("b"))
    star = entries.select("gram", F.col("key").alias("a"), F.col("n").alias("na")).join(leaders, "gram").where(fits).select("a", "b").distinct()
    star, _ = scratch.write(star, "star")
    sizes = kept.select("key", "n")
    linked, _ = scratch.write(_links(star, segments, sizes, percent), "linked")
    clusters, _ = scratch.write(connected_components(linked, scratch), "clusters")

    placed = entries.drop("typical").join(clusters.withColumnsRenamed({"node": "key", "component": "cluster"}), "key", "left").withColumn("cluster", F.coalesce("cluster", "key"))
    placed, _ = scratch.write(placed, "placed")
    t = percent / 100
    mixed, _ = scratch.write(placed.groupBy("gram").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi"), F.min("n").alias("least")).where("lo <> hi").select("gram", "least"), "mixed")
    fit = placed.join(mixed, "gram").where((F.col("n") - F.col("p")) * (1 + t) + 1e-6 >= t * (F.col("n") + F.greatest(F.col("n") * t, F.col("least"))))
    fit, _ = scratch.write(fit.drop("least"), "fit")
    again, _ = scratch.write(fit.groupBy("gram").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi"), F.count("*").alias("many")).where("lo <> hi").select("gram", "many"), "again")
    cross = _cross_pairs(fit.join(again, "gram"), width, percent)
    tested = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross, _ = scratch.write(cross.join(tested, ["a", "b"], "left_anti"), "cross")
    more = _links(cross, segments, sizes, percent)
    last, _ = scratch.write(connected_components(linked.unionByName(more), scratch), "last")

    found = members.join(last.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    found, found_at = scratch.write(found.select("doc_id", "n", "component"), "found")
    least, least_at = scratch.write(found.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    scratch.sweep(rows_at, found_at, least_at)
    out = found.join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(rows.where("grams is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
