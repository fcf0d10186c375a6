"""Token ids of documents in canonical-Huffman files, in ascending doc_id order, and back.

Writing takes three narrow steps round one shuffle: ids are found and dealt to ranges of doc_id whose
bounds come from quantiles of that column (at most ``MOST_RANGES``); global counts give one length-limited
code; each range's task writes independent blocks. A block decodes alone: it holds its documents' ids and lengths and the
bit offset of every ``STRIDE``-th id, from which a reader can start. The files are Parquet tables of
such blocks, so Spark's committers make them whole after a lost executor and any Hadoop store holds them;
they are written where the caller says, else under the shared folder.

Order: doc_id with nulls first, then a hash of the text, so ties and repeated rows have a fixed place up
to equal rows. A null text counts as empty and holds the end id alone; a very long one is a block of its
own. An empty table gives files without a block. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.huffman import Code, code_lengths
from kinweave.llm.storage import Scratch, deal, plan_bytes, shuffle_width
from kinweave.llm.tokens import encoder, parts, release, with_end

STRIDE, BLOCK_IDS, MAGIC, MOST_RANGES = 256, 1 << 18, b"KWH1", 1 << 14
_HEAD = struct.Struct("<4sIQII")  # magic, documents, ids, checkpoints, stride
_LEAST = -(1 << 63)


@dataclass(frozen=True)
class IdFiles:
    """``blocks``: one row for each block; ``codebook``: one row with the code lengths of all ids."""

    blocks: str
    codebook: str


def write_block(code: Code, doc_ids: list[int | None], lengths: np.ndarray, flat: np.ndarray) -> bytes:
    """A block of documents whose ids lie one after another in ``flat``."""
    bits, offsets = code.encode(flat, STRIDE)
    head = _HEAD.pack(MAGIC, len(doc_ids), len(flat), len(offsets), STRIDE)
    known = np.array([x is not None for x in doc_ids], dtype=np.uint8)
    names = np.array([x or 0 for x in doc_ids], dtype="<i8")
    return head + known.tobytes() + names.tobytes() + lengths.astype("<u4").tobytes() + offsets.astype("<u8").tobytes() + bits


def read_block(code: Code, data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and all ids of a block."""
    magic, docs, count, points, stride = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a block of ids")
    at = _HEAD.size
    known = np.frombuffer(data, dtype=np.uint8, count=docs, offset=at)
    names = np.frombuffer(data, dtype="<i8", count=docs, offset=(at := at + docs))
    lengths = np.frombuffer(data, dtype="<u4", count=docs, offset=(at := at + 8 * docs))
    offsets = np.frombuffer(data, dtype="<u8", count=points, offset=(at := at + 4 * docs))
    flat = code.decode(data[at + 8 * points :], count, offsets, stride)
    return [x if k else None for x, k in zip(names.tolist(), known.tolist(), strict=True)], lengths.astype(np.int64), flat


def _range_bounds(docs: DataFrame, ranges: int) -> list[int]:
    """Quantiles of doc_id; a value that many rows share is there more than once."""
    ids = docs.select(F.coalesce("doc_id", F.lit(_LEAST)).cast("long").alias("doc_id"))
    return [int(x) for x in ids.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], max(10_000, 10 * ranges))).first()[0] or []] if ranges > 1 else []


def write_ids(spark: SparkSession, docs: DataFrame, tokenizer: str, *, end_id: int = 2, path: str | None = None, scratch: Scratch | None = None) -> IdFiles:
    """Encodes doc_id and text of ``docs`` into files in the folder ``path``."""
    scratch = scratch or Scratch(spark, "ids")
    docs = docs.select("doc_id", "text")
    width = max(2 * shuffle_width(spark), min(plan_bytes(docs) >> 26, MOST_RANGES))
    bounds = _range_bounds(docs, width)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, cuts = encoder(tokenizer), np.array(bounds, dtype=np.int64)
        total, item = np.zeros(tokens.size, dtype=np.int64), tokens.dtype.itemsize
        for batch in batches:
            for part in parts(batch, "text", most_bytes=1 << 23):
                ids, ends = with_end(*tokens.encode_flat(part["text"]), end_id)
                marks = np.array([zlib.crc32(x.as_buffer()) if x.is_valid else 0 for x in part["text"]], dtype=np.int64)
                names = part["doc_id"].cast(pa.int64())
                keys = pc.fill_null(names, _LEAST).to_numpy()
                low, high = (np.searchsorted(cuts, keys, side) for side in ("left", "right"))
                to = low + (marks * (high - low + 1) >> 32)
                total += np.bincount(ids, minlength=len(total))
                offsets = np.concatenate([[0], ends * item]).astype(np.int32)
                coded = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), names, pa.array(marks), coded, pa.nulls(len(to), pa.binary())], schema=_IDS)
        if (at := np.flatnonzero(total)).size:  # the task's counts travel with its ids, in a column of their own
            sums = np.stack([at, total[at]]).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((TaskContext.get().partitionId() % width, None, None, None, sums), _IDS, strict=True)], schema=_IDS)
        release()

    found = docs.mapInArrow(tokenise, _IDS_DDL)
    sorted_ids, sorted_at = scratch.write(deal(found, width, "range").sortWithinPartitions("range", F.asc_nulls_first("doc_id"), "mark"), "ids")
    size = encoder(tokenizer).size
    kind = encoder(tokenizer).dtype

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                at, n = np.frombuffer(x.as_py(), dtype="<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n, pa.int64())], names=["id", "n"])

    counts = np.zeros(size, dtype=np.int64)  # at most one row for each id of the vocabulary comes here
    for row in sorted_ids.select("counts").where("counts is not null").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row["id"]] = row["n"]
    lengths = code_lengths(counts)
    sent = spark.sparkContext.broadcast(lengths.tobytes())  # one byte for each id of the vocabulary

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, task = Code(np.frombuffer(sent.value, dtype=np.uint8)), TaskContext.get().partitionId()
        run, within, block = None, 0, 0
        names: list[int | None] = []
        held: list[np.ndarray] = []  # runs of ids, and their documents' lengths
        sizes: list[np.ndarray] = []
        many = first_mark = 0

        def flush() -> pa.RecordBatch:
            nonlocal within, block, many
            row = [run, task, block, names[0], first_mark, within, many, write_block(code, names, np.concatenate(sizes), np.concatenate(held))]
            out = pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, _BLOCKS, strict=True)], schema=_BLOCKS)
            within, block, many = within + many, block + 1, 0
            for x in (names, held, sizes):
                x.clear()
            return out

        for batch in batches:
            ids = batch.column(3)
            ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64) // kind.itemsize
            flat = np.frombuffer(ids.buffers()[2], kind, count=int(ends[-1]))
            to, marks, own = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(1).to_pylist()
            at = 0
            while at < len(to):
                if names and (to[at] != run or many >= BLOCK_IDS):
                    yield flush()
                if to[at] != run:
                    run, within = int(to[at]), 0
                if not names:
                    first_mark = int(marks[at])
                same = at + int(np.argmax(np.append(to[at:] != run, True)))
                until = min(max(int(np.searchsorted(ends, ends[at] + BLOCK_IDS - many)), at + 1), same)
                names += own[at:until]
                held.append(flat[ends[at] : ends[until]].copy())  # the batch goes, the block stays
                sizes.append(np.diff(ends[at : until + 1]))
                many += len(held[-1])
                at = until
        if names:
            yield flush()
        release()

    blocks, book = (f"{path}/{x}" if path else scratch.path(x) for x in ("blocks", "codebook"))
    sorted_ids.where("ids is not null").select("range", "doc_id", "mark", "ids").mapInArrow(encode, _BLOCKS_DDL).write.option("compression", "none").parquet(blocks)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").write.parquet(book)
    scratch.drop(sorted_at)
    return IdFiles(blocks, book)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


_IDS_DDL = "range int, doc_id long, mark long, ids binary, counts binary"
_IDS = _arrow(_IDS_DDL)
_BLOCKS_DDL = "range int, task int, block int, first_id long, first_mark long, within long, n_ids long, data binary"
_BLOCKS = _arrow(_BLOCKS_DDL)


def read_ids(spark: SparkSession, files: IdFiles, *, digest: bool = False) -> DataFrame:
    """One row for each document of the files: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit).

    With ``digest``, ids_crc32 of those bytes stands in place of ids.
    """
    blocks = spark.read.schema(_BLOCKS_DDL).parquet(files.blocks)
    lengths = bytes(spark.read.parquet(files.codebook).first()["lengths"])
    runs = blocks.groupBy("range", "task").agg(F.min(F.struct(F.coalesce("first_id", F.lit(_LEAST)), "first_mark", "block")).alias("first"), F.sum("n_ids").alias("n")).orderBy("range", "first").collect()  # one row for each range and write task
    base, at = {}, 0
    for row in runs:
        base[row["range"], row["task"]] = at
        at += row["n"]
    sent = spark.sparkContext.broadcast((lengths, base))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, starts = Code(np.frombuffer(sent.value[0], dtype=np.uint8)), sent.value[1]
        for batch in batches:
            for to, task, within, data in zip(*(batch.column(i) for i in range(4)), strict=True):
                names, lens, flat = read_block(code, data.as_buffer())
                ends = np.cumsum(lens)
                begins = starts[to.as_py(), task.as_py()] + within.as_py() + ends - lens
                whole = flat.astype("<u4", copy=False)
                offsets = np.concatenate([[0], 4 * ends])
                if digest:
                    seen, at = memoryview(whole).cast("B"), offsets.tolist()
                    ids = pa.array([zlib.crc32(seen[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.int64())
                else:
                    ids = pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(offsets), pa.py_buffer(whole)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(begins, pa.int64()), pa.array(lens, pa.int64()), ids], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])
        release()

    return blocks.select("range", "task", "within", "data").mapInArrow(decode, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary"))
