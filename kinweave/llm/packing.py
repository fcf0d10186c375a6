"""Packing of token documents into windows by Karmarkar-Karp multiway differencing.

Each scan task packs its own documents in groups of ``group``; nothing is shuffled, so the plan is one
narrow stage at any size. Documents longer than a window are cut at its multiples, and pieces of a whole
window fill windows alone; no other document is cut. The rest, one tail of a document each, is differenced:
the two partial partitions with the largest imbalances merge with their windows in opposite order, until
one partition is left, whose windows are near-equal. The first window count is the least that could hold
the tails, and it rises as long as a window exceeds its capacity.

Null text counts as empty: one piece that holds the end id. Very long texts are cut as above. Repeated rows
and ids, and ties of length, are packed one by one. An empty table gives no row. Extra columns, whatever
their names, are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from kinweave.llm.tokens import encoder, parts, release, with_end

KEPT_PIECES = 200_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: the indexes of ``sizes`` in each of ``windows`` near-equal parts.

    A partial partition lists its parts that hold anything, the largest sum first. While two of them have
    few enough, the parts of one only meet empty ones of the other.
    """
    heap: list[tuple] = [(-size, i, [size], [[i]]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, tie, sums, parts = heapq.heappop(heap)
        _, _, sums2, parts2 = heapq.heappop(heap)
        free = windows - len(sums)
        sums, parts = sums + sums2[:free], parts + parts2[:free]
        # what is left over of the second, smallest last, meets the smallest of the first
        for k, (size, part) in enumerate(zip(sums2[free:], parts2[free:], strict=True)):
            at = windows - free - 1 - k
            sums[at] += size
            parts[at] = parts[at] + part
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        sums, parts = [sums[i] for i in order], [parts[i] for i in order]
        heapq.heappush(heap, ((sums[-1] if len(sums) == windows else 0) - sums[0], tie, sums, parts))
    found = heap[0][3] if heap else []
    return found + [[] for _ in range(windows - len(found))]


def pack(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length) that hold every token of documents of these lengths once."""
    out, tails = [], []
    for doc, n in enumerate(lengths):
        for start in range(0, n, capacity):
            piece = (doc, start, min(capacity, n - start))
            (out.append([piece]) if piece[2] == capacity else tails.append(piece))
    if not tails:
        return out
    sizes = [x[2] for x in tails]
    windows = -(-sum(sizes) // capacity)
    while True:
        parts = difference(sizes, windows)
        over = max(sum(sizes[i] for i in part) for part in parts) / capacity - 1
        if over <= 0:
            return out + [[tails[i] for i in part] for part in parts if part]
        windows += max(1, int(windows * over / 2))


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 1024, end_id: int = 0, group: int = 256) -> DataFrame:
    """One row for each piece: where it is in its document and in its window, and the CRC of its ids.

    Reads doc_id and text of ``docs``. A window's id is unique: the task's number and a count within it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        tokens, base = encoder(tokenizer, KEPT_PIECES), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        names: list[int | None] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal base
            rows = []
            for window in pack([len(ids) for ids in held], capacity):
                at, total = 0, sum(x[2] for x in window)
                for doc, start, n in window:
                    ids = held[doc]
                    rows.append((names[doc], start, n, zlib.crc32(ids[start : start + n]), len(ids), base, at, total))
                    at += n
                base += 1
            names.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], schema=_ARROW)

        many = 0
        for batch in batches:
            for part in parts(batch, "text"):
                ids, ends = with_end(*tokens.encode_flat(part["text"]), end_id)
                begins = [0, *ends[:-1].tolist()]
                for name, a, b in zip(part["doc_id"].to_pylist(), begins, ends.tolist(), strict=True):
                    names.append(name)
                    held.append(ids[a:b].astype("<u4"))
                    many += b - a
                    if len(held) >= group or many >= 4 << 20:
                        yield flush()
                        many = 0
        if held:
            yield flush()
        release()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
