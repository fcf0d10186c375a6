"""Document quality by co-training two views.

The content view sees a text's characters and words; the metadata view sees language, source, length and
the layout of lines. Each view is a logistic regression, fitted on labelled documents and calibrated (a
logistic regression of its logit) on others that it never trains on. Over ``ROUNDS`` rounds, each view says
of which documents of the whole corpus it is sure (``SURE``, calibrated); these pseudo-labels train the other
view: every task sums the gradient and the curvature of its documents, a tree of sums brings them together,
and the driver adds them to the labelled loss, with ``EXCHANGED`` of its weight and the labels' class shares.
A view takes them only if they are of both classes and don't make it worse on the calibrating documents.
A logistic regression of the two calibrated views scores all documents.

Labelled documents are a bounded sample, ``LABELLED`` in order of a hash of doc_id; everything else covers
all documents, whole. The figures of all documents are written once, as half-precision numbers.

Conflicting labels of a document count by their mean, even ones as good; of several rows of one doc_id, the
text of the smallest hash is the labelled one. Ties don't matter otherwise: each row is scored by itself.
Documents without a word (null or empty text, white space) get score 0 and are rejected. With fewer than
``LEAST_LABELS`` labelled documents of either class nothing can be learnt: every document with a word scores
1. An empty table gives an empty table. Very long texts count as any other. All columns stay as they are,
but columns named score, content_score, meta_score or kept, which are replaced.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.shingles import texts_words
from kinweave.llm.storage import Scratch, plan_bytes, private
from kinweave.llm.tokens import release, slices

LABELLED, LEAST_LABELS, ROUNDS, SURE, EXCHANGED = 12_000, 10, 3, 0.97, 0.5
_BUCKETS = 128
_CLASS = np.full(256, 9, dtype=np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n", b".", b",;:", b"!?", b"|")):
    _CLASS[list(_chars)] = _k
_CLASS[128:192], _CLASS[192:] = 10, 11
CONTENT, META = 12 + 144 + 4 + _BUCKETS, 8 + 32 + 6


def _hashed(value: str | None, size: int) -> np.ndarray:
    out = np.zeros(size)
    out[xxhash.xxh64_intdigest(value or "") % size] = 1
    return out


def content_view(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Figures of each text, and its words."""
    hashes, at = texts_words(texts)
    out = np.zeros((len(texts), CONTENT), dtype=np.float32)
    for k, text in enumerate(texts):
        words = hashes[at[k] : at[k + 1]]
        if not len(words):
            continue
        kinds = _CLASS[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
        n = len(kinds)
        out[k, :12] = np.bincount(kinds, minlength=12) / n
        out[k, 12:156] = np.sqrt(np.bincount(kinds[:-1] * 12 + kinds[1:], minlength=144) / n)
        _, counts = np.unique(words, return_counts=True)
        out[k, 156:160] = (words[1:] == words[:-1]).mean() if len(words) > 1 else 0, len(counts) / len(words), counts.max() / len(words), n / len(words) / 10
        out[k, 160:] = np.sqrt(np.bincount((words >> np.uint64(57)).astype(np.int64), minlength=_BUCKETS) / len(words))
    return out, np.diff(at)


def meta_view(texts: list[str | None], langs: list[str | None], sources: list[str | None], chars: list[int | None]) -> np.ndarray:
    out = np.zeros((len(texts), META), dtype=np.float32)
    for k, text in enumerate(texts):
        lines = (text or "").split("\n")
        sizes = np.fromiter(map(len, lines), np.float64, len(lines))
        size = chars[k] if chars[k] is not None else len(text or "")
        out[k, :8], out[k, 8:40] = _hashed(langs[k], 8), _hashed(sources[k], 32)
        out[k, 40:] = np.log1p(max(size, 0)), np.log1p(len(lines)), np.log1p(sizes.mean()), np.log1p(sizes.max()), np.log1p(sizes.min()), sizes.std() / (1 + sizes.mean())
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Logistic:
    """A logistic regression on standardised columns, fitted by Newton's method."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Logistic:
        mean, scale = x.mean(axis=0, dtype=np.float64), x.std(axis=0, dtype=np.float64)
        scale[scale < 1e-9] = np.inf
        return cls(mean, scale, np.zeros(x.shape[1] + 1))

    def columns(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])

    def sums(self, x: np.ndarray, y: float) -> np.ndarray:
        """Rows, gradient and curvature of rows of one class, at the present weights."""
        z = self.columns(x)
        p = _sigmoid(z @ self.weights)
        return np.concatenate([[len(x)], z.T @ (y - p), ((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z).ravel()])

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, more: tuple[np.ndarray, np.ndarray] | None = None) -> Logistic:
        """``more``: gradient and curvature at the present weights of further rows, which count by that expansion."""
        z, w, was, keep = self.columns(x), self.weights.copy(), self.weights, np.full(len(self.weights), ridge)
        keep[-1] = 1e-6
        for _ in range(25):
            p = _sigmoid(z @ w)
            slope, bend = z.T @ (y - p) - keep * w, (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(keep)
            if more:
                slope, bend = slope + more[0] - more[1] @ (w - was), bend + more[1]
            step = np.linalg.solve(bend, slope)
            w += step
            if np.abs(step).max() < 1e-4:
                break
        return Logistic(self.mean, self.scale, w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1], -30, 30)


class CoTrained:
    """Two views, their calibration, and what joins them."""

    def __init__(self, content: np.ndarray, meta: np.ndarray, y: np.ndarray) -> None:
        """Every fifth labelled row of each class calibrates; the others train."""
        held = np.zeros(len(y), dtype=bool)
        for c in (0, 1):
            held[np.flatnonzero(y == c)[::5]] = True
        self.rows, self.held = [(v[~held], v[held]) for v in (content, meta)], y[held]
        self.y, self.prior = y[~held], float(y.mean())
        self.views = [Logistic.of(x).fit(x, self.y) for x, _ in self.rows]
        self._calibrate()

    def _calibrate(self) -> None:
        raw = [m.logit(x)[:, None] for m, (_, x) in zip(self.views, self.rows, strict=True)]
        self.scales = [Logistic.of(x).fit(x, self.held, 1e-2) for x in raw]
        both = np.hstack([c.logit(x)[:, None] for c, x in zip(self.scales, raw, strict=True)])
        self.joint = Logistic.of(both).fit(both, self.held, 1e-2)

    def logits(self, content: np.ndarray, meta: np.ndarray) -> list[np.ndarray]:
        """Of each view, calibrated."""
        return [c.logit(m.logit(x)[:, None]) for c, m, x in zip(self.scales, self.views, (content, meta), strict=True)]

    def pseudo(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """What documents of which one view is sure add to the other: sums for each view and class."""
        said, bound, out = self.logits(content, meta), np.log(SURE / (1 - SURE)), []
        for k, x in enumerate((content, meta)):
            other = said[1 - k]
            out += [self.views[k].sums(x[other <= -bound], 0.0), self.views[k].sums(x[other >= bound], 1.0)]
        return np.concatenate(out)

    def _loss(self, k: int) -> float:
        p = _sigmoid(self.scales[k].logit(self.views[k].logit(self.rows[k][1])[:, None]))
        return float(-np.log(np.where(self.held == 1, p, 1 - p) + 1e-12).mean())

    def exchange(self, sums: np.ndarray) -> None:
        """One round: fits both views to the labelled rows and the other's pseudo-labels of both classes.

        A view that gets worse on the calibrating rows stays as it was.
        """
        fitted, at, whole = [], 0, EXCHANGED * len(self.y)
        for view, (x, _) in zip(self.views, self.rows, strict=True):
            n = len(view.weights)
            slope, bend = np.zeros(n), np.zeros((n, n))
            low, high = (sums[at + k * (1 + n + n * n) :][: 1 + n + n * n] for k in (0, 1))
            at += 2 * (1 + n + n * n)
            if low[0] and high[0]:
                for share, part in ((1 - self.prior, low), (self.prior, high)):
                    slope += part[1 : n + 1] * whole * share / part[0]
                    bend += part[n + 1 :].reshape(n, n) * whole * share / part[0]
            fitted.append(view.fit(x, self.y, more=(slope, bend)))
        was, losses = self.views, [self._loss(k) for k in (0, 1)]
        self.views = fitted
        self._calibrate()
        self.views = [new if self._loss(k) <= losses[k] + 1e-3 else old for k, (new, old) in enumerate(zip(fitted, was, strict=True))]
        self._calibrate()

    def score(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.logits(content, meta)
        return _sigmoid(self.joint.logit(np.stack([a, b], axis=1))), _sigmoid(a), _sigmoid(b)

    def slim(self) -> CoTrained:
        """Without the labelled rows, to be sent to tasks."""
        out = copy.copy(self)
        out.rows = out.y = out.held = None
        return out


_LOOKED = ("text", "lang", "source", "n_chars")


def _views(columns: dict[str, pa.Array]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for first, texts in slices(columns["text"], 1024, 1 << 21):
        langs, sources, chars = (columns[x].slice(first, len(texts)).to_pylist() for x in _LOOKED[1:])
        content, words = content_view(texts)
        yield first, len(texts), content, meta_view(texts, langs, sources, chars), words


def _labelled(labels: DataFrame) -> DataFrame:
    """doc_id and class of labelled documents: some more than ``LABELLED``, the first in order of a hash."""
    told = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    share = 4 * LABELLED / max(told.count(), 1)
    if share < 1:
        told = told.where(F.xxhash64("doc_id") <= int(-(1 << 63) + share * (1 << 64)))
    return told.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))


def _added(df: DataFrame, size: int) -> np.ndarray:
    """The sum of a column of arrays of doubles as bytes, by a tree: few rows come to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), dtype="<f8")
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    tasks = plan_bytes(df) // df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    width = max(8, tasks // 16)
    while True:
        df = df.repartition(width).mapInArrow(add, "sums binary")
        if width <= 8:
            break
        width = max(8, width // 16)
    return sum((np.frombuffer(r["sums"], dtype="<f8") for r in df.collect()), np.zeros(size))  # eight rows


def fit_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, scratch: Scratch) -> CoTrained | None:
    """``docs``: doc_id, text, lang, source, n_chars."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    told = F.broadcast(_labelled(labels))  # about 4 * LABELLED rows at most, by the hash
    texts = docs.join(told, "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("mark"), *_LOOKED)).alias("d"))
    texts = texts.orderBy(*order).limit(LABELLED).select("doc_id", "y", *(F.col(f"d.{x}").alias(x) for x in _LOOKED))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, content, meta, _ in _views({x: batch[x] for x in _LOOKED}):
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, n), batch["y"].slice(first, n), pa.array([x.tobytes() for x in content], pa.binary()), pa.array([x.tobytes() for x in meta], pa.binary())], names=["doc_id", "y", "content", "meta"])

    rows = texts.repartition(8).mapInArrow(look, "doc_id long, y int, content binary, meta binary").collect()  # at most LABELLED
    rows.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r["doc_id"])), r["doc_id"]))
    y = np.array([r["y"] for r in rows], dtype=np.float64)
    if min((y == 0).sum(), (y == 1).sum()) < LEAST_LABELS:
        return None
    get = lambda name, size: np.array([np.frombuffer(r[name], "<f4") for r in rows], dtype=np.float64).reshape(-1, size)
    model = CoTrained(get("content", CONTENT), get("meta", META), y)
    known = spark.sparkContext.broadcast(np.sort(np.array([r["doc_id"] for r in rows], dtype=np.int64)))

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, content, meta, words in _views({x: batch[x] for x in _LOOKED}):
                ids = batch["doc_id"].slice(first, n)
                free = (words > 0) & ~(np.isin(ids.fill_null(0).to_numpy(), known.value) & ids.is_valid().to_numpy(zero_copy_only=False))
                both = np.hstack([content, meta])[free].astype("<f2")
                yield pa.RecordBatch.from_arrays([pa.array([both.tobytes()], pa.binary())], names=["both"])
        release()

    every, at = scratch.write(docs.mapInArrow(figures, "both binary"), "figures")
    size = len(model.pseudo(np.zeros((0, CONTENT)), np.zeros((0, META))))
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast(model.slim())

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                for x in batch.column(0):
                    both = np.frombuffer(x.as_buffer(), "<f2").reshape(-1, CONTENT + META).astype(np.float64)
                    total += sent.value.pseudo(both[:, :CONTENT], both[:, CONTENT:])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])
            release()

        model.exchange(_added(every.mapInArrow(sums, "sums binary"), size))
    scratch.drop(at)
    return model.slim()


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` with score, content_score, meta_score and kept."""
    scratch = scratch or Scratch(spark, "quality")
    added = ("score", "content_score", "meta_score", "kept")
    own = [x for x in docs.columns if x not in added]
    docs = docs.select(*own)
    looked = [F.col(name).cast(kind) if name in own else F.lit(None).cast(kind) for name, kind in zip(_LOOKED, ("string", "string", "string", "long"), strict=True)]
    helpers = private([*own, *added], *_LOOKED)
    model = fit_quality(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(x) for c, x in zip(looked, _LOOKED, strict=True))), labels, scratch)
    sent = spark.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(x, T.DoubleType()) for x in added[:3]), T.StructField("kept", T.BooleanType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores: list[list[np.ndarray]] = [[], [], []]
            for _, n, content, meta, words in _views(dict(zip(_LOOKED, batch.columns[len(own) :], strict=True))):
                got = sent.value.score(content, meta) if sent.value else (np.ones(n),) * 3
                for to, x in zip(scores, got, strict=True):
                    to.append(np.where(words > 0, x, 0.0))
            done = [np.concatenate(x) if x else np.zeros(0) for x in scores]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *map(pa.array, done), pa.array(done[0] >= threshold)], names=[*own, *added])
        release()

    return docs.withColumns(dict(zip(helpers, looked, strict=True))).select(*own, *helpers).mapInArrow(judge, schema)
