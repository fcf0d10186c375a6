"""Licence scan: units of text against templates by the Dice coefficient of their word bigrams.

Units are a document's whole text, its paragraphs, its lines, its sentences and its runs of consecutive
lines (so of paragraphs too), normalised: lower case,
letters and digits alone, copyright lines dropped. A template meets only the units whose number of
bigrams lies within the bounds that the threshold puts on sizes, and that hold one of its anchors: words
chosen so that a unit without any of them shares too few bigrams. A run is a unit only if enough of its
bigrams are in any template. Neither bound loses a match. A run whose first or last line has no bigram in
any template is no unit either: it is less similar than the run without that line. Of the
templates that a unit reaches, the most similar names its licence; of overlapping units, the most
similar stays.

Templates are a fixed set of the package. Null or empty text matches nothing. A unit of one word has no
bigram. Very long texts are scanned whole. Of templates equally similar, the first by name counts. All columns
of the documents stay, whatever their names, but one named licences, which is replaced; repeated rows are
scanned one by one. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kinweave.llm.license_texts import TEMPLATES

LEAST_DICE = 0.8
_WORD = re.compile(r"[^\W_]+")
_COPYRIGHT = re.compile(r"^[^\w\n]*(?:copyright|\(c\)|©)[^\n]*\d{4}[^\n]*$", re.IGNORECASE | re.MULTILINE)
_PARAGRAPH, _LINE, _SENTENCE = re.compile(r"\n[^\S\n]*\n"), re.compile(r"\n"), re.compile(r"(?<=[.!?])\s+|\n")
LICENCES = T.ArrayType(T.StructType([T.StructField("licence", T.StringType()), T.StructField("dice", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW = pa.list_(pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
#: Words that make poor anchors.
_COMMON = frozenset("a an and any are as at be by for from in is it its may no not of on or that the this to under use with you 0 1 2 3 4 version work".split())


def bigrams(text: str) -> Counter:
    words = _WORD.findall(_COPYRIGHT.sub("", text).lower())
    return Counter(zip(words, words[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    if len(a) > len(b):
        a, b = b, a
    total = a.total() + b.total()
    return 2 * sum(min(n, b[x]) for x, n in a.items() if x in b) / total if total else 0.0


class Templates:
    """Templates by size, with anchors."""

    def __init__(self, texts: dict[str, tuple[str, ...]] = TEMPLATES, least: float = LEAST_DICE) -> None:
        self.least = least
        grams = [(bigrams(t), name) for name, all_texts in texts.items() for t in all_texts]
        self.entries = sorted(((g.total(), name, g, self._anchors(g)) for g, name in grams if g), key=lambda x: (x[0], x[1], sorted(x[2])))
        self.sizes = [x[0] for x in self.entries]
        self.grams = frozenset().union(*(x[2] for x in self.entries)) if self.entries else frozenset()
        self.anchors = frozenset().union(*(x[3] for x in self.entries)) if self.entries else frozenset()

    def _anchors(self, grams: Counter) -> frozenset[str]:
        m = grams.total()
        missing = m - math.ceil(self.least * m / (2 - self.least) - 1e-9) + 1
        rest, chosen = Counter(grams), set()
        while missing > 0:
            cover = Counter()
            for gram, n in rest.items():
                for word in set(gram):
                    cover[word] += n
            best = max(cover, key=lambda w: (w not in _COMMON, cover[w], len(w), w))
            chosen.add(best)
            missing -= cover[best]
            rest = Counter({g: n for g, n in rest.items() if best not in g})
        return frozenset(chosen)

    def _within(self, n: int) -> range:
        """Templates whose size a unit of n bigrams may match."""
        t = self.least
        return range(bisect_left(self.sizes, n * t / (2 - t) - 1e-9), bisect_right(self.sizes, n * (2 - t) / t + 1e-9))

    def best(self, unit: str) -> tuple[float, str] | None:
        words = _WORD.findall(unit.lower())
        noted = _COPYRIGHT.search(unit)
        if self.anchors.isdisjoint(words) or not (noted or self._within(len(words) - 1)):
            return None
        grams = bigrams(unit) if noted else Counter(zip(words, words[1:], strict=False))
        found = None
        for k in self._within(grams.total()):
            _, name, template, anchors = self.entries[k]
            if not anchors.isdisjoint(words):
                got = dice(grams, template)
                if got >= self.least and (found is None or (got, found[1]) > (found[0], name)):
                    found = (got, name)
        return found

    def runs(self, text: str) -> list[tuple[int, int]]:
        """Runs of two lines or more that may match a template, whatever stands between them."""
        lines, words, at = [], [], 0
        dropped = [m.span() for m in _COPYRIGHT.finditer(text)]
        for m in [*_LINE.finditer(text), None]:
            end = m.start() if m else len(text)
            while dropped and dropped[0][1] <= at:
                dropped.pop(0)
            own = [] if dropped and dropped[0][0] < end else _WORD.findall(text[at:end].lower())
            if own:
                lines.append((at, end, len(words), len(words) + len(own)))
                words += own
            at = end + 1
        hits = [0]
        for gram in zip(words, words[1:], strict=False):
            hits.append(hits[-1] + (gram in self.grams))
        if not hits[-1] or len(lines) < 2:
            return []
        t = self.least
        share, most = t / (2 - t), self.sizes[-1] * (2 - t) / t + 1e-9
        useful = [hits[min(b, len(hits) - 1)] > hits[max(a - 1, 0)] for _, _, a, b in lines]
        out = []
        for i, (start, _, a, _) in enumerate(lines):
            if useful[i]:
                for j in range(i + 1, len(lines)):
                    b = lines[j][3]
                    if b - 1 - a > most:
                        break
                    if useful[j] and hits[b - 1] - hits[a] >= share * (b - 1 - a) - 1e-9:
                        out.append((start, lines[j][1]))
        return out

    def scan(self, text: str | None) -> list[dict]:
        """The most similar matches that don't overlap, by place."""
        if not text:
            return []
        if self.anchors.isdisjoint(_WORD.findall(text.lower())):
            return []
        units = {(0, len(text))}
        for cut in (_PARAGRAPH, _LINE, _SENTENCE):
            at = 0
            for m in cut.finditer(text):
                units.add((at, m.start()))
                at = m.end()
            units.add((at, len(text)))
        units.update(self.runs(text))
        found = [(-got[0], a, b, got[1]) for a, b in units if b > a and (got := self.best(text[a:b]))]
        out: list[dict] = []
        for minus, a, b, name in sorted(found, key=lambda x: (x[0], x[1] - x[2], x[1])):
            if all(b <= x["start"] or a >= x["end"] for x in out):
                out.append({"licence": name, "dice": -minus, "start": a, "end": b})
        return sorted(out, key=lambda x: x["start"])


def scan_licences(docs: DataFrame, texts: dict[str, tuple[str, ...]] = TEMPLATES, *, least: float = LEAST_DICE) -> DataFrame:
    """The rows of ``docs`` with ``licences``: what matches, how well, and where by code point."""
    kept = [x for x in docs.columns if x != "licences"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(texts, least)
        for batch in batches:
            found = [templates.scan(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), pa.array(found, _ARROW)], names=[*kept, "licences"])

    return docs.select(*kept).mapInArrow(scan, T.StructType([*(docs.schema[x] for x in kept), T.StructField("licences", LICENCES)]))
