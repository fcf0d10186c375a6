"""Token ids of whole texts by the tokenizers library, with the ids of pieces kept between texts.

A byte-level BPE merges only inside its pre-tokens, so a text's ids are those of any pieces that end where
pre-tokens end. Such places are: before a single space between other characters, between a Latin letter
and ASCII punctuation, and round a single line feed between other characters. They are found on the bytes
of an Arrow column; Arrow numbers the pieces, each distinct piece is looked up in a bounded dictionary,
and the library encodes those that are new. White space of any other kind is never cut at.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
#: Pieces in each of two generations of a dictionary, if its user doesn't say.
GENERATION, _PIECES_AT_ONCE = 340_000, 4096
_SPACE, _BLANK, _LETTER, _STOP, _FEED = 1, 2, 4, 8, 16
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[:33] = _KIND[127] = _BLANK
_KIND[32] |= _SPACE
_KIND[10] |= _FEED
for _k in range(33, 127):
    _KIND[_k] = _LETTER if chr(_k).isalpha() else 0 if chr(_k).isdigit() else _STOP


def default_path() -> str:
    return public_tokenizers.path(DEFAULT_VOCABULARY)


def _wide_blanks(raw: np.ndarray, solid: np.ndarray) -> None:
    """Takes white space and control characters of two and three bytes out of ``solid``."""
    two = np.flatnonzero(raw[:-1] == 0xC2)
    two = two[raw[two + 1] <= 0xA0]
    three = np.flatnonzero((raw[:-2] >= 0xE1) & (raw[:-2] <= 0xE3))
    first, second, third = raw[three], raw[three + 1], raw[three + 2]
    general = (first == 0xE2) & (((second == 0x80) & ((third <= 0x8F) | (third >= 0xA8))) | (second == 0x81))
    three = three[general | ((first == 0xE1) & (second == 0x9A)) | ((first == 0xE3) & (second == 0x80) & (third == 0x80))]
    for at in (two, two + 1, three, three + 1, three + 2):
        solid[at] = False


def _begins(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The first byte of every piece of texts that lie one after another between ``bounds``."""
    kind = _KIND[raw]
    solid = (kind & _BLANK) == 0
    latin = np.zeros(len(raw), dtype=bool)
    if (raw >= 0x80).any():
        _wide_blanks(raw, solid)
        latin[1:] = (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    firsts, lasts = bounds[:-1][np.diff(bounds) > 0], bounds[1:][np.diff(bounds) > 0] - 1
    around = np.zeros(len(raw), dtype=bool)
    around[1:-1] = solid[:-2] & solid[2:]
    around[firsts] = around[lasts] = False
    feeds = np.flatnonzero(around & ((kind & _FEED) != 0))
    begin = around & ((kind & _SPACE) != 0)
    begin[1:] |= ((kind[1:] & _STOP) != 0) & (((kind[:-1] & _LETTER) != 0) | latin[:-1])
    begin[feeds] = begin[feeds + 1] = begin[firsts] = True
    return np.flatnonzero(begin)


class _Generation:
    """Numbered pieces and their ids, one after another."""

    def __init__(self, dtype: np.dtype) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.ends = np.zeros(1 << 16, dtype=dtype), np.zeros(1 << 14, dtype=np.int64)

    def get(self, pieces: list[str]) -> np.ndarray:
        """Their numbers; -1 for those that aren't here."""
        return np.fromiter(map(self.number.get, pieces, repeat(-1)), np.int64, len(pieces))

    def add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        count = len(self.number)
        used = int(self.ends[count])
        while len(self.ids) < used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.ends) <= count + len(pieces):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[used : used + len(ids)] = ids
        self.ends[count + 1 : count + 1 + len(pieces)] = used + np.cumsum(sizes)
        self.number.update(zip(pieces, range(count, count + len(pieces)), strict=True))

    def gather(self, numbers: np.ndarray, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces ``numbers[of]`` one after another, and each one's size."""
        firsts, sizes = self.ends[numbers], self.ends[numbers + 1] - self.ends[numbers]
        if of is not None:
            firsts, sizes = firsts[of], sizes[of]
        ends = np.cumsum(sizes)
        where = np.repeat((firsts - ends + sizes).astype(np.int32), sizes)
        where += np.arange(len(where), dtype=np.int32)
        return self.ids[where], sizes


class TextEncoder:
    """Encodes texts; special tokens' strings in a text are ordinary text. Null counts as empty."""

    def __init__(self, path: str, generation: int = GENERATION) -> None:
        self.generation = generation
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.size = self.library.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.starts_with_space = np.zeros(self.size, dtype=bool)
        self.feed = -1
        for word, i in self.library.get_vocab().items():
            self.starts_with_space[i] = word.startswith("Ġ")
            self.feed = i if word == "Ċ" else self.feed
        self.now, self.older = _Generation(self.dtype), _Generation(self.dtype)

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype=self.dtype) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Adds pieces. Many are encoded in one string, which is cut where a space begins an id or at line feeds."""
        spaced, lines, rest = [], [], []
        for x in pieces:
            (spaced if x[0] == " " and x[1:].split() == [x[1:]] else lines if x.split() == [x] else rest).append(x)
        for some in (spaced[at : at + _PIECES_AT_ONCE] for at in range(0, len(spaced), _PIECES_AT_ONCE)):
            whole = self._batch(["".join(some)])[0]
            begins = np.flatnonzero(self.starts_with_space[whole])
            if len(begins) == len(some):
                self.now.add(some, whole, np.diff(begins, append=len(whole)))
            else:  # a vocabulary that marks spaces otherwise
                rest += some
        for some in (lines[at : at + _PIECES_AT_ONCE] for at in range(0, len(lines), _PIECES_AT_ONCE)):
            whole = self._batch(["\n".join(some)])[0]
            feeds = whole == self.feed
            if int(feeds.sum()) == len(some) - 1:
                self.now.add(some, whole[~feeds], np.diff(np.flatnonzero(feeds), prepend=-1, append=len(whole)) - 1)
            else:
                rest += some
        for some in (rest[at : at + _PIECES_AT_ONCE] for at in range(0, len(rest), _PIECES_AT_ONCE)):
            ids = self._batch(some)
            self.now.add(some, np.concatenate(ids), np.array([len(x) for x in ids]))

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        if len(self.now.number) > self.generation:
            self.older, self.now = self.now, _Generation(self.dtype)
        numbers = self.now.get(pieces)
        if len(gaps := np.flatnonzero(numbers < 0)):
            unknown = [pieces[i] for i in gaps.tolist()]
            old = self.older.get(unknown)
            if len(known := np.flatnonzero(old >= 0)):
                self.now.add([unknown[i] for i in known.tolist()], *self.older.gather(old[known]))
            self._learn([unknown[i] for i in np.flatnonzero(old < 0).tolist()])
            numbers[gaps] = self.now.get(unknown)
        return numbers

    def encode_flat(self, column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's end."""
        column = column.cast(pa.string())
        if column.null_count:
            column = pc.fill_null(column, "")
        bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        if bounds[-1] == bounds[0]:
            return np.zeros(0, dtype=self.dtype), np.zeros(len(column), dtype=np.int64)
        data = column.buffers()[2].slice(int(bounds[0]), int(bounds[-1] - bounds[0]))
        bounds = bounds - bounds[0]
        begins = _begins(np.frombuffer(data, np.uint8), bounds)
        offsets = np.append(begins, bounds[-1]).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), data).dictionary_encode()
        numbers = self._numbers(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids, sizes = self.now.gather(numbers, pieces.indices.to_numpy())
        return ids, np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(begins, bounds[1:])]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, ends = self.encode_flat(pa.array(texts, pa.string()))
        return np.split(ids, ends[:-1]) if texts else []


@lru_cache(maxsize=2)
def encoder(path: str, generation: int = GENERATION) -> TextEncoder:
    """One for each Python worker and vocabulary."""
    return TextEncoder(path, generation)


def release() -> None:
    """Gives memory that a task has freed back to the system: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text, and where each text's end then."""
    ends = ends + np.arange(1, len(ends) + 1)
    out = np.empty(len(ids) + len(ends), dtype=ids.dtype)
    own = np.ones(len(out), dtype=bool)
    own[ends - 1] = False
    out[own] = ids
    out[ends - 1] = end_id
    return out, ends


def parts(batch: pa.RecordBatch, column: str, most_rows: int = 4096, most_bytes: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold at most ``most_bytes``, or a single longer text."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        before = int(ends[at] - sizes[at])
        to = min(max(int(np.searchsorted(ends, before + most_bytes, "right")), at + 1), at + most_rows)
        yield batch.slice(at, min(to, batch.num_rows) - at)
        at = to


def slices(column, most_rows: int = 2048, most_chars: int = 1 << 21) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of an Arrow string column, in slices that bound memory."""
    first, texts, chars = 0, [], 0
    for row, value in enumerate(column):
        text = value.as_py()
        texts.append(text)
        chars += len(text or "")
        if len(texts) >= most_rows or chars >= most_chars:
            yield first, texts
            first, texts, chars = row + 1, [], 0
    if texts:
        yield first, texts
