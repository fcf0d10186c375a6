"""Hashes of words and word shingles of whole texts, many texts at once, on numpy arrays.

A word is a run of anything but ASCII white space, A-Z in lower case. The hash of a word of up to 16 bytes
mixes its bytes, all of them, as two numbers; a longer word's is its 64-bit xxh3. Equal words have equal
hashes in every process.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import regex
import xxhash

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_OTHER = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_PLACES = np.array([xxhash.xxh64_intdigest(bytes([i]), 23) | 1 for i in range(64)], dtype=_U)
_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def word_hashes(data: bytes, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the first byte of every word; ``between`` marks the bytes that part words."""
    data = data.translate(_LOWER)
    apart = between[np.frombuffer(data + b" ", dtype=np.uint8)]
    firsts = np.flatnonzero(~apart & np.concatenate([[True], apart[:-1]]))
    sizes = np.flatnonzero(apart & np.concatenate([[False], ~apart[:-1]])) - firsts
    if not len(firsts):
        return np.zeros(0, dtype=_U), firsts
    eight = np.ndarray(len(data) + 9, dtype="<u8", buffer=data + b"\0" * 16, strides=(1,))  # the eight bytes from each byte on
    low = eight[firsts] & _BYTES[np.minimum(sizes, 8)]
    high = eight[np.minimum(firsts + 8, len(data))] & _BYTES[np.clip(sizes - 8, 0, 8)]
    hashes = mix(mix(mix(low + sizes.astype(_U) * _PLACES[0]) * _PLACES[1] + high))
    for k in np.flatnonzero(sizes > 16).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(data[firsts[k] : firsts[k] + sizes[k]])
    return hashes, firsts


@cache
def _marks() -> regex.Pattern:
    return regex.compile(r"[[\p{P}\p{S}\p{Z}\p{Cc}]--[\x00-\x7F]]", regex.V1)


def _letters(text: str) -> str:
    """Lower case, with spaces for punctuation, symbols and white space beyond ASCII."""
    text = text.lower()
    return text if text.isascii() else _marks().sub(" ", text)


def texts_words(texts: list[str | None], *, letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after another, and the index at which each text's begin (and the end).

    With ``letters``, words are runs of letters, digits and marks of any script, without regard to case.
    """
    if letters:
        texts = [_letters(x or "") for x in texts]
    coded = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    hashes, firsts = word_hashes(b"\n".join(coded), _OTHER if letters else _SPACE)
    sizes = np.array([len(x) + 1 for x in coded], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    return hashes, np.searchsorted(firsts, begins)


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a shorter text's whole sequence is its only shingle."""
    hashes, at = texts_words(texts)
    n = max(len(hashes) - words + 1, 0)
    rolled = np.zeros(n, dtype=_U)
    for k in range(words):
        rolled += hashes[k : k + n] * _PLACES[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            few = hashes[a:b] * _PLACES[32 : 32 + b - a]
            out.append(mix(np.array([few.sum(dtype=_U) + _U(b - a)], dtype=_U)))
        else:
            out.append(np.zeros(0, dtype=_U))
    return out
