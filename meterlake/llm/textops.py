"""Words, shingles and windows of a batch of texts as arrays: one pass of numpy over the bytes of an Arrow column.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D; no byte of a longer UTF-8 sequence is
one of these, so bytes and code points give the same words.  Words, and sequences of them, are known by
64-bit hashes; where a wrong match would change a result, callers use two independent ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are hashed at once, and bytes of text that callers should put in a batch.
PIECE, BATCH_BYTES = 1 << 20, 1 << 21

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_SPACE] = 0
_LOWER = _BYTE.copy()
_LOWER[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_P, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


class Words(NamedTuple):
    """Of all texts, one after another: hash, first byte, byte after the last, number of the text."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit (splitmix64's finish)."""
    h = h + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _P, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each text begins (one more entry: the end). Null counts as empty."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, off, data = texts.buffers()
    at = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(texts) else np.empty(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def words(raw: np.ndarray, at: np.ndarray, lower: bool = False) -> Words:
    if not len(raw):
        none = np.empty(0, np.int64)
        return Words(np.empty(0, np.uint64), none, none, none)
    inside = ~_SPACE[raw]
    first = np.zeros(len(raw), dtype=bool)  # a text begins here
    first[at[:-1][at[:-1] < len(raw)]] = True
    begins = inside & (first | np.concatenate(([True], ~inside[:-1])))
    ends = inside & np.concatenate((first[1:] | ~inside[1:], [True]))
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(at, start, side="right") - 1
    if not len(start):
        return Words(np.empty(0, np.uint64), start, end, doc)
    values, out = _LOWER if lower else _BYTE, np.empty(len(start), dtype=np.uint64)
    longest = int((end - start).max())
    power = _powers(longest)
    k = 0
    while k < len(start):  # pieces of whole words
        n = max(k + 1, int(np.searchsorted(end, start[k] + PIECE, side="right")))
        a, b = start[k], end[n - 1]
        place = np.arange(a, b) - np.repeat(start[k:n], np.diff(np.append(start[k:n], b)))
        v = values[raw[a:b]] * power[np.minimum(place, longest - 1)]  # spaces have value 0
        out[k:n] = np.add.reduceat(v, start[k:n] - a)
        k = n
    return Words(mix(out), start, end, doc)


def runs(w: Words, k: int, seed: int = 0) -> np.ndarray:
    """Hash of the k words from each word on; those that leave their text are to be masked by ``whole``."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, np.uint64(seed * 2 + 1))
    for j in range(k):
        h = h * _M + (w.hash[j : j + n] if not seed else mix(w.hash[j : j + n], seed))
    return mix(h, seed)


def whole(w: Words, k: int) -> np.ndarray:
    n = len(w.hash) - k + 1
    return w.doc[:n] == w.doc[k - 1 :] if n > 0 else np.empty(0, dtype=bool)


def shingles(w: Words, n_docs: int, k: int = 5, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all k-word shingles, with repeats; a text of fewer words is one shingle, without words none."""
    ok = whole(w, k)
    h, doc = runs(w, k, seed)[ok], w.doc[: len(ok)][ok]
    count = np.bincount(w.doc, minlength=n_docs)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.searchsorted(w.doc, short)
        extra = np.empty(len(short), dtype=np.uint64)
        for i, (d, f) in enumerate(zip(short, first)):
            part = w.hash[f : f + count[d]]
            v = np.uint64(seed * 2 + 1)
            with np.errstate(over="ignore"):
                for x in part if not seed else mix(part, seed):
                    v = v * _M + x
            extra[i] = v ^ np.uint64(count[d])
        h, doc = np.concatenate((h, mix(extra, seed + 17))), np.concatenate((doc, short))
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    return h, doc


def distinct(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Each (hash, text) once, in order of text and hash."""
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.uint16) if n_docs < 1 << 16 else doc[order], kind="stable")]  # 16 bits are sorted by radix
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def slices(at: np.ndarray, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes; one longer text is a range of its own."""
    a, n = 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = b
