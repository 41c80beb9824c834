"""Words and their 64-bit hashes, for whole Arrow batches of texts at once.

A word is a maximal run of bytes outside the ASCII white space ``\\x20
\\x09-\\x0D``; A-Z count as a-z. Everything runs on the UTF-8 buffer of a slice,
so that no Python object is made for a word. A slice holds at most
``SLICE_BYTES`` of text, or one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: Powers are kept for slices up to this size.
CACHED_BYTES = 4 << 20
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters and digits of ASCII, and all bytes of longer characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _S30)
    x = x * _M1
    x ^= x >> _S27
    x = x * _M2
    x ^= x >> _S31
    return x


_G = mix(LOWER.astype(np.uint64) + np.uint64(0x51F15EED))
_powers: dict[str, np.ndarray] = {}


def power(which: str, n: int) -> np.ndarray:
    """Powers 0 to n - 1 at least of the base ('r') or its inverse ('i')."""
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        out = np.full(size, _R if which == "r" else _RINV, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if size > CACHED_BYTES + 1:
            return out
        _powers[which] = have = out
    return have


@dataclass
class Words:
    """hash: of each word; doc: words before each text (n + 1 values); start and
    end: of each word in ``data``, the slice's bytes; at: the text's first byte."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    at: np.ndarray

    def text(self, k: int) -> str:
        return bytes(LOWER[self.data[self.start[k] : self.end[k]]]).decode()


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, start of each text and the end) of slices
    that follow each other; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def split(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> Words:
    """The words of one slice; ``space`` tells the bytes between words."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(at), np.int64), none, none, data, at)
    gap = space[data]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = gap[:-1]
    first[at[:-1][at[:-1] < n]] = True
    first &= ~gap
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = gap[1:]
    inner = at[1:]
    last[inner[inner > 0] - 1] = True
    last &= ~gap
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_G[data] * power("r", n)[:n], out=total[1:])
    h = mix((total[end] - total[start]) * power("i", n)[start])
    return Words(h, np.searchsorted(start, at), start, end, data, at)


def words(texts: pa.Array, most: int = SLICE_BYTES, space: np.ndarray = SPACE) -> Iterator[tuple[int, Words]]:
    """(index of the first text, words) of each slice."""
    for i, data, at in slices(texts, most):
        yield i, split(data, at, space)
