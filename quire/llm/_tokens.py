"""Words and shingles of Arrow text columns as numpy arrays, many texts at a time.

The bytes of a chunk of texts are scanned as one array. Word hashes come from running sums of a polynomial in the
bytes, so no Python object is made for a word. Chunks are bounded in bytes; a longer text is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_powers: dict[str, np.ndarray] = {}


def powers(n: int, base: int = int(_BASE)) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64, for i up to n."""
    have = _powers.get("up")
    if have is None or len(have) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            for name, b in (("up", base), ("down", inverse)):
                out = np.full(size, np.uint64(b))
                out[0] = 1
                _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of a chunk of texts: first byte and end in data, hash, and where each text's words begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    offsets: np.ndarray


def text_chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, end) of runs of rows whose texts have at most ``most`` bytes together, one row at least."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(sizes)))
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, side="right")) - 1)
        yield i, j
        i = j


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins in them; a null text has none."""
    texts = pa.compute.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, off - off[0]


def words(texts: pa.Array, lower: bool = True) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text, with A-Z in lower case unless told otherwise."""
    raw, off = raw_bytes(texts)
    data = _LOWER[raw] if lower else raw
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, np.uint64), np.zeros(len(off), np.int64))
    is_word = _WORD[data]
    first = np.zeros(n + 1, dtype=bool)
    first[off] = True  # a text's words never join those of the next
    before = np.concatenate(([False], is_word[:-1]))
    start = np.flatnonzero(is_word & (~before | first[:n]))
    after = np.concatenate((is_word[1:], [False]))
    end = np.flatnonzero(is_word & (~after | first[1:])) + 1
    up, down = powers(n)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n])))
        h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return Words(data, start, end, h, np.searchsorted(start, off))


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and where each text's begin.

    A text with fewer words than ``size``, but not none, has the whole sequence as its one shingle.
    """
    n, h = len(w.offsets) - 1, w.hash
    with np.errstate(over="ignore"):
        rolled = h[: max(0, len(h) - size + 1)] * np.uint64(3)
        for k in range(1, size):
            rolled = mix(rolled) + h[k : k + len(rolled)]
        rolled = mix(rolled)
    out, offsets = [], np.zeros(n + 1, np.int64)
    for i in range(n):
        a, b = int(w.offsets[i]), int(w.offsets[i + 1])
        if b - a >= size:
            x = np.sort(rolled[a : b - size + 1])
            x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif b > a:
            x = h[a : a + 1] * np.uint64(5) + np.uint64(b - a)
            for k in range(a + 1, b):
                x = mix(x) + h[k : k + 1]
            x = mix(x)
        else:
            x = h[:0]
        out.append(x)
        offsets[i + 1] = offsets[i] + len(x)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), offsets
