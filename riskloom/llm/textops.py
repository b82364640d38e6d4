"""Vectorised work on the bytes of texts: word hashes, word shingles, polynomial hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd: has an inverse modulo 2^64
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PIECE = 1 << 20  # bytes handled at once

_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**i (or its inverse) for i below n, modulo 2^64."""
    key = "inverse" if inverse else "base"
    have = _powers.get(key)
    if have is None or len(have) < n:
        m = 1 << max(16, (n - 1).bit_length())  # as long texts come; a worker that sees short ones stays small
        a = np.full(m, BASE_INVERSE if inverse else BASE, U)
        a[0] = 1
        have = _powers[key] = np.multiply.accumulate(a)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, valid) of an Arrow string column, without copies where it has one chunk."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if n and buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data, offsets, ~column.is_null().to_numpy(zero_copy_only=False)


def word_hashes(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of one text, in order; works in pieces that end at white space."""
    out, at, n = [], 0, len(text)
    while at < n:
        end = min(n, at + PIECE)
        if end < n:
            gaps = np.flatnonzero(SPACE[text[at:end]])
            while not len(gaps) and end < n:  # one word longer than a piece
                end = min(n, end + PIECE)
                gaps = np.flatnonzero(SPACE[text[at:end]])
            if end < n:
                end = at + int(gaps[-1]) + 1
        part = text[at:end]
        word = ~SPACE[part]
        edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros(len(part) + 1, U)
        np.cumsum((part.astype(U) + U(1)) * powers(len(part))[: len(part)], out=total[1:])
        out.append(mix((total[last] - total[first]) * powers(len(part), True)[first] + (last - first).astype(U)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, U)


def shingles(text: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text in lower case (A-Z); fewer words: one of them all; no word: none."""
    w = word_hashes(LOWER[text])
    if not len(w):
        return w
    if len(w) < k:
        return mix(_short(w))
    s = np.zeros(len(w) - k + 1, U)
    for i in range(k):
        s += w[i : len(w) - k + 1 + i] * powers(k + 2)[i + 1]
    return np.unique(mix(s))


def _short(w: np.ndarray) -> np.ndarray:
    return np.array([(w * powers(len(w) + 2)[1 : len(w) + 1]).sum(dtype=U) + U(len(w))], U)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums p with p[j] - p[i] the polynomial hash of data[i:j] times BASE**i."""
    p = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(len(data) + 1)[: len(data)], out=p[1:])
    return p


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (p[end] - p[start]) * powers(len(p), True)[start]
