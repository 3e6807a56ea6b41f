"""Vectorised word and line hashing over blocks of texts.

Blocks are runs of whole documents of about ``BLOCK_BYTES``; a longer document
is a block of its own.  Hashes are polynomials over a random byte table,
modulo 2**64 and mixed, computed for all words of a block at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
U = np.uint64

#: ASCII white space, as the contracts write it: [\x20\x09-\x0D].
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose outputs look independent."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""
    x = x ^ (x >> U(31)) ^ (x >> U(62))
    x = x * U(0x319642B2D24D8EC3)
    x = x ^ (x >> U(27)) ^ (x >> U(54))
    x = x * U(0x96DE1B173F119089)
    return x ^ (x >> U(30)) ^ (x >> U(60))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` pseudo-random 64-bit numbers that depend on ``seed`` only."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(seed))


BYTES = stream(11, 256)
_BASE = U(0x2545F4914F6CDD1D)


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = U(1)
    return np.cumprod(out, dtype=np.uint64)


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first row, end row, bytes, offsets)``; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        yield row, end, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of ``data[starts[i]:ends[i]]`` for non-empty, disjoint, ordered segments."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    rel = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(first, lens)
    idx = rel + np.repeat(starts, lens)
    table, base = (BYTES, _BASE) if not seed else (stream(1000 + seed, 256), U(int(stream(2000 + seed, 1)[0]) | 5))
    with np.errstate(over="ignore"):
        v = table[data[idx]] * powers(int(lens.max()), base)[rel]
        return mix(np.add.reduceat(v, first) + lens.astype(np.uint64))


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, and each document's first word."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = ~WHITE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    inner = off[(off > 0) & (off < len(data))]
    start[inner] = word[inner]
    end = word.copy()
    end[:-1] &= ~word[1:]
    end[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the A-Z-lower-cased words of a block, and each document's first word."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, off)
    return segment_hashes(low, starts, ends), first


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``k``-word shingles of every document, concatenated, and offsets.

    A document with 1 to k-1 words has its whole sequence as one shingle; one
    without words has none.
    """
    h, first = word_hashes(data, off)
    weights = stream(77, k) | U(1)
    with np.errstate(over="ignore"):
        n = max(0, len(h) - k + 1)
        grams = np.zeros(n, np.uint64)
        for j in range(k):
            grams += h[j : j + n] * weights[j]
        grams = mix(grams)
        sets, sizes = [], np.zeros(len(off), np.int64)
        for d in range(len(off) - 1):
            a, b = first[d], first[d + 1]
            if b - a >= k:
                s = np.unique(grams[a : b - k + 1])
            elif b > a:
                s = mix((h[a:b] * weights[: b - a]).sum(dtype=np.uint64, keepdims=True) + U(b - a))
            else:
                continue
            sets.append(s)
            sizes[d + 1] = len(s)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.cumsum(sizes)
