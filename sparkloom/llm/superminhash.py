"""SuperMinHash signatures, computed for all elements of a block together."""

from __future__ import annotations

import numpy as np

from .blocks import U, mix

_SHIFT = U(48)


def signatures(elements: np.ndarray, offsets: np.ndarray, m: int) -> np.ndarray:
    """One row of ``m`` 16-bit values per set; equal values mark equal minima.

    Round ``j`` gives every element the value ``j + r`` with ``r`` in [0, 1) for
    slot ``p[j]`` of the element's own random permutation, so the values of one
    element are ranks of a permutation and not independent.  A set is finished
    once each of its slots holds less than the next round can give.
    """
    n_sets = len(offsets) - 1
    table = np.full(n_sets * m, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(n_sets, dtype=np.int64), np.diff(offsets))
    swaps: list[np.ndarray] = []
    e = elements
    for j in range(m):
        if not len(e):
            break
        with np.errstate(over="ignore"):
            r = mix(e ^ U(0xD6E8FEB86659FD93 * (j + 1) & (2**64 - 1)))
            k = (mix(r + U(0xA0761D6478BD642F)) >> U(33)).astype(np.int64) % (m - j) + j
        # What stands in slot k after the element's swaps (t, k_t), t < j, on the identity.
        slot = k.copy()
        for t in range(j - 1, -1, -1):
            slot[slot == swaps[t]] = t
        swaps.append(k)
        np.minimum.at(table, owner * m + slot, (U(j) << _SHIFT) | (r >> U(16)))
        if j + 1 == m:
            break
        todo = table.reshape(n_sets, m).max(axis=1) >= (U(j + 1) << _SHIFT)
        keep = todo[owner]
        if not keep.all():
            e, owner = e[keep], owner[keep]
            swaps = [s[keep] for s in swaps]
    return (mix(table.reshape(n_sets, m)) >> _SHIFT).astype(np.uint16)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key per band of ``rows`` values; the band's place is part of the key."""
    n, m = sig.shape
    bands = m // rows
    part = sig[:, : bands * rows].reshape(n, bands, rows).astype(np.uint64)
    key = np.zeros((n, bands), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = mix(key * U(0x9E3779B97F4A7C15) + part[:, :, r] + U(1))
        return mix(key + np.arange(bands, dtype=np.uint64)[None, :] * U(0xC2B2AE3D27D4EB4F)).astype(np.int64)
