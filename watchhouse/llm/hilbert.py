"""Keys along a Hilbert curve for arrays of points (the transpose form published by Skilling, 2004), in numpy."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the curve of each row of ``cells`` (points x dimensions, integers of ``bits`` bits).

    dimensions * bits must be at most 63; the key is a signed 64-bit integer.
    """
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    bit = np.uint64(1 << (bits - 1))
    one = np.uint64(1)
    while bit > one:
        low = bit - one
        for d in range(dims):
            high = (x[d] & bit) != 0
            flip = (x[0] ^ x[d]) & low
            x[0] = np.where(high, x[0] ^ low, x[0] ^ flip)
            if d:
                x[d] = np.where(high, x[d], x[d] ^ flip)
        bit >>= one
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    twist = np.zeros_like(x[0])
    bit = np.uint64(1 << (bits - 1))
    while bit > one:
        twist = np.where((x[dims - 1] & bit) != 0, twist ^ (bit - one), twist)
        bit >>= one
    x ^= twist
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << one) | ((x[d] >> np.uint64(b)) & one)
    return key.astype(np.int64)
