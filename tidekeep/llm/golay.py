"""Fuzzy keys from the perfect binary Golay code [23, 12, 7].

keys(v) gives, for each 23-bit value, the indices of all codewords within distance four of it: one index where the
nearest codeword is at most two away, six where it is three away.  Two values that differ in at most two bits always
share an index: if one lies within two of its codeword, the other lies within four of the same; else both have six
codewords at distance three or four whose error patterns, with a parity bit, split the 24 places into tetrads, and
either flipped bits share a tetrad (then the other value would be within two of that codeword) or moving along one
tetrad keeps the distance.  The tests check it for every pair of bits.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GENERATOR, N, CHECK = 0b110001110101, 23, 11


def _remainder(values: np.ndarray) -> np.ndarray:
    out = values.astype(np.int64)
    for bit in range(N - 1, CHECK - 1, -1):
        out ^= np.where(out >> bit & 1, GENERATOR << (bit - CHECK), 0)
    return out


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 bits and of the high 11, and for each syndrome its error patterns of weight four at most."""
    errors = np.array([sum(1 << b for b in bits) for w in range(5) for bits in combinations(range(N), w)], dtype=np.int64)
    found = _remainder(errors)
    patterns = np.full((1 << CHECK, 6), -1, dtype=np.int64)
    order = np.argsort(found, kind="stable")
    of, start = np.unique(found[order], return_index=True)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    patterns[found[order], rank] = errors[order]
    assert len(of) == 1 << CHECK
    return _remainder(np.arange(1 << 12)), _remainder(np.arange(1 << 11) << 12), patterns


def keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, index): the index (12 bits) of every codeword within distance four, and the place of its value."""
    low, high, patterns = _tables()
    values = values.astype(np.int64)
    errors = patterns[low[values & 0xFFF] ^ high[values >> 12]]
    which, column = np.nonzero(errors >= 0)
    return which, (values[which] ^ errors[which, column]) >> CHECK
