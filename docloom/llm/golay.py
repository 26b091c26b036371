"""The binary Golay code (23, 12, 7): nearest codewords of 23-bit words, built from its generator polynomial.

The code is perfect: each word lies within 3 bits of one codeword. A word at distance 3 lies at distance 4 from
five more, so two words that differ in up to 2 bits always have a codeword within 4 bits of both.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GENERATOR = 0b110001110101


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator polynomial: 11 bits."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - 11))
    return rest


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(error of up to 3 bits per syndrome; patterns that lead to the nearest and the next five codewords, -1 where none)."""
    errors = np.array([sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(23), n)], dtype=np.int64)
    nearest = np.zeros(2048, dtype=np.int64)
    nearest[syndromes(errors)] = errors
    messages = np.arange(4096, dtype=np.int64) << 11
    codewords = messages ^ syndromes(messages)
    sevens = codewords[np.bitwise_count(codewords) == 7]
    near = np.full((2048, 6), -1, dtype=np.int64)
    near[:, 0] = nearest
    for syndrome in np.flatnonzero(np.bitwise_count(nearest) == 3):
        error = nearest[syndrome]
        near[syndrome, 1:] = error ^ sevens[(sevens & error) == error]
    return nearest, near


def nearest_index(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the one codeword within 3 bits."""
    nearest, _ = tables()
    words = words.astype(np.int64)
    return (words ^ nearest[syndromes(words)]) >> 11


def near_indices(words: np.ndarray) -> np.ndarray:
    """Indices of all codewords within 4 bits: (n, 6), -1 where there are none."""
    _, near = tables()
    words = words.astype(np.int64)
    pattern = near[syndromes(words)]
    return np.where(pattern < 0, -1, (words[:, None] ^ pattern) >> 11)
