"""The perfect binary Golay code (23, 12), as a fuzzy hash of short bit strings.

Every 23-bit word lies within three bits of exactly one of 4,096 codewords.
The index of that codeword is a word's key; the keys of the word and of all
its one-bit changes (six at most) are its fuzzy keys. Of two words that differ
in one bit or none, the key of either is among the fuzzy keys of the other.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

BITS = 23
#: Coefficients of the code's generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (fixed value).
GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    """Remainder of a word as polynomial by the generator: its syndrome."""
    for bit in range(BITS - 1, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the two halves of a word, and the error that each syndrome stands for."""
    single = [_remainder(1 << b) for b in range(BITS)]
    low, high = np.zeros(1 << 12, np.uint16), np.zeros(1 << 11, np.uint16)
    for b in range(12):
        low[1 << b : 2 << b] = low[: 1 << b] ^ single[b]
    for b in range(11):
        high[1 << b : 2 << b] = high[: 1 << b] ^ single[12 + b]
    errors = np.zeros(1 << 11, np.uint32)
    for weight in (1, 2, 3):
        for bits in combinations(range(BITS), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= single[b]
            errors[syndrome] = sum(1 << b for b in bits)
    return np.stack([low[: 1 << 11], low[1 << 11 :]]).reshape(-1), np.concatenate([high, errors])


def key(words: np.ndarray) -> np.ndarray:
    """Index (0 to 4095) of the codeword nearest to each word."""
    low, rest = _tables()
    high, errors = rest[: 1 << 11], rest[1 << 11 :]
    words = words.astype(np.uint32)
    nearest = words ^ errors[low[words & 0xFFF] ^ high[words >> np.uint32(12)]]
    return (nearest >> np.uint32(11)).astype(np.int64)  # the code is systematic in its upper bits


def fuzzy_keys(words: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Sorted keys of each word and of its one-bit changes in the lowest ``bits`` bits; repeats are -1."""
    changes = np.array([0, *(1 << b for b in range(bits))], np.uint32)
    keys = np.sort(key(words.astype(np.uint32)[:, None] ^ changes), axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = -1
    return keys
