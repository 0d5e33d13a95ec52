"""The perfect binary Golay code (23, 12, 7) as fuzzy hash keys.

Every 23-bit word lies within distance 3 of exactly one of 4096 codewords.  A
word at distance 3 also has five codewords at distance 4 (the weight-7 codewords
over its three error places), so each word decodes to one or six 12-bit indices.
Two words at distance 2 or less always share an index: the codeword nearest to a
word half-way is within distance 4 of both.
"""

from __future__ import annotations

import itertools

import numpy as np

BITS, MESSAGE, CHECK = 23, 12, 11
GENERATOR = 0xC75


def _mod(x: int) -> int:
    for i in range(BITS - 1, CHECK - 1, -1):
        if x >> i & 1:
            x ^= GENERATOR << (i - CHECK)
    return x


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    unit = [_mod(1 << i) for i in range(BITS)]
    low = np.zeros(1 << 12, np.int32)
    high = np.zeros(1 << 11, np.int32)
    for i in range(12):
        low[(np.arange(1 << 12) >> i & 1) == 1] ^= unit[i]
    for i in range(11):
        high[(np.arange(1 << 11) >> i & 1) == 1] ^= unit[12 + i]
    words = np.array([m << CHECK | _mod(m << CHECK) for m in range(1 << MESSAGE)], np.int64)
    weight = np.array([bin(w).count("1") for w in words])
    heavy = words[weight == 7]
    masks = np.zeros((1 << CHECK, 6), np.int32)
    count = np.ones(1 << CHECK, np.int32)
    for r in range(4):
        for places in itertools.combinations(range(BITS), r):
            syndrome = pattern = 0
            for p in places:
                syndrome ^= unit[p]
                pattern |= 1 << p
            near = [0] if r < 3 else [0, *(int(w) for w in heavy[(heavy & pattern) == pattern])]
            masks[syndrome, : len(near)] = [(pattern ^ w) >> CHECK for w in near]
            count[syndrome] = len(near)
    return low, high, masks, count


LOW, HIGH, MASKS, COUNT = _tables()


def indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the six slots of codeword indices, and how many of them hold (1 or 6)."""
    words = words.astype(np.int64)
    syndrome = LOW[words & 0xFFF] ^ HIGH[words >> 12]
    return (words >> CHECK)[:, None] ^ MASKS[syndrome], COUNT[syndrome]
