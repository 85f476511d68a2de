"""Fast similarity sketching and the exact similarity of sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .kernels import mix64, random_words

COORDINATES, BAND = 288, 6
BANDS = COORDINATES // BAND
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)
_SEED = random_words(2 * COORDINATES, 11)
_MULTIPLY = random_words(COORDINATES, 12).reshape(BANDS, BAND) | np.uint64(1)
_WHICH = random_words(BANDS, 13)
#: Elements hashed at a time: enough to fill the coordinates in one go, nearly always.
_AT_ONCE = 4096


def fast_sketch(members: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """The sketch of a set, not empty: coordinate b holds the least (round, value) placed in bin b.

    In each of the first t rounds every member is hashed to one bin; in each of the next t rounds
    to one given bin, so that every coordinate fills. Rounds are hashed a block at a time: a later
    round never beats an earlier one, so those beyond the first that fills all bins change nothing.
    """
    out = np.full(t, _EMPTY)
    block = max(1, _AT_ONCE // len(members))
    for first in range(0, t, block):
        rounds = np.arange(first, min(t, first + block), dtype=np.uint64)
        h = mix64(members[None, :] ^ _SEED[rounds.astype(np.int64)][:, None])
        bins = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        np.minimum.at(out, bins.astype(np.int64).ravel(), ((h & _LOW) | (rounds << np.uint64(32))[:, None]).ravel())
        if not (out == _EMPTY).any():
            return out
    for b in np.flatnonzero(out == _EMPTY).tolist():
        h = mix64(members ^ _SEED[t + b])
        out[b] = (np.uint64(t + b) << np.uint64(32)) | (h & _LOW).min()
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of a sketch; keys of different bands differ."""
    return mix64((mix64(sketch).reshape(BANDS, BAND) * _MULTIPLY).sum(axis=1) + _WHICH)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending arrays of distinct numbers."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


PARITY_BITS = 2048


def parity_sketch(members: np.ndarray) -> np.ndarray:
    """An odd sketch: bit b is the parity of the number of members hashed to b (32 longs).

    The bits in which two sketches differ are at most the members in which the sets differ, so they
    prove sets unlike, whatever the sets' sizes, and never sets alike.
    """
    slot = (mix64(members ^ _SEED[0]) >> np.uint64(64 - 11)).astype(np.int64)
    odd = (np.bincount(slot, minlength=PARITY_BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)
