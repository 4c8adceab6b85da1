"""Vectorised words and word windows over a block of texts."""

from __future__ import annotations

import numpy as np

from ._common import mixed

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Keys of independent hashes of the same bytes.
_SEEDS = mixed(np.arange(1, 5, dtype=np.uint64) * _STEP)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and for each text the number of its first word (one more than texts)."""
    visible = ~SPACE[data]
    begins = visible.copy()
    begins[1:] &= ~visible[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begins[edge] = visible[edge]
    ends = visible.copy()
    ends[:-1] &= ~visible[1:]
    edge = offsets[1:][offsets[1:] > 0] - 1
    ends[edge] = visible[edge]
    begin = np.flatnonzero(begins)
    return begin, np.flatnonzero(ends) + 1, np.searchsorted(begin, offsets)


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, under another seed an independent one of its bytes. Pieces of eight bytes are mixed, then each
    with its place, and summed: unlike a polynomial modulo 2^64, no pattern of bytes makes different words equal."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    length = end - begin
    pieces = (length + 7) >> 3
    first = np.cumsum(pieces) - pieces
    place = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
    at = np.repeat(begin, pieces) + 8 * place
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    piece = rows[at].view("<u8").reshape(-1)
    left = np.minimum(np.repeat(end, pieces) - at, 8).astype(np.uint64)
    piece = piece & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
    value = mixed(mixed(piece ^ _SEEDS[2 * seed]) + mixed(place.astype(np.uint64) ^ _SEEDS[2 * seed + 1]))
    return mixed(np.add.reduceat(value, first) ^ (length.astype(np.uint64) * _STEP))


def windows(word: np.ndarray, k: int, step: np.uint64 = _STEP) -> np.ndarray:
    """A hash of each k words in a row (k - 1 fewer than words; across texts too); another one for another odd step. Windows of
    powers of 2 are mixed from two halves, and a window from those that make up its length."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    held, have, out, done = word, 1, None, 0
    while True:
        if k & have:
            piece = held[done : done + n]
            out = piece if out is None else mixed(out * step + piece)
            done += have
        if 2 * have > k:
            return mixed(out)
        held = mixed(held[:-have] * step + held[have:])
        have *= 2


def starts(first: np.ndarray, k: int) -> np.ndarray:
    """For each word at which k words of one text begin, its number."""
    n = np.diff(first) - k + 1
    n = np.maximum(n, 0)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)
