"""Substring dedup over words with fixed-block anchors.

Blocks of ANCHOR words in a row, one after another in each text, are the
reference; every rolling window of ANCHOR words probes them. A window of WINDOW
words holds a whole block wherever it begins, so where no probe hits, nothing
repeats. Windows around hits extend them to maximal repeats: each is looked up by
two independent 64-bit hashes of its bytes (texts stay with their batches, and are
not compared byte by byte), the earliest stays, and words covered by a later one go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _words
from ._batches import ASKED, NO_ID, Batch, answered, answers, ask, buckets_of, distinct, each, held_bytes, pack, rows_of, union_kinds, unpacked, with_answers
from ._common import cut

WINDOW = 20
#: Any WINDOW words in a row hold a whole block: 2 * ANCHOR - 1 is at most WINDOW.
ANCHOR = 10
#: The step of a window's second hash, which is made from second hashes of its words.
OTHER = np.uint64(0xD1342543DE82EF95)
REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans binary, kept binary"


def kept_bits(words: int) -> int:
    """Bits of an anchor's hash that are sent: enough that one in thousands of windows is looked up in vain."""
    return min(64, max(32, int(words).bit_length() + 13))


class Probes:
    """The rolling windows of a batch, their distinct hashes, and which begin a reference block."""

    def __init__(self, own: Batch, bits: int):
        self.begin, self.end, self.first = _words.spans(own.data, own.offsets)
        self.word = _words.hashes(own.data, self.begin, self.end)
        self.data = own.data
        self.drop = 64 - bits
        self.at = _words.starts(self.first, ANCHOR)
        hashed = _words.windows(self.word, ANCHOR)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        self.keys, self.group = np.unique(hashed >> np.uint64(self.drop) << np.uint64(self.drop), return_inverse=True)

    def values(self) -> np.ndarray:
        """Occurrences in two steps (1, more) and reference blocks among them (0 or more): 1, 2, 5, 6."""
        offset = self.at - self.first[np.searchsorted(self.first, self.at, "right") - 1]
        blocks = np.bincount(self.group, offset % ANCHOR == 0, len(self.keys)) > 0
        return np.minimum(np.bincount(self.group, minlength=len(self.keys)), 2) + 4 * blocks

    def near(self, hit: np.ndarray) -> np.ndarray:
        """Starts of windows that hold the start of a hit and the whole anchor after it. hit: for each distinct hash."""
        found = np.zeros(len(self.word) + 1, np.int64)
        found[self.at] = hit[self.group]
        total = np.concatenate([[0], np.cumsum(found)])
        at = _words.starts(self.first, WINDOW)
        return at[total[at + WINDOW - ANCHOR + 1] > total[at]] if len(at) else at

    def candidates(self, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of windows around hits, their distinct contents as two hashes, the number of each one's content, and the first
        start of each content."""
        at = self.near(hit)
        if not len(at):
            return at, np.zeros(0, np.uint64), np.zeros(0, np.uint64), at, at
        keys, other = _words.windows(self.word, WINDOW)[at], _words.windows(_words.hashes(self.data, self.begin, self.end, 1), WINDOW, OTHER)[at]
        first, group, _ = distinct(keys, other)
        return at, keys[first], other[first], group, at[first]


def repeated(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """1 for hashes that occur twice or more, in a reference block at least once."""
    n = int(group.max()) + 1
    return ((np.bincount(group, value.astype(np.int64) & 3, n) >= 2) & (np.bincount(group, value.astype(np.int64) >> 2, n) > 0)).astype(np.uint64)[group]


def later(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """1 where another batch has the hash in a smaller document. value: the least doc_id of the batch with it, made unsigned."""
    least = np.full(int(group.max()) + 1, np.iinfo(np.uint64).max)
    np.minimum.at(least, group, value)
    return (value > least[group]).astype(np.uint64)


def unsigned(ids: np.ndarray) -> np.ndarray:
    return ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def remove(docs: DataFrame, texts: bool = True) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_sha256, spans (pairs of 32-bit word numbers, from
    and to, of what goes) and, if texts is set, kept (what stays, joined by one blank, UTF-8; else null).

    A word goes if a window that covers it also starts earlier: in a smaller doc_id, or earlier in the same document.
    A null doc_id counts as the largest. Rows with one doc_id are copies of one document: equal windows at their first
    place in them stay. Null, empty and short texts keep all words; an empty table gives an empty one. Only doc_id and
    text are read.
    """
    spark = docs.sparkSession
    packed = pack(docs)
    size = held_bytes(packed)
    buckets = buckets_of(spark, size)
    bits = kept_bits(size)  # of the order of the number of words

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(batches):
            probes = Probes(own := unpacked(row), bits)
            yield ask(own.batch, probes.keys, probes.values(), buckets, probes.drop)

    hits = cut(answers(packed.mapInArrow(probe, ASKED), repeated, 64 - bits))

    def extend(own: Batch, got: list[list[dict]]) -> Iterator[pa.RecordBatch]:
        probes = Probes(own, bits)
        _, keys, other, _, first = probes.candidates(answered(got[0]))
        doc = np.searchsorted(probes.first, first, "right") - 1
        yield ask(own.batch, keys, unsigned(own.ids)[doc], buckets, second=other)

    owners = answers(with_answers(packed, hits, extend, ASKED), later)

    def drop(own: Batch, got: list[list[dict]]) -> Iterator[pa.RecordBatch]:
        probes = Probes(own, bits)
        at, _, _, group, first = probes.candidates(answered(got[0]))
        there = answered(got[1]).astype(bool)
        # the first place of a hash stays if no other batch has it in a smaller document; so do the same places of rows with the same doc_id
        going = there[group] | (at != first[group])
        if len(at) and (own.ids[1:] == own.ids[:-1]).any():
            doc, one = np.searchsorted(probes.first, at, "right") - 1, np.searchsorted(probes.first, first, "right") - 1
            same = (own.ids[doc] == own.ids[one[group]]) & (at - probes.first[doc] == (first - probes.first[one])[group])
            going = there[group] | ~same
        edge = np.zeros(len(probes.word) + WINDOW + 1, np.int64)
        np.add.at(edge, at[going], 1)
        np.add.at(edge, at[going] + WINDOW, -1)
        gone = np.cumsum(edge)[: len(probes.word)] > 0
        whole, rows = own.data.tobytes(), []
        begin, end = probes.begin.tolist(), probes.end.tolist()
        for k in range(len(own.ids)):
            a, b = int(probes.first[k]), int(probes.first[k + 1])
            mine = gone[a:b]
            stay = (np.flatnonzero(~mine) + a).tolist()
            kept = b" ".join([whole[begin[i] : end[i]] for i in stay])
            turns = np.flatnonzero(np.diff(np.concatenate([[0], mine, [0]]))).astype("<i4")
            rows.append((None if own.ids[k] == NO_ID else int(own.ids[k]), b - a, int(mine.sum()), hashlib.sha256(kept).hexdigest(), turns.tobytes(), kept if texts else None))
        yield rows_of(REMOVED, rows)

    return with_answers(packed, union_kinds(hits, owners), drop, REMOVED, 2)
