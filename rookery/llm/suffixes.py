"""Suffix-array dedup of byte strings: every byte under a 200-byte string that starts twice goes.

Suffixes are sampled by content: of each REACH places in a row, the one with the
least hash of its next bytes. A repeated string has its first sample at the same
offset in all copies, so samples whose next BASE bytes occur once need no more. The
others are a sparse suffix array: each batch sorts its own, sends them front-coded
to the range of the alphabet that they fall in, and there a loser tree merges the
runs by known common prefixes. Suffixes that share BASE bytes or more stand together
in the merged order; what their left and right contexts share decides, for each
offset, which strings of LENGTH bytes repeat.

Whole copies are one text until the end. Where more than HOT suffixes share their
next bytes, no task may get the group that grows with the corpus: its strings are
dealt to all buckets and counted there by 128 bits of their content.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import ANSWERED, ASKED, NO_ID, Batch, answered, answers, ask, buckets_of, distinct, each, folded, held_bytes, named_as, pack, restored, restored_schema, rows_of, squeezed, unpacked, with_answers
from ._common import cut, mixed

LENGTH = 200
#: Places among which one suffix is sampled; offsets of a string before its sample are below it and fit a 64-bit mask.
REACH = 64
#: Bytes that a string has from its sample on, at least.
BASE = LENGTH - REACH + 1
#: Suffixes merged as one group, at most.
HOT = 1_024
#: Groups up to so many suffixes are compared in pairs; in larger ones a hash finds equal strings, whose bytes are then compared.
FEW = 8
#: Bits of the hash that tells places apart; two places of a string are taken for one with probability 2 ** (1 - STAND).
STAND = 58
BATCH = 1 << 20
#: Suffixes of a batch that help to give the borders of the ranges, and for each range; borders only balance the work.
SPLIT, PER_RANGE = 512, 8
REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary, kept binary"


FIRST, OTHER = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def doubled(data: np.ndarray, start: np.ndarray | None, n: int, to: int, step: int = FIRST) -> np.ndarray:
    """At each place, a hash of the next to bytes, from that of the next n; fewer at the end. Another odd step gives another
    hash."""
    h = mixed(np.arange(1, 257, dtype=np.uint64) ^ np.uint64(step - FIRST & 0xFFFFFFFF))[data] if start is None else start
    while n < to:
        h[:-n] = h[:-n] * np.uint64((step * (2 * n + 1)) % (1 << 64)) + h[n:] if len(h) > n else h[:-n]
        n *= 2
    return h


class Samples:
    """start: places at which LENGTH bytes of one text begin. place: the distinct samples, ascending; number: of each start's
    sample. next: the hash of a sample's next BASE bytes."""

    def __init__(self, own: Batch):
        n = np.maximum(np.diff(own.offsets) - LENGTH + 1, 0)
        self.start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(own.offsets[:-1], n)
        self.own = own
        if not len(self.start):
            self.place, self.number, self.next, self.hash = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            return
        h = doubled(own.data, None, 1, 16)
        key = (mixed(h) >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
        n = 1
        while n < REACH:
            key[:-n] = np.minimum(key[:-n], key[n:])
            n *= 2
        at = (key[self.start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        del key
        fresh = np.ones(len(at), bool)
        fresh[1:] = at[1:] != at[:-1]
        self.place, self.number = at[fresh], np.cumsum(fresh) - 1
        self.hash = doubled(own.data, h, 16, 128)
        self.next = mixed(self.hash[self.place] * np.uint64(3) + self.hash[self.place + BASE - 128])

    def keys(self, drop: int) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.next >> np.uint64(drop) << np.uint64(drop), return_inverse=True)

    def occurrence(self, group: np.ndarray, n: int) -> np.ndarray:
        """For each of n distinct hashes: the least power of 2 that its number of samples doesn't exceed, above STAND bits, and
        below them a hash of where they stand in which text, or 0 if they differ in that; whole copies of a text don't."""
        doc = np.searchsorted(self.own.offsets, self.place, "right") - 1
        text = np.frombuffer(self.own.extra, np.uint64).reshape(-1, 4)[doc, 0]
        stand = (mixed(text + (self.place - self.own.offsets[doc]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - STAND)) | np.uint64(1)
        low, high = np.full(n, np.iinfo(np.uint64).max), np.zeros(n, np.uint64)
        np.minimum.at(low, group, stand)
        np.maximum.at(high, group, stand)
        power = np.ceil(np.log2(np.maximum(np.bincount(group, minlength=n), 1))).astype(np.uint64)
        return np.where(low == high, low, np.uint64(0)) | (power << np.uint64(STAND))

    def strings(self, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts under hot samples, their distinct strings as two hashes and how often each is there, and the number of each
        start's string."""
        start = self.start[hot[self.number]]
        if not len(start):
            return start, np.zeros(0, np.uint64), np.zeros(0, np.uint64), start, start
        second = doubled(self.own.data, None, 1, 128, OTHER)
        keys, other = (mixed(h[start] * np.uint64(5) + h[start + LENGTH - 128]) for h in (self.hash, second))
        first, group, count = distinct(keys, other)
        return start, keys[first], other[first], count, group

    def run(self, warm: np.ndarray) -> list[tuple[bytes, bytes, int]]:
        """(suffix, its left context backwards, number of the sample) for the warm samples, sorted."""
        data, offsets = self.own.data.tobytes(), self.own.offsets
        number = np.flatnonzero(warm)
        place = self.place[number]
        doc = np.searchsorted(offsets, place, "right") - 1
        out = [(data[p : min(p + LENGTH, e)], data[max(b, p - REACH + 1) : p][::-1], i) for p, b, e, i in zip(place.tolist(), offsets[doc].tolist(), offsets[doc + 1].tolist(), number.tolist(), strict=True)]
        out.sort()
        return out


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, known to be at least at."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[at:n], "little") ^ int.from_bytes(b[at:n], "little")
    return at + ((x & -x).bit_length() - 1 >> 3) if x else n


def front_coded(run: list[tuple[bytes, bytes, int]]) -> bytes:
    """Each suffix as what it shares with the one before and the rest, and its left context."""
    shared, rest, left, last = [], [], [], b""
    for suffix, before, _ in run:
        n = common(last, suffix)
        shared.append(n)
        rest.append(suffix[n:])
        left.append(before)
        last = suffix
    sizes = np.array([shared, [len(x) for x in rest], [len(x) for x in left]], np.uint8)
    return len(run).to_bytes(4, "little") + zstandard.ZstdCompressor(3).compress(sizes.tobytes() + b"".join(rest) + b"".join(left))


def decoded(blob: bytes) -> tuple[list[int], list[bytes], list[bytes]]:
    """Common prefixes, suffixes and left contexts of a run."""
    n = int.from_bytes(blob[:4], "little")
    raw = zstandard.ZstdDecompressor().decompress(blob[4:])
    shared, rest, left = (list(raw[i * n : (i + 1) * n]) for i in range(3))
    at, suffixes, last = 3 * n, [], b""
    for same, more in zip(shared, rest, strict=True):
        last = last[:same] + raw[at : at + more]
        suffixes.append(last)
        at += more
    befores = []
    for more in left:
        befores.append(raw[at : at + more])
        at += more
    return shared, suffixes, befores


def merged(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, int]]:
    """(run, place in it, prefix common with the suffix before) of all suffixes in order, by a tree of losers. Each
    contender knows the prefix that it shares with the last winner it met: a longer one comes first unseen, and equal
    ones are compared only beyond it."""
    size = 1
    while size < len(runs):
        size *= 2
    end = len(runs)
    head = [0] * len(runs)
    known = [0] * len(runs)  # prefix common with the last suffix that went out past it
    done = [not r[1] for r in runs]

    def beats(a: int, b: int) -> bool:
        """Settles a against b; the loser's known prefix becomes that with the winner."""
        if a >= end or done[a]:
            return False
        if b >= end or done[b]:
            return True
        p, q = known[a], known[b]
        if p != q:
            return p > q
        x, y = runs[a][1][head[a]], runs[b][1][head[b]]
        n = common(x, y, p)
        if x[n : n + 1] <= y[n : n + 1]:
            known[b] = n
            return True
        known[a] = n
        return False

    def play(node: int) -> int:
        if node >= size:
            return node - size
        a, b = play(2 * node), play(2 * node + 1)
        won, lost = (a, b) if beats(a, b) else (b, a)
        loser[node] = lost
        return won

    loser = [end] * size
    top = play(1)
    while top < end and not done[top]:
        yield top, head[top], known[top]
        head[top] += 1
        done[top] = head[top] == len(runs[top][1])
        if not done[top]:
            known[top] = runs[top][0][head[top]]
        node = (top + size) // 2
        while node:
            if beats(loser[node], top):
                loser[node], top = top, loser[node]
            node //= 2


def group_masks(suffixes: list[bytes], befores: list[bytes], prefixes: list[int]) -> list[int]:
    """For each suffix of a group, bit o is set if the LENGTH bytes from o before it occur elsewhere in the group.
    prefixes: common with the suffix before, in order. What is alike on both sides is looked at once."""
    number: dict[tuple[bytes, bytes], int] = {}
    kind, first, shared, least = [], [], [], LENGTH
    for i, key in enumerate(zip(suffixes, befores, strict=True)):
        least = min(least, prefixes[i])
        if key not in number:
            number[key] = len(first)
            first.append(i)
            shared.append(least)
            least = LENGTH
        kind.append(number[key])
    masks = distinct_masks([suffixes[i] for i in first], [befores[i] for i in first], shared) if len(first) > 1 else [0]
    count = np.bincount(kind).tolist()
    for k, i in enumerate(first):
        if count[k] > 1:  # its own copies: whatever it is long enough for
            low, high = max(0, LENGTH - len(suffixes[i])), len(befores[i])
            masks[k] |= (1 << high + 1) - (1 << low) if high >= low else 0
    return [masks[k] for k in kind]


def distinct_masks(suffixes: list[bytes], befores: list[bytes], prefixes: list[int]) -> list[int]:
    n = len(suffixes)
    masks = [0] * n
    if n <= FEW:
        for i in range(n):
            right = LENGTH
            for j in range(i + 1, n):
                right = min(right, prefixes[j])
                left = common(befores[i], befores[j])
                if left >= LENGTH - right:
                    held = (1 << left + 1) - (1 << LENGTH - right)
                    masks[i] |= held
                    masks[j] |= held
        return masks
    text = np.zeros((n, REACH - 1 + LENGTH), np.uint8)
    low, high = np.array([len(b) for b in befores]), np.array([len(s) for s in suffixes])
    for i, (s, b) in enumerate(zip(suffixes, befores, strict=True)):
        text[i, REACH - 1 - len(b) : REACH - 1] = np.frombuffer(b[::-1], np.uint8)
        text[i, REACH - 1 : REACH - 1 + len(s)] = np.frombuffer(s, np.uint8)
    h = np.ascontiguousarray(mixed(np.arange(1, 257, dtype=np.uint64))[text].T)
    k = 1
    while k < 128:
        h = h[:-k] * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64)) + h[k:]
        k *= 2
    found = np.zeros(n, np.uint64)
    for o in range(REACH):
        at = REACH - 1 - o
        fit = np.flatnonzero((low >= o) & (high >= LENGTH - o))
        if len(fit) > 1:
            _, first, group, count = np.unique(mixed(h[at, fit] * np.uint64(5) + h[at + LENGTH - 128, fit]), return_index=True, return_inverse=True, return_counts=True)
            many = np.flatnonzero(count[group] > 1)
            string = text[:, at : at + LENGTH]
            if (string[fit[many]] != string[fit[first[group[many]]]]).any():  # a hash took different strings for equal
                _, group, count = np.unique(np.ascontiguousarray(string[fit]).view(f"V{LENGTH}").ravel(), return_inverse=True, return_counts=True)
            found[fit[count[group] > 1]] |= np.uint64(1 << o)
    return found.tolist()


def merge(table: pa.Table) -> pa.Table:
    """The masks of all suffixes of one range, by batch and in the order in which it sent them."""
    batches = table.column("batch").to_pylist()
    held = [decoded(b) for b in table.column("blob").to_pylist()]
    masks = [np.zeros(len(h[1]), np.uint64) for h in held]
    group: list[tuple[int, int]] = []
    prefixes: list[int] = []

    def settle() -> None:
        if len(group) > 1:
            for (r, i), mask in zip(group, group_masks([held[r][1][i] for r, i in group], [held[r][2][i] for r, i in group], prefixes), strict=True):
                masks[r][i] = mask

    for r, i, prefix in merged([h[:2] for h in held]):
        if prefix < BASE:
            settle()
            group, prefixes = [], []
        group.append((r, i))
        prefixes.append(prefix)
    settle()
    bucket = table.column("bucket")[0].as_py()
    return pa.Table.from_batches([rows_of(ANSWERED, [(b, bucket, squeezed(m)) for b, m in zip(batches, masks, strict=True)])])


def text_digests(own: Batch) -> bytes:
    whole = own.data.tobytes()
    return b"".join(hashlib.sha256(whole[a:b]).digest() for a, b in zip(own.offsets[:-1].tolist(), own.offsets[1:].tolist(), strict=True))


def often(limit: int):
    """0 for a hash that stands in one place of one text, 2 for one that may have more than limit samples (each batch counts
    them up to a power of 2), else 1. Values as from Samples.occurrence."""

    def fold(group: np.ndarray, value: np.ndarray) -> np.ndarray:
        n = int(group.max()) + 1
        stand = value & np.uint64((1 << STAND) - 1)
        low, high = np.full(n, np.iinfo(np.uint64).max), np.zeros(n, np.uint64)
        np.minimum.at(low, group, stand)
        np.maximum.at(high, group, stand)
        twice = (low != high) | (low == 0)
        total = np.bincount(group, np.exp2((value >> np.uint64(STAND)).astype(np.float64)))
        return (twice.astype(np.uint64) * np.where(total > limit, 2, 1).astype(np.uint64))[group]

    return fold


def twice(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """1 for a string that occurs more than once."""
    return (np.bincount(group, value.astype(np.float64)) > 1).astype(np.uint64)[group]


def borders(packed: DataFrame, ranges: int) -> list[bytes]:
    """Suffixes between ranges, from PER_RANGE for each (24 bytes each). Their batches are chosen by number first, so that no
    texts are sorted."""
    found: list[bytes] = []
    many = max(32, -(-PER_RANGE * ranges // SPLIT))
    chosen = [r["batch"] for r in packed.select("batch").orderBy(F.xxhash64("batch"), "batch").limit(many).collect()]
    for row in packed.where(F.col("batch").isin(chosen)).mapInArrow(_sampled, "suffix binary").collect():
        found.append(bytes(row[0]))
    found.sort()
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in each(batches):
        own = unpacked(row)
        samples = Samples(own)
        chosen = samples.place[np.argsort(samples.next)[:SPLIT]]
        data = own.data.tobytes()
        yield rows_of("suffix binary", [(data[p : p + 24],) for p in chosen.tolist()])


def remove(docs: DataFrame, hot: int = HOT, texts: bool = True, rows: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans (removed runs), kept_sha256, spans (pairs of
    64-bit offsets of removed runs, from and to) and, if texts is set, kept (the remaining bytes). With rows set, docs
    with its columns and the remaining text instead, without bytes of characters that were cut through.

    Texts are UTF-8 bytes, null ones empty. A byte goes if LENGTH bytes of its text that cover it also start anywhere
    else, in the same or another row, first occurrences too. Rows with one doc_id are texts of their own; a null doc_id
    stays null. An empty table gives an empty one. Only doc_id and text are read.
    """
    packed = pack(docs, text_digests, BATCH, rows)
    size = held_bytes(packed)
    buckets = buckets_of(docs.sparkSession, size)

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch, n, extra in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch)), pa.array(np.arange(n, dtype=np.int32)), pa.array([extra[32 * i : 32 * i + 32] for i in range(n)], pa.binary())], ["batch", "place", "digest"])

    same = packed.select("batch", "n", "extra").mapInArrow(texts_of, "batch long, place int, digest binary")
    same = same.groupBy("digest").agg(F.min(F.struct("batch", "place")).alias("r"), F.count("*").alias("copies"))
    # the places of a batch's texts that stand for their copies: n without others, -1 - n with
    chosen = same.select(F.col("r.batch").alias("batch"), F.when(F.col("copies") == 1, F.col("r.place")).otherwise(-1 - F.col("r.place")).alias("p"))
    chosen = packed.select("batch").join(chosen.groupBy("batch").agg(F.collect_list("p").alias("places")), "batch", "left")
    flags = cut(chosen).withColumn("kind", F.lit(0))

    def own_texts(own: Batch, rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """Which texts stand for their copies, and which of all are copies of others."""
        stands, alone = np.zeros(len(own.ids), bool), np.zeros(len(own.ids), bool)
        for p in (p for r in rows for p in (r["places"] or ())):
            stands[p if p >= 0 else -1 - p] = True
            alone[p if p >= 0 else -1 - p] = p >= 0
        return stands, ~alone

    drop = 64 - min(64, max(32, int(size).bit_length() + 10))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(batches):
            samples = Samples(own := unpacked(row))
            keys, group = samples.keys(drop)
            yield ask(own.batch, keys, samples.occurrence(group, len(keys)), buckets, drop)

    counts = cut(answers(packed.mapInArrow(send, ASKED), often(hot), drop)).withColumn("kind", F.lit(1))
    at = borders(packed, buckets)

    def known(own: Batch, got: list[list[dict]]):
        stands, copied = own_texts(own, got[0])
        samples = Samples(own)
        step = answered(got[1])[samples.keys(drop)[1]] if len(samples.place) else np.zeros(0, np.uint64)
        # copies are left out: the text that stands for them has the same
        return samples, step * stands[np.searchsorted(own.offsets, samples.place, "right") - 1], copied

    def ranged(run: list[tuple[bytes, bytes, int]]) -> list[tuple[int, list[tuple[bytes, bytes, int]]]]:
        parts: dict[int, list] = {}
        for x in run:
            parts.setdefault(bisect_right(at, x[0][:24]), []).append(x)
        return sorted(parts.items())

    def sort(own: Batch, got: list[list[dict]]) -> Iterator[pa.RecordBatch]:
        samples, step, _ = known(own, got)
        yield rows_of(ASKED + ", kind int", [(k, own.batch, front_coded(part), 2) for k, part in ranged(samples.run(step == 1))])
        _, keys, other, count, _ = samples.strings(step == 2)
        asked = ask(own.batch, keys, count, buckets, second=other)
        yield pa.RecordBatch.from_arrays([*asked.columns, pa.array(np.full(asked.num_rows, 3), pa.int32())], [*asked.schema.names, "kind"])

    first = flags.unionByName(counts, allowMissingColumns=True)
    sent = with_answers(packed, first, sort, ASKED + ", kind int", 2)
    count_strings = folded(twice)

    def settle(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        got = merge(table) if kind == 2 else count_strings(table)
        return got.append_column("kind", pa.array(np.full(got.num_rows, kind), pa.int32()))

    settled = sent.groupBy("bucket", "kind").applyInArrow(settle, ANSWERED + ", kind int")

    def drop_bytes(own: Batch, got: list[list[dict]]) -> Iterator[pa.RecordBatch]:
        samples, step, copied = known(own, got)
        edge = np.zeros(len(own.data) + 1, np.int32)
        if len(samples.place):
            mask = np.zeros(len(samples.place), np.uint64)
            order = [x[2] for _, part in ranged(samples.run(step == 1)) for x in part]
            mask[order] = answered(got[2])
            offset = (samples.place[samples.number] - samples.start).astype(np.uint64)
            found = [samples.start[mask[samples.number] >> offset & np.uint64(1) > 0]]
            start, _, _, _, group = samples.strings(step == 2)
            if len(start):
                found.append(start[answered(got[3])[group] > 0])
            for s in found:
                edge[: len(own.data)] += np.bincount(s, minlength=len(own.data)).astype(np.int32)
                edge[: len(own.data) + 1] -= np.bincount(s + LENGTH, minlength=len(own.data) + 1).astype(np.int32)
        gone = np.cumsum(edge[:-1]) > 0
        whole, out, left = own.data, [], []
        for k in range(len(own.ids)):
            a, b = int(own.offsets[k]), int(own.offsets[k + 1])
            mine = gone[a:b]
            if copied[k] and b - a >= LENGTH:
                mine = np.ones(b - a, bool)
            kept = whole[a:b][~mine].tobytes()
            if rows:
                left.append(kept)
                continue
            turns = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0)).astype("<i8")
            out.append((None if own.ids[k] == NO_ID else int(own.ids[k]), b - a, int(mine.sum()), len(turns) // 2, hashlib.sha256(kept).hexdigest(), turns.tobytes(), kept if texts else None))
        yield restored(own, np.ones(len(own.ids), bool), left) if rows else rows_of(REMOVED, out)

    got = first.unionByName(settled, allowMissingColumns=True)
    done = with_answers(packed, got, drop_bytes, restored_schema(docs) if rows else REMOVED, 4)
    return named_as(done, docs) if rows else done
