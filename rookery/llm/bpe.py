"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash cuts texts into chunks at content-defined places, so documents
that share a passage share chunks, wherever it stands. Documents are dealt so
that those sharing content meet, and each partition encodes a shared chunk once,
from the first to the last place in it that no surrounding text can change. A join
is repaired by encoding again what lies between two such places around it, with
one piece more on either side: where that piece comes out as the chunks have it,
both sides agree; where it doesn't, the join grows by the next chunk.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import blocks, mixed, utf8

#: A chunk ends where the hash of the last 16 bytes has its lowest bits zero; on average so many bytes apart.
MEAN = 1024
LEAST, MOST = 256, 8192
#: Bytes of chunks that a partition keeps; beyond it the dictionary starts anew, which costs time only.
KEPT_BYTES = 48 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(2)
def codec(path: str):
    """(encode(text) to ids, bytes of each id) of a byte-level BPE in the tokenizers library's format. The merge loop
    is tiktoken's, over the same vocabulary: a merge's rank is the id that it makes."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    model, before = held["model"], held["pre_tokenizer"]
    if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or held["normalizer"]:
        raise ValueError("not a byte-level BPE without normaliser and prefix blank")
    # the visible character that stands for each byte: printable Latin-1 for itself, others from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    special = {x["content"]: x["id"] for x in held["added_tokens"]}
    if any(not x.isascii() or any(c.isspace() for c in x) for x in special):
        raise ValueError("special tokens with white space or other characters than ASCII")
    ranks = {bytes(shown[c] for c in word): i for word, i in model["vocab"].items() if word not in special}
    pair = lambda m: "".join(m) if isinstance(m, list) else m.replace(" ", "")
    made = [model["vocab"][pair(m)] for m in model["merges"]]
    if made != sorted(made):
        raise ValueError("merges are not in the order of their ids")
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    coder = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    words = [b""] * (max([*ranks.values(), *special.values()]) + 1)
    for word, i in [*ranks.items(), *((k.encode(), i) for k, i in special.items())]:
        words[i] = word
    return lambda text: coder.encode_to_numpy(text, allowed_special="all"), words


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
VISIBLE = np.zeros(256, bool)
VISIBLE[33:127] = True


def rolling(data: np.ndarray) -> np.ndarray:
    """At each place, a hash of the 16 bytes that end there, by doubling; the first 15 places get 1."""
    h = mixed(np.arange(1, 257, dtype=np.uint64))[data]
    for i, n in enumerate((1, 2, 4, 8)):
        h[n:] = h[:-n] * np.uint64((0x9E3779B97F4A7C15 * (2 * i + 3)) % (1 << 64) | 1) + h[n:]
    h[:15] = 1
    return h >> np.uint64(40)


def chunk_ends(data: np.ndarray, offsets: np.ndarray, mean: int = MEAN) -> list[list[int]]:
    """For each text in data, where its chunks end; never inside a character, at least LEAST and at most MOST bytes apart."""
    hashes = rolling(data) if len(data) > 16 else np.ones(len(data), np.uint64)
    at = np.flatnonzero(hashes % np.uint64(mean) == 0) + 1
    at = at[(at < len(data)) & ((data[np.minimum(at, len(data) - 1)] & 0xC0) != 0x80)]
    found, ends = at.tolist(), []
    low = np.searchsorted(at, offsets[:-1] + 16)
    for k, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        own, last, i = [], begin, int(low[k])
        while end - last > LEAST:
            while i < len(found) and found[i] < last + LEAST:
                i += 1
            to = found[i] if i < len(found) else end
            if to > last + MOST:
                to = last + MOST
                while to < end and data[to] & 0xC0 == 0x80:
                    to -= 1
            if to >= end:
                break
            own.append(to)
            last = to
        ends.append([*own, end])
    return ends


# The characters with Unicode's property White_Space outside ASCII.
BLANKS = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
LETTER, NUMBER, BLANK, MARK = 1, 2, 3, 4


@lru_cache(1)
def kinds() -> np.ndarray:
    """LETTER, NUMBER, BLANK, MARK (punctuation and symbols) or 0 (unknown) of the 16-bit characters: what Unicode 3.2 and
    today's agree on, so that no other version differs."""
    out = np.zeros(1 << 16, np.uint8)
    named = {"L": LETTER, "N": NUMBER, "P": MARK, "S": MARK}
    for i in range(1 << 16):
        old, new = unicodedata.ucd_3_2_0.category(chr(i))[0], unicodedata.category(chr(i))[0]
        out[i] = named.get(old, 0) if old == new else 0
    out[[*range(9, 14), 32, *BLANKS]] = BLANK
    return out


def firm(chunk: bytes) -> list[int]:
    """The places at which every encoding of a text with this chunk has a border, as no word piece has what stands before
    and what follows: white space after another character; and, where one of both is beyond ASCII (special tokens aren't),
    a letter or number before another kind, or a mark before a number."""
    b = np.frombuffer(chunk, np.uint8)
    if not (b & 0x80).any():
        return (np.flatnonzero(SPACE[b[1:]] & VISIBLE[b[:-1]]) + 1).tolist()
    c = np.frombuffer(chunk.decode().encode("utf-32-le"), np.uint32)
    kind = np.where(c < 1 << 16, kinds()[np.minimum(c, 0xFFFF)], 0)
    before, after, wide = kind[:-1], kind[1:], (c[:-1] > 127) | (c[1:] > 127)
    border = (after == BLANK) & (before != BLANK) & (before != 0)
    other = wide & (after != 0) & (before != after)
    border |= other & ((before == LETTER) | (before == NUMBER) | ((before == MARK) & (after == NUMBER)))
    begin = np.flatnonzero((b & 0xC0) != 0x80)
    return begin[1:][border].tolist()


class Chunk(NamedTuple):
    """first, last: firm places, with the encoding ids between them. head and tail: the first and last piece between two such
    places, as bytes and ids."""

    first: int
    last: int
    ids: np.ndarray
    head: bytes
    head_ids: np.ndarray
    tail: bytes
    tail_ids: np.ndarray


NONE = np.zeros(0, np.uint32)


class Reuse:
    """Encodes texts chunk by chunk, each distinct chunk once while it is kept."""

    def __init__(self, encode: Callable[[str], np.ndarray]):
        self.encode, self.kept, self.held, self.hits, self.chunks, self.grown = encode, {}, 0, 0, 0, 0

    def ids(self, piece: bytes) -> np.ndarray:
        return self.encode(piece.decode()).astype(np.uint32) if piece else NONE

    def chunk(self, chunk: bytes) -> Chunk | None:
        self.chunks += 1
        if chunk in self.kept:
            self.hits += 1
            return self.kept[chunk]
        places, got = firm(chunk), None
        if places:
            second, before = places[min(1, len(places) - 1)], places[max(0, len(places) - 2)]
            head, middle, tail = chunk[places[0] : second], chunk[second : max(second, before)], chunk[max(second, before) : places[-1]]
            parts = [self.ids(x) for x in (head, middle, tail)]
            got = Chunk(places[0], places[-1], np.concatenate(parts), head, parts[0], *((tail, parts[2]) if tail else (head, parts[0])))
        if self.held > KEPT_BYTES:
            self.kept, self.held = {}, 0
        self.kept[chunk] = got
        self.held += len(chunk) + (4 * len(got.ids) if got else 0)
        return got

    def text(self, text: bytes, ends: list[int], begin: int) -> np.ndarray:
        """ends: of the chunks, counted from where the text has begin."""
        ids, join, at = [], b"", 0
        tail, tail_ids = b"", NONE
        for end in ends:
            chunk, at = text[at : end - begin], end - begin
            if (got := self.chunk(chunk)) is None:
                join += chunk
                continue
            mended = self.ids(tail + join + chunk[: got.first] + got.head)
            to = len(mended) - len(got.head_ids)
            if to >= len(tail_ids) and np.array_equal(mended[: len(tail_ids)], tail_ids) and np.array_equal(mended[to:], got.head_ids):
                ids += [mended[len(tail_ids) : to], got.ids]
                tail, tail_ids, join = got.tail, got.tail_ids, chunk[got.last :]
            else:
                self.grown += 1
                join += chunk
        mended = self.ids(tail + join)
        if not np.array_equal(mended[: len(tail_ids)], tail_ids):  # no agreement up to the end
            return self.ids(text).astype("<u4")
        return np.concatenate([*ids, mended[len(tail_ids) :]]).astype("<u4")


def met(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty), dealt by the least hash among the cuts of a text, which texts with most content
    in common share; Spark splits partitions that grow large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            data, offsets = utf8(batch.column(1))
            if len(data) <= 16:
                share = np.zeros(batch.num_rows, np.int64)
            else:
                h = rolling(data)
                at = np.flatnonzero(h % np.uint64(MEAN) == 0)
                row = np.searchsorted(offsets, at, "right") - 1
                at, row = at[at - offsets[row] >= 16], row[at - offsets[row] >= 16]
                share = np.full(batch.num_rows, np.iinfo(np.int64).max)
                np.minimum.at(share, row, (mixed(h[at]) >> np.uint64(2)).astype(np.int64))
                alone = share == np.iinfo(np.int64).max
                share[alone] = np.arange(batch.num_rows)[alone] + len(data)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(share)], ["doc_id", "text", "share"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, share long").hint("rebalance", "share").select("doc_id", "text")


def _encoded(docs: DataFrame, path: str | None, row: Callable[[bytes, np.ndarray, list[bytes]], tuple], schema: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, words = codec(path or default_path())
        reuse = Reuse(encode)
        for batch in blocks(batches):
            data, offsets = utf8(batch.column(1))
            whole, rows = data.tobytes(), []
            for k, ends in enumerate(chunk_ends(data, offsets)):
                begin = int(offsets[k])
                text = whole[begin : int(offsets[k + 1])]
                rows.append(row(text, reuse.text(text, ends, begin), words))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kind) for c, (_, _, kind) in zip(zip(*rows, strict=True), schema, strict=True))], ["doc_id", *(name for name, _, _ in schema)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return met(docs).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{name} {sql}" for name, sql, _ in schema))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int), one row for each row of docs. Null and empty texts get an empty array; repeated
    rows repeat; an empty table gives an empty one. Only doc_id and text are read. path: of the vocabulary, on the
    executors; without one, the installed byte-level vocabulary."""
    return _encoded(docs, path, lambda _, ids, __: (ids.astype(np.int32),), [("ids", "array<int>", pa.list_(pa.int32()))])


def decoded(ids, words: list[bytes]) -> str:
    return b"".join(map(words.__getitem__, ids.tolist() if hasattr(ids, "tolist") else ids)).decode("utf-8", "replace")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids. Null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, words = codec(path or default_path())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else decoded(x, words) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: what encode and decode give, as digests."""

    def row(_: bytes, ids: np.ndarray, words: list[bytes]) -> tuple:
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded(ids, words).encode()).hexdigest()

    return _encoded(docs, path, row, [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())])
