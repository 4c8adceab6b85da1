"""Documents in batches, and questions that batches ask about their hashes.

A batch holds some megabytes of text. To learn something about all its hashes
(how many documents have each, or who has it first) it sends a sorted, packed
list of its distinct ones to each bucket of the hash space; the bucket answers
with one packed value for each. Texts stay with their batch, rows stay few, and a
hash that half of the corpus shares is sent once by each batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ._common import blocks, cut, partitions, utf8

#: Text in a batch; a longer document is a batch of its own.
BATCH_BYTES = 2 << 20
#: Packed text for each bucket, at most. Its distinct hashes and answers take some tens of times as much memory when open.
BUCKET_BYTES = 8 << 20
NO_ID = np.iinfo(np.int64).max
ASKED = "bucket int, batch long, blob binary"
ANSWERED = "batch long, bucket int, blob binary"


def squeezed(a: np.ndarray) -> bytes:
    """Unsigned integers as compressed planes of bytes, those above the largest left out."""
    a = np.ascontiguousarray(a, np.uint64)
    planes = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return len(a).to_bytes(8, "little") + zstandard.ZstdCompressor(1).compress(a.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes())


def opened(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[8:]), np.uint8)
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : len(raw) // n] = raw.reshape(-1, n).T
    return out.view(np.uint64).reshape(-1)


def packed_keys(keys: np.ndarray) -> bytes:
    return squeezed(np.diff(keys, prepend=np.uint64(0)))


def opened_keys(b: bytes) -> np.ndarray:
    return np.cumsum(opened(b), dtype=np.uint64)


@dataclass
class Batch:
    """ids: of the texts, ascending (NO_ID: null). data and offsets: their bytes. carried: their other columns, if packed."""

    batch: int
    ids: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    extra: bytes
    carried: bytes = b""


PACKED = "batch long, n long, ids binary, lengths binary, text binary, extra binary, carried binary"


def pack(docs: DataFrame, extra: Callable[[Batch], bytes] | None = None, limit: int = BATCH_BYTES, carry: bool = False) -> DataFrame:
    """doc_id and text in batches (null text: empty), by ascending doc_id; texts compressed, cut from their lineage.
    carry: all other columns too, for restored()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for block in blocks(batches, limit=limit):
            ids = block.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(ids, kind="stable")
            data, offsets = utf8(block.column(1).take(pa.array(order)))
            own = Batch(number, ids[order], data, offsets, b"")
            held = b""
            if carry:
                others = [i for i, name in enumerate(block.schema.names) if name != "text"]
                kept = pa.RecordBatch.from_arrays([*(block.column(i).take(pa.array(order)) for i in others), block.column(1).is_null().take(pa.array(order))], [*(f"c{i}" for i in others), "no_text"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, kept.schema) as out:
                    out.write_batch(kept)
                held = zstandard.ZstdCompressor(1).compress(sink.getvalue().to_pybytes())
            row = (number, len(ids), own.ids.tobytes(), squeezed(np.diff(offsets)), zstandard.ZstdCompressor(1).compress(data.tobytes()), extra(own) if extra else b"", held)
            yield rows_of(PACKED, [row])
            number += 1

    rest = [docs[c] for c in docs.columns if c not in ("doc_id", "text")] if carry else []
    return cut(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", *rest).mapInArrow(run, PACKED))


def restored(own: Batch, chosen: np.ndarray, texts: list[bytes] | None = None) -> pa.RecordBatch:
    """The chosen rows of a batch packed with carry, in the order doc_id, text, others; with other texts if given."""
    held = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(own.carried)).read_all().combine_chunks().to_batches()[0]
    whole, at = own.data.tobytes(), np.flatnonzero(chosen)
    no = held.column(held.num_columns - 1).to_pylist()
    text = [None if no[k] else (texts[k] if texts is not None else whole[int(own.offsets[k]) : int(own.offsets[k + 1])]).decode("utf-8", "ignore") for k in at.tolist()]
    columns = [held.column(i).take(pa.array(at)) for i in range(held.num_columns - 1)]
    return pa.RecordBatch.from_arrays([columns[0], pa.array(text, pa.string()), *columns[1:]], [f"c{i}" for i in range(held.num_columns)])


def restored_schema(docs: DataFrame) -> str:
    """For with_answers; restored rows bear the names of docs again after named_as()."""
    rest = [f.dataType.simpleString() for f in docs.schema if f.name not in ("doc_id", "text")]
    return ", ".join(f"c{i} {kind}" for i, kind in enumerate(["long", "string", *rest]))


def named_as(rows: DataFrame, docs: DataFrame) -> DataFrame:
    names = ["doc_id", "text", *(c for c in docs.columns if c not in ("doc_id", "text"))]
    back = rows.toDF(*names)
    return back.select(*(back[f.name].cast(f.dataType).alias(f.name) for f in docs.schema))


def unpacked(row: dict) -> Batch:
    lengths = opened(row["lengths"]).astype(np.int64)
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"]), np.uint8) if row["text"] else np.zeros(0, np.uint8)
    return Batch(row["batch"], np.frombuffer(row["ids"], np.int64), data, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), row["extra"], row["carried"])


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one, so that one batch's text is open at a time."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def rows_of(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def held_bytes(packed: DataFrame) -> int:
    """Bytes of the packed texts."""
    return packed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def buckets_of(spark: SparkSession, size: int) -> int:
    """Buckets for texts of so many packed bytes: what a bucket gets doesn't grow with them, whatever the session's partitions."""
    return max(64, 2 * partitions(spark), -(-size // BUCKET_BYTES))


def parts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted 64-bit keys (one more than buckets)."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)


def distinct(keys: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each distinct pair of hashes is first, in order, the number of each one's pair, and how often each occurs."""
    order = np.lexsort((second, keys))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (keys[order][1:] != keys[order][:-1]) | (second[order][1:] != second[order][:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    return order[fresh], group, np.diff(np.append(np.flatnonzero(fresh), len(order)))


def ask(batch: int, keys: np.ndarray, values: np.ndarray, buckets: int, drop_bits: int = 0, second: np.ndarray | None = None) -> pa.RecordBatch:
    """keys: sorted and distinct, or distinct with second, other 64 bits of the same; values: a non-negative integer for each.
    drop_bits: lowest bits that are zero in all keys."""
    at, rows = parts(keys, buckets), []
    for b in range(buckets):
        own = slice(at[b], at[b + 1])
        if at[b + 1] > at[b]:
            held = [packed_keys(keys[own] >> np.uint64(drop_bits)), squeezed(values[own])] + ([] if second is None else [squeezed(second[own])])
            rows.append((b, batch, b"".join(len(x).to_bytes(8, "little") + x for x in held)))
    return rows_of(ASKED, rows)


def asked_parts(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(blob[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def folded(fold: Callable[[np.ndarray, np.ndarray], np.ndarray], drop_bits: int = 0) -> Callable[[pa.Table], pa.Table]:
    """What a bucket does. fold(number of the distinct key of each entry, value of each entry) gives the answer to each entry."""

    def run(table: pa.Table) -> pa.Table:
        keys, values, seconds, batches = [], [], [], table.column("batch").to_pylist()
        for blob in table.column("blob").to_pylist():
            held = asked_parts(blob)
            keys.append(opened_keys(held[0]) << np.uint64(drop_bits))
            values.append(opened(held[1]))
            seconds += [opened(x) for x in held[2:]]
        group = distinct(np.concatenate(keys), np.concatenate(seconds))[1] if seconds else np.unique(np.concatenate(keys), return_inverse=True)[1]
        got = fold(group, np.concatenate(values))
        ends = np.cumsum([len(k) for k in keys])
        bucket = table.column("bucket")[0].as_py()
        out = [(batch, bucket, squeezed(part)) for batch, part in zip(batches, np.split(got, ends[:-1]), strict=True)]
        return pa.Table.from_batches([rows_of(ANSWERED, out)])

    return run


def answers(asked: DataFrame, fold: Callable[[np.ndarray, np.ndarray], np.ndarray], drop_bits: int = 0) -> DataFrame:
    return asked.groupBy("bucket").applyInArrow(folded(fold, drop_bits), ANSWERED)


def answered(rows: list[dict]) -> np.ndarray:
    """The answers to a batch's keys, in their order."""
    return np.concatenate([opened(r["blob"]) for r in sorted(rows, key=lambda r: r["bucket"])]) if rows else np.zeros(0, np.uint64)


def with_answers(packed: DataFrame, got: DataFrame, run: Callable[[Batch, list[list[dict]]], Iterator[pa.RecordBatch]], schema: str, kinds: int = 1) -> DataFrame:
    """run(batch, answers of each kind) for each batch. got: rows of ANSWERED, with a column kind from 0 if there are several."""
    nothing = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        held = right.to_pylist()
        out = []
        for row in left.to_pylist():
            out += list(run(unpacked(row), [[r for r in held if r.get("kind", 0) == k] for k in range(kinds)]))
        return pa.Table.from_batches(out) if out else nothing

    return packed.groupBy("batch").cogroup(got.groupBy("batch")).applyInArrow(both, schema)


def union_kinds(*got: DataFrame) -> DataFrame:
    out = got[0].withColumn("kind", F.lit(0))
    for k, df in enumerate(got[1:], 1):
        out = out.unionByName(df.withColumn("kind", F.lit(k)))
    return out

