"""Ranked lexical search by dense, blocked matrix products.

Items come in tiles, each with a compact vocabulary of its own terms. Documents come
in tiles of some megabytes of text, of which the terms of the items alone are kept
and stored. A tile of weights (items by terms) times a tile of impacts (terms by
documents) is one BLAS product in float64: all entries are integers, and no partial
sum reaches 2^53, so that every order of adding gives the same exact score. A task
keeps the best of each item over its tiles; ties go to the lesser doc_id everywhere,
so that no cut loses one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._batches import NO_ID, each, opened, rows_of, squeezed
from ._common import blocks, cut, utf8
from ._sums import WIDTH, summed

K = 50
#: Items of a tile; terms and documents of one product.
ITEMS, TERMS, DOCS = 64, 4_096, 1_024
#: Items, and bytes of their terms, that are broadcast at once; a larger table takes a pass over the documents for each
#: such group. (An item of more bytes is a group of its own.)
GROUP_ITEMS, GROUP_BYTES = 1_024, 16 << 20
#: Weights stay below 2^16 for fewer than 2^63 documents and impacts at most at 10^6 < 2^20, so that a sum of TERMS = 2^12
#: products stays below 2^48.
INSIDE = np.zeros(256, bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    INSIDE[_low:_high] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

ITEM = "number long, item_id long, terms array<binary>"
TILE = "part long, ids binary, lengths binary, pairs binary, counts binary, df binary"
BEST = "number long, item_id long, part long, doc_id long, score long"


def terms(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts end to end (null: none), and how many each text has."""
    data, offsets = utf8(column)
    inside = INSIDE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begins[edge] = inside[edge]
    begin = np.flatnonzero(begins)
    before = np.cumsum(inside)
    held = LOWER[data[inside]]
    starts = np.append(before[begin] - 1, len(held)).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(starts), pa.py_buffer(held)])
    return found, np.diff(np.searchsorted(begin, offsets))


def numbered(items: DataFrame) -> DataFrame:
    """A row of distinct terms for each item that has any, with a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for block in blocks(batches):
            found, n = terms(block.column(1))
            ends = np.cumsum(n)
            ids = block.column(0).to_pylist()
            out = []
            for i, (end, size) in enumerate(zip(ends.tolist(), n.tolist(), strict=True)):
                if size:
                    out.append((number + i, ids[i], found.slice(end - size, size).unique().to_pylist()))
            number += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.list_(pa.binary()))], ["number", "item_id", "terms"])

    return cut(items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, ITEM))


def groups(rows: Iterator) -> Iterator[list]:
    """Items in groups of GROUP_ITEMS and GROUP_BYTES at most."""
    held, size = [], 0
    for r in rows:
        own = sum(len(t) + 8 for t in r["terms"])
        if held and (len(held) == GROUP_ITEMS or size + own > GROUP_BYTES):
            yield held
            held, size = [], 0
        held.append(r)
        size += own
    if held:
        yield held


class Tile:
    """Some items over their own terms. number, item_id: of the items; place: of each term of the group in this tile, or -1;
    item, term: where a weight stands."""

    def __init__(self, items: list, at: dict[bytes, int]):
        self.number = np.array([r["number"] for r in items], np.int64)
        self.item_id = [r["item_id"] for r in items]
        own: dict[int, int] = {}
        pairs = [(i, own.setdefault(at[bytes(t)], len(own))) for i, r in enumerate(items) for t in r["terms"]]
        self.terms = np.fromiter(own, np.int64, len(own))
        self.item, self.term = np.array(pairs, np.int64).reshape(-1, 2).T

    def weights(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.number), len(self.terms)))
        out[self.item, self.term] = w[self.terms[self.term]]
        return out


def tiled(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """A stored row for each tile of documents: ids, numbers of terms, and tf of each (document, term of the vocabulary); and
    a row for each task with df of each term, the number of documents with terms and that of all terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most GROUP_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, known = TaskContext.get().partitionId(), pa.array(shared.value, pa.large_binary())
        width = max(1, len(known))
        sums = np.zeros(len(known) + 2, np.int64)
        for block in blocks(batches):
            found, n = terms(block.column(1))
            ids = block.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            number = pc.index_in(found, value_set=known)
            hit = np.asarray(number.is_valid())
            keys = np.repeat(np.arange(len(n)), n)[hit] * width + np.asarray(number.drop_null()).astype(np.int64)
            pairs, tf = np.unique(keys, return_counts=True)
            sums[: len(known)] += np.bincount(pairs % width, minlength=len(known))[: len(known)]
            sums[-2:] += [np.count_nonzero(n), n.sum()]
            yield rows_of(TILE, [(part, ids.tobytes(), squeezed(n), squeezed(np.diff(pairs, prepend=0)), squeezed(tf), None)])
        yield rows_of(TILE, [(part, None, None, None, None, sums.tobytes())])

    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, TILE))


def weight(df: np.ndarray, documents: int) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * documents + 2) / (2.0 * df + 1)))


def best(k: int, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, of equal ones those of the least ids."""
    if len(ids) > 4 * k:
        least = -np.partition(-scores, k - 1)[k - 1]
        ids, scores = ids[scores >= least], scores[scores >= least]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def scored(tiles: list[Tile], w: np.ndarray, n_docs: int, n_terms: int, k: int, rows: Iterator[dict]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """For (tile, item of it) the best ids and scores over the tiles of documents in rows."""
    width = max(1, len(w))
    held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    place = np.full(width, -1, np.int64)
    floors = [np.ones(len(t.number), np.int64) for t in tiles]  # a score below can't be kept
    weights = [t.weights(w) for t in tiles]
    for row in rows:
        ids = np.frombuffer(row["ids"], np.int64)
        m = np.array([50 + 50 * n * n_docs // max(1, n_terms) for n in opened(row["lengths"]).tolist()], np.int64)
        pairs, tf = np.cumsum(opened(row["pairs"]).astype(np.int64)), opened(row["counts"]).astype(np.int64)
        doc, term = pairs // width, pairs % width
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
        for number, tile in enumerate(tiles):
            place[tile.terms] = np.arange(len(tile.terms))
            column = place[term]
            place[tile.terms] = -1
            some = np.flatnonzero(column >= 0)
            for at, until in zip(cuts := np.searchsorted(doc[some], np.arange(0, len(ids) + DOCS, DOCS)), cuts[1:], strict=False):
                own = some[at:until]
                if not len(own):
                    continue
                names, spot = np.unique(doc[own], return_inverse=True)
                score = np.zeros((len(tile.number), len(names)), np.int64)
                for low in range(0, len(tile.terms), TERMS):
                    high = min(low + TERMS, len(tile.terms))
                    inner = (column[own] >= low) & (column[own] < high)
                    dense = np.zeros((high - low, len(names)))
                    dense[column[own][inner] - low, spot[inner]] = impact[own][inner]
                    score += (weights[number][:, low:high] @ dense).astype(np.int64)
                may = score >= floors[number][:, None]
                for i in np.flatnonzero(may.any(1)).tolist():
                    old = held.get((number, i), (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    got = best(k, np.concatenate([old[0], ids[names[may[i]]]]), np.concatenate([old[1], score[i][may[i]]]))
                    held[number, i] = got
                    if len(got[0]) == k:
                        floors[number][i] = got[1][-1]
    return held


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id, score (see the README for the measure).

    An item or text that is null or has no terms finds nothing and is found by none. Every row is an item or a document of
    its own: repeated rows of docs each have a rank, and items that repeat have results each. Equal scores go by ascending doc_id,
    null last. Fewer than k where fewer score above 0; empty tables give no rows. Texts are read whole; other columns aren't read.
    """
    spark = docs.sparkSession
    found = None
    for group in groups(numbered(items).toLocalIterator()):
        vocabulary = sorted({bytes(t) for r in group for t in r["terms"]})
        at = {t: i for i, t in enumerate(vocabulary)}
        held = tiled(docs, vocabulary)
        sums = summed(held.where("df is not null").select(F.lit(0).cast("long").alias("key"), "part", F.col("df").alias("blob")), held.rdd.getNumPartitions(), np.int64)[0] if not held.isEmpty() else np.zeros(len(at) + 2, np.int64)
        n_docs, n_terms = int(sums[-2]), int(sums[-1])
        tiles = [Tile(group[i : i + ITEMS], at) for i in range(0, len(group), ITEMS)]
        shared = spark.sparkContext.broadcast((tiles, weight(sums[:-2], n_docs)))  # of the size of the group

        def run(batches: Iterator[pa.RecordBatch], shared=shared, n_docs=n_docs, n_terms=n_terms) -> Iterator[pa.RecordBatch]:
            part, (tiles, w) = TaskContext.get().partitionId(), shared.value
            for (t, i), (ids, scores) in scored(tiles, w, n_docs, n_terms, k, each(batches)).items():
                name, item = int(tiles[t].number[i]), tiles[t].item_id[i]
                yield rows_of(BEST, [(name, item, part, None if d == NO_ID else d, s) for d, s in zip(ids.tolist(), scores.tolist(), strict=True)])

        got = held.where("df is null").mapInArrow(run, BEST)
        found = got if found is None else found.unionByName(got)
    if found is None:
        found = spark.createDataFrame([], BEST)
    first = F.col("score").desc(), F.col("doc_id").asc_nulls_last()
    # one more step between the tasks and an item's only group, so that this doesn't grow with all tasks
    some = found.withColumn("part", F.expr(f"part div {WIDTH}")).withColumn("r", F.row_number().over(Window.partitionBy("number", "part").orderBy(*first))).where(F.col("r") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*first))).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


SEARCH_SQL = """
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM {docs}),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM {items}),
sizes AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM words GROUP BY doc_id),
total AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
tfs AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * CAST(any_value(n_docs) AS DOUBLE) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, total GROUP BY term),
impacts AS (
  SELECT tfs.doc_id, tfs.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS part
  FROM tfs JOIN weights USING (term) JOIN sizes ON sizes.doc_id = tfs.doc_id, total),
scores AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, doc_id HAVING sum(part) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores QUALIFY rank <= 50
"""
