"""N-gram Jaccard join with token-combination prefixes.

The tokens of a document are its distinct shingles of WORDS words, ordered from
rare to frequent. Two sets that link share a token in their prefixes of the rarest
quarter. Rare tokens of a prefix are indexed singly. If all that two sets share is
frequent, they share two frequent tokens next to each other in both orders, early
on; so from an extended prefix of frequent tokens the pairs of neighbours are
indexed, and single frequent tokens never are. Each index key gathers around one
set, its hub; the sets around a hub are verified there, whole, by two independent
64-bit hashes of each token.

Around a hub with many sets each is held against the hub first. Jaccard distance is
a metric, so two sets can link only if their distances to the hub differ by no more
than a link's: rings of that width around the hub, and classes of size, leave only
neighbouring cells to be compared, and nothing within the ring that links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words
from ._batches import ASKED, NO_ID, Batch, answered, answers, ask, buckets_of, distinct, held_bytes, named_as, pack, restored, restored_schema, rows_of, with_answers
from ._common import beside, cut, mixed
from ._components import components

WORDS = 5
#: Two sets link if UP times their intersection is at least OF times their union.
UP, OF = 100, 75
#: Tokens in 2 ** (FREQUENT + 1) documents or more are indexed in pairs.
FREQUENT = 8
#: Sets verified in one task; those around a larger hub are dealt into blocks.
BLOCK = 1024


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text, by text and then by hash, a second hash of each, and where each text's begin. A text
    with fewer words is one shingle, one without words has none."""
    data = _words.LOWER[data]
    begin, end, first = _words.spans(data, offsets)
    at = _words.starts(first, k)
    doc = np.searchsorted(first, at, "right") - 1
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < k))
    both = []
    for seed in (0, 1):
        word = _words.hashes(data, begin, end, seed)
        own = [_words.windows(word[first[d] : first[d + 1]], int(count[d])) ^ np.uint64(int(count[d]) * 0x9E3779B97F4A7C15 % (1 << 64)) for d in short]
        both.append(np.concatenate([_words.windows(word, k)[at] if len(at) else np.zeros(0, np.uint64), *own]))
    doc = np.concatenate([doc, short])
    order = np.lexsort((both[0], doc))
    doc, hashed, second = doc[order], both[0][order], both[1][order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (hashed[1:] != hashed[:-1])
    doc, hashed, second = doc[fresh], hashed[fresh], second[fresh]
    return hashed, second, np.searchsorted(doc, np.arange(len(offsets))).astype(np.int64)


def digests(tokens: np.ndarray, second: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two 64-bit sums for each set, of both hashes of its tokens, equal for equal sets."""
    out = np.zeros((len(first) - 1, 2), np.uint64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        for i, x in enumerate((mixed(tokens), mixed(second))):
            out[some, i] = np.add.reduceat(x, first[:-1][some])
    return out.view(np.int64)


def sized(own: Batch) -> bytes:
    """Set sizes and digests of a batch's texts, for its column extra."""
    tokens, second, first = shingles(own.data, own.offsets)
    return np.column_stack([np.diff(first), digests(tokens, second, first)]).astype("<i8").tobytes()


SETS = "doc_id long, batch long, place int, n_shingles long, d1 long, d2 long"


def sets_of(packed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch, ids, extra in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ids, held = np.frombuffer(ids, np.int64), np.frombuffer(extra, "<i8").reshape(-1, 3)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = (ids, np.full(len(ids), batch), np.arange(len(ids)), held[:, 0], held[:, 1], held[:, 2])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in SETS.split(", ")])

    return packed.select("batch", "ids", "extra").mapInArrow(run, SETS)


def classes(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """0 for a token of one document, else 1 and more by the power of 2 in the number of documents."""
    df = np.bincount(group, value.astype(np.float64))
    return np.floor(np.log2(df)).astype(np.uint64)[group]


def least_overlap(n: np.ndarray) -> np.ndarray:
    """No set of n tokens links over fewer shared ones."""
    return -(-OF * n // UP)


def signature(tokens: np.ndarray, kind: np.ndarray, frequent: int = FREQUENT) -> np.ndarray:
    """Index keys of a set: tokens with their class (0: in no other document), in any order. None if no set can link.

    Singles: of the n - least + 1 first in order, those of class 1 to frequent. Pairs: if o tokens are shared, all
    frequent, a linked pair leaves at most o / 3 others on both sides, so among the first o // 3 + 2 shared ones two
    are neighbours in both; they stand among the first o // 3 + 2 + (frequent - least) frequent tokens, and o <= n."""
    n = len(tokens)
    least = int(least_overlap(np.int64(n)))
    if (kind > 0).sum() < least:
        return np.zeros(0, np.uint64)
    order = np.lexsort((tokens, kind))
    prefix, c = tokens[order], kind[order]
    head = slice(0, n - least + 1)
    keys = [mixed(prefix[head][(c[head] > 0) & (c[head] <= frequent)])]
    common = prefix[c > frequent]
    if len(common) >= max(2, least):
        common = common[: n // 3 + 2 + len(common) - least]
        keys.append(mixed(common[:-1] * np.uint64(0x9E3779B97F4A7C15) + mixed(common[1:])))
    return np.unique(np.concatenate(keys))


#: A row for each key of a set (blob null), and one for each set with keys (key null).
INDEXED = "doc long, key long, n int, m int, blob binary"


def keyed(own: Batch, representative: np.ndarray, kind: np.ndarray, tokens: np.ndarray, first: np.ndarray, frequent: int) -> Iterator[pa.RecordBatch]:
    keys, docs, ns, ms, texts = [], [], [], [], []
    for d in np.flatnonzero(representative).tolist():
        a, b = int(first[d]), int(first[d + 1])
        if a == b:
            continue
        found = signature(tokens[a:b], kind[a:b], frequent)
        if len(found):
            m = int((kind[a:b] > 0).sum())
            keys.append(found.view(np.int64))
            docs.append(np.full(len(found), own.ids[d]))
            ns.append(np.full(len(found), b - a))
            ms.append(np.full(len(found), m))
            texts.append((int(own.ids[d]), None, b - a, m, zstandard.ZstdCompressor(3).compress(own.data[own.offsets[d] : own.offsets[d + 1]].tobytes())))
    if keys:
        columns = [np.concatenate(x) for x in (docs, keys, ns, ms)]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)), pa.nulls(len(columns[0]), pa.binary())], [x.split()[0] for x in INDEXED.split(", ")])
        yield rows_of(INDEXED, texts)


def tokens_of(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of each token of a packed text."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8) if blob else np.zeros(0, np.uint8)
    return shingles(data, np.array([0, len(data)], np.int64))[:2]


def links(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return UP * shared >= OF * (a + b - shared)


def around(hub: int | None, docs: np.ndarray, n: np.ndarray, m: np.ndarray, side: np.ndarray, blobs: list[bytes]) -> list[tuple[int, int]]:
    """Edges between linked sets around a hub, enough to connect what is linked. First each set against the hub (None:
    without one); then every two sets that these don't connect and whose sizes and common tokens allow it. side: 0 and 1
    for two blocks, of which only pairs across are looked at, or all 2 for one."""
    order = np.lexsort((docs, docs != hub)) if hub is not None else np.argsort(docs)
    docs, n, m, side = docs[order], n[order].astype(np.int64), m[order].astype(np.int64), side[order]
    sets = [tokens_of(blobs[i]) for i in order]
    words, number, _ = distinct(*(np.concatenate([s[i] for s in sets]) for i in (0, 1)))
    number = np.split(number, np.cumsum([len(s[0]) for s in sets])[:-1])
    at = np.zeros(len(words), bool)
    label = np.arange(len(docs))
    edges = []
    for i in range(len(docs)):
        others = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        may = links(np.minimum(m[i], m[others]), n[i], n[others])
        if docs[i] != hub:
            may &= (side[others] != side[i]) | (side[i] == 2)
        others = others[may]
        if not len(others):
            continue
        at[number[i]] = True
        held = [number[j] for j in others.tolist()]
        begins = np.cumsum([0, *(len(x) for x in held[:-1])])
        shared = np.add.reduceat(at[np.concatenate(held)].astype(np.int64), begins)
        at[number[i]] = False
        for j in others[links(shared, n[i], n[others])].tolist():
            if label[j] != label[i]:
                edges.append((int(docs[i]), int(docs[j])))
                label[label == label[j]] = label[i]
    return edges


RINGS = "hub long, doc long, ring int, size int"


def ringed(table: pa.Table) -> pa.Table:
    """The ring around the hub (0: what links with it) and the class of size of each set of a block."""
    hub, docs, n = table.column("hub")[0].as_py(), table.column("doc").to_pylist(), table.column("n").to_pylist()
    blobs = table.column("blob").to_pylist()
    center, center_second = tokens_of(blobs[docs.index(hub)])
    rows = []
    for doc, size, blob in zip(docs, n, blobs, strict=True):
        if doc != hub:
            tokens, second = tokens_of(blob)
            _, mine, theirs = np.intersect1d(center, tokens, assume_unique=True, return_indices=True)
            shared = int((center_second[mine] == second[theirs]).sum())
            union = len(center) + size - shared
            # a link is no farther apart than (UP - OF) / UP, which is the width of a ring
            ring = 0 if links(np.int64(shared), len(center), size) else max(1, -(-UP * (union - shared) // (union * (UP - OF))) - 1)
            rows.append((hub, doc, ring, int(math.log(size) / math.log(UP / OF))))
    return pa.Table.from_batches([rows_of(RINGS, rows)])


def apart(members: DataFrame, texts: DataFrame, block: int) -> tuple[DataFrame, DataFrame | None]:
    """members: hub, doc, sets (of the hub) of hubs with more than a block of sets. Edges with the hubs, and those of pairs that
    a hub doesn't link."""
    blocks = F.ceil(F.col("sets") / block).cast("int")
    mine = F.array(F.pmod(F.xxhash64("doc", F.lit(3)), blocks).cast("int"))
    dealt = members.select("hub", "doc", F.explode(F.when(F.col("doc") == F.col("hub"), F.sequence(F.lit(0), blocks - 1)).otherwise(mine)).alias("block"))
    rings = cut(dealt.join(texts, "doc").select("hub", "block", "doc", "n", "blob").groupBy("hub", "block").applyInArrow(ringed, RINGS))
    edges = rings.where("ring = 0").select(F.col("hub").alias("a"), F.col("doc").alias("b"))
    if rings.where("ring > 0").isEmpty():
        return edges, None
    cells = cut(rings.groupBy("hub", "ring", "size").agg(F.count("*").alias("sets")))
    held = beside(rings, cells, ["hub", "ring", "size"], "sets").withColumn("block", F.pmod(F.xxhash64("doc", F.lit(5)), blocks).cast("int"))
    one = cells.select("hub", F.col("ring").alias("r"), F.col("size").alias("s"), blocks.alias("k"))
    other = cells.select("hub", F.col("ring").alias("r2"), F.col("size").alias("s2"), blocks.alias("k2"))
    # sizes of linked sets are in the same class or the next
    near = one.join(other, "hub").where("r2 - r IN (0, 1) AND abs(s2 - s) <= 1 AND r + r2 > 0 AND (r2 > r OR s2 >= s)")
    pairs = near.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k2") - 1)))
    pairs = cut(pairs.where("r2 > r OR s2 > s OR j >= i").select("hub", "r", "s", "i", "r2", "s2", "j"))
    place = ["hub", "r", "s", "i", "r2", "s2", "j"]
    alike = (F.col("r") == F.col("r2")) & (F.col("s") == F.col("s2")) & (F.col("i") == F.col("j"))
    left = held.select("hub", "doc", F.col("ring").alias("r"), F.col("size").alias("s"), F.col("block").alias("i")).join(pairs, ["hub", "r", "s", "i"])
    right = held.select("hub", "doc", F.col("ring").alias("r2"), F.col("size").alias("s2"), F.col("block").alias("j")).join(pairs.where(~alike), ["hub", "r2", "s2", "j"])
    both = left.select(*place, "doc", F.when(alike, 2).otherwise(0).alias("side")).unionByName(right.select(*place, "doc", F.lit(1).alias("side")))

    def verify(table: pa.Table) -> pa.Table:
        docs, n, m, side = (table.column(c).to_numpy() for c in ("doc", "n", "m", "side"))
        return pa.Table.from_batches([rows_of("a long, b long", around(None, docs, n, m, side, table.column("blob").to_pylist()))])

    return edges, both.join(texts, "doc").select(*place, "doc", "side", "n", "m", "blob").groupBy(*place).applyInArrow(verify, "a long, b long")


def join(docs: DataFrame, frequent: int = FREQUENT, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (the least doc_id reached by links, its own
    included), copy_of (the least doc_id with the same set).

    Words are runs of bytes other than ASCII white space, A-Z in lower case. Texts without words, null or empty, link
    with nothing. A null doc_id takes no part and is its own (null) component. Rows with one doc_id are one vertex.
    An empty table gives an empty one. Only doc_id and text are read.
    """
    return _joined(pack(docs, sized), frequent, block).drop("batch", "place", "d1", "d2")


def representatives(docs: DataFrame, frequent: int = FREQUENT, block: int = BLOCK) -> DataFrame:
    """The rows of docs whose doc_id is the least of its component, or null, or whose text has no words. Of rows alike in
    doc_id and set one stays."""
    packed = pack(docs, sized, carry=True)
    rows = _joined(packed, frequent, block)
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    first = rows.where(~alone & (F.col("doc_id") == F.col("component_id"))).groupBy("doc_id", "d1", "d2", "n_shingles").agg(F.min(F.struct("batch", "place")).alias("r")).select("r.batch", "r.place")
    chosen = first.unionByName(rows.where(alone).select("batch", "place")).groupBy("batch").agg(F.collect_list("place").alias("places"))

    def keep(own: Batch, got: list[list[dict]]) -> Iterator[pa.RecordBatch]:
        yield restored(own, flagged(own, got[0]))

    return named_as(with_answers(packed, chosen, keep, restored_schema(docs)), docs)


def flagged(batch: Batch, rows: list[dict]) -> np.ndarray:
    out = np.zeros(len(batch.ids), bool)
    out[[p for r in rows for p in (r["places"] or ())]] = True
    return out


def _joined(packed: DataFrame, frequent: int, block: int) -> DataFrame:
    buckets = buckets_of(packed.sparkSession, held_bytes(packed))
    sets = sets_of(packed)
    same = ["d1", "d2", "n_shingles"]
    whole = (F.col("n_shingles") > 0) & (F.col("doc_id") != NO_ID)
    # copies in one batch are one row, so that a set which many texts have isn't a key with as many rows
    named = cut(sets.where(whole).groupBy("batch", *same).agg(F.collect_list(F.struct("place", "doc_id")).alias("members"), F.min(F.struct("doc_id", "batch", "place")).alias("r")))
    least = cut(named.groupBy(*same).agg(F.min("r").alias("r"), F.count("*").alias("batches")))
    chosen = least.groupBy(F.col("r.batch").alias("batch")).agg(F.collect_list("r.place").alias("places"))
    flags = cut(packed.select("batch").join(chosen, "batch", "left"))

    total = sets.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    bits = min(64, max(32, int(total).bit_length() + 13))
    drop = 64 - bits

    def cut_hashes(tokens: np.ndarray, first: np.ndarray, representative: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cut hashes of representatives' tokens, distinct, the number of each of them, and which tokens are theirs."""
        theirs = np.repeat(representative, np.diff(first))
        keys, group = np.unique(tokens[theirs] >> np.uint64(drop) << np.uint64(drop), return_inverse=True)
        return keys, group, theirs

    def send(own: Batch, got: list[list[dict]]) -> Iterator[pa.RecordBatch]:
        tokens, _, first = shingles(own.data, own.offsets)
        keys, group, _ = cut_hashes(tokens, first, flagged(own, got[0]))
        yield ask(own.batch, keys, np.bincount(group, minlength=len(keys)), buckets, drop)

    asked = with_answers(packed, flags, send, ASKED)
    frequency = answers(asked, classes, drop).withColumn("places", F.lit(None).cast("array<int>")).withColumn("kind", F.lit(0))
    known = frequency.unionByName(flags.select("batch", "places", F.lit(1).alias("kind")), allowMissingColumns=True)

    def index(own: Batch, got: list[list[dict]]) -> Iterator[pa.RecordBatch]:
        tokens, _, first = shingles(own.data, own.offsets)
        representative = flagged(own, got[1])
        _, group, theirs = cut_hashes(tokens, first, representative)
        kind = np.zeros(len(tokens), np.int64)
        kind[theirs] = answered(got[0])[group].astype(np.int64)
        yield from keyed(own, representative, kind, tokens, first, frequent)

    indexed = cut(with_answers(packed, known, index, INDEXED, 2))
    keys, texts = indexed.where("key is not null").drop("blob"), indexed.where("key is null").drop("key")
    # the hub of a key: the set with the largest share of tokens that others have too
    hubs = keys.groupBy("key").agg(F.max(F.struct((F.col("m") / F.col("n")).alias("share"), (-F.col("doc")).alias("low"))).alias("h"), F.count("*").alias("sets")).where("sets > 1")
    hubs = cut(hubs.select("key", (-F.col("h.low")).alias("hub"), "sets"))
    near = beside(keys, hubs, ["key"], "sets").select("hub", "doc").distinct()
    near = cut(near.unionByName(near.select("hub", F.col("hub").alias("doc"))).distinct())
    sums = cut(near.groupBy("hub").agg(F.count("*").alias("sets")))
    members = beside(near, sums, ["hub"], "sets")

    def verify(table: pa.Table) -> pa.Table:
        docs, n, m = (table.column(c).to_numpy() for c in ("doc", "n", "m"))
        return pa.Table.from_batches([rows_of("a long, b long", around(table.column("hub")[0].as_py(), docs, n, m, np.full(len(docs), 2), table.column("blob").to_pylist()))])

    linked = members.where(F.col("sets") <= block).join(texts, "doc").select("hub", "doc", "n", "m", "blob").groupBy("hub").applyInArrow(verify, "a long, b long")
    if not sums.where(F.col("sets") > block).isEmpty():
        for more in apart(members.where(F.col("sets") > block), texts, block):
            linked = linked if more is None else linked.unionByName(more)
    found = components(linked)
    firsts = least.select(*same, "batches", F.col("r.doc_id").alias("copy_of")).join(found.select(F.col("node").alias("copy_of"), "component"), "copy_of", "left")
    rows = beside(named.drop("r"), cut(firsts), same, "batches").select("batch", *same, F.explode("members").alias("p"), F.coalesce("component", "copy_of").alias("component_id"), "copy_of")
    rows = rows.select("batch", "p.place", "d1", "d2", "p.doc_id", "n_shingles", "component_id", "copy_of")
    ids = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    return rows.unionByName(sets.where(~whole).select("batch", "place", "d1", "d2", ids.alias("doc_id"), "n_shingles", ids.alias("component_id"), ids.alias("copy_of")))
