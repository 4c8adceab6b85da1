"""Nearest vectors by cosine over low-dimensional stable projections.

The squared distance of two unit vectors in a Gaussian projection to AXES dimensions
is their own times a chi-square variable of AXES degrees of freedom. A kd-tree over
the projections cuts the vectors into cells, stored as blocks in the order of the
tree's leaves. A query takes projected neighbours one ring of leaves after another,
verifies them by their cosines, and stops once a vector as near as its k-th best would
lie that far out with a probability below 1 - SURE only. It begins in its own cell;
the distance found there rules out other cells by the same test. Recall is measured
against brute force, and the test made stricter where it falls short.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._batches import each, rows_of
from ._common import beside, cut
from .neardup import matrix, units

K = 5
#: Rows whose id this divides are the queries.
ASKED = 50
#: Dimensions of the projection (even, so that the chi-square distribution has a closed form).
AXES = 12
#: The stopping test's probability, and those that follow where recall is below RECALL; 1 compares with every row.
SURE, RECALL = (0.95, 0.99, 0.999, 1.0), 0.9
#: Vectors that the tree's upper levels are fitted on, and their cells, at most. Lower levels are those of each block.
SAMPLE, CELLS = 16_384, 4_096
#: Bytes of the vectors of a block; vectors of a leaf; queries of a pack; packs that meet a copy of a block, about.
BLOCK_BYTES, LEAF, PACK, PACKS = 4 << 20, 64, 256, 16
#: Queries whose recall is measured, about (by hash).
AUDITED = 256
#: What rounding may do to a squared distance.
ROUNDING = 1e-9

PLACED = "id long, dims int, unit binary, ids binary, cell int, spot binary"
INDEX = "dims int, cell int, block int, units binary, spots binary, names binary, ids binary, sizes binary"
PACKED = "dims int, cell int, names binary, units binary, spots binary, reach binary"
FOUND = "name long, score double, vec_id long, own boolean"


def quantile(p: float) -> float:
    """Below which a chi-square variable of AXES degrees of freedom lies with probability p; infinite for 1."""
    if p >= 1:
        return math.inf

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(AXES // 2))

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def projection(dims: int) -> np.ndarray:
    return np.random.default_rng(dims).standard_normal((dims, AXES))


def split(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The upper levels of a kd-tree in heap order (from 1): axis and value of each cut, across the axis of most variance."""
    axis, value = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
    held = {1: points}
    for node in range(1, 1 << depth):
        own = held.pop(node)
        if len(own):
            axis[node] = int(np.argmax(own.var(0)))
            value[node] = float(np.median(own[:, axis[node]]))
        right = own[:, axis[node]] > value[node]
        held[2 * node], held[2 * node + 1] = own[~right], own[right]
    return axis, value


def cells(points: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    axis, value = tree
    node = np.ones(len(points), np.int64)
    for _ in range(len(axis).bit_length() - 1):
        node = 2 * node + (points[np.arange(len(points)), axis[node]] > value[node])
    return (node - len(axis)).astype(np.int32)


def walls(tree: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest coordinates of each cell."""
    axis, value = tree
    low, high = np.full((2 * len(axis), AXES), -np.inf), np.full((2 * len(axis), AXES), np.inf)
    for node in range(1, len(axis)):
        for child in (2 * node, 2 * node + 1):
            low[child], high[child] = low[node], high[node]
        high[2 * node, axis[node]] = low[2 * node + 1, axis[node]] = value[node]
    return low[len(axis) :], high[len(axis) :]


def apart(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point from each box."""
    out = np.zeros((len(points), len(low)))
    for a in range(AXES):
        gap = np.maximum(np.maximum(low[:, a] - points[:, a, None], points[:, a, None] - high[:, a]), 0)
        out += gap * gap
    return out


def classes_of(held: DataFrame, k: int) -> DataFrame:
    """A stored row for each different vector: unit, dims, id (a number of its own), ids (the k + 1 least vec_ids; no query needs
    more of equal vectors)."""
    least = held.withColumn("r", F.row_number().over(Window.partitionBy("unit").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    ids = least.groupBy("unit").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return cut(ids.select("unit", F.octet_length("unit").alias("dims"), F.monotonically_increasing_id().alias("id"), "ids"))


def trees(classes: DataFrame) -> Broadcast:
    """The upper levels for each length of vectors, fitted in a task of its own on about SAMPLE projections by hash."""
    sums = classes.groupBy("dims").agg(F.count("*").alias("total"))  # a row for each length of vectors
    part = F.pmod(F.xxhash64("unit", F.lit(29)), F.lit(1 << 30)) < F.lit(float(SAMPLE)) / F.col("total") * (1 << 30)
    form = "dims int, axis binary, value binary"

    def fitted(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        dims, total = table.column("dims")[0].as_py(), table.column("total")[0].as_py()
        points = matrix(table.column("unit").to_pylist()) @ projection(dims // 8)
        wanted = min(CELLS, len(points), -(-total * dims // BLOCK_BYTES))
        axis, value = split(points, max(0, (wanted - 1).bit_length()))
        return pa.Table.from_batches([rows_of(form, [(dims, axis.tobytes(), value.tobytes())])])

    rows = classes.select("id", "dims", "unit").join(F.broadcast(sums), "dims").where(part).groupBy("dims").applyInArrow(fitted, form).collect()
    return classes.sparkSession.sparkContext.broadcast({r["dims"]: (np.frombuffer(r["axis"], np.int64), np.frombuffer(r["value"], np.float64)) for r in rows})  # CELLS bounds it


#: Of a length whose sample came out empty.
ONE_CELL = (np.zeros(1, np.int64), np.zeros(1))


def placed(classes: DataFrame, shared: Broadcast) -> DataFrame:
    """Each class with its projection and its cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                own = b.filter(pa.array(dims == d))
                points = matrix(own.column(2).to_pylist()) @ projection(d // 8)
                ids = pa.array([np.array(x, np.int64).tobytes() for x in own.column(3).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*own.columns[:3], ids, pa.array(cells(points, shared.value.get(d, ONE_CELL))), pa.array([p.tobytes() for p in points], pa.binary())], ["id", "dims", "unit", "ids", "cell", "spot"])

    return cut(classes.select("id", "dims", "unit", "ids").mapInArrow(run, PLACED))


def indexed(classes: DataFrame) -> DataFrame:
    """The stored index: a row for each block of a cell, in the order of its leaves."""
    blocks = classes.groupBy("dims", "cell").agg(F.ceil(F.count("*") * F.col("dims") / BLOCK_BYTES).cast("int").alias("blocks"))
    members = classes.join(blocks, ["dims", "cell"]).withColumn("block", F.pmod(F.xxhash64("unit"), F.col("blocks")).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        spots = matrix(table.column("spot").to_pylist())
        depth = max(0, (-(-len(spots) // LEAF) - 1).bit_length())
        order = np.argsort(cells(spots, split(spots, depth)), kind="stable")
        units, ids = (table.column(c).take(pa.array(order)).to_pylist() for c in ("unit", "ids"))
        place = [table.column(c)[0].as_py() for c in ("dims", "cell", "block")]
        names, sizes = table.column("id").to_numpy()[order], np.array([len(x) // 8 for x in ids], np.int64)
        return pa.Table.from_batches([rows_of(INDEX, [(*place, b"".join(units), spots[order].tobytes(), names.tobytes(), b"".join(ids), sizes.tobytes())])])

    return cut(members.groupBy("dims", "cell", "block").applyInArrow(build, INDEX))


class Block:
    """A row of the index, opened."""

    def __init__(self, row: dict):
        self.units = np.frombuffer(row["units"], np.float64).reshape(-1, row["dims"] // 8)
        self.spots = np.frombuffer(row["spots"], np.float64).reshape(-1, AXES)
        self.names, self.ids, self.sizes = (np.frombuffer(row[c], np.int64) for c in ("names", "ids", "sizes"))
        self.owners = np.repeat(self.names, self.sizes)
        self.first = np.cumsum(self.sizes) - self.sizes
        starts = np.arange(0, len(self.spots), LEAF)
        self.low, self.high = np.minimum.reduceat(self.spots, starts), np.maximum.reduceat(self.spots, starts)

    def nearest(self, query: np.ndarray, spot: np.ndarray, reach: float, factor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The scores of the k best that the stopping test lets be found, and where their ids are. reach: squared distance that
        the k-th best has elsewhere."""
        far = apart(spot[None, :], self.low, self.high)[0]
        order = np.argsort(far, kind="stable")
        pool, held = np.zeros(0, np.int64), np.zeros(0)
        found, scores = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 1
        while at < len(order):
            own = order[at : at + step]
            at, step = at + step, step * 2
            rows = (own[:, None] * LEAF + np.arange(LEAF)).ravel()
            rows = rows[rows < len(self.spots)]
            pool, held = np.concatenate([pool, rows]), np.concatenate([held, ((self.spots[rows] - spot) ** 2).sum(1)])
            ring = far[order[at]] if at < len(order) else math.inf  # all that is nearer has been met
            limit = self.limit(reach, factor)
            ready = held <= min(ring, limit)
            some = pool[ready]
            pool, held = pool[~ready], held[~ready]
            close = some[self.units[some] @ query >= 1 - reach / 2 - ROUNDING]
            if len(close):
                score = (self.units[close] * query).sum(1)  # equal vectors get equal scores
                size = self.sizes[close]
                spread = np.repeat(self.first[close] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                found, scores = np.concatenate([found, spread]), np.concatenate([scores, np.repeat(score, size)])
                best = np.lexsort((self.ids[found], -scores))[:k]
                found, scores = found[best], scores[best]
                if len(found) == k:
                    reach = min(reach, max(0.0, 2 - 2 * scores[-1]))
            if ring > self.limit(reach, factor):
                break
        return scores, found

    @staticmethod
    def limit(reach: float, factor: float) -> float:
        """How far out in the projection a vector at this squared distance is looked for."""
        return math.inf if math.isinf(factor) or math.isinf(reach) else factor * reach + ROUNDING


def packs(asked: DataFrame, shared: Broadcast, factor: float, home: bool) -> DataFrame:
    """Queries in packs for each cell: that of their own (home), or all others in their reach. asked: id, dims, unit, cell,
    spot, reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                low, high = walls(shared.value.get(d, ONE_CELL))
                whole = b.filter(pa.array(dims == d))
                for at in range(0, whole.num_rows, PACK):
                    own = whole.slice(at, PACK)
                    names, cell, reach = own.column(0).to_numpy(), own.column(3).to_numpy(), own.column(5).to_numpy()
                    unit, spots = matrix(own.column(2).to_pylist()), matrix(own.column(4).to_pylist())
                    mine = cell[:, None] == np.arange(len(low))
                    limits = np.array([Block.limit(r, factor) for r in reach])
                    sent = mine if home else ~mine & (apart(spots, low, high) <= limits[:, None])
                    for c in np.flatnonzero(sent.any(0)).tolist():
                        some = sent[:, c]
                        yield rows_of(PACKED, [(d, c, names[some].tobytes(), unit[some].tobytes(), spots[some].tobytes(), reach[some].tobytes())])

    return asked.select("id", "dims", "unit", "cell", "spot", "reach").mapInArrow(run, PACKED)


def met(index: DataFrame, packed: DataFrame, factor: float, k: int) -> DataFrame:
    """The k + 1 best of each query in each block that its packs meet; blocks that many packs meet are copied for them."""
    packed = cut(packed.withColumn("salt", F.xxhash64("names")))
    parts = packed.groupBy("dims", "cell").agg(F.ceil(F.count("*") / PACKS).cast("int").alias("parts"))
    asked = packed.join(index.select("dims", "cell", F.col("block").alias("its_block")), ["dims", "cell"]).join(parts, ["dims", "cell"]).withColumn("part", F.pmod("salt", "parts").cast("int"))
    held = index.join(parts, ["dims", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = ["dims", "cell", "block", "part"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in each(iter(left.to_batches())):
            block = Block(row)
            for pack in each(iter(right.to_batches())):
                names, reach = np.frombuffer(pack["names"], np.int64), np.frombuffer(pack["reach"], np.float64)
                unit, spots = np.frombuffer(pack["units"], np.float64).reshape(len(names), -1), np.frombuffer(pack["spots"], np.float64).reshape(-1, AXES)
                for i, name in enumerate(names.tolist()):
                    scores, rows = block.nearest(unit[i], spots[i], float(reach[i]), factor, k + 1)
                    out += zip([name] * len(rows), scores.tolist(), block.ids[rows].tolist(), (block.owners[rows] == name).tolist(), strict=True)
        return pa.Table.from_batches([rows_of(FOUND, out)])

    asked = asked.select(F.col("dims").alias("its_dims"), F.col("cell").alias("its_cell"), "its_block", F.col("part").alias("its_part"), "names", "units", "spots", "reach")
    return held.groupBy(*key).cogroup(asked.groupBy(*(f"its_{c}" for c in key))).applyInArrow(run, FOUND)


def leading(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("rank") <= k + 1)


def answers(index: DataFrame, asked: DataFrame, shared: Broadcast, sure: float, k: int) -> DataFrame:
    """(name, rank, score, vec_id, own), the k + 1 best of each query's class, itself included. asked: as placed()."""
    factor = quantile(sure)
    first = cut(leading(met(index, packs(asked.withColumn("reach", F.lit(math.inf)), shared, factor, True), factor, k), k))
    reach = first.where(F.col("rank") == k + 1).select(F.col("name").alias("id"), F.greatest(F.lit(0.0), 2 - 2 * F.col("score")).alias("reach"))
    rest = asked.join(reach, "id", "left").withColumn("reach", F.coalesce("reach", F.lit(math.inf)))
    second = met(index, packs(rest, shared, factor, False), factor, k)
    return cut(leading(first.drop("rank").unionByName(second), k))


def recall(exact: DataFrame, found: DataFrame) -> float | None:
    """Part of the true k + 1 best (by score, so that equal ones stand for each other) that were found."""
    least = exact.groupBy("name").agg(F.min("score").alias("least"), F.count("*").alias("there"))
    got = least.join(found.select("name", "score", F.lit(1).alias("one")), "name", "left").where("one is null or score >= least - 1e-12")
    sums = got.groupBy("name").agg(F.first("there").alias("there"), F.least(F.first("there"), F.sum("one")).alias("n")).agg(F.sum("n"), F.sum("there")).first()
    return (sums[0] or 0) / sums[1] if sums[1] else None


def search(vectors: DataFrame, k: int = K) -> DataFrame:
    """The k nearest other rows of each row whose vec_id ASKED divides: query_id, rank, vec_id, score (cosine), recall (measured
    on about AUDITED of the queries, over the k + 1 best with the query itself).

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor does a null vec_id; a query
    finds vectors of its own length only. Equal scores go by ascending vec_id. Rows that repeat a vec_id are rows of their
    own: each such query leaves out one row of its id and vector, and has ranks of its own. Fewer than k where there are fewer
    candidates; an empty table gives an empty one. Only vec_id and embedding are read.
    """
    held = cut(units(vectors)).where("unit is not null and vec_id is not null")
    shared = trees(classes := classes_of(held, k))
    every = placed(classes, shared)
    index = indexed(every)
    asking = held.where(F.col("vec_id") % ASKED == 0)
    counts = cut(asking.groupBy("unit").agg(F.count("*").alias("rows")))
    asked = cut(every.join(counts.select("unit"), "unit", "left_semi"))
    total = asked.count()
    audited = cut(asked.where(F.pmod(F.xxhash64("unit", F.lit(31)), F.lit(max(1, total // AUDITED))) == 0))
    exact = None
    for sure in SURE:
        found = answers(index, asked, shared, sure, k)
        if exact is None:
            exact = answers(index, audited, shared, 1.0, k)
        measured = recall(exact, found)
        if measured is None or measured >= RECALL:
            break
    # an answer for each class of equal queries; each row then leaves itself out
    lists = found.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "vec_id", "own"))).alias("best"))
    by_class = asked.select("unit", F.col("id").alias("name")).join(lists, "name").join(counts, "unit").select("unit", "rows", "best")
    rows = beside(asking.select(F.col("vec_id").alias("query_id"), "unit"), cut(by_class), ["unit"], "rows")
    mine = F.expr("get(filter(best, x -> x.own and x.vec_id = query_id), 0).rank")
    others = F.filter("best", lambda x: mine.isNull() | (x["rank"] != mine))
    ranked = rows.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("r", "x"))
    return ranked.select("query_id", (F.col("r") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"), F.lit(measured).cast("double").alias("recall"))
