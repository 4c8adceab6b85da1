"""Near-duplicate vectors over a robust-pruned flat graph.

Centroids fitted on a bounded sample cut the vectors into overlapping shards, and
large shards into blocks. Each block builds a robust-pruned neighbour graph; a
vector's adjacency lists are united over its shards. Every vector is then searched
for in its home shard: greedily from the medoids, and from there through all that is
in or near its range. Cosines that count are verified in double precision, recall is
audited against brute force on a stated query set, and the overlap grows if it lacks.
If the largest overlap lacks as well, every vector is compared with all that can be in its range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import rows_of
from ._common import beside, cut
from ._components import components

COSINE = 0.95
#: Vectors that the centroids are fitted on, and centroids, at most; vectors per centroid and per block aimed at.
SAMPLE, CENTROIDS, PER_CENTROID, PER_BLOCK = 16_384, 4_096, 1_000, 4_096
#: Shards that a vector belongs to at first; doubled while the audit falls short of RECALL, to OVERLAPS at most. After that, exhaustive().
OVERLAP, OVERLAPS, RECALL = 4, 16, 0.99
#: Out-degree within a shard, candidates for it, and the prune's factor on distances.
DEGREE, CANDIDATES, ALPHA = 24, 64, 1.2
#: Width of the greedy search, and how far below the threshold a range still expands.
BEAM, SLACK = 24, 0.06
#: Vectors with a copy (or themselves) whose id this divides are the audit's queries.
AUDITED = 50

#: Vectors sent to a ball in one row, and the slack in angles that covers their rounding.
PACK, ROUNDING = 512, 1e-6

UNIT = "vec_id long, unit binary"
FOUND = "id long, n long, m long, a long, b long"
SUMS = "found long, there long, shares double, queries long"
SENT = "dims int, shard int, block int, ids binary, units binary, id long, n long, m long, a long, b long"


def units(vectors: DataFrame) -> DataFrame:
    """vec_id and the vector at length 1 in double precision; null where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column(1).to_pylist():
                ok = v is not None and len(v) and None not in v
                x = np.array(v, np.float64) if ok else np.zeros(0)
                ok = ok and bool(np.isfinite(x).all())
                if ok:
                    top = np.abs(x).max()
                    x = x / top if top else x
                    norm = float(np.sqrt(x @ x))
                out.append((x / norm).tobytes() if ok and norm > 0 else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["vec_id", "unit"])

    return vectors.selectExpr("cast(vec_id as long) vec_id", "embedding").mapInArrow(run, UNIT)


def matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means."""
    spread = np.random.default_rng(11).permutation(len(sample))[:k]
    c = sample[np.sort(spread)]
    for _ in range(rounds):
        near = np.concatenate([np.argmax(sample[i : i + 2048] @ c.T, 1) for i in range(0, len(sample), 2048)])
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-300), c)
    return c


def pruned(v: np.ndarray) -> np.ndarray:
    """Robust pruning: of each vector's nearest, keep the next unless one kept is nearer to it by ALPHA. -1 fills rows."""
    n, near = len(v), min(CANDIDATES, len(v) - 1)
    out = np.full((n, DEGREE), -1, np.int64)
    for begin in range(0, n, 512):
        s = v[begin : begin + 512] @ v.T
        s[np.arange(len(s)), np.arange(begin, begin + len(s))] = -2
        top = np.argpartition(-s, near - 1, 1)[:, :near] if near else np.zeros((len(s), 0), np.int64)
        for r in range(len(s)):
            c = top[r][np.argsort(-s[r, top[r]], kind="stable")]
            far = np.sqrt(np.maximum(0, 2 - 2 * s[r, c]))
            among = np.sqrt(np.maximum(0, 2 - 2 * v[c] @ v[c].T))
            alive, kept = np.ones(len(c), bool), 0
            for i in range(len(c)):
                if alive[i]:
                    out[begin + r, kept] = c[i]
                    kept += 1
                    if kept == DEGREE:
                        break
                    alive &= ALPHA * among[i] > far
    return out


def entries(v: np.ndarray, count: int = 8) -> np.ndarray:
    """The medoid, and points far from those before."""
    mean = v.mean(0)
    found = [int(np.argmax(v @ mean))]
    nearest = v @ v[found[0]]
    while len(found) < min(count, len(v)):
        found.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, v @ v[found[-1]])
    return np.array(found)


def searched(query: np.ndarray, v: np.ndarray, adjacent: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Rows of v within COSINE of query that the graph reaches. A beam goes down to the best it finds; then whatever is
    in range, or SLACK below, passes the search on to its neighbours."""
    seen = np.zeros(len(v) + 1, bool)
    seen[-1] = True  # stands for no neighbour
    spread = np.zeros(len(v) + 1, bool)
    seen[begin] = True
    beam, score = begin, v[begin] @ query
    low = COSINE - SLACK
    inside: list[np.ndarray] = [beam[score >= low]]
    while True:
        turn = beam[~spread[beam]]
        if not len(turn):
            break
        spread[turn] = True
        new = np.unique(adjacent[turn])
        new = new[~seen[new]]
        seen[new] = True
        s = v[new] @ query
        inside.append(new[s >= low])
        beam, score = np.concatenate([beam, new]), np.concatenate([score, s])
        if len(beam) > BEAM:
            top = np.argpartition(-score, BEAM)[:BEAM]
            beam, score = beam[top], score[top]
    turn = np.concatenate(inside)
    found = [turn]
    while len(turn := turn[~spread[turn]]):
        spread[turn] = True
        new = np.unique(adjacent[turn])
        new = new[~seen[new]]
        seen[new] = True
        turn = new[v[new] @ query >= low]
        found.append(turn)
    return np.concatenate(found)


def near(vectors: DataFrame) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links (other rows with cosine COSINE or more), component_id (least
    vec_id reached by links, its own included), kept (vec_id = component_id), overlap and recall (of the audit, null where it
    has no link to find; where the last overlap falls short of RECALL, links and recall are those of exhaustive()).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor does a vector
    with another number of components. Equal vectors are searched for once, and repeated rows are vectors of their own, as
    are different ones of the same vec_id: these link and have components by themselves. A null vec_id takes no part. An empty table gives an empty one. Only
    vec_id and embedding are read.
    """
    spark = vectors.sparkSession
    held = cut(units(vectors))
    some = held.where("unit is not null and vec_id is not null")
    classes = cut(some.groupBy("unit").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.max(F.col("vec_id") % AUDITED == 0).alias("audited")).withColumn("dims", F.octet_length("unit")))
    # classes are numbered by their least vec_id, or by their place in the cut table where that names several
    named = classes.groupBy("least").count().where("count > 1").isEmpty()
    classes = classes.withColumn("id", F.col("least")) if named else cut(classes.withColumn("id", F.monotonically_increasing_id()))
    overlap, exact = OVERLAP, False
    while True:
        links, edges = exhaustive(classes) if exact else linked(classes, overlap)
        found = classes.join(links.groupBy("id").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "id", "left").select("id", "least", "unit", "dims", "audited", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))
        found = cut(found)
        recall = audit(found)
        if recall is None or recall >= RECALL or exact:
            break
        exact = overlap >= OVERLAPS
        overlap = overlap if exact else overlap * 2
    parts = components(edges).withColumnRenamed("node", "id")
    if not named:
        parts = cut(parts.join(found.select("id", "least"), "id"))
        sums = cut(parts.groupBy("component").agg(F.min("least").alias("first"), F.count("*").alias("nodes")))
        parts = beside(parts.select("id", "component"), sums, ["component"], "nodes").select("id", F.col("first").alias("component"))
    by_class = found.join(parts, "id", "left").select("unit", "n", "copies", F.coalesce("component", "least").alias("component_id"))
    linkable = F.col("unit").isNotNull() & F.col("vec_id").isNotNull()
    rows = beside(held.where(linkable), cut(by_class), ["unit"], "copies").select("vec_id", "n", "component_id")
    rows = rows.unionByName(held.where(~linkable).select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("component_id")))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    return rows.select("vec_id", F.col("n").cast("long").alias("n_links"), "component_id", kept.alias("kept"), F.lit(overlap).alias("overlap"), F.lit(recall).cast("double").alias("recall"))


def fitted(classes: DataFrame) -> Broadcast:
    """Centroids by dims, each length's fitted in a task of its own on about SAMPLE vectors by hash."""
    sums = classes.groupBy("dims").agg(F.count("*").alias("total"))  # a row for each length of vectors
    part = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) < F.lit(float(SAMPLE)) / F.col("total") * (1 << 30)

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        v, total = matrix(table.column("unit").to_pylist()), table.column("total")[0].as_py()
        return pa.Table.from_batches([rows_of("dims int, centroids binary", [(table.column("dims")[0].as_py(), centroids(v, max(1, min(CENTROIDS, len(v), -(-total // PER_CENTROID)))).tobytes())])])

    rows = classes.select("id", "dims", "unit").join(F.broadcast(sums), "dims").where(part).groupBy("dims").applyInArrow(fit, "dims int, centroids binary").collect()
    return classes.sparkSession.sparkContext.broadcast({r["dims"]: np.frombuffer(r["centroids"], np.float64).reshape(-1, r["dims"] // 8) for r in rows})  # CENTROIDS bounds it


def linked(classes: DataFrame, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(id, n: copies of others linked, m: different ones, found in a block) and edges (a, b) that connect what is linked. A
    pair counts for both, also where only one is in the other's home shard."""
    shared = fitted(classes)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                c = shared.value.get(int(d), np.zeros((1, int(d) // 8)))
                own = b.filter(pa.array(dims == d))
                s = matrix(own.column(2).to_pylist()) @ c.T
                k = min(overlap, len(c))
                top = np.argpartition(-s, k - 1, 1)[:, :k]
                home = np.argmax(s, 1)
                at = np.repeat(np.arange(len(s)), k)
                columns = [own.column(i).take(pa.array(at)) for i in range(4)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(top.ravel().astype(np.int32)), pa.array(top.ravel() == home[at]), pa.array(home[at].astype(np.int32)), pa.array([x.tobytes() for x in top.astype(np.int32)], pa.binary()).take(pa.array(at))], ["id", "dims", "unit", "copies", "shard", "home", "home_shard", "shards"])

    dealt = classes.select("id", "dims", "unit", "copies").mapInArrow(assign, "id long, dims int, unit binary, copies long, shard int, home boolean, home_shard int, shards binary")
    dealt = cut(dealt)
    blocks = dealt.groupBy("dims", "shard").agg(F.ceil(F.count("*") / PER_BLOCK).cast("int").alias("blocks"))
    members = dealt.join(blocks, ["dims", "shard"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        order = np.argsort(ids)
        v = matrix([table.column("unit")[int(i)].as_py() for i in order])
        ids = ids[order]
        return pa.Table.from_batches([rows_of("id long, near binary", [(int(i), ids[row[row >= 0]].tobytes()) for i, row in zip(ids, pruned(v), strict=True)])])

    graph = members.groupBy("dims", "shard", "block").applyInArrow(build, "id long, near binary").groupBy("id").agg(F.collect_list("near").alias("near"))
    placed = members.join(graph, "id")
    asked = members.where("home").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["dims", "shard", "block", "id", "unit", "copies", "home_shard", "shards"]
    both = placed.select(*columns, "near").unionByName(asked.select(*columns, F.lit(None).cast("array<binary>").alias("near")))

    def search(table: pa.Table) -> pa.Table:
        query = np.array(table.column("near").is_null())
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        own = np.flatnonzero(~query)
        own = own[np.argsort(ids[own])]
        names, weights, homes = ids[own], copies[own], table.column("home_shard").to_numpy()[own]
        # what finds a member over a border, and so isn't in its home shard to be found by it
        n_back, m_back = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        v = matrix([table.column("unit")[int(i)].as_py() for i in own])
        lists = [np.frombuffer(b"".join(table.column("near")[int(i)].as_py()), np.int64) for i in own]
        spots = [np.searchsorted(names, x) for x in lists]
        spots = [s[(s < len(names))] [names[s[s < len(names)]] == x[s < len(names)]] for s, x in zip(spots, lists, strict=True)]
        # an edge goes both ways
        a = np.concatenate([np.repeat(np.arange(len(spots)), [len(s) for s in spots]), *spots]).astype(np.int64)
        b = np.concatenate([*spots, np.repeat(np.arange(len(spots)), [len(s) for s in spots])]).astype(np.int64)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b = a[fresh], b[fresh]
        first = np.searchsorted(a, np.arange(len(v) + 1))
        adjacent = np.full((len(v), max(1, int(np.diff(first).max(initial=0)))), len(v), np.int64)
        adjacent[a, np.arange(len(a)) - first[a]] = b
        begin = entries(v)
        parent: dict[int, int] = {}

        def root(i: int) -> int:
            while parent.setdefault(i, i) != i:
                parent[i] = i = parent[parent[i]]
            return i

        rows = []
        for q in np.flatnonzero(query).tolist():
            x, i = np.frombuffer(table.column("unit")[q].as_py(), np.float64), int(ids[q])
            got = searched(x, v, adjacent, begin)
            got = got[(v[got] * x).sum(1) >= COSINE]
            got = got[names[got] != i]
            rows.append((i, int(weights[got].sum()), len(got), None, None))
            over = got[~np.isin(homes[got], np.frombuffer(table.column("shards")[q].as_py(), np.int32))]
            n_back[over] += copies[q]
            m_back[over] += 1
            for j in names[got].tolist():
                if root(i) != root(j):
                    rows.append((None, None, None, i, j))
                    parent[root(j)] = root(i)
        rows += [(int(names[j]), int(n_back[j]), int(m_back[j]), None, None) for j in np.flatnonzero(m_back).tolist()]
        return pa.Table.from_batches([rows_of(FOUND, rows)])

    out = cut(both.groupBy("dims", "shard", "block").applyInArrow(search, FOUND))
    return out.where("id is not null").select("id", "n", "m"), out.where("id is null").select("a", "b")


def exhaustive(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same as linked(), with nothing missed. The blocks of the home shards are balls of angles; a vector links with all
    of a ball that lies within its range, with none of one outside, and is sent to each other ball to be compared with all
    its members. Counts leave a block, and edges that connect, but no pairs."""
    spark = classes.sparkSession
    shared = fitted(classes)
    reach = float(np.arccos(COSINE))
    begin = "id long, dims int, unit binary, copies long"

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                own = b.filter(pa.array(dims == d))
                home = np.argmax(matrix(own.column(2).to_pylist()) @ shared.value.get(int(d), np.zeros((1, int(d) // 8))).T, 1)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(home.astype(np.int32))], ["id", "dims", "unit", "copies", "shard"])

    homes = cut(classes.select("id", "dims", "unit", "copies").mapInArrow(settle, f"{begin}, shard int"))
    blocks = homes.groupBy("dims", "shard").agg(F.ceil(F.count("*") / PER_BLOCK).cast("int").alias("blocks"))
    members = homes.join(blocks, ["dims", "shard"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def measure(table: pa.Table) -> pa.Table:
        v, ids = matrix(table.column("unit").to_pylist()), table.column("id").to_numpy()
        mean = v.mean(0)
        center = mean / np.linalg.norm(mean) if np.linalg.norm(mean) > 1e-9 else v[0]
        radius = float(np.arccos(np.clip(v @ center, -1, 1)).max())
        place = [table.column(c)[0].as_py() for c in ("dims", "shard", "block")]
        return pa.Table.from_batches([rows_of("dims int, shard int, block int, center binary, radius double, copies long, size long, id long", [(*place, center.tobytes(), radius, int(table.column("copies").to_numpy().sum()), len(ids), int(ids.min()))])])

    rows = members.groupBy("dims", "shard", "block").applyInArrow(measure, "dims int, shard int, block int, center binary, radius double, copies long, size long, id long").orderBy("dims", "shard", "block").collect()
    balls = {d: [r for r in rows if r["dims"] == d] for d in {r["dims"] for r in rows}}
    balls = spark.sparkContext.broadcast({d: (np.array([(r["shard"], r["block"], r["copies"], r["size"], r["id"]) for r in of], np.int64), matrix([r["center"] for r in of]), np.array([r["radius"] for r in of])) for d, of in balls.items()})

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                about, centers, radius = balls.value[d]
                own = b.filter(pa.array(dims == d))
                for at in range(0, own.num_rows, PACK):
                    part = own.slice(at, PACK)
                    ids, v = part.column(0).to_numpy(), matrix(part.column(2).to_pylist())
                    angle = np.arccos(np.clip(v @ centers.T, -1, 1))
                    whole = angle + radius <= reach - ROUNDING
                    some = ~whole & (angle - radius <= reach + ROUNDING)
                    out = [(d, None, None, None, None, i, n, m, None, None) for i, (n, m) in zip(ids.tolist(), (whole @ about[:, 2:4]).tolist(), strict=True) if n]
                    out += [(d, None, None, None, None, None, None, None, a, c) for a, c in spanning(whole, ids, about[:, 4])]
                    for j in np.flatnonzero(some.any(0)).tolist():
                        out.append((d, *about[j, :2].tolist(), ids[some[:, j]].tobytes(), v[some[:, j]].tobytes(), None, None, None, None, None))
                        if len(out) >= 16:
                            yield rows_of(SENT, out)
                            out = []
                    yield rows_of(SENT, out)

    sent = cut(members.select("id", "dims", "unit", "copies").mapInArrow(send, SENT))
    asked = sent.where("ids is not null").select("dims", "shard", "block", "ids", "units", F.xxhash64("ids").alias("salt"))
    parts = asked.groupBy("dims", "shard", "block").agg(F.ceil(F.count("*") / 32).cast("int").alias("parts"))
    asked = asked.join(parts, ["dims", "shard", "block"]).withColumn("part", F.pmod("salt", "parts").cast("int"))
    held = members.join(parts, ["dims", "shard", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = asked.select("dims", "shard", "block", "part", "ids", "units", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("copies"))
    both = both.unionByName(held.select("dims", "shard", "block", "part", F.lit(None).cast("binary").alias("ids"), F.col("unit").alias("units"), "id", "copies"))

    def compare(table: pa.Table) -> pa.Table:
        own = table.filter(table.column("id").is_valid())
        names, weights, v = own.column("id").to_numpy(), own.column("copies").to_numpy(), matrix(own.column("units").to_pylist())
        out = []
        for r in table.filter(table.column("ids").is_valid()).select(["ids", "units"]).to_batches(1):
            ids = np.frombuffer(r.column(0)[0].as_py(), np.int64)
            x = np.frombuffer(r.column(1)[0].as_py(), np.float64).reshape(len(ids), -1)
            s = x @ v.T
            hit = s >= COSINE
            for i, j in np.argwhere(np.abs(s - COSINE) < 1e-12):
                hit[i, j] = (v[j] * x[i]).sum() >= COSINE  # the same from both sides
            out += [(i, n, m, None, None) for i, n, m in zip(ids.tolist(), (hit @ weights).tolist(), hit.sum(1).tolist(), strict=True) if n]
            out += [(None, None, None, a, c) for a, c in spanning(hit, ids, names)]
        return pa.Table.from_batches([rows_of(FOUND, out)])

    out = cut(both.groupBy("dims", "shard", "block", "part").applyInArrow(compare, FOUND).unionByName(sent.where("ids is null").select("id", "n", "m", "a", "b")))
    counted = out.where("id is not null").groupBy("id").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).join(classes.select("id", "copies"), "id")
    return counted.select("id", (F.col("n") - F.col("copies")).alias("n"), (F.col("m") - 1).alias("m")), out.where("id is null").select("a", "b")


def spanning(hit: np.ndarray, ids: np.ndarray, names: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect each of ids with the names that its row of hit has."""
    label, out = np.arange(len(names)), []
    for i, row in zip(ids.tolist(), hit, strict=True):
        roots = np.unique(label[row])
        out += [(i, int(names[r])) for r in roots]
        if len(roots) > 1:
            label[np.isin(label, roots)] = roots[0]
    return out


def audit(found: DataFrame) -> float | None:
    """Recall of m over the audited classes, each against all classes, in blocks: of links between different vectors,
    whatever their copies, over all of them or as the mean of the queries that have any, whichever is less; None if there
    is no link to be found. found: id, unit, dims, audited, m."""

    def packed(df: DataFrame, size: int) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            blob = b"".join(table.column("unit").to_pylist())
            return pa.Table.from_batches([rows_of("dims int, units binary, m binary", [(table.column("dims")[0].as_py(), blob, table.column("m").to_numpy().astype(np.int64).tobytes())])])

        rows = df.count()
        return df.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-rows // size))))).groupBy("dims", "part").applyInArrow(run, "dims int, units binary, m binary").withColumn("number", F.monotonically_increasing_id())

    queries = cut(packed(found.where("audited"), 512))
    rows = cut(packed(found, 8_192)).select("dims", "units")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                q, v = (np.frombuffer(r[c], np.float64).reshape(-1, r["dims"] // 8) for c in ("q_units", "units"))
                hit = q @ v.T >= COSINE
                yield rows_of("number long, hits binary", [(r["number"], hit.sum(1).astype(np.int64).tobytes())])

    pairs = rows.join(queries.select("dims", "number", F.col("units").alias("q_units")), "dims").mapInArrow(count, "number long, hits binary")

    def total(table: pa.Table) -> pa.Table:
        hits = sum(np.frombuffer(h, np.int64) for h in table.column("hits").to_pylist()) - 1
        m = np.frombuffer(table.column("m")[0].as_py(), np.int64)
        got, some = np.minimum(m, hits), hits > 0
        return pa.Table.from_batches([rows_of(SUMS, [(int(got.sum()), int(hits.sum()), float((got[some] / hits[some]).sum()), int(some.sum()))])])

    sums = pairs.join(queries.select("number", "m"), "number").groupBy("number").applyInArrow(total, SUMS).agg(*[F.sum(c) for c in ("found", "there", "shares", "queries")]).first()
    return min(sums[0] / sums[1], sums[2] / sums[3]) if sums[1] else None
