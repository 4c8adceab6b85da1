"""Whitening of vectors by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance come from passes over the data alone: a
pass makes X'XQ of the centred vectors X, block by block. A Chebyshev polynomial of
the covariance, by its three-term recurrence, damps the part of the spectrum that
isn't wanted; QR and Rayleigh-Ritz follow, until the residuals certify the pairs. The
driver holds arrays of (components of a vector) times (columns of Q) only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import each, rows_of
from ._common import cut, partitions
from ._sums import partials, summed

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Columns beside the wanted ones; the residual (relative to the largest eigenvalue) that certifies a pair; the largest
#: degree of a filter, and the ratio by which it may raise the first column over the last wanted one.
GUARD, CERTIFIED, DEGREE, SPREAD = 24, 1e-13, 24, 1e7
#: Rounds after which pairs count as certified as far as rounding lets them be.
ROUNDS = 60
#: Below this part of the largest an eigenvalue is rounding, and has no component.
RANK = 1e-12
BLOCK_BYTES, PART_BYTES = 4 << 20, 64 << 20
#: Entries beyond are as unusable as infinite ones: their integers would not fit a long.
LARGEST = float(1 << 62)

PACKED = "dims long, n long, ids binary, named binary, x binary"
PIECES = (42, 21, 0)  # a long in three pieces, whose sums fit


@dataclass
class Model:
    """What fit() finds for vectors of one length. total: exact sums of the n integer vectors; vectors: unit eigenvectors as
    columns, by falling values; trace: of the covariance; residual: largest of the pairs, relative to the first value."""

    n: int
    total: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    rounds: int

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """total = n * quotient + rest"""
        pairs = [divmod(s, self.n) for s in self.total]
        return np.array([q for q, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        quotient, rest = self.parts()
        return (x - quotient).astype(np.float64) - rest / self.n


def integers(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Stored blocks of the vectors as integers, floor(SCALE * entry) + SHIFT, of one length each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def block(dims: int) -> pa.RecordBatch:
            ids, named, x = (np.concatenate(a) for a in zip(*held.pop(dims), strict=True))
            return rows_of(PACKED, [(dims, len(ids), ids.tobytes(), named.tobytes(), x.tobytes())])

        for b in batches:
            column = b.column(1)
            lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten().cast(pa.float64())
            entries = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            with np.errstate(over="ignore"):
                whole = np.floor(SCALE * entries)
            bad = np.append(0, np.cumsum(~(np.abs(whole) < LARGEST)))
            usable = (bad[ends] == bad[ends - lengths]) & (lengths > 0)
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            named = np.asarray(b.column(0).is_valid())
            for dims in np.unique(lengths[usable]).tolist():
                own = np.flatnonzero(usable & (lengths == dims))
                step = max(1, BLOCK_BYTES // (8 * dims))
                for at in range(0, len(own), step):
                    some = own[at : at + step]
                    x = whole[(ends - lengths)[some][:, None] + np.arange(dims)].astype(np.int64) + SHIFT
                    held.setdefault(dims, []).append((ids[some], named[some], x))
                    if sum(len(a[0]) for a in held[dims]) >= step:
                        yield block(dims)
        for dims in list(held):
            yield block(dims)

    return cut(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, PACKED))


def matrix(row: dict) -> np.ndarray:
    return np.frombuffer(row["x"], np.int64).reshape(row["n"], row["dims"])


def gathered(held: DataFrame) -> tuple[DataFrame, int]:
    """held in fewer, larger partitions, and their number: a pass costs a task for each."""
    size = held.agg(F.coalesce(F.sum(F.octet_length("x")), F.lit(0))).first()[0]
    parts = min(held.rdd.getNumPartitions(), max(partitions(held.sparkSession), -(-size // PART_BYTES)))
    return held.coalesce(max(1, parts)), max(1, parts)


def fit(held: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each length of vectors among the blocks of integers()."""
    blocks, parts = gathered(held)

    def sums(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for row in each(batches):
            x = matrix(row)
            low = (1 << 21) - 1
            own = np.stack([x >> 42, (x >> 21) & low, x & low]).sum(1).ravel()
            out[row["dims"]] = out.get(row["dims"], 0) + np.append(own, row["n"])
        return out

    models: dict[int, Model] = {}
    for dims, flat in summed(partials(blocks, sums), parts, np.int64).items():
        pieces, n = flat[:-1].reshape(3, dims), int(flat[-1])
        total = [sum(int(p) << shift for p, shift in zip(column, PIECES, strict=True)) for column in pieces.T]
        models[dims] = Model(n, total, np.zeros(0), np.zeros((dims, 0)), 0.0, 0.0, 0)

    def squares(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for row in each(batches):
            c = models[row["dims"]].centred(matrix(row))
            out[row["dims"]] = out.get(row["dims"], 0) + np.array([(c * c).sum()])
        return out

    for dims, value in summed(partials(blocks, squares), parts).items():
        models[dims].trace = float(value[0]) / models[dims].n

    def applied(columns: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """The covariance times the columns, for each length, in one pass."""

        def run(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
            out: dict[int, np.ndarray] = {}
            for row in each(batches):
                if row["dims"] in columns:
                    c = models[row["dims"]].centred(matrix(row))
                    out[row["dims"]] = out.get(row["dims"], 0) + (c.T @ (c @ columns[row["dims"]])).ravel()
            return out

        got = summed(partials(blocks, run), parts)
        return {d: got[d].reshape(q.shape) / models[d].n for d, q in columns.items()}

    active = {d: np.linalg.qr(np.random.default_rng(12).standard_normal((d, min(d, components + GUARD))))[0] for d, m in models.items() if m.trace > 0}
    least = dict.fromkeys(active, np.inf)
    stuck = dict.fromkeys(active, 0)
    for rounds in range(1, ROUNDS + 1):
        if not active:
            break
        product, plan = applied(active), {}
        for d, q in list(active.items()):
            small = q.T @ product[d]
            theta, u = np.linalg.eigh((small + small.T) / 2)
            theta, u = theta[::-1], u[:, ::-1]
            vectors, image = q @ u, product[d] @ u
            k = min(components, len(theta))
            residual = float(np.linalg.norm(image - vectors * theta, axis=0)[:k].max() / theta[0])
            stuck[d] = stuck[d] + 1 if residual > least[d] / 2 else 0
            least[d] = min(least[d], residual)
            model = models[d]
            model.values, model.vectors, model.residual, model.rounds = theta[:k].copy(), vectors[:, :k].copy(), residual, rounds
            # rounding ends the descent a little above or below the bound, as n and the length of vectors grow
            if residual <= CERTIFIED or (stuck[d] >= 3 and residual <= CERTIFIED * 100):
                del active[d]
            else:
                plan[d] = (vectors, image, theta, k)
        if plan:
            active = {d: np.linalg.qr(y)[0] for d, y in filtered(applied, plan).items()}
    else:
        late = {d: models[d].residual for d in active}
        raise ArithmeticError(f"eigenvectors without a certificate, residuals by length: {late}")
    for m in models.values():
        some = m.values > RANK * m.values[0] if len(m.values) else np.zeros(0, bool)
        m.values, m.vectors = m.values[some], m.vectors[:, some]
    return models


def filtered(applied, plan: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, int]]) -> dict[int, np.ndarray]:
    """Columns under a Chebyshev polynomial that stays small from 0 to the last Ritz value and grows above. The first product is
    known from Rayleigh-Ritz."""
    state, done = {}, {}
    for d, (x, image, theta, k) in plan.items():
        edge = max(theta[-1], 1e-8 * theta[0])
        half = edge / 2
        first, last = (np.arccosh(max(1.0, (t - half) / half)) for t in (theta[0], theta[k - 1]))
        degree = int(np.clip(np.log(SPREAD) / max(first - last, 1e-9), 2, DEGREE))
        sigma = half / (theta[0] - half)
        state[d] = [degree, half, sigma, 2 / sigma, x, (image - half * x) * (sigma / half)]
    step = 1
    while state:
        for d in [d for d, s in state.items() if s[0] <= step]:
            done[d] = state.pop(d)[5]
        product = applied({d: s[5] for d, s in state.items()}) if state else {}
        for d, s in state.items():
            _, half, sigma, tau, x, y = s
            new = 1 / (tau - sigma)
            s[2], s[4], s[5] = new, y, (product[d] - half * y) * (2 * new / half) - (sigma * new) * x
        step += 1
    return done


def deviations(x: np.ndarray, model: Model) -> list[int | None]:
    """sum((n x - S)^2) of each row, exact; None where a long can't hold it."""
    quotient, rest = model.parts()
    moved = x - quotient
    largest = int(np.abs(moved).max(initial=0)) + 1
    if (model.n * largest) ** 2 * x.shape[1] < 1 << 63:
        return ((model.n * moved - rest) ** 2).sum(1).tolist()
    exact = ((model.n * moved.astype(object) - rest.astype(object)) ** 2).sum(1)
    return [int(v) if v < 1 << 63 else None for v in exact]


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """A row for each usable row of vectors and component: vec_id, component (from 1, by falling eigenvalue), n, deviation,
    whitened, explained, identity_error.

    Vectors that are null, empty, or hold null, non-finite or too large entries are dropped. Vectors of another length are fitted
    for themselves, each length over all of its vectors. Directions in which nothing varies (as where all vectors are equal)
    have no component, so that there may be fewer than asked, or no row. A deviation that a long can't hold is null.
    Repeated rows are rows of their own, and a null vec_id stays null. An empty table gives an empty one. Only vec_id and the
    vector are read.
    """
    held = integers(vectors, vector)
    models = fit(held, components)
    blocks, parts = gathered(held)

    def moments(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for row in each(batches):
            m = models[row["dims"]]
            if len(m.values):
                w = m.centred(matrix(row)) @ m.vectors / np.sqrt(m.values)
                out[row["dims"]] = out.get(row["dims"], 0) + np.concatenate([(w.T @ w).ravel(), w.sum(0)])
        return out

    error = {}
    for d, flat in summed(partials(blocks, moments), parts).items():
        k, n = len(models[d].values), models[d].n
        mean = flat[k * k :] / n
        error[d] = float(np.abs(flat[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(batches):
            m, ids, named = models[row["dims"]], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["named"], bool)
            k, x = len(m.values), matrix(row)
            for at in range(0, row["n"] if k else 0, 4_096):
                part = x[at : at + 4_096]
                w = m.centred(part) @ m.vectors / np.sqrt(m.values)
                size = len(part)
                columns = [
                    pa.array(np.repeat(ids[at : at + size], k), pa.int64(), mask=np.repeat(~named[at : at + size], k)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * k, m.n)),
                    pa.array(deviations(part, m), pa.int64()).take(pa.array(np.repeat(np.arange(size), k))),
                    pa.array(w.ravel()),
                    pa.array(np.tile(m.values / m.trace, size)),
                    pa.array(np.full(size * k, error[row["dims"]])),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return held.mapInArrow(run, f"{OUT}, identity_error double")
