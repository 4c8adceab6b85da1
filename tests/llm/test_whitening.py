import numpy as np
import pytest

from rookery.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, component int, x binary"


def whitened(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, "n", 1, b"") for i, v in rows], SCHEMA)
    return whitening.whiten(frame, **options).toPandas().sort_values(["vec_id", "component"], na_position="last")


def brute(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(0)
    c = x - total / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return c @ u / np.sqrt(e), e / np.trace(c.T @ c / n), [int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total, strict=True))) for row in x]


def vectors(seed, n, dims, decay=0.9):
    g = np.random.default_rng(seed)
    return (g.standard_normal((n, dims)) * decay ** np.arange(dims) @ np.linalg.qr(g.standard_normal((dims, dims)))[0] + g.standard_normal(dims)).astype(np.float32).tolist()


def same(got, held, k=8):
    want, share, exact = brute(held, k)
    found = got.whitened.to_numpy().reshape(-1, k)
    assert np.abs(found * np.sign((found * want).sum(0)) - want).max() < 1e-8
    assert np.abs(got.explained.to_numpy()[:k] / share - 1).max() < 1e-10
    assert got.deviation.tolist() == [d for d in exact for _ in range(k)]
    assert set(got.n) == {len(held)} and got.component.tolist() == list(range(1, k + 1)) * len(held)
    assert got.identity_error.nunique() == 1 and 0 <= got.identity_error.iloc[0] < 1e-9


@pytest.mark.parametrize(("n", "dims", "decay"), [(400, 64, 0.97), (300, 64, 0.5), (500, 12, 0.9), (200, 96, 1.0)])
def test_components_equal_a_dense_solution(spark, n, dims, decay):
    """A slow and a fast decay, fewer dimensions than columns, and a flat spectrum."""
    held = vectors(n, n, dims, decay)
    same(whitened(spark, list(enumerate(held))), held)


def test_unusable_vectors_are_dropped_and_repeats_kept(spark):
    held = vectors(7, 120, 16)
    held += [held[0]] * 60
    bad = [None, [], [float("nan")] * 16, [float("inf"), *[0.0] * 15], [None, *[0.0] * 15], [3e38, *[0.0] * 15]]
    got = whitened(spark, [*enumerate(held), *((1000 + i, v) for i, v in enumerate(bad))])
    same(got, held)


def test_lengths_are_fitted_apart_and_ids_may_be_null(spark):
    a, b = vectors(8, 90, 16), vectors(9, 80, 10)
    got = whitened(spark, [*enumerate(a), *((1000 + i, v) for i, v in enumerate(b[:-1])), (None, b[-1])])
    same(got[got.vec_id < 1000], a)
    same(got[~(got.vec_id < 1000)], b)


def test_directions_without_variance_have_no_component(spark):
    flat = [[1.0, 2.0, 3.0]] * 5
    assert whitened(spark, list(enumerate(flat))).empty and whitened(spark, [(1, [1.0, 2.0])]).empty and whitened(spark, []).empty
    line = [[float(i), 2.0 * i, 5.0] for i in range(9)]
    got = whitened(spark, list(enumerate(line)))
    assert set(got.component) == {1} and np.isclose(got.explained, 1).all()
    assert np.isclose((got.whitened**2).mean(), 1)


def test_deviations_beyond_a_long_are_null_and_others_exact(spark):
    held = [[float(v)] for v in (1e9, 2e9, -3e9, 4)]
    got = whitened(spark, list(enumerate(held)))
    exact = brute(held, 1)[2]
    assert [None if np.isnan(v) else int(v) for v in got.deviation] == [None if v >= 1 << 63 else v for v in exact] and None in [None if v >= 1 << 63 else v for v in exact]


def test_sums_beyond_a_long(spark):
    """Exact sums in pieces, whatever their size."""
    frame = spark.createDataFrame([(i, [4e15, float(i)]) for i in range(9)], "vec_id long, embedding array<double>")
    model = whitening.fit(whitening.integers(frame))[2]
    assert model.total == [9 * (int(4e15 * 1024) + 100_000), sum(1024 * i + 100_000 for i in range(9))] and model.total[0] > 1 << 63
