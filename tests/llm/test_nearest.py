import numpy as np
import pytest

from rookery.llm import nearest

SCHEMA = "vec_id long, embedding array<float>, rank string, score int, unit binary, dims string"


def found(spark, rows, k=5):
    got = nearest.search(spark.createDataFrame([(i, v, "r", 1, b"", "d") for i, v in rows], SCHEMA), k)
    return got.select("query_id", "rank", "vec_id", "score", "recall").toPandas().sort_values(["query_id", "rank", "vec_id"])


def usable(v):
    return v is not None and len(v) > 0 and None not in v and np.isfinite(np.array(v, np.float32)).all() and np.any(np.array(v, np.float32))


def brute(rows, k=5):
    rows = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if i is not None and usable(v)]
    out = {}
    for at, (q, x) in enumerate(rows):
        if q % 50 == 0:
            scores = [(-float((x / np.linalg.norm(x) * (y / np.linalg.norm(y))).sum()), i) for j, (i, y) in enumerate(rows) if j != at and len(y) == len(x)]
            out[q] = sorted((round(s, 12), i) for s, i in scores)[:k]
    return out


def clustered(seed, n, dims=24):
    g = np.random.default_rng(seed)
    return (g.standard_normal((max(1, n // 40), dims))[g.integers(0, max(1, n // 40), n)] + 0.3 * g.standard_normal((n, dims))).astype(np.float32).tolist()


@pytest.mark.parametrize("spread", ["clusters", "noise"])
def test_recall_over_several_cells(spark, spread, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_BYTES", 16 << 10)  # cells of the driver's plan; workers split alike
    g = np.random.default_rng(5)
    held = list(enumerate(clustered(4, 3_000) if spread == "clusters" else g.standard_normal((3_000, 24)).astype(np.float32).tolist()))
    got, want = found(spark, held), brute(held)
    assert set(got.query_id) == set(want) and (got.groupby("query_id").size() == 5).all()
    hits = sum(v in {i for _, i in want[q]} for q, v in zip(got.query_id, got.vec_id, strict=True))
    assert hits >= 0.9 * 5 * len(want) and got.recall.iloc[0] >= 0.9
    true = dict(held)
    for q, v, s in zip(got.query_id, got.vec_id, got.score, strict=True):
        a, b = (np.array(true[i], np.float64) for i in (q, v))
        assert abs(s - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12 and q != v


def test_few_rows_are_searched_whole(spark):
    """Fewer candidates than asked for, unusable rows, lengths, ties and copies."""
    g = np.random.default_rng(6)
    held = [(i, g.standard_normal(6).astype(np.float32).tolist()) for i in range(0, 40)]
    held += [(100 + i, held[3][1]) for i in range(12)] + [(200, held[3][1]), (201, [2 * x for x in held[5][1]])]
    held += [(250, [1.0, 2.0]), (251, [2.0, 1.0]), (300, [1.0, 1.0, 1.0])]
    held += [(350, None), (400, []), (450, [0.0] * 6), (500, [float("nan")] * 6), (550, [None, *[1.0] * 5]), (None, held[0][1])]
    got, want = found(spark, held), brute(held)
    assert {q: [(round(-s, 12), v) for s, v in zip(d.score, d.vec_id, strict=True)] for q, d in got.groupby("query_id")} == {q: w for q, w in want.items() if w}
    assert got.groupby("query_id")["rank"].apply(list).map(lambda r: r == list(range(1, len(r) + 1))).all()


def test_repeated_ids_are_rows_of_their_own(spark):
    """Each row leaves out one row of its id and vector."""
    held = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0]), (7, [1.0, 1.0])]
    got = found(spark, held)
    assert len(got) == 9 and got.groupby("rank").size().tolist() == [3, 3, 3]
    assert sorted(got[got["rank"] == 1].score.round(6)) == [0.707107, 1.0, 1.0]


def test_a_hot_vector_fills_no_class(spark):
    held = [(i, [1.0, 2.0, 3.0]) for i in range(3_000)] + [(3_000 + i, [1.0, 2.0, 3.0 + i]) for i in range(60)]
    got = found(spark, held)
    first = got[got.query_id < 3_000]
    assert len(first) == 300 and all(v == ([i for i in range(6) if i != q][:5]) for q, v in first.groupby("query_id").vec_id.apply(list).items())


def test_empty_table(spark):
    assert found(spark, []).empty and found(spark, [(1, [1.0])]).empty and found(spark, [(50, [1.0])]).empty


def test_chi_square_quantiles():
    """Published values for twelve degrees of freedom."""
    assert [round(nearest.quantile(p), 3) for p in (0.5, 0.95, 0.99)] == [11.340, 21.026, 26.217]
