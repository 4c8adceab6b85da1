import numpy as np
import pytest

from rookery.llm import neardup

SCHEMA = "vec_id long, embedding array<float>, label int, id long, shard int"


def brute(rows):
    ids = [i for i, _ in rows]
    good = {i: np.array(v, float) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))}
    keys = sorted(good)
    x = np.array([good[k] / np.linalg.norm(good[k]) for k in keys])
    hit = x @ x.T >= 0.95
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in zip(*np.nonzero(hit), strict=True):
        p, q = sorted((root(keys[a]), root(keys[b])))
        parent[q] = p
    n = dict(zip(keys, (hit.sum(1) - 1).tolist(), strict=True))
    return {i: (n.get(i, 0), root(i), root(i) == i) for i in ids}


def test_against_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(60, 24))
    rows = [(i, (base[i % 60] + 0.12 * r.normal(size=24) * (i % 3)).astype(np.float32).tolist()) for i in range(900)]
    rows += [(2000 + i, rows[5][1]) for i in range(50)]
    rows += [(3000, None), (3001, [0.0] * 24), (3002, [None] * 24), (3003, [float("nan")] * 24), (3004, [float("inf")] * 24), (3005, []), (3006, (base[0] * 1e30).tolist())]
    df = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], SCHEMA).repartition(4)
    got = neardup.near(df).collect()
    assert {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in got} == brute([r for r in rows])
    assert got[0]["recall"] == pytest.approx(1.0)


def test_empty(spark):
    assert neardup.near(spark.createDataFrame([], SCHEMA)).count() == 0


def results(got):
    return {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in got}


def test_short_recall_at_the_last_overlap_ends_in_an_exhaustive_search(spark, monkeypatch):
    for name, value in {"OVERLAP": 1, "OVERLAPS": 1, "PER_CENTROID": 20, "PER_BLOCK": 16}.items():
        monkeypatch.setattr(neardup, name, value)
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=3).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, (np.array([1, 2, 3]) + 0.01 * r.normal(size=3)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(2000 + i, rows[7][1]) for i in range(5)] + [(3000 + i, r.normal(size=2).tolist()) for i in range(60)] + [(4000, None)]
    got = neardup.near(spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], SCHEMA).repartition(4)).collect()
    want = {4000: (0, 4000, True)}
    for size in (2, 3):
        want |= brute([x for x in rows if x[1] and len(x[1]) == size])
    assert results(got) == want
    assert got[0]["overlap"] == 1 and got[0]["recall"] == pytest.approx(1.0)


def test_the_audit_counts_links_between_different_vectors(spark):
    unit = lambda *v: (np.array(v, float) / np.linalg.norm(v)).tobytes()
    # a large class of copies; two vectors close to each other, whose link was not found; one that has its link with the large class
    rows = [(1, unit(1, 0, 0), True, 4999, 1), (2, unit(0, 1, 0), True, 0, 0), (3, unit(0, 1, 0.1), False, 0, 0), (4, unit(1, 0.1, 0), True, 5000, 1)]
    found = spark.createDataFrame([(i, u, 24, 5000 if i == 1 else 1, a, n, m) for i, u, a, n, m in rows], "id long, unit binary, dims int, copies long, audited boolean, n long, m long")
    assert neardup.audit(found) == pytest.approx(2 / 3)


def test_queries_are_all_classes_with_an_audited_row(spark, monkeypatch):
    held = []
    monkeypatch.setattr(neardup, "audit", lambda found: held.extend(found.where("audited").collect()) or 1.0)
    rows = [(i, [1.0, float(i // 10)]) for i in (41, 42, 50, 61, 62, 103, 108, 150)] + [(151, [0.0, 1.0])]
    rows += [(200, [1.0, 10.0])]  # a copy of 103
    neardup.near(spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], SCHEMA)).count()
    assert sorted(x["id"] for x in held) == [50, 103, 150]


def test_pairs_over_borders_count_on_both_sides(spark, monkeypatch):
    # shards of 20 degrees; of two vectors in range at least one is in the other's home shard, and often only one is
    angle = np.radians(np.arange(0, 360, 20))
    monkeypatch.setattr(neardup, "centroids", lambda sample, k: np.stack([np.cos(angle), np.sin(angle)], 1))
    for name, value in {"OVERLAP": 2, "OVERLAPS": 2, "RECALL": 0}.items():
        monkeypatch.setattr(neardup, name, value)
    a = np.random.default_rng(7).uniform(0, 2 * np.pi, 400)
    rows = [(i, [float(np.cos(x)), float(np.sin(x))]) for i, x in enumerate(a)]
    rows += [(1000 + i, rows[i % 9][1]) for i in range(40)]
    got = neardup.near(spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], SCHEMA).repartition(4)).collect()
    assert got[0]["overlap"] == 2 and got[0]["recall"] == pytest.approx(1.0)
    assert results(got) == brute([(i, np.array(v, np.float32).tolist()) for i, v in rows])


def test_many_lengths_repeated_rows_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PER_CENTROID", 5)
    r = np.random.default_rng(9)
    rows = []
    for size in range(2, 82):
        base = r.normal(size=size)
        rows += [(len(rows) + i, (base + (0 if i < 2 else 0.02 * i) * r.normal(size=size)).tolist()) for i in range(6)]
    df = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in [*rows, rows[3], (None, rows[3][1]), (None, None)]], SCHEMA).repartition(3)
    got = neardup.near(df).collect()
    want = {}
    for size in range(2, 82):
        # the repeated row is a vector of its own
        want |= brute([x for x in rows if len(x[1]) == size])
    more = {i for i in want if len(rows[i][1]) == 2 and i != 3 and np.dot(rows[i][1], rows[3][1]) / np.linalg.norm(rows[i][1]) / np.linalg.norm(rows[3][1]) >= 0.95}
    want = {i: (n + (i in more) + (i == 3), c, k) for i, (n, c, k) in want.items()}
    assert len(got) == len(rows) + 3 and results(x for x in got if x["vec_id"] is not None) == want
    assert {(x["n_links"], x["component_id"]) for x in got if x["vec_id"] is None} == {(0, None)}


def test_nothing_to_find(spark):
    axes = [(i, np.eye(8)[i].tolist(), 0, 1, 2) for i in range(8)]
    got = neardup.near(spark.createDataFrame(axes, SCHEMA)).collect()
    assert {(x["n_links"], x["recall"]) for x in got} == {(0, None)}


def test_a_vec_id_for_different_vectors(spark):
    """Each is a row of its own: its links and its component are those of its vector."""
    r = np.random.default_rng(13)
    base = r.normal(size=(12, 16))
    rows = [(100 + i // 3, (base[i % 12] + 0.02 * r.normal(size=16)).astype(np.float32).tolist()) for i in range(240)]
    rows += [(7, rows[1][1]), (7, rows[5][1]), (7, rows[5][1])]
    got = neardup.near(spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], SCHEMA).repartition(4)).collect()
    own = brute([(n, v) for n, (_, v) in enumerate(rows)])
    least = {}
    for n, (_, root, _) in own.items():
        least[root] = min(least.get(root, rows[n][0]), rows[n][0])
    want = sorted((rows[n][0], links, least[root], rows[n][0] == least[root]) for n, (links, root, _) in own.items())
    assert sorted((x["vec_id"], x["n_links"], x["component_id"], x["kept"]) for x in got) == want
