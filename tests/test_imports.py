import random

import pytest
from pyspark.sql import functions as F

from rookery.operators import imports
from rookery.streaming import ingest

SCHEMA = "source string, number long, record_id string, fault string, group long, imported string"


def table(spark, rows):
    return spark.createDataFrame([(s, n, r, f, 7, "x") for s, n, r, f in rows], SCHEMA.replace("group long, imported string", "taken long, extra string"))


def one_by_one(rows, stored, size, skip):
    """Each source's games in order, until one can't be taken."""
    added, outcomes = set(), {}
    for source in {r[0] for r in rows}:
        seen, malformed, stop, n = set(), 0, (None, None, None), 0
        for _, number, record, fault in sorted((r for r in rows if r[0] == source), key=lambda r: r[1]):
            if fault and skip:
                malformed += 1
                continue
            error = "invalid_game" if fault else "invalid_record_id" if not record else "duplicate_record_id" if record in seen else "record_exists" if record in stored else None
            if error:
                stop = (number, error, fault)
                break
            seen.add(record)
            n += 1
            added.add((source, number, record, (n - 1) // size + 1))
        outcomes[source] = (n, -(-n // size), malformed, *stop)
    return added, outcomes


@pytest.mark.parametrize(("skip", "size"), [(False, 10), (True, 3), (True, 1)])
def test_strict_imports_equal_one_by_one(spark, skip, size):
    r = random.Random(size)
    rows = []
    for source in ["a", "b", "c", None, "late"]:
        for n in range(1, 60):
            kind = r.random()
            rows.append((source, n, f"{source}{n}" if kind > 0.06 else r.choice(["", None, f"{source}{max(1, n - 2)}", "stored"]), "bad_move" if r.random() < 0.05 else None))
    rows = [x if x[0] != "late" or x[1] > 57 else (*x[:2], f"late{x[1]}", None) for x in rows] + [("one", 1, None, "no_moves"), ("other", 1, "x", None)]
    got, outcomes = imports.strict(table(spark, rows), spark.createDataFrame([("stored",), ("stored",), (None,)], "record_id string"), size, skip)
    added, expected = one_by_one(rows, {"stored"}, size, skip)
    assert {(x["source"], x["number"], x["record_id"], x["group"]) for x in got.collect()} == added and got.count() == len(added)
    assert {x["source"]: (x["imported"], x["groups"], x["malformed"], x["index"], x["error"], x["detail"]) for x in outcomes.collect()} == expected


def test_strict_bounds(spark):
    none = spark.createDataFrame([], "record_id string")
    for size in (0, 11):
        with pytest.raises(ValueError, match="invalid_batch_size"):
            imports.strict(table(spark, []), none, size)
    rows, outcomes = imports.strict(table(spark, []), none)
    assert rows.count() == outcomes.count() == 0


def test_places_run_over_parts(spark):
    held = spark.range(45_000).selectExpr("id % 2 AS s", "id * 3 AS n")
    got = imports.running(held, "s", "n", "place").groupBy("s").agg(F.count("*"), F.min("place"), F.max("place"), F.count_distinct("place"), F.max(F.abs(F.col("place") - F.expr("n div 6 + 1")))).collect()
    assert sorted(map(tuple, got)) == [(0, 22_500, 1, 22_500, 22_500, 0), (1, 22_500, 1, 22_500, 22_500, 0)]


def test_results_keep_the_order_and_fail_whole(spark):
    incoming = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "number int, record_id string")
    added = spark.createDataFrame([("a", 10), ("b", 11), ("c", 12)], "record_id string, id int")
    none = spark.createDataFrame([], "number int, error string")
    assert [tuple(r) for r in imports.results(incoming, added, none).collect()] == [(1, "a", 10, None), (2, "b", 11, None), (3, "c", 12, None)]
    bad = spark.createDataFrame([(2, "illegal_move_4")], "number int, error string")
    assert [tuple(r) for r in imports.results(incoming, added, bad).collect()] == [(1, "a", None, None), (2, "b", None, "illegal_move_4"), (3, "c", None, None)]


def test_backfills_reach_the_same_table_through_failures(spark, tmp_path):
    rows = spark.range(1, 251).selectExpr("id", "id * 2 AS v")
    none = spark.createDataFrame([], "id long")

    def run(path, broken, steps=None, failed=none, limit=40):
        read = lambda: spark.read.parquet(path) if (tmp_path / path.rsplit("/", 1)[1]).exists() else spark.createDataFrame([], "id long, v long")
        make = lambda chunk: (chunk.where(~F.col("id").isin(*broken)), chunk.where(F.col("id").isin(*broken)))
        return imports.backfill(rows, "id", make, read, lambda done: done.write.mode("append").parquet(path), failed, limit, steps)

    one, other, third = (str(tmp_path / n) for n in ("one", "other", "third"))
    mark, failed = run(one, [])
    assert mark == 250 and failed.count() == 0
    mark, failed = run(other, [7, 90, 91], steps=3)  # cut off after three steps, with failures
    assert mark == 120 and sorted(r[0] for r in failed.collect()) == [7, 90, 91]
    mark, failed = run(other, [200], failed=failed)  # goes on, and leaves the failed ones alone
    assert sorted(r[0] for r in failed.collect()) == [7, 90, 91, 200]
    run(other, [], failed=none)  # all can be made now
    run(third, [], limit=1_000)
    plain = lambda path: sorted(map(tuple, spark.read.parquet(path).collect()))
    assert plain(one) == plain(other) == plain(third) == [(i, 2 * i) for i in range(1, 251)]
    with pytest.raises(ValueError, match="too_many_failures"):
        run(one, [], failed=spark.range(imports.REMEMBERED + 1))


def test_syncs_go_on_where_they_ended(spark):
    rows = [("a", n // 3, f"g{n:02}") for n in range(20)] + [("b", n, f"h{n}") for n in range(4)] + [(None, 1, "x"), ("a", None, "y"), ("a", 1, None)]
    exports = spark.createDataFrame([(*r, "pgn") for r in rows], "source string, at long, id string, page string").drop("page")
    cursors, seen = spark.createDataFrame([], "source string, at long, id string"), []
    for refused in (None, "a", None, None, None):
        taken, cursors = imports.synced(exports, cursors, 2, 3, spark.createDataFrame([(refused,)], "source string") if refused else None)
        own = taken.collect()
        assert all(len([r for r in own if r["source"] == s]) <= 6 for s in "ab") and all(1 <= r["page"] <= 3 for r in own)
        seen.append(sorted(r["id"] for r in own if r["source"] == "a"))
        cursors = spark.createDataFrame(cursors.collect(), cursors.schema)
    assert [len(s) for s in seen] == [6, 0, 6, 6, 2] and sum(seen, []) == [f"g{n:02}" for n in range(20)]
    assert sorted(map(tuple, cursors.collect())) == [("a", 6, "g19"), ("b", 3, "h3")]


def game(n):
    return f'[Event "{n}"]\n[Result "1-0"]\n\n1. e4 e5 1-0\n\n'


def test_streams_drop_what_comes_again_and_let_state_go(spark, tmp_path):
    source, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    source.mkdir()
    (source / "a.pgn").write_text(game(1) + game(2))
    (source / "b.pgn").write_text(game(2) + game(3))
    ingest.ingest(spark, str(source), target, checkpoint, within="1 second").awaitTermination()
    assert spark.read.parquet(target).count() == 3
    import os
    import time

    time.sleep(3)
    (source / "late.pgn").write_text(game(4) + game(1))  # an old file, and a game that comes again after its state went
    os.utime(source / "late.pgn", (1_000_000_000, 1_000_000_000))
    for extra in ("late", "c"):
        if extra == "c":
            time.sleep(3)
            (source / "c.pgn").write_text(game(5) + game(5) + game(3))
        run = ingest.ingest(spark, str(source), target, checkpoint, within="1 second")
        run.awaitTermination()
    assert sorted(r["headers"]["event"] for r in spark.read.parquet(target).collect()) == ["1", "2", "3", "4", "5"]
    state = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert state and state[-1] < state[0]  # the first games' state went; the target alone keeps them from being added again
