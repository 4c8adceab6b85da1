import pytest
from pyspark.sql import functions as F

from rookery.operators import replay, search, storage, store

SCHEMA = "name string, moves array<string>, headers map<string,string>"


def played(spark, lines):
    games = spark.createDataFrame([(k, line.split(), {"white": k}) for k, line in lines], SCHEMA)
    return replay.played(games, "name").join(games.select("name", "headers").dropDuplicates(["name"]), "name")


def test_months_are_added_with_ids_that_go_on(spark, tmp_path):
    path = str(tmp_path / "star")
    first = [("a", "e4 e5 Nf3"), ("b", "e4 e5 Nf3"), ("c", "e4 c5"), ("bad", "e4 e4")]
    second = [("c", "e4 c5"), ("d", "Nf3 e5 e4"), ("e", "e4 c5"), ("f", ""), ("f", "e4")]
    assert storage.append(played(spark, first), "name", path).count() == 0
    before = {t: {tuple(str(x) for x in r) for r in df.collect()} for t, df in storage.read(spark, path).items()}
    refused = sorted(map(tuple, storage.append(played(spark, second), "name", path).collect()))
    assert ("c", "already_exists") in refused and ("f", "duplicate_in_batch") in refused
    tables = storage.read(spark, path)
    for t, df in tables.items():
        rows = df.collect()
        assert before[t] <= {tuple(str(x) for x in r) for r in rows}
        assert sorted(r["id"] for r in rows) == list(range(1, len(rows) + 1))
    assert {t: df.count() for t, df in tables.items()} == {"positions": 7, "games": 5, "occurrences": 4 + 3 + 4 + 1 + 2, "records": 6}
    assert store.integrity(tables["occurrences"]).count() == 0
    assert search.matches(tables["positions"], tables["occurrences"], tables["records"]).count() == 4 + 4 + 3 + 4 + 3 + 1
    # again, as after a run that was cut off
    storage.append(played(spark, second), "name", path)
    assert {t: df.count() for t, df in storage.read(spark, path).items()} == {t: df.count() for t, df in tables.items()}


def test_a_run_that_was_cut_off_is_completed(spark, tmp_path):
    """Positions and games are there, their occurrences and records aren't."""
    whole, part = str(tmp_path / "whole"), str(tmp_path / "part")
    games = played(spark, [("a", "e4 e5"), ("b", "d4")])
    storage.append(games, "name", whole)
    for t in ("positions", "games"):
        storage.read(spark, whole)[t].write.parquet(f"{part}/{t}")
    storage.append(games, "name", part)
    plain = lambda path: {t: sorted(str(r) for r in df.collect()) for t, df in storage.read(spark, path).items()}
    assert plain(part) == plain(whole)


def test_empty_and_missing_tables(spark, tmp_path):
    path = str(tmp_path / "none")
    assert all(df.count() == 0 for df in storage.read(spark, path).values())
    assert storage.append(played(spark, [("a", "e4")]).limit(0), "name", path).count() == 0
    assert all(df.count() == 0 for df in storage.read(spark, path).values())


def test_bucketed_tables_join_and_group_without_an_exchange(spark, tmp_path):
    p = spark.range(1, 400).select("id", (F.col("id") % 7).alias("material"))
    o = spark.range(5_000).selectExpr("id % 450 AS position_id", "IF(id % 11 = 0, NULL, concat('m', id % 5)) AS move")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        positions = storage.bucketed(p, "id", str(tmp_path / "p"), 8)
        played_moves = storage.bucketed(o, "position_id", str(tmp_path / "o"), 8, ["move"])
        got = storage.moves_of(positions.where("material < 3"), played_moves)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        plain = storage.moves_of(p.where("material < 3"), o)
        assert "Exchange" in plain._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_each_symmetry_has_a_scan_of_its_own_that_ends(spark):
    masks = [(0x100, 0x1000000000000), (0x8000, 0x80000000000000), (0x100, 0x80000000000000), (0x8000, 0x1000000000000), (0x200, 0x2000000000000)]
    held = spark.createDataFrame([(i, *masks[i % 5]) for i in range(300)], "id long, white long, black long")
    for at in (0, 2):
        asked = held.where(f"id = {at}")
        every = search.by_mode(held, asked, "structure_symmetries").where("id > 20").orderBy("id").limit(8)
        paged = search.symmetry_page(held, asked, 7, 20)
        assert [r["id"] for r in paged.collect()] == [r["id"] for r in every.select("id").collect()]
        plan = paged._jdf.queryExecution().executedPlan().toString()
        forms = search.structure_keys(asked, "structure_symmetries").count()
        assert plan.count("TakeOrderedAndProject(limit=8") == forms + 1 and forms in (2, 4)
    with pytest.raises(ValueError, match="invalid_limit"):
        search.symmetry_page(held, held.limit(1), 0)
    assert search.symmetry_page(held, held.limit(0), 3).count() == 0


def test_rows_are_counted_from_footers(spark):
    path = "/root/testdata/sf0.001/lineitem.parquet"
    got = storage.rows_of(spark, path)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.first()["rows"] == spark.read.parquet(path).count() and "PushedAggregation: [COUNT(*)]" in plan and "l_orderkey" not in plan
