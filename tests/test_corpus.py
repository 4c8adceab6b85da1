import pytest
from pyspark.sql import functions as F

from rookery.functions import boards
from rookery.operators import corpus, moves, replay, search, store

LINES = {"a": "e4 e5 Nf3", "b": "e4 e5 Nf3", "c": "e4 c5", "d": "Nf3 e5 e4", "e": "e4 e4"}


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(k, line.split(), {"white": k, "result": "1-0", "white_elo": "2300", "black_elo": "2100", "date": "2024.01.02"}) for k, line in LINES.items()]
    games = spark.createDataFrame(rows, "name string, moves array<string>, headers map<string,string>")
    done = replay.played(games, "name").join(games.select("name", "headers"), "name")
    return {k: v.cache() for k, v in corpus.star(done, "name").items()}


def test_star(tables):
    count = {k: v.count() for k, v in tables.items()}
    assert count == {"positions": 7, "games": 3, "occurrences": 11, "records": 4}  # both orders of 1.e4 e5 2.Nf3 end in one position
    for df in tables.values():
        ids = sorted(r["id"] for r in df.select("id").collect())
        assert ids == list(range(1, len(ids) + 1))
    assert store.integrity(tables["occurrences"]).count() == 0
    found = search.matches(tables["positions"], tables["occurrences"], tables["records"])
    assert found.count() == 4 + 4 + 3 + 4
    start = tables["positions"].orderBy(F.desc(F.expr("bit_count(white_pawns)")), "id").first()
    assert start["white_pawns"] == 0xFF00 or bin(start["white_pawns"]).count("1") == 8


def test_moves_are_filled_in(spark, tables):
    games = spark.createDataFrame([(1, ["x", "y"])], "id int, moves array<string>")
    o = spark.createDataFrame([(1, 0, None), (1, 1, "kept"), (1, 2, None), (2, 0, None)], "game_id int, ply int, move string")
    assert sorted(map(tuple, corpus.backfilled_moves(o, games).select("game_id", "ply", "move").collect()), key=str) == [(1, 0, "x"), (1, 1, "kept"), (1, 2, None), (2, 0, None)]


def test_openings(spark):
    lines = spark.createDataFrame([("C20", "King's pawn", ["e4", "e5"]), ("C40", "Knight", ["e4", "e5", "Nf3"]), ("A04", "Other way", ["Nf3", "e5", "e4"]), ("X", "None", ["e5"])], "eco string, name string, moves array<string>")
    got = {(r["eco"], r["name"], r["plies"]) for r in corpus.openings(lines).collect()}
    assert got == {("C20", "King's pawn", 2), ("A04", "Other way", 3)}  # of equal lengths the first by code


def test_faults(spark):
    cases = {
        boards.START: None,
        "8/8/8/8/8/8/8/K6k w - - 0 1": None,
        "8/8/8/8/8/8/8/Kk6 w - - 0 1": "adjacent_kings",
        "8/8/8/8/8/8/8/K7 w - - 0 1": "kings",
        "k7/8/8/8/8/8/8/K6P w - - 0 1": "pawn_rank",
        "k6R/8/8/8/8/8/8/K7 w - - 0 1": "opponent_in_check",
        "k6R/8/8/8/8/8/8/K7 b - - 0 1": None,
        "4k3/8/8/8/8/8/8/4K3 w K - 0 1": "castling",
        "k7/8/8/8/8/8/PPPPPPPP/KQQ5 w - - 0 1": "promotions",
    }
    p = boards.with_masks(spark.createDataFrame([(f,) for f in cases], "name string").withColumn("fen", F.col("name"))).drop("fen")
    assert {r["name"]: r["fault"] for r in moves.validated(p).select("name", "fault").collect()} == cases


def test_filters(tables):
    n = lambda **asked: tables["records"].where(search.filters(F.col("metadata"), asked)).count()
    assert (n(), n(player="A"), n(player="A", color="black"), n(result="1-0"), n(result="0-1")) == (4, 1, 0, 4, 0)
    assert (n(min_rating=2000), n(min_rating=2200), n(since="2024.01.01", until="2024.02.01"), n(since="2025")) == (4, 0, 4, 0)
    with pytest.raises(ValueError, match="unknown"):
        n(colour="x")
