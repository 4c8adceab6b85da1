import pytest
from pyspark.sql import functions as F

from rookery.functions import boards
from rookery.operators import moves

#: Published node counts to depth 3.
PERFT = {
    "startpos": (boards.START, 20, 400, 8902),
    "kiwipete": ("r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1", 48, 2039, 97862),
    "ep-and-pins": ("8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1", 14, 191, 2812),
    "castling": ("r3k2r/Pppp1ppp/1b3nbN/nP6/BBP1P3/q4N2/Pp1P2PP/R2Q1RK1 w kq - 0 1", 6, 264, 9467),
    "promotion": ("rnbq1k1r/pp1Pbppp/2p5/8/2B5/8/PPP1NnPP/RNBQK2R w KQ - 1 8", 44, 1486, 62379),
    "midgame": ("r4rk1/1pp1qppp/p1np1n2/8/2BPP3/P1N2N2/1P2QPPP/R4RK1 w - - 0 10", 44, 1591, 68174),
}


@pytest.fixture(scope="module")
def positions(spark):
    return boards.with_masks(spark.createDataFrame([(k, v[0]) for k, v in PERFT.items()], "name string, fen string")).drop("fen")


@pytest.mark.parametrize("depth", [1, 2])
def test_perft(positions, depth):
    got = {r["name"]: r["nodes"] for r in moves.perft(positions, "name", depth).collect()}
    assert got == {k: v[depth] for k, v in PERFT.items()}


def test_perft_to_depth_three(positions):
    got = {r["name"]: r["nodes"] for r in moves.perft(positions.where("name IN ('ep-and-pins', 'castling')"), "name", 3).collect()}
    assert got == {k: PERFT[k][3] for k in got} and len(got) == 2


def test_regressions(spark):
    def ucis(fen):
        return [r["uci"] for r in moves.legal(boards.with_masks(spark.createDataFrame([(fen,)], "fen string")).drop("fen")).collect()]

    found = ucis("r3k2r/p2pqpb1/bn2pnp1/1BpPN3/1p2P3/2N2Q1p/PPP1BPPP/R3K2R w KQkq c6 0 2")
    assert found.count("b5c6") == 1 or found.count("d5c6") == 1
    assert found.count("d5c6") == 1
    assert "e1g1" not in ucis("6k1/8/8/8/8/8/8/4R1K1 w - - 0 1") and ucis("6k1/8/8/8/8/8/8/4R1K1 w - - 0 1").count("e1c1") == 1
    after = moves.legal(boards.with_masks(spark.createDataFrame([("r3kN1r/8/8/8/8/8/8/4K3 b kq - 0 1",)], "fen string")).drop("fen")).where("uci = 'h8f8'")
    assert after.select("castling").first()[0] == 8


def test_endings(spark):
    rows = [("mate", "rnb1kbnr/pppp1ppp/8/4p3/6Pq/5P2/PPPPP2P/RNBQKBNR w KQkq - 1 3"), ("stale", "7k/5Q2/6K1/8/8/8/8/8 b - - 0 1"), ("start", boards.START)]
    got = {r["name"]: (r["legal_moves"], r["check"], r["ending"]) for r in moves.status(boards.with_masks(spark.createDataFrame(rows, "name string, fen string")).drop("fen"), "name").collect()}
    assert got == {"mate": (0, True, "checkmate"), "stale": (0, False, "stalemate"), "start": (20, False, None)}


def test_record_and_fen_round_trip(positions):
    rows = positions.withColumn("record", boards.record()).withColumn("fen", boards.to_fen()).select("name", "record", "fen", *moves.STATE)
    got = rows.collect()
    assert {r["name"]: r["fen"] for r in got} == {k: " ".join(v[0].split()[:4]) for k, v in PERFT.items()}
    assert all(len(r["record"]) == 67 for r in got)
    back = boards.from_record(rows.select("name", "record")).collect()
    assert {r["name"]: tuple(r[c] for c in moves.STATE) for r in back} == {r["name"]: tuple(r[c] for c in moves.STATE) for r in got}


def test_symmetries_are_involutions(positions):
    for turn in (boards.color_swapped, boards.file_reflected):
        once = turn(positions)
        assert sorted(map(str, turn(once).select("name", *moves.STATE).collect())) == sorted(map(str, positions.select("name", *moves.STATE).collect()))
        nodes = {r["name"]: r["nodes"] for r in moves.perft(boards.color_swapped(positions), "name", 1).collect()}
        assert nodes == {k: v[1] for k, v in PERFT.items()}
    keys = positions.withColumn("z", boards.zobrist()).select(F.count_distinct("z")).first()[0]
    assert keys == len(PERFT)
