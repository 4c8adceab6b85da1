from pyspark.sql import functions as F

from rookery.functions import boards
from rookery.operators import moves, replay, store
from rookery.sources import pgn

OPERA = "e4 e5 Nf3 d6 d4 Bg4 dxe5 Bxf3 Qxf3 dxe5 Bc4 Nf6 Qb3 Qe7 Nc3 c6 Bg5 b5 Nxb5 cxb5 Bxb5+ Nbd7 O-O-O Rd8 Rxd7 Rxd7 Rd1 Qe6 Bxd7+ Nxd7 Qb8+ Nxb8 Rd8#"
SPECIAL = "e4 a6 e5 d5 exd6 Nc6 dxc7 Nb4 cxd8=N Kxd8 Nf3 Bg4 Be2 Nf6 O-O"


def test_games_are_played_to_their_known_ends(spark):
    rows = [
        (1, OPERA.split(), None), (2, SPECIAL.split(), None), (3, "e4 e5 Ke3".split(), None), (4, None, None), (5, ["Rad1"], "4k3/8/8/8/8/8/4K3/R6R w - - 0 1"), (6, ["Ra1d1"], "4k3/8/8/8/8/8/8/R3K3 w - - 0 1"),
        (7, ["Nbd2"], "4k3/8/8/8/8/5N2/8/1N2K3 w - - 0 1"), (8, ["Nd2"], "4k3/8/8/8/8/5N2/8/1N2K3 w - - 0 1"), (9, ["O-O"], "4k3/8/8/8/8/8/5r2/4K2R w K - 0 1"), (10, ["e4"], "not a position"), (11, ["exd6"], "4k3/8/8/3pP3/8/8/8/4K3 w - d6 0 1"), (None, ["e4"], None),
    ]
    got = {r["id"]: r for r in replay.played(spark.createDataFrame(rows, "id int, moves array<string>, fen string").repartition(3), "id").collect()}
    assert {k: r["error"] for k, r in got.items()} == {1: None, 2: None, 3: "illegal_move_3", 4: None, 5: None, 6: "illegal_move_1", 7: None, 8: "illegal_move_1", 9: "illegal_move_1", 10: "bad_start", 11: None, None: None}
    assert got[1]["moves"] == OPERA.split() and got[2]["moves"] == SPECIAL.split() and len(got[3]["records"]) == 3
    assert got[2]["uci"][8:9] == ["c7d8n"] and got[2]["uci"][-1] == "e1g1"
    ends = spark.createDataFrame([(k, bytes(r["records"][-1])) for k, r in got.items() if k in (1, 2, 11)], "id int, record binary")
    fens = {r["id"]: r["fen"] for r in boards.from_record(ends).select("id", boards.to_fen().alias("fen")).collect()}
    assert fens == {1: "1n1Rkb1r/p4ppp/4q3/4p1B1/4P3/8/PPP2PPP/2K5 b k -", 2: "r2k1b1r/1p2pppp/p4n2/8/1n4b1/5N2/PPPPBPPP/RNBQ1RK1 b - -", 11: "4k3/8/3P4/8/8/8/8/4K3 b - -"}


def test_every_position_follows_by_a_legal_move(spark):
    games = replay.played(spark.createDataFrame([(1, OPERA.split()), (2, SPECIAL.split())], "id int, moves array<string>"), "id")
    rows = replay.positions(games, "id")
    step = boards.from_record(rows.where("move is not null"))
    after = moves.legal(step.select("id", "ply", *moves.STATE)).select("id", (F.col("ply") + 1).alias("ply"), boards.record().alias("record"))
    reached = rows.where("ply > 0").join(after, ["id", "ply", "record"], "left_semi").count()
    assert reached == rows.where("ply > 0").count() == len(OPERA.split()) + len(SPECIAL.split())
    assert store.integrity(rows.select(F.col("id").alias("game_id"), "ply", "move")).count() == 0


def test_lenient_text_and_game_files(spark):
    text = '[Event "x"]\n[Result "1-0"]\n\n1. e4! {good} e5 2. 0-0 *'
    held = pgn.framed(spark.createDataFrame([("f", text)], "file string, pgn string"))
    assert replay.played(held, "file").first()["error"] == "illegal_move_3"
    one = spark.createDataFrame([(1, ["Ra1d1"], "4k3/8/8/8/8/8/8/R3K3 w - - 0 1")], "id int, moves array<string>, fen string")
    assert replay.played(one, "id", strict=False).first()["moves"] == ["Rd1"]
    assert replay.played(one.limit(0), "id").count() == 0


def test_moves_made_are_the_different_prefixes(spark):
    """Each prefix of moves is made once in a range, whatever the number of games that share it, and refused moves too."""
    texts = [OPERA, SPECIAL, OPERA[:40], "e4 e5 Nf3", "e4 e5 Nf3", "e4 e5 Ke3", "e4 e5 Ke3 d5", "e4 e5 Ke2", "", "d4"]
    rows = [(i, t.split(), None) for i, t in enumerate(texts * 3)] + [(99, "e4 e5".split(), boards.START), (98, "Kd1".split(), "4k3/8/8/8/8/8/8/4K3 w - - 0 1"), (97, None, "4k3/8/8/8/8/8/8/4K3 w - - 0 1")]
    games = spark.createDataFrame(rows, "id int, moves array<string>, fen string")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    got = replay.walked(games, "id").collect()
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = replay.walked(games, "id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    tried = {tuple(m[:n]) for t in texts for m in [t.split()] for n in range(1, len(m) + 1)} - {("e4", "e5", "Ke3", "d5")}
    assert sum(r["made"] for r in one) == len(tried) + 1
    assert sum(r["made"] for r in got) >= len(tried) + 1
    plain = lambda rows: sorted((r["id"], r["records"], r["moves"], r["uci"], r["error"]) for r in rows if r["error"] is None)
    assert plain(got) == plain(one) and sorted(r["id"] for r in got) == sorted(r[0] for r in rows)
    assert {r["error"] for r in got if rows[r["id"] if r["id"] < 97 else 0][1] in ("e4 e5 Ke3".split(), "e4 e5 Ke3 d5".split())} == {"illegal_move_3"}


def test_first_positions_are_read_once_and_the_usual_one_never(spark):
    plain = replay.started(spark.createDataFrame([(1, ["e4"])], "id int, moves array<string>"))
    assert "aggregate" not in plain._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plain.select(F.hex("record")).first()[0] == replay.FIRST
