import random

import pytest
from pyspark.sql import functions as F

from rookery.sources import pgn
from rookery.streaming import ingest

GAME = """[Event "Rated {speed} game"]
[White "Del\\"ta"]
[Black "Epsilon"]
[Result "{result}"]
[WhiteElo "{w}"]
[BlackElo "{b}"]
[TimeControl "{tc}"]
[ECO "C20"]

1. e4 {{a [%clk 0:03:00] note}} e5 (1... c5 2. Nf3 (2. c3) d6) 2. Ke2!? $6 Ke7 {result}
"""
#: Ratings and clocks with what a floor of 2200 without bullet keeps.
CASES = [(2300, 2250, "180+0", "Blitz", "1-0", True), (2300, 2100, "300+0", "Blitz", "0-1", False), (2500, 2400, "60+0", "Bullet", "1/2-1/2", False), (2200, 2345, "600+5", "Rapid", "1/2-1/2", True)]


@pytest.fixture
def path(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pgn").write_text("\n".join(GAME.format(w=w, b=b, tc=tc, speed=s, result=r) for w, b, tc, s, r, _ in CASES))
    return tmp_path / "in"


def test_framing_headers_and_filter(spark, path):
    games = pgn.framed(pgn.read(spark, str(path)))
    rows = games.collect()
    assert len(rows) == 4 and all(r["error"] is None for r in rows)
    assert rows[0]["moves"] == ["e4", "e5", "Ke2", "Ke7"]
    assert rows[0]["headers"]["white"] == 'Del"ta' and rows[0]["headers"]["white_elo"] and rows[0]["headers"]["eco"] == "C20"
    kept = pgn.kept(games, 2200).collect()
    assert sorted(int(r["headers"]["white_elo"]) for r in kept) == [w for w, *_, ok in sorted(CASES) if ok]
    assert pgn.kept(games, 2200, allow_bullet=True).count() == 3


def test_malformed(spark):
    text = GAME.format(w=1, b=1, tc="600+0", speed="Rapid", result="1-0")
    rows = [("ok", text), ("two", text + "\n" + text), ("after", text + "e4"), ("none", '[Event "x"]\n\n*'), ("bare", "1. e4 e5"), ("bad", text.replace("Ke2!?", "Kx")), ("fen", text.replace("[ECO", '[FEN "8/8/8/8/8/8/8/8 w - - 0 1"]\n[ECO')), ("long", text.replace("note", "n" * 100_001)), ("empty", "")]
    got = {r["k"]: r["error"] for r in pgn.framed(spark.createDataFrame(rows, "k string, pgn string")).collect()}
    assert got == {"ok": None, "two": "several_games", "after": "content_after_result", "none": "no_moves", "bare": "no_headers", "bad": "bad_move", "fen": "setup_without_fen", "long": "too_long", "empty": "no_headers"}


def test_annotations(spark):
    rows = spark.createDataFrame([(1, GAME.format(w=1, b=1, tc="600+0", speed="Rapid", result="1-0"))], "id int, pgn string")
    got = [(r["kind"], r["value"]) for r in pgn.annotations(rows, "id").orderBy("place", "kind").collect()]
    assert got == [("clock", "0:03:00"), ("comment", "a  note"), ("nag", "6")]


def test_openings_and_provider(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("eco\tname\tpgn\nC20\tKing's Pawn\t1. e4 e5\nX\tNothing\t*\n")
    assert [tuple(r) for r in pgn.openings(spark, str(tmp_path / "a.tsv")).collect()] == [("C20", "King's Pawn", ["e4", "e5"])]
    (tmp_path / "b.json").write_text('{"id": "q", "moves": "e4 e5"}\n{"pgn": "1. d4"}\n{"url": "u", "pgn": "1. c4"}\n')
    assert sorted(tuple(r) for r in pgn.provider(spark, str(tmp_path / "b.json")).collect()) == [("q", "e4 e5"), ("u", "1. c4")]


def test_stream_equals_batch_and_runs_again(spark, path, tmp_path):
    target, check = str(tmp_path / "out"), str(tmp_path / "check")
    ingest.ingest(spark, str(path), target, check, 2200).awaitTermination()
    assert spark.read.parquet(target).count() == 2
    (path / "b.pgn").write_text((path / "a.pgn").read_text() + "\n" + GAME.format(w=2600, b=2600, tc="900+0", speed="Rapid", result="0-1"))
    ingest.ingest(spark, str(path), target, check, 2200).awaitTermination()
    got = spark.read.parquet(target)
    assert got.count() == 3 and got.select("record_id").distinct().count() == 3


def test_faults_of_one_text_are_those_of_frames(spark):
    r = random.Random(7)
    heads = ['[Event "x"]\n\n'] * 4 + ['[SetUp "1"]\n\n', '[set_up "1"]\n[Fen\t"8/8 w"]\n', '[SetUp "0"]\r\n[Event "q\\"x"]\r\n', "", "  [", '[FEN "a]\n']
    bits = ["(", ")", "{", "}", "$3", "0-0", "e3e.p.!", "1.", "1...", "1. ", '\n[Event "y"]\n', "* ", "1-0 ", "\x85", "\u2028", "\x1c", ";x} \n", "\r", "h3!? ", "N1f3+", "Zz9", "é", "({c})", '[x "', "0-0-0!?"]
    texts = {r.choice(heads) + "1. e4 " + "".join(r.choice(bits) + " " * r.randrange(2) for _ in range(r.randrange(5))) + " e5 *" for _ in range(1_500)}
    texts |= {'[Event "x"]\n\n*', '[Event "x"]\n\n' + "(" * 25 + "a3" + ")" * 25 + " e4", ""}
    rows = pgn.framed(spark.createDataFrame([(t,) for t in sorted(texts)], "pgn string")).select("pgn", "error", pgn.set_up_without_fen(F.col("headers")).alias("set_up")).collect()
    assert {r["pgn"]: pgn.fault(r["pgn"], r["set_up"]) for r in rows} == {r["pgn"]: r["error"] for r in rows}
    assert len({r["error"] for r in rows}) == 7
