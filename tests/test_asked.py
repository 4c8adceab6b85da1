"""What searches, imports and stores refuse or count."""

import pytest
from pyspark.sql import functions as F

from rookery.functions import boards
from rookery.operators import analysis, moves, replay, search, store
from rookery.sources import pgn
from rookery.streaming import ingest


def test_pages_that_cannot_be_given(spark):
    found = spark.range(5).selectExpr("id AS position_id", "id AS occurrence_id", "id AS record_id")
    for limit, after, error in ((None, None, "missing_limit"), (0, None, "invalid_limit"), ("9", None, "invalid_limit"), (3, (1, 2), "invalid_cursor"), (3, [1, 2, 3], "invalid_cursor")):
        with pytest.raises(ValueError, match=error):
            search.page(found, limit, after)
    with pytest.raises(ValueError, match="invalid_sort"):
        search.asked(5, sort="elo")
    with pytest.raises(ValueError, match="unsupported_sort"):
        search.asked(5, sort="date_desc")
    with pytest.raises(ValueError, match="unsupported_property"):
        search.structure_keys(spark.range(1).selectExpr("1L AS white", "2L AS black"), "castling")
    with pytest.raises(ValueError, match="substitution"):
        search.signature_variants("white", *[F.lit(1)] * 5, "two_pawns")
    assert search.page(found.where("false"), 3).count() == 0


def test_nested_metadata(spark):
    text = '{"a": {"b": [1, {"c": "x"}, null, true], "d": 2.5}, "e\'s": "y"}'
    cases = [({}, True), ({"a": {}}, True), ({"a": {"d": 2.5}}, True), ({"a": {"b": [{"c": "x"}, 1]}}, True), ({"a": {"b": [1, 1]}}, True), ({"a": {"b": [None]}}, True), ({"a": {"b": [True]}}, True), ({"e's": "y"}, True)]
    cases += [({"a": {"b": [2]}}, False), ({"a": {"b": [{"c": "z"}]}}, False), ({"a": {"b": {"c": "x"}}}, False), ({"f": None}, False), ({"a": "x"}, False), ({"a": {"d": "2.5"}}, False), ({"a": {"b": ["true"]}}, False), ([], False)]
    row = spark.createDataFrame([(text,)], "j string").select(*[search.contains_json(F.col("j"), w).alias(f"c{i}") for i, (w, _) in enumerate(cases)]).first()
    assert list(row) == [ok for _, ok in cases]
    assert [r[0] for r in spark.createDataFrame([("no json",), (None,)], "j string").select(search.contains_json(F.col("j"), {})).collect()] == [False, False]


def test_a_move_in_a_column_of_any_name(spark):
    df = boards.with_masks(spark.createDataFrame([(1, boards.START, "e2e4"), (2, boards.START, "e2e5")], "id int, fen string, uci string"))
    assert [(r["id"], r["uci"]) for r in moves.played(df, "uci").collect()] == [(1, "e2e4")]
    assert [(r["id"], r["mine"], r["uci"]) for r in moves.played(df.withColumnRenamed("uci", "mine"), "mine").collect()] == [(1, "e2e4", "e2e4")]


def test_variations_stop_at_the_first_illegal_move(spark):
    rows = [(1, None, "e2e4 e7e5 g1f3"), (2, None, "e2e4 e2e4 g1f3"), (3, "4k3/P7/8/8/8/8/8/4K2R w K - 0 1", "a7a8q e8e7 e1g1"), (4, "4k3/P7/8/8/8/8/8/4K3 w - - 0 1", "a7a8"), (5, None, None), (6, "bad", "e2e4")]
    got = {r["id"]: r["moves"] for r in replay.variations(spark.createDataFrame(rows, "id int, fen string, pv string"), "id").collect()}
    assert got == {1: ["e4", "e5", "Nf3"], 2: ["e4"], 3: ["a8=Q+", "Ke7", "O-O"], 4: [], 5: [], 6: []}


def test_clocks_and_colours(spark):
    df = boards.with_masks(spark.createDataFrame([("r3k3/8/8/8/8/8/8/4K2R b Kq - 12 34",), ("4k3/8/8/8/8/8/8/4K3 w - -",)], "fen string"))
    assert [r[0] for r in df.select(boards.full_fen(*boards.clocks(F.col("fen")))).collect()] == ["r3k3/8/8/8/8/8/8/4K2R b Kq - 12 34", "4k3/8/8/8/8/8/8/4K3 w - - 0 1"]
    swapped = boards.swap_colors(df).select(boards.to_fen()).first()[0]
    assert swapped == "R3K3/8/8/8/8/8/8/4k2r w Qk -"
    a, b = (boards.keys(x).select("equivalent_key", "exact_key").first() for x in (df.limit(1), boards.swap_colors(df.limit(1))))
    assert a["equivalent_key"] == b["equivalent_key"] and a["exact_key"] != b["exact_key"]


def test_move_numbers(spark):
    rows = [(1, "w", 0), (1, "w", 1), (1, "w", 2), (7, "b", 0), (7, "b", 1)]
    got = spark.createDataFrame(rows, "n int, s string, p int").select(*[c.alias(n) for c, n in zip(analysis.move_number(F.col("n"), F.col("s"), F.col("p")), "ab", strict=True)]).collect()
    assert [tuple(r) for r in got] == [(1, "w"), (1, "b"), (2, "w"), (7, "b"), (8, "w")]


def game(n, elo=2300, text="1. e4 e5"):
    return f'[Event "Rated Blitz game"]\n[White "w{n}"]\n[Black "b"]\n[Result "1-0"]\n[WhiteElo "{elo}"]\n[BlackElo "2400"]\n[TimeControl "300+0"]\n\n{text} 1-0\n\n'


@pytest.fixture
def files(tmp_path):
    (tmp_path / "in").mkdir()
    for f in range(2):
        (tmp_path / "in" / f"{f}.pgn").write_text("".join(game(10 * f + n, 2300 if n % 3 else 2000, "1. e4 Zz" if n == 4 else "1. e4 e5") for n in range(10)))
    return tmp_path / "in"


def test_an_import_goes_on_where_it_stopped(spark, files):
    placed = pgn.placed(spark, str(files))
    white = lambda df: [r["w"] for r in df.select("number", F.regexp_extract("pgn", r'White "w(\d+)', 1).cast("int").alias("w")).orderBy("number").collect()]
    assert white(pgn.sliced(placed)) == list(range(20))
    assert white(pgn.sliced(placed, 7, 6)) == list(range(7, 13)) and white(pgn.sliced(placed, 19)) == [19] and white(pgn.sliced(placed, 30)) == []
    with pytest.raises(ValueError, match="invalid_limit"):
        pgn.sliced(placed, -1)


def test_the_filter_comes_before_any_move_is_looked_at(spark, files):
    games = pgn.framed(pgn.kept(pgn.read(spark, str(files)), rating=2200))
    assert games.count() == 12
    assert tuple(pgn.counters(pgn.read(spark, str(files)), rating=2200).first()) == (20, 8, 2, 10)


def test_malformed_games_are_counted_by_the_stream(spark, files, tmp_path):
    for _ in range(2):
        ingest.ingest(spark, str(files), str(tmp_path / "out"), str(tmp_path / "check"), 2200).awaitTermination()
    assert {r["outcome"]: r["games"] for r in ingest.counters(spark, str(tmp_path / "out")).collect()} == {"imported": 10, "bad_move": 2}
    assert ingest.counters(spark, str(tmp_path / "none")).count() == 0


def test_stores(spark):
    rows = spark.createDataFrame([(1, 5), (2, 3), (3, 9), (4, 3)], "token int, expires_at int")
    assert [r["token"] for r in store.expired(rows, "token", F.lit(5), 2).collect()] == [2, 4]
    pairs = spark.createDataFrame([(1, 1)], "room int, analysis int")
    new = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (9, 1)], "room int, analysis int")
    assert sorted(map(tuple, store.associated(pairs, spark.createDataFrame([(1,)], "room int"), new, "room", "analysis").collect())) == [(1, 1), (1, 2)]
    incoming = spark.createDataFrame([("a", 1, None), ("b", 2, None), ("b", 3, None), ("c", 4, "bad"), ("c", 5, None)], "record_id string, n int, fault string")
    good, bad = store.inserted(spark.createDataFrame([("a",)], "record_id string"), incoming, "record_id", ["n"], F.col("fault"))
    assert sorted(r["n"] for r in good.collect()) == [2, 5] and {r["n"]: r["error"] for r in bad.collect()} == {1: "already_exists", 3: "duplicate_in_batch", 4: "bad"}
    numbered = store.numbered(spark.range(1000), ["id"], name="n", buckets=7)
    assert sorted(r["n"] for r in numbered.collect()) == list(range(1, 1001))
