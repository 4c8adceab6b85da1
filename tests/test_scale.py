"""Plans: what reaches the scan, and what is shuffled."""

import re

from conftest import SMALL
from pyspark.sql import functions as F

from rookery.functions import bits, boards, features
from rookery.operators import moves, search, store, variations
from rookery.plans import bindings as b
from rookery.plans.queries import games, trees
from rookery.sources import pgn


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(b.positions(spark, SMALL).where("id = 77").select("id", "white"))
    assert "PushedFilters: [IsNotNull(p_partkey), EqualTo(p_partkey,77)]" in text
    assert "p_size" in text and "p_name" not in text and "p_retailprice" not in text
    assert "Exchange" not in text and "Python" not in text


def test_moves_and_features_shuffle_nothing(spark):
    p = boards.with_masks(spark.createDataFrame([(1, boards.START)], "id int, fen string"))
    assert "Exchange" not in plan(moves.legal(p)) and "Python" not in plan(moves.legal(p))
    text = plan(features.extract(p, "id", ["pawns", "lines"]))
    assert "Exchange" not in text and "Python" not in text


def test_deepest_rows_combine_before_the_shuffle(spark):
    text = plan(store.upsert(b.evaluations(spark, SMALL), ["position_id", "engine"], ["depth", "seq"]))
    assert "partial_max_by" in text and text.count("Exchange") == 1


def test_pages_are_top_k(spark):
    assert "TakeOrderedAndProject" in plan(search.page(b.records(spark, SMALL).selectExpr("id AS position_id", "id AS occurrence_id", "id AS record_id"), 25))


def test_headers_and_moves_are_made_once(spark):
    games = spark.createDataFrame([(1, '[Event "x"]\n\n1. e4 e5 *')], "id int, pgn string")
    held = pgn.framed(pgn.kept(games, rating=2200)).where("error IS NULL AND result <> '1-0'").select("id", "headers", "moves", "error")
    text = held._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("lower(regexp_replace(") == 1 and text.count("aggregate(") == 1  # names of tags; rounds that strip variations


def test_trees_are_grown_once(spark):
    """Starts, games with faults and games with a wrong move are no runs of their own."""
    games = spark.createDataFrame([(1, '[Event "x"]\n\n1. e4 e5 *')], "id int, pgn string")
    text = variations.tree(games, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("MapInArrow") == 1


def test_trees_shuffle_nothing(spark):
    """A game's tree depends on no other game, whatever its first position."""
    games = spark.createDataFrame([(1, '[Event "x"]\n\n1. e4 e5 *')], "id int, pgn string")
    text = plan(variations.tree(games, "id"))
    assert "Exchange" not in text and "Window" not in text and "Join" not in text and "Union" not in text


def test_texts_that_are_alike_have_one_tree(spark):
    text = plan(trees.annotated_paths(spark, SMALL))
    assert re.search(r"Aggregate\(keys=\[pgn#\d+\]", text[text.index("MapInArrow") :])


def test_masks_are_made_once_for_a_record(spark):
    """Not for each square of it: a name within a function over squares would stand for all that makes the mask."""
    text = b.whole_positions(spark, SMALL).select("id", "record")._jdf.queryExecution().optimizedPlan().toString()
    lines = [line for line in text.split("\n") if "unhex(" in line]
    assert lines and not any("p_size" in line for line in lines)


def test_records_have_any_square_of_any_man(spark):
    rows = [("." * s + p + "." * (63 - s), s, i) for i, p in enumerate(boards.PIECES, 1) for s in range(64)]
    held = boards._masked(spark.createDataFrame(rows, "text string, s int, code int"), F.col("text"), "." + boards.PIECES)
    held = held.selectExpr("*", "'b' AS side", "s % 16 AS castling", "IF(code % 2 = 0, NULL, s) AS ep")
    for r in held.select("s", "code", boards.record().alias("record")).collect():
        assert bytes(r["record"]) == bytes([*(r["code"] if s == r["s"] else 0 for s in range(64)), 1, r["s"] % 16, r["s"] if r["code"] % 2 else 255])


def test_masks_are_made_once_for_their_squares(spark):
    """Not for each of 64 squares: a mask may be long to make."""
    text = bits.names("MADE")
    assert text.count("MADE") == 1 and "MADE" not in text[text.index("filter(") :]
    rows = spark.createDataFrame([(1, -(1 << 63) + 5), (2, 0), (3, None)], "id int, m long").select("id", F.expr(bits.names("m")).alias("n"))
    assert {r["id"]: r["n"] for r in rows.collect()} == {1: ["a1", "c1", "h8"], 2: [], 3: []}


def test_long_work_on_boards_is_dealt_out(spark):
    """Few short rows are one task otherwise, behind the search for different boards and behind the join with counted moves."""
    held = games._boards(spark, SMALL)
    assert held.select(F.spark_partition_id().alias("p")).distinct().count() == 8
    some = held.limit(40).repartition(1)
    text = plan(features.extract(some, "id", ["tactics.fork", "threats.aantal_checks"]))
    assert "REPARTITION_BY_NUM" in text[: text.index("Join")]


def test_compared_features_join_by_position(spark):
    p = boards.with_masks(spark.createDataFrame([(1, boards.START)], "id int, fen string"))
    got = features.extract(p, "id", ["center"])
    text = plan(features.compared(got, "id", got))
    assert text.count("Generate explode(arrays_zip") == 1 and text.index("Generate explode(arrays_zip") < text.index("Join")
