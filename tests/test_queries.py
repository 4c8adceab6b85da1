import pytest
from conftest import SMALL
from oracle import same

from rookery.plans import queries

#: Those that only show features or moves; tests of their own hold them against published values.
SHOWN = set(queries.QUERIES) - set(queries.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_and_sql_agree(spark, name):
    same(spark, SMALL, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_every_other_query_is_known():
    assert SHOWN == {"feature_vectors", "feature_activity", "feature_motifs", "feature_compare", "digest_atoms", "feature_tactics", "feature_evaluation", "feature_similarity", "perft", "legal_moves", "position_records"}


def test_replay_query_has_a_row_for_each_ply(spark):
    rows = queries.QUERIES["pgn_replay"](spark, SMALL)
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    assert rows.where("move IS NULL").count() == orders.count() and rows.groupBy("id", "ply").count().where("count > 1").count() == 0


@pytest.mark.parametrize("name", ["feature_vectors", "legal_moves"])
def test_positions_of_the_tables_all_have_rows(spark, name):
    """Features for every position once; moves for none that isn't there."""
    every = {r[0] for r in queries.QUERIES["position_records"](spark, SMALL).select("id").collect()}
    got = [r[0] for r in queries.QUERIES[name](spark, SMALL).select("id").collect()]
    assert len(every) > 100 and (set(got) <= every if name == "legal_moves" else sorted(got) == sorted(every))


def test_records_survive_their_masks(spark):
    rows = queries.QUERIES["position_records"](spark, SMALL).select("id", "record").collect()
    assert rows and all(r["id"] == bytes(r["record"]).hex().upper() for r in rows)


def test_placed_positions_have_every_kind_of_move_and_fault(spark):
    """The SQL that moves and faults are held against is no use for what no position has."""
    moved = {r[0] for r in queries.QUERIES["placed_moves"](spark, SMALL).select("uci").distinct().collect()}
    assert {"e1g1", "e1c1"} & moved and {"e8g8", "e8c8"} & moved and {u[4] for u in moved if len(u) > 4} == set("nbrq")
    faults = {r[0] for r in queries.QUERIES["placed_faults"](spark, SMALL).select("fault").distinct().collect()}
    assert {None, "kings", "adjacent_kings", "pawn_rank", "opponent_in_check", "castling"} <= faults
