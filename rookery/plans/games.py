"""Queries over the text of games: a game for each order, with headers from the order and the moves of a known line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boards, features, similarity
from ..functions.once import spread
from ..operators import corpus, moves, replay
from ..sources import pgn
from . import bindings as b
from .queries import query

LINES = ("e4 e5 Nf3 Nc6 Bb5 a6 Ba4 Nf6 O-O Be7", "d4 d5 c4 e6 Nc3 Nf6 Bg5 Be7 e3 O-O", "e4 c5 Nf3 d6 d4 cxd4 Nxd4 Nf6 Nc3 a6", "c4 e5 Nc3 Nf6 g3 d5 cxd5 Nxd5 Bg2 Nb6")
#: Every order of remainder 11 by 13 has a game without moves, of remainder 7 by 17 one with an unreadable move.
_FAULT = "CASE WHEN o_orderkey % 13 = 11 THEN 'no_moves' WHEN o_orderkey % 17 = 7 THEN 'bad_move' END"
_PLIES = "CAST(o_custkey % 9 + 2 AS INT)"


def games(spark: SparkSession, d: str) -> DataFrame:
    """id and pgn."""
    lines = F.array(*[F.array(*[F.lit(m) for m in line.split()]) for line in LINES])
    held = b.dealt(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").selectExpr("o_orderkey AS id", "o_custkey", "o_orderstatus", "o_orderpriority", f"{_FAULT} AS fault", f"{_PLIES} AS plies")
    line = F.slice(F.element_at(lines, (F.col("id") % 4 + 1).cast("int")), 1, F.col("plies"))
    numbered = F.array_join(F.transform(line, lambda m, i: F.concat(F.when(i % 2 == 0, F.concat((F.floor(i / 2) + 1).cast("string"), F.lit(". "))).otherwise(F.lit("")), m, F.when(i == 1, F.lit(" {book [%clk 0:03:00]} $2")).otherwise(F.lit("")))), " ")
    text = F.when(F.col("fault") == "no_moves", F.lit("")).when(F.col("fault") == "bad_move", F.lit("1. e4 Zz9")).otherwise(numbered)
    result = F.expr("CASE o_orderstatus WHEN 'F' THEN '1-0' WHEN 'O' THEN '1/2-1/2' ELSE '0-1' END")
    tag = lambda k, v: F.concat(F.lit(f'[{k} "'), v, F.lit('"]\n'))
    parts = [
        tag("Event", F.when(F.col("id") % 5 == 0, F.lit("Rated Bullet game")).otherwise(F.concat(F.lit("Rated "), "o_orderpriority"))), tag("White", F.concat(F.lit('Cust\\"'), F.col("o_custkey").cast("string"))), tag("Black", F.lit("Clerk")),
        tag("Result", result), tag("WhiteElo", (F.col("o_custkey") + 1000).cast("string")), tag("BlackElo", F.when(F.col("id") % 7 == 0, F.lit("?")).otherwise((F.col("id") % 1500 + 1000).cast("string"))), tag("TimeControl", F.concat((F.col("id") % 600).cast("string"), F.lit("+0"))),
    ]
    return held.select("id", F.concat(*parts, F.lit("\n"), text, F.lit(" "), result, F.lit("\n")).alias("pgn"))


def _sql(select: str, where: str = "true") -> str:
    return f"SELECT {select} FROM (SELECT o_orderkey AS id, o_custkey, o_orderpriority, {_FAULT} AS fault, {_PLIES} AS plies, CASE o_orderstatus WHEN 'F' THEN '1-0' WHEN 'O' THEN '1/2-1/2' ELSE '0-1' END AS result, o_orderkey % 5 = 0 OR o_orderkey % 600 < 180 AS bullet FROM orders) WHERE {where}"


_KEPT = "NOT bullet AND o_custkey + 1000 >= 1200 AND id % 7 <> 0 AND id % 1500 + 1000 >= 1200"


@query(_sql("id, 'Cust\"' || o_custkey AS white, CAST(o_custkey + 1000 AS VARCHAR) AS white_elo, CASE WHEN id % 5 = 0 THEN 'Rated Bullet game' ELSE 'Rated ' || o_orderpriority END AS event, result"))
def pgn_headers(spark, d):
    tag = lambda k: F.try_element_at("headers", F.lit(k)).alias(k)
    return pgn.with_headers(games(spark, d)).select("id", tag("white"), tag("white_elo"), tag("event"), tag("result"))


@query(_sql("id", _KEPT))
def pgn_header_filter(spark, d):
    return pgn.kept(games(spark, d), rating=1200).select("id")


@query(_sql("id, CASE fault WHEN 'no_moves' THEN 0 WHEN 'bad_move' THEN 2 ELSE plies END AS moves, result, fault AS error"))
def pgn_framing(spark, d):
    return pgn.framed(games(spark, d)).select("id", F.size("moves").alias("moves"), "result", "error")


@query(_sql("id, unnest(['clock', 'comment', 'nag']) AS kind, unnest(['0:03:00', 'book', '2']) AS value", "fault IS NULL"))
def pgn_annotations(spark, d):
    return pgn.annotations(games(spark, d), "id").select("id", "kind", "value")


@query(_sql(f"count(*) AS read, count(*) FILTER (WHERE NOT ({_KEPT})) AS filtered, count(*) FILTER (WHERE {_KEPT} AND fault IS NOT NULL) AS malformed, count(*) FILTER (WHERE {_KEPT} AND fault IS NULL) AS imported"))
def import_counters(spark, d):
    return pgn.counters(games(spark, d), rating=1200)


@query("WITH n AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderstatus, o_custkey % 4, o_orderkey) AS number FROM orders) SELECT id, number FROM n WHERE number > 1200 AND number <= 8700")
def import_resume(spark, d):
    """Games after the first 1,200 in the order of files and their parts, 7,500 at most."""
    placed = b.table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_orderstatus AS file", "o_custkey % 4 AS block", "o_orderkey AS row")
    return pgn.sliced(placed, 1_200, 7_500).select("id", "number")


def _move_lists(spark: SparkSession, d: str) -> DataFrame:
    """id and moves of a game for each order."""
    lines = F.array(*[F.array(*[F.lit(m) for m in line.split()]) for line in LINES])
    held = b.table(spark, d, "orders").selectExpr("o_orderkey AS id", f"{_PLIES} AS plies")
    return held.select("id", F.slice(F.element_at(lines, (F.col("id") % 4 + 1).cast("int")), 1, F.col("plies")).alias("moves"))


_LINE_SQL = "[" + ", ".join("[" + ", ".join(f"'{m}'" for m in line.split()) + "]" for line in LINES) + "]"


@query(f"WITH g AS (SELECT o_orderkey AS id, {_LINE_SQL}[o_orderkey % 4 + 1][1:{_PLIES}] AS moves FROM orders) SELECT id, ply, CASE WHEN ply < len(moves) THEN moves[ply + 1] END AS move FROM (SELECT id, moves, unnest(range(len(moves) + 1)) AS ply FROM g)")
def pgn_replay(spark, d):
    """A game for each order: every ply with its move in canonical notation. Known lines, so that many games are alike."""
    played = replay.positions(replay.played(_move_lists(spark, d), "id"), "id")
    return played.where(F.octet_length("record") == 67).select("id", "ply", "move")


@query(f"""WITH g AS (SELECT DISTINCT o_orderkey % 4 AS line, {_PLIES} AS plies FROM orders WHERE ({_FAULT}) IS NULL), p AS (SELECT DISTINCT {_LINE_SQL}[line + 1][1:ply] AS prefix FROM (SELECT line, unnest(range(plies + 1)) AS ply FROM g))
    SELECT (SELECT count(*) FROM p) AS positions, (SELECT count(*) FROM g) AS games, (SELECT CAST(sum(plies + 1) AS BIGINT) FROM g) AS occurrences, (SELECT count(*) FROM orders WHERE ({_FAULT}) IS NULL) AS records""")
def corpus_star(spark, d):
    """Rows of the four tables of an imported corpus; no two of the known lines meet again after they part."""
    framed = pgn.framed(games(spark, d)).where("error IS NULL")
    played = replay.played(framed, "id").join(framed.select("id", "headers"), "id")
    tables = corpus.star(played, "id")
    counts = [tables[t].agg(F.count("*").alias(t)) for t in ("positions", "games", "occurrences", "records")]
    return counts[0].join(counts[1], F.lit(True)).join(counts[2], F.lit(True)).join(counts[3], F.lit(True))


@query(f"SELECT o_orderkey AS id, array_to_string({_LINE_SQL}[o_orderkey % 4 + 1][1:{_PLIES}], ' ') AS moves FROM orders")
def uci_variations(spark, d):
    """The game of each order written in coordinates, with two moves behind that aren't legal, and back in the standard notation."""
    held = replay.played(_move_lists(spark, d), "id").select("id", F.concat(F.array_join("uci", " "), F.lit(" e1e8 a2a3")).alias("pv"), F.lit(None).cast("string").alias("fen"))
    return replay.variations(held, "id").select("id", F.array_join("moves", " ").alias("moves"))


@query(f"""WITH s AS (SELECT DISTINCT o_orderpriority AS eco, {_LINE_SQL}[o_orderkey % 4 + 1][1:CAST(o_custkey % 3 + 3 AS INT)] AS moves FROM orders) SELECT array_to_string(moves, ' ') AS line, min(eco) AS eco, len(moves) AS plies FROM s GROUP BY moves""")
def openings_by_position(spark, d):
    """Openings by the position that they end in; of equal ones the first by code."""
    lines = F.array(*[F.array(*[F.lit(m) for m in line.split()]) for line in LINES])
    rows = b.table(spark, d, "orders").select(F.col("o_orderpriority").alias("eco"), F.slice(F.element_at(lines, (F.col("o_orderkey") % 4 + 1).cast("int")), 1, (F.col("o_custkey") % 3 + 3).cast("int")).alias("moves")).distinct()
    named = corpus.openings(rows.withColumn("name", F.array_join("moves", " ")))
    return named.select(F.col("name").alias("line"), "eco", F.col("plies"))


# Positions of the tables, for moves and features.


def _legal_sql() -> str:
    """Steps and double steps of white pawns, as the pieces of these positions give them, in unobstructed positions with White to move."""
    return f"WITH {b.WHOLE}, p AS (SELECT id, white, (white | black) AS pawns FROM whole WHERE substr(record, 129, 2) = '00'), sq AS (SELECT unnest(range(8, 48)) AS s) SELECT id, count(*) AS steps FROM p, sq WHERE ((white >> s) & 1) = 1 AND ((pawns >> (s + 8)) & 1) = 0 GROUP BY id"


@query(_legal_sql())
def pawn_steps(spark, d):
    """White's single pawn steps below the last rank among pseudo-legal moves."""
    held = b.whole_positions(spark, d).where("side = 'w'").select("id", *boards.MASKS, "side", "castling", "ep")
    steps = moves.pseudo(held).where("code = 1 AND target - source = 8 AND source < 48")
    return steps.groupBy("id").agg(F.count("*").alias("steps"))


def _files(m: str) -> str:
    return f"list_transform(range(8), f -> len(list_filter(range(1, 7), r -> (({m} >> (8 * r + f)) & 1) = 1)))"


def _pawn_sql(side: str, other: str) -> str:
    """Counts by file, lonely pawns, islands and their number, as lists over squares."""
    n = f"{side}_files"
    lonely = f"list_transform(list_filter(range(8, 56), s -> (({side} >> s) & 1) = 1 AND (s % 8 = 0 OR {n}[s % 8] = 0) AND (s % 8 = 7 OR {n}[s % 8 + 2] = 0)), s -> substr('abcdefgh', CAST(s % 8 + 1 AS INT), 1) || CAST(s // 8 + 1 AS VARCHAR))"
    islands = f"len(list_filter(range(8), f -> {n}[f + 1] > 0 AND (f = 0 OR {n}[f] = 0)))"
    return f"list_sort({lonely}) AS {side}_isolated, {islands} AS {side}_islands, CAST(bit_count({side}) AS INT) AS {side}_pawns"


@query(f"WITH {b.WHOLE}, c AS (SELECT id, white, black, {_files('white')} AS white_files, {_files('black')} AS black_files FROM whole) SELECT id, {_pawn_sql('white', 'black')}, {_pawn_sql('black', 'white')}, CAST(bit_count(white) - bit_count(black) AS INT) AS pawn_difference FROM c")
def feature_pawns(spark, d):
    got = features.extract(b.whole_positions(spark, d), "id", ["material.count.pawn", "material.count.rook", "material.difference", "pawns.isolated", "pawns.islands"])
    side = lambda name, color: F.col(f"`{name}`")[color]
    columns = [x for c in ("white", "black") for x in (F.array_sort(side("pawns.isolated", c)).alias(f"{c}_isolated"), side("pawns.islands", c).cast("long").alias(f"{c}_islands"), side("material.count.pawn", c).alias(f"{c}_pawns"))]
    return got.select("id", *columns, (side("material.count.pawn", "white") - side("material.count.pawn", "black")).alias("pawn_difference"))


@query(f"WITH {b.WHOLE} SELECT id, CASE WHEN bit_count(white) > 8 OR bit_count(black) > 8 THEN 'promotions' END AS fault FROM whole WHERE bit_count(white) > 8 OR bit_count(black) > 8")
def positions_validated(spark, d):
    """What makes positions impossible: here only too many men, and whatever else validated() would find first is none."""
    return moves.validated(b.whole_positions(spark, d)).select("id", "fault").where("fault = 'promotions'")


# Positions of all games and parts. No SQL of the other engine says the same; tests hold the operators against published values.


def _boards(spark: SparkSession, d: str) -> DataFrame:
    """Each position of the parts and of the orders' games once, by the hexadecimal text of its record. Equal games are played
    once. What follows works long on each, so they are dealt out."""
    lists = _move_lists(spark, d).select("moves").distinct().withColumn("game", F.array_join("moves", " "))
    played = replay.positions(replay.played(lists, "game"), "game").select("record")
    records = spread(played.unionAll(b.whole_positions(spark, d).select("record")).distinct(), "record")
    return boards.from_record(records).withColumn("id", F.hex("record"))


@query()
def feature_vectors(spark, d):
    return features.extract(_boards(spark, d), "id", ["material", "pawns", "king"])


@query()
def feature_activity(spark, d):
    return features.extract(_boards(spark, d), "id", ["attacks", "mobility", "quality", "space", "state"])


@query()
def feature_motifs(spark, d):
    return features.extract(_boards(spark, d), "id", ["motifs", "tension"])


@query()
def feature_tactics(spark, d):
    return features.extract(_boards(spark, d), "id", ["tactics", "threats", "lines"])


@query()
def feature_evaluation(spark, d):
    return features.extract(_boards(spark, d), "id", ["initiative", "evaluation", "position"])


@query()
def feature_compare(spark, d):
    first = features.extract(_boards(spark, d), "id", ["pawns", "center"])
    return features.compared(first, "id", features.extract(boards.color_swapped(_boards(spark, d)), "id", ["pawns", "center"]))


@query()
def digest_atoms(spark, d):
    return features.atoms(features.extract(_boards(spark, d), "id", ["goals", "squares", "placement"]), "id")


@query()
def feature_similarity(spark, d):
    return similarity.similarity(_boards(spark, d), "id")


@query()
def perft(spark, d):
    return moves.perft(_boards(spark, d), "id", 2)


@query()
def legal_moves(spark, d):
    return moves.legal(_boards(spark, d)).select("id", "uci", "castling", "ep")


@query()
def position_records(spark, d):
    return _boards(spark, d).select("id", boards.record().alias("record"), boards.to_fen().alias("fen4"), boards.zobrist().alias("hash"))
