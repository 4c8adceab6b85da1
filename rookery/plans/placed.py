"""Positions with men of all kinds, one for each part, so that they grow with the table: their faults, moves and features.

Squares of men follow from the part's key by arithmetic that both engines share.
DuckDB then looks at boards as lists and at reach as a table of squares, Spark at
bitboards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boards, features
from ..functions.once import made_once
from ..operators import moves
from . import bindings as b
from .queries import query


def _raw(j: int) -> str:
    return f"(((id * 7919 + {j * 104_729}) * (id % 1009 + {31 * j + 17})) % 1000003)"


#: Of the keys, those that 4 divides have kings and rooks at home and rights; of remainder 1 a pawn that has just made two steps beside
#: an enemy one. Others now and then lack a king, have a pawn on the last rank, or a right or a square that nothing supports.
_TO_MOVE, _FILE = f"({_raw(50)} % 2)", f"({_raw(51)} % 7)"


def _men() -> list[tuple[int, str]]:
    """Codes of men and their squares; squares above 63 are none, and the first man on a square stays."""
    home = lambda at, other: f"CASE WHEN id % 4 = 0 THEN {at} ELSE {other} END"
    pawn = lambda j: f"CASE WHEN {_raw(j)} % 96 < 48 + (CASE WHEN id % 5 = 2 THEN 2 ELSE 0 END) THEN 8 + {_raw(j)} % 96 ELSE 99 END"
    out = [(6, home(4, f"{_raw(0)} % 64")), (12, f"CASE WHEN id % 31 = 3 THEN 99 ELSE {home(60, f'{_raw(1)} % 64')} END")]
    out += [(code, home(at, f"{_raw(at + 2)} % 128")) for code, at in ((4, 0), (4, 7), (10, 56), (10, 63))]
    beside = lambda white, black: f"CASE WHEN id % 4 <> 1 THEN 99 WHEN {_TO_MOVE} = 0 THEN {white} + {_FILE} ELSE {black} + {_FILE} END"
    out += [(7, beside(32, 25)), (1, beside(33, 24))]
    out += [(code, f"{_raw(70 + i)} % 128") for i, code in enumerate((5, 11, 3, 3, 9, 9, 2, 2, 8, 8))]
    return out + [(code, pawn(90 + i)) for i, code in enumerate((1, 7) * 5)]


_MEN = _men()
_SQUARES, _CODES = ", ".join(f"CAST({text} AS BIGINT)" for _, text in _MEN), ", ".join(str(code) for code, _ in _MEN)
_RIGHTS = f"CASE WHEN id % 4 = 0 THEN {_raw(52)} % 16 WHEN id % 23 = 7 THEN 15 ELSE 0 END"
#: Where a pawn may be taken in passing; board is a list and {0} its element at a square.
_PASSED = f"CASE WHEN id % 4 = 1 AND side = 0 AND {{0}}(board, 33 + file) = 7 AND {{0}}(board, 41 + file) = 0 THEN 40 + file WHEN id % 4 = 1 AND side = 1 AND {{0}}(board, 26 + file) = 1 AND {{0}}(board, 18 + file) = 0 THEN 17 + file WHEN id % 4 > 1 AND id % 29 = 11 THEN 40 + {_raw(53)} % 24 ELSE 255 END"


def placed(spark: SparkSession, d: str) -> DataFrame:
    """id (the part's key), masks, side, castling and ep. Keys are dealt out first: a split of a table is small for its scan, but
    its positions are milliseconds of work each."""
    held = b.table(spark, d, "part").selectExpr("CAST(p_partkey AS BIGINT) AS id").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    # within a function over squares, names would stand for all that makes them
    held = made_once(held, sq=F.expr(f"array({_SQUARES})"), side=F.expr(f"CAST({_TO_MOVE} AS INT)"), castling=F.expr(f"CAST({_RIGHTS} AS INT)"), file=F.expr(f"CAST({_FILE} AS INT)"))
    held = made_once(held, board=F.expr(f"transform(sequence(0L, 63L), x -> coalesce(get(array({_CODES}), CAST(array_position(sq, x) AS INT) - 1), 0))"))
    held = held.withColumn("bytes", F.expr(f"concat(board, array(side, castling, CAST({_PASSED.format('element_at')} AS INT)))"))
    return boards.from_record(held.select("id", F.expr("unhex(array_join(transform(bytes, c -> lpad(hex(c), 2, '0')), ''))").alias("record"))).drop("record")


def sound(spark: SparkSession, d: str) -> DataFrame:
    return moves.validated(placed(spark, d)).where("fault IS NULL").drop("fault")


_BIT = "(1::HUGEINT << CAST({} AS INT))"
_STEPS = "(VALUES (0, 1), (1, 0), (0, -1), (-1, 0), (1, 1), (1, -1), (-1, -1), (-1, 1)) AS dirs(dx, dy)"
#: Boards as lists, what each man reaches and whether that is the other side's or free, and what makes positions impossible.
PLACED = f"""src AS (SELECT CAST(p_partkey AS BIGINT) AS id FROM part),
    spots AS (SELECT id, [{_SQUARES}] AS sq, CAST({_TO_MOVE} AS INT) AS side, CAST({_RIGHTS} AS INT) AS castling, CAST({_FILE} AS INT) AS file FROM src),
    filled AS (SELECT *, list_transform(range(64), x -> coalesce([{_CODES}][list_position(sq, x)], 0)) AS board FROM spots),
    placed AS (SELECT id, side, castling, board, CAST({_PASSED.format('list_extract')} AS INT) AS ep FROM filled),
    squares AS (SELECT id, side, CAST(s.range AS INT) AS sq, board[s.range + 1] AS code FROM placed, range(64) s),
    pieces AS (SELECT *, code <= 6 AS white FROM squares WHERE code > 0),
    occupied AS (SELECT id, bit_or({_BIT.format('sq')}) AS m FROM pieces GROUP BY id),
    rays AS (SELECT CAST(s.range AS INT) AS src, dx, dy, CAST(n.range AS INT) AS d, CAST(s.range + n.range * (dx + 8 * dy) AS INT) AS dst, dx * dy = 0 AS straight,
        coalesce((SELECT bit_or({_BIT.format('s.range + k.range * (dx + 8 * dy)')}) FROM range(1, 7) k WHERE k.range < n.range), 0) AS via
      FROM range(64) s, {_STEPS}, range(1, 8) n WHERE s.range % 8 + n.range * dx BETWEEN 0 AND 7 AND s.range // 8 + n.range * dy BETWEEN 0 AND 7),
    reach AS (SELECT k.code, src, dst, via FROM rays, (VALUES (1), (7), (3), (9), (4), (10), (5), (11), (6), (12)) AS k(code)
        WHERE CASE WHEN k.code IN (6, 12) THEN d = 1 WHEN k.code = 1 THEN d = 1 AND dx <> 0 AND dy = 1 WHEN k.code = 7 THEN d = 1 AND dx <> 0 AND dy = -1 WHEN k.code IN (3, 9) THEN NOT straight WHEN k.code IN (4, 10) THEN straight ELSE true END
      UNION ALL SELECT k.code, CAST(s.range AS INT), CAST(s.range + dx + 8 * dy AS INT), 0 FROM range(64) s, (VALUES (2), (8)) AS k(code), (VALUES (1, 2), (2, 1), (2, -1), (1, -2), (-1, -2), (-2, -1), (-2, 1), (-1, 2)) AS jumps(dx, dy)
        WHERE s.range % 8 + dx BETWEEN 0 AND 7 AND s.range // 8 + dy BETWEEN 0 AND 7),
    attacked AS (SELECT p.id, p.side, p.code, p.white, p.sq AS src, r.dst FROM pieces p JOIN occupied o USING (id) JOIN reach r ON r.code = p.code AND r.src = p.sq WHERE (o.m & r.via) = 0),
    kings AS (SELECT id, count(*) FILTER (WHERE code = 6) AS nw, count(*) FILTER (WHERE code = 12) AS nb, max(sq) FILTER (WHERE code = 6) AS wk, max(sq) FILTER (WHERE code = 12) AS bk, bool_or(code IN (1, 7) AND sq // 8 IN (0, 7)) AS edge FROM pieces GROUP BY id),
    checks AS (SELECT k.id, bool_or(a.white AND a.dst = bk) AS black_checked, bool_or(NOT a.white AND a.dst = wk) AS white_checked FROM kings k JOIN attacked a USING (id) GROUP BY k.id),
    faults AS (SELECT p.id, CASE WHEN nw <> 1 OR nb <> 1 THEN 'kings' WHEN greatest(abs(wk % 8 - bk % 8), abs(wk // 8 - bk // 8)) <= 1 THEN 'adjacent_kings' WHEN edge THEN 'pawn_rank'
        WHEN CASE WHEN side = 0 THEN black_checked ELSE white_checked END THEN 'opponent_in_check'
        WHEN (castling & 3 > 0 AND board[5] <> 6) OR (castling & 12 > 0 AND board[61] <> 12) OR (castling & 1 > 0 AND board[8] <> 4) OR (castling & 2 > 0 AND board[1] <> 4) OR (castling & 4 > 0 AND board[64] <> 10) OR (castling & 8 > 0 AND board[57] <> 10) THEN 'castling'
        WHEN ep < 64 AND (board[ep + 1] <> 0 OR ep // 8 <> CASE WHEN side = 0 THEN 5 ELSE 2 END OR board[CASE WHEN side = 0 THEN ep - 7 ELSE ep + 9 END] <> CASE WHEN side = 0 THEN 7 ELSE 1 END) THEN 'en_passant' END AS fault
      FROM placed p JOIN kings USING (id) JOIN checks USING (id))"""

_ROOM = "(VALUES (1, 6, 4, 6, [5, 6], [4, 5, 6]), (2, 6, 4, 2, [1, 2, 3], [2, 3, 4]), (4, 12, 60, 62, [61, 62], [60, 61, 62]), (8, 12, 60, 58, [57, 58, 59], [58, 59, 60])) AS room(bit, code, src, dst, empty, calm)"
#: Every legal move with the board behind it: moves by kind, boards rewritten square by square, and those that leave the king attacked gone.
MOVED = f"""{PLACED}, sound AS (SELECT placed.* FROM placed JOIN faults USING (id) WHERE fault IS NULL),
    tried AS (
      SELECT s.id, a.src, a.dst, a.code FROM sound s JOIN attacked a ON a.id = s.id AND a.white = (s.side = 0)
        WHERE board[dst + 1] NOT IN (6, 12) AND (board[dst + 1] = 0 OR (board[dst + 1] <= 6) <> a.white) AND (a.code NOT IN (1, 7) OR board[dst + 1] > 0 OR dst = ep)
      UNION ALL SELECT s.id, sq, sq + 8 * up.n * up.k, code FROM sound s JOIN pieces p ON p.id = s.id AND p.white = (s.side = 0) JOIN (VALUES (1, 1, 1), (1, 1, 2), (7, -1, 1), (7, -1, 2)) AS up(code, n, k) USING (code)
        WHERE board[sq + 8 * n + 1] = 0 AND (k = 1 OR (sq // 8 = CASE WHEN n = 1 THEN 1 ELSE 6 END AND board[sq + 16 * n + 1] = 0))
      UNION ALL SELECT s.id, src, dst, code FROM sound s JOIN {_ROOM} ON castling & bit > 0 AND (code = 6) = (s.side = 0)
        WHERE len(list_filter(empty, x -> board[x + 1] > 0)) = 0 AND NOT EXISTS (SELECT 1 FROM attacked a WHERE a.id = s.id AND a.white <> (s.side = 0) AND list_contains(calm, a.dst))),
    promoted AS (SELECT *, unnest(CASE WHEN code IN (1, 7) AND dst // 8 IN (0, 7) THEN [5, 4, 3, 2] ELSE [0] END) AS promo FROM tried),
    after AS (SELECT t.*, s.side, s.castling, board, list_transform(range(64), x -> CASE WHEN x = dst THEN CASE WHEN promo > 0 THEN promo + 6 * s.side ELSE code END WHEN x = src THEN 0
        WHEN code IN (1, 7) AND dst = ep AND x = CASE WHEN s.side = 0 THEN dst - 8 ELSE dst + 8 END THEN 0
        WHEN code IN (6, 12) AND abs(dst - src) = 2 AND x = CASE WHEN dst > src THEN dst + 1 ELSE dst - 2 END THEN 0
        WHEN code IN (6, 12) AND abs(dst - src) = 2 AND x = (src + dst) // 2 THEN code - 2 ELSE board[x + 1] END) AS next FROM promoted t JOIN sound s USING (id)),
    seen AS (SELECT *, CAST(list_position(next, 6 + 6 * side) - 1 AS INT) AS king, CAST(list_sum(list_transform(list_filter(range(64), x -> next[x + 1] > 0), x -> CAST(pow(2, x) AS HUGEINT))) AS HUGEINT) AS m FROM after),
    unsafe AS (SELECT DISTINCT seen.id, seen.src, seen.dst, promo FROM seen JOIN reach r ON r.dst = king AND (r.code <= 6) = (side = 1) WHERE next[r.src + 1] = r.code AND (m & r.via) = 0),
    legal AS (SELECT * FROM seen ANTI JOIN unsafe USING (id, src, dst, promo))"""

_NAME = "substr('abcdefgh', {0} % 8 + 1, 1) || ({0} // 8 + 1)"
_LOST = " & ".join(f"(CASE WHEN {s} IN (src, dst) THEN {15 - lost} ELSE 15 END)" for s, lost in ((4, 3), (7, 1), (0, 2), (60, 12), (63, 4), (56, 8)))
_TAKER = "(CASE WHEN side = 0 THEN 7 ELSE 1 END)"


@query(f"WITH {PLACED} SELECT id, fault FROM faults")
def placed_faults(spark, d):
    """What first makes each position impossible, or null."""
    return moves.validated(placed(spark, d)).select("id", "fault")


@query(f"""WITH {MOVED} SELECT id, {_NAME.format('src')} || {_NAME.format('dst')} || CASE WHEN promo > 0 THEN substr('nbrq', promo - 1, 1) ELSE '' END AS uci,
    list_aggregate(list_transform(next, c -> printf('%02X', c)), 'string_agg', '') || printf('%02X', 1 - side) || printf('%02X', castling & {_LOST})
      || printf('%02X', CASE WHEN code IN (1, 7) AND abs(dst - src) = 16 AND ((dst % 8 > 0 AND board[dst] = {_TAKER}) OR (dst % 8 < 7 AND board[dst + 2] = {_TAKER})) THEN (src + dst) // 2 ELSE 255 END) AS record FROM legal""")
def placed_moves(spark, d):
    """Every legal move of every possible position, and the record of the position behind it."""
    return moves.legal(sound(spark, d)).select("id", "uci", F.hex(boards.record()).alias("record"))


@query(f"""WITH {MOVED}, n AS (SELECT id, count(*) AS n FROM legal GROUP BY id) SELECT s.id, coalesce(n, 0) AS legal_moves, CASE WHEN side = 0 THEN white_checked ELSE black_checked END AS "check",
    CASE WHEN n > 0 THEN NULL WHEN CASE WHEN side = 0 THEN white_checked ELSE black_checked END THEN 'checkmate' ELSE 'stalemate' END AS ending FROM sound s JOIN checks USING (id) LEFT JOIN n USING (id)""")
def placed_status(spark, d):
    """Checks, mates and stalemates, and how many moves there are."""
    return moves.status(sound(spark, d), "id")


#: Features that are sets of squares, by what a square holds for one side: c (its man), own, enemy, a and e (own and enemy men that
#: attack it), p and q (the same, pawns alone), half (it lies in the enemy's half), near and far (it is beside the own or the enemy king).
_KING, _PAWN = "c IN (6, 12)", "c IN (1, 7)"
_CENTER, _INNER = "sq % 8 BETWEEN 2 AND 5 AND sq // 8 BETWEEN 2 AND 5", "sq % 8 BETWEEN 3 AND 4 AND sq // 8 BETWEEN 3 AND 4"
SETS = {
    "attacks.map": "a > 0", "attacks.defended_squares": "own AND a > 0", "attacks.attacked_pieces": "enemy AND a > 0", "attacks.undefended": f"own AND NOT {_KING} AND a = 0", "attacks.loose": f"own AND NOT {_KING} AND a = 0 AND e > 0",
    "attacks.hanging": f"own AND NOT {_KING} AND a = 0 AND e > 1", "attacks.en_prise": "own AND e > a AND a < 8", "attacks.overprotected": "own AND a > 2", "attacks.underdefended": "own AND a > 0 AND e > a AND a < 8", "attacks.pressure_squares": "enemy AND a > 1",
    "attacks.king_zone_pressure": "near AND e > 0", "center.controlled": f"a > 0 AND {_CENTER}", "center.key_controlled": f"a > 0 AND {_INNER}", "center.occupation": f"own AND {_INNER}", "center.pawn_center": f"own AND {_PAWN} AND {_INNER}",
    "space.enemy_half_squares": "a > 0 AND half", "space.territory_squares": "a > 0 AND half AND e = 0", "squares.invasion": "c = 0 AND half AND a > 0 AND e = 0", "squares.weak": "c = 0 AND NOT half AND q > 0 AND p = 0", "squares.hole": "c = 0 AND NOT half AND p = 0",
    "squares.king_weak": "near AND e > 0 AND a = 0", "mobility.coordinated": f"own AND NOT {_PAWN} AND NOT {_KING} AND a > 0", "mobility.uncoordinated": f"own AND NOT {_PAWN} AND NOT {_KING} AND a = 0", "placement.enemy_territory": "own AND half",
    "placement.advanced": f"own AND NOT {_PAWN} AND half", "placement.centralized": f"own AND {_CENTER}", "placement.knight_on_rim": "own AND c IN (2, 8) AND sq % 8 IN (0, 7)", "king.zone": "near", "king.escape_squares": "near AND c = 0 AND e = 0",
    "king.attackers": "enemy AND z > 0", "king.defenders": f"own AND NOT {_KING} AND z > 0", "tactics.fork": "own AND c IN (1, 2, 7, 8) AND hits > 1", "threats.promotion_threat": f"own AND {_PAWN} AND sq // 8 = CASE WHEN white THEN 6 ELSE 1 END",
}
_COLUMN = {f: f.replace(".", "_") for f in SETS}


@query(f"""WITH {PLACED}, sides AS (SELECT unnest([true, false]) AS white), counts AS (SELECT id, dst, count(*) FILTER (WHERE white) AS wa, count(*) FILTER (WHERE NOT white) AS ba, count(*) FILTER (WHERE code = 1) AS wp, count(*) FILTER (WHERE code = 7) AS bp FROM attacked GROUP BY id, dst),
    men AS (SELECT a.id, a.src, count(*) FILTER (WHERE t.code IS NOT NULL AND t.white <> a.white AND t.code NOT IN (6, 12)) AS hits, count(*) FILTER (WHERE greatest(abs(dst % 8 - wk % 8), abs(dst // 8 - wk // 8)) = 1) AS wz, count(*) FILTER (WHERE greatest(abs(dst % 8 - bk % 8), abs(dst // 8 - bk // 8)) = 1) AS bz
      FROM attacked a JOIN kings USING (id) LEFT JOIN pieces t ON t.id = a.id AND t.sq = a.dst GROUP BY a.id, a.src),
    cells AS (SELECT s.id, sq, s.code AS c, sides.white, s.code > 0 AND (s.code <= 6) = sides.white AS own, s.code > 0 AND (s.code <= 6) <> sides.white AS enemy, coalesce(CASE WHEN sides.white THEN wa ELSE ba END, 0) AS a, coalesce(CASE WHEN sides.white THEN ba ELSE wa END, 0) AS e,
        coalesce(CASE WHEN sides.white THEN wp ELSE bp END, 0) AS p, coalesce(CASE WHEN sides.white THEN bp ELSE wp END, 0) AS q, (sq // 8 > 3) = sides.white AS half, coalesce(hits, 0) AS hits, coalesce(CASE WHEN sides.white THEN wz ELSE bz END, 0) AS z,
        greatest(abs(sq % 8 - CASE WHEN sides.white THEN wk % 8 ELSE bk % 8 END), abs(sq // 8 - CASE WHEN sides.white THEN wk // 8 ELSE bk // 8 END)) = 1 AS near
      FROM squares s JOIN faults USING (id) JOIN kings USING (id) CROSS JOIN sides LEFT JOIN counts ON counts.id = s.id AND counts.dst = sq LEFT JOIN men ON men.id = s.id AND men.src = sq WHERE fault IS NULL)
    SELECT id, CASE WHEN white THEN 'white' ELSE 'black' END AS side, {', '.join(f"coalesce(string_agg({_NAME.format('sq')}, ' ' ORDER BY sq) FILTER (WHERE {test}), '') AS {_COLUMN[f]}" for f, test in SETS.items())} FROM cells GROUP BY id, white""")
def placed_squares(spark, d):
    """Features that are sets of squares, for both sides of every possible position."""
    got = features.extract(sound(spark, d), "id", list(SETS))
    held = got.select("id", F.explode(F.array(F.lit("white"), F.lit("black"))).alias("side"), *[f"`{f}`" for f in SETS])
    one = lambda f: F.when(F.col("side") == "white", F.col(f"`{f}`")["white"]).otherwise(F.col(f"`{f}`")["black"])
    return held.select("id", "side", *[F.array_join(one(f), " ").alias(name) for f, name in _COLUMN.items()])
