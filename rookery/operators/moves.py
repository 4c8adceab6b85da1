"""Moves as relations: every legal move of every position, what it leads to, and counts to a depth.

A row of positions (twelve masks, side, castling, ep) explodes into its moves; each
move rewrites the masks, and rows that leave the own king attacked go. All of it is
projection and filter, so it splits by rows and shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import attacks, bits
from ..functions.boards import MASKS

STATE = [*MASKS, "side", "castling", "ep"]


def settled(df: DataFrame, new: dict[str, str]) -> DataFrame:
    """Sets columns through a one-element explode, which the optimizer doesn't see through: a long predicate over them
    stays as long as it is written."""
    values = F.struct(*[F.expr(text).alias(name) for name, text in new.items()])
    return df.withColumn("_new", F.explode(F.array(values))).select(*[c for c in df.columns if c not in new], *[F.col(f"_new.{name}").alias(name) for name in new])


def attacked(df: DataFrame, king: str, white: str) -> DataFrame:
    """Adds check: whether a king is attacked. king: its mask; white: that it is White's; both as SQL text. Looks outwards
    from the king, so no piece's reach is needed."""
    enemy = {p: f"IF({white}, b{p}, w{p})" for p in "pnbrqk"}
    held = settled(df, {"occ": bits.either(*MASKS), "_king": king, "_white": white} | {f"_e{p}": text for p, text in enemy.items()})
    held = settled(held, {"_at": "CAST(IF(_king < 0, 63, least(63, bit_count(_king - 1))) AS INT)"})
    held = settled(attacks.with_tables(held), {"_rook": attacks.slider("rook", "_at"), "_bishop": attacks.slider("bishop", "_at"), "_knights": "_knight[_at]", "_kings": "_kingstep[_at]", "_pawns": "IF(_white, _wpawn[_at], _bpawn[_at])"})
    check = "(_pawns & _ep) <> 0 OR (_knights & _en) <> 0 OR (_kings & _ek) <> 0 OR (_rook & (_er | _eq)) <> 0 OR (_bishop & (_eb | _eq)) <> 0"
    return held.withColumn("check", F.expr(check)).drop(*attacks.TABLES, "occ", "_king", "_white", "_at", "_rook", "_bishop", "_knights", "_kings", "_pawns", *(f"_e{p}" for p in "pnbrqk"))


def pseudo(positions: DataFrame) -> DataFrame:
    """A row for each pseudo-legal move of the side to move: the position's columns, source, target, promotion (5 to 2 for
    queen to knight, in the order of record codes, else 0) and code (of the piece)."""
    held = attacks.with_destinations(attacks.with_attacks(attacks.with_reach(positions)))
    own = "IF(side = 'w', codes[s] BETWEEN 1 AND 6, codes[s] > 6)"
    source = F.expr(f"explode(transform(filter(sequence(0, 63), s -> {own} AND dest[s] <> 0), s -> struct(s AS source, dest[s] AS to, codes[s] AS code)))")
    rows = held.select(*[c for c in held.columns if c not in ("watt", "batt", "moves", "dest", "reach", "codes")], source.alias("m"))
    rows = rows.select("*", F.expr(f"explode({bits.squares('m.to')})").alias("target")).withColumns({"source": F.col("m.source"), "code": F.col("m.code")}).drop("m")
    last = "code IN (1, 7) AND (target > 55 OR target < 8)"
    return rows.withColumn("promotion", F.expr(f"explode(IF({last}, array(5, 4, 3, 2), array(0)))"))


def applied(moves: DataFrame) -> DataFrame:
    """Rows of moves with the position after the move; the other columns stay."""
    src, dst = "shiftleft(1L, source)", "shiftleft(1L, target)"
    pawn = "code IN (1, 7)"
    passed = f"IF({pawn} AND ep IS NOT NULL AND target = ep, shiftleft(1L, IF(side = 'w', target - 8, target + 8)), 0L)"
    castle = "code IN (6, 12) AND abs(target - source) = 2"
    corner = "shiftleft(1L, IF(target > source, target + 1, target - 2))"
    beside = "shiftleft(1L, IF(target > source, target - 1, target + 1))"
    new = {}
    for i, m in enumerate(MASKS, 1):
        text = f"({m} & ~({src} | {dst} | {passed}))"
        if i in (4, 10):
            text = f"IF({castle} AND ((code = 6) = ({i} = 4)), ({text} & ~{corner}) | {beside}, {text})"
        moved = f"(IF(promotion > 0, promotion + IF(side = 'w', 0, 6), code) = {i})"
        new[m] = f"IF({moved}, {text} | {dst}, {text})"
    kept = " & ".join(f"IF(source = {s} OR target = {s}, {15 - lost}, 15)" for s, lost in ((4, 3), (7, 1), (0, 2), (60, 12), (63, 4), (56, 8)))
    jump = f"{pawn} AND abs(target - source) = 16"
    # an en passant square only where an enemy pawn can take
    takers = "(IF(side = 'w', bp, wp) & " + bits.either(f"IF(target % 8 > 0, shiftleft(1L, target - 1), 0L)", f"IF(target % 8 < 7, shiftleft(1L, target + 1), 0L)") + ")"  # noqa: F541
    new["castling"] = f"castling & {kept}"
    new["ep"] = f"IF({jump} AND {takers} <> 0, CAST((source + target) DIV 2 AS INT), NULL)"
    new["side"] = "IF(side = 'w', 'b', 'w')"
    return settled(moves, new)


def legal(positions: DataFrame) -> DataFrame:
    """A row for each legal move: the columns of positions after it, with source, target, promotion, code and uci."""
    done = applied(pseudo(positions)).drop("w", "b", "occ")
    safe = attacked(done, "IF(side = 'b', wk, bk)", "side = 'b'").where("NOT check").drop("check")
    name = lambda c: f"concat(substr('abcdefgh', {c} % 8 + 1, 1), {c} DIV 8 + 1)"
    return safe.withColumn("uci", F.expr(f"concat({name('source')}, {name('target')}, IF(promotion > 0, substr('nbrq', promotion - 1, 1), ''))"))


def forcing(positions: DataFrame, key: str) -> DataFrame:
    """key, legal_moves (of the side to move) and, as {w,b}_ columns for each side as if it were to move: checks (moves that
    leave the own king safe and attack the other), captures (of men other than the king), forcing (either), quiet_threats
    (no captures, but the man attacks one afterwards), active (capture, check or such an attack), and check_from and
    capture_from (masks of where they begin)."""
    turn = positions.select(key, *STATE).withColumn("_turn", F.lit(True))
    other = turn.withColumns({"side": F.expr("IF(side = 'w', 'b', 'w')"), "ep": F.lit(None).cast("int"), "_turn": F.lit(False)})
    tried = pseudo(turn.unionByName(other)).withColumns({"_mover": F.col("side"), "_prey": F.expr("IF(side = 'w', b & ~bk, w & ~wk)")})
    done = applied(tried).drop("w", "b", "occ")
    done = attacked(done, "IF(_mover = 'w', wk, bk)", "_mover = 'w'").withColumnRenamed("check", "_unsafe")
    done = attacked(done, "IF(_mover = 'w', bk, wk)", "_mover = 'b'")
    held = settled(attacks.with_tables(settled(done, {"occ": bits.either(*MASKS), "_man": "IF(promotion > 0, promotion, (code - 1) % 6 + 1)"})), {
        "_sees": f"CASE _man WHEN 1 THEN IF(_mover = 'w', _wpawn[target], _bpawn[target]) WHEN 2 THEN _knight[target] WHEN 3 THEN {attacks.slider('bishop', 'target')} WHEN 4 THEN {attacks.slider('rook', 'target')} WHEN 5 THEN {attacks.slider('queen', 'target')} ELSE _kingstep[target] END",
    })
    flags = {"_checks": "check AND NOT _unsafe", "_captures": "(shiftleft(1L, target) & _prey) <> 0", "_hits": "(_sees & _prey) <> 0"}
    held = settled(held, flags).select(key, "_turn", "_unsafe", "_mover", "source", *flags)
    counts = [F.count_if(F.expr("_turn AND NOT _unsafe")).cast("int").alias("legal_moves")]
    for s in "wb":
        tests = {"checks": "_checks", "captures": "_captures", "forcing": "_checks OR _captures", "quiet_threats": "_hits AND NOT _captures", "active": "_checks OR _captures OR _hits"}
        counts += [F.count_if(F.expr(f"_mover = '{s}' AND ({test})")).cast("int").alias(f"{s}_{name}") for name, test in tests.items()]
        counts += [F.expr(f"coalesce(bit_or(IF(_mover = '{s}' AND _{of}, shiftleft(1L, source), 0L)), 0L)").alias(f"{s}_{name}") for name, of in (("check_from", "checks"), ("capture_from", "captures"))]
    got = held.groupBy(key).agg(*counts)
    names = [c for c in got.columns if c != key]
    # a position without any move still has its row
    return positions.select(key).join(got, key, "left").select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def perft(positions: DataFrame, key: str, depth: int) -> DataFrame:
    """key and nodes: the number of legal move sequences of a length."""
    held = positions.select(key, *STATE)
    for _ in range(depth):
        held = legal(held).select(key, *STATE)
    return held.groupBy(key).agg(F.count("*").alias("nodes"))


def in_check(positions: DataFrame) -> DataFrame:
    """Adds check: the king of the side to move is attacked."""
    return attacked(positions, "IF(side = 'w', wk, bk)", "side = 'w'")


def status(positions: DataFrame, key: str) -> DataFrame:
    """key, legal_moves, check, and ending: checkmate, stalemate or null."""
    counts = legal(positions.select(key, *STATE)).groupBy(key).agg(F.count("*").alias("n"))
    held = in_check(positions).select(key, "check").join(counts, key, "left")
    n = F.coalesce("n", F.lit(0))
    return held.select(key, n.alias("legal_moves"), "check", F.when(n > 0, None).when(F.col("check"), "checkmate").otherwise("stalemate").alias("ending"))


def played(positions: DataFrame, uci: str) -> DataFrame:
    """The position after the legal move that the column names, which stays; rows whose move isn't legal go."""
    return legal(positions.withColumn("_asked", F.col(uci)).drop("uci")).where(F.col("uci") == F.col("_asked")).drop("_asked")


def validated(positions: DataFrame) -> DataFrame:
    """Adds fault: null, or what first makes a position impossible: side, kings, adjacent_kings, pawn_rank, promotions (more
    men than pawns can have become), opponent_in_check, castling, or en_passant."""
    tables = attacks.with_tables(positions.withColumn("occ", F.expr(bits.either(*MASKS))))
    at = "CAST(IF({k} < 0, 63, least(63, bit_count({k} - 1))) AS INT)"
    spare = lambda s: " + ".join(f"greatest(bit_count({s}{p}) - {n}, 0)" for p, n in (("n", 2), ("b", 2), ("r", 2), ("q", 1))) + f" + bit_count({s}p)"
    rook = lambda bit, king, rook_at, k, r: f"((castling & {bit}) > 0 AND (({k} & shiftleft(1L, {king})) = 0 OR ({r} & shiftleft(1L, {rook_at})) = 0))"
    rights = " OR ".join((rook(1, 4, 7, "wk", "wr"), rook(2, 4, 0, "wk", "wr"), rook(4, 60, 63, "bk", "br"), rook(8, 60, 56, "bk", "br")))
    passing = "ep IS NOT NULL AND ((shiftrightunsigned(occ, ep) & 1) = 1 OR ep DIV 8 <> IF(side = 'w', 5, 2) OR (shiftrightunsigned(IF(side = 'w', bp, wp), IF(side = 'w', ep - 8, ep + 8)) & 1) = 0)"
    sound = "side IN ('w', 'b') AND bit_count(wk) = 1 AND bit_count(bk) = 1"
    first = f"""CASE WHEN side NOT IN ('w', 'b') OR side IS NULL THEN 'side' WHEN bit_count(wk) <> 1 OR bit_count(bk) <> 1 THEN 'kings' WHEN {sound} AND (_kingstep[{at.format(k='wk')}] & bk) <> 0 THEN 'adjacent_kings'
        WHEN ((wp | bp) & {bits.num(255 - (1 << 56))}) <> 0 THEN 'pawn_rank' WHEN {spare('w')} > 8 OR {spare('b')} > 8 THEN 'promotions' WHEN {rights} THEN 'castling' WHEN {passing} THEN 'en_passant' END"""
    held = tables.withColumn("_first", F.expr(first)).drop(*attacks.TABLES, "occ")
    both = attacked(held, "IF(side = 'w', bk, wk)", "side = 'b'")
    late = F.col("_first").isin("castling", "en_passant") | F.col("_first").isNull()
    return both.withColumn("fault", F.when(late & F.col("check"), "opponent_in_check").otherwise(F.col("_first"))).drop("_first", "check")
