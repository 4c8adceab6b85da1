"""What pieces attack and where they may go, square by square, by built-in functions over bitboards.

Tables of rays and steps come from rules; a slider's reach ends at the first
occupied square of each ray, which is the lowest or highest bit of ray and board.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bits
from .boards import MASKS

KNIGHT = [(1, 2), (2, 1), (2, -1), (1, -2), (-1, -2), (-2, -1), (-2, 1), (-1, 2)]
KING = [(f, r) for f in (-1, 0, 1) for r in (-1, 0, 1) if f or r]
#: Rays towards higher squares, then towards lower ones; straight ones are 0, 1, 4 and 5.
RAYS = [(0, 1), (1, 0), (1, 1), (-1, 1), (0, -1), (-1, 0), (-1, -1), (1, -1)]
#: Attack counts above it are not told apart.
MOST = 12


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def steps(square: int, by: list[tuple[int, int]], far: int = 1) -> int:
    out = 0
    for df, dr in by:
        f, r = square % 8, square // 8
        for _ in range(far):
            f, r = f + df, r + dr
            if not (0 <= f < 8 and 0 <= r < 8):
                break
            out |= 1 << 8 * r + f
    return signed(out)


TABLES = {
    "_knight": [steps(s, KNIGHT) for s in range(64)],
    "_kingstep": [steps(s, KING) for s in range(64)],
    "_wpawn": [steps(s, [(1, 1), (-1, 1)]) for s in range(64)],
    "_bpawn": [steps(s, [(1, -1), (-1, -1)]) for s in range(64)],
} | {f"_ray{d}": [steps(s, [ray], 7) for s in range(64)] for d, ray in enumerate(RAYS)}


def _ray(d: int, s: str, occupied: str) -> str:
    hit = f"(_ray{d}[{s}] & {occupied})"
    first = f"IF({hit} < 0 AND shiftleft({hit}, 1) = 0, 63, bit_count(({hit} & -{hit}) - 1))" if d < 4 else f"(length(bin({hit})) - 1)"
    return f"(_ray{d}[{s}] ^ IF({hit} = 0, 0L, _ray{d}[CAST({first} AS INT)]))"


def slider(kind: str, s: str, occupied: str = "occ") -> str:
    """SQL text of the reach of a rook, bishop or queen at a square."""
    rays = {"rook": (0, 1, 4, 5), "bishop": (2, 3, 6, 7), "queen": range(8)}[kind]
    return bits.either(*[_ray(d, s, occupied) for d in rays])


def with_tables(df: DataFrame) -> DataFrame:
    return df.withColumns({name: F.lit(values) for name, values in TABLES.items()})


def with_reach(df: DataFrame) -> DataFrame:
    """Adds w, b and occ (occupied squares), codes (piece on each square, 0 for none) and reach (mask of what the piece on
    each square attacks)."""
    held = with_tables(df.withColumns({"w": F.expr(bits.either(*MASKS[:6])), "b": F.expr(bits.either(*MASKS[6:]))}).withColumn("occ", F.expr("w | b")))
    codes = " + ".join(f"{i} * CAST(shiftrightunsigned({m}, s) & 1 AS INT)" for i, m in enumerate(MASKS, 1))
    held = held.withColumn("codes", F.expr(f"transform(sequence(0, 63), s -> {codes})"))
    reach = f"""transform(sequence(0, 63), s -> CASE codes[s] WHEN 0 THEN 0L WHEN 1 THEN _wpawn[s] WHEN 7 THEN _bpawn[s] WHEN 2 THEN _knight[s] WHEN 8 THEN _knight[s]
        WHEN 6 THEN _kingstep[s] WHEN 12 THEN _kingstep[s] WHEN 3 THEN {slider('bishop', 's')} WHEN 9 THEN {slider('bishop', 's')} WHEN 4 THEN {slider('rook', 's')} WHEN 10 THEN {slider('rook', 's')} ELSE {slider('queen', 's')} END)"""
    return held.withColumn("reach", F.expr(reach)).drop(*TABLES)


def with_attacks(df: DataFrame) -> DataFrame:
    """Adds to with_reach: watt and batt, 12 masks each, of the squares attacked by at least 1, 2, ... pieces of a side."""
    for side, low in (("w", 1), ("b", 7)):
        fold = f"""aggregate(sequence(0, 63), array_repeat(0L, {MOST}), (a, s) -> IF(codes[s] BETWEEN {low} AND {low + 5},
            transform(a, (x, k) -> x | (reach[s] & IF(k = 0, -1L, a[greatest(k - 1, 0)]))), a))"""
        df = df.withColumn(side + "att", F.expr(fold))
    return df


def with_destinations(df: DataFrame) -> DataFrame:
    """Adds to with_attacks: dest (mask of the pseudo-legal destinations of the piece on each square, castling included,
    king captures not) and moves (their number, a promotion counting four times)."""
    passing = "IF(ep IS NULL, 0L, shiftleft(1L, ep))"

    def pawn(white: bool) -> str:
        bit, enemy, king = "shiftleft(1L, s)", "b" if white else "w", "bk" if white else "wk"
        own = "'w'" if white else "'b'"
        one = bits.less(bits.ahead(bit, white), "occ")
        two = bits.less(bits.ahead(bits.both(one, bits.RANKS[2 if white else 5]), white), "occ")
        capture = f"(reach[s] & (({enemy} & ~{king}) | IF(side = {own}, {passing}, 0L)))"
        return bits.either(one, two, capture)

    def castles(side: str) -> str:
        """The king's two-step squares, with rights, room, and no attack from where it stands to where it goes."""
        rank, other, king = (0, "batt[0]", "wk") if side == "w" else (56, "watt[0]", "bk")
        out = []
        for right, room, safe, to in ((1 if side == "w" else 4, (5, 6), (4, 5, 6), 6), (2 if side == "w" else 8, (1, 2, 3), (2, 3, 4), 2)):
            need, calm = (signed(sum(1 << rank + f for f in fs)) for fs in (room, safe))
            rook = signed(1 << rank + (7 if to == 6 else 0))
            out.append(f"IF((castling & {right}) > 0 AND {king} = {signed(1 << rank + 4)} AND ({'wr' if side == 'w' else 'br'} & {bits.num(rook)}) <> 0 AND (occ & {bits.num(need)}) = 0 AND ({other} & {bits.num(calm)}) = 0, {bits.num(signed(1 << rank + to))}, 0L)")
        return bits.either(*out)

    dest = f"""transform(sequence(0, 63), s -> CASE WHEN codes[s] = 0 THEN 0L WHEN codes[s] = 1 THEN {pawn(True)} WHEN codes[s] = 7 THEN {pawn(False)}
        WHEN codes[s] = 6 THEN (reach[s] & ~w & ~bk) | {castles('w')} WHEN codes[s] = 12 THEN (reach[s] & ~b & ~wk) | {castles('b')}
        WHEN codes[s] < 7 THEN reach[s] & ~w & ~bk ELSE reach[s] & ~b & ~wk END)"""
    edge = bits.num(255 - (1 << 56))
    moves = f"transform(sequence(0, 63), s -> bit_count(dest[s]) + IF(codes[s] IN (1, 7), 3 * bit_count(dest[s] & {edge}), 0))"
    return df.withColumn("dest", F.expr(dest)).withColumn("moves", F.expr(moves))
