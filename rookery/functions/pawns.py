"""The algebra of pawn structures: pairs of masks, their differences, symmetries and edit neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bits

#: Kinds of difference between two structures.
KINDS = ("exact", "removal", "addition", "single_rank", "capture_like", "not_single_edit")


def difference(df: DataFrame, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """removed and added masks of each colour, from structure a to b, and kind: what one edit explains it."""
    held = df.withColumns({f"{what}_{color}": F.expr(f"({x} & ~{y})") for color, p, q in (("white", a[0], b[0]), ("black", a[1], b[1])) for what, x, y in (("removed", p, q), ("added", q, p))})
    gone, come = "(bit_count(removed_white) + bit_count(removed_black))", "(bit_count(added_white) + bit_count(added_black))"
    lowest = lambda m: f"bit_count({m} - 1)"  # noqa: E731  the square of a mask with one bit; of 0 it isn't asked
    moved = f"{gone} = 1 AND {come} = 1 AND bit_count(removed_white) = bit_count(added_white)"
    source, target = f"{lowest('(removed_white | removed_black)')}", f"{lowest('(added_white | added_black)')}"
    kind = f"""CASE WHEN {gone} = 0 AND {come} = 0 THEN 'exact'
        WHEN {gone} = 1 AND {come} = 0 THEN 'removal'
        WHEN {gone} = 0 AND {come} = 1 THEN 'addition'
        WHEN {moved} THEN CASE
            WHEN abs({source} % 8 - {target} % 8) = 0 AND abs({source} DIV 8 - {target} DIV 8) = 1 THEN 'single_rank'
            WHEN abs({source} % 8 - {target} % 8) = 1 AND abs({source} DIV 8 - {target} DIV 8) = 1 THEN 'capture_like'
            ELSE 'not_single_edit' END
        ELSE 'not_single_edit' END"""
    return held.withColumn("kind", F.expr(kind))


def color_reversed(white: str, black: str) -> tuple[str, str]:
    return bits.flipped_ranks(black), bits.flipped_ranks(white)


def file_reflected(white: str, black: str) -> tuple[str, str]:
    return bits.flipped_files(white), bits.flipped_files(black)


def symmetries(df: DataFrame, white: str = "white", black: str = "black") -> DataFrame:
    """Adds symmetry (array of white, black): the structure, its colour reversal, its file reflection and both, each once."""
    w, k = color_reversed(white, black)
    held = df.withColumns({"_white": F.expr(w), "_black": F.expr(k)})  # columns of their own, so that the next flips stay small
    forms = [(white, black), ("_white", "_black"), file_reflected(white, black), file_reflected("_white", "_black")]
    out = held.withColumns({f"_{side}{i}": F.expr(form[side == "b"]) for i, form in enumerate(forms) for side in "wb"})
    pairs = ", ".join(f"struct(_w{i} AS white, _b{i} AS black)" for i in range(4))
    return out.withColumn("symmetry", F.expr(f"array_distinct(array({pairs}))")).drop("_white", "_black", *(f"_{s}{i}" for s in "wb" for i in range(4)))


def shifted(df: DataFrame, color: str, source: str, target: str) -> DataFrame:
    """Adds shift_error (invalid_square, same_square, missing_pawn or target_has_pawn, else null) and, without one, the
    structure shifted_white, shifted_black with the pawn of a colour (white or black) moved from square to square."""
    if color not in ("white", "black"):
        raise ValueError("invalid_color")
    on = lambda m, s: f"(shiftrightunsigned({m}, {s}) & 1) = 1"
    square = lambda s: f"({s} BETWEEN 8 AND 55)"
    error = f"""CASE WHEN NOT coalesce({square(source)} AND {square(target)}, false) THEN 'invalid_square' WHEN {source} = {target} THEN 'same_square'
        WHEN NOT ({on(color, source)}) THEN 'missing_pawn' WHEN {on('(white | black)', target)} THEN 'target_has_pawn' END"""
    held = df.withColumn("shift_error", F.expr(error))
    move = f"IF(shift_error IS NULL, ({color} & ~shiftleft(1L, {source})) | shiftleft(1L, {target}), NULL)"
    stay = {"white": "black", "black": "white"}[color]
    return held.withColumns({f"shifted_{color}": F.expr(move), f"shifted_{stay}": F.expr(f"IF(shift_error IS NULL, {stay}, NULL)")})


def bounded(pairs: DataFrame, key: list[str], limit: int) -> DataFrame:
    """key and distance (edits from (white, black) to (white2, black2); null beyond limit, 0 to 2) of pairs. Each source
    structure is expanded once, however many pairs it is in."""
    if limit not in (0, 1, 2):
        raise ValueError("invalid_limit")
    sources = pairs.select("white", "black").distinct()
    found = sources.select(F.col("white").alias("white2"), F.col("black").alias("black2"), "white", "black", F.lit(0).alias("distance"))
    edge = found
    for d in range(1, limit + 1):
        edge = _edited(edge, "white2", "black2", ["white", "black"]).withColumn("distance", F.lit(d))
        found = found.unionByName(edge)
    least = found.groupBy("white", "black", "white2", "black2").agg(F.min("distance").alias("distance"))
    return pairs.join(least, ["white", "black", "white2", "black2"], "left").select(*key, "distance")


def _edited(df: DataFrame, white: str, black: str, keep: list[str]) -> DataFrame:
    """One edit (a rank, a capture-like step or a removal) away from (white, black), with the columns of keep, distinct."""
    steps = [(f, s) for s in (1, -1) for f in (0, 1, -1)]
    arrays = []
    for own in (white, black):
        pair = lambda new, own=own: f"struct({new if own == white else white} AS w, {new if own == black else black} AS b)"
        for files, step in steps:
            to = f"s + {8 * step + files}"
            fits = f"(s % 8 + {files}) BETWEEN 0 AND 7 AND ({to}) BETWEEN 8 AND 55 AND (shiftrightunsigned({white} | {black}, {to}) & 1) = 0"
            arrays.append(f"transform(filter(sequence(0, 63), s -> (shiftrightunsigned({own}, s) & 1) = 1 AND {fits}), s -> {pair(f'(({own} & ~shiftleft(1L, s)) | shiftleft(1L, {to}))')})")
        arrays.append(f"transform(filter(sequence(0, 63), s -> (shiftrightunsigned({own}, s) & 1) = 1), s -> {pair(f'({own} & ~shiftleft(1L, s))')})")
    return df.select(*keep, F.explode(F.expr(f"concat({', '.join(arrays)})")).alias("k")).select(*keep, F.col("k.w").alias(white), F.col("k.b").alias(black)).distinct()


def neighbours(keys: DataFrame, *, pushes: bool = False, ranks: bool = False, captures: bool = False, removals: bool = False) -> DataFrame:
    """One edit away from each (white, black) of keys, distinct. pushes: a pawn one rank ahead. ranks: one rank either
    way. captures: one file aside and one rank either way. removals: one pawn less. A pawn goes only where no pawn
    stands, and not to the first or last rank."""
    steps = []
    if ranks:
        steps += [(0, 1), (0, -1)]
    if captures:
        steps += [(1, 1), (-1, 1), (1, -1), (-1, -1)]
    moves = []
    for own, ahead in (("white", 1), ("black", -1)):
        mine = [*steps, *([(0, ahead)] if pushes else [])]
        for files, step in mine:
            # the target of square s, or nothing beyond the board
            target = f"s + {8 * step + files}"
            fits = f"(s % 8 + {files}) BETWEEN 0 AND 7 AND ({target}) BETWEEN 8 AND 55 AND (shiftrightunsigned(white | black, {target}) & 1) = 0"
            new = f"(({own} & ~shiftleft(1L, s)) | shiftleft(1L, {target}))"
            moves.append((own, fits, new))
        if removals:
            moves.append((own, "true", f"({own} & ~shiftleft(1L, s))"))
    arrays = []
    for own, fits, new in moves:
        pair = f"struct({new} AS white, black AS black)" if own == "white" else f"struct(white AS white, {new} AS black)"
        arrays.append(f"transform(filter(sequence(0, 63), s -> (shiftrightunsigned({own}, s) & 1) = 1 AND ({fits})), s -> {pair})")
    return keys.select(F.explode(F.expr(f"concat({', '.join(arrays)})")).alias("k")).select("k.white", "k.black").distinct()


def neighbourhood(keys: DataFrame, edits: int) -> DataFrame:
    """(white, black, distance): structures within so many edits (a rank, a capture-like step or a removal), with the
    least number of them."""
    found = keys.select("white", "black", F.lit(0).alias("distance"))
    edge = keys
    for d in range(1, edits + 1):
        edge = neighbours(edge, ranks=True, captures=True, removals=True)
        found = found.unionByName(edge.withColumn("distance", F.lit(d)))
    return found.groupBy("white", "black").agg(F.min("distance").alias("distance"))
