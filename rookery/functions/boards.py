"""Positions in columns: FEN text, 67-byte records and twelve bitboards, by built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .once import made_once

#: Pieces in the order of their codes in a record, from 1; 0 is an empty square.
PIECES = "PNBRQKpnbrqk"
#: The mask of each piece.
MASKS = ["wp", "wn", "wb", "wr", "wq", "wk", "bp", "bn", "bb", "br", "bq", "bk"]
START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"


def placement(fen: Column) -> Column:
    """64 characters from a1 to h8, '.' for an empty square."""
    rows = F.reverse(F.split(F.element_at(F.split(F.trim(fen), r"\s+"), 1), "/"))
    text = F.array_join(rows, "")
    for n in range(1, 9):
        text = F.regexp_replace(text, str(n), "." * n)
    return text


def _masked(df: DataFrame, board: Column, letters: str) -> DataFrame:
    """Adds a mask for each piece of a board of 64 letters, from a1: its squares as binary digits, the last one first. letters: of
    an empty square and of the pieces in order; masks are 0 if the board has others."""
    df = made_once(df, _backwards=F.when(board.rlike(f"^[{letters}]{{64}}$"), F.reverse(board)))
    digits = {mask: F.translate("_backwards", letters, "0" * i + "1" + "0" * (len(letters) - i - 1)) for i, mask in enumerate(MASKS, 1)}
    masks = {mask: F.coalesce(F.conv(text, 2, -10).cast("long"), F.lit(0).cast("long")) for mask, text in digits.items()}
    return made_once(df.drop(*MASKS), **masks).drop("_backwards")


def with_masks(df: DataFrame, fen: str = "fen") -> DataFrame:
    """Adds a mask for each piece, side ('w' or 'b'), castling (K 1, Q 2, k 4, q 8), ep (square or null) and valid.

    valid: a 64-square board, a known side, one king on each side, and no pawn on the first or last rank. ep is kept
    only where a pawn of the side to move stands beside the pawn that has just moved two squares."""
    parts = F.split(F.trim(F.col(fen)), r"\s+")
    held = df.withColumn("_board", placement(F.col(fen)))
    held = _masked(held, F.col("_board"), "." + "".join(PIECES))
    rights = F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit("-"))
    castling = sum((F.when(F.instr(F.translate(rights, "KQkq", "1248"), str(n)) > 0, n).otherwise(0) for n in (1, 2, 4, 8)), F.lit(0))
    square = F.coalesce(F.try_element_at(parts, F.lit(4)), F.lit("-"))
    at = F.when(square.rlike("^[a-h][36]$"), F.ascii(square) - 97 + (F.substring(square, 2, 1).cast("int") - 1) * 8)
    side = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("w"))
    held = held.withColumn("side", side).withColumn("castling", castling).withColumn("_ep", at)
    pawns = F.when(F.col("side") == "w", F.col("wp")).otherwise(F.col("bp"))
    row = F.when(F.col("side") == "w", F.col("_ep") - 8).otherwise(F.col("_ep") + 8)
    near = F.expr("CASE WHEN _row IS NULL THEN false ELSE (shiftrightunsigned(_pawns, _row - 1) & 1 = 1 AND _row % 8 > 0) OR (shiftrightunsigned(_pawns, _row + 1) & 1 = 1 AND _row % 8 < 7) END")
    held = held.withColumn("_row", row).withColumn("_pawns", pawns).withColumn("ep", F.when(near, F.col("_ep")))
    edge = F.expr(f"(wp | bp) & {255 - (1 << 56)}")
    valid = (F.length("_board") == 64) & F.col("_board").rlike("^[.PNBRQKpnbrqk]{64}$") & F.col("side").isin("w", "b") & (F.bit_count("wk") == 1) & (F.bit_count("bk") == 1) & (edge == 0)
    return held.withColumn("valid", valid).drop("_board", "_row", "_pawns", "_ep")


def record() -> Column:
    """The 67-byte record of a row with masks (no two of which share a square): 64 piece codes, side (0 white), castling bits, ep square
    or 255. Masks become one for each bit of the codes, and each rank of these the eight bytes of its squares."""
    planes = ", ".join(" | ".join(f"`{m}`" for i, m in enumerate(MASKS, 1) if i >> bit & 1) for bit in range(4))
    # bit k of a rank goes to byte 7 - k: copies at distances of 9 bits have it at 63 - 8 * k, and that of bit 0 is put there by itself
    row = lambda bit: f"shiftrightunsigned(p[{bit}], r)"
    bytes_ = lambda bit: f"(shiftright(((({row(bit)} & 254) * {0x0040201008040201}) & {0x0080808080808080}), 7) | shiftleft({row(bit)} & 1, 56))"
    whole = " + ".join(f"{1 << bit} * {bytes_(bit)}" for bit in range(4))
    # a variable, so that masks are made once and not for each rank
    codes = f"element_at(transform(array(array({planes})), p -> array_join(transform(sequence(0, 56, 8), r -> lpad(hex({whole}), 16, '0')), '')), 1)"
    return F.expr(f"unhex(concat_ws('', {codes}, IF(side = 'w', '00', '01'), lpad(hex(castling), 2, '0'), lpad(hex(coalesce(ep, 255)), 2, '0')))")


def from_record(df: DataFrame, column: str = "record") -> DataFrame:
    """The masks, side, castling and ep of a record."""
    held = made_once(df, _hex=F.hex(column))
    held = held.withColumn("_board", F.regexp_replace(F.substring("_hex", 1, 128), "0(.)", "$1"))
    held = _masked(held, F.col("_board"), "0123456789ABC").drop("_board")
    byte = lambda i: F.conv(F.substring("_hex", 2 * i + 1, 2), 16, 10).cast("int")
    return held.withColumn("side", F.when(byte(64) == 0, "w").otherwise("b")).withColumn("castling", byte(65)).withColumn("ep", F.when(byte(66) < 64, byte(66))).drop("_hex")


def to_fen() -> Column:
    """The first four fields of the FEN of a row with masks."""
    letter = "coalesce(" + ", ".join(f"IF(shiftrightunsigned({m}, 8 * r + f) & 1 = 1, '{p}', NULL)" for p, m in zip(PIECES, MASKS, strict=True)) + ", '1')"
    rows = F.expr(f"array_join(transform(sequence(7, 0), r -> array_join(transform(sequence(0, 7), f -> {letter}), '')), '/')")
    for n in range(8, 1, -1):
        rows = F.regexp_replace(rows, "1" * n, str(n))
    rights = F.expr("CASE WHEN castling = 0 THEN '-' ELSE concat(IF(castling & 1 > 0, 'K', ''), IF(castling & 2 > 0, 'Q', ''), IF(castling & 4 > 0, 'k', ''), IF(castling & 8 > 0, 'q', '')) END")
    ep = F.expr("CASE WHEN ep IS NULL THEN '-' ELSE concat(substr('abcdefgh', ep % 8 + 1, 1), CAST(ep DIV 8 + 1 AS STRING)) END")
    return F.concat_ws(" ", rows, "side", rights, ep)


def full_fen(halfmove: Column, fullmove: Column) -> Column:
    """All six fields."""
    return F.concat_ws(" ", to_fen(), F.coalesce(halfmove, F.lit(0)).cast("string"), F.coalesce(fullmove, F.lit(1)).cast("string"))


def clocks(fen: Column) -> tuple[Column, Column]:
    """The halfmove clock and the number of the move, 0 and 1 where they are left out."""
    parts = F.split(F.trim(fen), r"\s+")
    number = lambda i, least: F.greatest(F.coalesce(F.try_element_at(parts, F.lit(i)).try_cast("int"), F.lit(least)), F.lit(least))
    return number(5, 0), number(6, 1)


def swap_colors(df: DataFrame) -> DataFrame:
    """Men change their colour where they stand; rights and the side to move are exchanged, squares stay."""
    other = dict(zip(MASKS, MASKS[6:] + MASKS[:6], strict=True))
    return df.withColumns({m: F.col(other[m]) for m in MASKS} | {"side": F.when(F.col("side") == "w", "b").otherwise("w"), "castling": F.expr("((castling & 3) << 2) | ((castling & 12) >> 2)")})


def keys(df: DataFrame) -> DataFrame:
    """Adds exact_key (the record), equivalent_key (one for a position and its colour swap) and SHA-256 hashes of both."""
    names = df.columns
    held = df.withColumn("exact_key", record())
    both = swap_colors(held).withColumn("_swapped", record()).select(*[F.col(c) for c in ("exact_key", "_swapped")], *[F.col(c).alias(f"_{c}") for c in names])
    out = both.withColumn("equivalent_key", canonical_key(F.col("exact_key"), F.col("_swapped")))
    other = dict(zip(MASKS, MASKS[6:] + MASKS[:6], strict=True))
    back = {m: F.col(f"_{other[m]}") for m in MASKS} | {"side": F.when(F.col("_side") == "w", "b").otherwise("w"), "castling": F.expr("((_castling & 3) << 2) | ((_castling & 12) >> 2)")}
    return out.select(*[back.get(c, F.col(f"_{c}")).alias(c) for c in names], "exact_key", "equivalent_key", F.unhex(F.sha2("exact_key", 256)).alias("exact_hash"), F.unhex(F.sha2("equivalent_key", 256)).alias("equivalent_hash"))


def color_swapped(df: DataFrame) -> DataFrame:
    """Ranks flipped and colours, castling rights and the side to move exchanged."""
    from .bits import flipped_ranks

    other = dict(zip(MASKS, MASKS[6:] + MASKS[:6], strict=True))
    return df.withColumns(
        {m: F.expr(flipped_ranks(other[m])) for m in MASKS}
        | {"side": F.when(F.col("side") == "w", "b").otherwise("w"), "castling": F.expr("((castling & 3) << 2) | ((castling & 12) >> 2)"), "ep": F.expr("ep ^ 56")}
    )


def file_reflected(df: DataFrame) -> DataFrame:
    """Files mirrored, and with them king's and queen's side rights."""
    from .bits import flipped_files

    return df.withColumns({m: F.expr(flipped_files(m)) for m in MASKS} | {"castling": F.expr("((castling & 5) << 1) | ((castling & 10) >> 1)"), "ep": F.expr("ep ^ 7")})


def canonical_key(record: Column, swapped: Column) -> Column:
    """One key for a position and its colour swap: the lesser record."""
    return F.least(record, swapped)


def zobrist(seed: int = 0) -> Column:
    """An xor over pieces, rights, ep file and side of 64-bit hashes; equal positions have equal ones."""
    pieces = [f"aggregate(sequence(0, 63), 0L, (a, s) -> a ^ IF(shiftrightunsigned({m}, s) & 1 = 1, xxhash64({seed}, {i}, s), 0L))" for i, m in enumerate(MASKS)]
    return F.expr(" ^ ".join([*pieces, f"xxhash64({seed}, 'castling', castling)", f"IF(ep IS NULL, 0L, xxhash64({seed}, 'ep', ep % 8))", f"IF(side = 'b', xxhash64({seed}, 'side'), 0L)"]))
