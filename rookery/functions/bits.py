"""Bitboards as SQL text over BIGINT columns: bit s is square s, a1 = 0, rank by rank.

Every helper takes and returns SQL text, so that features compose into one
whole-stage-generated projection.
"""

from __future__ import annotations

FULL = -1
FILES = [0x0101010101010101 << f for f in range(7)] + [-0x7F7F7F7F7F7F7F80]
RANKS = [0xFF << 8 * r for r in range(7)] + [-(1 << 56)]
NOT_A, NOT_H = ~FILES[0], ~FILES[7]
DARK = -0x55AA55AA55AA55AB - 0  # a1, c1, ... set: 0xAA55AA55AA55AA55 as a signed long
QUEENSIDE, KINGSIDE = 0x0F0F0F0F0F0F0F0F, ~0x0F0F0F0F0F0F0F0F


def num(value: int) -> str:
    """A literal that both signs of a 64-bit value survive."""
    return str(value) if value >= -(2**63) + 1 else "(-9223372036854775807 - 1)"


def both(*terms: str | int) -> str:
    return "(" + " & ".join(num(t) if isinstance(t, int) else t for t in terms) + ")"


def either(*terms: str) -> str:
    return "(" + " | ".join(terms) + ")"


def less(a: str, b: str) -> str:
    return f"({a} & ~{b})"


def count(mask: str) -> str:
    return f"bit_count({mask})"


def has(mask: str) -> str:
    return f"({mask} <> 0)"


def up(mask: str, n: int = 1) -> str:
    return f"shiftleft({mask}, {8 * n})"


def down(mask: str, n: int = 1) -> str:
    return f"shiftrightunsigned({mask}, {8 * n})"


def right(mask: str) -> str:
    """Towards the h-file."""
    return f"shiftleft({mask} & {num(NOT_H)}, 1)"


def left(mask: str) -> str:
    return f"shiftrightunsigned({mask} & {num(NOT_A)}, 1)"


def ahead(mask: str, white: bool) -> str:
    return up(mask) if white else down(mask)


def sides(mask: str) -> str:
    return either(left(mask), right(mask))


def pawn_attacks(pawns: str, white: bool) -> str:
    return sides(ahead(pawns, white))


def filled(mask: str, white: bool) -> str:
    """The mask and all squares ahead of it, for a side."""
    for n in (1, 2, 4):
        mask = f"({mask} | {up(mask, n) if white else down(mask, n)})"
    return mask


def front(mask: str, white: bool) -> str:
    """All squares strictly ahead."""
    return filled(ahead(mask, white), white)


def files_of(mask: str) -> str:
    """Bits 0 to 7: which files hold a bit."""
    for n in (4, 2, 1):
        mask = f"({mask} | {down(mask, n)})"
    return f"({mask} & 255)"


def knight_attacks(mask: str) -> str:
    one, two = sides(mask), either(left(left(mask)), right(right(mask)))
    return either(up(one, 2), down(one, 2), up(two), down(two))


def king_attacks(mask: str) -> str:
    row = either(mask, sides(mask))
    return less(either(row, up(row), down(row)), mask)


def squares(mask: str) -> str:
    """Ascending square numbers. The mask is a variable, so that it is made once and not for each square."""
    return f"transform(array({mask}), m -> filter(sequence(0, 63), s -> ((shiftrightunsigned(m, s) & 1) = 1)))[0]"


def name_of(square: str) -> str:
    return f"concat(substr('abcdefgh', {square} % 8 + 1, 1), CAST(CAST({square} / 8 AS INT) + 1 AS STRING))"


def names(mask: str) -> str:
    """Ascending square names."""
    return f"transform({squares(mask)}, s -> concat(substr('abcdefgh', s % 8 + 1, 1), CAST(s DIV 8 + 1 AS STRING)))"


def flipped_ranks(mask: str) -> str:
    """Rank 1 for rank 8 and so on: the bytes reversed."""
    terms = [f"shiftleft({mask} & {num(RANKS[r])}, {8 * (7 - 2 * r)})" if r < 4 else f"(shiftrightunsigned({mask}, {8 * (2 * r - 7)}) & {num(RANKS[7 - r])})" for r in range(8)]
    return either(*terms)


def flipped_files(mask: str) -> str:
    """File a for file h and so on: each byte's bits reversed."""
    for n, m in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        mask = f"((shiftrightunsigned({mask}, {n}) & {m}) | shiftleft({mask} & {m}, {n}))"
    return mask
