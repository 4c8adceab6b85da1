"""Games played out: moves in the standard notation to positions, and moves back to notation.

A game's moves depend on one another. Games are sorted by their moves, over ranges of
them, so that they stand as the leaves of the corpus' prefix tree do: each takes over
what it shares with the game before and makes the rest, and a move from a position that
many games reach by the same moves is made once. Boards are lists of 64 record codes;
tables of steps and rays are those of the SQL kernel.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import attacks, boards
from ..sources.pgn import SAN

LETTERS = " PNBRQK"
LOST = {4: 3, 7: 1, 0: 2, 60: 12, 63: 4, 56: 8}  # rights that end where a man leaves or arrives


def _listed(table: str) -> list[list[int]]:
    return [[t for t in range(64) if m >> t & 1] for m in attacks.TABLES[table]]


LEAPS = {1: _listed("_wpawn"), 7: _listed("_bpawn"), 2: _listed("_knight"), 6: _listed("_kingstep")}
LINES = [[sorted(line, reverse=d > 3) for line in _listed(f"_ray{d}")] for d in range(8)]
SLIDES = {3: (2, 3, 6, 7), 4: (0, 1, 4, 5), 5: tuple(range(8))}


@dataclass(slots=True)
class Board:
    """codes: of the men from a1 to h8; side: 0 for White; castling: K 1, Q 2, k 4, q 8; ep: a square, or 255."""

    codes: list[int]
    side: int
    castling: int
    ep: int

    @classmethod
    def of(cls, record: bytes) -> Board:
        return cls(list(record[:64]), record[64], record[65], record[66])

    def record(self) -> bytes:
        return bytes([*self.codes, self.side, self.castling, self.ep])

    def seen_from(self, square: int, kind: int) -> Iterator[int]:
        """What a man other than a pawn attacks; by symmetry also from where it is attacked by its kind."""
        if kind in SLIDES:
            for d in SLIDES[kind]:
                for t in LINES[d][square]:
                    yield t
                    if self.codes[t]:
                        break
        else:
            yield from LEAPS[kind][square]

    def attacked(self, square: int, by: int) -> bool:
        base = 6 * by
        if any(self.codes[t] == base + 1 for t in LEAPS[7 if by == 0 else 1][square]):
            return True
        return any(self.codes[t] == base + kind for kind in (2, 6, 3, 4, 5) for t in self.seen_from(square, kind))

    def checked(self, side: int) -> bool:
        return self.attacked(self.codes.index(6 * side + 6), 1 - side)

    def sources(self, kind: int, to: int) -> list[int]:
        """Where men of a kind stand that may go to a square, castling left out."""
        own, man = 6 * self.side, self.codes[to]
        if man and (man > 6) == bool(self.side):
            return []
        if kind != 1:
            return [f for f in self.seen_from(to, kind) if self.codes[f] == own + kind]
        if man or to == self.ep:
            return [f for f in LEAPS[1 if self.side else 7][to] if self.codes[f] == own + 1]
        step = -8 if self.side else 8
        if not 0 <= to - step < 64:
            return []
        if self.codes[to - step] == own + 1:
            return [to - step]
        far = to - 2 * step
        return [far] if to // 8 == (4 if self.side else 3) and not self.codes[to - step] and self.codes[far] == own + 1 else []

    def castles(self) -> list[tuple[int, int]]:
        king, out = 60 if self.side else 4, []
        for right, room, to, rook in ((1, (1, 2), 2, 3), (2, (-1, -2, -3), -2, -4)):
            if self.castling & right << 2 * self.side and self.codes[king] == 6 * self.side + 6 and self.codes[king + rook] == 6 * self.side + 4 and not any(self.codes[king + r] for r in room):
                if not any(self.attacked(king + i, 1 - self.side) for i in (0, to // 2, to)):
                    out.append((king, king + to))
        return out

    def played(self, source: int, to: int, promotion: int = 0) -> Board:
        codes, man, own = list(self.codes), self.codes[source], 6 * self.side
        kind, step = man - own, -8 if self.side else 8
        if kind == 1 and to == self.ep:
            codes[to - step] = 0
        codes[source], codes[to] = 0, own + promotion if promotion else man
        if kind == 6 and abs(to - source) == 2:
            corner, beside = (to + 1, to - 1) if to > source else (to - 2, to + 1)
            codes[corner], codes[beside] = 0, own + 4
        ep = 255
        if kind == 1 and abs(to - source) == 16:
            taker = 7 - own
            if (to % 8 and codes[to - 1] == taker) or (to % 8 < 7 and codes[to + 1] == taker):
                ep = (source + to) // 2
        return Board(codes, 1 - self.side, self.castling & ~(LOST.get(source, 0) | LOST.get(to, 0)), ep)

    def legal(self, kind: int, to: int) -> list[int]:
        return [f for f in self.sources(kind, to) if not self.played(f, to).checked(self.side)]

    def can_move(self) -> bool:
        return any(self.legal(kind, to) for kind in (6, 1, 2, 3, 4, 5) for to in range(64))


def square(name: str) -> int:
    return "abcdefgh".index(name[0]) + 8 * (int(name[1]) - 1)


def square_name(s: int) -> str:
    return "abcdefgh"[s % 8] + str(s // 8 + 1)


def told_apart(source: int, others: list[int]) -> str:
    """What of its square names the man among others that may go there too."""
    others = [o for o in others if o != source]
    if not others:
        return ""
    if all(o % 8 != source % 8 for o in others):
        return square_name(source)[0]
    return square_name(source)[1] if all(o // 8 != source // 8 for o in others) else square_name(source)


_SAN = re.compile(SAN)


def resolved(board: Board, san: str, strict: bool = True) -> tuple[int, int, int] | None:
    """Source, target and promotion of the one legal move that the text names. strict: not more of the source than needed."""
    found = _SAN.match(san)
    if not found:
        return None
    if san[0] == "O":
        to = 2 if san.rstrip("+#") == "O-O" else -2
        return next(((a, b, 0) for a, b in board.castles() if b - a == to), None)
    letter, file, rank, takes, target, promotes = found.groups()
    kind, to = LETTERS.index(letter or "P"), square(target)
    taking = bool(board.codes[to]) or (kind == 1 and to == board.ep)
    if taking != bool(takes) or bool(promotes) != (kind == 1 and to // 8 in (0, 7)) or (promotes and promotes not in "QRBN"):
        return None
    every = board.legal(kind, to)
    fit = [f for f in every if (not file or square_name(f)[0] == file) and (not rank or square_name(f)[1] == rank)]
    if len(fit) != 1 or (kind == 1 and taking and not file):
        return None
    if strict and kind > 1 and (file or "") + (rank or "") != told_apart(fit[0], every):
        return None
    return fit[0], to, LETTERS.index(promotes) if promotes else 0


def notation(board: Board, source: int, to: int, promotion: int, after: Board) -> str:
    """The move in the standard notation, with check and mate."""
    kind = board.codes[source] - 6 * board.side
    if kind == 6 and abs(to - source) == 2:
        text = "O-O" if to > source else "O-O-O"
    else:
        taking = board.codes[to] or (kind == 1 and to == board.ep)
        lead = (square_name(source)[0] if taking else "") if kind == 1 else LETTERS[kind] + told_apart(source, board.legal(kind, to))
        text = lead + "x" * bool(taking) + square_name(to) + (f"={LETTERS[promotion]}" if promotion else "")
    return text + ("" if not after.checked(after.side) else "+" if after.can_move() else "#")


#: The record of the usual first position, as hexadecimal digits.
FIRST = "".join(f"{c:02X}" for c in [4, 2, 3, 5, 6, 3, 2, 4, *[1] * 8, *[0] * 32, *[7] * 8, 10, 8, 9, 11, 12, 9, 8, 10, 0, 15, 255])


def started(rows: DataFrame, start: str = "fen") -> DataFrame:
    """rows with record and valid, of their first position: the usual one, a constant, where start is null or no column, else that of
    the text, each different one read once."""
    usual = lambda df: df.withColumns({"record": F.unhex(F.lit(FIRST)), "valid": F.lit(True)})
    if start not in rows.columns:
        return usual(rows)
    fens = rows.where(F.col(start).isNotNull()).select(F.col(start).alias("_fen")).distinct()
    read = boards.with_masks(fens, "_fen").select(F.col("_fen").alias(start), boards.record().alias("record"), "valid")
    return usual(rows.where(F.col(start).isNull())).unionByName(rows.where(F.col(start).isNotNull()).join(read, start).select(*rows.columns, "record", "valid"))


def made(board: Board, move: tuple[int, int, int] | None) -> tuple[str, str, bytes, Board] | None:
    """Notation, UCI text, record and position after a move."""
    if move is None:
        return None
    after = board.played(*move)
    return notation(board, *move, after), square_name(move[0]) + square_name(move[1]) + ("nbrq"[move[2] - 2] if move[2] else ""), after.record(), after


_UCI = re.compile("^([a-h][1-8])([a-h][1-8])([nbrq])?$")


def coordinates(board: Board, uci: str) -> tuple[int, int, int] | None:
    """The legal move that coordinates name."""
    found = _UCI.match(uci)
    if not found:
        return None
    source, to, promotion = square(found[1]), square(found[2]), "nbrq".index(found[3]) + 2 if found[3] else 0
    kind = board.codes[source] - 6 * board.side
    if not 1 <= kind <= 6 or bool(promotion) != (kind == 1 and to // 8 in (0, 7)):
        return None
    if kind == 6 and (source, to) in board.castles():
        return source, to, 0
    return (source, to, promotion) if source in board.legal(kind, to) else None


def variations(rows: DataFrame, key: str, pv: str = "pv", start: str = "fen") -> DataFrame:
    """key and moves (array, in the standard notation) of a line of coordinates parted by blanks, up to its first move that isn't
    legal. A null line has none, and neither has one from a position that isn't valid."""
    held = started(rows.select(key, F.coalesce(pv, F.lit("")).alias("_pv"), F.col(start).alias("_fen")), "_fen").select(key, "_pv", "record", "valid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[bytes, str], tuple | None] = {}  # of one batch: lines from one position begin alike
        for batch in batches:
            known.clear()
            out = []
            for line, record, valid in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                board, moves = Board.of(record), []
                for uci in line.split() if valid else []:
                    if (record, uci) not in known:
                        known[record, uci] = made(board, coordinates(board, uci))
                    step = known[record, uci]
                    if step is None:
                        break
                    moves.append(step[0])
                    record, board = step[2], step[3]
                out.append(moves)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], [key, "moves"])

    return held.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, moves array<string>")


PLAYED = "records array<binary>, moves array<string>, uci array<string>, error string, made int"


class Line:
    """The moves of the last game, to be taken over as far as the next one has them too."""

    def __init__(self, strict: bool):
        self.strict = strict
        self.text: list[str] = []
        self.boards: list[Board] = []
        self.records: list[bytes] = []
        self.moves: list[str] = []
        self.uci: list[str] = []
        self.refused: str | None = None  # what could not be played after these

    def play(self, record: bytes, text: list[str]) -> tuple[list[bytes], list[str], list[str], str | None, int]:
        """Records, moves, coordinates, error, and how many moves were made for this game."""
        same = 0
        if not self.records or self.records[0] != record:
            self.records, self.boards = [record], [Board.of(record)]
        else:
            while same < len(self.text) and same < len(text) and self.text[same] == text[same]:
                same += 1
        if same < len(self.text) or self.refused != (text[same] if same < len(text) else None):
            self.refused = None
        del self.text[same:], self.moves[same:], self.uci[same:], self.records[same + 1 :], self.boards[same + 1 :]
        made_now, error = 0, None
        for n, san in enumerate(text[same:], same + 1):
            step = None
            if self.refused is None:
                made_now += 1
                step = made(self.boards[-1], resolved(self.boards[-1], san, self.strict))
            if step is None:
                self.refused, error = san, f"illegal_move_{n}"
                break
            self.text.append(san)
            for held, value in zip((self.moves, self.uci, self.records, self.boards), step, strict=True):
                held.append(value)
        return list(self.records), list(self.moves), list(self.uci), error, made_now


def walked(games: DataFrame, key: str, strict: bool = True, start: str = "fen") -> DataFrame:
    """played() with made: how many moves were made for a game. Over all games these are as many as different move prefixes,
    and those that stand at the borders of ranges again."""
    held = started(games.select(key, "moves", *([start] if start in games.columns else [])), start).select(key, "moves", "record", "valid")
    # equal games are told apart by their keys, so that many of them split too
    ranges = int(games.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = held.repartitionByRange(ranges, "record", "moves", F.xxhash64(key)).sortWithinPartitions("record", "moves")
    kind = games.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = Line(strict)
        for batch in batches:
            out = [line.play(record, moves or []) if valid else ([record], [], [], "bad_start", 0) for moves, record, valid in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            kinds = (pa.list_(pa.binary()), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True))], [key, "records", "moves", "uci", "error", "made"])

    return ordered.mapInArrow(run, f"{key} {kind.simpleString()}, {PLAYED}")


def played(games: DataFrame, key: str, strict: bool = True, start: str = "fen") -> DataFrame:
    """key, records (of all positions, from the first), moves (in canonical notation), uci, and error (null, or the number
    of the first move that is no legal one; what comes before it stays). games: key, moves (array of text; null counts as
    none) and, if it has the column, start (FEN; null: the usual first position). Repeated rows repeat."""
    return walked(games, key, strict, start).drop("made")


def positions(games: DataFrame, key: str) -> DataFrame:
    """key, ply and record of games as played() gives them, and move (in canonical notation, null at the last position)."""
    zipped = F.posexplode(F.arrays_zip("records", "moves")).alias("ply", "z")
    return games.select(key, zipped).select(key, "ply", F.col("z.records").alias("record"), F.col("z.moves").alias("move"))
