"""Annotated games as trees: side lines, comments, glyphs, clocks and evaluations at the moves that they belong to.

A game's tree depends on no other game: its text is taken apart in one loop with a
stack of open brackets, and its moves are played out in a second one. So games need
no shuffle, and what a batch makes is as long as its games. A move follows the one
before it in its line; the first of a line follows what the move follows that it
stands in for. Texts that a batch holds more than once are taken apart once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boards
from ..functions.once import made_once
from ..sources import pgn
from . import replay

# The notation's tokens (comments, rests of lines, brackets, numeric glyphs, words, and what is left over of an
# unclosed comment or a lonely glyph sign), the glyphs of its symbols, what is wrong with lonely signs, and how many glyphs a move has, and the largest.
TOKEN = r"\{[^}]*\}|;[^\r\n]*|[()]|\$\d+|[^\s{}();$]+|[{}$]"
SYMBOLS = {"!": 1, "?": 2, "!!": 3, "??": 4, "!?": 5, "?!": 6}
LONELY = {"{": "unclosed_comment", "}": "bad_move", "$": "bad_glyph"}
MOST_GLYPHS, LARGEST_GLYPH = 8, 255
ROOT = 0
#: How many rows go out together, if no single game has more, and how many steps of games are remembered.
ROWS, STEPS = 20_000, 20_000

_TOKEN = re.compile(TOKEN, re.ASCII)
_NUMBER = re.compile(r"\A\d+\.(?:\.\.)?", re.ASCII)
_SUFFIX = re.compile(r"[!?]+" + pgn.END)
_COMMANDS, _EDGES = re.compile(r"\[%[^\]]*\]"), re.compile(r"\A\{|\}" + pgn.END + r"|\A;")
_CLOCK, _EVALUATION = (re.compile(rf"\[%{name}\s+([^\]]+)\]", re.ASCII) for name in ("clk", "eval"))


@lru_cache(10_000)
def _word(token: str) -> tuple[str, str, int | None]:
    """Kind (move, glyph or none), move and glyph of a word."""
    word = _NUMBER.sub("", token)
    if word == "" or word in pgn.RESULTS:
        return "none", "", None
    suffix = _SUFFIX.search(word)
    glyph = SYMBOLS.get(suffix[0], LARGEST_GLYPH + 1) if suffix else None
    return "glyph" if word in SYMBOLS else "move", _SUFFIX.sub("", word), glyph


def nodes(text: str) -> tuple[tuple[list, ...] | None, str | None]:
    """parent, ply, depth, san, glyphs, comment, clock and evaluation of the first position (node ROOT, with the comments before the
    first move) and of all moves of a move text, in its order; or why it has no tree."""
    parents, plies, depths, sans, glyphs, comments, clocks, evaluations = [None], [0], [0], [None], [[]], [[]], [None], [None]
    # the last move of this line, or what its first one will follow; those of the lines around; comments before the first move
    last, fresh, around, before = ROOT, True, [], []
    for token in _TOKEN.findall(text):
        first = token[0]
        if token == "(":
            if fresh:
                return None, "variation_without_move"
            around.append(last)
            last, fresh, before = parents[last], True, []
        elif token == ")":
            if not around:
                return None, "unexpected_ending"
            last, fresh, before = around.pop(), False, []
        elif token in LONELY:
            return None, LONELY[token]
        elif first == "{" or first == ";":
            comment = _EDGES.sub("", _COMMANDS.sub("", token)).strip(" ")
            if comment:
                (before if fresh and around else comments[last]).append(comment)
            if not fresh and "[%" in token:
                for values, command in ((clocks, _CLOCK), (evaluations, _EVALUATION)):
                    if found := command.search(token):
                        values[last] = found[1]
        else:
            if first == "$":
                kind, san, glyph = "glyph", "", min(int(token[1:13]), LARGEST_GLYPH + 1)
            else:
                kind, san, glyph = _word(token)
            if kind == "move":
                parents.append(last)
                plies.append(plies[last] + 1)
                depths.append(len(around))
                sans.append(san)
                glyphs.append([])
                comments.append(before)
                clocks.append(None)
                evaluations.append(None)
                last, fresh, before = len(sans) - 1, False, []
            elif kind == "glyph" and fresh:
                return None, "annotation_without_move"
            if glyph is not None and glyph not in glyphs[last]:
                glyphs[last].append(glyph)
    if around:
        return None, "unclosed_variation"
    if len(sans) == 1:
        return None, "no_moves"
    if any(len(of) > MOST_GLYPHS or max(of, default=0) > LARGEST_GLYPH for of in glyphs):
        return None, "bad_annotations"
    return (parents, plies, depths, sans, glyphs, ["\n".join(of) or None for of in comments], clocks, evaluations), None


TREE = "node int, parent int, ply int, depth int, path array<int>, record binary, move string, uci string, glyphs array<int>, comment string, clock string, evaluation string"


def tree(games: DataFrame, key: str, comments: bool = True, side_lines: bool = True, commands: bool = False) -> DataFrame:
    """key, node, parent, ply, depth (of brackets), path (numbers of children from the root, from 1), record (the position that the
    node is), move (canonical notation), uci, glyphs, comment, clock, evaluation and error of games(key, pgn).

    A game has a row for its first position (node 0, no parent, path empty, with the comments before its first move) and one for
    each move, side lines too; a side line's first move is a sibling of the move that it follows in the text. A game that is
    malformed or holds a move that isn't legal, in whatever line, has one row with error alone. comments, side_lines: whether
    these are kept; commands: whether clocks and evaluations are. Null texts are malformed, repeated rows repeat, and a null
    key is a key. Other columns aren't read. No row is shuffled."""
    held = games.select(F.col(key).alias("_key"), F.coalesce("pgn", F.lit("")).alias("pgn"))
    # most games begin at the usual first position: only texts that seem to have tags of another one have their headers read
    tags = made_once(held, _tags=F.when(F.rlike("pgn", F.lit(r"(?i)\[(?:set_?up|fen)\s")), pgn.headers(F.col("pgn"))))
    tags = made_once(tags, _fen=F.try_element_at("_tags", F.lit("fen")), _set_up=F.coalesce(pgn.set_up_without_fen(F.col("_tags")), F.lit(False)))
    begun, other = boards.with_masks(tags, "_fen"), F.col("_fen").isNotNull()
    text = F.when(F.octet_length("pgn") <= pgn.MOST_BYTES, F.make_valid_utf8("pgn"))
    begun = begun.select(F.col("_key").alias(key), text.alias("pgn"), F.when(other, boards.record()).alias("record"), (~other | F.coalesce("valid", F.lit(False))).alias("valid"), "_set_up")
    kind = games.schema[key].dataType.simpleString()
    names = [*(x.split()[0] for x in TREE.split(", ")), "error"]
    lists, text = pa.list_(pa.int32()), pa.string()
    types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), lists, pa.binary(), text, text, lists, text, text, text, text)
    usual = bytes.fromhex(replay.FIRST)

    def made(text: str | None, record: bytes | None, valid: bool, set_up: bool, known: dict) -> tuple[tuple[list, ...] | None, str | None]:
        """Columns of a game, or its error."""
        if text is None:
            return None, "too_long"
        if error := pgn.fault(text, set_up):
            return None, error
        found, error = nodes(pgn.move_text(text))
        if error or not valid:
            return None, error or "bad_start"
        parents, plies, depths, sans, *said = found
        out, error = grown(record or usual, sans[1:], parents[1:], known)
        return (range(len(sans)), parents, plies, depths, *out, *said) if out else None, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[bytes, str], tuple | None] = {}  # side lines and openings often play the same
        for batch in batches:
            held = batch.column(1).dictionary_encode("encode")
            at = held.indices.to_numpy()
            games, ends = np.argsort(at, kind="stable"), np.cumsum(np.bincount(at, minlength=len(held.dictionary)))
            one = batch.take(pa.array(games[ends - np.bincount(at, minlength=len(ends))])) if len(batch) else batch
            columns, sizes, begin = [[] for _ in names], [], 0
            for i, row in enumerate(zip(*(one.column(c).to_pylist() for c in (1, 2, 3, 4)), strict=True)):
                if len(known) > STEPS:
                    known.clear()
                out, error = made(*row, known)
                sizes.append(len(out[0]) if out else 1)
                for column, values in zip(columns, (*(out or [[None]] * (len(names) - 1)), [error] * sizes[-1]), strict=True):
                    column += values
                if len(columns[0]) >= ROWS or i + 1 == len(one):
                    arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                    for game, rows in _dealt(games[begin : ends[i]], at, np.array(sizes), i + 1 - len(sizes)):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(game), *(a.take(rows) for a in arrays)], [key, *names])
                    columns, sizes, begin = [[] for _ in names], [], ends[i]

    whole = begun.mapInArrow(run, f"{key} {kind}, {TREE}, error string")
    if not side_lines:
        whole = whole.where("depth = 0 OR error IS NOT NULL")
    lost = [c for c, stays in (("comment", comments), ("clock", commands), ("evaluation", commands)) if not stays]
    return whole.withColumns({c: F.lit(None).cast("string") for c in lost})


def _dealt(games: np.ndarray, at: np.ndarray, sizes: np.ndarray, base: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """For each row that goes out its game, and its place among the rows of different texts, about ROWS at a time. games: with these
    texts; at: each game's text, from base; sizes: rows of each text."""
    starts, of = np.cumsum(sizes) - sizes, at[games] - base
    counts = sizes[of]
    pieces = np.cumsum(counts) // ROWS
    for piece in np.split(np.arange(len(games)), np.flatnonzero(np.diff(pieces)) + 1):
        n = counts[piece]
        rows = np.arange(n.sum()) + np.repeat(starts[of[piece]] - (np.cumsum(n) - n), n)
        yield pa.array(np.repeat(games[piece], n)), pa.array(rows)


def grown(record: bytes, sans: list[str], parents: list[int], known: dict) -> tuple[tuple[list, list, list, list] | None, str | None]:
    """Paths, records, moves and coordinates of a tree from its first position on, or the number of the first node that isn't legal."""
    boards, children, paths, records, moves, uci = [replay.Board.of(record)], [0], [[]], [record], [None], [None]
    for san, parent in zip(sans, parents, strict=True):
        step = records[parent], san
        if step not in known:
            known[step] = replay.made(boards[parent], replay.resolved(boards[parent], san))
        if known[step] is None:
            return None, f"illegal_node_{len(records)}"
        for column, value in zip((moves, uci, records, boards), known[step], strict=True):
            column.append(value)
        children[parent] += 1
        children.append(0)
        paths.append([*paths[parent], children[parent]])
    return (paths, records, moves, uci), None
