"""Game files as DataFrames: framing, headers, the filter on them, move tokens and annotations.

A file is read as text split at the tag that opens a game, so large files split
too; headers are one regular expression, and the filter on them comes before any
move text is looked at.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.once import made_once

OPENING = "[Event "
#: Longer games are malformed.
MOST_BYTES = 100_000
RESULTS = ("1-0", "0-1", "1/2-1/2", "*")
#: Games faster than this many seconds count as bullet.
BULLET_SECONDS = 180


def read(spark: SparkSession, path: str) -> DataFrame:
    """file and pgn, one row for each game of plain or compressed files. Text before the first game of a file is a row
    of its own, which framed() marks as malformed."""
    rows = spark.read.option("lineSep", "\n" + OPENING).text(path)
    text = F.when(F.startswith("value", F.lit("[")), F.col("value")).otherwise(F.concat(F.lit(OPENING), F.col("value")))
    return rows.select(F.col("_metadata.file_path").alias("file"), text.alias("pgn")).where("trim(pgn) <> ''")


def placed(spark: SparkSession, path: str) -> DataFrame:
    """read() with the place of each game: block (where its part of the file begins) and row (ascending within it)."""
    rows = spark.read.option("lineSep", "\n" + OPENING).text(path)
    text = F.when(F.startswith("value", F.lit("[")), F.col("value")).otherwise(F.concat(F.lit(OPENING), F.col("value")))
    held = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), text.alias("pgn"))
    return held.where("trim(pgn) <> ''")


def sliced(games: DataFrame, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Games of placed() in file order after the first skip, at most limit of them, with number (from 1 over all files): where an
    import that stopped at a number goes on. Counts for each part of a file give its first number."""
    if skip < 0 or (limit is not None and limit < 0):
        raise ValueError("invalid_limit")
    upto = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part of a file
    before = games.groupBy("file", "block").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("row"))
    held = games.withColumn("_own", own).join(before, ["file", "block"]).withColumn("number", F.col("_before") + F.col("_own")).drop("_before", "_own")
    held = held.where(F.col("number") > skip)
    return held if limit is None else held.where(F.col("number") <= skip + limit)


def counters(games: DataFrame, rating: int | None = None, allow_bullet: bool = False) -> DataFrame:
    """One row over the games of read(): read, filtered (by their headers), and of the rest malformed and imported."""
    passes = made_once(with_headers(games), _passes=_passes(rating, allow_bullet))
    malformed = framed(passes.where("_passes")).agg(F.count("*").alias("passed"), F.count("error").alias("malformed"))
    return games.agg(F.count("*").alias("read")).join(malformed, F.lit(True)).select("read", (F.col("read") - F.col("passed")).alias("filtered"), "malformed", (F.col("passed") - F.col("malformed")).alias("imported"))


def with_headers(games: DataFrame) -> DataFrame:
    return games if "headers" in games.columns else made_once(games, headers=headers(F.col("pgn")))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value made once: within it a variable, where Python's name would stand for the whole expression."""
    return F.transform(F.array(value), use)[0]


def headers(pgn: Column) -> Column:
    """Tags as a map with keys in snake_case; backslashes escape, the last of equal tags counts."""
    pattern = r'\[(\w+)\s+"((?:[^"\\]|\\.)*)"\]'

    def zipped(head: Column) -> Column:
        keys = F.transform(F.regexp_extract_all(head, F.lit(pattern), F.lit(1)), snake_case)
        values = F.transform(F.regexp_extract_all(head, F.lit(pattern), F.lit(2)), lambda v: F.regexp_replace(v, r"\\(.)", "$1"))
        return F.arrays_zip(keys.alias("k"), values.alias("v"))

    def last(pairs: Column) -> Column:
        return F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))

    head = F.regexp_extract(pgn, r'^\s*((?:\[[^\n]*\]\s*\n?)*)', 1)
    held = _bound(_bound(head, zipped), last)
    return F.map_from_entries(F.transform(held, lambda p: F.struct(p["k"], p["v"])))


def snake_case(tag: Column) -> Column:
    """WhiteElo to white_elo, ECO to eco."""
    return F.lower(F.regexp_replace(F.regexp_replace(tag, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2"))


def movetext(pgn: Column) -> Column:
    return F.trim(F.regexp_replace(pgn, r'^\s*(?:\[[^\n]*\]\s*\n?)*', ""))


def stripped(moves: Column, depth: int = 20) -> Column:
    """Move text without comments, annotation glyphs and variations up to a depth."""
    text = F.regexp_replace(F.regexp_replace(moves, r"\{[^}]*\}", " "), r";[^\n]*", " ")
    text = F.regexp_replace(text, r"\$\d+", " ")
    # each round removes the innermost variations; none are left when a round changes nothing
    inner = lambda t, _: F.when(F.contains(t, F.lit("(")), F.regexp_replace(t, r"\([^()]*\)", " ")).otherwise(t)
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), text, inner)


def tokens(moves: Column) -> Column:
    """Moves of stripped text in order: numbers, results and suffixes gone, castling with letters."""
    return _words(stripped(moves))


def _words(bare: Column) -> Column:
    text = F.regexp_replace(bare, r"\d+\.(?:\.\.)?", " ")
    parts = F.filter(F.split(F.trim(text), r"\s+"), lambda t: (t != "") & ~t.isin(*RESULTS))
    clean = lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "0-0-0", "O-O-O"), "0-0", "O-O"), r"(?:e\.p\.)?[!?]*$", "")
    return F.filter(F.transform(parts, clean), lambda t: t != "")


#: A move in the standard notation: castling, or piece, origin, capture, target, promotion, check.
SAN = r"^(?:O-O(?:-O)?|([KQRBN])?([a-h])?([1-8])?(x)?([a-h][1-8])(?:=([QRBN]))?)[+#]?$"


def framed(games: DataFrame) -> DataFrame:
    """Adds headers, moves (array), result and error: null, or why the row is no single game. Malformed rows stay, for the
    caller to count or refuse."""
    own = with_headers(games).drop("moves", "result", "error")
    held = made_once(own, _text=movetext(F.col("pgn")))
    held = made_once(held, _bare=stripped(F.col("_text")))
    held = made_once(held, moves=_words(F.col("_bare")))
    bare = F.col("_bare")
    error = (
        F.when(F.octet_length("pgn") > MOST_BYTES, "too_long")
        .when(~F.startswith(F.ltrim("pgn"), F.lit("[")), "no_headers")
        .when(F.regexp_count(bare, F.lit(r"(?m)^\s*\[\w+ \"")) > 0, "several_games")
        .when(F.regexp_count(bare, F.lit(r"(?:^|\s)1\.(?!\d)(?!\.\.)")) > 1, "several_games")
        .when(F.regexp_like(bare, F.lit(r"(?:1-0|0-1|1/2-1/2|\*)\s+\S")), "content_after_result")
        .when(set_up_without_fen(F.col("headers")), "setup_without_fen")
        .when(F.size("moves") == 0, "no_moves")
        .when(F.exists("moves", lambda m: ~F.regexp_like(m, F.lit(SAN))), "bad_move")
    )
    result = F.coalesce(F.try_element_at("headers", F.lit("result")), F.lit("*"))
    return made_once(held, result=result, error=error).select(*own.columns, "moves", "result", "error")


def set_up_without_fen(headers: Column) -> Column:
    """Whether one of the tags of another first position is there without the other."""
    return (F.coalesce(F.try_element_at(headers, F.lit("set_up")), F.lit("0")) == "1") != F.try_element_at(headers, F.lit("fen")).isNotNull()


#: What Java's $ says in Python: the end, or in front of a last line terminator (words have no others).
END = r"(?=[\x85\u2028\u2029]?\Z)"
_HEAD = re.compile(r"\A\s*(?:\[[^\n]*\]\s*\n?)*", re.ASCII)
_COMMENTS, _RESTS, _GLYPHS, _INNER = (re.compile(x, re.ASCII) for x in (r"\{[^}]*\}", r";[^\n]*", r"\$\d+", r"\([^()]*\)"))
_TAG = re.compile(r'(?:\A|(?<=[\n\r\x85\u2028\u2029]))\s*\[\w+ "', re.ASCII)
_FIRST, _BEHIND = re.compile(r"(?:\A|\s)1\.(?!\d)(?!\.\.)", re.ASCII), re.compile(r"(?:1-0|0-1|1/2-1/2|\*)\s+\S", re.ASCII)
_NUMBER, _WORD = re.compile(r"\d+\.(?:\.\.)?", re.ASCII), re.compile(r"\S+", re.ASCII)
_SUFFIX, _MOVE = re.compile(r"(?:e\.p\.)?[!?]*" + END), re.compile(SAN.removesuffix("$") + END)


def move_text(text: str) -> str:
    """movetext() of one text."""
    return _HEAD.sub("", text, count=1).strip(" ")


@lru_cache(10_000)
def _legible(word: str) -> bool | None:
    """Whether a word of bare text is a move; None if it says nothing."""
    word = _SUFFIX.sub("", word.replace("0-0-0", "O-O-O").replace("0-0", "O-O")) if word not in RESULTS else ""
    return _MOVE.match(word) is not None if word else None


def fault(text: str, set_up: bool = False, depth: int = 20) -> str | None:
    """The error that framed() gives a text of at most MOST_BYTES, for work on it in Python. set_up: set_up_without_fen() of its headers."""
    if not text.lstrip(" ").startswith("["):
        return "no_headers"
    bare = _GLYPHS.sub(" ", _RESTS.sub(" ", _COMMENTS.sub(" ", move_text(text))))
    for _ in range(depth):
        if "(" not in bare:
            break
        bare = _INNER.sub(" ", bare)
    if ("[" in bare and _TAG.search(bare)) or len(_FIRST.findall(bare)) > 1:
        return "several_games"
    if _BEHIND.search(bare):
        return "content_after_result"
    if set_up:
        return "setup_without_fen"
    moves = [m for m in map(_legible, _WORD.findall(_NUMBER.sub(" ", bare))) if m is not None]
    return "no_moves" if not moves else None if all(moves) else "bad_move"


def _passes(rating: int | None, allow_bullet: bool) -> Column:
    tag = lambda k: F.try_element_at("headers", F.lit(k))
    terms = F.lit(True)
    if rating is not None:
        for side in ("white_elo", "black_elo"):
            terms &= F.coalesce(F.when(tag(side).rlike("^[0-9]+$"), tag(side)).try_cast("int") >= rating, F.lit(False))
    if not allow_bullet:
        seconds = F.regexp_extract(F.coalesce(tag("time_control"), F.lit("")), r"^(\d+)", 1).try_cast("int")
        terms &= ~F.coalesce(F.contains(tag("event"), F.lit("Bullet")), F.lit(False)) & ~F.coalesce(seconds < BULLET_SECONDS, F.lit(False))
    return terms


def kept(games: DataFrame, rating: int | None = None, allow_bullet: bool = False) -> DataFrame:
    """Rows whose headers pass: both ratings are there and high enough, and the game is no bullet. Games without the column
    headers get it first; framed() then takes it over, so that only moves of games that pass are looked at."""
    return with_headers(games).where(_passes(rating, allow_bullet))


def with_provenance(games: DataFrame, source: str, detail: str | None = None) -> DataFrame:
    """Adds source and source_detail to the headers; they are no part of a game's identity."""
    extra = {"source": source} | ({"source_detail": detail} if detail else {})
    added = F.create_map(*[F.lit(x) for pair in extra.items() for x in pair])
    return games.withColumn("headers", F.map_concat(F.map_filter("headers", lambda k, _: ~k.isin(*extra)), added))


def annotations(games: DataFrame, key: str) -> DataFrame:
    """key, place, kind (comment, nag, clock, eval) and value: what annotates the moves, in order."""
    found = F.regexp_extract_all(movetext(F.col("pgn")), F.lit(r"(\{[^}]*\}|\$\d+)"), F.lit(1))
    rows = games.select(key, F.posexplode(found).alias("place", "text"))
    command = lambda name: F.nullif(F.regexp_extract("text", rf"\[%{name} ([^\]]*)\]", 1), F.lit(""))
    plain = F.nullif(F.trim(F.regexp_replace(F.regexp_replace("text", r"\[%[^\]]*\]", ""), r"[{}]", "")), F.lit(""))
    kinds = F.array(
        F.struct(F.lit("nag").alias("kind"), F.when(F.startswith("text", F.lit("$")), F.substring("text", 2, 9)).alias("value")),
        F.struct(F.lit("clock").alias("kind"), command("clk").alias("value")),
        F.struct(F.lit("eval").alias("kind"), command("eval").alias("value")),
        F.struct(F.lit("comment").alias("kind"), F.when(F.startswith("text", F.lit("{")), plain).alias("value")),
    )
    return rows.select(key, "place", F.explode(kinds).alias("a")).where("a.value IS NOT NULL").select(key, "place", "a.kind", "a.value")


def openings(spark: SparkSession, path: str) -> DataFrame:
    """eco, name and moves (array) of tab-separated volumes with a header line; lines without moves are left out."""
    rows = spark.read.option("sep", "\t").option("header", True).schema("eco string, name string, pgn string").csv(path)
    return rows.select("eco", "name", tokens(F.col("pgn")).alias("moves")).where(F.size("moves") > 0)


def provider(spark: SparkSession, path: str) -> DataFrame:
    """id and pgn of JSON lines as game servers export them; the moves field stands in where no pgn is given."""
    rows = spark.read.schema("id string, pgn string, moves string, url string").json(path)
    return rows.select(F.coalesce("id", "url").alias("id"), F.coalesce("pgn", "moves").alias("pgn")).where("id IS NOT NULL AND pgn IS NOT NULL")
