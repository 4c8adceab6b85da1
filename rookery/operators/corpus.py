"""From played games to the star of positions, games, occurrences and records, and openings by position."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boards
from . import replay, store


def star(games: DataFrame, key: str) -> dict[str, DataFrame]:
    """positions(id, record, white_pawns, black_pawns), games(id, fingerprint, content), occurrences(id, game_id, ply,
    position_id, move) and records(id, record_id, game_id, metadata). games: as replay.played() gives them, with key and
    headers; rows with an error are left out, and repeated rows make a record each.

    A game is its first position and its moves; equal ones are one game under several records. Ids follow from the
    rows alone. Games are replayed once: their plies and what is numbered are kept on the executors' disks for the four tables. The first
    position, which most games share, meets its id by broadcast."""
    held = games.where("error IS NULL").withColumn("content", F.concat(F.col("records")[0], F.encode(F.concat(F.lit(" "), F.array_join("uci", " ")), "utf-8")))
    held = held.withColumn("fingerprint", F.unhex(F.sha2("content", 256))).persist(StorageLevel.DISK_ONLY)
    identity = ["fingerprint", "content"]
    one = store.numbered(held.groupBy(*identity).agg(F.any_value("records").alias("records"), F.any_value("moves").alias("moves")), identity).persist(StorageLevel.DISK_ONLY)
    plies = one.select(F.col("id").alias("game_id"), F.posexplode(F.arrays_zip("records", "moves")).alias("ply", "z")).select("game_id", "ply", F.col("z.records").alias("record"), F.col("z.moves").alias("move"))
    positions = boards.from_record(store.numbered(plies.select("record").distinct(), ["record"])).select("id", "record", F.col("wp").alias("white_pawns"), F.col("bp").alias("black_pawns")).persist(StorageLevel.DISK_ONLY)
    named = positions.select(F.col("id").alias("position_id"), "record")
    usual = F.broadcast(named.where(F.col("record") == F.unhex(F.lit(replay.FIRST))))  # one row
    rest = plies.where(F.col("record") != F.unhex(F.lit(replay.FIRST)))
    occurrences = store.numbered(plies.join(usual, "record").unionByName(rest.join(named, "record")).drop("record"), ["game_id", "ply"])
    named = held.select(F.col(key).cast("string").alias("record_id"), F.col("headers").alias("metadata"), *identity).join(one.select(F.col("id").alias("game_id"), *identity), identity)
    # maps don't order, so equal keys are told apart by their game
    records = store.numbered(named.drop(*identity), ["record_id", "game_id"])
    return {"positions": positions, "games": one.select("id", *identity), "occurrences": occurrences.select("id", "game_id", "ply", "position_id", "move"), "records": records.select("id", "record_id", "game_id", "metadata")}


def openings(lines: DataFrame) -> DataFrame:
    """position (record), eco, name and plies of lines(eco, name, moves): each names the position that it ends in, the
    longest line wins, and lines that can't be played are left out."""
    named = lines.select(F.struct("eco", "name").alias("line"), F.col("moves"))
    ends = replay.played(named.select(F.to_json("line").alias("line"), "moves"), "line").where("error IS NULL AND size(records) > 1")
    rows = ends.select(F.from_json("line", "eco string, name string").alias("o"), F.element_at("records", -1).alias("position"), F.size("moves").alias("plies"))
    return store.longest_wins(rows.select("position", "o.eco", "o.name", "plies"))


def backfilled_moves(occurrences: DataFrame, games: DataFrame) -> DataFrame:
    """occurrences with moves that are null taken from games(id, moves); what has one keeps it."""
    known = games.select(F.col("id").alias("game_id"), F.col("moves").alias("_moves"))
    move = F.coalesce("move", F.try_element_at("_moves", (F.col("ply") + 1).cast("int")))
    return occurrences.join(known, "game_id", "left").withColumn("move", move).drop("_moves")
