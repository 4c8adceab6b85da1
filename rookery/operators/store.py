"""Writes as set operations: identity by content, stable ids, upserts, and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Buckets of numbered(), each of which one task orders.
BUCKETS = 1_024


def numbered(df: DataFrame, order: list[Column | str], after: Column | int = 0, name: str = "id", buckets: int = BUCKETS) -> DataFrame:
    """Consecutive ids in the order of a hash of the order columns and then of these, from after + 1: the same rows get
    the same ids, however they are partitioned. Counts per bucket give each bucket its first id, so that no task
    orders everything. Nothing runs before the result is asked for; df then runs for the counts and for the rows."""
    held = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sums = held.groupBy("_bucket").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = sums.withColumn("_base", F.sum("_n").over(w) - F.col("_n")).drop("_n")
    within = Window.partitionBy("_bucket").orderBy(*order)
    start = after if isinstance(after, Column) else F.lit(after)
    return held.withColumn("_place", F.row_number().over(within)).join(F.broadcast(base), "_bucket").withColumn(name, (F.col("_base") + F.col("_place") + start).cast("long")).drop("_bucket", "_place", "_base")


def insert_or_get(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """existing(id, key...) with a row for each new distinct key of incoming, numbered after the largest id."""
    fresh = incoming.select(*key).distinct().join(existing, key, "left_anti")
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("_top"))
    new = numbered(fresh, list(key)).join(F.broadcast(top), F.lit(True)).select((F.col("id") + F.col("_top")).alias("id"), *key)
    return existing.select("id", *key).unionByName(new)


def dictionary_encode(dictionary: DataFrame, atoms: DataFrame) -> DataFrame:
    """Appends the unseen atoms to dictionary(id, atom); ids never change."""
    return insert_or_get(dictionary, atoms, ["atom"])


def deduplicated(games: DataFrame) -> DataFrame:
    """One game for each (fingerprint, content), the first by id; a fingerprint alone is only a bucket."""
    return games.groupBy("fingerprint", "content").agg(F.min("id").alias("id"))


def occurrences_of(games: DataFrame) -> DataFrame:
    """game_id, ply, position_id, move of games(id, positions array, moves array): n + 1 rows for n moves, the last without move."""
    zipped = F.posexplode(F.arrays_zip("positions", "moves")).alias("ply", "z")
    return games.select(F.col("id").alias("game_id"), zipped).select("game_id", "ply", F.col("z.positions").alias("position_id"), F.col("z.moves").alias("move"))


def integrity(occurrences: DataFrame) -> DataFrame:
    """A row for each game whose plies don't run from 0 without gaps or repeats, or which lacks a move before its last ply."""
    held = occurrences.groupBy("game_id").agg(F.count("*").alias("rows"), F.count_distinct("ply").alias("plies"), F.min("ply").alias("first"), F.max("ply").alias("last"), F.count("move").alias("moves"))
    return held.where((F.col("rows") != F.col("plies")) | (F.col("first") != 0) | (F.col("last") != F.col("rows") - 1) | (F.col("moves") < F.col("rows") - 1))


def upsert(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last in order; with ["depth", "seq"] the deepest, and of equal depth the latest."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def missing(rows: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """What a backfill has still to do."""
    return rows.join(done, on, "left_anti")


def longest_wins(lines: DataFrame) -> DataFrame:
    """For each position the name with the longest line; of equal ones the first by code, then by name."""
    best = F.min_by(F.struct("eco", "name", "plies"), F.struct((-F.col("plies")).alias("p"), "eco", "name"))
    return lines.groupBy("position").agg(best.alias("b")).select("position", "b.*")


def expired_without(parents: DataFrame, children: DataFrame, on: str, older_than: Column, limit: int) -> DataFrame:
    """The oldest parents without children."""
    return parents.where(older_than).join(children, on, "left_anti").orderBy("created", on).limit(limit)


def with_children(parents: DataFrame, children: DataFrame, on: str, child: str, inactive: Column) -> DataFrame:
    held = children.groupBy(on).agg(F.array_sort(F.collect_list(child)).alias("children"))
    return parents.where(inactive).join(held, on, "left").withColumn("children", F.coalesce("children", F.array().cast(held.schema["children"].dataType)))


def orphans(parents: DataFrame, first: DataFrame, second: DataFrame, on: str) -> DataFrame:
    return parents.join(first, on, "left_anti").join(second, on, "left_anti")


def expired(rows: DataFrame, key: str, now: Column, limit: int = 1_000) -> DataFrame:
    """Keys of the rows that a sweep takes: the first to expire, up to now, and no more than limit."""
    return rows.where(F.col("expires_at") <= now).orderBy("expires_at", key).limit(limit).select(key)


def associated(existing: DataFrame, parents: DataFrame, new: DataFrame, parent: str, child: str) -> DataFrame:
    """existing(parent, child) with each new pair whose parent is there; a pair that is there already changes nothing."""
    fresh = new.select(parent, child).distinct().join(parents.select(parent), parent, "left_semi").join(existing, [parent, child], "left_anti")
    return existing.select(parent, child).unionByName(fresh)


def cached(rows: DataFrame, cache: DataFrame, on: list[str]) -> DataFrame:
    """rows with what a cache (one row for each key) knows of them, and cached: whether it knows them."""
    return rows.join(cache.withColumn("cached", F.lit(True)), on, "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def inserted(existing: DataFrame, incoming: DataFrame, key: str, order: list[str], fault: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to add, errors) of incoming: an error is fault where that is not null, else duplicate_in_batch for all but the
    first of a key in order, else already_exists. Errors carry all columns of incoming and error."""
    valid = F.col("_fault").isNull()
    first = F.row_number().over(Window.partitionBy(key, valid).orderBy(*order))
    marks = existing.select(key).distinct().withColumn("_there", F.lit(True))
    held = incoming.withColumn("_fault", fault.cast("string")).withColumn("_n", first).join(marks, key, "left")
    held = held.withColumn("error", F.coalesce("_fault", F.when(F.col("_n") > 1, "duplicate_in_batch").when(F.col("_there"), "already_exists")))
    return held.where("error IS NULL").select(*incoming.columns), held.where("error IS NOT NULL").select(*incoming.columns, "error")


def revisions(updates: DataFrame) -> DataFrame:
    """Folds updates(key, seq, expected, value) in order of seq: one counts if it expects the revision that those before
    it made, from 0. key, revision and the last value that counted.

    What counts is a run: revision r is made by the first update after that of r - 1 that expects r - 1."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "expected", "value")))
    start = F.struct(F.lit(0).cast("long").alias("revision"), F.lit(None).cast(updates.schema["value"].dataType).alias("value"))
    fold = F.aggregate(ordered, start, lambda s, u: F.when(u["expected"] == s["revision"], F.struct((s["revision"] + 1).alias("revision"), u["value"].alias("value"))).otherwise(s))
    return updates.groupBy("key").agg(fold.alias("s")).select("key", "s.revision", "s.value")
