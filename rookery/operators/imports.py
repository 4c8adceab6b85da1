"""Imports that stop at the first game they can't take, results in the order of the input, and work that is done bit by bit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: games that are committed together, at most.
GROUP = 10
#: Numbers that running() counts as one part.
CHUNK = 10_000


def running(rows: DataFrame, by: str, number: str, name: str) -> DataFrame:
    """rows with their place (from 1) by number among those of the same by, from counts for each part of the numbers: a task gets
    CHUNK rows of one by at a time, however many there are."""
    held = rows.withColumn("_chunk", F.expr(f"{number} div {CHUNK}"))
    upto = Window.partitionBy(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    before = held.groupBy(by, "_chunk").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(by, "_chunk").orderBy(number))
    return held.withColumn("_own", own).join(before, [by, "_chunk"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_chunk", "_own", "_before")


def strict(games: DataFrame, existing: DataFrame, size: int = GROUP, skip_malformed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows to add, outcomes) of strict imports. games(source, number, record_id, fault, ...): a source's games have numbers from 1,
    fault is why a game is malformed, or null. existing(record_id): what is stored.

    A source is taken up to its first game that can't be: a malformed one (invalid_game, unless skip_malformed, which leaves those
    out and counts them), one without a record_id (invalid_record_id), with that of an earlier game that was taken
    (duplicate_record_id) or a stored one (record_exists). What comes before stays, in groups of size that are committed whole
    and numbered from 1, the last of which may be short; nothing behind is tried. Rows to add carry all columns and group;
    outcomes: source, imported, groups, malformed, and index, error and detail (fault) of where it stopped, null if it didn't.
    A null source is a source. An empty table has no outcomes."""
    if not 1 <= size <= GROUP:
        raise ValueError("invalid_batch_size")
    well = F.col("fault").isNull() & F.col("record_id").isNotNull()
    first = games.where(well).groupBy("source", "record_id").agg(F.min("number").alias("_first"))
    there = existing.select("record_id").distinct().withColumn("_there", F.lit(True))
    held = games.join(first.select(F.col("source").alias("_source"), F.col("record_id").alias("_id"), "_first"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("record_id") == F.col("_id")), "left").drop("_source", "_id")
    held = held.join(there, "record_id", "left")
    malformed = F.col("fault").isNotNull()
    reason = F.when(malformed, F.lit(None if skip_malformed else "invalid_game")).when(F.coalesce("record_id", F.lit("")) == "", "invalid_record_id").when(F.col("number") > F.col("_first"), "duplicate_record_id").when(F.col("_there"), "record_exists")
    held = held.withColumn("_reason", reason).drop("_first", "_there")
    stops = held.where("_reason IS NOT NULL").groupBy("source").agg(F.min(F.struct("number", "_reason", "fault")).alias("_stop")).withColumnRenamed("source", "_source")
    held = held.join(stops, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    before = F.col("_stop").isNull() | (F.col("number") < F.col("_stop.number"))
    taken = running(held.where(before & ~malformed).select(*games.columns).withColumn("_by", F.to_json(F.struct("source"))), "_by", "number", "_place")
    rows = taken.withColumn("group", F.expr(f"(_place - 1) div {size} + 1")).select(*games.columns, "group")
    outcomes = held.groupBy("source").agg(F.count_if(before & ~malformed).alias("imported"), F.count_if(before & malformed).alias("malformed"), F.any_value("_stop", ignoreNulls=True).alias("s"))
    return rows, outcomes.select("source", "imported", F.ceil(F.col("imported") / size).cast("long").alias("groups"), "malformed", F.col("s.number").alias("index"), F.col("s._reason").alias("error"), F.col("s.fault").alias("detail"))


def results(incoming: DataFrame, added: DataFrame, refused: DataFrame) -> DataFrame:
    """number, record_id, id and error for each row of incoming(number, record_id), in its order: added(record_id, id) is what a write
    has given ids, refused(number, error) what it refused. A batch with a refused row adds nothing: its other rows have neither id
    nor error."""
    faults = refused.select("number", "error")
    none = faults.agg((F.count("*") == 0).alias("_whole"))
    held = incoming.select("number", "record_id").join(faults, "number", "left").join(added.select("record_id", "id"), "record_id", "left").join(F.broadcast(none), F.lit(True))  # one row
    return held.select("number", "record_id", F.when(F.col("_whole"), F.col("id")).alias("id"), "error").orderBy("number")


# Fixed value: failed ids that a backfill remembers.
REMEMBERED = 10_000
#: Rows of one of its steps.
STEP = 1_000


def work(rows: DataFrame, done: DataFrame, failed: DataFrame, key: str, after: int, limit: int = STEP) -> DataFrame:
    """The next rows of a backfill: the first limit by key after the mark that are neither done nor failed. Top-k, so that a task
    sends limit rows at most."""
    return rows.where(F.col(key) > after).join(done.select(key), key, "left_anti").join(failed.select(key), key, "left_anti").orderBy(key).limit(limit)


def backfill(rows: DataFrame, key: str, make, read_done, write, failed: DataFrame, limit: int = STEP, steps: int | None = None) -> tuple[int, DataFrame]:
    """Fills in what is missing, step by step behind a high-water mark, and returns the mark and the failed ids.

    make(chunk) gives (done, failed): rows to write, and keys that couldn't be made. read_done() and write(done) reach the stored
    table; failed holds keys (column key) of earlier runs, which aren't tried again. A run that ends between two steps, or
    in one, loses nothing: what is written isn't missing any more. ValueError("too_many_failures") beyond REMEMBERED."""
    spark, mark = rows.sparkSession, -1
    lost = [r[0] for r in failed.select(key).limit(REMEMBERED + 1).collect()]
    kind = f"{key} long"
    while steps is None or steps > 0:
        if len(lost) > REMEMBERED:
            raise ValueError("too_many_failures")
        chunk = work(rows, read_done(), spark.createDataFrame([(i,) for i in lost], kind), key, mark, limit)
        keys = [r[0] for r in chunk.select(key).collect()]  # at most limit
        if not keys:
            break
        own = rows.where(F.col(key).isin(*keys))
        done, bad = make(own)
        write(done)
        lost += [r[0] for r in bad.select(key).limit(REMEMBERED + 1).collect()]
        mark = max(keys)
        steps = None if steps is None else steps - 1
    return mark, spark.createDataFrame([(i,) for i in lost], kind)


# Fixed value: pages of one run of a sync.
PAGES = 3


def synced(exports: DataFrame, cursors: DataFrame, page: int, pages: int = PAGES, refused: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(games to take in, cursors afterwards) of exports(source, at, id, ...), cursors(source, at, id): where each source's last run
    ended. A run takes the next games by (at, id), pages of a size at most; equal times are told apart by id, so that no game is
    taken twice or left out at a page's end. A source in refused(source) gives nothing and keeps its cursor; one without a
    cursor begins at its first game. Rows without source, at or id aren't reached."""
    held = exports.where("source IS NOT NULL AND at IS NOT NULL AND id IS NOT NULL")
    if refused is not None:
        held = held.join(refused.select("source"), "source", "left_anti")
    marks = cursors.select("source", F.struct("at", "id").alias("_mark"))
    held = held.join(marks, "source", "left").where(F.col("_mark").isNull() | (F.struct("at", "id") > F.col("_mark")))
    place = F.row_number().over(Window.partitionBy("source").orderBy("at", "id"))
    taken = held.withColumn("_n", place).where(F.col("_n") <= page * pages).withColumn("page", F.expr(f"(_n - 1) div {page} + 1")).select(*exports.columns, "page")
    ends = taken.groupBy("source").agg(F.max(F.struct("at", "id")).alias("_mark"))
    after = cursors.select("source", F.struct("at", "id").alias("_old")).join(ends, "source", "full").select("source", F.coalesce("_mark", "_old").alias("m"))
    return taken, after.select("source", "m.at", "m.id")
