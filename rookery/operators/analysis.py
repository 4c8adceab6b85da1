"""Move statistics, openings and the accuracy model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The logistic win model, and the decay of accuracy with the win percentage that a move loses.
WIN_SCALE, WIN_CLAMP = 0.00368208, 1000
ACCURACY_A, ACCURACY_K, ACCURACY_B = 103.1668100711649, 0.04354415386753951, 3.166924740191411
#: Drops above which a move is marked.
MARKS = ((30, "??"), (20, "?"), (10, "?!"))


def opening_book(occurrences: DataFrame, records: DataFrame, limit: int = 50) -> DataFrame:
    """For each move of occurrences(game_id, move): distinct games, and distinct records(id, game_id, result) by result.
    Games without a record, and null moves, don't count."""
    held = occurrences.where("move IS NOT NULL").join(records.select(F.col("id").alias("record_id"), "game_id", "result"), "game_id")
    won = lambda r: F.count_distinct(F.when(F.col("result") == r, F.col("record_id")))
    book = held.groupBy("move").agg(F.count_distinct("game_id").alias("games"), won("1-0").alias("white"), won("1/2-1/2").alias("draws"), won("0-1").alias("black"))
    return book.orderBy(F.desc("games"), "move").limit(limit)


def deepest_opening(occurrences: DataFrame, openings: DataFrame) -> DataFrame:
    """For each game the last of its positions that openings(position_id, eco, name) names."""
    return occurrences.join(openings, "position_id").groupBy("game_id").agg(F.max_by(F.struct("eco", "name", "ply"), "ply").alias("o")).select("game_id", "o.*")


def win_percent(cp: Column, mate: Column) -> Column:
    """White's chances; a mate decides, without evaluation 50."""
    clamped = F.greatest(F.least(cp, F.lit(WIN_CLAMP)), F.lit(-WIN_CLAMP))
    return F.when(mate > 0, 100.0).when(mate <= 0, 0.0).when(cp.isNotNull(), 50 + 50 * (2 / (1 + F.exp(-WIN_SCALE * clamped)) - 1)).otherwise(50.0)


def move_drops(series: DataFrame) -> DataFrame:
    """series(game, ply, win, start_side) with side (who moved to ply), before, and drop from the mover's view."""
    w = Window.partitionBy("game").orderBy("ply")
    white = (F.col("ply") % 2 == 1) == (F.col("start_side") == "w")
    held = series.withColumn("before", F.lag("win").over(w)).where("before IS NOT NULL").withColumn("side", F.when(white, "w").otherwise("b"))
    return held.withColumn("drop", F.when(F.col("side") == "w", F.col("before") - F.col("win")).otherwise(F.col("win") - F.col("before")))


def mark(drop: Column) -> Column:
    out = F.lit("")
    for least, sign in reversed(MARKS):
        out = F.when(drop > least, sign).otherwise(out)
    return out


def move_accuracy(drop: Column) -> Column:
    value = ACCURACY_A * F.exp(-ACCURACY_K * drop) - ACCURACY_B + 1
    return F.when(drop <= 0, 100.0).otherwise(F.greatest(F.least(value, F.lit(100.0)), F.lit(0.0)))


def game_accuracy(series: DataFrame) -> DataFrame:
    """game, side, accuracy: the mean of the volatility-weighted and the harmonic mean of the side's move accuracies.

    A move's weight is the spread of the win series over a window that grows with the game (a tenth of its moves,
    between 2 and 8 positions), kept between 0.5 and 12; windows of the first moves begin with the series. A game is
    one array: its length is bounded by the rules."""
    ordered = F.array_sort(F.collect_list(F.struct("ply", "win")))
    games = series.groupBy("game").agg(ordered.alias("s"), F.first("start_side").alias("start_side")).withColumn("win", F.transform("s", lambda x: x["win"]))
    games = games.withColumn("w", F.expr("greatest(2, least(8, (size(win) - 1) DIV 10))"))
    moves = games.where("size(win) > 1").select("game", "start_side", "win", "w", F.explode(F.expr("sequence(1, size(win) - 1)")).alias("i"))
    moves = moves.withColumn("part", F.expr("slice(win, greatest(1, i - w + 2), w)"))
    mean = F.expr("aggregate(part, 0D, (a, x) -> a + x) / size(part)")
    moves = moves.withColumn("mean", mean).withColumn("spread", F.expr("sqrt(aggregate(part, 0D, (a, x) -> a + (x - mean) * (x - mean)) / size(part))"))
    moves = moves.withColumn("weight", F.expr("greatest(0.5D, least(12D, spread))")).withColumn("before", F.expr("win[i - 1]")).withColumn("after", F.expr("win[i]"))
    white = (F.col("i") % 2 == 1) == (F.col("start_side") == "w")
    moves = moves.withColumn("side", F.when(white, "w").otherwise("b")).withColumn("acc", move_accuracy(F.when(white, F.col("before") - F.col("after")).otherwise(F.col("after") - F.col("before"))))
    sums = moves.groupBy("game", "side").agg(
        (F.sum(F.col("acc") * F.col("weight")) / F.sum("weight")).alias("weighted"),
        F.when(F.min("acc") <= 0, 0.0).otherwise(F.count("*") / F.sum(1 / F.when(F.col("acc") > 0, F.col("acc")))).alias("harmonic"),
    )
    return sums.select("game", "side", ((F.col("weighted") + F.col("harmonic")) / 2).alias("accuracy"))


def packed_similarity(candidates: DataFrame, query: DataFrame, limit: int = 24) -> DataFrame:
    """candidates(id, white, black, material) scored against one row of query(white, black, material): equal bits of
    both pawn masks, and a bonus for equal material; best first. Of more rows of query, the first by id counts."""
    q = query.orderBy("id").limit(1).select(F.col("white").alias("q_white"), F.col("black").alias("q_black"), F.col("material").alias("q_material"))
    both = candidates.join(F.broadcast(q), F.lit(True))
    score = F.expr("bit_count(white & q_white) + bit_count(black & q_black) - bit_count(white ^ q_white) - bit_count(black ^ q_black) + IF(material = q_material, 16, 0)")
    return both.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def move_number(start_number: Column, start_side: Column, ply: Column) -> tuple[Column, Column]:
    """The number of the move and the side to move ('w' or 'b') after so many plies from a position."""
    offset = F.when(start_side == "w", ply).otherwise(ply + 1)
    even = ply % 2 == 0
    return (start_number + F.floor(offset / 2)).cast("long"), F.when(even == (start_side == "w"), "w").otherwise("b")
