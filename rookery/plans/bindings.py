"""The relations of the engine over the driver's tables, in Spark and in DuckDB.

positions are parts (pawn masks from size and brand), occurrences are line items
(games are orders, plies are places in them), records are orders, evaluations are
events, digests are the positive dimensions of embeddings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import boards
from ..functions.once import made_once

#: 48 bits on ranks 2 to 7, about a quarter set; no product passes 63 bits.
P48 = 1 << 48


def mask(key: str, a: int, b: int) -> str:
    return f"((((({key}) * {a}) % {P48}) & ((({key}) * {b}) % {P48})) * 256)"


KEY_WHITE, KEY_BLACK = "(p_size + 17)", "(CAST(substr(p_brand, 7) AS INT) + 61)"
WHITE = mask(f"CAST({KEY_WHITE} AS BIGINT)", 97_400_714_819, 77_046_029_254)
BLACK = f"({mask(f'CAST({KEY_BLACK} AS BIGINT)', 88_172_645_463, 65_536_987_631)} & ~{WHITE})"
MATERIAL = "(p_size % 8)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str) -> DataFrame:
    """Columns of a table, its rows dealt out by their key: a split is little to read, but what follows works long on each row."""
    return table(spark, sf_dir, name).select(key, *columns).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"{WHITE} AS white", f"{BLACK} AS black", f"{MATERIAL} AS material")


_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines in the order of all their columns; equal lines are alike in all that is kept."""
    w = Window.partitionBy("l_orderkey").orderBy(*_LINE)
    lines = table(spark, sf_dir, "lineitem").withColumn("ply", F.row_number().over(w) - 1)
    return lines.selectExpr("l_orderkey * 1000 + ply AS id", "l_orderkey AS game_id", "CAST(ply AS BIGINT) AS ply", "l_partkey AS position_id", "concat(l_returnflag, l_linestatus) AS move")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderkey").alias("game_id"),
        F.when(F.col("o_orderkey") % 10 > 0, F.date_format("o_orderdate", "yyyy.MM.dd")).alias("date"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN '1-0' WHEN 'O' THEN '1/2-1/2' ELSE '0-1' END").alias("result"),
        F.create_map(
            F.lit("white"), F.concat(F.lit("Customer_"), F.col("o_custkey").cast("string")), F.lit("black"), F.concat(F.lit("Clerk%"), (F.col("o_custkey") % 97).cast("string")), F.lit("event"), F.col("o_orderpriority"),
            F.lit("white_elo"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_custkey").cast("string")).otherwise("?"),
        ).alias("metadata"),
    )


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("position_id"), F.expr("filter(sequence(0, size(embedding) - 1), i -> embedding[i] > 0)").alias("atom_ids"))


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """depth from 0 to 9 so that many are equal."""
    return table(spark, sf_dir, "events").selectExpr("user_id AS position_id", "event_type AS engine", "CAST(value AS INT) % 10 AS depth", "event_id AS seq", "CAST(round(value * 10) AS INT) AS eval_cp")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Win series: a user's events in order; values as centipawns around 0."""
    w = Window.partitionBy("game").orderBy("event_id")
    held = table(spark, sf_dir, "events").selectExpr("user_id AS game", "event_id", "value * 4 - 200 AS cp").withColumn("ply", F.row_number().over(w) - 1)
    return held.withColumn("start_side", F.when(F.col("game") % 2 == 0, "w").otherwise("b"))


POSITIONS = f"positions AS (SELECT p_partkey AS id, {WHITE} AS white, {BLACK} AS black, {MATERIAL} AS material FROM part)"
OCCURRENCES = f"occurrences AS (SELECT l_orderkey * 1000 + ply AS id, l_orderkey AS game_id, ply, l_partkey AS position_id, concat(l_returnflag, l_linestatus) AS move FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE)}) - 1 AS ply FROM lineitem))"
RECORDS = """records AS (SELECT o_orderkey AS id, o_orderkey AS game_id, CASE WHEN o_orderkey % 10 > 0 THEN strftime(o_orderdate, '%Y.%m.%d') END AS date,
    CASE o_orderstatus WHEN 'F' THEN '1-0' WHEN 'O' THEN '1/2-1/2' ELSE '0-1' END AS result, 'Customer_' || o_custkey AS white, 'Clerk%' || (o_custkey % 97) AS black, o_orderpriority AS event,
    CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_custkey AS VARCHAR) ELSE '?' END AS white_elo FROM orders)"""
DIGESTS = "digests AS (SELECT vec_id AS position_id, list_filter(range(len(embedding)), i -> embedding[i + 1] > 0) AS atom_ids FROM embeddings)"
EVALUATIONS = "evaluations AS (SELECT user_id AS position_id, event_type AS engine, CAST(trunc(value) AS INT) % 10 AS depth, event_id AS seq, CAST(round(value * 10) AS INT) AS eval_cp FROM events)"
SERIES = "series AS (SELECT user_id AS game, event_id, value * 4 - 200 AS cp, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ply, CASE WHEN user_id % 2 = 0 THEN 'w' ELSE 'b' END AS start_side FROM events)"
WIN = "CASE WHEN cp IS NULL THEN 50.0 ELSE 50 + 50 * (2 / (1 + exp(-0.00368208 * greatest(least(cp, 1000), -1000))) - 1) END"
MATCHES = "matches AS (SELECT p.id AS position_id, o.id AS occurrence_id, o.game_id, o.ply, r.id AS record_id, r.result, r.date, r.white, r.black, r.event, r.white_elo, p.white AS white_pawns, p.black AS black_pawns FROM positions p JOIN occurrences o ON o.position_id = p.id JOIN records r ON r.game_id = o.game_id)"
STAR = f"{POSITIONS}, {OCCURRENCES}, {RECORDS}, {MATCHES}"


# Whole positions for the modes of a search: kings, rooks and pawns of a structure by size, as it is, with an edit, or turned.
_SIZE_BLACK = f"({mask('CAST((p_size + 61) AS BIGINT)', 88_172_645_463, 65_536_987_631)} & ~{WHITE})"
_LOW, _HALF, _FILE_H = "(w0 & (-w0))", 1 << 48, sum(1 << s for s in range(7, 64, 8) if s < 63)
_AHEAD, _ASIDE = f"(({_LOW} % {_HALF}) * 256)", f"(({_LOW} % {_HALF}) * 512)"
EDITED = f"""CASE WHEN v = 3 THEN w0 & ~{_LOW}
    WHEN v IN (5, 7) AND {_LOW} < {_HALF} AND ((w0 | b0) & {_AHEAD}) = 0 THEN (w0 & ~{_LOW}) | {_AHEAD}
    WHEN v = 6 AND {_LOW} < {_HALF} AND ({_LOW} & {_FILE_H}) = 0 AND ((w0 | b0) & {_ASIDE}) = 0 THEN (w0 & ~{_LOW}) | {_ASIDE} ELSE w0 END"""
#: The size whose structure is asked for.
ASKED_SIZE = 2


def _whole(rows: DataFrame) -> DataFrame:
    """rows(id, p_size) as positions with masks."""
    held = rows.selectExpr("id", "p_size", "CAST(id % 8 AS INT) AS v", f"{WHITE} AS w0", f"{_SIZE_BLACK} AS b0")
    held = held.selectExpr("id", "v", f"{EDITED} AS wp", "b0 AS bp", "IF(p_size % 2 = 0, 1L, 0L) AS wr", "IF(p_size % 2 = 0, shiftleft(1L, 56), 0L) AS br", "shiftleft(1L, 4) AS wk", "shiftleft(1L, 60) AS bk")
    none = {m: F.lit(0).cast("long") for m in ("wn", "wb", "wq", "bn", "bb", "bq")}
    return held.withColumns(none | {"side": F.lit("w"), "castling": F.lit(0), "ep": F.lit(None).cast("int")})


def _named(df: DataFrame) -> DataFrame:
    df = made_once(df.select("id", *[F.col(m).alias(f"_{m}") for m in boards.MASKS], "side", "castling", "ep"), **{m: F.col(f"_{m}") for m in boards.MASKS})
    return df.select("id", *boards.MASKS, "side", "castling", "ep", F.col("wp").alias("white"), F.col("bp").alias("black"), boards.record().alias("record"))


def whole_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _whole(dealt(spark, sf_dir, "part", "p_partkey", "p_size").selectExpr("p_partkey AS id", "p_size"))
    forms = [held.where("v NOT IN (1, 2, 7)"), boards.color_swapped(held.where("v IN (1, 7)")), boards.file_reflected(held.where("v = 2"))]
    return _named(forms[0].unionByName(forms[1]).unionByName(forms[2]))


def asked_position(spark: SparkSession) -> DataFrame:
    return _named(_whole(spark.range(1).selectExpr("id", f"{ASKED_SIZE} AS p_size")))


def flip(form: int, m: str) -> str:
    """DuckDB's mask with each square s at s xor form: 56 flips ranks, 7 files."""
    return f"CAST(coalesce(list_sum(list_transform(list_filter(range(8, 56), s -> (({m} >> s) & 1) = 1), s -> 1::BIGINT << xor(s, {form}))), 0) AS BIGINT)"


WHOLE = f"""w1 AS (SELECT p_partkey AS id, p_size, p_partkey % 8 AS v, {WHITE} AS w0, {_SIZE_BLACK} AS b0 FROM part),
    w2 AS (SELECT id, p_size, v, {EDITED} AS ew, b0 AS eb FROM w1),
    w3 AS (SELECT id, p_size, v, CASE WHEN v IN (1, 7) THEN {flip(56, 'eb')} WHEN v = 2 THEN {flip(7, 'ew')} ELSE ew END AS white, CASE WHEN v IN (1, 7) THEN {flip(56, 'ew')} WHEN v = 2 THEN {flip(7, 'eb')} ELSE eb END AS black FROM w2),
    whole AS (SELECT id, white, black, v, list_aggregate(list_transform(range(64), s -> CASE WHEN ((white >> s) & 1) = 1 THEN '01' WHEN ((black >> s) & 1) = 1 THEN '07' WHEN s = CASE WHEN v = 2 THEN 3 ELSE 4 END THEN '06' WHEN s = CASE WHEN v = 2 THEN 59 ELSE 60 END THEN '0C'
        WHEN p_size % 2 = 0 AND s = CASE WHEN v = 2 THEN 7 ELSE 0 END THEN '04' WHEN p_size % 2 = 0 AND s = CASE WHEN v = 2 THEN 63 ELSE 56 END THEN '0A' ELSE '00' END), 'string_agg', '') || CASE WHEN v IN (1, 7) THEN '01' ELSE '00' END || '00FF' AS record FROM w3)"""
ASKED = f"asked AS (SELECT {WHITE.replace('p_size', str(ASKED_SIZE))} AS white, {_SIZE_BLACK.replace('p_size', str(ASKED_SIZE))} AS black)"
