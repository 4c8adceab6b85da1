"""The star as stored tables: appended month by month with ids that go on, and bucketed for joins without a shuffle."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boards
from . import store

TABLES = {
    "positions": "id long, record binary, white_pawns long, black_pawns long",
    "games": "id long, fingerprint binary, content binary",
    "occurrences": "id long, game_id long, ply int, position_id long, move string",
    "records": "id long, record_id string, game_id long, metadata map<string,string>",
}


def folder(spark: SparkSession) -> str:
    """A new folder for tables, beside the checkpoints that all executors share. A local master without one gets a temporary one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='rookery-')).rstrip('/')}/tables-{uuid.uuid4().hex}"


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables stored under path, empty where nothing is."""
    return {t: spark.read.schema(s).parquet(f"{path}/{t}") if exists_table(spark, f"{path}/{t}") else spark.createDataFrame([], s) for t, s in TABLES.items()}


def exists_table(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def _top(df: DataFrame) -> int:
    return df.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]


def append(games: DataFrame, key: str, path: str) -> DataFrame:
    """Adds games to the tables under path and returns what was refused: record_id and error (duplicate_in_batch, already_exists).
    games: as replay.played() gives them, with key and headers; rows with an error are left out, as is a null key.

    Ids go on after those that are stored. A position, game or record that is there stays as it is. Games are replayed once, into a
    table of their own; each step reads what the one before has written and adds what is lacking, so that a run that
    was cut off may be run again, which then completes it (its own finished records come back as already_exists)."""
    spark = games.sparkSession
    staged = f"{path}/_staged"
    held = games.where(F.col("error").isNull() & F.col(key).isNotNull())
    held = held.withColumn("content", F.concat(F.col("records")[0], F.encode(F.concat(F.lit(" "), F.array_join("uci", " ")), "utf-8")))
    held.select(F.col(key).cast("string").alias("record_id"), F.col("headers").alias("metadata"), F.unhex(F.sha2("content", 256)).alias("fingerprint"), "content", "records", "moves").write.mode("overwrite").parquet(staged)
    held = spark.read.parquet(staged)
    identity = ["fingerprint", "content"]
    one = held.groupBy(*identity).agg(F.any_value("records").alias("records"), F.any_value("moves").alias("moves"))

    def add(table: str, rows: DataFrame) -> DataFrame:
        rows.select(*(x.split()[0] for x in TABLES[table].split(", "))).write.mode("append").parquet(f"{path}/{table}")
        return read(spark, path)[table]

    stored = read(spark, path)
    fresh = one.select(F.explode("records").alias("record")).distinct().join(stored["positions"], "record", "left_anti")
    named = boards.from_record(store.numbered(fresh, ["record"], _top(stored["positions"])))
    positions = add("positions", named.select("id", "record", F.col("wp").alias("white_pawns"), F.col("bp").alias("black_pawns")))
    new = one.select(*identity).join(stored["games"], identity, "left_anti")
    known = add("games", store.numbered(new, identity, _top(stored["games"]))).withColumnRenamed("id", "game_id")
    lacking = one.join(known, identity).join(stored["occurrences"], "game_id", "left_anti")
    plies = lacking.select("game_id", F.posexplode(F.arrays_zip("records", "moves")).alias("ply", "z")).select("game_id", "ply", F.col("z.records").alias("record"), F.col("z.moves").alias("move"))
    placed = plies.join(positions.select(F.col("id").alias("position_id"), "record"), "record").drop("record")
    add("occurrences", store.numbered(placed, ["game_id", "ply"], _top(stored["occurrences"])))
    rows, refused = store.inserted(stored["records"], held.join(known, identity).select("record_id", "game_id", "metadata"), "record_id", ["game_id"], F.lit(None).cast("string"))
    refused = refused.select("record_id", "error")
    refused.write.mode("overwrite").parquet(f"{path}/_refused")  # before the records that it is judged by change
    add("records", store.numbered(rows, ["record_id"], _top(stored["records"])))
    return spark.read.parquet(f"{path}/_refused")


def bucketed(df: DataFrame, by: str, path: str, buckets: int, sort: list[str] | None = None) -> DataFrame:
    """df stored under path in buckets of a column, each sorted by it (and what sort names). Tables in the same number of buckets join
    on it, and group by it and more, without an exchange."""
    name = f"bucketed_{uuid.uuid4().hex}"
    df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by, *(sort or [])).option("path", path).mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def moves_of(positions: DataFrame, occurrences: DataFrame) -> DataFrame:
    """position_id, move and n: how often each move was played from positions(id), of occurrences(position_id, move)."""
    held = positions.select(F.col("id").alias("position_id")).join(occurrences, "position_id").where("move IS NOT NULL")
    return held.groupBy("position_id", "move").agg(F.count("*").alias("n"))


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    """rows of a Parquet table, counted from its files' footers: no column is read."""
    with_v2 = spark.newSession()
    with_v2.conf.set("spark.sql.sources.useV1SourceList", "")
    with_v2.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return with_v2.read.parquet(path).agg(F.count("*").alias("rows"))
