"""Continuous ingest of game files into Parquet tables, each record once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import pgn


#: Of the oldest file beside the newest one.
AGE = "36500d"


def stream(spark: SparkSession, path: str, rating: int | None = None, max_files: int = 64) -> DataFrame:
    """record_id, headers, moves, result, error and file of the games of files that arrive in path. record_id is a hash of the text
    without blanks around it, so a file that comes again brings no new one. Files are taken whatever their age: the stream's log
    of seen files isn't cut by age (AGE), and grows with their number."""
    rows = spark.readStream.option("lineSep", "\n" + pgn.OPENING).option("maxFilesPerTrigger", max_files).option("maxFileAge", AGE).text(path)
    text = F.when(F.startswith("value", F.lit("[")), F.col("value")).otherwise(F.concat(F.lit(pgn.OPENING), F.col("value")))
    games = rows.select(F.col("_metadata.file_path").alias("file"), text.alias("pgn")).where("trim(pgn) <> ''")
    framed = pgn.framed(pgn.kept(games, rating))
    return framed.select(F.sha2(F.btrim("pgn", F.lit(" \t\r\n")), 256).alias("record_id"), "headers", "moves", "result", "error", "file")


def append_new(batch: DataFrame, target: str) -> None:
    """Adds the records of a batch that target lacks, so that a batch that runs again changes nothing, and its malformed games
    to rejected(target) in the same way. Of target only the ids that begin like some of the batch are read."""
    for rows, to in ((batch.where("error IS NULL").drop("error"), target), (batch.where("error IS NOT NULL"), rejected(target))):
        fresh = rows.dropDuplicates(["record_id"]).withColumn("part", F.concat(F.lit("p"), F.substring("record_id", 1, 2)))  # never read as a number
        if exists(batch.sparkSession, to):
            held = batch.sparkSession.read.parquet(to).select("part", "record_id")
            fresh = fresh.join(held, ["part", "record_id"], "left_anti")
        fresh.write.mode("append").partitionBy("part").parquet(to)


def rejected(target: str) -> str:
    """Where malformed games of a target go."""
    return f"{target.rstrip('/')}-rejected"


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(folder) and any(s.isDirectory() for s in files.listStatus(folder))


def counters(spark: SparkSession, target: str) -> DataFrame:
    """outcome (imported, or why games were rejected) and games."""
    none = spark.createDataFrame([], "outcome string")
    held = spark.read.parquet(target).select(F.lit("imported").alias("outcome")) if exists(spark, target) else none
    bad = spark.read.parquet(rejected(target)).select(F.col("error").alias("outcome")) if exists(spark, rejected(target)) else none
    return held.unionByName(bad).groupBy("outcome").agg(F.count("*").alias("games"))


def unrepeated(records: DataFrame, within: str = "1 hour") -> DataFrame:
    """The first of records that come again within a time of their arrival, as state of the stream: a file that is delivered twice
    in short order costs no look into the target. Arrival is the time of the batch, not of the file, so that an old file is
    never late, and state older than that time is let go. What comes again later is left to append_new()."""
    arrived = records.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", within)
    return arrived.dropDuplicatesWithinWatermark(["record_id"]).drop("_arrived")


def ingest(spark: SparkSession, path: str, target: str, checkpoint: str, rating: int | None = None, within: str | None = None) -> StreamingQuery:
    """Takes in what has arrived since the last run, and ends. within: also as unrepeated() says."""
    records = stream(spark, path, rating)
    return (unrepeated(records, within) if within else records).writeStream.foreachBatch(lambda batch, _: append_new(batch, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
