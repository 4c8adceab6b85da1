"""Columns that are made once for each row, and rows dealt out for long work on each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def made_once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are made once for each row, however many later columns and filters read them: names of a select are replaced
    by their expressions, also within functions over lists, and filters go before it, but neither passes a generator."""
    return df.select("*", F.stack(F.lit(1), *columns.values()).alias(*columns))


def spread(df: DataFrame, key: str) -> DataFrame:
    """df's rows dealt out over all partitions by a hash of a column, for long work on each. Spark puts short rows into few tasks after
    a shuffle, except where their number is given; and it leaves out a repartition by the column that rows are grouped by."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(key))
