"""From documents to encoded training rows, in stages; counted as part of the subpackage llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm import bpe, jaccard, mixing, suffixes, toxicity


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic, at the threshold or above, go. Null and empty texts score like texts without toxic passages;
    repeated rows go or stay together. Texts of any length are scored whole."""
    return toxicity.clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by word shingles, the least doc_id stays, and of repeated rows one. Texts without words (null ones
    too) and rows without doc_id link with nothing and stay."""
    return jaccard.representatives(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under strings that repeat go; n_chars follows the text. Null texts stay null, and a text of which nothing is
    left becomes empty."""
    return suffixes.remove(docs, rows=True).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those not taken, and those without words, go. A null source is a source of
    its own."""
    return mixing.mixed_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each row, repeated rows and null doc_ids too. Null and empty texts have no ids; long texts are
    encoded whole. An empty table gives an empty one."""
    return bpe.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", clean), ("jaccard", unlike), ("suffixes", unrepeated), ("mixing", mixed), ("bpe", encoded)]
#: Training and encoding can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
