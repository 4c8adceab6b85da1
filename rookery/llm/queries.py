"""One thin query for each operator, under production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jaccard, lexical, licenses, media, mixing, nearest, neardup, sharding, substring, suffixes, toxicity, whitening
from ._common import table


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove(table(spark, sf_dir, "documents"), texts=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "n_passages")


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near(table(spark, sf_dir, "embeddings"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove(table(spark, sf_dir, "documents"), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored(table(spark, sf_dir, "documents"))


def media_carved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sounds found in files that are made from the texts, with types corrected; beside op7_media, which stores and reads back."""
    found = media.scan(media.embedded(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "declared_type", "actual_type", "offset", "length", "type", F.sha2("carved", 256).alias("carved_sha256"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law: bytes. Each document's shard of 16, from the current version of the slot map."""
    rows, _ = sharding.shard(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffixes": op1_suffixes,
    "op2_toxicity": op2_toxicity,
    "op3_neardup": op3_neardup,
    "op4_bpe": op4_bpe,
    "op5_jaccard": op5_jaccard,
    "op6_substring": op6_substring,
    "op7_media": op7_media,
    "media_carved": media_carved,
    "op8_licenses": op8_licenses,
    "op9_sharding": op9_sharding,
    "op10_mixing": op10_mixing,
    "op11_lexical": op11_lexical,
    "op12_whitening": op12_whitening,
    "op13_nearest": op13_nearest,
}

ORACLE_SQL: dict[str, str] = {"media_carved": media.EMBEDDED_SQL, "op8_licenses": licenses.SCAN_SQL, "op10_mixing": mixing.MIX_SQL.format(docs="documents"), "op11_lexical": lexical.SEARCH_SQL.format(docs="documents", items="benchmark")}
