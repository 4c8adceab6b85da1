"""Very long texts, nulls, repeated rows, empty tables and names that clash, through the operators on whole texts and the pipeline."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rookery.llm import jaccard, substring, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = ("batch", "place", "kind", "ids", "extra", "carried", "blob", "bucket", "key", "hub", "component_id", "n_shingles", "size", "taken", "time", "c0", "no_text")


def long_text(n, seed):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(1 << 40)}" for _ in range(n))


@pytest.fixture(scope="module")
def long_rows(spark):
    whole = long_text(250_000, 1)
    words = whole.split(" ")
    words[::5000] = ["other"] * len(words[::5000])
    rows = [(1, whole), (2, " ".join(words)), (3, long_text(100, 2)), (4, whole)]
    return rows, spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], SCHEMA).repartition(4)


def test_long_texts_by_bytes(long_rows):
    rows, df = long_rows
    got = {r["doc_id"]: r for r in suffixes.remove(df, texts=False).collect()}
    n = {d: len(t) for d, t in rows}
    assert (got[1]["n_removed"], got[4]["n_removed"], got[3]["n_removed"]) == (n[1], n[4], 0)
    # all but what was put in
    assert 0 < n[2] - got[2]["n_removed"] < 6 * 51


def test_long_texts_by_words(long_rows):
    rows, df = long_rows
    got = {r["doc_id"]: r for r in substring.remove(df, texts=False).collect()}
    assert (got[1]["n_removed"], got[4]["n_removed"], got[3]["n_removed"]) == (0, 250_000, 0)
    assert got[2]["n_words"] - got[2]["n_removed"] == 50


def test_long_texts_by_shingles(long_rows):
    rows, df = long_rows
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1}


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("labels"))
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def through(spark, tmp_path, docs, sf_dir):
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.schema(docs.schema).parquet(f"{tmp_path}/{name}")
        yield k, docs


def test_odd_rows_through_the_stages(spark, labelled, tmp_path):
    r = random.Random(5)
    bad, plain = ["vile", "scum", "filth"], [f"plain{i}" for i in range(500)]
    rows = [(i, " ".join(r.choice(plain) for _ in range(60)) + (" " + " ".join(r.choice(bad) for _ in range(12)) if i % 3 == 0 else ""), "en", "ab"[i % 2], 1) for i in range(300)]
    odd = [(None, None, None, None, None), (None, None, None, None, None), (900, None, "en", "a", 0), (901, "", "en", None, 0), (902, long_text(60_000, 3), "en", "a", 1), (None, "no key but words", "en", "b", 1), rows[1], rows[1]]
    df = spark.createDataFrame([*rows, *odd], SCHEMA)
    for c in CLASHING:
        df = df.withColumn(c, F.lit(c))
    seen = []
    for k, docs in through(spark, tmp_path, df, labelled):
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.dtypes == df.dtypes and docs.where(" OR ".join(f"{c} != '{c}'" for c in CLASHING)).isEmpty()
        seen.append(docs.count())
    cleaned = spark.read.parquet(f"{tmp_path}/toxicity")
    kept = [x["doc_id"] for x in cleaned.collect()]
    assert {900, 901, 902, None} <= set(kept) and kept.count(1) == 3 and kept.count(None) == 3
    unlike = [x["doc_id"] for x in spark.read.parquet(f"{tmp_path}/jaccard").collect()]
    assert unlike.count(1) == 1 and unlike.count(None) == 3
    lost = spark.read.parquet(f"{tmp_path}/suffixes")
    assert lost.count() == seen[1] and lost.where("doc_id = 900").first()["text"] is None
    assert all(x["n_tokens"] == len(x["ids"]) for x in spark.read.parquet(f"{tmp_path}/bpe").collect())


def test_an_empty_table_through_the_stages(spark, labelled, tmp_path):
    assert [docs.count() for _, docs in through(spark, tmp_path, spark.createDataFrame([], SCHEMA), labelled)] == [0] * 5
