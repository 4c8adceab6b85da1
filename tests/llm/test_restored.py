import datetime

from rookery.llm import jaccard, suffixes

SCHEMA = "source string, n_chars int, text string, doc_id int, at timestamp, tags array<string>"


def test_rows_come_back_with_their_columns(spark):
    t = datetime.datetime(2024, 1, 2)
    text = " ".join(f"word{i}" for i in range(60))
    rows = [("a", 1, text, 4, t, ["x"]), (None, None, text, 2, None, None), ("b", 3, None, 7, t, []), ("c", 4, "", 8, t, ["y", None]), ("d", 5, "short é", None, t, ["z"])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = jaccard.representatives(df)
    assert got.schema == df.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([r for r in rows if r[3] != 4], SCHEMA).collect()))
    again = jaccard.representatives(df.unionAll(df))
    assert again.where("doc_id = 2").count() == 1 and again.where("doc_id = 8").count() == 2 and again.where("doc_id is null").count() == 2
    got = suffixes.remove(df, rows=True)
    assert got.schema == df.schema
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(r) for r in [(*r[:2], "" if r[2] == text else r[2], *r[3:]) for r in rows])
