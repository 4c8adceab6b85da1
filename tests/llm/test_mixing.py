import re
from collections import Counter, defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from rookery.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, total string"


def brute_targets(size):
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, target = Fraction(sum(size.values())), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * size[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = Fraction(3 * size[s])
            left -= target[s]
        free -= over
    return target


def rows():
    out = []
    for i in range(600):
        source = ["a", "a", "a", "a", "b", "c", "d", None][i % 8]
        out.append((i, " ".join(["w"] * (1 + i * 7 % 23)) if i % 50 else (None if i % 100 else "  \n"), source, i, "x"))
    return out


def test_words_near_targets_and_within_bounds(spark):
    got = mixing.mix(spark.createDataFrame(rows(), SCHEMA).repartition(5)).collect()
    want = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, *_ in rows()}
    source = {d: s for d, _, s, *_ in rows()}
    assert {r["doc_id"]: r["size"] for r in got} == want
    size, taken = defaultdict(int), Counter()
    for r in got:
        size[source[r["doc_id"]]] += want[r["doc_id"]]
        taken[source[r["doc_id"]]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    target = brute_targets(size)
    assert sum(target.values()) == sum(size.values())
    for r in got:
        assert r["source_size"] == size[source[r["doc_id"]]] and abs(r["target"] - float(target[source[r["doc_id"]]])) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 23 for s in size) and sum(taken.values()) <= sum(size.values())
    again = mixing.mix(spark.createDataFrame(rows(), SCHEMA).repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_empty_and_single(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    one = mixing.mix(spark.createDataFrame([(None, "two words", None, 1, "x")], SCHEMA)).collect()
    assert [(r["doc_id"], r["size"], r["target"], r["taken"]) for r in one] == [(None, 2, 2.0, 2)]
    assert [r["taken"] for r in mixing.mix(spark.createDataFrame([(1, None, "a", 1, "x"), (2, "", "b", 1, "x")], SCHEMA)).collect()] == [0, 0]


def test_rows_repeat_as_the_mix_takes_them(spark):
    df = spark.createDataFrame([*rows(), *rows()[:40], (None, "a b c", "b", 1, "n"), (None, "a b c", "b", 2, "n")], SCHEMA).repartition(4)
    whole = defaultdict(int)
    for r in mixing.mix(df).where("size > 0").collect():
        whole[r["doc_id"], r["source"], r["size"]] += r["taken"] // r["size"]
    got = mixing.mixed_rows(df)
    assert got.schema == df.schema
    held = got.collect()
    assert Counter((r["doc_id"], r["source"], len(re.findall(r"\S+", r["text"]))) for r in held) == {k: n for k, n in whole.items() if n}
    known = set(map(str, df.collect()))
    assert all(str(r) in known for r in held)
    assert mixing.mixed_rows(spark.createDataFrame([], SCHEMA)).collect() == []


def test_names_that_clash_and_a_long_text(spark):
    rows = [(i, "w " * (i % 7 + 1), "ab"[i % 2], 1, "x") for i in range(60)] + [(None, "one two", "a", 1, "x"), (None, "three four", "a", 1, "x"), (99, "word " * 400_000, "a", 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("_own", "_times", "_alike", "_time", "_n", "key", "bucket", "finish", "target", "__copy"):
        df = df.withColumn(c, F.lit(c))
    taken = Counter()
    for r in mixing.mix(df).where("taken > 0").collect():
        taken[r["doc_id"], r["source"], r["size"]] += r["taken"] // r["size"]
    got = mixing.mixed_rows(df)
    assert got.schema == df.schema
    held = got.collect()
    assert Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in held) == taken
    assert all(r[c] == c for r in held for c in ("_own", "_times", "key", "__copy"))
