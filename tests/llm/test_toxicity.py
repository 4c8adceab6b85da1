import math
import random
import time
import zlib

from pyspark.sql import functions as F

from rookery.llm import toxicity

SMALL = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, score string, toxic int"


def test_segments_are_all_maximal_ones():
    def brute(scores):
        """Recursively: the best segment, then the same before and after it."""
        x = scores

        def run(a, b):
            best = max(((sum(x[i:j]), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0, 0))
            if best[0] <= 0:
                return []
            _, _, i, j = best
            return [*run(a, i), (round(sum(x[i:j]), 6), i, j), *run(j, b)]

        return run(0, len(x))

    r = random.Random(2)
    for _ in range(60):
        scores = [r.choice([-0.25, -0.25, -0.25, -0.9, 1.3, 0.41, 2.17]) * (1 + r.random() / 10) for _ in range(r.randrange(0, 22))]
        assert [(round(s, 6), i, j) for s, i, j in toxicity.segments(scores)] == brute(scores)


def test_the_scan_is_linear():
    """In a falling walk each candidate begins below all before it and takes over none, so passing over all of them each time would be quadratic."""
    began = time.perf_counter()
    assert len(toxicity.segments([x for k in range(100_000) for x in (2.0, -1.0)])) == 1
    falling = [x for k in range(100_000) for x in (1.0, -1.5)]
    assert len(toxicity.segments(falling)) == 100_000
    assert time.perf_counter() - began < 5


def test_held_out_rows_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    rows = scored.join(labels, "doc_id").select("doc_id", "score", "toxic").collect()
    kept = [(r["score"], r["toxic"]) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    one, zero = [s for s, y in kept if y == 1], [s for s, y in kept if y == 0]
    auc = sum((a > b) + (a == b) / 2 for a in one for b in zero) / (len(one) * len(zero))
    # a part of these labels contradicts the text, and few are left to learn from
    assert auc > 0.8
    assert sum(s < 0.3 for s in zero) / len(zero) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark):
    r = random.Random(1)
    plain, bad = [f"plain{i}" for i in range(60)], ["vilest", "scum", "hateful"]
    docs = [(i, " ".join(r.choice(plain) for _ in range(40)) + (" " + " ".join(r.choice(bad) for _ in range(8)) if i % 3 == 0 else ""), "x", 0) for i in range(600)]
    df = spark.createDataFrame([*docs, (None, None, "x", 0), (1001, "", "x", 0), (1001, "", "x", 0), (1002, "vilest scum " * 100_000, "x", 1)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(600)] + [(None, 1, 1), (7, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(df, labels)
    got = toxicity.score(df, model).collect()
    assert len(got) == 604
    by = {x["doc_id"]: x for x in got}
    assert by[1002]["score"] > 0.9 and by[1002]["n_passages"] == 1 and by[1001]["score"] == by[None]["score"] < 0.3
    assert sum((by[i]["score"] >= 0.3) == (i % 3 == 0) for i in range(600)) >= 594
    clean = toxicity.clean(df, model)
    assert clean.schema == df.schema and clean.count() == sum(x["score"] < 0.3 for x in got)
    none = labels.where("toxic = 0")
    assert {x["score"] for x in toxicity.score(df, toxicity.fit(df, none)).collect()} == {toxicity.score(df.limit(1), toxicity.Model({})).first()["score"]}
    assert toxicity.score(df.limit(0), model).collect() == []


def test_the_model_equals_a_plain_one(spark):
    """Token scores from plain counts over the whole sample: nothing is cut off, negative ones stay."""
    r = random.Random(3)
    words = {1: [f"bad{i}" for i in range(300)], 0: [f"good{i}" for i in range(300)]}
    both = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(r.choice(words[i % 2] if r.random() < 0.5 else both) for _ in range(80)), "x", 0) for i in range(800)]
    df, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, i % 2) for i in range(800)], "doc_id long, toxic int")
    tokens = toxicity.fit(df, labels).tokens
    assert any(v > 0 for v in tokens.values()) and any(v < 0 for v in tokens.values())
    fit = {x["doc_id"] for x in labels.where(~toxicity.held_out(F.col("doc_id")) & (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) < 2)).collect()}
    seen = {}
    for d, text, _, _ in rows:
        if d in fit:
            w = text.split()
            for c in zip(w, ["", *w], [*w[1:], ""], strict=False):
                seen[c] = max(seen.get(c, 0), d % 2)
    n = [sum(v == y for v in seen.values()) for y in (0, 1)]
    count = {}
    for (w, _, _), y in seen.items():
        count.setdefault(w, [0, 0])[y] += 1
    for w, c in count.items():
        if sum(c) >= toxicity.OWN:
            prior = [max(sum(c) / sum(n) * toxicity.PRIOR * n[y], toxicity.LEAST_PRIOR) for y in (0, 1)]
            odds = [math.log((c[y] + prior[y]) / (n[y] * (1 + toxicity.PRIOR) + 1 - c[y])) for y in (0, 1)]
            delta = odds[1] - odds[0]
            z = delta / math.sqrt(sum(1 / (c[y] + prior[y]) for y in (0, 1)))
            want = delta if (z >= toxicity.LEAST_Z and delta >= toxicity.LEAST_ODDS) or z <= -toxicity.LEAST_Z else 0.0
            assert abs(tokens.get(w, 0.0) - want) <= 1 / toxicity.GRID, w


def test_clashing_names_and_no_labels(spark):
    df = spark.createDataFrame([(1, "some text", "x", 0)], SCHEMA).withColumn("n", F.lit(1)).withColumn("bytes", F.lit(2)).withColumn("upto", F.lit(3))
    model = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.clean(df, model).collect() == df.collect()
    assert toxicity.fit(df.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).tokens == {}


def test_long_texts_take_no_place_in_the_sample(spark, monkeypatch):
    """Whatever their place in the order: the model is that of the others, under a bound that these just fill."""
    rows = [(i, f"{chr(97 + i % 26)}x {'vile' if i % 2 else 'kind'} {chr(97 + i // 26)}y", "x", 0) for i in range(400)]
    monkeypatch.setattr(toxicity, "SAMPLE_TEXT", 1_000)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", sum(len(t) for _, t, _, _ in rows))
    labels = [(i, i % 2) for i in range(440)]
    long = [(400 + i, "kind vile " * 200, "x", 0) for i in range(40)]
    fits = [toxicity.fit(spark.createDataFrame(held, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")) for held in (rows, rows + long)]
    assert fits[0].tokens == fits[1].tokens and fits[0].tokens and (fits[0].rate, fits[0].scale) == (fits[1].rate, fits[1].scale)
