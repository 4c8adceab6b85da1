import random

from pyspark.sql import functions as F

from rookery.operators import postings, search

SCHEMA = "id long, atoms array<string>, bucket int, bits string"


def lists(spark, rows):
    return postings.built(spark.createDataFrame([(i, a, 1, "b") for i, a in rows], SCHEMA), "id", "atoms")


def found(df):
    got = [r["id"] for r in postings.ids(df).collect()]
    assert len(got) == len(set(got))
    return set(got)


def cases(seed, low, n):
    r = random.Random(seed)
    return [(low + r.randrange(1, 200_000), [a for a in "abcdef" if r.random() < 0.4]) for _ in range(n)]


def test_boolean_searches_equal_sets(spark):
    rows = cases(1, 0, 300) + cases(2, -250_000, 100) + [(0, ["a"]), (1, ["a", None, "a"]), (32_768, ["a", "b"]), (32_769, ["a", "b"]), (-1, None), (None, ["a"]), (7, []), (32_768, ["c"])]
    held = {}
    for i, atoms in rows:
        if i is not None:
            held.setdefault(i, set()).update(a for a in atoms or () if a)
    p = lists(spark, rows).cache()
    want = lambda f: {i for i, atoms in held.items() if f(atoms)}
    assert found(postings.all_of(p, ["a", "b", "a"])) == want(lambda s: {"a", "b"} <= s)
    assert found(postings.any_of(p, ["c", "d", "zz"])) == want(lambda s: s & {"c", "d"})
    assert found(postings.none_of(p, ["e"])) == want(lambda s: "e" not in s)
    assert found(postings.none_of(p, [])) == found(postings.all_of(p, [])) == set(held)
    assert found(postings.all_of(p, ["a", "zz"])) == found(postings.any_of(p, ["zz"])) == found(postings.any_of(p, [])) == set()
    assert found(postings.none_of(p, ["zz"])) == set(held)
    assert found(postings.both(postings.all_of(p, ["a"]), postings.none_of(p, ["b", "c"]))) == want(lambda s: "a" in s and not s & {"b", "c"})
    assert found(postings.without(postings.all_of(p, ["a"]), postings.all_of(p, ["a"]))) == set()


def test_empty_tables(spark):
    p = lists(spark, [])
    assert found(postings.all_of(p, [])) == found(postings.none_of(p, ["a"])) == found(postings.any_of(p, ["a"])) == set()


def test_stored_lists_grow_and_only_asked_parts_are_read(spark, tmp_path):
    first, second = cases(3, 0, 200), cases(4, 0, 200)
    for rows in (first, second):
        postings.written(lists(spark, rows), str(tmp_path / "p"))
    stored = postings.read(spark, str(tmp_path / "p"))
    held = {}
    for i, atoms in first + second:
        held.setdefault(i, set()).update(atoms)
    assert found(postings.all_of(stored, ["a", "b"])) == {i for i, s in held.items() if {"a", "b"} <= s}
    assert found(postings.none_of(stored, ["c"])) == {i for i, s in held.items() if "c" not in s}
    asked = postings.all_of(stored, ["a", "b"])
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan and "PushedFilters: [In(atom" in plan
    parts = {r[0] for r in spark.createDataFrame([("a",), ("b",)], "atom string").select(postings.part_of(F.col("atom"))).collect()}
    read = {f.split("part=")[1].split("/")[0] for f in stored.where(F.col("atom").isin("a", "b")).inputFiles()}
    assert {str(p) for p in parts} <= read
    assert {r[0] for r in postings._asked(stored, ["a", "b"]).select("part").distinct().collect()} == parts


def test_parts_of_texts_by_trigrams(spark):
    names = ["Carlsen, Magnus", "CARLSEN", "Čarlsen", "100%_sure", "100 sure", "a\\b%c", "ab", "", None, "Müller", "MÜLLER-Thurgau", "x" * 5_000 + "end", "日本語の名前"]
    rows = spark.createDataFrame([(i + 1, {"white": n, "black": "Carlsen"} if n is not None else {"event": "Carlsen"}) for i, n in enumerate(names)], "id long, metadata map<string,string>")
    p = postings.built(rows.select("id", postings.field_pieces(F.col("metadata"), ["white", "black"]).alias("atoms")), "id", "atoms").cache()
    for part in ("carlsen", "RLS", "%_s", "0%", "\\b%", "a", "", "mÜL", "xend", "本語の", "absent", "carlsen, magnus!"):
        got = {r["id"] for r in postings.containing(rows, "id", p, "white", part).collect()}
        assert got == {r["id"] for r in rows.where(search.value_contains(F.col("metadata"), "white", part)).collect()}, part
    narrowed = postings.containing(rows, "id", p, "white", "rlsen")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in narrowed and "LeftSemi" not in postings.containing(rows, "id", p, "white", "rl")._jdf.queryExecution().optimizedPlan().toString()


def test_many_parts_are_looked_for_together(spark):
    names = ["Carlsen, Magnus", "CARLSEN", "100%_sure", "100 sure", "ab", "", None, "MÜLLER-Thurgau"]
    rows = spark.createDataFrame([(i + 1, {"white": n, "black": "Carlsen"} if n is not None else {"event": "Carlsen"}) for i, n in enumerate(names)] + [(2, {"white": "Carlsen"})], "id long, metadata map<string,string>")
    p = postings.built(rows.select("id", postings.field_pieces(F.col("metadata"), ["white", "black"]).alias("atoms")), "id", "atoms")
    asked = [(f, part) for f in ("white", "black") for part in ("carlsen", "RLS", "%_s", "0%", "a", "", "mÜL", "absent")]
    for some in (asked, asked[:3], [("white", "a")], [], asked[:2] * 2):
        got = sorted(tuple(r) for r in postings.containing_each(rows, "id", p, some).select("id", "field", "part").collect())
        assert got == sorted((r["id"], f, part) for f, part in set(some) for r in postings.containing(rows, "id", p, f, part).collect()), some
    text = postings.containing_each(rows, "id", p, asked)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("bitmap_construct_agg(") == 1  # lists aren't built again for each part
    assert text.count("lower(") and not any(line.count("substring(lower(") for line in text.split("\n"))  # nor a text made again for each trigram
