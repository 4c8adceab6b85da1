import zlib
from collections import defaultdict

from rookery.llm import sharding

SCHEMA = "doc_id long, text string, size int, shard int, slot string"


def rows():
    return [(i, ("é" * (i * 37 % 211)) if i % 9 else (None if i % 2 else ""), 1, 2, "x") for i in range(3000)]


def test_sizes_are_near_equal_and_places_gapless(spark):
    got, maps = sharding.shard(spark.createDataFrame(rows(), SCHEMA).repartition(7))
    held = got.collect()
    text = {d: (t or "").encode() for d, t, *_ in rows()}
    assert sorted(r["doc_id"] for r in held) == sorted(text)
    load, places = defaultdict(int), defaultdict(list)
    for r in held:
        assert r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]])
        load[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert sorted(load) == list(range(16)) and max(load.values()) - min(load.values()) <= 422
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sorted(map(str, sharding.shard(spark.createDataFrame(rows(), SCHEMA).repartition(2))[0].collect())) == sorted(map(str, held))
    by_version = {(m["version"], m["virtual_slot"]): m["shard"] for m in maps.collect()}
    assert len(by_version) == 2 * sharding.SLOTS and all(by_version[2, r["virtual_slot"]] == r["shard"] for r in held)


def test_nulls_repeats_and_nothing(spark):
    df = spark.createDataFrame([(None, "a", 0, 0, ""), (None, "a", 0, 0, ""), (5, None, 0, 0, ""), (5, None, 0, 0, "")], SCHEMA)
    held = sharding.shard(df)[0].collect()
    assert len(held) == 4 and sorted(r["size"] for r in held) == [1, 1, 2, 2]
    assert sharding.shard(spark.createDataFrame([], SCHEMA))[0].collect() == []


def test_a_map_is_edited_while_it_helps():
    size = {s: 10 + s * s % 97 for s in range(256)}
    before = sharding.first_map(8, 256)
    after = sharding.rebalanced(before, size, 8)
    load = lambda m: [sum(size[s] for s in size if m[s] == k) for k in range(8)]
    assert max(load(after)) - min(load(after)) <= min(2, max(load(before)) - min(load(before)))
    assert sharding.rebalanced(after, size, 8) == after


def test_a_stored_map_is_read_back_and_edited(spark, tmp_path):
    store = str(tmp_path / "map")
    df = spark.createDataFrame(rows(), SCHEMA)
    first, maps = sharding.shard(df, store=store)
    assert {m["version"] for m in maps.collect()} == {1, 2}
    again, maps = sharding.shard(df, store=store)
    # nothing to edit: no new version, the same places
    assert {m["version"] for m in maps.collect()} == {1, 2} and sorted(map(str, again.collect())) == sorted(map(str, first.collect()))
    more = df.unionByName(spark.createDataFrame([(9000 + i, "long " * 400, 1, 2, "x") for i in range(40)], SCHEMA))
    grown, maps = sharding.shard(more, store=store)
    by = {}
    for m in maps.collect():
        by.setdefault(m["version"], {})[m["virtual_slot"]] = m["shard"]
    assert sorted(by) == [1, 2, 3] and sum(by[2][s] != by[3][s] for s in by[2]) < sharding.SLOTS / 4
    load = defaultdict(int)
    for r in grown.collect():
        assert r["shard"] == by[3][r["virtual_slot"]]
        load[r["shard"]] += r["size"]
    assert max(load.values()) - min(load.values()) <= 2001


def test_many_rows_without_doc_id_and_a_long_text(spark):
    df = spark.createDataFrame([(None, "same", 0, 0, "")] * 2000 + [(1, "y" * 5_000_000, 0, 0, "")], SCHEMA).repartition(3)
    held = sharding.shard(df)[0].collect()
    places = defaultdict(list)
    for r in held:
        places[r["shard"]].append(r["slot"])
    assert len(held) == 2001 and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert len({r["virtual_slot"] for r in held}) > 1000


def test_a_doc_id_of_many_rows_fills_no_shard(spark):
    rows = [(7, "x" * (90 + i % 20), 0, 0, "") for i in range(3000)] + [(100 + i, "y" * (i % 200), 0, 0, "") for i in range(6000)] + [(3, None, 0, 0, ""), (3, None, 0, 0, "")]
    held = sharding.shard(spark.createDataFrame(rows, SCHEMA).repartition(5))[0].collect()
    load, places = defaultdict(int), defaultdict(list)
    for r in held:
        load[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert len(held) == 9002 and len(load) == 16 and max(load.values()) - min(load.values()) <= 300
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert len({r["virtual_slot"] for r in held if r["doc_id"] == 7}) > 1000
