"""Sharding over fixed virtual slots.

Records hash into thousands of slots that never change; bytes are summed per
slot; a stored, versioned map gives each slot's shard. Rebalancing edits the map
into its next version: slots move from the fullest shards to the emptiest until
sizes are near equal.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import HEAVY, cut, shared_folder

#: Virtual slots; the map has one row for each, whatever the corpus.
SLOTS = 4096
#: Parts of a virtual slot, by the whole row, in which rows are ordered: smaller tasks, also where a doc_id has many rows.
PARTS = 16


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 1: slots dealt in turn."""
    return [slot % shards for slot in range(slots)]


def rebalanced(owner: list[int], size: dict[int, int], shards: int) -> list[int]:
    """The next version of a map: while it narrows the gap between the fullest and the emptiest shard, one slot
    moves there, or two slots change places. Deterministic."""
    owner = list(owner)
    load, held = [0] * shards, [set() for _ in range(shards)]
    for slot, shard in enumerate(owner):
        load[shard] += size.get(slot, 0)
        if size.get(slot, 0):
            held[shard].add(slot)
    while True:
        high, low = max(range(shards), key=lambda s: (load[s], s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        # a move of m bytes leaves a gap of |gap - 2m|
        best = min(((abs(gap - 2 * size[s]), s, -1) for s in held[high]), default=(gap, -1, -1))
        if best[0] * 8 > gap:
            mine = sorted(held[high], key=lambda s: (size[s], s))
            theirs = sorted(held[low], key=lambda s: (size[s], s))
            at = 0
            for s in mine:  # for each slot of the fullest, the slot of the emptiest whose exchange comes nearest to half the gap
                while at + 1 < len(theirs) and size[s] - size[theirs[at + 1]] >= gap / 2:
                    at += 1
                for t in theirs[at : at + 2]:
                    best = min(best, (abs(gap - 2 * (size[s] - size[t])), s, t))
        left, s, t = best
        if left >= gap:
            break
        for slot, a, b in ((s, high, low), (t, low, high)):
            if slot >= 0:
                owner[slot] = b
                held[a].discard(slot)
                held[b].add(slot)
                load[a] -= size[slot]
                load[b] += size[slot]
    return owner


MAP = "virtual_slot int, shard int, bytes long"


def versions(spark: SparkSession, store: str) -> DataFrame:
    """All versions of a stored map: version, virtual_slot, shard, bytes (of the slot when the version was made)."""
    return spark.read.schema(f"{MAP}, version int").parquet(store).select("version", *[c.split()[0] for c in MAP.split(", ")])


def stored_version(spark: SparkSession, store: str) -> tuple[int, list[int]]:
    """The last version of a stored map and each slot's shard in it; 0 and nothing where none is stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return 0, []
    held = versions(spark, store)
    last = held.agg(F.max("version")).first()[0]
    return last, [r["shard"] for r in sorted(held.where(F.col("version") == last).collect(), key=lambda r: r["virtual_slot"])]


def store_version(spark: SparkSession, store: str, version: int, owner: list[int], size: dict[int, int]) -> None:
    """Writes a version once; a version that is there is never changed."""
    rows = [(slot, shard, size.get(slot, 0)) for slot, shard in enumerate(owner)]
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("errorifexists").parquet(f"{store}/version={version}")


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, map). Rows: doc_id, size (UTF-8 bytes of the text and 1; null text: none and 1), text_crc32, virtual_slot,
    shard, slot (place in the shard, from 0 without gaps). Map: versions() of what is stored in store, a folder that all
    executors share (None: a new one beside the checkpoints). Without a stored version, version 1 deals slots in turn;
    a last version that these sizes don't fit is rebalanced by bytes into the next one, and otherwise stays.

    Equal rows get places in any order; empty tables give no rows and the map. Only doc_id and text are read. A null doc_id
    tells nothing, so each row that has one is hashed by its place in the table; so is each row of a doc_id that repeats and
    has more than a thousandth of all bytes (HEAVY), which would weigh down one slot.

    Places come from counts per part of a virtual slot, so no task orders a shard or the rows of null doc_ids."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    sized = cut(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")))
    sized = sized.withColumn("row", F.monotonically_increasing_id())  # over written rows, so it stays
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    sums = sized.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    many = cut(sums.where((F.col("rows") > 1) & (F.col("bytes") * HEAVY > total)).select("doc_id", F.lit(True).alias("many")))
    held = sized.join(F.broadcast(many), "doc_id", "left")  # fewer than HEAVY rows
    row = F.when(F.col("doc_id").isNull() | F.col("many"), F.col("row"))
    keyed = held.withColumn("row", row).withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "row"), F.lit(slots)).cast("int"))
    keyed = keyed.withColumn("part", F.pmod(F.xxhash64("size", "text_crc32", "row", "doc_id"), F.lit(PARTS)).cast("int"))
    # at most PARTS rows for each virtual slot: a fixed number
    sums = cut(keyed.groupBy("virtual_slot", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    size = {r["virtual_slot"]: r["bytes"] for r in sums.groupBy("virtual_slot").agg(F.sum("bytes").alias("bytes")).collect()}
    store = store or f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    version, owner = stored_version(spark, store)
    if not version:
        version, owner = 1, first_map(shards, slots)
        store_version(spark, store, version, owner, size)
    if len(owner) != slots or max(owner) >= shards:
        raise ValueError("the stored map has other slots or shards")
    if (edited := rebalanced(owner, size, shards)) != owner:
        version += 1
        store_version(spark, store, version, edited, size)
    maps = versions(spark, store)
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    current = sums.join(F.broadcast(maps.where(F.col("version") == version).select("virtual_slot", "shard")), "virtual_slot")
    current = current.select("virtual_slot", "part", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "size", "text_crc32", "row")
    rows = keyed.withColumn("place", F.row_number().over(order)).join(F.broadcast(current), ["virtual_slot", "part"])
    return rows.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("base") + F.col("place") - 1).alias("slot")), maps
