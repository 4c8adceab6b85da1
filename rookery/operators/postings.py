"""Posting lists as bitmaps: which ids hold an atom, for each atom and bucket of 32,768 ids.

Lists are built with Spark's bitmap aggregates and stored in parts by a hash of the
atom, so that a search reads the parts of the atoms that it asks for and no other. AND
and OR are the aggregates' again, bucket by bucket; NOT takes bits away from the list of
all ids. New ids are appended as further rows; those of one atom and bucket are united
when read. Texts are held by their trigrams: these narrow a search for a part of a
text, and what is left is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.once import made_once
from . import search

#: Ids of a bucket, and parts by the hash of atoms.
BUCKET, PARTS = 32_768, 64
#: The atom that every id holds. (No other may be this text.)
EVERY = "*"
#: The characters of a piece of text.
PIECE = 3


def part_of(atom: Column) -> Column:
    return F.pmod(F.xxhash64(atom), F.lit(PARTS)).cast("int")


def built(rows: DataFrame, id: str, atoms: str) -> DataFrame:
    """part, atom, bucket and bits of rows(id, atoms array). Every id stands under EVERY, also one without atoms; null ids and null
    atoms under nothing, and what repeats counts once. Partial bitmaps are combined before the shuffle, so that an atom that
    most ids hold sends one row for each task and bucket."""
    held = rows.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(atoms).cast("array<string>"), F.array().cast("array<string>")).alias("atoms"))
    flat = held.select("id", F.explode(F.concat(F.array(F.lit(EVERY)), "atoms")).alias("atom")).where("atom IS NOT NULL")
    bits = flat.groupBy("atom", F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
    return bits.select(part_of(F.col("atom")).alias("part"), "atom", "bucket", "bits")


def written(postings: DataFrame, path: str) -> None:
    """Appends to stored lists, sorted by atom within their parts."""
    postings.repartition("part").sortWithinPartitions("part", "atom", "bucket").write.mode("append").partitionBy("part").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("atom string, bucket long, bits binary, part int").parquet(path)


def _asked(postings: DataFrame, atoms: list[str]) -> DataFrame:
    """The rows of these atoms, by their parts first."""
    spark = postings.sparkSession
    wanted = sorted(set(atoms))
    parts = sorted({r[0] for r in spark.createDataFrame([(a,) for a in wanted], "atom string").select(part_of(F.col("atom"))).collect()}) if wanted else []
    return postings.where(F.col("part").isin(*parts) & F.col("atom").isin(*wanted))


def any_of(postings: DataFrame, atoms: list[str]) -> DataFrame:
    """bucket and bits of the ids that hold one of the atoms; for no atoms none."""
    return _asked(postings, atoms).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def all_of(postings: DataFrame, atoms: list[str]) -> DataFrame:
    """bucket and bits of the ids that hold all atoms; for no atoms all ids. An unknown atom is held by none."""
    wanted = sorted(set(atoms)) or [EVERY]
    lists = _asked(postings, wanted).groupBy("bucket", "atom").agg(F.bitmap_or_agg("bits").alias("bits"))  # appended rows of one list
    return lists.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n")).where((F.col("n") == len(wanted)) & (F.bitmap_count("bits") > 0)).select("bucket", "bits")


def none_of(postings: DataFrame, atoms: list[str]) -> DataFrame:
    """bucket and bits of the ids that hold none of the atoms."""
    return without(all_of(postings, []), any_of(postings, atoms))


def both(left: DataFrame, right: DataFrame) -> DataFrame:
    """bucket and bits that are in both."""
    got = left.unionByName(right).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
    return got.where((F.col("n") == 2) & (F.bitmap_count("bits") > 0)).select("bucket", "bits")


def without(left: DataFrame, right: DataFrame) -> DataFrame:
    """bucket and bits of left that right doesn't have, eight bytes at a time."""
    eight = lambda bits, i: F.conv(F.hex(F.substring(bits, i * 8 + 1, F.lit(8))), 16, -10).cast("long")
    kept = lambda i: F.lpad(F.hex(eight(F.col("bits"), i).bitwiseAND(F.bitwise_not(eight(F.col("_less"), i)))), 16, "0")
    less = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BUCKET // 64 - 1)), kept), ""))
    held = left.join(right.select("bucket", F.col("bits").alias("_less")), "bucket", "left")
    return held.select("bucket", F.when(F.col("_less").isNull(), F.col("bits")).otherwise(less).alias("bits")).where(F.bitmap_count("bits") > 0)


def ids(found: DataFrame, *kept: str) -> DataFrame:
    """id of each bit of (bucket, bits), and columns that are kept."""
    byte = lambda i: F.struct(i.alias("at"), F.conv(F.hex(F.substring("bits", i + 1, F.lit(1))), 16, 10).cast("int").alias("b"))
    some = F.filter(F.transform(F.sequence(F.lit(0), F.lit(BUCKET // 8 - 1)), byte), lambda x: x["b"] > 0)
    bytes_ = found.select(*kept, "bucket", F.explode(some).alias("x"))
    bit = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.getbit(F.col("x.b"), k) == 1)
    place = bytes_.select(*kept, "bucket", F.col("x.at").alias("at"), F.explode(bit).alias("k")).select(*kept, "bucket", (F.col("at") * 8 + F.col("k")).cast("long").alias("place"))
    return place.select(*kept, F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * BUCKET + F.col("place") + 1).otherwise(F.col("bucket") * BUCKET - F.col("place")).alias("id"))


def pieces(text: Column) -> Column:
    """The different trigrams of a text in lower case; none of a shorter or null one. The text is a variable, so that it is made once
    and not for each trigram."""

    def cut(low: Column) -> Column:
        return F.when(F.char_length(low) >= PIECE, F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(low) - (PIECE - 1)), lambda i: F.substring(low, i, F.lit(PIECE)))))

    return F.coalesce(F.element_at(F.transform(F.array(F.lower(text)), cut), 1), F.array().cast("array<string>"))


def field_pieces(metadata: Column, fields: list[str]) -> Column:
    """The trigrams of some fields of a map, each with the name of its field before it."""

    def named(field: str) -> Column:
        return F.transform(pieces(F.try_element_at(metadata, F.lit(field))), lambda p: F.concat(F.lit(f"{field}:"), p))

    return F.flatten(F.array(*[named(f) for f in fields]))


def containing(rows: DataFrame, id: str, postings: DataFrame, field: str, part: str, metadata: str = "metadata") -> DataFrame:
    """Rows whose field contains a part of text, as search.value_contains() says it: without regard to case, % _ and backslash for
    themselves. postings: built over field_pieces(). A part with fewer than PIECE characters has no trigrams, and is
    looked for in all rows; else only rows that hold all its trigrams are compared."""
    wanted = rows.sparkSession.range(1).select(pieces(F.lit(part)).alias("p")).first()["p"]
    if wanted:
        some = ids(all_of(postings, [f"{field}:{p}" for p in wanted])).withColumnRenamed("id", id)
        rows = rows.join(some, id, "left_semi")
    return rows.where(search.value_contains(F.col(metadata), field, part))


def containing_each(rows: DataFrame, id: str, postings: DataFrame, asked: list[tuple[str, str]], metadata: str = "metadata") -> DataFrame:
    """id, field and part: containing() for many (field, part), each row for each that it contains. Lists are read once for all
    parts together, rows once for those with trigrams and once for the shorter ones."""
    asked = list(dict.fromkeys(asked))
    spark = rows.sparkSession
    named = spark.createDataFrame([(i, f, p) for i, (f, p) in enumerate(asked)], "asked int, field string, part string")
    atoms = [(r[0], [f"{r[1]}:{p}" for p in r[2]]) for r in named.select("asked", "field", pieces(F.col("part"))).collect()]
    wanted = spark.createDataFrame([(a, i, len(of)) for i, of in atoms for a in of], "atom string, asked int, need int")
    lists = _asked(postings, [a for _, of in atoms for a in of]).groupBy("bucket", "atom").agg(F.bitmap_or_agg("bits").alias("bits"))
    all_held = lists.join(F.broadcast(wanted), "atom").groupBy("asked", "need", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
    some = ids(all_held.where((F.col("n") == F.col("need")) & (F.bitmap_count("bits") > 0)), "asked").withColumnRenamed("id", id)
    # maps are made once for a row
    held = made_once(rows.select(id, F.col(metadata).alias("_metadata")), _held=F.col("_metadata")).select(id, "_held")
    contains = {i: search.value_contains(F.col("_held"), *asked[i]) for i, _ in atoms}
    long, short = ([i for i, of in atoms if bool(of) == has] for has in (True, False))
    found = spark.createDataFrame([], f"{id} {rows.schema[id].dataType.simpleString()}, asked int")
    if long:
        test = F.lit(False)
        for i in long:
            test = F.when(F.col("asked") == i, contains[i]).otherwise(test)
        found = found.unionByName(held.join(some, id).where(test).select(id, "asked"))
    if short:
        which = F.filter(F.array(*[F.when(contains[i], F.lit(i)) for i in short]), lambda i: i.isNotNull())
        found = found.unionByName(held.select(id, F.explode(which).alias("asked")))
    return found.join(F.broadcast(named), "asked").select(id, "field", "part")
