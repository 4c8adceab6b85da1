"""Mixing sources to target weights by weighted fair queueing.

Every copy of a document gets a virtual finish time: the tokens of its source
up to and with it, in shuffled order, divided by the source's target. Sorted by
that time over all sources, copies are taken until the total budget is spent.

Running sums never need a source (or the corpus) in one task: documents fall
into buckets by shuffle key, small sums per (source, bucket) are accumulated,
and only rows of one bucket are ordered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut

#: Words are runs of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source's target, and so no document, exceeds this many times its size.
EPOCHS = 3
#: Steps of virtual time in the histogram that finds the cut, and within one of them in the next; only copies of one of the
#: last steps are put in order.
STEPS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target): shares of the sum by weight, no target above
    ``epochs`` times its source, the excess shared again. Sorted by size over weight, the capped sources are
    a prefix, so one pass finds the level. A row for each source, however long the corpus."""
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("long"))
    levels = (
        weighed.withColumn("ratio", epochs * F.col("source_size") / F.col("weight"))
        .withColumn("capped_before", epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("rest"))
    )
    first = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(Window.partitionBy())
    return levels.select("source", "source_size", F.least(F.lit(float(epochs)) * F.col("source_size"), F.coalesce(first["level"], F.lit(0.0)) * F.col("weight")).alias("target"), "total")


def _cut(rows: DataFrame, by: str) -> DataFrame:
    """The value of by in which the sizes of rows, in its order, pass their budget, and left: what is left of the budget where
    it begins. No row if they don't. One row of sums for each value, of which there are at most 2 * STEPS."""
    run = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.groupBy(by).agg(F.sum("size").alias("tokens"), F.max("budget").alias("budget")).withColumn("upto", F.sum("tokens").over(run))
    first = sums.where(F.col("upto") > F.col("budget")).agg(F.min(F.struct(by, (F.col("budget") - F.col("upto") + F.col("tokens")).alias("left"))).alias("cut"))
    return first.where("cut is not null").select("cut.*")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken (words, repeats counted), source.

    A null text has size 0; null is a source of its own, last in order; documents of size 0 take 0. Repeated
    rows are rows of their own, equal ones in any order. An empty table gives an empty one. Extra columns of
    docs are not read.
    """
    # rows without doc_id are told apart by their text
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit("")))))
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key")).withColumn("bucket", F.substring("key", 1, 3)))

    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, epochs)
    offsets = sums.withColumn("offset", F.sum("bucket_size").over(up_to) - F.col("bucket_size")).alias("o").join(whole.alias("w"), F.col("o.source").eqNullSafe(F.col("w.source")))
    offsets = offsets.select(F.col("o.source").alias("s"), F.col("bucket").alias("b"), "offset", "source_size", "target", "total")
    within = Window.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("sum", F.sum("size").over(within)).join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    # finish[p] is the virtual finish time of the copy taken in pass p
    finish = F.transform(F.sequence(F.lit(0), F.lit(epochs - 1)), lambda p: (p * F.col("source_size") + F.col("offset") + F.col("sum")) / F.col("target"))
    placed = cut(placed.select("doc_id", "source", "key", "size", "source_size", "target", "total", F.when((F.col("size") > 0) & (F.col("target") > 0), finish).alias("finish")))

    fine = lambda t: F.floor(F.least(t, F.lit(2.0)) * (STEPS * STEPS))
    copies = placed.select("size", "key", "source", "doc_id", "total", F.explode("finish").alias("time")).withColumn("fine", fine(F.col("time"))).withColumn("step", F.floor(F.col("fine") / STEPS))
    step = _cut(copies.withColumnRenamed("total", "budget"), "step")
    inside = copies.join(F.broadcast(step.select("step", F.col("left").alias("budget"))), "step")
    last = _cut(inside, "fine").select(F.col("fine").alias("cut_fine"), "left")
    order = Window.orderBy("time", "key", "source", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rim = copies.join(F.broadcast(last), F.col("fine") == F.col("cut_fine")).withColumn("spent", F.sum("size").over(order)).where(F.col("spent") <= F.col("left"))
    rim = rim.agg(F.max(F.struct("time", "key", "source", "size")).alias("rim"))
    edge = last.crossJoin(rim)  # one row
    taken = F.aggregate(
        "finish", F.lit(0).cast("long"),
        lambda n, t: n + F.when(F.col("cut_fine").isNull() | (fine(t) < F.col("cut_fine")) | ((fine(t) == F.col("cut_fine")) & (F.struct(t.alias("time"), "key", "source", "size") <= F.col("rim"))), F.col("size")).otherwise(0),
    )
    return placed.join(F.broadcast(edge), F.lit(True), "left").select("doc_id", "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"), "source")


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The rows of docs with all their columns, each as often as the mix takes it; those not taken go.

    Rows alike in doc_id, source and size share what the mix takes of them as evenly as it can be; only where there are
    such rows are they numbered."""
    same = ["doc_id", "source", "size"]
    fresh = "_" * (1 + max(len(c) for c in docs.columns))  # begins no column's name
    named = {c: fresh + c for c in (*same, "times", "alike", "own", "n", "copy")}
    times = (F.col("taken") / F.col("size")).cast("long")
    held = mix(docs, weights, epochs).where("size > 0").groupBy(*same).agg(F.sum(times).alias("times"), F.count("*").alias("alike")).where("times > 0")
    held = cut(held.select(*[F.col(c).alias(named[c]) for c in (*same, "times", "alike")]))
    sized = docs.withColumn(named["own"], word_count(docs["text"]))
    on = sized["doc_id"].eqNullSafe(held[named["doc_id"]]) & sized["source"].eqNullSafe(held[named["source"]]) & (sized[named["own"]] == held[named["size"]])
    rows, own = sized.join(held, on), F.col(named["times"])
    if not held.where(F.col(named["alike"]) > 1).isEmpty():
        rows = rows.withColumn(named["n"], F.row_number().over(Window.partitionBy(*[named[c] for c in same]).orderBy(F.xxhash64("text"))))
        own = F.floor(own / F.col(named["alike"])) + F.when(F.col(named["n"]) <= own % F.col(named["alike"]), 1).otherwise(0)
    rows = rows.withColumn(named["copy"], F.explode(F.when(own > 0, F.sequence(F.lit(1).cast("long"), own.cast("long"))).otherwise(F.array().cast("array<long>"))))
    return rows.select(*[sized[c] for c in docs.columns])


#: The same in one pass for small tables: whole sources and the whole corpus are ordered at once.
MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, ''))) AS key FROM {docs}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
r AS (SELECT *, 3 * source_size / weight AS ratio FROM w),
l AS (SELECT *, (total - 3 * coalesce(CAST(sum(source_size) OVER b AS BIGINT), 0)) / (CAST(sum(weight) OVER () AS BIGINT) - coalesce(CAST(sum(weight) OVER b AS BIGINT), 0)) AS level
      FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, total, least(3.0::DOUBLE * source_size, coalesce((SELECT arg_min(level, ratio) FROM l WHERE ratio > level), 0) * weight) AS target FROM l),
c AS (SELECT d.*, t.source_size, t.target, t.total, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT doc_id, key, source, size, total, (e * source_size + cum) / target AS time FROM c, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0 AND target > 0),
q AS (SELECT doc_id, size, sum(size) OVER (ORDER BY time, key, source NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS spent, total FROM p),
k AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM q WHERE spent <= total GROUP BY doc_id)
SELECT c.doc_id, c.size, c.source_size, c.target, coalesce(k.taken, 0) AS taken, c.source FROM c LEFT JOIN k ON c.doc_id = k.doc_id
"""
