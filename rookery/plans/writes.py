"""Queries over imports, stored tables and syncs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus, imports, replay, search, storage
from ..sources import pgn
from . import bindings as b
from .games import _FAULT, _LINE_SQL, _PLIES, games
from .queries import query

#: Sources of about a thousandth of the orders each; few of a source's games are malformed, or repeat an id of it or a stored one.
_SOURCES = """SELECT o_custkey % 20 AS source, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey, o_custkey) AS number, o_orderkey FROM orders"""
_IDS = "CASE WHEN o_orderkey % 397 = 5 THEN '' WHEN o_orderkey % 401 = 9 THEN concat('r', source, '-', greatest(number - 3, 1)) WHEN o_orderkey % 409 = 3 THEN concat('stored-', o_orderkey % 7) ELSE concat('r', source, '-', number) END"
_GAMES = f"SELECT source, number, {_IDS} AS record_id, CASE WHEN o_orderkey % 389 = 11 THEN 'no_moves' END AS fault FROM ({_SOURCES})"
_STORED = "SELECT concat('stored-', i) AS record_id FROM (SELECT unnest(range(7)) AS i)"


def _sql(skip: bool) -> str:
    stop = "fault IS NULL AND" if skip else ""
    return f"""WITH g AS ({_GAMES}), stored AS ({_STORED}), firsts AS (SELECT source, record_id, min(number) AS first FROM g WHERE fault IS NULL GROUP BY ALL),
      r AS (SELECT g.*, CASE WHEN fault IS NOT NULL THEN {'NULL' if skip else "'invalid_game'"} WHEN record_id = '' THEN 'invalid_record_id' WHEN number > first THEN 'duplicate_record_id' WHEN record_id IN (SELECT record_id FROM stored) THEN 'record_exists' END AS reason FROM g LEFT JOIN firsts USING (source, record_id)),
      stops AS (SELECT source, arg_min(struct_pack(n := number, r := reason, f := fault), number) AS s FROM r WHERE reason IS NOT NULL GROUP BY source),
      k AS (SELECT r.*, s FROM r LEFT JOIN stops USING (source) WHERE s IS NULL OR number < s.n)"""


def _strict(spark, d, skip):
    b.table(spark, d, "orders").createOrReplaceTempView("orders")
    stored = spark.range(7).select(F.concat(F.lit("stored-"), F.col("id").cast("string")).alias("record_id"))
    return imports.strict(spark.sql(_GAMES), stored, skip_malformed=skip)


@query(f"""{_sql(False)} SELECT source, count(*) FILTER (WHERE k.number IS NOT NULL) AS imported, CAST(ceil(count(k.number) / 10) AS BIGINT) AS groups, 0 AS malformed, any_value(stops.s.n) AS index, any_value(stops.s.r) AS error, any_value(stops.s.f) AS detail
    FROM (SELECT DISTINCT source FROM g) LEFT JOIN k USING (source) LEFT JOIN stops USING (source) GROUP BY source""")
def import_strict(spark, d):
    """Where each source's strict import stops, and why."""
    return _strict(spark, d, False)[1]


@query(f"""{_sql(True)}, ok AS (SELECT source, number, record_id, (row_number() OVER (PARTITION BY source ORDER BY number) - 1) // 10 + 1 AS grp FROM k WHERE fault IS NULL)
    SELECT source, number, record_id, grp AS "group" FROM ok""")
def import_strict_groups(spark, d):
    """The games that strict imports take when malformed ones are left out, with the groups that they are committed in."""
    return _strict(spark, d, True)[0].select("source", "number", "record_id", "group")


@query(f"{_sql(True)}, n AS (SELECT source, count(*) AS games FROM k WHERE fault IS NULL GROUP BY source) SELECT source, games, malformed FROM n JOIN (SELECT source, count(*) FILTER (WHERE fault IS NOT NULL) AS malformed FROM k GROUP BY source) USING (source)")
def import_malformed(spark, d):
    return _strict(spark, d, True)[1].where("imported > 0").select("source", F.col("imported").alias("games"), "malformed")


@query("""WITH e AS (SELECT user_id % 40 AS source, ts AS tm, event_id AS id FROM events), c AS (SELECT source, max(struct_pack(tm, id)) AS mark FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY tm, id) AS n FROM e) WHERE n <= 9 AND source % 5 > 0 GROUP BY source),
    h AS (SELECT e.*, row_number() OVER (PARTITION BY e.source ORDER BY tm, id) AS n FROM e LEFT JOIN c USING (source) WHERE (mark IS NULL OR struct_pack(tm, id) > mark) AND e.source % 7 <> 3) SELECT source, id, (n - 1) // 4 + 1 AS page FROM h WHERE n <= 12""")
def sync_pages(spark, d):
    """Three pages of four for each source after its cursor; sources of remainder 3 by 7 refuse."""
    held = b.table(spark, d, "events").selectExpr("user_id % 40 AS source", "ts AS at", "event_id AS id")
    none = spark.createDataFrame([], "source long, at timestamp, id long").select("source", F.col("at").cast(held.schema["at"].dataType).alias("at"), "id")
    cursors = imports.synced(held.where("source % 5 > 0"), none, 9, 1)[1]
    return imports.synced(held, cursors, 4, 3, held.where("source % 7 = 3").select("source").distinct())[0].select("source", "id", "page")


@query(f"""WITH g AS (SELECT DISTINCT o_orderkey % 4 AS line, {_PLIES} AS plies FROM orders WHERE ({_FAULT}) IS NULL), p AS (SELECT DISTINCT {_LINE_SQL}[line + 1][1:ply] AS prefix FROM (SELECT line, unnest(range(plies + 1)) AS ply FROM g))
    SELECT 'positions' AS name, count(*) AS n, count(*) AS last FROM p UNION ALL SELECT 'games', count(*), count(*) FROM g UNION ALL SELECT 'occurrences', CAST(sum(plies + 1) AS BIGINT), CAST(sum(plies + 1) AS BIGINT) FROM g
    UNION ALL SELECT 'records', count(*), count(*) FROM orders WHERE ({_FAULT}) IS NULL UNION ALL SELECT 'refused', count(*), NULL FROM orders WHERE ({_FAULT}) IS NULL AND o_custkey % 5 = 2""")
def star_appended(spark, d):
    """Rows and last ids of tables to which games were added in two runs, the second with some games of the first again."""
    path = storage.folder(spark)
    held = games(spark, d).join(b.table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_custkey"), "id")
    framed = pgn.framed(held).where("error IS NULL")
    refused = None
    for part in ("o_custkey % 5 < 3", "o_custkey % 5 >= 2"):
        own = framed.where(part)
        refused = storage.append(replay.played(own, "id").join(own.select("id", "headers"), "id"), "id", path)
    counts = [df.agg(F.lit(t).alias("name"), F.count("*").alias("n"), F.max("id").alias("last")) for t, df in storage.read(spark, path).items()]
    counts.append(refused.where("error = 'already_exists'").agg(F.lit("refused").alias("name"), F.count("*").alias("n"), F.lit(None).cast("long").alias("last")))
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


@query(f"WITH {b.POSITIONS}, {b.OCCURRENCES} SELECT position_id, move, count(*) AS n FROM occurrences o JOIN positions p ON p.id = o.position_id WHERE white IN (SELECT white FROM positions WHERE material = 3) GROUP BY position_id, move")
def bucketed_moves(spark, d):
    """The moves played from positions with structures like those of a material, over tables in buckets of the position."""
    path = storage.folder(spark)
    positions = storage.bucketed(b.positions(spark, d), "id", f"{path}/positions", 16)
    played = storage.bucketed(b.occurrences(spark, d), "position_id", f"{path}/occurrences", 16, ["move"])
    like = search.in_keys(positions, b.positions(spark, d).where("material = 3"), ["white"])
    return storage.moves_of(like, played)


@query(f"""WITH {b.POSITIONS}, asked AS (SELECT white, black FROM positions ORDER BY id LIMIT 1), forms AS (SELECT white, black FROM asked UNION SELECT {b.flip(7, 'white')}, {b.flip(7, 'black')} FROM asked UNION SELECT {b.flip(56, 'black')}, {b.flip(56, 'white')} FROM asked UNION SELECT {b.flip(63, 'black')}, {b.flip(63, 'white')} FROM asked)
    SELECT id, white, black FROM positions WHERE (white, black) IN (SELECT white, black FROM forms) AND id > 1 ORDER BY id LIMIT 11""")
def symmetry_branches(spark, d):
    """A page of positions whose structure is a symmetry of the first one's, from a limited scan for each form."""
    held = b.positions(spark, d).select("id", "white", "black")
    return search.symmetry_page(held, held.orderBy("id").limit(1), 10, 1)


@query("SELECT count(*) AS rows FROM lineitem")
def rows_from_footers(spark, d):
    return storage.rows_of(spark, f"{d}/lineitem.parquet")
