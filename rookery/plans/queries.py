"""A query for each operator over the driver's tables, with the same in DuckDB's SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, pawns
from ..operators import analysis, search, store
from . import bindings as b

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = re.sub(r"\b([a-z]) -> ", r"lambda \1: ", sql)
        return f

    return add


def _found(spark: SparkSession, d: str) -> DataFrame:
    return search.matches(b.positions(spark, d), b.occurrences(spark, d), b.records(spark, d))


KEYS = ("position_id", "occurrence_id", "game_id", "ply", "record_id")
_KEYS = ", ".join(KEYS)
#: The structure of the queries below: that of size 10 and brand 3.
_W, _B = b.WHITE.replace("p_size", "10").replace("p_brand", "'Brand#3'"), b.BLACK.replace("p_size", "10").replace("p_brand", "'Brand#3'")


# Positions by structure and record.


@query(f"WITH {b.POSITIONS} SELECT id, white, black FROM positions WHERE id = 77")
def position_exact(spark, d):
    return b.positions(spark, d).where("id = 77").select("id", "white", "black")


@query(f"WITH {b.POSITIONS} SELECT id, white, black FROM positions WHERE white = {_W} AND black = {_B}")
def structure_exact(spark, d):
    return b.positions(spark, d).where(f"white = {_W} AND black = {_B}").select("id", "white", "black")


@query(f"WITH {b.POSITIONS} SELECT id, white, black FROM positions WHERE (white, black) IN (SELECT white, black FROM positions WHERE id % 40 = 0)")
def structure_set_semi(spark, d):
    p = b.positions(spark, d)
    return search.in_keys(p, p.where("id % 40 = 0"), ["white", "black"]).select("id", "white", "black")


def _edits_sql(n: int) -> str:
    """Structures within n edits by brute force over pairs of positions: pieces that differ, matched as one edit each."""
    step = """SELECT white & ~(1::BIGINT << s) AS white, black, d + 1 AS d FROM {t}, sq WHERE ((white >> s) & 1) = 1
        UNION SELECT white, black & ~(1::BIGINT << s), d + 1 FROM {t}, sq WHERE ((black >> s) & 1) = 1
        UNION SELECT (white & ~(1::BIGINT << s)) | (1::BIGINT << t), black, d + 1 FROM {t}, mv WHERE ((white >> s) & 1) = 1 AND (((white | black) >> t) & 1) = 0
        UNION SELECT white, (black & ~(1::BIGINT << s)) | (1::BIGINT << t), d + 1 FROM {t}, mv WHERE ((black >> s) & 1) = 1 AND (((white | black) >> t) & 1) = 0"""
    parts = ["k0 AS (SELECT white, black, 0 AS d FROM asked)"]
    for i in range(n):
        parts.append(f"k{i + 1} AS ({step.format(t=f'k{i}')})")
    union = " UNION ALL ".join(f"SELECT * FROM k{i}" for i in range(n + 1))
    return f"""WITH {b.WHOLE}, {b.ASKED}, sq AS (SELECT unnest(range(8, 56)) AS s),
    mv AS (SELECT a.s, c.s AS t FROM sq a, sq c WHERE abs(a.s // 8 - c.s // 8) = 1 AND abs(a.s % 8 - c.s % 8) <= 1), {', '.join(parts)},
    keys AS (SELECT white, black, min(d) AS distance FROM ({union}) GROUP BY white, black)
    SELECT p.id, k.distance FROM whole p JOIN keys k ON p.white = k.white AND p.black = k.black"""


def _near(spark, d, edits):
    keys = pawns.neighbourhood(b.asked_position(spark).select("white", "black"), edits)
    # size checked by Spark: the neighbourhood of one structure has a few thousand keys, and joins like any table beyond the broadcast threshold
    return b.whole_positions(spark, d).join(keys, ["white", "black"]).select("id", "distance")


@query(_edits_sql(1))
def structure_edit1_join(spark, d):
    return _near(spark, d, 1)


@query(_edits_sql(2))
def structure_edit2_join(spark, d):
    return _near(spark, d, 2)


_FLIP_RANKS = "list_sum(list_transform(list_filter(range(8, 56), s -> (({m} >> s) & 1) = 1), s -> 1::BIGINT << xor(s, 56)))"
_FLIP_FILES = "list_sum(list_transform(list_filter(range(8, 56), s -> (({m} >> s) & 1) = 1), s -> 1::BIGINT << xor(s, 7)))"


def _flip(form: str, m: str) -> str:
    return f"CAST(coalesce({form.format(m=m)}, 0) AS BIGINT)"


_MIRROR = f"""forms AS (SELECT id, {_flip(_FLIP_RANKS.replace('{m}', 'black'), 'x')} AS rw, {_flip(_FLIP_RANKS.replace('{m}', 'white'), 'x')} AS rb, {_flip(_FLIP_FILES.replace('{m}', 'white'), 'x')} AS fw, {_flip(_FLIP_FILES.replace('{m}', 'black'), 'x')} AS fb FROM positions)"""


@query(f"WITH {b.POSITIONS}, {_MIRROR} SELECT id, rw AS white, rb AS black FROM forms")
def color_reversed(spark, d):
    w, k = pawns.color_reversed("white", "black")
    return b.positions(spark, d).select("id", F.expr(w).alias("white"), F.expr(k).alias("black"))


@query(f"WITH {b.POSITIONS}, {_MIRROR} SELECT id, fw AS white, fb AS black FROM forms")
def file_reflected(spark, d):
    w, k = pawns.file_reflected("white", "black")
    return b.positions(spark, d).select("id", F.expr(w).alias("white"), F.expr(k).alias("black"))


@query(f"""WITH {b.POSITIONS}, {_MIRROR}, rf AS (SELECT id, rw AS white, rb AS black FROM forms),
    rfm AS (SELECT id, {_flip(_FLIP_FILES.replace('{m}', 'white'), 'x')} AS white, {_flip(_FLIP_FILES.replace('{m}', 'black'), 'x')} AS black FROM rf)
    SELECT DISTINCT id, white, black FROM (SELECT id, white, black FROM positions UNION ALL SELECT * FROM rf UNION ALL SELECT id, fw, fb FROM forms UNION ALL SELECT * FROM rfm)""")
def structure_symmetries(spark, d):
    return pawns.symmetries(b.positions(spark, d)).select("id", F.explode("symmetry").alias("s")).select("id", "s.white", "s.black")


def _neighbours_sql(moves: str, removal: bool = False) -> str:
    kinds = []
    for own in ("white", "black"):
        new = f"(({own} & ~(1::BIGINT << s)) | (1::BIGINT << t))"
        pair = f"{new} AS white, black" if own == "white" else f"white, {new} AS black"
        kinds.append(f"SELECT {pair} FROM keys, mv WHERE (({own} >> s) & 1) = 1 AND (((white | black) >> t) & 1) = 0 AND {moves.format(up=1 if own == 'white' else -1)}")
        if removal:
            gone = f"({own} & ~(1::BIGINT << s))"
            kinds = [k for k in kinds if "mv" not in k] + [f"SELECT {gone + ' AS white, black' if own == 'white' else 'white, ' + gone + ' AS black'} FROM keys, sq WHERE (({own} >> s) & 1) = 1"]
    return f"""WITH {b.POSITIONS}, keys AS (SELECT DISTINCT white, black FROM positions), sq AS (SELECT unnest(range(8, 56)) AS s),
    mv AS (SELECT a.s, c.s AS t FROM sq a, sq c) SELECT DISTINCT white, black FROM ({' UNION ALL '.join(kinds)})"""


def _all_keys(spark, d):
    return b.positions(spark, d).select("white", "black").distinct()


@query(_neighbours_sql("t - s = 8 * {up}"))
def neighbours_single_push(spark, d):
    return pawns.neighbours(_all_keys(spark, d), pushes=True)


@query(_neighbours_sql("abs(t - s) = 8"))
def neighbours_single_rank(spark, d):
    return pawns.neighbours(_all_keys(spark, d), ranks=True)


@query(_neighbours_sql("abs(t // 8 - s // 8) = 1 AND abs(t % 8 - s % 8) = 1"))
def neighbours_capture_like(spark, d):
    return pawns.neighbours(_all_keys(spark, d), captures=True)


@query(_neighbours_sql("true", removal=True))
def neighbours_missing_pawn(spark, d):
    return pawns.neighbours(_all_keys(spark, d), removals=True)


@query(f"""WITH {b.POSITIONS}, x AS (SELECT p.id, p.white & ~q.white AS rw, p.black & ~q.black AS rb, q.white & ~p.white AS aw, q.black & ~p.black AS ab FROM positions p JOIN positions q ON q.id = p.id + 1),
    y AS (SELECT *, bit_count(rw) + bit_count(rb) AS gone, bit_count(aw) + bit_count(ab) AS come,
        list_filter(range(64), s -> (((rw | rb) >> s) & 1) = 1) AS f, list_filter(range(64), s -> (((aw | ab) >> s) & 1) = 1) AS t FROM x)
    SELECT id, rw AS removed_white, rb AS removed_black, aw AS added_white, ab AS added_black,
    CASE WHEN gone = 0 AND come = 0 THEN 'exact' WHEN gone = 1 AND come = 0 THEN 'removal' WHEN gone = 0 AND come = 1 THEN 'addition'
    WHEN gone = 1 AND come = 1 AND bit_count(rw) = bit_count(aw) AND abs(f[1] // 8 - t[1] // 8) = 1 AND f[1] % 8 = t[1] % 8 THEN 'single_rank'
    WHEN gone = 1 AND come = 1 AND bit_count(rw) = bit_count(aw) AND abs(f[1] // 8 - t[1] // 8) = 1 AND abs(f[1] % 8 - t[1] % 8) = 1 THEN 'capture_like' ELSE 'not_single_edit' END AS kind FROM y""")
def pawn_difference_classify(spark, d):
    p = b.positions(spark, d)
    q = p.select((F.col("id") - 1).alias("id"), F.col("white").alias("w2"), F.col("black").alias("b2"))
    held = pawns.difference(p.join(q, "id"), ("white", "black"), ("w2", "b2"))
    return held.select("id", "removed_white", "removed_black", "added_white", "added_black", "kind")


@query(f"WITH {b.POSITIONS} SELECT id, bit_count(white) AS white_pawns, bit_count(black) AS black_pawns, len(list_filter(range(8), f -> bit_count(white & (72340172838076673 << f)) > 0)) AS white_files FROM positions".replace("(72340172838076673 << f)", "list_sum(list_transform(range(1, 7), r -> 1::BIGINT << (8 * r + f)))::BIGINT"))
def bitboard_popcount(spark, d):
    return b.positions(spark, d).selectExpr("id", "CAST(bit_count(white) AS BIGINT) AS white_pawns", "CAST(bit_count(black) AS BIGINT) AS black_pawns", f"CAST(bit_count({bits.files_of('white')}) AS BIGINT) AS white_files")


@query("SELECT doc_id, coalesce(sum(1::BIGINT << i) FILTER (WHERE substr(h, i + 1, 1) = 'a'), 0)::BIGINT AS mask FROM (SELECT doc_id, substr(md5(doc_id::VARCHAR) || md5((doc_id + 1)::VARCHAR), 1, 60) AS h FROM documents), (SELECT unnest(range(60)) AS i) GROUP BY doc_id")
def bitboard_from_bytes(spark, d):
    held = b.table(spark, d, "documents").selectExpr("doc_id", "substr(concat(md5(CAST(doc_id AS STRING)), md5(CAST(doc_id + 1 AS STRING))), 1, 60) AS h")
    return held.selectExpr("doc_id", "aggregate(sequence(0, 59), 0L, (a, i) -> a | IF(substr(h, i + 1, 1) = 'a', shiftleft(1L, i), 0L)) AS mask")


# Predicates.


@query(f"WITH {b.POSITIONS} SELECT id FROM positions WHERE (bit_count(white) > 8 AND NOT (bit_count(black) < 9)) OR id % 100 = 3")
def predicate_and_or_not(spark, d):
    many, few = F.bit_count("white") > 8, F.bit_count("black") < 9
    return b.positions(spark, d).where(search.some(search.every(many, ~few), F.col("id") % 100 == 3)).select("id")


@query(f"WITH {b.POSITIONS} SELECT id FROM positions p WHERE material = 2 OR NOT EXISTS (SELECT 1 FROM positions k WHERE k.id % 20 = 0 AND k.white = p.white AND k.black = p.black)")
def exists_inside_or(spark, d):
    p = b.positions(spark, d)
    return search.flagged(p, p.where("id % 20 = 0"), ["white", "black"], "near").where((F.col("material") == 2) | ~F.col("near")).select("id")


@query(f"WITH {b.DIGESTS} SELECT position_id FROM digests WHERE list_has_all(atom_ids, [3, 8, 20])")
def digest_contains_all(spark, d):
    dictionary = spark.range(64).selectExpr("CAST(id AS INT) AS id", "concat('atom:', id) AS atom")
    return search.with_all_atoms(b.digests(spark, d), ["atom:3", "atom:8", "atom:20"], dictionary)


@query(f"WITH {b.DIGESTS} SELECT position_id FROM digests WHERE list_has_all(atom_ids, [3, 8, 20])")
def digest_posting_join(spark, d):
    postings = b.digests(spark, d).select("position_id", F.explode("atom_ids").alias("atom_id"))
    return search.by_postings(postings, [3, 8, 20])


@query(f"WITH {b.DIGESTS} SELECT position_id FROM digests WHERE NOT list_has_all(atom_ids, [1, 2])")
def digest_not(spark, d):
    digests = b.digests(spark, d)
    dictionary = spark.range(64).selectExpr("CAST(id AS INT) AS id", "concat('atom:', id) AS atom")
    return search.flagged(digests, search.with_all_atoms(digests, ["atom:1", "atom:2"], dictionary), ["position_id"], "has").where("NOT has").select("position_id")


# Pages of games.


@query(f"WITH {b.STAR} SELECT {_KEYS} FROM matches WHERE result = '1-0' AND position_id > 40 ORDER BY position_id, occurrence_id, record_id LIMIT 26")
def game_page_first(spark, d):
    found = _found(spark, d).where("result = '1-0' AND position_id > 40")
    return search.page(found, 25).select(*KEYS)


@query(f"WITH {b.STAR} SELECT {_KEYS} FROM matches WHERE position_id <= 900 AND occurrence_id <= 9000000 AND record_id <= 9000 AND (position_id, occurrence_id, record_id) > (120, 3000000, 3000) ORDER BY position_id, occurrence_id, record_id LIMIT 26")
def game_page_next(spark, d):
    return search.page(_found(spark, d), 25, (120, 3_000_000, 3_000), {"position_id": 900, "occurrence_id": 9_000_000, "record_id": 9_000}).select(*KEYS)


_DATES = "d AS (SELECT *, coalesce(date, '') AS date_key FROM records), t AS (SELECT * FROM d {where} ORDER BY date_key DESC, id DESC LIMIT 26), f AS (SELECT game_id, id AS occurrence_id, ply, position_id FROM occurrences QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY ply, id) = 1)"
_DATE_OUT = "SELECT t.id, t.game_id, t.date_key, f.occurrence_id, f.ply, f.position_id FROM t LEFT JOIN f ON t.game_id = f.game_id"
_DATE_COLUMNS = ["id", "game_id", "date_key", "occurrence_id", "ply", "position_id"]


@query(f"WITH {b.OCCURRENCES}, {b.RECORDS}, {_DATES.format(where='')} {_DATE_OUT}")
def date_page_first(spark, d):
    return search.date_page(b.records(spark, d), b.occurrences(spark, d), 25).select(*_DATE_COLUMNS)


@query(f"WITH {b.OCCURRENCES}, {b.RECORDS}, " + _DATES.format(where="WHERE id <= 12000 AND (date_key, id) < ('1998.05.05', 700)") + " " + _DATE_OUT)
def date_page_next(spark, d):
    return search.date_page(b.records(spark, d), b.occurrences(spark, d), 25, ("1998.05.05", 700), 12_000).select(*_DATE_COLUMNS)


@query(f"WITH {b.OCCURRENCES} SELECT game_id, id AS occurrence_id, ply, position_id FROM occurrences QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY ply, id) = 1")
def lateral_first_occurrence(spark, d):
    return search.first_occurrences(b.occurrences(spark, d))


#: The first two positions of a game that has them.
_LINE_SQL = "line AS (SELECT ply, position_id FROM occurrences WHERE ply < 2 AND game_id = (SELECT min(game_id) FROM occurrences WHERE ply = 1))"


@query(f"WITH {b.OCCURRENCES}, {_LINE_SQL} SELECT id, game_id, ply, position_id, move FROM occurrences WHERE ply = 1 AND game_id IN (SELECT o.game_id FROM occurrences o JOIN line USING (ply, position_id) GROUP BY o.game_id HAVING count(*) = 2)")
def move_line(spark, d):
    o = b.occurrences(spark, d)
    first = o.where("ply = 1").agg(F.min("game_id").alias("game_id"))
    line = o.where("ply < 2").join(F.broadcast(first), "game_id", "left_semi").select("ply", "position_id")
    return search.move_line(o, line).select("id", "game_id", "ply", "position_id", "move")


_SIMILAR = f"""{b.DIGESTS}, {b.POSITIONS}, s AS (SELECT position_id, len(list_intersect(atom_ids, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9])) AS shared FROM digests JOIN positions p ON p.id = position_id WHERE (white, black) IN (SELECT white, black FROM positions WHERE material < 5) AND list_has_any(atom_ids, [10, 11]) AND list_has_any(atom_ids, [12, 13, 14])),
    q AS (SELECT o.position_id, o.id AS occurrence_id, o.game_id, o.ply, r.id AS record_id, s.shared FROM s JOIN occurrences o USING (position_id) JOIN records r ON r.game_id = o.game_id)"""


def _similar(spark, d):
    positions = b.positions(spark, d)
    digests = b.digests(spark, d).join(positions.select(F.col("id").alias("position_id"), "white", "black"), "position_id")
    keys = positions.where("material < 5").select("white", "black").distinct()
    near = search.similar(digests, keys, list(range(10)), [10, 11], [12, 13, 14])
    o = b.occurrences(spark, d).withColumnRenamed("id", "occurrence_id")
    return near.join(o, "position_id").join(b.records(spark, d).select(F.col("id").alias("record_id"), "game_id"), "game_id")


@query(f"WITH {b.OCCURRENCES}, {b.RECORDS}, {_SIMILAR} SELECT {_KEYS}, shared FROM q ORDER BY shared DESC, position_id, occurrence_id, record_id LIMIT 25")
def similar_rank(spark, d):
    return search.similar_page(_similar(spark, d), 24).select(*KEYS, "shared")


@query(f"WITH {b.OCCURRENCES}, {b.RECORDS}, {_SIMILAR} SELECT {_KEYS}, shared FROM q WHERE shared < 6 OR (shared = 6 AND (position_id, occurrence_id, record_id) > (100, 100, 100)) ORDER BY shared DESC, position_id, occurrence_id, record_id LIMIT 25")
def similar_rank_next(spark, d):
    return search.similar_page(_similar(spark, d), 24, (6, 100, 100, 100)).select(*KEYS, "shared")


@query(f"WITH {b.OCCURRENCES}, {b.RECORDS}, {_SIMILAR} SELECT count(DISTINCT record_id) AS records FROM q")
def similar_count(spark, d):
    return search.count_records(_similar(spark, d))


@query(f"WITH {b.STAR} SELECT count(DISTINCT record_id) AS records FROM matches WHERE bit_count(white_pawns) > 9")
def count_matches(spark, d):
    p = b.positions(spark, d).where(F.bit_count("white") > 9)
    return search.count_records(search.matches(p, b.occurrences(spark, d), b.records(spark, d)))


@query("SELECT count(*) AS records FROM orders")
def corpus_size(spark, d):
    return b.records(spark, d).agg(F.count("*").alias("records"))


@query(f"WITH {b.STAR} SELECT {_KEYS} FROM matches QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY position_id, occurrence_id) = 1")
def page_dedup_records(spark, d):
    return search.one_row_per_record(_found(spark, d)).select(*KEYS)


# Record predicates.


def _where(sql: str) -> str:
    return f"WITH {b.RECORDS} SELECT id FROM records WHERE {sql}"


def _records_where(spark, d, predicate):
    return b.records(spark, d).where(predicate).select("id")


@query(_where("event = '5-LOW' AND white = 'Customer_7'"))
def metadata_contains(spark, d):
    return _records_where(spark, d, search.contains(F.col("metadata"), {"event": "5-LOW", "white": "Customer_7"}))


@query(_where("white ILIKE '%OMER\\_12%' ESCAPE '\\'"))
def metadata_ilike(spark, d):
    return _records_where(spark, d, search.value_contains(F.col("metadata"), "white", "OMER_12"))


@query(_where("contains(lower(black), 'k%3')"))
def metadata_ilike_escaped(spark, d):
    return _records_where(spark, d, search.value_contains(F.col("metadata"), "black", "K%3"))


@query(_where("event >= '2' AND event <= '4-Z'"))
def metadata_text_range(spark, d):
    return _records_where(spark, d, search.value_between(F.col("metadata"), "event", "2", "4-Z"))


@query(_where("TRY_CAST(white_elo AS INT) BETWEEN 100 AND 400"))
def metadata_int_range(spark, d):
    return _records_where(spark, d, search.int_between(F.col("metadata"), "white_elo", 100, 400))


@query(_where("contains(lower(white), 'r_5') OR contains(lower(black), 'r_5') OR contains(lower(white), 'clerk%9') OR contains(lower(black), 'clerk%9')"))
def player_either_colour(spark, d):
    m = F.col("metadata")
    return _records_where(spark, d, search.some(search.player(m, "r_5"), search.player(m, "Clerk%9")))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) BETWEEN 20 AND 40")
def metadata_json_range(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return b.table(spark, d, "events").select("event_id", k.alias("k")).where("k BETWEEN 20 AND 40")


# Analysis.


@query(f"""WITH {b.OCCURRENCES}, {b.RECORDS} SELECT move, count(DISTINCT o.game_id) AS games, count(DISTINCT r.id) FILTER (WHERE result = '1-0') AS white, count(DISTINCT r.id) FILTER (WHERE result = '1/2-1/2') AS draws,
    count(DISTINCT r.id) FILTER (WHERE result = '0-1') AS black FROM occurrences o JOIN records r ON r.game_id = o.game_id WHERE move IS NOT NULL GROUP BY move ORDER BY games DESC, move LIMIT 50""")
def opening_book(spark, d):
    return analysis.opening_book(b.occurrences(spark, d), b.records(spark, d))


@query(f"WITH {b.OCCURRENCES} SELECT o.id, p_brand AS eco, p_type AS name FROM occurrences o JOIN part ON p_partkey = position_id")
def classify_exact(spark, d):
    named = b.table(spark, d, "part").selectExpr("p_partkey AS position_id", "p_brand AS eco", "p_type AS name")
    return b.occurrences(spark, d).join(named, "position_id").select("id", "eco", "name")


@query(f"WITH {b.OCCURRENCES} SELECT game_id, p_brand AS eco, p_type AS name, ply FROM occurrences o JOIN part ON p_partkey = position_id QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY ply DESC) = 1")
def classify_deepest(spark, d):
    named = b.table(spark, d, "part").selectExpr("p_partkey AS position_id", "p_brand AS eco", "p_type AS name")
    return analysis.deepest_opening(b.occurrences(spark, d), named)


@query(f"WITH {b.EVALUATIONS} SELECT position_id, engine, depth, seq, eval_cp FROM evaluations QUALIFY row_number() OVER (PARTITION BY position_id, engine ORDER BY depth DESC, seq DESC) = 1")
def eval_deepest_wins(spark, d):
    return store.upsert(b.evaluations(spark, d), ["position_id", "engine"], ["depth", "seq"])


@query(f"WITH {b.EVALUATIONS} SELECT position_id, engine, depth, seq, eval_cp FROM evaluations WHERE position_id IN (SELECT c_custkey FROM customer) AND engine = 'click' QUALIFY row_number() OVER (PARTITION BY position_id, engine ORDER BY depth DESC, seq DESC) = 1")
def eval_get_many(spark, d):
    held = store.upsert(b.evaluations(spark, d), ["position_id", "engine"], ["depth", "seq"])
    wanted = b.table(spark, d, "customer").selectExpr("c_custkey AS position_id")
    return held.where("engine = 'click'").join(wanted, "position_id", "left_semi")


@query("SELECT user_id AS position_id, event_id AS seq, value, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def last_write_wins(spark, d):
    rows = b.table(spark, d, "events").selectExpr("user_id AS position_id", "event_id AS seq", "value", "props")
    return store.upsert(rows, ["position_id"], ["seq"])


_MATE = "CASE WHEN event_id % 40 = 3 THEN 2 WHEN event_id % 40 = 4 THEN -1 WHEN event_id % 40 = 5 THEN 0 END"


@query(f"WITH {b.SERIES} SELECT game, ply, CASE WHEN {_MATE} > 0 THEN 100.0 WHEN {_MATE} <= 0 THEN 0.0 ELSE {b.WIN} END AS win FROM series")
def win_percent(spark, d):
    """White's chances; some evaluations tell a mate, and one has none of both."""
    return b.series(spark, d).select("game", "ply", analysis.win_percent(F.col("cp"), F.expr(_MATE)).alias("win"))


_DROPS = f"""{b.SERIES}, w AS (SELECT *, {b.WIN} AS win FROM series), l AS (SELECT *, lag(win) OVER (PARTITION BY game ORDER BY ply) AS before, CASE WHEN (ply % 2 = 1) = (start_side = 'w') THEN 'w' ELSE 'b' END AS side FROM w),
    drops AS (SELECT *, CASE WHEN side = 'w' THEN before - win ELSE win - before END AS drop FROM l WHERE before IS NOT NULL)"""


def _series(spark, d):
    return b.series(spark, d).withColumn("win", analysis.win_percent(F.col("cp"), F.lit(None).cast("int"))).select("game", "ply", "win", "start_side")


@query(f"WITH {_DROPS} SELECT game, ply, side, CASE WHEN drop > 30 THEN '??' WHEN drop > 20 THEN '?' WHEN drop > 10 THEN '?!' ELSE '' END AS mark FROM drops")
def move_marks_lag(spark, d):
    return analysis.move_drops(_series(spark, d)).select("game", "ply", "side", analysis.mark(F.col("drop")).alias("mark"))


_ACC = "CASE WHEN drop <= 0 THEN 100.0 ELSE greatest(least(103.1668100711649 * exp(-0.04354415386753951 * drop) - 3.166924740191411 + 1, 100.0), 0.0) END"


@query(f"WITH {_DROPS} SELECT game, ply, side, round({_ACC}, 6) AS accuracy FROM drops")
def move_accuracy(spark, d):
    return analysis.move_drops(_series(spark, d)).select("game", "ply", "side", F.round(analysis.move_accuracy(F.col("drop")), 6).alias("accuracy"))


@query(f"""WITH {_DROPS}, g AS (SELECT game, list(win ORDER BY ply) AS win, greatest(2, least(8, (count(*) - 1) // 10)) AS k FROM w GROUP BY game),
    a AS (SELECT d.game, d.side, {_ACC} AS acc, list_slice(g.win, greatest(1, d.ply - g.k + 2), greatest(1, d.ply - g.k + 2) + g.k - 1) AS part FROM drops d JOIN g USING (game)),
    m AS (SELECT *, list_sum(part) / len(part) AS mean FROM a),
    v AS (SELECT *, greatest(0.5, least(12, sqrt(list_sum(list_transform(part, x -> (x - mean) * (x - mean))) / len(part)))) AS weight FROM m)
    SELECT game, side, round((sum(acc * weight) / sum(weight) + CASE WHEN min(acc) <= 0 THEN 0 ELSE count(*) / sum(1 / nullif(acc, 0)) END) / 2, 6) AS accuracy FROM v GROUP BY game, side""")
def game_accuracy(spark, d):
    return analysis.game_accuracy(_series(spark, d)).select("game", "side", F.round("accuracy", 6).alias("accuracy"))


@query(f"WITH {b.POSITIONS}, q AS (SELECT white AS w, black AS k, material AS m FROM positions WHERE id = 5) SELECT id, bit_count(white & w) + bit_count(black & k) - bit_count(xor(white, w)) - bit_count(xor(black, k)) + CASE WHEN material = m THEN 16 ELSE 0 END AS score FROM positions, q ORDER BY score DESC, id LIMIT 24")
def packed_similarity_score(spark, d):
    p = b.positions(spark, d)
    return analysis.packed_similarity(p, p.where("id = 5"))


@query(f"WITH {b.POSITIONS} SELECT white, black, count(*) AS positions FROM positions GROUP BY white, black ORDER BY positions DESC, white, black LIMIT 20")
def structure_histogram(spark, d):
    return b.positions(spark, d).groupBy("white", "black").agg(F.count("*").alias("positions")).orderBy(F.desc("positions"), "white", "black").limit(20)


@query(f"WITH {b.POSITIONS} SELECT material, count(*) AS positions, sum(bit_count(white)) AS pawns FROM positions GROUP BY material")
def material_histogram(spark, d):
    return b.positions(spark, d).groupBy("material").agg(F.count("*").alias("positions"), F.sum(F.bit_count("white")).alias("pawns"))


# Writes.


@query("SELECT p_size AS fingerprint, p_brand AS content, min(p_partkey) AS id FROM part GROUP BY p_size, p_brand")
def dedup_by_content(spark, d):
    return store.deduplicated(b.table(spark, d, "part").selectExpr("p_size AS fingerprint", "p_brand AS content", "p_partkey AS id"))


@query("SELECT count(*) AS rows, count(DISTINCT id) AS ids, min(id) AS first, max(id) AS last, count(DISTINCT key) AS keys FROM (SELECT dense_rank() OVER (ORDER BY l_partkey) AS id, l_partkey AS key FROM lineitem GROUP BY l_partkey)")
def insert_or_get_ids(spark, d):
    """Ids are consecutive, unique, and those that were there keep theirs."""
    keys = b.table(spark, d, "lineitem").selectExpr("l_partkey AS key")
    old = store.numbered(keys.where("key % 3 = 0").distinct(), ["key"])
    got = store.insert_or_get(old, keys, ["key"])
    return got.agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), F.min("id").alias("first"), F.max("id").alias("last"), F.count_distinct("key").alias("keys"))


@query("SELECT count(*) AS atoms, max(id) AS last, sum(CASE WHEN known THEN 1 ELSE 0 END) AS kept FROM (SELECT dense_rank() OVER (ORDER BY p_brand, p_type) AS id, bool_or(p_size < 5) AS known FROM part GROUP BY p_brand, p_type)")
def dictionary_encode(spark, d):
    atoms = b.table(spark, d, "part").selectExpr("concat(p_brand, ':', p_type) AS atom", "p_size")
    old = store.numbered(atoms.where("p_size < 5").select("atom").distinct(), ["atom"])
    new = store.dictionary_encode(old, atoms)
    return new.join(old.withColumnRenamed("id", "was"), "atom", "left").agg(F.count("*").alias("atoms"), F.max("id").alias("last"), F.sum(F.when(F.col("id") == F.col("was"), 1).otherwise(0)).alias("kept"))


@query("SELECT user_id AS game_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ply, event_id AS position_id, CASE WHEN lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) IS NOT NULL THEN event_type END AS move FROM events")
def ordinal_zip_occurrences(spark, d):
    e = b.table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("s"))
    games = e.select("id", F.expr("s.event_id").alias("positions"), F.expr("slice(s.event_type, 1, size(s) - 1)").alias("moves"))
    return store.occurrences_of(games)


@query("SELECT l_orderkey AS game_id, count(*) AS rows FROM lineitem GROUP BY l_orderkey HAVING count(*) <> count(DISTINCT l_linenumber) OR min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*)")
def occurrence_integrity(spark, d):
    o = b.table(spark, d, "lineitem").selectExpr("l_orderkey AS game_id", "l_linenumber - 1 AS ply", "l_returnflag AS move")
    return store.integrity(o).select("game_id", "rows")


@query("SELECT o_orderkey AS game_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def backfill_missing_anti(spark, d):
    done = b.table(spark, d, "lineitem").selectExpr("l_orderkey AS game_id")
    return store.missing(b.table(spark, d, "orders").selectExpr("o_orderkey AS game_id"), done, ["game_id"])


@query("SELECT p_size AS position, p_brand AS eco, p_name AS name, len(p_name) AS plies FROM part QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY len(p_name) DESC, p_brand, p_name) = 1")
def seed_longest_wins(spark, d):
    return store.longest_wins(b.table(spark, d, "part").selectExpr("p_size AS position", "p_brand AS eco", "p_name AS name", "length(p_name) AS plies"))


@query("SELECT c_custkey AS room, c_acctbal AS created FROM customer WHERE c_acctbal < 5000 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') ORDER BY created, room LIMIT 30")
def retention_old_empty(spark, d):
    rooms = b.table(spark, d, "customer").selectExpr("c_custkey AS room", "c_acctbal AS created")
    held = b.table(spark, d, "orders").where("o_orderstatus = 'F'").selectExpr("o_custkey AS room")
    return store.expired_without(rooms, held, "room", F.col("created") < 5000, 30)


@query("SELECT c_custkey AS room, coalesce(list(o_orderkey ORDER BY o_orderkey) FILTER (WHERE o_orderkey IS NOT NULL), []) AS children FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal < 0 GROUP BY c_custkey")
def inactive_with_children(spark, d):
    rooms = b.table(spark, d, "customer").selectExpr("c_custkey AS room", "c_acctbal")
    kids = b.table(spark, d, "orders").selectExpr("o_custkey AS room", "o_orderkey")
    return store.with_children(rooms, kids, "room", "o_orderkey", F.col("c_acctbal") < 0).select("room", "children")


@query("SELECT p_partkey AS analysis FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.09)")
def orphans_two_anti(spark, d):
    lines = b.table(spark, d, "lineitem").withColumnRenamed("l_partkey", "analysis")
    return store.orphans(b.table(spark, d, "part").selectExpr("p_partkey AS analysis"), lines.where("l_quantity > 48"), lines.where("l_discount > 0.09"), "analysis")


@query("SELECT c_mktsegment AS kind, count(*) AS rooms, count(*) FILTER (WHERE c_acctbal < 0) AS inactive, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS used FROM customer GROUP BY c_mktsegment")
def inventory_conditional_counts(spark, d):
    rooms = b.table(spark, d, "customer").withColumn("room", F.col("c_custkey"))
    held = search.flagged(rooms, b.table(spark, d, "orders").selectExpr("o_custkey AS room"), ["room"], "used")
    return held.groupBy(F.col("c_mktsegment").alias("kind")).agg(F.count("*").alias("rooms"), F.count_if(F.col("c_acctbal") < 0).alias("inactive"), F.count_if("used").alias("used"))


@query("""WITH RECURSIVE u AS (SELECT user_id AS key, event_id AS seq, CAST(value AS INT) % 4 AS expected FROM events),
    r AS (SELECT key, 0::BIGINT AS revision, -1::BIGINT AS seq FROM (SELECT DISTINCT key FROM u)
      UNION ALL SELECT key, revision + 1, next FROM (SELECT r.key, r.revision, min(u.seq) AS next FROM r JOIN u ON u.key = r.key AND u.seq > r.seq AND u.expected = r.revision GROUP BY r.key, r.revision))
    SELECT key, max(revision) AS revision FROM r GROUP BY key""".replace("CAST(value AS INT)", "CAST(trunc(value) AS INT)"))
def revision_cas_fold(spark, d):
    u = b.table(spark, d, "events").selectExpr("user_id AS key", "event_id AS seq", "CAST(value AS INT) % 4 AS expected", "value")
    return store.revisions(u).select("key", "revision")


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey > 250 ORDER BY p_partkey LIMIT 51")
def library_keyset_page(spark, d):
    return search.page(b.table(spark, d, "part").selectExpr("p_partkey AS id", "p_name AS name"), 50, (250,), order=("id",))


# Scans and sets.


@query(f"WITH {b.POSITIONS} SELECT id FROM positions WHERE white = {_W} UNION ALL SELECT id FROM positions WHERE black = {_B}")
def union_all_scans(spark, d):
    p = b.positions(spark, d)
    return p.where(f"white = {_W}").select("id").unionAll(p.where(f"black = {_B}").select("id"))


@query(f"WITH {b.POSITIONS} SELECT white, black FROM positions WHERE id < 500 UNION SELECT white, black FROM positions WHERE id > 400")
def distinct_union(spark, d):
    p = b.positions(spark, d).select("id", "white", "black")
    return p.where("id < 500").unionAll(p.where("id > 400")).select("white", "black").distinct()


# More queries register themselves.
from . import games, lists, placed, searches, trees, writes  # noqa: E402, F401
