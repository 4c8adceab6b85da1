"""Searches by a position in all modes, game searches over them, and what a form, a cache or a sweep asks for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boards, pawns
from ..operators import analysis, search, store
from . import bindings as b
from .queries import KEYS, query

_SQUARES = "sq AS (SELECT unnest(range(8, 56)) AS s), mv AS (SELECT a.s, c.s AS t FROM sq a, sq c)"
_STEPS = {"rank": "abs(t - s) = 8", "capture": "abs(t // 8 - s // 8) = 1 AND abs(t % 8 - s % 8) = 1", "push": "t - s = 8 * {up}"}


def _stepped(kinds: tuple[str, ...], of: str = "asked", keep: str = "") -> str:
    """SQL of (white, black) by steps of these kinds (or "removal") from a table, and the table's own."""
    parts = [f"SELECT {keep}white, black FROM {of}"]
    for own, up in (("white", 1), ("black", -1)):
        pair = lambda new, own=own: f"{new} AS white, black" if own == "white" else f"white, {new} AS black"
        for kind in kinds:
            if kind == "removal":
                parts.append(f"SELECT {keep}{pair(f'({own} & ~(1::BIGINT << s))')} FROM {of}, sq WHERE (({own} >> s) & 1) = 1")
            else:
                parts.append(f"SELECT {keep}{pair(f'(({own} & ~(1::BIGINT << s)) | (1::BIGINT << t))')} FROM {of}, mv WHERE (({own} >> s) & 1) = 1 AND (((white | black) >> t) & 1) = 0 AND {_STEPS[kind].format(up=up)}")
    return " UNION ".join(parts)


def _turned(of: str) -> str:
    """SQL of a table's four forms."""
    reversed_, reflected = f"{b.flip(56, 'black')} AS white, {b.flip(56, 'white')} AS black", f"{b.flip(7, 'white')} AS white, {b.flip(7, 'black')} AS black"
    return f"SELECT white, black FROM {of} UNION SELECT {reversed_} FROM {of} UNION SELECT {reflected} FROM {of} UNION SELECT {reflected} FROM (SELECT {reversed_} FROM {of})"


_KEY_SQL = {
    "structure": "SELECT white, black FROM asked",
    "structure_symmetries": _turned("asked"),
    "structure_edit1": _stepped(("rank", "capture", "removal")),
    "structure_push": _stepped(("push",)),
    "structure_capture": _stepped(("capture",)),
    "structure_missing": _stepped(("removal",)),
    "structure_push_symmetries": _turned(f"({_stepped(('push',))})"),
    "structure_color_reversed": f"SELECT {b.flip(56, 'black')} AS white, {b.flip(56, 'white')} AS black FROM asked",
    "structure_reflected": f"SELECT {b.flip(7, 'white')} AS white, {b.flip(7, 'black')} AS black FROM asked",
}
#: Kings stand on the d file under variant 2 only, and Black is to move in swapped forms.
_SAME = "(f.white = a.white AND f.black = a.black AND v <> 2 AND substr(record, 129, 2) = '00')"
_RECORD_SQL = {
    "exact": _SAME,
    "exact_color_swapped": f"{_SAME} OR (f.white = {b.flip(56, 'a.black')} AND f.black = {b.flip(56, 'a.white')} AND substr(record, 129, 2) = '01')",
    "exact_mirrored": f"{_SAME} OR (f.white = {b.flip(7, 'a.white')} AND f.black = {b.flip(7, 'a.black')} AND v = 2)",
}


def _mode_sql(mode: str) -> str:
    """CTEs up to found(id, white, black, record)."""
    if mode in _RECORD_SQL:
        return f"WITH {b.WHOLE}, {b.ASKED}, found AS (SELECT id, f.white, f.black, record FROM whole f, asked a WHERE {_RECORD_SQL[mode]})"
    return f"WITH {b.WHOLE}, {b.ASKED}, {_SQUARES}, keys AS ({_KEY_SQL[mode]}), found AS (SELECT id, white, black, record FROM whole WHERE (white, black) IN (SELECT white, black FROM keys))"


def _by_mode(spark, d, mode, having=None):
    return search.by_mode(b.whole_positions(spark, d), b.asked_position(spark), mode, having)


def _mode(mode: str) -> None:
    def run(spark, d):
        return _by_mode(spark, d, mode).select("id", "white", "black", F.hex("record").alias("record"))

    run.__name__ = f"search_{mode}"
    query(f"{_mode_sql(mode)} SELECT id, white, black, record FROM found")(run)


for _name in (*search.RECORD_MODES, *search.STRUCTURE_MODES):
    _mode(_name)


@query(f"{_mode_sql('structure_symmetries')}, {b.DIGESTS} SELECT id FROM found WHERE id IN (SELECT position_id FROM digests WHERE list_has_all(atom_ids, [59, 60]))")
def search_mode_and_atoms(spark, d):
    dictionary = spark.range(64).selectExpr("CAST(id AS INT) AS id", "concat('atom:', id) AS atom")
    return _by_mode(spark, d, "structure_symmetries", search.with_all_atoms(b.digests(spark, d), ["atom:59", "atom:60"], dictionary)).select("id")


_GAMES = f"{b.OCCURRENCES}, {b.RECORDS}, g AS (SELECT f.id AS position_id, o.id AS occurrence_id, o.game_id, o.ply, r.id AS record_id, r.result FROM found f JOIN occurrences o ON o.position_id = f.id JOIN records r ON r.game_id = o.game_id)"
_COLUMNS = ", ".join(KEYS)
_PAGE = "ORDER BY position_id, occurrence_id, record_id LIMIT 26"


def _games(spark, d, mode):
    return search.matches(_by_mode(spark, d, mode), b.occurrences(spark, d), b.records(spark, d))


@query(f"{_mode_sql('structure_edit1')}, {_GAMES} SELECT {_COLUMNS} FROM g WHERE result <> '0-1' {_PAGE}")
def game_edit_page_first(spark, d):
    return search.page(_games(spark, d, "structure_edit1").where("result <> '0-1'"), 25).select(*KEYS)


@query(f"{_mode_sql('structure_edit1')}, {_GAMES} SELECT {_COLUMNS} FROM g WHERE (position_id, occurrence_id, record_id) > (300, 500000, 500) AND position_id <= 1900 {_PAGE}")
def game_edit_page_next(spark, d):
    return search.page(_games(spark, d, "structure_edit1"), 25, (300, 500_000, 500), {"position_id": 1_900}).select(*KEYS)


@query(f"{_mode_sql('structure_symmetries')}, {_GAMES} SELECT {_COLUMNS} FROM g {_PAGE}")
def game_symmetry_page_first(spark, d):
    return search.page(_games(spark, d, "structure_symmetries"), 25).select(*KEYS)


@query(f"{_mode_sql('structure_symmetries')}, {_GAMES} SELECT {_COLUMNS} FROM g WHERE (position_id, occurrence_id, record_id) > (300, 500000, 500) {_PAGE}")
def game_symmetry_page_next(spark, d):
    return search.page(_games(spark, d, "structure_symmetries"), 25, (300, 500_000, 500)).select(*KEYS)


@query(f"{_mode_sql('structure_edit1')} SELECT id FROM found WHERE id > 60 AND id <= (SELECT max(id) FROM whole) AND bit_count(white) < 14 ORDER BY id LIMIT 11")
def position_edit_page(spark, d):
    """The scan of an edit neighbourhood with a residual filter, paged up to the largest id."""
    whole = b.whole_positions(spark, d)
    top = whole.agg(F.max("id").alias("top"))
    found = search.by_mode(whole, b.asked_position(spark), "structure_edit1").where(F.bit_count("white") < 14)
    return search.page(found.join(F.broadcast(top), F.col("id") <= F.col("top")), 10, (60,), order=("id",)).select("id")


@query(f"{_mode_sql('structure_symmetries')} SELECT id FROM found WHERE id > 60 ORDER BY id LIMIT 11")
def position_symmetry_page(spark, d):
    return search.page(_by_mode(spark, d, "structure_symmetries"), 10, (60,), order=("id",)).select("id")


@query(f"{_mode_sql('structure_edit1')}, {_GAMES}, {b.DIGESTS}, s AS (SELECT g.*, len(list_intersect(atom_ids, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9])) AS shared FROM g JOIN digests d ON d.position_id = g.position_id WHERE list_has_any(atom_ids, [10, 11]) AND list_has_any(atom_ids, [12, 13, 14])) SELECT {_COLUMNS}, shared FROM s ORDER BY shared DESC, position_id, occurrence_id, record_id LIMIT 25")
def search_similar(spark, d):
    """Ranked by shared atoms among positions whose structure is an edit away and that hold one of each side's signatures."""
    digests = b.digests(spark, d).join(b.whole_positions(spark, d).select(F.col("id").alias("position_id"), "white", "black"), "position_id")
    near = search.similar(digests, search.structure_keys(b.asked_position(spark), "structure_edit1"), list(range(10)), [10, 11], [12, 13, 14])
    games = search.matches(near.select(F.col("position_id").alias("id")), b.occurrences(spark, d), b.records(spark, d)).join(near, "position_id")
    return search.similar_page(games, 24).select(*KEYS, "shared")


_COUNTS = "(p_size % 3) AS q, (p_size % 4) AS r, (p_partkey % 3) AS bi, (p_partkey % 2) AS n, (p_size % 9) AS p"
_SIGN = "'material:white:Q' || ({q}) || 'R' || ({r}) || 'B' || ({b}) || 'N' || ({n}) || 'P' || p"
_sign = lambda q="q", r="r", b="bi", n="n": _SIGN.format(q=q, r=r, b=b, n=n)


@query(f"""WITH c AS (SELECT p_partkey AS id, {_COUNTS} FROM part), v AS (SELECT id, 'two_rooks_queen' AS kind, {_sign()} AS signature FROM c UNION SELECT id, 'bishop_knight', {_sign()} FROM c
    UNION SELECT id, 'two_rooks_queen', {_sign(q='q - 1', r='r + 2')} FROM c WHERE q >= 1 UNION SELECT id, 'two_rooks_queen', {_sign(q='q + 1', r='r - 2')} FROM c WHERE r >= 2
    UNION SELECT id, 'bishop_knight', {_sign(b='bi - 1', n='n + 1')} FROM c WHERE bi >= 1 UNION SELECT id, 'bishop_knight', {_sign(b='bi + 1', n='n - 1')} FROM c WHERE n >= 1) SELECT id, kind, signature FROM v""")
def substitution_variants(spark, d):
    counts = b.table(spark, d, "part").selectExpr("p_partkey AS id", *_COUNTS.split(", "))
    columns = [F.col(c) for c in ("q", "r", "bi", "n", "p")]
    found = [counts.select("id", F.lit(kind).alias("kind"), F.explode(search.signature_variants("white", *columns, kind)).alias("signature")) for kind in ("two_rooks_queen", "bishop_knight")]
    return found[0].unionByName(found[1])


@query("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) = 69")
def metadata_nested(spark, d):
    """Containment below the first level: {"game": {"tags": [{"k": 69}]}}."""
    nested = F.concat(F.lit('{"game": {"tags": ["x", '), F.col("props"), F.lit('], "round": 2}}'))
    return b.table(spark, d, "events").where(search.contains_json(nested, {"game": {"tags": [{"k": 69}], "round": 2}})).select("event_id")


@query(f"WITH {b.RECORDS} SELECT id FROM records WHERE result = '1-0' AND contains(lower(event), 'low') AND (contains(lower(white), '_1') OR contains(lower(black), '_1')) AND date >= '1995' AND date <= '1997.12.31'")
def search_form(spark, d):
    held = b.records(spark, d).withColumn("metadata", F.map_concat("metadata", F.create_map(F.lit("result"), F.col("result"), F.lit("date"), F.coalesce("date", F.lit("")))))
    return held.where(search.filters(F.col("metadata"), {"result": "1-0", "event": "low", "player": "_1", "since": "1995", "until": "1997.12.31"})).select("id")


# Positions and structures.


@query(f"""WITH {b.WHOLE}, h AS (SELECT id, record, list_aggregate(list_transform(range(67), i -> CASE WHEN i < 64 THEN CASE substr(record, 2 * i + 1, 2) WHEN '00' THEN '00' WHEN '01' THEN '07' WHEN '07' THEN '01' WHEN '06' THEN '0C' WHEN '0C' THEN '06' WHEN '04' THEN '0A' WHEN '0A' THEN '04' END
    WHEN i = 64 THEN CASE substr(record, 129, 2) WHEN '00' THEN '01' ELSE '00' END ELSE substr(record, 2 * i + 1, 2) END), 'string_agg', '') AS swapped FROM whole)
    SELECT id, record AS exact_key, least(record, swapped) AS equivalent_key, sha256(unhex(record)) AS exact_hash, sha256(unhex(least(record, swapped))) AS equivalent_hash FROM h""")
def position_keys(spark, d):
    held = boards.keys(b.whole_positions(spark, d).drop("record", "white", "black"))
    return held.select("id", F.hex("exact_key").alias("exact_key"), F.hex("equivalent_key").alias("equivalent_key"), F.lower(F.hex("exact_hash")).alias("exact_hash"), F.lower(F.hex("equivalent_hash")).alias("equivalent_hash"))


_SHIFT = "CAST(8 + id % 48 AS INT) AS source, CAST(8 + (id * 7) % 50 AS INT) AS target"


@query(f"""WITH {b.POSITIONS}, x AS (SELECT *, {_SHIFT} FROM positions), e AS (SELECT *, CASE WHEN target > 55 THEN 'invalid_square' WHEN source = target THEN 'same_square' WHEN ((white >> source) & 1) = 0 THEN 'missing_pawn' WHEN (((white | black) >> target) & 1) = 1 THEN 'target_has_pawn' END AS shift_error FROM x)
    SELECT id, shift_error, CASE WHEN shift_error IS NULL THEN (white & ~(1::BIGINT << source)) | (1::BIGINT << target) END AS shifted_white, CASE WHEN shift_error IS NULL THEN black END AS shifted_black FROM e""")
def pawn_shift(spark, d):
    held = b.positions(spark, d).selectExpr("id", "white", "black", *_SHIFT.split(", "))
    return pawns.shifted(held, "white", "source", "target").select("id", "shift_error", "shifted_white", "shifted_black")


@query(f"""WITH {b.WHOLE}, {b.ASKED}, {_SQUARES}, k1 AS ({_stepped(('rank', 'capture', 'removal'))}), k2 AS ({_stepped(('rank', 'capture', 'removal'), 'k1')})
    SELECT id, CASE WHEN (white, black) IN (SELECT white, black FROM asked) THEN 0 WHEN (white, black) IN (SELECT white, black FROM k1) THEN 1 WHEN (white, black) IN (SELECT white, black FROM k2) THEN 2 END AS distance FROM whole""")
def pawn_bounded_distance(spark, d):
    target = b.whole_positions(spark, d).select("id", F.col("white").alias("white2"), F.col("black").alias("black2"))
    pairs = target.join(F.broadcast(b.asked_position(spark).select("white", "black")), F.lit(True))  # one row
    return pawns.bounded(pairs, ["id"], 2)


@query(f"WITH {b.OCCURRENCES} SELECT id, 1 + game_id % 40 + CAST(floor((ply + CASE WHEN game_id % 2 = 0 THEN 0 ELSE 1 END) / 2) AS BIGINT) AS number, CASE WHEN (ply + CASE WHEN game_id % 2 = 0 THEN 0 ELSE 1 END) % 2 = 0 THEN 'w' ELSE 'b' END AS side FROM occurrences")
def move_numbers(spark, d):
    number, side = analysis.move_number(F.col("game_id") % 40 + 1, F.when(F.col("game_id") % 2 == 0, "w").otherwise("b"), F.col("ply"))
    return b.occurrences(spark, d).select("id", number.alias("number"), side.alias("side"))


# Stores.


@query(f"WITH {b.OCCURRENCES} SELECT o.id, p_type AS result, p_partkey IS NOT NULL AS cached FROM occurrences o LEFT JOIN part ON p_partkey = position_id AND p_size <= 25")
def tablebase_cache(spark, d):
    """Cached results by position: hits and misses; of results put twice the last stays."""
    part = b.table(spark, d, "part").where("p_size <= 25")
    puts = part.selectExpr("p_partkey AS position_id", "1 AS seq", "'old' AS result").unionByName(part.selectExpr("p_partkey AS position_id", "2 AS seq", "p_type AS result"))
    cache = store.upsert(puts, ["position_id"], ["seq"]).select("position_id", "result")
    return store.cached(b.occurrences(spark, d), cache, ["position_id"]).select("id", "result", "cached")


@query("SELECT event_id AS token FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts, event_id LIMIT 1000")
def expiry_sweep(spark, d):
    rows = b.table(spark, d, "events").select(F.col("event_id").alias("token"), F.col("ts").alias("expires_at"))
    return store.expired(rows, "token", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))


@query("SELECT DISTINCT o_custkey AS room, o_orderkey % 50 AS analysis FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)")
def associate_once(spark, d):
    pairs = b.table(spark, d, "orders").selectExpr("o_custkey AS room", "o_orderkey % 50 AS analysis", "o_orderkey")
    rooms = b.table(spark, d, "customer").selectExpr("c_custkey AS room")
    held = pairs.where("o_orderkey < 3000").select("room", "analysis").distinct().join(rooms, "room", "left_semi")
    return store.associated(held, rooms, pairs, "room", "analysis")


@query("""SELECT event_id AS seq, CASE WHEN value < 5 THEN 'invalid' WHEN row_number() OVER (PARTITION BY user_id, event_type, value < 5 ORDER BY event_id) > 1 THEN 'duplicate_in_batch' ELSE 'already_exists' END AS error
    FROM events QUALIFY value < 5 OR row_number() OVER (PARTITION BY user_id, event_type, value < 5 ORDER BY event_id) > 1 OR user_id <= 20""")
def insert_errors(spark, d):
    """Records that an insert refuses, each with its number and why."""
    rows = b.table(spark, d, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("record_id"), F.col("event_id").alias("seq"), "value", "user_id")
    there = rows.where("user_id <= 20").select("record_id").distinct()
    return store.inserted(there, rows, "record_id", ["seq"], F.when(F.col("value") < 5, "invalid"))[1].select("seq", "error")


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, lower(hex(encode(substr(text, 1, 4)))) AS head, octet_length(encode(text)) AS bytes FROM documents")
def binary_digests(spark, d):
    text = F.col("text")
    return b.table(spark, d, "documents").select("doc_id", F.md5(text.cast("binary")).alias("md5"), F.sha2(text, 256).alias("sha256"), F.lower(F.hex(F.encode(F.substring(text, 1, 4), "utf-8"))).alias("head"), F.octet_length(text).alias("bytes"))


@query("SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS age, strftime(ts, '%Y.%m.%d') AS tag, CAST(isodow(ts) AS INT) AS weekday FROM events")
def date_parts(spark, d):
    return b.table(spark, d, "events").select(
        "event_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("age"),
        F.date_format("ts", "yyyy.MM.dd").alias("tag"), (F.weekday("ts") + 1).alias("weekday"),
    )
