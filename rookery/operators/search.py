"""Searches over the star of positions, occurrences, games and records.

positions(id, ...), occurrences(id, game_id, ply, position_id, move) and
records(id, game_id, ...). Predicates are Columns; sets of keys are DataFrames
that Spark joins, so a list of structures never becomes a wide OR. Flags from
such sets are never null, which keeps NOT two-valued.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boards, pawns


def every(*terms: Column) -> Column:
    """True for no terms."""
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def some(*terms: Column) -> Column:
    """False for no terms."""
    return reduce(lambda a, b: a | b, terms, F.lit(False))


def in_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is in keys."""
    return df.join(keys.select(*on), on, "left_semi")


def flagged(df: DataFrame, keys: DataFrame, on: list[str], flag: str) -> DataFrame:
    """Adds a boolean, for predicates in which membership stands under OR or NOT."""
    marks = keys.select(*on).distinct().withColumn(flag, F.lit(True))
    return df.join(marks, on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def with_all_atoms(digests: DataFrame, atoms: list[str], dictionary: DataFrame) -> DataFrame:
    """position_ids of digests(position_id, atom_ids) that hold every atom; an unknown atom matches nothing, no atoms all."""
    if not atoms:
        return digests.select("position_id")
    wanted = dictionary.where(F.col("atom").isin(*atoms)).agg(F.array_sort(F.collect_set("id")).alias("wanted"))
    return digests.join(F.broadcast(wanted), F.lit(True)).where((F.size("wanted") == len(set(atoms))) & (F.size(F.array_except("wanted", "atom_ids")) == 0)).select("position_id")


def by_postings(postings: DataFrame, atom_ids: list[int]) -> DataFrame:
    """The same over postings(atom_id, position_id): reads only the lists of the atoms asked for."""
    wanted = sorted(set(atom_ids))
    return postings.where(F.col("atom_id").isin(*wanted)).groupBy("position_id").agg(F.count_distinct("atom_id").alias("n")).where(F.col("n") == len(wanted)).select("position_id")


def matches(positions: DataFrame, occurrences: DataFrame, records: DataFrame) -> DataFrame:
    """position_id, occurrence_id, game_id, ply, record_id and the records' other columns, one row for each."""
    p = positions.select(F.col("id").alias("position_id"))
    o = occurrences.select(F.col("id").alias("occurrence_id"), "game_id", "ply", "position_id")
    r = records.withColumnRenamed("id", "record_id")
    return p.join(o, "position_id").join(r, "game_id")


ORDER = ("position_id", "occurrence_id", "record_id")


def marks(found: DataFrame) -> dict[str, int]:
    """High-water marks of a search: later rows stay out of its next pages."""
    top = found.agg(*[F.max(c).alias(c) for c in ORDER]).first()
    return top.asDict()


def asked(limit: int | None, after: tuple | None = None, keys: int = len(ORDER), sort: str = "insertion", positions_asked: bool = True) -> None:
    """Refuses a page that can't be given: missing_limit, invalid_limit, invalid_cursor (not as many values as the order has),
    invalid_sort, or unsupported_sort (by date, but positions are asked for)."""
    if limit is None:
        raise ValueError("missing_limit")
    if not isinstance(limit, int) or isinstance(limit, bool) or limit <= 0:
        raise ValueError("invalid_limit")
    if after is not None and (not isinstance(after, tuple) or len(after) != keys):
        raise ValueError("invalid_cursor")
    if sort not in ("insertion", "date_desc"):
        raise ValueError("invalid_sort")
    if sort == "date_desc" and positions_asked:
        raise ValueError("unsupported_sort")


def page(found: DataFrame, limit: int, after: tuple | None = None, high: dict[str, int] | None = None, order: tuple[str, ...] = ORDER) -> DataFrame:
    """The first limit + 1 rows in order, the last of which only tells that there are more. after: the last key of the
    page before; high: marks of the first page. Errors as in asked()."""
    asked(limit, after, len(order))
    if high:
        found = found.where(every(*[F.col(c) <= v for c, v in high.items()]))
    if after:
        found = found.where(F.struct(*order) > F.struct(*[F.lit(v).cast(found.schema[c].dataType).alias(c) for c, v in zip(order, after, strict=True)]))
    return found.orderBy(*order).limit(limit + 1)


def symmetry_page(positions: DataFrame, asked_for: DataFrame, limit: int, after: int | None = None) -> DataFrame:
    """A page, as page() gives it by id, of positions(id, white, black, ...) whose structure is a symmetry of the one asked for. Each
    of the (at most four) different forms has a scan of its own that ends after limit + 1 rows; their union is ordered and cut
    once more, so that no more than that many rows of each form are moved."""
    asked(limit, None if after is None else (after,), 1)
    forms = structure_keys(asked_for.limit(1), "structure_symmetries").orderBy("white", "black").collect()  # of one position
    held = positions if after is None else positions.where(F.col("id") > after)
    branches = [held.where((F.col("white") == k["white"]) & (F.col("black") == k["black"])).orderBy("id").limit(limit + 1) for k in forms]
    return reduce(DataFrame.unionAll, branches).orderBy("id").limit(limit + 1) if branches else positions.limit(0)


def first_occurrences(occurrences: DataFrame) -> DataFrame:
    """game_id and its occurrence of least ply, by partial aggregation."""
    first = F.min_by(F.struct(F.col("id").alias("occurrence_id"), "ply", "position_id"), F.struct("ply", "id"))
    return occurrences.groupBy("game_id").agg(first.alias("f")).select("game_id", "f.*")


def date_page(records: DataFrame, occurrences: DataFrame, limit: int, after: tuple[str, int] | None = None, high: int | None = None) -> DataFrame:
    """Records by date, newest first and undated last, each with the first occurrence of its game if it has one."""
    asked(limit, after, 2, "date_desc", positions_asked=False)
    keyed = records.withColumn("date_key", F.coalesce("date", F.lit("")))
    if high is not None:
        keyed = keyed.where(F.col("id") <= high)
    if after:
        keyed = keyed.where((F.col("date_key") < after[0]) | ((F.col("date_key") == after[0]) & (F.col("id") < after[1])))
    top = keyed.orderBy(F.desc("date_key"), F.desc("id")).limit(limit + 1)
    # only the page's games are aggregated
    mine = occurrences.join(F.broadcast(top.select("game_id").distinct()), "game_id", "left_semi")
    return top.join(first_occurrences(mine), "game_id", "left").orderBy(F.desc("date_key"), F.desc("id"))


def move_line(occurrences: DataFrame, line: DataFrame) -> DataFrame:
    """Occurrences at the last ply of line(ply, position_id) whose games pass through all its positions, in one pass
    over the occurrences. A line has a row for each ply from 0. Spark broadcasts it where it is as short as lines are."""
    held = occurrences.join(line, ["ply", "position_id"])
    length = line.agg(F.count("*").alias("n"), F.max("ply").alias("last"))
    through = held.groupBy("game_id").agg(F.count_distinct("ply").alias("passed")).join(F.broadcast(length), F.lit(True)).where("passed = n").select("game_id", "last")
    return occurrences.join(through, "game_id").where("ply = last").drop("last")


def similar(digests: DataFrame, keys: DataFrame, query_atoms: list[int], white: list[int], black: list[int]) -> DataFrame:
    """Positions of digests(position_id, white, black, atom_ids) in the key set that hold one of each side's material
    signatures, with shared: how many of the query's atoms they hold. query_total is their number."""
    ids = lambda xs: F.array(*[F.lit(x) for x in xs])
    near = in_keys(digests, keys, ["white", "black"])
    held = near.where(F.arrays_overlap("atom_ids", ids(white)) & F.arrays_overlap("atom_ids", ids(black)))
    return held.select("position_id", F.size(F.array_intersect("atom_ids", ids(query_atoms))).alias("shared"), F.lit(len(set(query_atoms))).alias("query_total"))


def signature(side: str, queen: Column, rook: Column, bishop: Column, knight: Column, pawn: Column) -> Column:
    """A side's material as one word."""
    return F.concat(F.lit(f"material:{side}:Q"), queen, F.lit("R"), rook, F.lit("B"), bishop, F.lit("N"), knight, F.lit("P"), pawn)


def signature_variants(side: str, queen: Column, rook: Column, bishop: Column, knight: Column, pawn: Column, substitution: str | None = None) -> Column:
    """The signature, and with a substitution those after it: two_rooks_queen (a queen for two rooks or back), or bishop_knight
    (one minor piece for the other). Each once; what isn't there isn't traded."""
    form = lambda q=0, r=0, b=0, n=0: signature(side, queen + q, rook + r, bishop + b, knight + n, pawn)
    trades = {
        None: [],
        "two_rooks_queen": [F.when(queen >= 1, form(q=-1, r=2)), F.when(rook >= 2, form(q=1, r=-2))],
        "bishop_knight": [F.when(bishop >= 1, form(b=-1, n=1)), F.when(knight >= 1, form(b=1, n=-1))],
    }
    if substitution not in trades:
        raise ValueError(f"unknown substitution: {substitution}")
    return F.array_distinct(F.array_compact(F.array(form(), *trades[substitution])))


def similar_page(found: DataFrame, limit: int, after: tuple | None = None) -> DataFrame:
    """Most shared atoms first, then by ids. after: (shared, position_id, occurrence_id, record_id); what is equal in
    shared goes on with larger ids."""
    if after:
        rest = F.struct(*ORDER) > F.struct(*[F.lit(v).cast(found.schema[c].dataType).alias(c) for c, v in zip(ORDER, after[1:], strict=True)])
        found = found.where((F.col("shared") < after[0]) | ((F.col("shared") == after[0]) & rest))
    return found.orderBy(F.desc("shared"), *ORDER).limit(limit + 1)


def count_records(found: DataFrame) -> DataFrame:
    return found.agg(F.count_distinct("record_id").alias("records"))


def one_row_per_record(found: DataFrame) -> DataFrame:
    """The first occurrence of each record, by ids."""
    w = Window.partitionBy("record_id").orderBy("position_id", "occurrence_id")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


# Predicates over a record's metadata, a map of strings.


def contains(metadata: Column, wanted: dict[str, str]) -> Column:
    return every(*[F.coalesce(F.try_element_at(metadata, F.lit(k)) == v, F.lit(False)) for k, v in wanted.items()])


def value_contains(metadata: Column, key: str, part: str) -> Column:
    """Without regard to case; % _ and backslash stand for themselves."""
    return F.coalesce(F.contains(F.lower(F.try_element_at(metadata, F.lit(key))), F.lower(F.lit(part))), F.lit(False))


def value_between(metadata: Column, key: str, low: str | None, high: str | None) -> Column:
    """As text; an open bound is None, both open is true even without the key."""
    if low is None and high is None:
        return F.lit(True)
    value = F.try_element_at(metadata, F.lit(key))
    bounds = [value >= low] if low is not None else []
    bounds += [value <= high] if high is not None else []
    return F.coalesce(every(*bounds), F.lit(False))


def int_between(metadata: Column, key: str, low: int | None, high: int | None) -> Column:
    """Values of digits only, within 32 bits; others don't match."""
    if low is None and high is None:
        return F.lit(True)
    text = F.try_element_at(metadata, F.lit(key))
    value = F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))
    bounds = [value >= low] if low is not None else []
    bounds += [value <= high] if high is not None else []
    return F.coalesce(every(*bounds), F.lit(False))


def player(metadata: Column, name: str, color: str = "either") -> Column:
    seats = {"white": ["white"], "black": ["black"]}.get(color, ["white", "black"])
    return some(*[value_contains(metadata, s, name) for s in seats])


def filters(metadata: Column, wanted: dict) -> Column:
    """What a search form asks of a record: player and color, result, eco, opening, event (parts of text), min_rating and
    max_rating (of both players), since and until (dates as yyyy.mm.dd). Keys that are absent or None ask nothing."""
    terms = []
    asked = {k: v for k, v in wanted.items() if v not in (None, "")}
    unknown = set(asked) - {"player", "color", "result", "eco", "opening", "event", "min_rating", "max_rating", "since", "until"}
    if unknown:
        raise ValueError(f"unknown filters: {', '.join(sorted(unknown))}")
    if "player" in asked:
        terms.append(player(metadata, asked["player"], asked.get("color", "either")))
    if "result" in asked:
        terms.append(contains(metadata, {"result": asked["result"]}))
    terms += [value_contains(metadata, k, asked[k]) for k in ("eco", "opening", "event") if k in asked]
    if {"min_rating", "max_rating"} & set(asked):
        terms += [int_between(metadata, k, asked.get("min_rating"), asked.get("max_rating")) for k in ("white_elo", "black_elo")]
    if {"since", "until"} & set(asked):
        terms.append(value_between(metadata, "date", asked.get("since"), asked.get("until")))
    return every(*terms)


def contains_json(json: Column, wanted: dict | list | str | int | float | bool | None) -> Column:
    """A JSON text that holds what is wanted at any depth: all keys of an object, each element of a list in some element
    (order and repeats don't matter), equal scalars. A text that is no JSON holds nothing."""
    return F.coalesce(_held(F.try_parse_json(json), wanted), F.lit(False))


def _held(value: Column, wanted) -> Column:
    kind = F.schema_of_variant(value)
    if isinstance(wanted, dict):
        if any("'" in k and '"' in k for k in wanted):
            raise ValueError("a key with both kinds of quotes")
        path = lambda k: f'$["{k}"]' if "'" in k else f"$['{k}']"
        under = lambda k: F.try_variant_get(value, path(k), "variant")
        return every(F.startswith(kind, F.lit("OBJECT")), *[F.coalesce(_held(under(k), w), F.lit(False)) for k, w in wanted.items()])
    if isinstance(wanted, list):
        items = F.try_variant_get(value, "$", "array<variant>")
        among = lambda w: F.coalesce(F.exists(items, lambda e: F.coalesce(_held(e, w), F.lit(False))), F.lit(False))
        return every(F.startswith(kind, F.lit("ARRAY")), *[among(w) for w in wanted])
    if wanted is None:
        return F.is_variant_null(value)
    if isinstance(wanted, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == wanted)
    if isinstance(wanted, str):
        return (kind == "STRING") & (F.try_variant_get(value, "$", "string") == wanted)
    return ~kind.isin("STRING", "BOOLEAN", "VOID") & (F.try_variant_get(value, "$", "double") == float(wanted))


# Searches by a position, in the modes of a search form.

#: Modes that look for the pawn structure of the position asked for.
STRUCTURE_MODES = ("structure", "structure_symmetries", "structure_edit1", "structure_push", "structure_capture", "structure_missing", "structure_push_symmetries", "structure_color_reversed", "structure_reflected")
#: Modes that look for the position itself; "similar" ranks, see similar().
RECORD_MODES = ("exact", "exact_color_swapped", "exact_mirrored")


def structure_keys(asked_for: DataFrame, mode: str) -> DataFrame:
    """Distinct (white, black) that a mode looks for, from those of the positions asked for."""
    keys = asked_for.select("white", "black").distinct()
    turned = lambda form: keys.select(F.expr(form[0]).alias("white"), F.expr(form[1]).alias("black"))
    every_form = lambda df: pawns.symmetries(df).select(F.explode("symmetry").alias("s")).select("s.white", "s.black").distinct()
    found = {
        "structure": lambda: keys,
        "structure_symmetries": lambda: every_form(keys),
        "structure_edit1": lambda: pawns.neighbourhood(keys, 1).select("white", "black"),
        "structure_push": lambda: keys.unionByName(pawns.neighbours(keys, pushes=True)).distinct(),
        "structure_capture": lambda: keys.unionByName(pawns.neighbours(keys, captures=True)).distinct(),
        "structure_missing": lambda: keys.unionByName(pawns.neighbours(keys, removals=True)).distinct(),
        "structure_push_symmetries": lambda: every_form(keys.unionByName(pawns.neighbours(keys, pushes=True)).distinct()),
        "structure_color_reversed": lambda: turned(pawns.color_reversed("white", "black")),
        "structure_reflected": lambda: turned(pawns.file_reflected("white", "black")),
    }
    if mode not in found:
        raise ValueError(f"unsupported_property: {mode}")
    return found[mode]()


def by_mode(positions: DataFrame, asked_for: DataFrame, mode: str = "exact", having: DataFrame | None = None) -> DataFrame:
    """positions that a mode finds, each once. asked_for: positions with masks, side, castling and ep; positions: of the same
    columns and a record (exact modes) or white and black (structure modes). having: position ids (column position_id) to
    which the result is narrowed, as with_all_atoms() gives them."""
    if mode in RECORD_MODES:
        forms = [asked_for] + ([boards.color_swapped(asked_for)] if mode == "exact_color_swapped" else []) + ([boards.file_reflected(asked_for)] if mode == "exact_mirrored" else [])
        keys = reduce(DataFrame.unionByName, [f.select(boards.record().alias("record")) for f in forms]).distinct()
        found = in_keys(positions, keys, ["record"])
    else:
        found = in_keys(positions, structure_keys(asked_for, mode), ["white", "black"])
    return found if having is None else found.join(having.select(F.col("position_id").alias("id")), "id", "left_semi")
