"""Queries over posting lists of atoms and of trigrams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import postings
from . import bindings as b
from .queries import query


def _lists(spark, d):
    return postings.built(b.digests(spark, d), "position_id", "atom_ids")


def _has(*atoms: int) -> str:
    return " AND ".join(f"list_contains(atom_ids, {a})" for a in atoms)


@query(f"WITH {b.DIGESTS} SELECT position_id AS id FROM digests WHERE {_has(1, 5, 9)}")
def postings_all(spark, d):
    return postings.ids(postings.all_of(_lists(spark, d), ["1", "5", "9"]))


@query(f"WITH {b.DIGESTS} SELECT position_id AS id FROM digests WHERE list_has_any(atom_ids, [2, 3, 63])")
def postings_any(spark, d):
    return postings.ids(postings.any_of(_lists(spark, d), ["2", "3", "63", "no such atom"]))


@query(f"WITH {b.DIGESTS} SELECT position_id AS id FROM digests WHERE {_has(4)} AND NOT list_has_any(atom_ids, [6, 7])")
def postings_and_not(spark, d):
    """One atom and neither of two others."""
    lists = _lists(spark, d)
    return postings.ids(postings.both(postings.all_of(lists, ["4"]), postings.none_of(lists, ["6", "7", "no such atom"])))


@query(f"WITH {b.DIGESTS} SELECT 'known' AS asked, count(*) AS n FROM digests WHERE {_has(8)} UNION ALL SELECT 'unknown', 0 UNION ALL SELECT 'nothing', count(*) FROM digests")
def postings_counts(spark, d):
    """How many hold an atom, an atom and an unknown one, and all of none, without an id made."""
    lists = _lists(spark, d)
    count = lambda name, atoms: postings.all_of(lists, atoms).agg(F.lit(name).alias("asked"), F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))
    return count("known", ["8"]).unionByName(count("unknown", ["8", "no such atom"])).unionByName(count("nothing", []))


_PARTS = {"white": ("OMER_12", "_1", "r_99"), "black": ("k%3", "%", "CLERK%4"), "event": ("urg", "1-", "not spec")}


def _contains_sql() -> str:
    asked = " UNION ALL ".join(f"SELECT id, '{f}' AS field, '{p}' AS part FROM records WHERE contains(lower({f}), lower('{p}'))" for f, parts in _PARTS.items() for p in parts)
    return f"WITH {b.RECORDS} SELECT field, part, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM ({asked}) GROUP BY field, part"


@query(_contains_sql())
def trigram_contains(spark, d):
    """Parts of names and events in records, with signs that other matches give a meaning, and shorter than a trigram."""
    records = b.records(spark, d)
    lists = postings.built(records.select("id", postings.field_pieces(F.col("metadata"), list(_PARTS)).alias("atoms")), "id", "atoms")
    found = postings.containing_each(records, "id", lists, [(field, part) for field, parts in _PARTS.items() for part in parts])
    return found.groupBy("field", "part").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
