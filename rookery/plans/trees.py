"""Queries over annotated games: a game for each order, with side lines within side lines, glyphs, comments and clocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.once import spread
from ..operators import variations
from . import bindings as b
from .games import LINES
from .queries import query

#: Side lines at a move of White's and of Black's: none, one move, a reply with an alternative, alternatives within alternatives.
_SIDES = (
    ("", " ({also} h3 $6)", " (h3 h6 (1... a6 $2 {deep [%eval 0.3]} 2. a3) 2. h4)", " (h3! (a3 (b3 b6) a6?! (h6)) h6) (a3?? $14)"),
    ("", " ({also} h6 $6)", " (h6 h3 (a3 $2 {deep [%eval 0.3]} a6) h5)", " (h6! (a6 (b6 b3) a3?! (h3)) h3) (a6?? $14)"),
)
#: Which order has which line, number of moves, place of a side line and kind of it; some have an unclosed one, or one that isn't legal.
_FORM = "o_orderkey % 4 AS line, CAST(o_custkey % 7 + 4 AS INT) AS plies, CAST(o_orderkey % 4 + 1 AS INT) AS spot, CAST(o_custkey % 4 AS INT) AS side, CASE WHEN o_orderkey % 31 = 5 THEN ' (a3' WHEN o_orderkey % 37 = 6 THEN ' (Qh8)' ELSE '' END AS fault"
#: The same in both engines: the main line with the side line after the move that it stands for.
_LINE_LIST = [line.split() for line in LINES]
_HEAD = '[Event "Annotated"]\n[Result "*"]\n\n'


def _text(array: str, element: str, form: str) -> str:
    """The move text. array: of a list of literals; element, form: how the engine takes the n-th and writes a transformation."""
    sides = array.format(", ".join(array.format(", ".join(f"'{s}'" for s in of)) for of in _SIDES))
    lines = array.format(", ".join(array.format(", ".join(f"'{m}'" for m in line)) for line in _LINE_LIST))
    own = element.format(element.format(sides, "(spot + 1) % 2 + 1"), "side + 1")
    return form.format(lines=element.format(lines, "line + 1"), own=own)


_SPARK = _text("array({})", "{}[CAST({} AS INT) - 1]", "concat('{{intro}} ', array_join(transform(slice({lines}, 1, plies), (m, i) -> concat(IF(i % 2 = 0, concat(CAST(i div 2 + 1 AS STRING), '. '), ''), m, IF(i = 2, ' {{[%clk 0:03:00] book}}', ''), IF(i + 1 = spot, {own}, ''))), ' '), fault, ' *')")
_DUCK = _text("[{}]", "{}[{}]", "'{{intro}} ' || array_to_string(list_transform({lines}[1:plies], lambda m, i: (CASE WHEN i % 2 = 1 THEN CAST(i // 2 + 1 AS VARCHAR) || '. ' ELSE '' END) || m || (CASE WHEN i = 3 THEN ' {{[%clk 0:03:00] book}}' ELSE '' END) || (CASE WHEN i = spot THEN {own} ELSE '' END)), ' ') || fault || ' *'")


def annotated(spark: SparkSession, d: str) -> DataFrame:
    """id and pgn."""
    held = b.dealt(spark, d, "orders", "o_orderkey", "o_custkey").selectExpr("o_orderkey AS id", *_FORM.split(", ", 4))
    return held.select("id", F.concat(F.lit(_HEAD), F.expr(_SPARK)).alias("pgn"))


#: One token after another: the node that the next move follows, with the stack of those around open brackets.
_WALK = f"""WITH RECURSIVE form AS (SELECT o_orderkey AS id, {_FORM} FROM orders), texts AS (SELECT id, fault, {_DUCK} AS body FROM form),
    toks AS (SELECT id, regexp_extract_all(body, '\\{{[^}}]*\\}}|[()]|\\$\\d+|[^\\s{{}}()$]+') AS t FROM texts WHERE fault = ''),
    walk AS (
      SELECT id, t, 0 AS i, 0 AS cur, CAST(NULL AS INT) AS par, 0 AS ply, 0 AS n, CAST([] AS STRUCT(c INT, p INT, y INT)[]) AS stack, '' AS kind, '' AS san, CAST(NULL AS INT) AS was FROM toks
      UNION ALL
      SELECT id, t, i + 1,
        CASE k WHEN 'open' THEN par WHEN 'close' THEN stack[-1].c WHEN 'move' THEN n + 1 ELSE cur END,
        CASE k WHEN 'open' THEN NULL WHEN 'close' THEN stack[-1].p WHEN 'move' THEN cur ELSE par END,
        CASE k WHEN 'open' THEN ply - 1 WHEN 'close' THEN stack[-1].y WHEN 'move' THEN ply + 1 ELSE ply END,
        CASE k WHEN 'move' THEN n + 1 ELSE n END,
        CASE k WHEN 'open' THEN list_append(stack, {{'c': cur, 'p': par, 'y': ply}}) WHEN 'close' THEN stack[1:-2] ELSE stack END,
        k, w, cur
      FROM (SELECT *, t[i + 1] AS tok, regexp_replace(t[i + 1], '^\\d+\\.(\\.\\.)?', '') AS w,
          CASE WHEN t[i + 1] = '(' THEN 'open' WHEN t[i + 1] = ')' THEN 'close' WHEN t[i + 1][1] = '{{' THEN 'comment' WHEN t[i + 1][1] = '$' THEN 'glyph' WHEN regexp_replace(t[i + 1], '^\\d+\\.(\\.\\.)?', '') IN ('', '*') THEN 'none' ELSE 'move' END AS k
        FROM walk WHERE i < len(t))),
    moved AS (SELECT id, cur AS node, was AS parent, ply, len(stack) AS depth, regexp_replace(san, '[!?]+$', '') AS move FROM walk WHERE kind = 'move'),
    notes AS (
      SELECT id, i, cur AS node, CASE regexp_extract(san, '[!?]+$') WHEN '!' THEN '1' WHEN '?' THEN '2' WHEN '!!' THEN '3' WHEN '??' THEN '4' WHEN '!?' THEN '5' WHEN '?!' THEN '6' END AS glyph, CAST(NULL AS VARCHAR) AS comment, CAST(NULL AS VARCHAR) AS clock, CAST(NULL AS VARCHAR) AS evaluation FROM walk WHERE kind = 'move'
      UNION ALL SELECT id, i, cur, substr(san, 2), NULL, NULL, NULL FROM walk WHERE kind = 'glyph'
      UNION ALL SELECT id, i, CASE WHEN par IS NULL AND len(stack) > 0 THEN n + 1 ELSE cur END, NULL, nullif(trim(regexp_replace(regexp_replace(san, '\\[%[^\\]]*\\]', '', 'g'), '[{{}}]', '', 'g')), ''),
        nullif(regexp_extract(san, '\\[%clk ([^\\]]+)\\]', 1), ''), nullif(regexp_extract(san, '\\[%eval ([^\\]]+)\\]', 1), '') FROM walk WHERE kind = 'comment'),
    noted AS (SELECT id, node, coalesce(string_agg(glyph, ',' ORDER BY i), '') AS glyphs, string_agg(comment, chr(10) ORDER BY i) AS comment, max(clock) AS clock, max(evaluation) AS evaluation FROM notes GROUP BY id, node),
    tree AS (SELECT id, 0 AS node, CAST(NULL AS INT) AS parent, 0 AS ply, 0 AS depth, CAST(NULL AS VARCHAR) AS move FROM toks UNION ALL SELECT id, node, parent, ply, depth, move FROM moved)"""

_FAULTY = f"SELECT o_orderkey AS id, CASE fault WHEN ' (a3' THEN 'unclosed_variation' ELSE 'illegal' END AS error FROM (SELECT o_orderkey, {_FORM} FROM orders) WHERE fault <> ''"


@query(f"""{_WALK} SELECT id, node, parent, ply, CAST(depth AS INT) AS depth, move, coalesce(glyphs, '') AS glyphs, comment, clock, evaluation, CAST(NULL AS VARCHAR) AS error FROM tree LEFT JOIN noted USING (id, node)
    UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, error FROM ({_FAULTY})""")
def annotated_tree(spark, d):
    """Every move of every annotated game with what it follows and what is said about it; games with faults by their fault."""
    held = variations.tree(annotated(spark, d), "id", commands=True)
    error = F.regexp_replace("error", "(illegal).*|bad_move", "$1")
    error = F.when(F.col("error").isin("bad_move", "unclosed_variation"), "unclosed_variation").otherwise(error)
    return held.select("id", "node", "parent", "ply", "depth", "move", F.array_join(F.col("glyphs").cast("array<string>"), ",").alias("glyphs"), "comment", "clock", "evaluation", error.alias("error"))


@query(f"""{_WALK}, kids AS (SELECT id, parent, node, row_number() OVER (PARTITION BY id, parent ORDER BY node) AS k FROM tree WHERE node > 0),
    paths AS (SELECT id, node, CAST(k AS VARCHAR) AS path FROM kids WHERE parent = 0 UNION ALL SELECT kids.id, kids.node, paths.path || '.' || kids.k FROM paths JOIN kids ON kids.id = paths.id AND kids.parent = paths.node)
    SELECT path, count(*) AS games, count(DISTINCT move) AS moves FROM paths JOIN tree USING (id, node) GROUP BY path""")
def annotated_paths(spark, d):
    """How often a place in the tree is taken, by the numbers of children on the way to it."""
    # texts that are alike have one tree, which counts for all of their games; different ones are long work each
    texts = annotated(spark, d).groupBy("pgn").agg(F.count("*").alias("games"))
    held = variations.tree(spread(texts, "pgn"), "games", comments=False).where("node > 0")
    places = held.groupBy("path", "move").agg(F.sum("games").alias("games"))
    return places.groupBy(F.array_join(F.col("path").cast("array<string>"), ".").alias("path")).agg(F.sum("games").alias("games"), F.count_distinct("move").alias("moves"))
