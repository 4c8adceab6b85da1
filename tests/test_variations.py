import random
import re

import numpy as np

from rookery.operators import variations

HEAD = '[Event "x"]\n[Result "*"]\n\n'
SCHEMA = "id int, pgn string, node int, record string, headers string"
#: Moves that stay legal in any order, for each side.
QUIET = ("h3 g3 a3 b3 c3 d3".split(), "h6 g6 a6 b6 c6 d6".split())


def trees(spark, rows, **options):
    return variations.tree(spark.createDataFrame([(i, t, 1, "r", "h") for i, t in rows], SCHEMA), "id", **options).collect()


def text(r, ply, used, depth=0):
    """A line of random moves with side lines, and no move twice on the way to any node."""
    out, free = [], list(used)
    for _ in range(r.randrange(1, 5)):
        moves = [m for m in QUIET[ply % 2] if m not in free]
        if not moves:
            break
        move = r.choice(moves)
        out.append(("" if ply % 2 else f"{ply // 2 + 1}. ") + move + r.choice(["", "", "!", "?!"]))
        out += r.choice([[], [], ["$7", "$7", "$9"], ["{one [%clk 0:01:0" + str(r.randrange(9)) + "]}", "{two}"], ["; rest\n"]])
        for _ in range(r.choice([0, 0, 1, 2]) if depth < 3 else 0):
            inner = text(r, ply, free, depth + 1)
            out += ["(", *(["{before}"] if r.random() < 0.3 else []), *inner, ")"] if inner else []
        free.append(move)
        ply += 1
    return out


def brute(body):
    """What follows what: the node that the next move follows, and a stack of those around brackets."""
    marks = {"!": 1, "?": 2, "!!": 3, "??": 4, "!?": 5, "?!": 6}
    rows = {0: {"parent": None, "ply": 0, "depth": 0, "move": None, "glyphs": [], "comment": [], "clock": None}}
    cur, par, stack, fresh, pending = 0, None, [], True, []
    for token in re.findall(r"\{[^}]*\}|;[^\n]*|[()]|\$\d+|[^\s{}();$]+", body):
        if token == "(":
            stack.append((cur, par, fresh))
            cur, par, fresh = par, None, True
        elif token == ")":
            cur, par, fresh = stack.pop()
        elif token[0] in "{;":
            words = re.sub(r"\[%[^\]]*\]", "", token.strip("{};")).strip()
            clock = re.search(r"\[%clk ([^\]]+)\]", token)
            if fresh and stack:
                pending += [words] if words else []
            else:
                rows[cur]["comment"] += [words] if words else []
                rows[cur]["clock"] = clock[1] if clock and not fresh else rows[cur]["clock"]
        elif token[0] == "$":
            rows[cur]["glyphs"] += [int(token[1:])] * (int(token[1:]) not in rows[cur]["glyphs"])
        elif word := re.sub(r"^\d+\.(\.\.)?", "", token):
            if word != "*":
                bare = word.rstrip("!?")
                node = len(rows)
                rows[node] = {"parent": cur, "ply": rows[cur]["ply"] + 1, "depth": len(stack), "move": bare, "glyphs": [marks[word[len(bare) :]]] if word != bare else [], "comment": pending, "clock": None}
                cur, par, fresh, pending = node, cur, False, []
    return {k: v | {"comment": "\n".join(v["comment"]) or None} for k, v in rows.items()}


def test_random_trees_equal_a_stack_machine(spark):
    r = random.Random(3)
    games = []
    for i in range(60):
        body = " ".join(["{about}"] * r.randrange(2) + text(r, 0, [])) + " *"
        games.append((i, body))
    got = {}
    for row in trees(spark, [(i, HEAD + b) for i, b in games], commands=True):
        assert row["error"] is None
        got.setdefault(row["id"], {})[row["node"]] = {c: row[c] for c in ("parent", "ply", "depth", "move", "glyphs", "comment", "clock")}
    assert got == {i: brute(b) for i, b in games}
    assert max(v["depth"] for g in got.values() for v in g.values()) >= 3


def test_paths_and_positions_follow_from_parents(spark):
    rows = trees(spark, [(1, HEAD + "1. e4 (1. d4 d5 (1... Nf6 2. c4) 2. c4) (1. c4) 1... e5 2. Nf3 *")])
    by_node = {r["node"]: r for r in rows}
    assert [by_node[n]["path"] for n in range(len(rows))] == [[], [1], [2], [2, 1], [2, 2], [2, 2, 1], [2, 1, 1], [3], [1, 1], [1, 1, 1]]
    assert by_node[5]["record"] != by_node[6]["record"] and by_node[5]["move"] == by_node[6]["move"] == "c4"
    assert all(r["record"][64] == r["ply"] % 2 for r in rows)


def test_games_with_faults_are_refused_whole(spark):
    faults = {
        "1. e4 (1. d4 e5 *": "bad_move", "1. e4 (1. d4) ) *": "bad_move", "1. e4 (1. Ke3) *": "illegal_node_2", "1. e4 e5 (1... e4) *": "illegal_node_3", "1. e4 $256 *": "bad_annotations",
        "$3 1. e4 *": "annotation_without_move", "1. e4 ({only}) *": None, "1. e4 ! *": None, "1. e4 (1. d4 (1. c4 (1. b4))) *": None,
        "1. e4 " + " ".join(f"${n}" for n in range(8)) + " *": None, "1. e4 " + " ".join(f"${n}" for n in range(9)) + " *": "bad_annotations",
    }
    rows = trees(spark, [(i, HEAD + t) for i, t in enumerate(faults)])
    found = {i: {r["error"] for r in rows if r["id"] == i} for i in range(len(faults))}
    assert found == {i: {e} for i, e in enumerate(faults.values())}
    assert all(sum(r["id"] == i for r in rows) == 1 for i, e in enumerate(faults.values()) if e)


def test_nulls_repeats_starts_and_options(spark):
    set_up = '[Event "x"]\n[SetUp "1"]\n[FEN "4k3/8/8/8/8/8/4P3/4K3 w - - 0 1"]\n\n1. e4 {good [%eval 0.2]} (1. e3 $1) 1... Kd7 *'
    many = HEAD + "1. a3 a6 " + " ".join(f"(1... h6 2. h3 {{{'long ' * 20}}})" for _ in range(500)) + " *"
    rows = [(1, None), (2, ""), (3, set_up), (3, set_up), (None, set_up), (4, many)]
    got = trees(spark, rows)
    assert [sum(r["id"] == i and r["error"] is None for r in got) for i in (1, 2, 3, None, 4)] == [0, 0, 8, 4, 1_003]
    assert {r["error"] for r in got if r["id"] in (1, 2)} == {"no_headers"}
    assert {r["evaluation"] for r in got} == {None} and "good" in {r["comment"] for r in got}
    bare = trees(spark, rows[2:3], comments=False, side_lines=False, commands=True)
    assert sorted((r["node"], r["move"], r["comment"], r["evaluation"]) for r in bare) == [(0, None, None, None), (1, "e4", None, "0.2"), (3, "Kd7", None, None)]
    assert trees(spark, []) == []


def test_texts_that_repeat_within_a_batch(spark):
    texts = [HEAD + "1. e4 (1. d4 d5) 1... e5 *", HEAD + "1. e4 {} {[%clk 1]} ( *", HEAD + "1. e4 {} {{} *", HEAD + "1. a3 *"]
    held = spark.createDataFrame([(i, texts[i % 4]) for i in range(400)], "id int, pgn string").coalesce(1)
    found = {}
    for row in variations.tree(held, "id").orderBy("id", "node").collect():
        found.setdefault(row["id"], []).append((row["node"], row["move"], row["error"]))
    forms = [[(0, None, None), (1, "e4", None), (2, "d4", None), (3, "d5", None), (4, "e5", None)], [(None, None, "bad_move")], [(None, None, None)], [(0, None, None), (1, "a3", None)]]
    forms[2] = [(0, None, None), (1, "e4", None)]
    assert found == {i: forms[i % 4] for i in range(400)}


def test_rows_go_out_in_pieces_of_a_bounded_size():
    r = np.random.default_rng(5)
    at, sizes = r.integers(3, 40, 5_000), r.integers(1, 90, 37)
    games = np.flatnonzero(at < 30)
    got = [(g.to_numpy(), rows.to_numpy()) for g, rows in variations._dealt(games, at, sizes, 3)]
    starts = np.cumsum(sizes) - sizes
    want = [(g, starts[at[g] - 3] + k) for g in games for k in range(sizes[at[g] - 3])]
    assert [(g, x) for gs, xs in got for g, x in zip(gs, xs, strict=True)] == want
    assert len(got) > 3 and max(len(g) for g, _ in got) <= variations.ROWS + max(sizes)
