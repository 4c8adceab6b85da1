import pytest

from rookery.functions import boards, features

GOLDEN = [
    ("6k1/8/8/3p4/8/3N4/8/3R2K1 w - - 0 1", "goals.attack_isolated_pawn", ([], [])),
    ("4r1k1/8/8/8/4P3/8/8/6K1 b - - 0 1", "goals.attack_isolated_pawn", ([], ["e4"])),
    ("6k1/8/4p3/8/3P4/8/2P5/6K1 w - - 0 1", "goals.attack_backward_pawn", ([], [])),
    ("6k1/8/4p3/8/3P4/8/2P5/4R1K1 w - - 0 1", "goals.attack_backward_pawn", (["e6"], [])),
    ("3r2k1/8/4p3/8/3P4/8/2P5/6K1 b - - 0 1", "goals.attack_backward_pawn", ([], ["d4"])),
    ("3r2k1/8/3np3/8/3P4/8/2P5/6K1 b - - 0 1", "goals.attack_backward_pawn", ([], [])),
    ("4k3/8/7r/8/8/R7/8/4K3 w - - 0 1", "goals.rook_lift", (["a3"], ["h6"])),
    (boards.START, "mobility.per_side", (20, 20)),
    (boards.START, "material.total_value", (39, 39)),
    (boards.START, "pawns.islands", (1, 1)),
    (boards.START, "threats.check", (False, False)),
    (boards.START, "king.uncastled", (True, True)),
    (boards.START, "mobility.development", (0, 0)),
    ("4k3/8/8/3pP3/8/8/8/4K3 w - d6 0 1", "pawns.passed", (["e5"], ["d5"])),
    ("4k3/8/8/8/8/2N5/P1P5/4K3 w - - 0 1", "pawns.isolated", (["a2", "c2"], [])),
    ("4k3/8/8/4N3/3P4/8/8/4K3 w - - 0 1", "placement.knight_outpost", (["e5"], [])),
    ("4k3/8/1p6/8/2P5/8/8/R3K2R w KQ - 0 1", "mobility.king_activity", (7, 5)),
]


@pytest.fixture(scope="module")
def vectors(spark):
    fens = sorted({fen for fen, _, _ in GOLDEN})
    ids = sorted({i for _, i, _ in GOLDEN})
    rows = boards.with_masks(spark.createDataFrame([(f, f) for f in fens], "name string, fen string")).drop("fen")
    got = features.extract(rows, "name", ids)
    return got, {r["name"]: r for r in got.collect()}


@pytest.mark.parametrize(("fen", "feature", "want"), GOLDEN)
def test_golden(vectors, fen, feature, want):
    assert tuple(vectors[1][fen][feature]) == want


def test_ids_are_unique_and_every_text_fills_both_sides():
    own = [f.id for f in features._catalogue()]
    assert len(set(own)) == len(own)
    for f in features.CATALOGUE.values():
        assert "{" not in (features.side_text(f.text, "b") if f.per_side else f.text), f.id


def test_atoms_and_comparison(vectors):
    got = {(r["name"], r["atom"]) for r in features.atoms(vectors[0], "name").collect()}
    assert ("4k3/8/7r/8/8/R7/8/4K3 w - - 0 1", "goals.rook_lift:w:a3") in got
    assert (boards.START, "king.uncastled:w") in got
    assert features.compared(vectors[0], "name", vectors[0]).where("NOT equal").count() == 0
