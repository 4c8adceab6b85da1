import pytest

from rookery.functions import boards, features, similarity

KIWIPETE = "r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1"
PINNED = "4k3/4r3/8/8/8/8/4N3/R3K2R w KQ - 0 1"
GOLDEN = [
    (PINNED, "tactics.absolute_pin", (["e2"], [])),
    (PINNED, "tactics.relative_pin", ([], [])),
    (KIWIPETE, "tactics.pin", ([], ["f6"])),
    (KIWIPETE, "threats.capture_threats", (8, 7)),
    (KIWIPETE, "mobility.legal_moves", 48),
    (KIWIPETE, "lines.queen_bishop_battery", (True, False)),
    (KIWIPETE, "pawns.chain_bases", (["e4"], ["d7"])),
    (KIWIPETE, "evaluation.total_evaluation", 0.7),
    (PINNED, "threats.aantal_checks", (2, 1)),
    (PINNED, "threats.checks", (["a1", "h1"], ["e7"])),
    (boards.START, "mobility.legal_moves", 20),
    (boards.START, "pawns.structure_gap", 5.0),
    (boards.START, "pawns.color_mirrored", True),
    (boards.START, "quality.batteries", ([], [])),
    (boards.START, "king.open_diagonal", ([], [])),
    (boards.START, "evaluation.winning_drawing_losing", ("drawing", "drawing")),
    ("4k3/8/8/3b4/8/8/3R4/3QK3 w - - 0 1", "lines.queen_rook_battery", (True, False)),
    ("4k3/8/8/8/8/8/2PP4/4K3 w - - 0 1", "pawns.hanging", (["c2", "d2"], [])),
    ("4k3/8/8/8/P7/P7/P7/4K3 w - - 0 1", "pawns.tripled", (["a2", "a3", "a4"], [])),
    ("6k1/7p/8/8/8/3B4/8/6K1 w - - 0 1", "motifs.greek_gift", (True, False)),
    ("4k3/8/8/8/4N3/8/4R3/4K3 w - - 0 1", "tactics.discovered_check", (["e4"], [])),
]


@pytest.fixture(scope="module")
def vectors(spark):
    rows = boards.with_masks(spark.createDataFrame([(f, f) for f in sorted({f for f, _, _ in GOLDEN})], "name string, fen string")).drop("fen")
    return {r["name"]: r for r in features.extract(rows, "name", sorted({i for _, i, _ in GOLDEN})).collect()}


@pytest.mark.parametrize(("fen", "feature", "want"), GOLDEN)
def test_golden(vectors, fen, feature, want):
    got = vectors[fen][feature]
    assert (tuple(got) if isinstance(want, tuple) else got) == want


def test_all_sections_are_there():
    assert len(features.CATALOGUE) == 362  # and 18 of similarity


def test_similarity(spark):
    rows = [
        ("same", boards.START), ("turn", boards.START.replace(" w ", " b ")), ("e4", "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq - 0 1"),
        ("three", "rnbqkbnr/pppppppp/8/8/8/2PP4/PP2PPP1/RNBQKNNR w KQkq - 0 1"), ("knight", "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKNNR w KQkq - 0 1"), ("queen", "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/1NBQKBNQ w kq - 0 1"),
    ]
    p = boards.with_masks(spark.createDataFrame(rows, "name string, fen string")).drop("fen")
    got = {r["name"]: {k.split(".")[-1]: v for k, v in r.asDict().items()} for r in similarity.similarity(p, "name").collect()}
    true = lambda n: {k for k, v in got[n].items() if v is True}
    assert true("same") >= {"exact_same_position", "same_pawn_structure", "same_tactical_geometry"} and got["same"]["structural_distance"] == 0
    assert true("turn") >= {"same_position_other_side", "color_swapped_position"} and "exact_same_position" not in true("turn")
    assert got["e4"]["pawn_edit_distance"] == 2 and "one_pawn_shifted" in true("e4")
    assert got["three"]["pawn_edit_distance"] == 3 and "comparable_pawn_structure" not in true("three")
    assert "bishop_knight_substitution" in true("knight") and "bishop_knight_substitution" not in true("e4")
    assert "two_rooks_queen_substitution" in true("queen") and "two_rooks_queen_substitution" not in true("knight")
