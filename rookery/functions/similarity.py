"""How alike positions are to a reference: equal up to symmetries, distances, and digests of features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bits, boards, features
from .boards import MASKS, START
from .features import CATALOGUE, VALUES

STRATEGIC = ("pawns.structure", "lines.open_files", "lines.semi_open_files", "lines.rook_open_file", "lines.rook_semi_open_file", "king.uncastled", "king.castled_kingside", "king.castled_queenside", "king.open_file", "king.semi_open_file")
TACTICAL = ("tactics.absolute_pin", "tactics.relative_pin", "tactics.skewer", "tactics.fork", "tactics.double_attack", "tactics.double_check", "tactics.battery")
PLANS = ("goals.kingside_attack", "goals.queenside_attack", "goals.central_attack", "goals.pawn_storm", "goals.transfer_pieces_to_kingside", "goals.transfer_pieces_to_queenside")
#: What a frame keeps of each position.
FRAME = [*MASKS, "side", "castling", "ep", "strategic", "safety", "motifs", "roles", "plans"]


def _json(ids: list[str]) -> str:
    return "to_json(named_struct(" + ", ".join(f"'{i}', {features.rendered(CATALOGUE[i])}" for i in ids) + "))"


def _per_side(ids: tuple[str, ...], value) -> str:
    return "array(" + ", ".join(value(CATALOGUE[i].kind, features.side_text(CATALOGUE[i].text, s)) for i in ids for s in "wb") + ")"


def frame(positions: DataFrame, key: str) -> DataFrame:
    """key and FRAME. strategic and safety: values of features; motifs: how many of each tactical one a side has; roles: who
    pins what to what; plans: which attack indicators hold."""
    count = lambda kind, text: f"CAST({text} AS INT)" if kind == "bool" else f"CAST(bit_count({text}) AS INT)"
    roles = ", ".join(f"array_sort(transform({s}_pins, x -> concat_ws('/', codes[x.s], codes[x.f], codes[x.g])))" for s in "wb")
    held = features.staged(positions).withColumns({
        "strategic": F.expr(_json(list(STRATEGIC))),
        "safety": F.expr(_json([i for i in CATALOGUE if i.startswith("king.")])),
        "motifs": F.expr(_per_side(TACTICAL, count)),
        "roles": F.expr(f"array({roles})"),
        "plans": F.expr(_per_side(PLANS, lambda _, text: f"({text})")),
    })
    return held.select(key, *FRAME)


def edits(own: str, other: str) -> str:
    """The least number of pawns added, removed or moved by a step (one rank, at most one file) from mask to mask. Moves
    save one edit each; the most that fit together are found over the sets of targets in use."""
    gone, come = f"({own} & ~{other})", f"({other} & ~{own})"
    row = "(shiftleft(shiftleft(1L, s), 8) | shiftrightunsigned(shiftleft(1L, s), 8))"
    steps = bits.either(row, bits.sides(row))
    grown = f"flatten(transform(used, m -> transform(filter(sequence(0, 63), t -> (shiftrightunsigned({steps} & {come} & ~m, t) & 1) = 1), t -> m | shiftleft(1L, t))))"
    most = f"aggregate({bits.squares(gone)}, array(0L), (used, s) -> array_distinct(concat(used, {grown})), used -> array_max(transform(used, m -> bit_count(m))))"
    return f"CAST(bit_count({gone}) + bit_count({come}) - {most} AS INT)"


def compared(frames: DataFrame, key: str, reference: DataFrame) -> DataFrame:
    """key and similarity.* of frames against the one row of reference (a frame too). a_: columns of the reference."""
    one = reference.select(*[F.col(c).alias(f"a_{c}") for c in FRAME]).limit(1)
    both = frames.join(F.broadcast(one), F.lit(True))
    every = lambda form, ms=MASKS: " AND ".join(form.format(m=m, o=MASKS[(MASKS.index(m) + 6) % 12]) for m in ms)
    men = [m for m in MASKS if m[1] != "p"]
    state = "castling = a_castling AND ep <=> a_ep"
    same = every("{m} = a_{m}")
    upright = lambda m: bits.flipped_ranks(m)
    swapped = " AND ".join(f"{m} = {upright('a_' + MASKS[(i + 6) % 12])}" for i, m in enumerate(MASKS)) + " AND castling = (((a_castling & 3) << 2) | ((a_castling & 12) >> 2)) AND ep <=> (a_ep ^ 56)"
    by_rank = " AND ".join(f"{m} = {upright('a_' + m)}" for m in MASKS) + " AND castling = (((a_castling & 3) << 2) | ((a_castling & 12) >> 2)) AND ep <=> (a_ep ^ 56)"
    by_file = " AND ".join(f"{m} = {bits.flipped_files('a_' + m)}" for m in MASKS) + " AND castling = (((a_castling & 5) << 1) | ((a_castling & 10) >> 1)) AND ep <=> (a_ep ^ 7)"
    worth = lambda p: "(" + " + ".join(f"{v} * (bit_count({p}w{k.lower()}) + bit_count({p}b{k.lower()}))" for k, v in VALUES.items()) + ")"
    material = f"abs({worth('a_')} - {worth('')})"
    distance = f"({edits('a_wp', 'wp')} + {edits('a_bp', 'bp')})"
    placement = " + ".join(f"bit_count({m} ^ a_{m})" for m in men)

    def shifted(p: str, o: str, up: bool) -> str:
        gone, come = f"(a_{p} & ~{p})", f"({p} & ~a_{p})"
        one = bits.up(gone) if up else bits.down(gone)
        two = bits.up(gone, 2) if up else bits.down(gone, 2)
        return f"({o} = a_{o} AND bit_count({gone}) = 1 AND bit_count({come}) = 1 AND ({come} & {bits.either(one, bits.sides(one), two, bits.sides(two))}) <> 0)"

    def exchanged(s: str, x: str, y: str, n: int) -> str:
        """x pieces of a side less or more by n, y pieces the other way by one, all else equal."""
        dx, dy = (f"(bit_count(a_{s}{p}) - bit_count({s}{p}))" for p in (x, y))
        return f"(abs({dx}) = {n} AND {dy} * {n} = -{dx} AND {every('{m} = a_{m}', [m for m in MASKS if m not in (s + x, s + y)])})"

    texts = {
        "exact_same_position": f"{same} AND side = a_side AND {state}",
        "same_position_other_side": f"{same} AND side <> a_side AND {state}",
        "color_swapped_position": f"{swapped} AND side <> a_side",
        "mirrored_position": f"side = 'w' AND (({by_file}) OR ({by_rank}))",  # a mirrored position has White to move
        "same_pawn_structure": "wp = a_wp AND bp = a_bp",
        "comparable_pawn_structure": f"{distance} <= 2",
        "same_material_distribution": every("bit_count({m}) = bit_count(a_{m})"),
        "comparable_material_distribution": f"{material} <= 2",
        "same_piece_placement_patterns": every("{m} = a_{m}", men),
        "same_strategic_structure": "strategic = a_strategic",
        "same_king_safety_structure": "safety = a_safety",
        "same_tactical_geometry": f"motifs = a_motifs AND roles = a_roles AND (exists(motifs, n -> n > 0) OR ({same}))",
        "comparable_attack_plan": "exists(zip_with(plans, a_plans, (x, y) -> x AND y), p -> p)",
        "structural_distance": f"CAST({distance} + {placement} + IF(wk = a_wk AND bk = a_bk, 0, 1) + {material} AS INT)",
        "pawn_edit_distance": distance,
        "one_pawn_shifted": f"{shifted('wp', 'bp', True)} OR {shifted('bp', 'wp', False)}",
        "bishop_knight_substitution": f"{exchanged('w', 'b', 'n', 1)} OR {exchanged('b', 'b', 'n', 1)}",
        "two_rooks_queen_substitution": f"{exchanged('w', 'r', 'q', 2)} OR {exchanged('b', 'r', 'q', 2)}",
    }
    return both.select(key, *[F.expr(text).alias(f"similarity.{name}") for name, text in texts.items()])


def similarity(positions: DataFrame, key: str, fen: str = START) -> DataFrame:
    """The features similarity.* against a reference position."""
    one = boards.with_masks(positions.sparkSession.createDataFrame([("r", fen)], "name string, fen string")).drop("fen")
    return compared(frame(positions, key), key, frame(one, "name"))
