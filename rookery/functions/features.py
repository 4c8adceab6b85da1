"""Features of positions as SQL over bitboards.

A feature is text with placeholders for a side: {P} to {K} are its pieces, {own}
all of them, {eP} to {eK} and {enemy} the other's, {s} and {e} the prefixes of
columns made in stages before. A value for each side becomes a struct (white,
black); masks come out as arrays of square names. Several definitions that share a
name in other places are kept apart by section.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attacks, bits, geometry
from .attacks import signed
from .once import spread

CENTER = sum(1 << 8 * r + f for r in range(2, 6) for f in range(2, 6))
KEY = sum(1 << s for s in (27, 28, 35, 36))
HALF = {"w": -(1 << 32), "b": (1 << 32) - 1}  # the enemy's half
BACK = {"w": 0xFF, "b": -(1 << 56)}
SEVENTH = {"w": 0xFF << 48, "b": 0xFF << 8}
BAND = {"w": 0xFFFFFFFF << 24, "b": 0xFFFFFFFF << 8}  # where outposts stand
LIGHT = ~bits.DARK
VALUES = {"P": 1, "N": 3, "B": 3, "R": 5, "Q": 9}
WING = {"queenside": bits.QUEENSIDE, "kingside": bits.KINGSIDE}
AC, FH = 0x0707070707070707, signed(0xE0E0E0E0E0E0E0E0)


@dataclass(frozen=True)
class Feature:
    """kind: squares, int, bool or other (any value); per_side: a struct of white and black."""

    id: str
    text: str
    kind: str = "squares"
    per_side: bool = True

    @property
    def section(self) -> str:
        return self.id.split(".")[0]


def side_text(text: str, side: str) -> str:
    """Fills the placeholders for one side."""
    other = "b" if side == "w" else "w"
    names = {p.upper(): side + p for p in "pnbrqk"} | {"e" + p.upper(): other + p for p in "pnbrqk"}
    names |= {"own": side, "enemy": other, "s": side, "e": other}
    names |= {"half": bits.num(HALF[side]), "eback": bits.num(BACK[other]), "back": bits.num(BACK[side]), "seventh": bits.num(SEVENTH[side]), "band": bits.num(BAND[side]), "center": str(CENTER), "key": str(KEY)}
    names |= {"kings": bits.num(bits.KINGSIDE), "queens": str(bits.QUEENSIDE), "light": bits.num(LIGHT), "dark": bits.num(bits.DARK), "ac": str(AC), "fh": bits.num(FH), "pieces": f"({side} & ~({side}p | {side}k))", "major": f"({side}r | {side}q)", "emajor": f"({other}r | {other}q)", "minor": f"({side}n | {side}b)", "white": "true" if side == "w" else "false"}
    return text.format_map(names)


def _ahead(mask: str, side: str) -> str:
    return bits.ahead(mask, side == "w")


def stages() -> list[dict[str, str]]:
    """Columns that features share, in the order in which they build on one another."""
    one: dict[str, str] = {}
    two: dict[str, str] = {}
    three: dict[str, str] = {}
    four: dict[str, str] = {}
    for s, e in (("w", "b"), ("b", "w")):
        white = s == "w"
        p = s + "p"
        one |= {
            f"{s}_pat": bits.pawn_attacks(p, white),  # squares that own pawns attack
            f"{s}_front": bits.front(p, white),
            f"{s}_files": f"({bits.filled(p, True)} | {bits.filled(p, False)})",  # whole files of own pawns
            f"{s}_beside": bits.filled(bits.sides(p), white),  # level with or ahead of a pawn of the next file
            f"{s}_strict": bits.front(bits.sides(p), white),
            f"{s}_step": bits.less(_ahead(p, s), "occ"),  # empty squares before pawns
            f"{s}_zone": bits.king_attacks(s + "k"),
            f"{s}_value": " + ".join(f"{v} * bit_count({s}{k.lower()})" for k, v in VALUES.items()),
        }
        two |= {
            f"{s}_reachable": bits.sides(f"{s}_front"),  # squares that own pawns may come to attack
            f"{s}_iso": f"({p} & ~{bits.sides(f'{s}_files')})",
            f"{s}_back": f"({p} & ~{s}_beside)",
            f"{s}_rooks7": f"({s}r & {bits.num(SEVENTH[s])})",
            f"{s}_open": f"~({s}_files | {e}_files)",
            f"{s}_semi": f"({e}_files & ~{s}_files)",
            f"{s}_shield": f"({_ahead(bits.either(s + 'k', bits.sides(s + 'k')), s)} | {_ahead(_ahead(bits.either(s + 'k', bits.sides(s + 'k')), s), s)})",
        }
        three |= {
            f"{s}_passed": f"({p} & ~({e}_front | {e}_reachable))",
            f"{s}_potential": f"({bits.num(BAND[s])} & ~{e}_reachable)",
            f"{s}_outpost": f"({bits.num(BAND[s])} & {s}_pat & ~{e}_reachable)",
            f"{s}_doubled": f"({p} & ({bits.front(p, True)} | {bits.front(p, False)}))",
        }
        behind = bits.ahead(f"({s}_step & {e}_pat & ~{s}_pat)", not white)
        four |= {
            f"{s}_sback": f"({p} & {behind} & ~{s}_passed)",  # the other backward pawns: the step is covered by enemy pawns only
            f"{s}_candidate": f"({p} & ~{s}_passed & ~{bits.ahead(bits.either(f'{e}_front', f'{e}_reachable'), not white)})",
        }
    return [one, two, three, four]


def _catalogue() -> list[Feature]:
    out: list[Feature] = []

    def add(section: str, kind: str, sided: bool, /, **texts: str) -> None:
        out.extend(Feature(f"{section}.{name.replace('__', '.')}", text, kind, sided) for name, text in texts.items())

    count = "bit_count"
    add("state", "squares", True, king_squares="{K}")
    add("state", "other", False, side_to_move="IF(side = 'w', 'white', 'black')", castling_rights="IF(castling = 0, '-', concat(IF(castling & 1 > 0, 'K', ''), IF(castling & 2 > 0, 'Q', ''), IF(castling & 4 > 0, 'k', ''), IF(castling & 8 > 0, 'q', '')))")
    add("state", "other", False, en_passant=f"IF(ep IS NULL, NULL, {bits.names('shiftleft(1L, ep)')}[0])", white_pawn_squares=bits.names("wp"), black_pawn_squares=bits.names("bp"), square_occupancy="transform(codes, c -> IF(c = 0, NULL, substr('PNBRQKpnbrqk', c, 1)))")
    add("material", "int", True, total_value="{s}_value", count__queen=f"{count}({{Q}})", count__rook=f"{count}({{R}})", count__bishop=f"{count}({{B}})", count__knight=f"{count}({{N}})", count__pawn=f"{count}({{P}})")
    add("material", "int", False, difference="w_value - b_value")
    diff = {k: f"(bit_count(w{k}) - bit_count(b{k}))" for k in "pnbrq"}
    add("material", "bool", True, bishop_pair="bit_count({B}) >= 2", exchange_advantage="bit_count({R}) - bit_count({eR}) = 1 AND bit_count({minor}) - bit_count({e}n | {e}b) = -1 AND bit_count({Q}) = bit_count({eQ}) AND bit_count({P}) = bit_count({eP})")
    add("material", "bool", False, bishop_pair__both="bit_count(wb) >= 2 AND bit_count(bb) >= 2", imbalance__knight_vs_bishop=f"{diff['n']} * {diff['b']} < 0", imbalance__rook_vs_minor=f"{diff['r']} * ({diff['n']} + {diff['b']}) < 0", imbalance__queen_vs_rooks=f"{diff['q']} * {diff['r']} < 0",
        imbalance__two_rooks_vs_queen=f"({diff['r']} >= 2 AND {diff['q']} <= -1) OR ({diff['r']} <= -2 AND {diff['q']} >= 1)", imbalanced="w_value <> b_value OR " + " OR ".join(f"{d} <> 0" for d in diff.values()),
        bishops__opposite_color=f"wb <> 0 AND bb <> 0 AND NOT (((wb & {bits.num(bits.DARK)}) <> 0 AND (bb & {bits.num(bits.DARK)}) <> 0) OR ((wb & {bits.num(LIGHT)}) <> 0 AND (bb & {bits.num(LIGHT)}) <> 0))",
        bishops__same_color=f"((wb & {bits.num(bits.DARK)}) <> 0 AND (bb & {bits.num(bits.DARK)}) <> 0) OR ((wb & {bits.num(LIGHT)}) <> 0 AND (bb & {bits.num(LIGHT)}) <> 0)",
        queenless="wq = 0 AND bq = 0", endgame_transition="wq = 0 AND bq = 0 AND bit_count(wn | wb | wr | bn | bb | br) <= 6")
    step = "IF({white}, shiftleft({m}, 8), shiftrightunsigned({m}, 8))"
    fore = lambda m: step.replace("{m}", m)
    rear = lambda m: f"IF({{white}}, shiftrightunsigned({m}, 8), shiftleft({m}, 8))"
    attacked_by = lambda m: bits.sides(rear(m))  # noqa: E731  own pawns from which a square of m is attacked
    breaks = f"({{P}} & {rear('({s}_step & ' + bits.sides(rear('{eP}')) + ')')})"
    add("pawns", "squares", True, isolated="{s}_iso", iqp="{s}_iso & " + str(bits.FILES[3]), backward="{s}_back", doubled="{s}_doubled", passed="{s}_passed", protected_passed="{s}_passed & {s}_pat", connected_passed="{s}_passed & (" + " | ".join(f"{d}" for d in [bits.sides(bits.up("{s}_passed")), bits.sides(bits.down("{s}_passed"))]) + ")",
        candidate_passed="{s}_candidate", connected="{P} & {s}_pat", levers=f"{{P}} & {attacked_by('{eP}')}", breaks=breaks, weak="{s}_iso | {s}_back", weak_undeprotectable="({s}_iso | {s}_back) & ~{s}_strict", advanced="{P} & {half}", overextended="{P} & {half} & ~{s}_pat",
        blockaded_passed=f"{{s}}_passed & {rear('{enemy}')}", blockade_square=f"{fore('{s}_passed')} & {{enemy}}")
    wings = "named_struct('queenside', CAST(bit_count({P} & {queens}) AS INT), 'kingside', CAST(bit_count({P} & {kings}) AS INT))"
    islands = f"bit_count({bits.files_of('{P}')} & ~(shiftleft({bits.files_of('{P}')}, 1)))"
    add("pawns", "other", True, count__per_wing=wings)
    add("pawns", "int", True, islands=islands, count_anomaly="8 - bit_count({P})")
    add("pawns", "bool", True, majority="bit_count({P}) > bit_count({eP})", kingside_majority="bit_count({P} & {kings}) > bit_count({eP} & {kings})", queenside_majority="bit_count({P} & {queens}) > bit_count({eP} & {queens})", minority="bit_count({P}) < bit_count({eP})",
        minority_attack=" OR ".join(f"(bit_count({{P}} & {w}) BETWEEN 1 AND bit_count({{eP}} & {w}) - 1)" for w in ("{queens}", "{kings}")), diagonal_displacement="{s}_doubled <> 0", rook_behind_passed=f"({{R}} & {'IF({white}, ' + bits.front('{s}_passed', False) + ', ' + bits.front('{s}_passed', True) + ')'}) <> 0")
    facing = "(shiftleft(wp, 8) & bp)"
    tense = f"({bits.pawn_attacks('wp', True)} & bp)"
    add("pawns", "bool", False, locked=f"{facing} <> 0 AND {tense} = 0", open_structure=f"{facing} = 0 AND {tense} = 0", fixed="w_step = 0 AND b_step = 0")
    add("placement", "other", True, concentration__per_wing="named_struct('queenside', CAST(bit_count({own} & ~{P} & {queens}) AS INT), 'kingside', CAST(bit_count({own} & ~{P} & {kings}) AS INT))")
    add("placement", "int", True, center="bit_count({own} & {center})")
    rim = bits.num(bits.FILES[0] | bits.FILES[7])
    by_conflict = lambda test: f"((IF(bit_count({{P}} & {{dark}}) {test}, {{B}} & {{dark}}, 0L)) | (IF(bit_count({{P}} & {{light}}) {test}, {{B}} & {{light}}, 0L)))"
    add("placement", "squares", True, enemy_territory="{own} & {half}", advanced="{own} & ~{P} & {half}", centralized="{own} & {center}", knight_on_rim=f"{{N}} & {rim}", knight_outpost="{N} & {s}_outpost", bishop_outside_chain=by_conflict("<= 2"), rook_seventh="{s}_rooks7", rook_open_file="{R} & {s}_open", rook_semi_open_file="{R} & {s}_semi", queen_center="{Q} & {center}", king_center="{K} & {center}")
    doubled_rooks = f"({{R}} & ({bits.front('{R}', True)} | {bits.front('{R}', False)})) <> 0"
    add("placement", "bool", True, doubled_rooks=doubled_rooks, rook_behind_passed="({R} & IF({white}, " + bits.front("{s}_passed", False) + ", " + bits.front("{s}_passed", True) + ")) <> 0")
    home = "IF({white}, 102L, 7349874591868649472L)"  # b, c, f and g of the back rank
    add("mobility", "int", True, development=f"4 - bit_count({{minor}} & {home})", development_deficit=f"bit_count({{minor}} & {home}) + IF({{K}} = IF({{white}}, 16L, 1152921504606846976L), 1, 0)")
    add("mobility", "squares", True, undeveloped=f"{{minor}} & {home}")
    add("center", "squares", True, occupation="{own} & {key}", pawn_center="{P} & {key}", piece_center="{own} & ~{P} & {key}")
    add("center", "int", True, extended="bit_count({P} & {center})")
    add("center", "bool", True, stable="bit_count({P} & {center}) >= 2 AND ({P} & {center} & {e}_pat) = 0", mobile=f"({{s}}_step & {fore('({P} & {center})')}) <> 0", breakthrough=f"({breaks} & {{center}}) <> 0")
    add("center", "bool", False, locked=f"(shiftleft(wp & {CENTER}, 8) & bp & {CENTER}) <> 0", open=f"((wp | bp) & {CENTER}) = 0", tension=f"({bits.pawn_attacks(f'(wp & {CENTER})', True)} & bp) <> 0 OR ({bits.pawn_attacks(f'(bp & {CENTER})', False)} & wp) <> 0")
    add("space", "bool", True, advanced_chain="({P} & {half} & " + bits.right("({P} & {half})") + ") <> 0")
    own_half = "~{half}"
    add("squares", "squares", True, weak=f"~occ & {own_half} & {{e}}_pat & ~{{s}}_pat", hole=f"~occ & {own_half} & ~{{s}}_pat", outpost="{s}_outpost & ~occ", occupied_outpost="{s}_outpost & {own}", potential_outpost="{s}_potential & ~occ", enemy_on_outpost="{s}_outpost & {enemy}")
    lights = "(bit_count({P} & {light}) - bit_count({P} & {dark}))"
    add("squares", "other", True, weak_color_complex=f"CASE WHEN {lights} <= -3 THEN 'light' WHEN {lights} >= 3 THEN 'dark' END")
    add("squares", "bool", True, dark_weakness=f"{lights} >= 3", light_weakness=f"{lights} <= -3 AND NOT {lights} >= 3")
    add("lines", "other", False, open_files="transform(filter(sequence(0, 7), f -> (shiftrightunsigned(w_open, f) & 1) = 1), f -> substr('abcdefgh', f + 1, 1))", closed_files="transform(filter(sequence(0, 7), f -> (shiftrightunsigned(w_files & b_files, f) & 1) = 1), f -> substr('abcdefgh', f + 1, 1))", open_ranks="transform(filter(sequence(0, 7), r -> (shiftrightunsigned(wp | bp, 8 * r) & 255) = 0), r -> r + 1)")
    add("lines", "other", True, semi_open_files="transform(filter(sequence(0, 7), f -> (shiftrightunsigned({s}_semi, f) & 1) = 1), f -> substr('abcdefgh', f + 1, 1))")
    add("lines", "bool", True, rook_open_file="({R} & {s}_open) <> 0", rook_semi_open_file="({R} & {s}_semi) <> 0", penetration="exists(sequence(0, 63), s -> (shiftrightunsigned({R}, s) & 1) = 1 AND (reach[s] & {eback}) <> 0)")
    a = lambda n, side="{s}": f"{side}att[{n - 1}]"
    more = "(" + " | ".join(f"({a(k, '{e}')} & ~{a(k)})" for k in range(1, 9)) + ")"  # more enemy attackers than own defenders
    add("attacks", "squares", True, map=a(1), defended_squares=f"{{own}} & {a(1)}", attacked_pieces=f"{{enemy}} & {a(1)}", undefended=f"{{own}} & ~{{K}} & ~{a(1)}", loose=f"{{own}} & ~{{K}} & ~{a(1)} & {a(1, '{e}')}", hanging=f"{{own}} & ~{{K}} & ~{a(1)} & {a(2, '{e}')}", en_prise=f"{{own}} & {more}", overprotected=f"{{own}} & {a(3)}",
        underdefended=f"{{own}} & {a(1)} & {more}", pressure_squares=f"{{enemy}} & {a(2)}", pressure_isolated=f"{{e}}_iso & {a(2)}", pressure_backward=f"{{e}}_back & {a(2)}", pressure_passed=f"{{e}}_passed & {a(2)}", king_zone_pressure=f"{{s}}_zone & {a(1, '{e}')}",
        overloaded="aggregate(filter(sequence(0, 63), s -> (shiftrightunsigned({own}, s) & 1) = 1 AND bit_count(reach[s] & {own}) >= 2), 0L, (m, s) -> m | shiftleft(1L, s)) & " + a(1, "{e}"))
    add("attacks", "squares", False, attacked_squares="watt[0] | batt[0]")
    f2 = "IF({white}, 8192L, 9007199254740992L)"
    add("attacks", "int", True, f2_f7=" + ".join(f"IF(({a(k, '{e}')} & {f2}) <> 0, 1, 0)" for k in range(1, 9)))
    add("attacks", "other", True, attackers_per_square="map_from_entries(transform(filter(sequence(0, 63), s -> (shiftrightunsigned({s}att[0], s) & 1) = 1), s -> struct(concat(substr('abcdefgh', s % 8 + 1, 1), s DIV 8 + 1), aggregate({s}att, 0, (n, m) -> n + CAST(shiftrightunsigned(m, s) & 1 AS INT)))))")
    add("center", "int", True, control=f"bit_count({a(1)} & {{center}})", key_control=f"bit_count({a(1)} & {{key}})")
    add("center", "squares", True, controlled=f"{a(1)} & {{center}}", key_controlled=f"{a(1)} & {{key}}")
    add("center", "int", False, dominance=f"bit_count(watt[0] & {CENTER}) - bit_count(batt[0] & {CENTER})")
    halves = lambda mask: f"bit_count(watt[0] & {bits.num(HALF['w'])} & {mask}) - bit_count(batt[0] & {bits.num(HALF['b'])} & {mask})"
    add("space", "int", False, total=halves("-1L"), kingside=halves(bits.num(bits.KINGSIDE)), queenside=halves(str(bits.QUEENSIDE)), center=halves(str(CENTER)))
    add("space", "int", True, enemy_half_control=f"bit_count({a(1)} & {{half}})", territory=f"bit_count({a(1)} & {{half}} & ~{a(1, '{e}')})")
    add("space", "squares", True, enemy_half_squares=f"{a(1)} & {{half}}", territory_squares=f"{a(1)} & {{half}} & ~{a(1, '{e}')}")
    add("space", "bool", True, gaining_push=f"({{s}}_step & ~{a(1, '{e}')}) <> 0")
    heavy = "aggregate(filter(sequence(0, 63), s -> (shiftrightunsigned({major}, s) & 1) = 1), 0L, (m, s) -> m | reach[s])"
    add("squares", "squares", True, king_weak=f"{{s}}_zone & {a(1, '{e}')} & ~{a(1)}", behind_pawns=f"{rear('{P}')} & ~occ & {a(1, '{e}')}", invasion=f"~occ & {{half}} & {a(1)} & ~{a(1, '{e}')}", heavy_entry=f"~occ & {{half}} & {a(1)} & ~{a(1, '{e}')} & {heavy}")
    add("mobility", "int", True, coordination=f"bit_count({{pieces}} & {a(1)})")
    add("mobility", "squares", True, coordinated=f"{{pieces}} & {a(1)}", uncoordinated=f"{{pieces}} & ~{a(1)}")
    file = bits.either(bits.filled("{K}", True), bits.filled("{K}", False))
    on = lambda files: "({K} & {back} & " + bits.num(signed(sum((0x0101010101010101 << f) & (2**64 - 1) for f in files) & (2**64 - 1))) + ") <> 0"
    add("king", "bool", True, castled=on([1, 2, 5, 6]), castled_kingside=on([5, 6]), castled_queenside=on([1, 2]), uncastled=on([4]), center="({K} & {center}) <> 0", castle_rights_lost="(castling & IF({white}, 3, 12)) = 0", open_file=f"({{P}} & {file}) = 0", semi_open_file=f"({{P}} & {file}) = 0 AND ({{eP}} & {file}) <> 0", exposed="({P} & {s}_shield) = 0")
    add("king", "squares", True, shield="{P} & {s}_shield", missing_shield="{s}_shield & ~occ", weak_shield_pawns="{P} & {s}_shield & ({s}_iso | {s}_back)", zone="{s}_zone", escape_squares=f"{{s}}_zone & ~occ & ~{a(1, '{e}')}")
    towards = lambda who: f"aggregate(filter(sequence(0, 63), s -> (shiftrightunsigned({who}, s) & 1) = 1 AND (reach[s] & {{s}}_zone) <> 0), 0L, (m, s) -> m | shiftleft(1L, s))"
    add("king", "squares", True, attackers=towards("{enemy}"), defenders=towards("({own} & ~{K})"))
    escapes = f"bit_count({{s}}_zone & ~occ & ~{a(1, '{e}')})"
    add("king", "bool", True, limited_escapes=f"{escapes} <= 1", mating_net=f"bit_count({towards('{enemy}')}) >= 3 AND {escapes} <= 1", back_rank_weakness="({K} & {back}) <> 0 AND ((" + fore("({K} | " + bits.sides("{K}") + ")") + ") & ~occ) = 0 AND {emajor} <> 0")
    hits = lambda who, least, what: f"aggregate(filter(sequence(0, 63), s -> (shiftrightunsigned({who}, s) & 1) = 1 AND bit_count(reach[s] & {what}) >= {least}), 0L, (m, s) -> m | shiftleft(1L, s))"
    add("tactics", "squares", True, fork=hits("({P} | {N})", 2, "({enemy} & ~{eK})"), double_attack=hits("({B} | {R} | {Q} | {K})", 2, "{enemy}"), loose_piece=f"{{own}} & ~{{K}} & ~{a(1)} & {a(1, '{e}')}", hanging_piece=f"{{own}} & ~{{K}} & ~{a(1)} & {a(2, '{e}')}", deflection_possibility=hits("{enemy}", 1, "({enemy} & ~{eK})") + f" & {a(1)}", decoy_possibility=hits("{enemy}", 1, "{e}_zone"))
    add("tactics", "bool", True, double_check=f"({{K}} & {a(2, '{e}')}) <> 0")
    add("threats", "bool", True, check=f"({{K}} & {a(1, '{e}')}) <> 0")
    add("threats", "squares", True, promotion_threat="{P} & {seventh}", fork_threat=hits("({P} | {N} | {B})", 2, "({eK} | {eR} | {eQ} | {enemy})"), sacrifice_opportunity="{e}r & " + a(1, "{e}") + " & " + hits_mask("({P} | {N} | {B})") + " | ({eQ} & " + a(1, "{e}") + " & " + hits_mask("({P} | {N} | {B})") + ")")
    add("threats", "int", False, tactical_tension="bit_count(watt[0] & batt[0])")
    ek_back = "({eK} & {eback})"
    add("motifs", "bool", True, back_rank_motifs=f"({ek_back} & {fore('{eP}')}) <> 0", smothered_mate_motifs=f"({ek_back} & {bits.num(signed(0xC0C0C0C0C0C0C0C0))}) <> 0 AND ({bits.knight_attacks('{N}')} & {{e}}_zone) <> 0")
    add("motifs", "squares", True, exchange_sacrifice="({e}n | {e}b) & " + hits_mask("{R}"))
    tight = lambda wing: f"({{eK}} & {wing}) <> 0 AND bit_count({hits('{own}', 1, '{e}_zone')}) >= 3"
    passer = "{P} & IF({white}, " + bits.num(signed(0xFFFFFFFFFF << 24)) + ", 1099511627775L)"
    same_file = bits.either(bits.filled("({enemy} & ~{eK})", True), bits.filled("({enemy} & ~{eK})", False))
    add("goals", "bool", True, kingside_attack=tight("{fh}"), queenside_attack=tight("{ac}"), minority_attack="bit_count({eP} & {ac}) >= 4 AND bit_count({P} & {ac}) BETWEEN 1 AND bit_count({eP} & {ac}) - 1", double_rooks_on_file=doubled_rooks, trade_queens="{Q} <> 0 AND {eQ} <> 0 AND {s}_value - {e}_value >= 2", avoid_queen_trade="{Q} <> 0 AND {eQ} <> 0 AND {s}_value - {e}_value <= -2", activate_king="NOT (wq <> 0 AND bq <> 0) AND ({K} & {back}) <> 0",
        transfer_pieces_to_kingside="({eK} & {fh}) <> 0 AND bit_count(({minor} | {Q}) & {fh}) >= 2", transfer_pieces_to_queenside="({eK} & {ac}) <> 0 AND bit_count(({minor} | {Q}) & {ac}) >= 2", exchange_bad_piece=f"{by_conflict('>= 5')} <> 0 AND {flip(by_conflict('>= 5'))} = 0", preserve_good_piece=f"{by_conflict('<= 2')} <> 0 AND {flip(by_conflict('<= 2'))} = 0",
        exploit_color_complex_weakness="IF(({eK} & {dark}) <> 0, {e}b & {dark}, {e}b & {light}) = 0")
    add("goals", "squares", True, queenside_expansion=f"{passer} & {{ac}}", attack_isolated_pawn=f"{{e}}_iso & {a(1)}", attack_backward_pawn=f"{{e}}_sback & {a(1)}", exploit_weak_square="~occ & {half} & {s}_pat & ~{e}_pat", establish_outpost="{minor} & {s}_outpost", occupy_open_file="{R} & {s}_open", penetrate_seventh_rank="{major} & {seventh}", create_passed_pawn="{P} & ~{e}_files & ~{s}_passed", advance_passed_pawn="{s}_passed", blockade_passed_pawn="{e}_passed", pawn_break=f"({{P}} & {attacked_by('{eP}')}) | {breaks}",
        space_gaining_pawn_advance="{P} & {half} & ~{seventh}", rook_lift=f"{{R}} & IF({{white}}, {(0xFFFF << 16)}L, {(0xFFFF << 32)}L)", pressure_along_file=f"{{major}} & {same_file}", blockade_isolated_pawn=fore_enemy("{e}_iso"))
    tension = "bit_count(w_pat & b_pat & {0})"
    add("tension", "int", False, pawn_tension=tension.format("-1L"), central_tension=tension.format(CENTER), kingside_tension=tension.format(bits.num(FH)), queenside_tension=tension.format(AC), opposed_pawns=f"bit_count({bits.files_of('wp')} & {bits.files_of('bp')})", unresolved_captures="bit_count(b & ~bk & watt[0] & batt[0]) + bit_count(w & ~wk & watt[0] & batt[0])")
    add("tension", "squares", True, possible_pawn_breaks=f"({{P}} & {attacked_by('{eP}')}) | {breaks}", lever_structure=f"{{P}} & {attacked_by('({eP} & {e}_pat)')}")
    add("quality", "squares", True, good_bishop=by_conflict("<= 2"), bad_bishop=by_conflict(">= 5"), knight_outpost="{N} & {s}_outpost", active_rook="{R} & ({s}_open | {s}_semi | {seventh})", passive_rook="{R} & ~({s}_open | {s}_semi | {seventh})")
    add("quality", "bool", True, bishop_pair="bit_count({B}) = 2", strong_knight_vs_bad_bishop=f"({{N}} & {{s}}_outpost) <> 0 AND {flip(by_conflict('>= 5'))} <> 0")
    add("quality", "int", True, piece_coordination=f"bit_count({{own}} & {a(1)})", piece_harmony="CAST(aggregate(filter(sequence(0, 63), s -> (shiftrightunsigned({own}, s) & 1) = 1), 0, (n, s) -> n + bit_count(reach[s] & {own})) AS INT)")
    add("quality", "bool", False, opposite_colored_bishops=f"bit_count(wb) = 1 AND bit_count(bb) = 1 AND ((wb & {bits.num(bits.DARK)}) <> 0) <> ((bb & {bits.num(bits.DARK)}) <> 0)")
    away = "bit_count(({minor} | {major}) & ~{back})"
    add("initiative", "int", True, development_lead=f"{away} - {flip(away)}", attacking_potential="CAST(" + " + ".join(f"bit_count({{enemy}} & ~{{eK}} & {a(k)})" for k in range(1, 9)) + " AS INT)", defending_burden="CAST(" + " + ".join(f"bit_count({{own}} & ~{{K}} & {a(k, '{e}')})" for k in range(1, 9)) + " AS INT)")
    add("initiative", "bool", True, tempo_advantage=f"side = '{{s}}' AND {away} >= {flip(away)}")
    open_n = f"bit_count({bits.files_of('~(w_files | b_files) & 255')})"
    semi_n = "bit_count(((w_files | b_files) & ~(w_files & b_files)) & 255)"
    blocked = "(bit_count(wp & shiftrightunsigned(occ, 8)) + bit_count(bp & shiftleft(occ, 8)))"
    queens = "wq <> 0 AND bq <> 0"
    rest = "bit_count(wn | wb | wr) >= 3 AND bit_count(bn | bb | br) >= 3"
    add("position", "bool", False, open_position=f"{open_n} >= 3", semi_open_position=f"{open_n} < 3 AND {semi_n} >= 1", closed_position=f"{open_n} = 0 AND {semi_n} <= 1", locked_position=f"{blocked} >= 10", maneuvering_position=f"{open_n} <= 1 AND (w_pat & b_pat) = 0 AND {queens}", symmetric_position=" AND ".join(f"w{p} = {bits.flipped_ranks('b' + p)}" for p in "pnbrqk"), opposite_side_castling_position="(wk IN (64, 4611686018427387904) AND bk IN (4, 288230376151711744)) OR (wk IN (4, 288230376151711744) AND bk IN (64, 4611686018427387904))",
        queenless_middlegame=f"NOT ({queens}) AND {rest}", endgame_like_position=f"NOT ({queens}) AND w_value + b_value <= 14", material_imbalanced_position="abs(w_value - b_value) >= 2")
    add("evaluation", "int", False, material_advantage="w_value - b_value", space_advantage=f"bit_count(wp & {bits.num(HALF['w'])}) - bit_count(bp & {bits.num(HALF['b'])})", pawn_structure_advantage="3 * (bit_count(w_passed) - bit_count(b_passed)) - (bit_count(w_iso) - bit_count(b_iso)) - (bit_count(w_sback) - bit_count(b_sback))", development_advantage=f"{side_text(away, 'w')} - {side_text(away, 'b')}", defensive_strength="bit_count(w & watt[0]) - bit_count(b & batt[0])")
    # With destinations.
    n = lambda who: f"CAST(aggregate(filter(sequence(0, 63), s -> (shiftrightunsigned({who}, s) & 1) = 1), 0, (n, s) -> n + moves[s]) AS INT)"
    few = lambda who, test: f"aggregate(filter(sequence(0, 63), s -> (shiftrightunsigned({who}, s) & 1) = 1 AND moves[s] {test}), 0L, (m, s) -> m | shiftleft(1L, s))"
    add("mobility", "int", True, per_side=n("{own}"), rook_activity=n("{R}"), bishop_activity=n("{B}"), queen_activity=n("{Q}"), knight_activity=n("{N}"), king_activity=n("{K}"))
    add("mobility", "int", False, total=f"{n('w')} + {n('b')}")
    add("mobility", "squares", True, restricted=few("{pieces}", "<= 1"), trapped_piece=few("{own}", "= 0"))
    add("mobility", "other", True, active_passive=f"named_struct('active', CAST(bit_count({few('{own}', '>= 4')}) AS INT), 'passive', CAST(bit_count({few('{own}', '<= 1')}) AS INT))")
    add("placement", "squares", True, bishop_active=few("{B}", ">= 8"), bad_bishop=few("{B}", "<= 2"), good_bishop=few("{B}", ">= 6"), trapped_bishop=few("{B}", "= 0"), trapped_rook=few("{R}", "= 0"), trapped_queen=few("{Q}", "= 0"), trapped_piece=few("{pieces}", "= 0"))
    add("space", "bool", True, cramping=f"{n('{enemy}')} <= {n('{own}')} - 10")
    add("tactics", "squares", True, trapped_piece=few("({own} & ~{K})", "= 0"))
    add("motifs", "squares", True, trapped_queen=few("{eQ}", "<= 1"))
    add("goals", "squares", True, improve_worst_placed_piece=few("({own} & ~{K})", "<= 2"))
    add("evaluation", "int", False, mobility_advantage=f"{n('w')} - {n('b')}")
    return out


def hits_mask(who: str) -> str:
    """What pieces attack together."""
    return f"aggregate(filter(sequence(0, 63), s -> (shiftrightunsigned({who}, s) & 1) = 1), 0L, (m, s) -> m | reach[s])"


def flip(text: str) -> str:
    """A text for the other side."""
    for mine, other in (("P", "eP"), ("N", "eN"), ("B", "eB"), ("R", "eR"), ("Q", "eQ"), ("K", "eK"), ("own", "enemy"), ("s", "e"), ("back", "eback"), ("major", "emajor")):
        text = text.replace("{" + mine + "}", "{@" + other + "}").replace("{" + other + "}", "{" + mine + "}").replace("{@", "{")
    return text.replace("{minor}", "({e}n | {e}b)")


def fore_enemy(mask: str) -> str:
    """The squares that the other side's pieces of a mask step on."""
    return f"IF({{white}}, shiftrightunsigned({mask}, 8), shiftleft({mask}, 8))"


CATALOGUE = {f.id: f for f in _catalogue()}
CATALOGUE |= {i: Feature(i, text, kind, sided) for i, text, kind, sided in geometry.definitions({f.id: f.text for f in CATALOGUE.values()})}
MASK_KINDS = {"squares": lambda t: bits.names(f"({t})"), "int": lambda t: f"CAST({t} AS INT)", "bool": lambda t: f"({t})", "other": lambda t: f"({t})"}


def staged(positions: DataFrame) -> DataFrame:
    """Positions with masks, and all columns that features build on."""
    held = attacks.with_destinations(attacks.with_attacks(attacks.with_reach(positions)))
    held = held.withColumn("_rays", F.lit([attacks.TABLES[f"_ray{d}"] for d in range(8)]))
    for stage in [*stages(), *geometry.stages()]:
        held = held.withColumns({k: F.expr(v) for k, v in stage.items()})
    return held


#: Columns of played-out moves in a text.
_MOVED = re.compile(rf"\b(?:legal_moves|[wb]_(?:{'|'.join(geometry.FROM_MOVES)}))\b")


def rendered(f: Feature) -> str:
    """A feature's value as SQL over staged positions."""
    value = MASK_KINDS[f.kind]
    return f"named_struct('white', {value(side_text(f.text, 'w'))}, 'black', {value(side_text(f.text, 'b'))})" if f.per_side else value(f.text)


def extract(positions: DataFrame, key: str, ids: list[str] | None = None) -> DataFrame:
    """key and a column for each feature (all, or those of ids or of sections). Moves are played out, counted and joined by
    key only where a chosen feature reads them; then keys must be distinct and not null."""
    chosen = [f for f in CATALOGUE.values() if ids is None or f.id in ids or f.section in ids]
    columns = [F.expr(rendered(f)).alias(f.id) for f in chosen]
    texts = " ".join(side_text(f.text, s) if f.per_side else f.text for f in chosen for s in "wb")
    if _MOVED.search(texts):
        from ..operators import moves

        positions = spread(positions.join(moves.forcing(positions, key), key), key)
    return staged(positions).select(key, *columns)


#: Sections and features that give no atoms.
NO_ATOMS = ("similarity", "evaluation", "state.side_to_move", "state.en_passant", "state.castling_rights", "pawns.structure", "tactics.zwischenzug_possibilities")


def _tagged(name: str):
    return lambda square: F.concat(F.lit(name + ":"), square)


def atoms(vectors: DataFrame, key: str) -> DataFrame:
    """key and atom of extracted features: true ones, squares, and squares per side; numbers and structs give none."""
    parts = []
    for f in CATALOGUE.values():
        if f.id not in vectors.columns or f.section in NO_ATOMS or f.id in NO_ATOMS or f.kind not in ("bool", "squares"):
            continue
        for field, tag in (("white", ":w"), ("black", ":b")) if f.per_side else (("", ""),):
            value = F.col(f"`{f.id}`")[field] if field else F.col(f"`{f.id}`")
            name = f.id + tag
            parts.append(F.when(value, F.array(F.lit(name))) if f.kind == "bool" else F.when(F.size(value) > 0, F.concat(F.array(F.lit(name)), F.transform(value, _tagged(name)))))
    none = F.array().cast("array<string>")
    return vectors.select(key, F.explode(F.flatten(F.array(*[F.coalesce(p, none) for p in parts]))).alias("atom"))


def compared(vectors: DataFrame, key: str, other: DataFrame) -> DataFrame:
    """key, feature, equal: the features of two extractions of the same keys, side by side."""
    names = [c for c in vectors.columns if c != key]
    texts = lambda df, name: df.select(key, F.array(*[F.to_json(F.struct(F.col(f"`{c}`").alias("v"))) for c in names]).alias(name))
    both = texts(vectors, "value").join(texts(other, "other"), key)  # one row for a position, not for each of its features
    pairs = both.select(key, F.explode(F.arrays_zip(F.array(*[F.lit(c) for c in names]).alias("feature"), "value", "other")).alias("p"))
    return pairs.select(key, "p.feature", F.col("p.value").eqNullSafe(F.col("p.other")).alias("equal"))
