"""Features over lines, pins, batteries and played-out moves, as SQL like those of features.

Every slider's ray keeps its first two occupied squares (far), every two aligned
sliders of a side the squares between them (pairs); what is pinned, skewered or
discovered follows by filters over these small arrays. Features over moves read
counts per position and side that operators.moves.forcing makes.
"""

from __future__ import annotations

from . import attacks, bits
from .attacks import RAYS, signed

LEAST = "(-9223372036854775807L - 1L)"
#: Directions in the order in which the first of several relations counts: straight ones, then diagonal ones.
DIRECTIONS = (0, 4, 1, 5, 2, 7, 3, 6)
KINDS = ("rook", "bishop", "queen")
CODES = {"rook": (4, 10), "bishop": (3, 9), "queen": (5, 11)}
TYPE = "element_at(array('pawn', 'knight', 'bishop', 'rook', 'queen', 'king'), (codes[{0}] - 1) % 6 + 1)"
FILE_A, AC, FH = "72340172838076673L", "506381209866536711L", bits.num(signed(0xE0E0E0E0E0E0E0E0))
WEIGHTS = {"material": 1.0, "mobility": 0.10, "space": 0.10, "king_safety": 0.05, "initiative": 0.10, "development": 0.10, "pawn_structure": 0.10, "piece_activity": 0.05, "tactical": 0.10, "attack": 0.05, "defense": 0.05}
#: Columns from played-out moves, for each side.
FROM_MOVES = ("checks", "check_from", "captures", "capture_from", "forcing", "quiet_threats", "active")

Definition = tuple[str, str, str, bool]


def low(m: str) -> str:
    """The lowest square of a mask that isn't empty."""
    return f"IF({m} = {LEAST}, 63, CAST(bit_count(({m} & -{m}) - 1) AS INT))"


def high(m: str) -> str:
    return f"(length(bin({m})) - 1)"


def has(mask: str, s: str = "s") -> str:
    return f"(shiftrightunsigned({mask}, {s}) & 1) = 1"


def name(s: str) -> str:
    return f"concat(substr('abcdefgh', {s} % 8 + 1, 1), CAST({s} DIV 8 + 1 AS STRING))"


def gathered(rows: str, field: str) -> str:
    """The mask of a field of an array of structs."""
    return f"aggregate({rows}, 0L, (m, x) -> m | shiftleft(1L, x.{field}))"


def where(test: str) -> str:
    """The mask of the squares s that pass."""
    return f"aggregate(filter(sequence(0, 63), s -> {test}), 0L, (m, s) -> m | shiftleft(1L, s))"


def diagonals() -> list[tuple[int, str, int]]:
    """Mask, name by its ends and length, by offset of file and rank, then by their sum."""
    lines = [[8 * r + f for r in range(8) for f in range(8) if f - r == k] for k in range(-7, 8)] + [[8 * r + f for r in range(8) for f in range(8) if f + r == k] for k in range(15)]
    square = lambda s: "abcdefgh"[s % 8] + str(s // 8 + 1)
    return [(signed(sum(1 << s for s in line)), square(line[0]) + square(line[-1]), len(line)) for line in lines]


def labels(test: str, least: int = 2) -> str:
    """Names of the diagonals x.m that pass."""
    every = ", ".join(f"named_struct('m', {bits.num(m) if m >= 0 else f'CAST({bits.num(m)} AS BIGINT)'}{'L' if m >= 0 else ''}, 'n', '{n}')" for m, n, k in diagonals() if k >= least)
    return f"transform(filter(array({every}), x -> {test}), x -> x.n)"


def attackers(side: str, s: str) -> str:
    """How many pieces of a side attack a square."""
    return f"aggregate({side}att, 0, (n, a) -> n + CAST(shiftrightunsigned(a, {s}) & 1 AS INT))"


def weight_on(zone: str, side: str) -> str:
    """Attacks of a side on the squares of a zone, each as often as it is made."""
    return "CAST(" + " + ".join(f"bit_count({zone} & {side}att[{k}])" for k in range(attacks.MOST)) + " AS INT)"


def stages() -> list[dict[str, str]]:
    """Columns to be made after those of features.stages, one dictionary upon another. _rays: masks by direction and square."""
    slides = "CASE WHEN codes[s] IN (5, 11) THEN true WHEN codes[s] IN (4, 10) THEN d IN (0, 1, 4, 5) ELSE d IN (2, 3, 6, 7) END"
    order = ", ".join(map(str, DIRECTIONS))
    first = f"IF(x.d < 4, {low('x.hit')}, {high('x.hit')})"
    of_kind = lambda k: f"filter(_far, x -> codes[x.s] IN {CODES[k]})"
    out = [
        {"_hits": f"filter(flatten(transform(filter(sequence(0, 63), s -> codes[s] IN (3, 4, 5, 9, 10, 11)), s -> transform(filter(array({order}), d -> {slides}), d -> named_struct('s', s, 'd', d, 'hit', _rays[d][s] & occ)))), x -> x.hit <> 0)"},
        {"_near": f"transform(_hits, x -> named_struct('s', x.s, 'd', x.d, 'f', {first}))"},
        {"_next": "filter(transform(_near, x -> named_struct('s', x.s, 'd', x.d, 'f', x.f, 'hit', _rays[x.d][x.f] & occ)), x -> x.hit <> 0)"},
        {"_far": f"transform(_next, x -> named_struct('s', x.s, 'f', x.f, 'g', {first}))"},
        {"far": f"concat({', '.join(of_kind(k) for k in KINDS)})"},
    ]
    one: dict[str, str] = {}
    two: dict[str, str] = {}
    three: dict[str, str] = {}
    for s, e, base in (("w", "b", 0), ("b", "w", 6)):
        own = lambda x, base=base: f"codes[{x}] BETWEEN {base + 1} AND {base + 6}"
        enemy = lambda x, base=base: f"codes[{x}] BETWEEN {7 - base} AND {12 - base}"
        sliders = ", ".join(f"transform({bits.squares(s + k[0] if k != 'knight' else s + 'n')}, s -> named_struct('t', {t}, 'a', s))" for t, k in enumerate(KINDS))
        one |= {
            f"{s}_pins": f"filter(far, x -> {enemy('x.s')} AND {own('x.f')} AND codes[x.f] <> {base + 6} AND {own('x.g')})",
            f"{s}_opens": f"filter(far, x -> {own('x.s')} AND {own('x.f')} AND {enemy('x.g')})",
            f"{s}_sliders": f"concat({sliders})",
            f"{s}_kat": low(s + "k"),
            f"{s}_ring": weight_on(f"{e}_zone", s),
            f"{s}_ringk": weight_on(f"({e}_zone | {e}k)", s),
        }
        aligned = "(x.t <> 1 AND y.t <> 1 AND (x.a % 8 = y.a % 8 OR x.a DIV 8 = y.a DIV 8)) OR (x.t <> 0 AND y.t <> 0 AND abs(x.a % 8 - y.a % 8) = abs(x.a DIV 8 - y.a DIV 8))"
        between = "aggregate(sequence(0, 7), 0L, (m, d) -> m | IF((shiftrightunsigned(_rays[d][x.a], y.a) & 1) = 1, _rays[d][x.a] & ~_rays[d][y.a] & ~shiftleft(1L, y.a), 0L))"
        pair = f"named_struct('a', x.a, 'b', y.a, 't', x.t, 'u', y.t, 'straight', x.a % 8 = y.a % 8 OR x.a DIV 8 = y.a DIV 8, 'between', {between})"
        two |= {
            f"{s}_pin": gathered(f"{s}_pins", "f"),
            f"{s}_absolute": gathered(f"filter({s}_pins, x -> codes[x.g] = {base + 6})", "f"),
            f"{s}_last": f"filter({s}_opens, (x, i) -> NOT exists(slice({s}_opens, i + 2, 64), y -> y.f = x.f))",
            f"{s}_pairs": f"flatten(transform({s}_sliders, (x, i) -> transform(filter(slice({s}_sliders, i + 2, 64), y -> {aligned}), y -> {pair})))",
            f"{s}_flee": f"dest[{s}_kat] & ~{e}att[0]",
        }
        three |= {f"{s}_clear": f"filter({s}_pairs, x -> (x.between & occ) = 0)"}
    return [*out, one, two, three]


def definitions(known: dict[str, str]) -> list[Definition]:
    """Id, text, kind and whether it is per side; known: texts of features defined before. Later ones of an id replace
    those before."""
    out: list[Definition] = []

    def add(section: str, kind: str, sided: bool, /, **texts: str) -> None:
        out.extend((f"{section}.{n.replace('__', '.')}", text, kind, sided) for n, text in texts.items())

    def both(text: str, sign: str) -> str:
        """A text of a side for White, and the same for Black, joined."""
        return f"({text.replace('{s}', 'w').replace('{e}', 'b')}) {sign} ({text.replace('{s}', 'b').replace('{e}', 'w')})"

    occupied = "filter(sequence(0, 63), s -> codes[s] > 0)"
    color, kind = "IF(codes[s] < 7, 'white', 'black')", TYPE.format("s")
    add("state", "other", False, pieces=f"transform({occupied}, s -> named_struct('square', {name('s')}, 'color', {color}, 'type', {kind}))")
    types = {"pawn": "P", "knight": "N", "bishop": "B", "rook": "R", "queen": "Q", "king": "K"}
    add("state", "other", True, piece_occupancy="named_struct(" + ", ".join(f"'{t}', {bits.names('{' + p + '}')}" for t, p in types.items()) + ")")
    add("material", "other", False, value_ratio__per_type="named_struct(" + ", ".join(f"'{t}', bit_count(w{p}) / nullif(CAST(bit_count(w{p}) + bit_count(b{p}) AS DOUBLE), 0D)" for t, p in (("pawn", "p"), ("knight", "n"), ("bishop", "b"), ("rook", "r"), ("queen", "q"))) + ")")

    file = f"shiftleft({FILE_A}, f)"
    add("pawns", "other", True, structure=f"transform(sequence(0, 7), f -> filter(sequence(0, 7), r -> {has('{P}', '8 * r + f')}))")
    beside = bits.sides("shiftleft(1L, s)")
    inner = str(sum(0x0101010101010101 << f for f in range(2, 6)))
    add("pawns", "squares", True, tripled=f"aggregate(sequence(0, 7), 0L, (m, f) -> m | IF(bit_count({{P}} & {file}) >= 3, {{P}} & {file}, 0L))", hanging=where(f"{has('{P}')} AND s % 8 BETWEEN 2 AND 5 AND ({beside} & {{P}} & {inner}) <> 0 AND bit_count({{P}} & shiftleft({AC}, s % 8 - 1)) = 2"))
    slant = bits.sides("(shiftleft(m, 8) | shiftrightunsigned(m, 8))")
    component = f"aggregate(sequence(1, 7), shiftleft(1L, s), (m, i) -> m | ({slant} & {{P}}))"
    turned = lambda c: f"transform(array_sort(transform({bits.squares(c).replace('s ->', 'q ->').replace(', s)', ', q)')}, q -> CAST(q ^ IF({{white}}, 0, 56) AS INT))), q -> CAST(q ^ IF({{white}}, 0, 56) AS INT))"
    chains = f"transform(filter(array_distinct(transform({bits.squares('{P}')}, s -> {component})), c -> bit_count(c) > 1), c -> transform({turned('c')}, q -> {name('q')}))"
    add("pawns", "other", True, chains=f"array_sort({chains})", chain_bases=f"array_sort(transform({chains}, c -> c[0]))")
    gaps = f"flatten(transform(sequence(0, 7), f -> flatten(transform(filter(sequence(0, 7), r -> {has('wp', '8 * r + f')}), r -> transform(filter(sequence(0, 7), q -> {has('bp', '8 * q + f')}), q -> abs(r - q))))))"
    add("pawns", "other", False, structure_gap=f"round(aggregate({gaps}, 0, (n, x) -> n + x) * 100D / nullif(size({gaps}), 0)) / 100")
    gone, come = f"(wp & ~{bits.flipped_ranks('bp')})", f"({bits.flipped_ranks('bp')} & ~wp)"
    add("pawns", "bool", False, single_rank_shift=f"bit_count{gone} = 1 AND bit_count{come} = 1 AND (shiftleft{gone[:-1]}, 8) = {come} OR shiftrightunsigned{gone[:-1]}, 8) = {come})", color_mirrored=f"wp = {bits.flipped_files(bits.flipped_ranks('bp'))}")

    add("placement", "other", False, piece_on_square=f"map_from_entries(transform({occupied}, s -> struct({name('s')}, concat({color}, ' ', {kind}))))", type_at_square=f"map_from_entries(transform({occupied}, s -> struct({name('s')}, {kind})))")
    seen = lambda who: f"aggregate(filter(sequence(0, 63), s -> {has(who)}), 0L, (m, s) -> m | reach[s])"
    joined = f"({seen('{R}')} & {{R}}) <> 0"
    add("placement", "bool", True, connected_rooks=joined)
    per_square = lambda value, test: f"map_from_entries(transform(filter(sequence(0, 63), s -> {has('{own}')} AND {test}), s -> struct({name('s')}, {value})))"
    add("mobility", "other", True, per_piece=per_square("CAST(moves[s] AS INT)", "moves[s] > 0"), available_squares=per_square("CAST(bit_count(dest[s]) AS INT)", "dest[s] <> 0"))
    developed = known["mobility.development"]
    add("mobility", "int", False, legal_moves="legal_moves", development_advantage=f"({side(developed, 'w')}) - ({side(developed, 'b')})")
    weak = f"({known['squares.weak']})"
    add("squares", "other", True, weakness_duration=f"named_struct('permanent', {bits.names(f'({weak} & {{e}}att[1])')}, 'temporary', {bits.names(f'({weak} & ~{{e}}att[1])')})")

    add("lines", "other", True, open_diagonals=labels("(x.m & {P}) = 0"), semi_open_diagonals=labels("(x.m & {P}) = 0 AND (x.m & {eP}) <> 0"), long_diagonals=labels("(x.m & {P}) = 0", 5))
    files = lambda who, test: f"exists(sequence(0, 63), s -> {has(who)} AND {test})"
    own_file = f"shiftleft({FILE_A}, s % 8)"
    cross = f"(reach[s] & ({own_file} | shiftleft(255L, CAST(s DIV 8 * 8 AS INT))))"
    crossing = lambda who: f"size(filter(sequence(0, 63), s -> {has(who)} AND ({cross} & {file}) <> 0)) >= 3"
    clear = lambda test: f"exists({{s}}_clear, x -> {test})"
    add("lines", "squares", True, bishop_open_diagonals=f"{seen('{B}')} & ~occ")
    add("lines", "bool", True, open_file_control=files("{major}", f"({{P}} & {own_file}) = 0 AND bit_count(reach[s] & {own_file}) >= 4"), contested_files=f"exists(sequence(0, 7), f -> {crossing('{major}')} AND {crossing('{emajor}')})",
        battery_on_file=clear("x.straight AND x.a % 8 = x.b % 8"), battery_on_diagonal=clear("NOT x.straight"), queen_rook_battery=clear("x.straight AND x.t = 0 AND x.u = 2"), queen_bishop_battery=clear("NOT x.straight AND x.t = 1 AND x.u = 2"),
        bishop_battery=clear("NOT x.straight AND x.t = 1 AND x.u = 1"), xray="exists({s}_pairs, x -> (x.between & {own}) <> 0)")

    count = lambda s="s": attackers("{s}", s)
    add("attacks", "other", True, defenders_per_square=f"map_from_entries(transform(filter(sequence(0, 63), s -> {has('({own} & {s}att[0])')}), s -> struct({name('s')}, {count()})))",
        force_ratio=f"round(aggregate(transform(filter(sequence(0, 63), s -> {has('({own} & {s}att[0] & {e}att[0])')}), s -> {attackers('{e}', 's')} / CAST({count()} AS DOUBLE)), 0D, (n, x) -> n + x) * 100 / nullif(CAST(bit_count({{own}} & {{s}}att[0] & {{e}}att[0]) AS DOUBLE), 0D)) / 100",
        pressure_piece=f"transform(array(array_max(transform(filter(sequence(0, 63), s -> {has('({enemy} & {s}att[0])')}), s -> named_struct('n', {count()}, 'm', -s)))), x -> {name('(-x.m)')})[0]")

    worth = lambda mask: "CAST(" + " + ".join(f"{v} * bit_count({mask} & {{e}}{p})" for p, v in (("p", 1), ("n", 3), ("b", 3), ("r", 5), ("q", 9))) + " AS INT)"
    ring = lambda k: f"bit_count({known['king.' + k]})"
    safety = f"{ring('defenders')} - 2 * {ring('attackers')} - 2 * {ring('missing_shield')} + IF({known['king.castled']}, 3, 0)"
    wing = "CASE WHEN (castling & IF({white}, 3, 12)) <> IF({white}, 3, 12) THEN 0 WHEN {s}_kat % 8 IN (5, 6) THEN 1 WHEN {s}_kat % 8 IN (1, 2) THEN 2 ELSE 0 END"
    add("king", "other", True, open_diagonal=f"array_sort({labels('(x.m & {K}) <> 0 AND (x.m & {P}) = 0', 1)})")
    add("king", "int", True, attack_power=worth(f"({known['king.attackers']})"))
    add("king", "int", False, safety_advantage=f"({side(safety, 'w')}) - ({side(safety, 'b')})")
    add("king", "bool", False, opposite_side_castling=f"({side(wing, 'w')}) + ({side(wing, 'b')}) = 3")

    shown = gathered("{s}_last", "f")
    onto = lambda codes: gathered(f"filter({{s}}_last, x -> codes[x.g] IN ({codes}))", "f")
    sole = where(f"{has('{enemy}')} AND (reach[s] & {{e}}att[0] & ~{{e}}att[1]) <> 0") + " & {s}att[0]"
    attacked = where(f"{has('{enemy}')} AND reach[s] <> 0") + " & {s}att[0]"
    spans = lambda pairs: f"aggregate({pairs}, 0L, (m, x) -> m | x.between)"
    add("tactics", "squares", True, pin="{s}_pin", absolute_pin="{s}_absolute", relative_pin="{s}_pin & ~{s}_absolute", skewer="{s}_pin", discovered_attack=shown, discovered_check=onto("6, 12"), xray_attack=gathered("{s}_last", "g"),
        overloaded_piece=known["attacks.overloaded"], deflection_possibility=attacked, removal_of_defender=sole, interference=spans("{e}_pairs"), clearance=f"{spans('{s}_pairs')} & occ")
    moves_n = known["mobility.per_side"]
    add("tactics", "bool", True, battery="size({s}_clear) > 0", zwischenzug_possibilities=f"{{s}}_forcing > 0 AND {moves_n} > {{s}}_forcing")

    add("threats", "int", True, aantal_checks="{s}_checks", capture_threats="{s}_captures", aantal_forcing_moves="{s}_forcing", check_capture_threat_moves="{s}_active")
    add("threats", "squares", True, checks="{s}_check_from", captures="{s}_capture_from", discovered_attack_threat=onto("4, 5, 10, 11"), pin_exploitation="{e}_absolute")
    add("threats", "bool", True, mate_threat="{s}_checks > 0 AND bit_count({e}_flee) <= 1", mating_net="{s}_ring >= 3 AND bit_count({e}_flee) <= 1")
    add("threats", "other", True, forcing_move_density=f"round({{s}}_forcing / nullif(CAST({moves_n} AS DOUBLE), 0D), 2)")

    h = "IF({white}, 55, 15)"
    gift = lambda who: f"{{e}}_kat % 8 = 6 AND {has('{eP}', h)} AND {has(seen(who), h)}"
    mating = "exists({s}_clear, x -> x.t <> x.u AND x.t <> 1 AND x.u <> 1 AND ((reach[x.a] | reach[x.b]) & ({e}_zone | {eK})) <> 0)"
    add("motifs", "bool", True, greek_gift=gift("{B}"), rook_sacrifice_against_king=gift("{R}"), clearance_sacrifice=f"({onto('6, 12')} & {{P}}) <> 0", mating_battery=mating)
    add("motifs", "squares", True, deflection=attacked, overloaded_defender=known["attacks.overloaded"])
    add("motifs", "int", True, f2_f7_attack=attackers("{s}", "IF({white}, 53, 13)"))
    storm = f"IF({{e}}_kat % 8 > 4, {FH}, IF({{e}}_kat % 8 < 3, {AC}, {AC} | {FH}))"
    slants = " | ".join(f"_rays[{d}][s]" for d, (f, r) in enumerate(RAYS) if f and r)
    add("goals", "bool", True, central_attack=f"{weight_on('{key}', '{s}')} >= 2", pawn_storm=f"bit_count({{P}} & {{half}} & {storm}) >= 3", kingside_attack="({eK} & {fh}) <> 0 AND {s}_ringk >= 3", queenside_attack="({eK} & {ac}) <> 0 AND {s}_ringk >= 3")
    add("goals", "squares", True, pressure_along_diagonal=where(f"{has('({B} | {Q})')} AND (({slants}) & {{enemy}} & ~{{eK}}) <> 0"))
    mutual = f"bit_count({where(has('{own}') + ' AND (reach[s] & {enemy}) <> 0')} & {{e}}att[0])"
    add("tension", "int", False, mutually_attacked_pieces=f"{side(mutual, 'w')} + {side(mutual, 'b')}")
    add("tension", "other", False, static_versus_dynamic=f"named_struct('type', IF({known['tension.pawn_tension']} > 0 OR {known['tension.unresolved_captures']} > 0, 'dynamic', 'static'))")

    bishops = bits.squares("{B}")
    pieces = bits.squares("({own} & ~{K})")
    best = f"array_max(transform({pieces}, s -> named_struct('n', bit_count(dest[s]), 'm', -s))).m"
    worst = f"array_min(transform({pieces}, s -> named_struct('n', bit_count(dest[s]), 'm', s))).m"
    rooks = f"(bit_count({{R}}) = 2 AND {joined})"
    add("quality", "other", True, bishop_pawn_color_conflict=f"transform({bishops}, s -> CAST(bit_count({{P}} & IF((s % 8 + s DIV 8) % 2 = 0, {{dark}}, {{light}})) AS INT))", batteries=f"transform({{s}}_clear, x -> array({name('x.a')}, {name('x.b')}))",
        best_worst_placed=f"IF(({{own}} & ~{{K}}) = 0, CAST(array() AS ARRAY<STRING>), transform(array(-{best}, {worst}), s -> {name('s')}))")
    add("quality", "int", True, queen_activity=f"CAST(aggregate({bits.squares('{Q}')}, 0, (n, s) -> n + bit_count(dest[s])) AS INT)")
    add("quality", "bool", True, connected_rooks=rooks, rooks_cut_off=f"bit_count({{R}}) >= 2 AND NOT {rooks}")
    add("quality", "squares", True, poorly_placed_piece=where(f"{has('({own} & ~{K})')} AND bit_count(dest[s]) <= 1"))

    pressure = f"({{s}}_checks + {{s}}_captures + bit_count({known['tactics.fork']}))"
    potential = f"({pressure} + 2 * bit_count({{s}}_pin))"
    attack = known["initiative.attacking_potential"]
    value, enemy_value = "{s}_value", "{e}_value"
    flipped = lambda text: swapped(text)
    add("initiative", "bool", True, initiative=f"{pressure} > {flipped(pressure)}", attacking_momentum="{s}_ringk >= 3 AND {e}_ringk = 0", dynamic_compensation=f"{value} - ({enemy_value}) <= -2 AND {attack} > {flipped(attack)}",
        positional_compensation=f"{value} - ({enemy_value}) <= -1 AND {moves_n} - {flipped(moves_n)} >= 4", sacrifice_compensation=f"{value} - ({enemy_value}) <= -1 AND ({{s}}_pin <> 0 OR {where(has('({enemy} & ~{eK})') + ' AND moves[s] = 0')} <> 0)")
    add("initiative", "int", True, tactical_potential=f"CAST({potential} AS INT)", ability_to_create_threats="{s}_quiet_threats")
    add("initiative", "other", True, forcing_move_density=f"round(coalesce({{s}}_forcing / nullif(CAST({moves_n} AS DOUBLE), 0D), 0D), 3)")
    tense = known["tension.pawn_tension"]
    shelter = "bit_count(" + bits.files_of("{P}") + " & shiftright(shiftleft(7, {s}_kat % 8), 1) & 255) <= 1"
    add("position", "bool", False, locked_position="2 * bit_count(shiftleft(wp, 8) & bp) >= 10", tactical_position=f"{tense} >= 2 OR w_checks + w_captures + b_checks + b_captures >= 3", quiet_position=f"w_checks + w_captures + b_checks + b_captures = 0 AND {tense} = 0",
        sharp_position=f"wq <> 0 AND bq <> 0 AND {tense} > 0 AND {side(shelter, 'w')} AND {side(shelter, 'b')}", asymmetric_position=f"NOT ({known['position.symmetric_position']})")

    less = lambda text: f"(({side(text, 'w')}) - ({side(text, 'b')}))"
    parts = {k: f"({known[f'evaluation.{k}_advantage']})" for k in ("material", "mobility", "space", "development", "pawn_structure")} | {
        "king_safety": both("{s}_ringk", "-"), "attack": both("{s}_ringk", "-"), "initiative": less(pressure), "tactical": less(potential), "piece_activity": less(f"({moves_n}) + ({attack})"), "defense": f"({known['evaluation.defensive_strength']})",
    }
    add("evaluation", "int", False, **{f"{k}_advantage": parts[k] for k in ("king_safety", "initiative", "piece_activity", "tactical")}, attack_strength=parts["attack"])
    whole = lambda names: "round(" + " + ".join(f"{WEIGHTS[k]}D * ({parts[k]})" for k in names) + ", 2)"
    total, rest = whole(WEIGHTS), whole([k for k in WEIGHTS if k != "material"])
    add("evaluation", "other", False, total_evaluation=total, positional_advantage=rest, compensation=rest)
    add("evaluation", "other", True, winning_drawing_losing=f"CASE WHEN IF({{white}}, 1, -1) * {total} >= 1.5D THEN 'winning' WHEN IF({{white}}, 1, -1) * {total} <= -1.5D THEN 'losing' ELSE 'drawing' END")
    return out


def side(text: str, s: str) -> str:
    from .features import side_text

    return side_text(text, s)


def swapped(text: str) -> str:
    from .features import flip

    return flip(text)
