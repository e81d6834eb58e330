"""Common table expressions of the SQL twins over the derived scene. Each builds on those before it."""

from __future__ import annotations

from trackscan.config import CORE, EXPANDED, Bounds
from trackscan.fixtures import scene_sql
from trackscan.functions.exprs import FOREST as TREES
from trackscan.functions.exprs import THRESHOLD, number

FK = "source_id, frame_index"


def lq(values: str, q: str) -> str:
    """The lower quantile of a list."""
    return f"list_sort({values})[CAST(floor((len({values}) - 1) * {q}) AS BIGINT) + 1]"


T = scene_sql()
BIN = f"""{T}, bin AS (SELECT *, CAST(floor((s - 2e0) / 2e0) AS BIGINT) AS station, CAST(floor((xd + 4e0) / 4e-2) AS BIGINT) AS cell FROM (
  SELECT {FK}, source_index, CAST(x AS DOUBLE) AS xd, -CAST(y AS DOUBLE) AS s, CAST(z AS DOUBLE) AS zd FROM t) WHERE s >= 2e0 AND s < 80e0 AND xd >= -4e0 AND xd < 4e0)"""
FLOORS = f"""{BIN}, cells AS (SELECT {FK}, station, cell, list(zd) AS zs, count(*) AS n FROM bin GROUP BY ALL),
lows AS (SELECT {FK}, station, list(CASE WHEN n >= 2 THEN {lq('zs', '1e-1')} END) FILTER (n >= 2) AS lows FROM cells GROUP BY ALL),
floors AS (SELECT {FK}, station, {lq('lows', '2e-1')} AS floor FROM lows)"""
HEADS = f"""{FLOORS}, band AS (SELECT b.*, floor FROM bin b JOIN floors f USING ({FK}, station) WHERE zd >= floor - 35e-2 AND zd <= floor + 7e-1),
hz AS (SELECT {FK}, station, cell, list(zd) AS zs FROM band GROUP BY ALL HAVING count(*) >= 2),
heads AS (SELECT {FK}, station, cell, {lq('zs', '9e-1')} AS height FROM hz)"""
PROM = f"""{HEADS}, flanks AS (SELECT *, list(height) OVER (w RANGE BETWEEN 8 PRECEDING AND 3 PRECEDING) AS lh, list(height) OVER (w RANGE BETWEEN 3 FOLLOWING AND 8 FOLLOWING) AS rh
  FROM heads WINDOW w AS (PARTITION BY {FK}, station ORDER BY cell)),
prom AS (SELECT * FROM (SELECT {FK}, station, cell, height, least(height - {lq('lh', '5e-1')}, height - {lq('rh', '5e-1')}) AS prominence FROM flanks WHERE len(lh) >= 2 AND len(rh) >= 2)
  WHERE prominence BETWEEN 65e-3 AND 4e-1)"""
PEAKS = f"""{PROM}, near AS (SELECT b.*, height, prominence, 2e0 + (station + 5e-1) * 2e0 AS s0 FROM band b JOIN prom USING ({FK}, station, cell) WHERE zd >= height - 25e-3),
nx AS (SELECT {FK}, station, cell, list(xd) AS xs FROM near GROUP BY ALL),
mid AS (SELECT {FK}, station, cell, {lq('xs', '5e-1')} AS px FROM nx),
peaks AS (SELECT {FK}, station, cell, s0 AS s, px AS x, height AS z, prominence, source_index, CAST(xd AS FLOAT) AS ox, CAST(-s AS FLOAT) AS oy, CAST(zd AS FLOAT) AS oz FROM (
  SELECT *, row_number() OVER (PARTITION BY {FK}, station, cell ORDER BY abs(xd - px) + abs(s - s0) * 1e-2, source_index) AS rn FROM near JOIN mid USING ({FK}, station, cell)) WHERE rn = 1)"""
SEPARATE = f"""{PEAKS}, folded AS (SELECT {FK}, station, list_reduce(list([{{'x': x, 'z': z, 's': s, 'cell': cell, 'ox': ox, 'oy': oy, 'oz': oz}}] ORDER BY -prominence, cell),
  lambda acc, p: CASE WHEN len(list_filter(acc, lambda a: abs(a.x - p[1].x) <= 22e-2)) > 0 THEN acc ELSE list_concat(acc, p) END) AS ps FROM peaks GROUP BY ALL),
sep AS (SELECT {FK}, station, unnest(ps) AS p FROM folded)"""
PAIRS = f"""{SEPARATE}, pairs AS (SELECT a.source_id, a.frame_index, a.station, a.p.s AS s, a.p.x AS l, b.p.x AS r, a.p.z AS lz, b.p.z AS rz,
  a.p.ox AS lx, a.p.oy AS ly, a.p.oz AS lzz, b.p.ox AS rx, b.p.oy AS ry, b.p.oz AS rzz
  FROM sep a JOIN sep b ON a.source_id = b.source_id AND a.frame_index = b.frame_index AND a.station = b.station
  WHERE b.p.x > a.p.x AND b.p.x - a.p.x BETWEEN 14e-1 AND 18e-1 AND abs(b.p.z - a.p.z) <= 25e-2), fks AS (SELECT DISTINCT {FK} FROM t)"""

_NODE = "'s': {p}s, 'l': {p}l, 'r': {p}r, 'lz': {p}lz, 'rz': {p}rz, 'lx': {p}lx, 'ly': {p}ly, 'lzz': {p}lzz, 'rx': {p}rx, 'ry': {p}ry, 'rzz': {p}rzz"
_SLOPE = "greatest(abs(n[1].l - p.l), abs(n[1].r - p.r), abs(n[1].lz - p.lz), abs(n[1].rz - p.rz)) / (n[1].s - p.s)"
#: The chains by folding nodes in order; needs CTEs `pairs` and `fks`.
CHAIN = f"""facts AS (SELECT {FK}, count(DISTINCT station) AS pair_stations, max(n) AS most_pairs FROM (SELECT {FK}, station, count(*) AS n FROM pairs GROUP BY ALL) GROUP BY ALL),
searched AS (SELECT p.* FROM pairs p JOIN facts USING ({FK}) WHERE pair_stations >= 6 AND most_pairs <= 8),
dp AS (SELECT {FK}, list_reduce(list([{{{_NODE.format(p='')}, 'idx': 0, 'score': 1, 'cost': 0e0, 'prev': -1}}] ORDER BY station, l, r),
  lambda acc, n: list_concat(acc, list_transform([list_max(list_transform(list_filter(acc, lambda p: n[1].s - p.s > 0 AND n[1].s - p.s <= 6e0 AND {_SLOPE} <= 12e-2),
    lambda p: {{'score': p.score + 1, 'gain': -(p.cost + ({_SLOPE}) / 12e-2 + (n[1].s - p.s - 2e0) / 2e0), 'back': -p.idx}}))],
    lambda b: {{{_NODE.format(p='n[1].')}, 'idx': CAST(len(acc) AS INTEGER), 'score': CAST(coalesce(b.score, 1) AS INTEGER), 'cost': coalesce(-b.gain, 0e0), 'prev': CAST(coalesce(-b.back, -1) AS INTEGER)}}))) AS nodes
  FROM searched GROUP BY ALL),
bests AS (SELECT {FK}, nodes, list_max(list_transform(list_filter(nodes, lambda n: n.score >= 6), lambda n: {{'score': n.score, 'gain': -n.cost, 'back': -n.idx}})) AS best FROM dp),
chains AS (SELECT *, list_reduce(list_concat([[nodes[-best.back + 1]]], list_transform(list_reverse(nodes), lambda n: [n])),
  lambda acc, n: CASE WHEN n[1].idx = acc[1].prev THEN list_concat(n, acc) ELSE acc END) AS chain FROM bests WHERE best IS NOT NULL),
spans AS (SELECT {FK}, nodes, best, chain, len(chain) AS supported, chain[-1].s - chain[1].s AS span, len(chain) / ((chain[-1].s - chain[1].s) / 2e0 + 1e0) AS coverage FROM chains),
rivals AS (SELECT {FK}, r, chain, list_reduce(list_concat([[r]], list_transform(list_reverse(nodes), lambda n: [n])), lambda acc, n: CASE WHEN n[1].idx = acc[1].prev THEN list_concat(n, acc) ELSE acc END) AS other
  FROM (SELECT {FK}, nodes, chain, unnest(list_filter(nodes, lambda n: n.idx <> -best.back AND n.score >= best.score * 85e-2)) AS r FROM spans WHERE span >= 10e0 AND coverage >= 65e-2)),
moved AS (SELECT {FK}, r.idx AS idx, coalesce(list_max(list_transform(list_filter(list_transform(range(1, len(chain) + 1), lambda i: list_filter(other, lambda o: abs(o.s - chain[i].s) <= 1e-6)), lambda h: len(h) > 0),
    lambda h: abs((h[1].l + h[1].r) * 5e-1 - list_transform(list_filter(chain, lambda c: abs(c.s - h[1].s) <= 1e-6), lambda c: (c.l + c.r) * 5e-1)[1]))),
    abs((r.l + r.r) * 5e-1 - (chain[-1].l + chain[-1].r) * 5e-1)) AS displacement FROM rivals),
apart AS (SELECT {FK}, arg_min(displacement, idx) AS displacement FROM moved WHERE displacement > 7e-1 GROUP BY ALL),
rails AS (SELECT {FK}, coalesce(pair_stations, 0) AS pair_stations, CASE WHEN coalesce(pair_stations, 0) < 6 THEN 'INSUFFICIENT_PAIRED_RAIL_SUPPORT' WHEN most_pairs > 8 THEN 'SEARCH_BUDGET_EXCEEDED'
    WHEN s.best IS NULL THEN 'INSUFFICIENT_LOCALLY_CONTINUOUS_PAIR_SUPPORT' WHEN NOT (span >= 10e0 AND coverage >= 65e-2) THEN 'INSUFFICIENT_CONTIGUOUS_COVERAGE'
    WHEN displacement IS NOT NULL THEN 'AMBIGUOUS_LOCAL_CONTINUITY_PATH' ELSE 'PAIRED_RAISED_LOCAL_CONTINUITY_PATH' END AS reason, supported, s.best, span, coverage, chain, displacement
  FROM fks LEFT JOIN facts USING ({FK}) LEFT JOIN spans s USING ({FK}) LEFT JOIN apart USING ({FK}))"""
RAILS = f"{PAIRS}, {CHAIN}"


def _near(lines: str, name: str) -> str:
    """CTE `name`: of each seed and station the pair nearest to the seed's lines, if near enough."""
    off = ", ".join(f"abs({c} - ({c}0 + {c}1 * s)) / 1e-1" for c in ("l", "r", "lz", "rz"))
    return f"""{name}_off AS (SELECT m.source_id, m.frame_index, seed, e.* EXCLUDE (source_id, frame_index), greatest({off}) AS error FROM {lines} m JOIN each_pair e USING ({FK})),
{name} AS (SELECT {FK}, seed, station, arg_min(k, {{'error': error, 'k': k}}) AS k FROM {name}_off WHERE error <= 1 GROUP BY ALL),
{name}_rows AS (SELECT n.*, e.* EXCLUDE (source_id, frame_index, station, k) FROM {name} n JOIN each_pair e USING ({FK}, station, k))"""


def _lines(keys: str) -> str:
    return f"{FK}, {keys}, count(*) AS held, " + ", ".join(f"coalesce(regr_slope({c}, s), 0e0) AS {c}1, avg({c}) - coalesce(regr_slope({c}, s), 0e0) * avg(s) AS {c}0" for c in ("l", "r", "lz", "rz"))


_FIELDS = ("l", "r", "lz", "rz")
_VALUE = {(c, at): f"({c}0 + {c}1 * {at})" for c in _FIELDS for at in ("first_s", "last_s")}
#: The alternative method: lines through two pairs, fitted twice to the pairs near them; needs PAIRS.
STRAIGHT = f"""{PAIRS}, each_pair AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {FK}, station ORDER BY l, r) AS k FROM pairs),
facts AS (SELECT {FK}, count(*) AS pair_stations, max(n) AS most_pairs FROM (SELECT {FK}, station, count(*) AS n FROM pairs GROUP BY ALL) GROUP BY ALL),
duos AS (SELECT a.source_id, a.frame_index, row_number() OVER (PARTITION BY a.source_id, a.frame_index ORDER BY a.station, a.k, b.station, b.k) AS seed, a.s AS sa, {', '.join(f'(b.{c} - a.{c}) / (b.s - a.s) AS {c}1, a.{c} AS {c}a' for c in _FIELDS)}
  FROM each_pair a JOIN each_pair b USING ({FK}) WHERE (b.station - a.station) * 2e0 >= 1e1),
tried AS (SELECT {FK}, count(*) AS seeds FROM duos GROUP BY ALL),
within_budget AS (SELECT {FK} FROM facts LEFT JOIN tried USING ({FK}) WHERE pair_stations >= 6 AND most_pairs <= 8 AND coalesce(seeds, 0) <= 10000),
lines1 AS (SELECT {FK}, seed, {', '.join(f'{c}1, {c}a - {c}1 * sa AS {c}0' for c in _FIELDS)} FROM duos JOIN within_budget USING ({FK}) WHERE greatest({', '.join(f'abs({c}1)' for c in _FIELDS)}) <= 12e-2),
{_near('lines1', 'near1')}, lines2 AS (SELECT {_lines('seed')} FROM near1_rows GROUP BY {FK}, seed HAVING count(*) >= 6),
{_near('lines2', 'near2')}, gaps AS (SELECT *, s - lag(s) OVER (PARTITION BY {FK}, seed ORDER BY s) AS gap, count(*) OVER (PARTITION BY {FK}, seed) AS total FROM near2_rows),
parted AS (SELECT *, sum(CASE WHEN gap > 6e0 THEN 1 ELSE 0 END) OVER (PARTITION BY {FK}, seed ORDER BY s) AS run FROM gaps WHERE total >= 6),
lines3 AS (SELECT {_lines('seed, run')}, min(s) AS first_s, max(s) AS last_s FROM parted GROUP BY {FK}, seed, run HAVING count(*) >= 6),
residuals AS (SELECT {FK}, seed, run, max(greatest({', '.join(f'abs({c} - ({c}0 + {c}1 * s))' for c in _FIELDS)})) AS worst, sqrt(sum({' + '.join(f'({c} - ({c}0 + {c}1 * s)) * ({c} - ({c}0 + {c}1 * s))' for c in _FIELDS)}) / (count(*) * 4)) AS rms FROM parted JOIN lines3 USING ({FK}, seed, run) GROUP BY ALL),
sound AS MATERIALIZED (SELECT *, last_s - first_s AS span, sqrt(1e0 + (l1 + r1) * (l1 + r1) / 4e0) AS tilt FROM lines3 JOIN residuals USING ({FK}, seed, run)
  WHERE last_s - first_s >= 1e1 AND held / ((last_s - first_s) / 2e0 + 1e0) >= 65e-2 AND abs(l1 - r1) * (last_s - first_s) <= 1e-1 AND greatest({', '.join(f'abs({c}1)' for c in _FIELDS)}) <= 12e-2 AND worst <= 1e-1 AND rms <= 55e-3),
usable AS (SELECT * FROM sound WHERE {' AND '.join(f'({_VALUE["r", at]} - {_VALUE["l", at]}) / tilt BETWEEN 14e-1 AND 18e-1 AND abs({_VALUE["rz", at]} - {_VALUE["lz", at]}) <= 25e-2' for at in ('first_s', 'last_s'))}),
top_line AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {FK} ORDER BY held DESC, rms, seed, run) AS place FROM usable) WHERE place = 1),
far_lines AS (SELECT u.source_id, u.frame_index, max(greatest({', '.join(f'abs((u.{c}0 + u.{c}1 * b.{at}) - (b.{c}0 + b.{c}1 * b.{at}))' for c in ('l', 'r') for at in ('first_s', 'last_s'))})) AS displacement FROM usable u JOIN top_line b USING ({FK}) WHERE u.held >= b.held * 85e-2 GROUP BY ALL),
rails AS (SELECT {FK}, CASE WHEN coalesce(pair_stations, 0) < 6 THEN 'INSUFFICIENT_PAIRED_RAIL_SUPPORT' WHEN most_pairs > 8 OR coalesce(seeds, 0) > 10000 THEN 'SEARCH_BUDGET_EXCEEDED'
    WHEN held IS NULL THEN 'NO_STRAIGHT_CONSISTENT_PAIR' WHEN displacement > 7e-1 THEN 'AMBIGUOUS_RAIL_PAIRS' ELSE 'PAIRED_RAISED_LINEAR_RIDGES' END AS reason, held, rms, first_s, last_s, seed, run
  FROM fks LEFT JOIN facts USING ({FK}) LEFT JOIN tried USING ({FK}) LEFT JOIN top_line USING ({FK}) LEFT JOIN far_lines USING ({FK})),
observed AS MATERIALIZED (SELECT {FK}, p.s, p.lx, p.ly, p.lzz AS lz, p.rx, p.ry, p.rzz AS rz FROM rails r JOIN parted p USING ({FK}, seed, run) WHERE reason = 'PAIRED_RAISED_LINEAR_RIDGES')"""
OBSERVED = f"""{RAILS}, observed AS (SELECT {FK}, c.s AS s, c.lx, c.ly, c.lzz AS lz, c.rx, c.ry, c.rzz AS rz FROM (SELECT {FK}, unnest(chain) AS c FROM rails WHERE reason = 'PAIRED_RAISED_LOCAL_CONTINUITY_PATH'))"""


def centred(source: str) -> str:
    return f"SELECT *, CAST(CAST(lx + rx AS DOUBLE) * 5e-1 AS FLOAT) AS cx, CAST(CAST(ly + ry AS DOUBLE) * 5e-1 AS FLOAT) AS cy, CAST(CAST(lz + rz AS DOUBLE) * 5e-1 AS FLOAT) AS cz FROM {source}"


def tangent(source: str, target: str = "80e0") -> str:
    """CTEs `axis_pairs`: source pairs (lx .. rz) and one more at the target."""
    move = lambda side, a: f"CAST({side}{a} + (CAST(c{a} AS DOUBLE) - pb{a}) * scale AS FLOAT)"
    return f"""mids AS ({centred(source)}), tails AS (SELECT *, lag(s) OVER w AS bs, lag(cx) OVER w AS pbx, lag(cy) OVER w AS pby, lag(cz) OVER w AS pbz, row_number() OVER (PARTITION BY {FK} ORDER BY s DESC) AS back
  FROM mids WINDOW w AS (PARTITION BY {FK} ORDER BY s)),
axis_pairs AS (SELECT {FK}, s, lx, ly, lz, rx, ry, rz FROM {source} UNION ALL SELECT {FK}, {target}, {', '.join(move(side, a) for side in 'lr' for a in 'xyz')}
  FROM (SELECT *, ({target} - s) / (s - bs) AS scale FROM tails WHERE back = 1 AND bs IS NOT NULL AND s + 1e-6 < {target}))"""


#: Segments of CTE `axis_pairs`.
SEGMENTS = f"""apm AS ({centred('axis_pairs')}), nexts AS (SELECT *, lead(cx) OVER w AS mx, lead(cy) OVER w AS my, lead(cz) OVER w AS mz, lead(s) OVER w AS ns, row_number() OVER w - 1 AS seg_index
  FROM apm WINDOW w AS (PARTITION BY {FK} ORDER BY s)),
deltas AS (SELECT *, CAST(mx AS DOUBLE) - cx AS dx, CAST(my AS DOUBLE) - cy AS dy, CAST(mz AS DOUBLE) - cz AS dz FROM nexts WHERE ns IS NOT NULL),
units AS (SELECT *, sqrt(dx*dx + dy*dy) AS length FROM deltas), sides AS (SELECT *, dx/length AS tx, dy/length AS ty FROM units),
segs AS (SELECT {FK}, CAST(seg_index AS BIGINT) AS seg_index, cx AS ax, cy AS ay, cz AS az, tx, ty, ty * flip AS nx, -tx * flip AS ny, dz, length, s AS s0, ns AS s1
  FROM (SELECT *, CASE WHEN ty * (CAST(lx AS DOUBLE) - rx) - tx * (CAST(ly AS DOUBLE) - ry) < 0 THEN -1e0 ELSE 1e0 END AS flip FROM sides))"""
AXIS = f"{OBSERVED}, {tangent('observed')}, {SEGMENTS}"


def box(b: Bounds) -> str:
    return f"side_m >= {number(b.left - 1e-6)} AND side_m <= {number(b.right + 1e-6)} AND height >= {number(b.bottom - 1e-6)} AND height <= {number(b.top + 1e-6)}"


#: Places of points `t` on the segments that cover them, and zones.
PLACES = f"""places AS (SELECT t.*, g.seg_index, (CAST(x AS DOUBLE) - ax) * nx + (CAST(y AS DOUBLE) - ay) * ny AS side_m,
    CAST(z AS DOUBLE) - az - dz * ((CAST(x AS DOUBLE) - ax) * tx + (CAST(y AS DOUBLE) - ay) * ty) / length AS height
  FROM t JOIN segs g USING ({FK}) WHERE (CAST(x AS DOUBLE) - ax) * tx + (CAST(y AS DOUBLE) - ay) * ty >= -1e-6 AND (CAST(x AS DOUBLE) - ax) * tx + (CAST(y AS DOUBLE) - ay) * ty <= length + 1e-6),
zoned AS (SELECT {FK}, source_index, seg_index, CASE WHEN {box(CORE)} THEN 1 WHEN {box(EXPANDED)} THEN 2 ELSE 3 END AS z FROM places)"""
FIRST = f"labels AS (SELECT t.*, sqrt(CAST(t.x AS DOUBLE)*t.x + CAST(t.y AS DOUBLE)*t.y + CAST(t.z AS DOUBLE)*t.z) AS d, coalesce(zone, 0) AS zone FROM t LEFT JOIN (SELECT {FK}, source_index, CASE WHEN min(z) = 1 THEN 1 ELSE arg_min(z, seg_index) END AS zone FROM zoned GROUP BY ALL) USING ({FK}, source_index))"
LABELS = f"{AXIS}, {PLACES}, {FIRST}"
STATS = f"""stats AS (SELECT {FK}, count(*) AS points, count(*) FILTER (zone = 1) AS core, count(*) FILTER (zone = 2) AS margin, count(*) FILTER (zone = 3) AS outside, count(*) FILTER (zone = 0) AS unknown,
  min(d) FILTER (zone = 1) AS core_d, min(d) FILTER (zone = 2) AS margin_d, arg_min(source_index, {{'d': d, 'i': source_index}}) FILTER (zone = 1) AS core_i, arg_min(source_index, {{'d': d, 'i': source_index}}) FILTER (zone = 2) AS margin_i FROM labels GROUP BY ALL)"""


def reach(nodes: str, edges: str) -> str:
    """CTE `cc` (source_id, frame_index, node, label): least node reachable. Put it first, with RECURSIVE."""
    return f"""cc({FK}, node, label) USING KEY ({FK}, node) AS (SELECT {FK}, node, node FROM {nodes} UNION
  SELECT e.source_id, e.frame_index, e.b, min(c.label) FROM {edges} e JOIN cc c ON c.source_id = e.source_id AND c.frame_index = e.frame_index AND c.node = e.a
  JOIN recurring.cc r ON r.source_id = e.source_id AND r.frame_index = e.frame_index AND r.node = e.b GROUP BY e.source_id, e.frame_index, e.b, r.label HAVING min(c.label) < r.label)"""


CORE_POINTS = f"core_points AS MATERIALIZED (SELECT {FK}, source_index AS node, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, d FROM labels WHERE zone = 1)"
EDGES = f"""edges AS MATERIALIZED (SELECT a.source_id, a.frame_index, a.node AS a, b.node AS b FROM core_points a JOIN core_points b USING ({FK})
  WHERE a.node <> b.node AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 25e-2*25e-2)"""
COMPONENTS = f"""{LABELS}, {CORE_POINTS}, {EDGES}, {reach('core_points', 'edges')},
members AS (SELECT {FK}, node AS source_index, label AS component, x, y, z, d FROM cc JOIN core_points USING ({FK}, node))"""
SHAPES = f"""{COMPONENTS}, boxes AS (SELECT {FK}, component, count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, min(d) AS nearest FROM members GROUP BY ALL),
shapes AS (SELECT *, max_x - min_x AS ex, max_y - min_y AS ey, max_z - min_z AS ez FROM boxes)"""
FEATURES = f"""{SHAPES}, features AS (SELECT *, CAST(n AS DOUBLE) AS f0, ex AS f1, ey AS f2, ez AS f3, greatest(ex * ey * ez, 1e-6) AS f4, n / greatest(ex * ey * ez, 1e-6) AS f5, sqrt(cx*cx + cy*cy + cz*cz) AS f6, nearest AS f7 FROM shapes)"""


def leaves(tree, path: tuple[str, ...] = ()) -> list[tuple[str, float]]:
    """(condition, value) of each leaf that isn't zero."""
    if not isinstance(tree, tuple):
        return [(" AND ".join(path) or "TRUE", tree)] if tree else []
    feature, threshold, low, high = tree
    return leaves(low, (*path, f"f{feature} <= {number(threshold)}")) + leaves(high, (*path, f"f{feature} > {number(threshold)}"))


#: The forest as a sum over leaves, of which one holds in each tree.
FOREST = "((" + " + ".join("coalesce(CASE " + " ".join(f"WHEN {c} THEN {number(v)}" for c, v in leaves(t)) + " END, 0e0)" for t in TREES) + f") / {number(len(TREES))})"
BOUNDARY = "(n >= 250 AND ((cx < -13e-1 AND ex < 25e-2 AND ez > 15e-1) OR (least(ex, ey, cz) > 1e0 AND ez > 3e-1)))"
EARLY = """(n > 79 AND nearest > 7e0 AND nearest <= 8e1 AND ey <= 8e-1 AND abs(min_x + max_x) <= 28e-1
  AND ((least(ex, ez) >= 11e-1 AND greatest(ex, ez) <= 26e-1) OR (least(ex, ez) >= 2e-1 AND greatest(ex, ez) <= 65e-2)))"""
DECIDED = f"""{FEATURES}, ruled AS (SELECT *, {BOUNDARY} AS boundary, {EARLY} AND NOT {BOUNDARY} AS early FROM features),
scored AS (SELECT *, CASE WHEN NOT boundary AND n < 1000 THEN {FOREST} END AS score FROM ruled),
decided AS (SELECT *, CASE WHEN boundary THEN 'boundary_warning' WHEN n >= 1000 THEN 'geometry_obstacle' WHEN score >= {number(THRESHOLD)} THEN 'model_assist' ELSE 'noise' END AS decision FROM scored)"""
FLAGS = f"""{DECIDED}, {STATS}, sums AS (SELECT {FK}, count(*) AS components, sum(CASE WHEN decision = 'geometry_obstacle' THEN n ELSE 0 END) AS geometry_obstacle, sum(CASE WHEN decision = 'model_assist' THEN n ELSE 0 END) AS model_assist,
  sum(CASE WHEN decision = 'boundary_warning' THEN n ELSE 0 END) AS boundary_warning, sum(CASE WHEN early THEN n ELSE 0 END) AS early_points, sum(CASE WHEN decision IN ('geometry_obstacle', 'model_assist') THEN n ELSE 0 END) AS reportable_points,
  min(CASE WHEN decision IN ('geometry_obstacle', 'model_assist') THEN nearest END) AS nearest_reportable, min(CASE WHEN early THEN nearest END) AS nearest_early FROM decided GROUP BY ALL),
flags AS (SELECT {FK}, reason = 'PAIRED_RAISED_LOCAL_CONTINUITY_PATH' AS evaluated, reason AS axis_reason, core, margin, outside, unknown, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in ('components', 'geometry_obstacle', 'model_assist', 'boundary_warning', 'early_points', 'reportable_points'))},
  nearest_reportable, nearest_early FROM rails JOIN stats USING ({FK}) LEFT JOIN sums USING ({FK})),
tri AS (SELECT *, CASE WHEN evaluated THEN geometry_obstacle > 0 END AS geometry, CASE WHEN evaluated THEN model_assist > 0 END AS model, CASE WHEN evaluated THEN early_points > 0 END AS early, CASE WHEN evaluated THEN boundary_warning > 0 END AS boundary FROM flags)"""


def streak(source: str, flag: str, out: str, name: str) -> str:
    """CTE `name`: source with the consecutive frames of a flag."""
    return f"""{name}_r AS (SELECT *, sum(CASE WHEN coalesce({flag}, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY frame_index) AS run FROM {source}),
{name} AS (SELECT * EXCLUDE (run), CASE WHEN coalesce({flag}, FALSE) THEN CAST(sum(CASE WHEN coalesce({flag}, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, run ORDER BY frame_index) AS BIGINT) ELSE 0 END AS {out} FROM {name}_r)"""


def confirmed(source: str, name: str = "confirmed") -> str:
    return f"""{streak(source, 'model', 'model_streak', name + '_m')}, {streak(name + '_m', 'early', 'early_streak', name + '_e')},
{name} AS (SELECT *, CASE WHEN model IS NOT NULL THEN model AND model_streak >= 2 END AS model_confirmed, CASE WHEN early IS NOT NULL THEN early AND early_streak >= 3 END AS early_confirmed FROM {name}_e)"""


PUBLIC = f"""{FLAGS}, {confirmed('tri')}, sure AS (SELECT *, CASE WHEN evaluated THEN geometry OR model_confirmed OR early_confirmed END AS intrusion, coalesce(early_confirmed AND reportable_points = 0, FALSE) AS ep FROM confirmed),
public AS (SELECT *, CASE WHEN ep THEN early_points ELSE reportable_points END AS public_points, CASE WHEN ep THEN nearest_early ELSE nearest_reportable END AS public_nearest, core - CASE WHEN ep THEN early_points ELSE reportable_points END AS noise_points,
  CASE WHEN intrusion THEN 'OBSERVED_CORE_INTRUSION_CANDIDATE' WHEN boundary THEN 'OBSERVED_BOUNDARY_WARNING' WHEN core > 0 THEN 'UNKNOWN' WHEN margin > 0 THEN 'OBSERVED_MARGIN_RETURN' ELSE 'UNKNOWN' END AS status,
  CASE WHEN NOT evaluated THEN axis_reason WHEN intrusion THEN 'BASELINE_V3_CONFIRMED_INTRUSION_CANDIDATE' WHEN boundary THEN 'BASELINE_V3_BOUNDARY_WARNING_NOT_OBSTACLE' WHEN early THEN 'BASELINE_V3_EARLY_CANDIDATE_WAITING_FOR_TEMPORAL_CONFIRMATION'
    WHEN model THEN 'BASELINE_V3_MODEL_ASSIST_WAITING_FOR_TEMPORAL_CONFIRMATION' WHEN core > 0 THEN 'BASELINE_V3_WEAK_OR_UNCONFIRMED_CORE_UNKNOWN_NOT_CLEAR' WHEN margin > 0 THEN 'OBSERVED_RETURN_IN_CLEARANCE_MARGIN' ELSE 'NO_RETURNS_INTERSECT_REFERENCE_NOT_CLEAR' END AS reason FROM sure)"""


def alternative(reportable: str, needed: int) -> str:
    """CTE `public` of an alternative filter: `reportable` gives FRAME, component, n, nearest and reportable; STATS must stand before it."""
    return f"""picked AS ({reportable}), sums AS (SELECT {FK}, count(*) AS components, sum(CASE WHEN reportable THEN n ELSE 0 END) AS reportable_points, min(CASE WHEN reportable THEN nearest END) AS public_nearest FROM picked GROUP BY ALL),
flags AS (SELECT {FK}, reason = 'PAIRED_RAISED_LOCAL_CONTINUITY_PATH' AS evaluated, reason AS axis_reason, core, margin, CAST(coalesce(reportable_points, 0) AS BIGINT) AS public_points, public_nearest FROM rails JOIN stats USING ({FK}) LEFT JOIN sums USING ({FK})),
tri AS (SELECT *, CASE WHEN evaluated THEN public_points > 0 END AS model FROM flags), {streak('tri', 'model', 'model_streak', 'runs')},
sure AS (SELECT *, CASE WHEN evaluated THEN model AND model_streak >= {needed} END AS intrusion FROM runs),
public AS (SELECT *, core - public_points AS noise_points, CASE WHEN intrusion THEN 'OBSERVED_CORE_INTRUSION_CANDIDATE' WHEN model THEN 'UNCONFIRMED_CORE_INTRUSION_CANDIDATE' WHEN core > 0 THEN 'NO_REPORTABLE_INTRUSION_NOISE_IGNORED' WHEN margin > 0 THEN 'OBSERVED_MARGIN_RETURN' ELSE 'UNKNOWN' END AS status,
  CASE WHEN NOT evaluated THEN axis_reason WHEN intrusion THEN 'ANY_REPORTABLE_CORE_COMPONENT_IS_INTRUSION_CANDIDATE' WHEN model THEN 'MODEL_CANDIDATE_WAITING_FOR_TEMPORAL_CONFIRMATION' WHEN core > 0 THEN 'ONLY_SPARSE_CORE_GROUPS' WHEN margin > 0 THEN 'OBSERVED_RETURN_IN_CLEARANCE_MARGIN' ELSE 'NO_RETURNS_INTERSECT_REFERENCE_NOT_CLEAR' END AS reason FROM sure)"""


def select(ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"
