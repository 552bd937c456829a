"""DuckDB SQL for the queries of the catalog that SQL can express."""

from __future__ import annotations

LINES = """w AS (SELECT greatest(2, CAST(floor(sqrt(count(*))) AS BIGINT)) AS w FROM supplier),
lines AS (
  SELECT s_suppkey AS ref, CAST(s_suppkey % w AS DOUBLE) AS x1, CAST(s_suppkey // w AS DOUBLE) AS y1,
    CAST(s_suppkey % w + s_nationkey % 5 - 2 AS DOUBLE) AS x2, CAST(s_suppkey // w + s_nationkey // 5 - 2 AS DOUBLE) AS y2, s_acctbal AS weight
  FROM supplier, w WHERE s_nationkey <> 12)"""

#: Does line a meet line b? Coordinates are whole numbers, so signs are exact.
MEET = """least(a.x1, a.x2) <= greatest(b.x1, b.x2) AND least(b.x1, b.x2) <= greatest(a.x1, a.x2)
    AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) AND least(b.y1, b.y2) <= greatest(a.y1, a.y2)
    AND ((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1)) * ((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) <= 0
    AND ((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1)) * ((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1)) <= 0"""
CROSS = MEET.replace("<= 0", "< 0")

EDGES = f"{LINES},\nedges AS MATERIALIZED (SELECT a.ref AS src, b.ref AS dst FROM lines a JOIN lines b ON a.ref <> b.ref AND {MEET})"


def hops(roots: str, edges: str, limit: int | None = None) -> str:
    """depths(root, ref, depth): breadth-first search from each root, ended by the limit or when nothing new is reached."""
    until = "" if limit is None else f"AND w.depth < {limit}"
    return f"""depths(root, ref, depth) USING KEY (root, ref) AS (
  SELECT ref, ref, 0 FROM {roots}
  UNION
  SELECT w.root, e.dst, min(w.depth + 1) FROM depths w JOIN {edges} e ON e.src = w.ref LEFT JOIN recurring.depths o ON o.root = w.root AND o.ref = e.dst
  WHERE o.ref IS NULL {until} GROUP BY w.root, e.dst)"""


def reach(nodes: str, edges: str, limit: int | None = None) -> str:
    """levels(root, depth, n) and depths(root, ref, depth) by breadth-first search from every node."""
    return f"""{hops(nodes, edges, limit)},
levels AS (SELECT root, depth, count(*) AS n FROM depths GROUP BY root, depth)"""


def axial_global(limit: int | None, radius: int | None) -> str:
    slots = "deepest + 2" if radius is None else f"least(deepest + 2, {radius + 1})"
    return f"""WITH RECURSIVE {EDGES},
{reach("lines", "edges", limit)},
s AS (SELECT root, sum(n) AS n, sum(depth * n) AS t, max(depth) AS deepest, sum(CASE WHEN depth > 0 THEN 1.0 / n END) AS inverse FROM levels GROUP BY root),
m AS (SELECT *, t / (n - 1) AS mean, {slots} AS slots, (CASE WHEN n > 2 THEN 2 * (n * (log2((n + 2) / 3) - 1) + 1) / ((n - 1) * (n - 2)) END) AS dv FROM s),
k AS (SELECT *, n > 1 AS more, n > 2 AND mean > 1 AS fine, 2 * (mean - 1) / nullif(n - 2, 0) AS r,
  CASE WHEN n > slots - 1 THEN (slots - 1) * (n - 0.5 * slots) ELSE n * (n - 1) / 2 END AS largest FROM m),
h AS (SELECT l.root, -sum(l.n / k.n * log2(l.n / k.n)) AS entropy,
  sum(l.n / k.n * log2(l.n / k.n / (pow(k.mean, l.depth - 1) / gamma(l.depth + 1.0) * exp(-k.mean)))) AS relative
  FROM levels l JOIN k USING (root) WHERE l.depth > 0 GROUP BY l.root)
SELECT k.root AS ref, CAST(n AS BIGINT) AS node_count, round(CASE WHEN more THEN mean ELSE -1.0 END, 6) AS mean_depth,
  round(CASE WHEN fine THEN dv / r ELSE -1.0 END, 6) AS integration_hh, round(CASE WHEN fine THEN dv / r ELSE -1.0 END, 6) AS integration_p,
  round(CASE WHEN fine AND t - n + 1 > 1 THEN ln(0.5 * (n - 2)) / ln(t - n + 1) ELSE -1.0 END, 6) AS integration_tekl,
  round(CASE WHEN fine THEN r ELSE -1.0 END, 6) AS ra, round(CASE WHEN fine THEN r / dv ELSE -1.0 END, 6) AS rra,
  round(CASE WHEN fine THEN CAST(t AS DOUBLE) ELSE -1.0 END, 6) AS total_depth,
  round(CASE WHEN fine AND largest <> n - 1 THEN (largest - t) / (largest - (n - 1)) ELSE -1.0 END, 6) AS ra_penn,
  round(CASE WHEN more THEN entropy ELSE -1.0 END, 6) AS entropy, round(CASE WHEN more THEN relative ELSE -1.0 END, 6) AS relativised_entropy,
  round(CASE WHEN more AND t > n THEN n * entropy / (t - n) ELSE -1.0 END, 6) AS intensity,
  round(CASE WHEN more THEN slots / inverse ELSE -1.0 END, 6) AS harmonic_mean_depth
FROM k LEFT JOIN h ON h.root = k.root""".replace("l.n / k.n", "CAST(l.n AS DOUBLE) / CAST(k.n AS DOUBLE)").replace("sum(n) AS n, sum(depth * n) AS t", "CAST(sum(n) AS DOUBLE) AS n, CAST(sum(depth * n) AS DOUBLE) AS t")


#: Of each node the least node before it on shortest paths from the root.
PARENTS = "parent AS (SELECT d.root, d.ref, min(e.src) AS p FROM depths d JOIN {edges} e ON e.dst = d.ref JOIN depths q ON q.root = d.root AND q.ref = e.src AND q.depth = d.depth - 1 GROUP BY d.root, d.ref)"

CELLS = "cells AS (SELECT p_partkey AS ref, CAST(p_partkey % 50 AS INTEGER) AS x, CAST(p_partkey // 50 AS INTEGER) AS y, p_size > 10 AS filled FROM part)"
STEPS = "steps(dx, dy, bit) AS (VALUES (1, 0, 0), (1, 1, 1), (0, 1, 2), (-1, 1, 3), (-1, 0, 4), (-1, -1, 5), (0, -1, 6), (1, -1, 7))"
NEAR = f"{CELLS},\n{STEPS},\nnear AS MATERIALIZED (SELECT a.ref AS src, b.ref AS dst, bit FROM cells a, steps, cells b WHERE a.filled AND b.filled AND b.x = a.x + dx AND b.y = a.y + dy)"

_BIG, _SMALL = "greatest(abs(dx), abs(dy))", "least(abs(dx), abs(dy))"
SIGHT = f"""{LINES},
{CELLS},
f AS (SELECT * FROM cells WHERE filled),
pairs AS (SELECT a.ref AS src, b.ref AS dst, CAST(a.x AS DOUBLE) AS x1, CAST(a.y AS DOUBLE) AS y1, CAST(b.x AS DOUBLE) AS x2, CAST(b.y AS DOUBLE) AS y2, CAST(b.x - a.x AS DOUBLE) AS dx, CAST(b.y - a.y AS DOUBLE) AS dy
  FROM f a JOIN f b ON a.ref <> b.ref AND b.x BETWEEN a.x - 3 AND a.x + 3 AND b.y BETWEEN a.y - 3 AND a.y + 3 WHERE (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) <= 9),
hidden AS (SELECT DISTINCT a.src, a.dst FROM pairs a JOIN lines b ON {CROSS}),
ratio AS (SELECT src, dst, dx, dy, x1, y1, x2, y2, sqrt(dx * dx + dy * dy) AS dist, abs(dx) >= abs(dy) AS wide, {_SMALL} / {_BIG} AS q FROM pairs ANTI JOIN hidden USING (src, dst)),
stepped AS (SELECT *, CASE WHEN q < 1e-12 THEN 0 WHEN q < tan(radians(15)) THEN 1 WHEN q < tan(radians(30)) THEN 2 WHEN q < 1 - 1e-12 THEN 3 ELSE 4 END AS step,
  CASE WHEN wide AND dx >= 0 THEN 0 WHEN NOT wide AND dy > 0 THEN 8 WHEN wide THEN 16 ELSE 24 END AS quarter FROM ratio),
sight AS MATERIALIZED (SELECT *, (quarter + 32 + CASE WHEN CASE quarter WHEN 0 THEN dy >= 0 WHEN 8 THEN dx <= 0 WHEN 16 THEN dy <= 0 ELSE dx >= 0 END THEN step ELSE -step END) % 32 AS bin FROM stepped)"""

ZONES = """zones AS (SELECT CAST(n_nationkey AS BIGINT) AS ref, -0.5 + (n_nationkey % 5) * 0.2 AS x1, -0.5 + (n_nationkey // 5) * 0.2 AS y1, -0.5 + (n_nationkey % 5 + 1) * 0.2 AS x2, -0.5 + (n_nationkey // 5 + 1) * 0.2 AS y2 FROM nation),
points AS (SELECT vec_id AS ref, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(label AS DOUBLE) AS value FROM embeddings),
inside AS (SELECT z.ref AS zone, p.ref AS point, p.value FROM zones z JOIN points p ON p.x >= z.x1 AND p.x < z.x2 AND p.y >= z.y1 AND p.y < z.y2)""".replace("* 0.2", "* CAST(0.2 AS DOUBLE)").replace("-0.5", "CAST(-0.5 AS DOUBLE)")

SCALED = """big AS (SELECT CAST(n_nationkey AS BIGINT) AS ref, (CAST(-0.5 AS DOUBLE) + (n_nationkey % 5) * CAST(0.2 AS DOUBLE)) * 12 + 4.25 AS x1, (CAST(-0.5 AS DOUBLE) + (n_nationkey // 5) * CAST(0.2 AS DOUBLE)) * 12 + 4.25 AS y1,
  (CAST(-0.5 AS DOUBLE) + (n_nationkey % 5 + 1) * CAST(0.2 AS DOUBLE)) * 12 + 4.25 AS x2, (CAST(-0.5 AS DOUBLE) + (n_nationkey // 5 + 1) * CAST(0.2 AS DOUBLE)) * 12 + 4.25 AS y2 FROM nation),
touch AS (SELECT z.ref AS zone, l.ref AS line, l.weight FROM big z JOIN lines l ON (l.x1 >= z.x1 AND l.x1 < z.x2 AND l.y1 >= z.y1 AND l.y1 < z.y2) OR (l.x2 >= z.x1 AND l.x2 < z.x2 AND l.y2 >= z.y1 AND l.y2 < z.y2))"""

ATTRS = "attrs AS (SELECT p_partkey AS ref, p_retailprice AS price, CAST(p_size AS DOUBLE) AS size, CAST(1 << (p_partkey % 8) AS BIGINT) AS layer_key FROM part)"


def _push(how: str) -> str:
    return f"WITH {ZONES} SELECT z.ref, round(coalesce({how}(nullif(value, -1)), -1.0), 6) AS pushed, count(nullif(value, -1)) AS n FROM zones z LEFT JOIN inside i ON i.zone = z.ref GROUP BY z.ref"


def _angle(ux: str, uy: str, vx: str, vy: str) -> str:
    return f"2 * acos(greatest(-1.0, least(1.0, ({ux} * {vx} + {uy} * {vy}) / sqrt(({ux} * {ux} + {uy} * {uy}) * ({vx} * {vx} + {vy} * {vy}))))) / pi()"


def _ends(table: str) -> str:
    """segedges(src, dst, weight) of segments that share ends."""
    return f"""leave AS (SELECT ref AS src, round(x2, 9) AS x, round(y2, 9) AS y, x2 - x1 AS ux, y2 - y1 AS uy FROM {table} UNION ALL SELECT ref, round(x1, 9), round(y1, 9), x1 - x2, y1 - y2 FROM {table}),
enter AS (SELECT ref AS dst, round(x1, 9) AS x, round(y1, 9) AS y, x2 - x1 AS vx, y2 - y1 AS vy FROM {table} UNION ALL SELECT ref, round(x2, 9), round(y2, 9), x1 - x2, y1 - y2 FROM {table}),
segedges AS (SELECT src, dst, {_angle("ux", "uy", "vx", "vy")} AS weight FROM leave JOIN enter USING (x, y) WHERE src <> dst)"""


SPLIT = f"""{LINES},
cuts AS (SELECT a.ref, round(((b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1)) / nullif((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1), 0), 9) AS t FROM lines a JOIN lines b ON a.ref <> b.ref AND {MEET}),
marks AS (SELECT DISTINCT ref, t FROM cuts WHERE t > 0 AND t < 1 UNION SELECT ref, 0.0 FROM lines UNION SELECT ref, 1.0 FROM lines),
pieces AS (SELECT ref, t, lead(t) OVER (PARTITION BY ref ORDER BY t) AS t2, row_number() OVER (PARTITION BY ref ORDER BY t) - 1 AS k FROM marks),
segs AS (SELECT l.ref AS axial_ref, k, l.x1 + (l.x2 - l.x1) * t AS x1, l.y1 + (l.y2 - l.y1) * t AS y1, l.x1 + (l.x2 - l.x1) * t2 AS x2, l.y1 + (l.y2 - l.y1) * t2 AS y2 FROM pieces p JOIN lines l USING (ref) WHERE t2 IS NOT NULL),
numbered AS (SELECT *, axial_ref * CAST(pow(10, length(CAST((SELECT max(k) FROM segs) AS VARCHAR))) AS BIGINT) + k AS ref FROM segs)"""

#: Steps between states (segment, direction), with turns, lengths and lines.
STATES = f"""{SPLIT},
leave AS (SELECT ref AS src, 1 AS sdir, axial_ref AS sa, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS sl, round(x2, 9) AS x, round(y2, 9) AS y, x2 - x1 AS ux, y2 - y1 AS uy FROM numbered
  UNION ALL SELECT ref, -1, axial_ref, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2), round(x1, 9), round(y1, 9), x1 - x2, y1 - y2 FROM numbered),
enter AS (SELECT ref AS dst, 1 AS ddir, axial_ref AS da, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS dl, round(x1, 9) AS x, round(y1, 9) AS y, x2 - x1 AS vx, y2 - y1 AS vy FROM numbered
  UNION ALL SELECT ref, -1, axial_ref, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2), round(x2, 9), round(y2, 9), x1 - x2, y1 - y2 FROM numbered),
turns AS (SELECT src, sdir, dst, ddir, sa, da, sl, dl, {_angle("ux", "uy", "vx", "vy")} AS weight FROM leave JOIN enter USING (x, y) WHERE src <> dst)"""
COSTS = {"metric": "(sl + dl) / 2", "topological": "CASE WHEN sa = da THEN 0.0 ELSE 1.0 END", "angular": "weight", "tulip": "floor(weight * 513 * 0.5) / 256"}


def least_costs(kind: str, roots: str) -> str:
    """costs(root, ref, cost): relaxation until nothing gets cheaper."""
    return f"""steps AS MATERIALIZED (SELECT src, sdir, dst, ddir, CAST({COSTS[kind]} AS DOUBLE) AS c FROM turns),
walk(root, ref, dir, cost) USING KEY (root, ref, dir) AS (
  SELECT ref, ref, d, CAST(0 AS DOUBLE) FROM ({roots}) r, (VALUES (1), (-1)) v(d)
  UNION
  SELECT w.root, e.dst, e.ddir, min(w.cost + e.c) FROM walk w JOIN steps e ON e.src = w.ref AND e.sdir = w.dir
    LEFT JOIN recurring.walk o ON o.root = w.root AND o.ref = e.dst AND o.dir = e.ddir
  GROUP BY w.root, e.dst, e.ddir HAVING min(w.cost + e.c) < coalesce(min(o.cost), 1e18) - 1e-9),
costs AS (SELECT root, ref, min(cost) AS cost FROM walk GROUP BY root, ref)"""


def _segment_step(kind: str) -> str:
    return f"""WITH RECURSIVE {STATES},
{least_costs(kind, "SELECT min(src) AS ref FROM turns")}
SELECT n.ref, round(coalesce(cost, -1.0), 6) AS step_depth FROM numbered n LEFT JOIN costs c ON c.ref = n.ref"""


def _segment_sums(kind: str, columns: str, where: str = "true") -> str:
    return f"""WITH RECURSIVE {STATES},
{least_costs(kind, "SELECT ref FROM numbered")},
s AS (SELECT root AS ref, count(*) AS n, sum(cost) AS t, sum(len) AS span, sum(cost * len) AS tl, sum(CASE WHEN c.ref = root THEN len END) AS own
  FROM costs c JOIN (SELECT ref, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS len FROM numbered) l ON l.ref = c.ref WHERE {where} GROUP BY root)
SELECT ref, {columns} FROM s"""


def _lattice_costs(roots: str, extra: str = "", within: float = 1e18) -> str:
    """costs(root, ref, cost): only the root and cells beside a blocked one see on."""
    return f"""small AS (SELECT ref, x, y FROM f),
corner AS MATERIALIZED (SELECT DISTINCT a.ref FROM cells a JOIN cells b ON b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 WHERE NOT b.filled AND a.ref <> b.ref),
steps AS MATERIALIZED (SELECT src, dst, dist AS c, false AS jump FROM sight {extra}),
walk(root, ref, cost) USING KEY (root, ref) AS (
  SELECT ref, ref, CAST(0 AS DOUBLE) FROM ({roots}) r
  UNION
  SELECT w.root, e.dst, min(w.cost + e.c) FROM walk w JOIN steps e ON e.src = w.ref AND (e.jump OR w.ref = w.root OR w.ref IN (SELECT ref FROM corner))
    LEFT JOIN recurring.walk o ON o.root = w.root AND o.ref = e.dst
  WHERE w.cost + e.c <= {within} GROUP BY w.root, e.dst HAVING min(w.cost + e.c) < coalesce(min(o.cost), 1e18) - 1e-9),
costs AS (SELECT root, ref, min(cost) AS cost FROM walk GROUP BY root, ref)"""


CONNECTIVITY = "SELECT l.ref, count(e.dst) AS connectivity, round(sqrt((any_value(x2) - any_value(x1)) ** 2 + (any_value(y2) - any_value(y1)) ** 2), 6) AS line_length FROM lines l LEFT JOIN edges e ON e.src = l.ref GROUP BY l.ref"


LINKS = "p AS (SELECT a.ref AS a, b.ref AS b FROM cells a JOIN cells b ON b.ref = a.ref + 7 WHERE a.filled AND b.filled AND a.ref % 40 = 0)"

#: Each cell's place, which the two cells of a link share, and sight between places.
PLACES = f"""{LINKS},
place AS (SELECT f.ref, coalesce(p.a, f.ref) AS place FROM f LEFT JOIN p ON p.b = f.ref),
places AS (SELECT DISTINCT place AS ref FROM place),
joined AS MATERIALIZED (SELECT DISTINCT s.place AS src, t.place AS dst FROM sight e JOIN place s ON s.ref = e.src JOIN place t ON t.ref = e.dst WHERE s.place <> t.place)"""


def _visual_global(limit: int | None, linked: bool = False) -> str:
    """linked: links join two cells into one place."""
    more = f"{PLACES},\n" if linked else ""
    last = "LEFT JOIN h ON h.root = k.root" + (" JOIN place c ON c.place = k.root" if linked else "")
    return f"""WITH RECURSIVE {SIGHT},
{more}{reach("places", "joined", limit) if linked else reach("f", "sight", limit)},
s AS (SELECT root, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(depth * n) AS DOUBLE) AS t FROM levels GROUP BY root),
k AS (SELECT *, t / nullif(n - 1, 0) AS mean, n > 1 AS more, n > 2 AND t / nullif(n - 1, 0) > 1 AS fine FROM s),
h AS (SELECT l.root, -sum(l.n / (k.n - 1) * log2(l.n / (k.n - 1))) AS entropy, sum(l.n / (k.n - 1) * log2(l.n / (k.n - 1) / (pow(k.mean, l.depth) / gamma(l.depth + 2.0) * exp(-k.mean)))) AS relative
  FROM levels l JOIN k USING (root) WHERE l.depth > 0 GROUP BY l.root)
SELECT {"c.ref" if linked else "k.root"} AS ref, CAST(n AS BIGINT) AS node_count, round(CASE WHEN more THEN mean ELSE -1.0 END, 6) AS mean_depth,
  round(CASE WHEN fine THEN 2 * (n * (log2((n + 2) / 3) - 1) + 1) / ((n - 1) * (n - 2)) / (2 * (mean - 1) / (n - 2)) ELSE -1.0 END, 6) AS integration_hh,
  round(CASE WHEN fine THEN 2 * (n - log2(n) - 1) / ((n - 1) * (n - 2)) / (2 * (mean - 1) / (n - 2)) ELSE -1.0 END, 6) AS integration_p,
  round(CASE WHEN fine AND t - n + 1 > 1 THEN ln(0.5 * (n - 2)) / ln(t - n + 1) ELSE -1.0 END, 6) AS integration_tekl,
  round(CASE WHEN more THEN entropy ELSE -1.0 END, 6) AS entropy, round(CASE WHEN more THEN relative ELSE -1.0 END, 6) AS relativised_entropy
FROM k {last}"""


#: up(via, k): the cells of the best path by hops from the least filled cell to the greatest, from its end.
WAY = f"""g AS (SELECT min(ref) AS a, max(ref) AS b FROM f),
{hops("(SELECT a AS ref FROM g)", "sight")},
{PARENTS.format(edges="sight")},
up(via, k) AS (SELECT b, 0 FROM g WHERE b IN (SELECT ref FROM depths) UNION ALL SELECT p, CASE WHEN k = 0 THEN 2 ELSE k + 1 END FROM up JOIN parent ON parent.ref = up.via),"""

_DEPTHS = """SELECT s.ref, round(coalesce(cost, 0.0), 6) AS depth, round(sqrt((s.x - o.x) ** 2 + (s.y - o.y) ** 2), 6) AS straight
FROM small s CROSS JOIN (SELECT x, y FROM small WHERE ref = (SELECT min(ref) FROM small)) o LEFT JOIN costs c ON c.ref = s.ref"""

ORACLES: dict[str, str] = {
    **{f"segment_{k}_step_depth": _segment_step(k) for k in ("metric", "topological", "tulip")},
    "segment_angular": f"""WITH RECURSIVE {STATES},
{least_costs("angular", "SELECT ref FROM numbered")},
r AS (SELECT root, CAST(NULL AS DOUBLE) AS radius, count(*) AS n, sum(cost) AS t FROM costs GROUP BY root UNION ALL SELECT root, 2.0, count(*), sum(cost) FROM costs WHERE cost <= 2 + 1e-9 GROUP BY root)
SELECT root, radius, round(CASE WHEN n > 1 THEN t / (n - 1) ELSE -1.0 END, 6) AS mean_depth, n AS node_count, round(CASE WHEN n > 1 THEN t ELSE -1.0 END, 6) AS total_depth FROM r""",
    "segment_metric_totals": _segment_sums("metric", "round(CASE WHEN n > 1 THEN t / (n - 1) ELSE -1.0 END, 5) AS mean_depth, round(CASE WHEN n > 1 THEN tl / (span - own) ELSE -1.0 END, 5) AS mean_depth_slw, round(t, 5) AS total_depth, n AS total_nodes, round(span, 5) AS total_length", "cost < 6"),
    "segment_topological_totals": _segment_sums("topological", "round(CASE WHEN n > 1 THEN t / (n - 1) ELSE -1.0 END, 5) AS mean_depth, round(t, 5) AS total_depth, n AS total_nodes, round(span, 5) AS total_length"),
    "segment_tulip_totals": _segment_sums("tulip", "round(CASE WHEN t > 1e-9 THEN n * n / t ELSE -1.0 END, 5) AS integration, n AS node_count, round(t, 5) AS total_depth"),
    "metric_global_distances": f"""WITH RECURSIVE {SIGHT},
{_lattice_costs("SELECT ref FROM small", within=5)},
k AS (SELECT root, cost, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS straight FROM costs JOIN small a ON a.ref = root JOIN small b ON b.ref = costs.ref WHERE cost <= 5)
SELECT root AS ref, round(sum(cost) / count(*), 6) AS mean_distance, round(sum(straight) / count(*), 6) AS mean_straight, count(*) AS node_count FROM k GROUP BY root""",
    "metric_depth_lengths": f"""WITH RECURSIVE {SIGHT},
{_lattice_costs("SELECT min(ref) AS ref FROM small")}
{_DEPTHS}""",
    "metric_depth_link_lengths": f"""WITH RECURSIVE {SIGHT},
{_lattice_costs("SELECT min(ref) AS ref FROM small", "UNION ALL SELECT min(ref), max(ref), 1.0, true FROM f UNION ALL SELECT max(ref), min(ref), 1.0, true FROM f")}
{_DEPTHS}""",
    "axial_edges": f"WITH {EDGES} SELECT * FROM edges",
    "axial_connectivity": f"WITH {EDGES} {CONNECTIVITY}",
    "axial_step_depth": f"""WITH RECURSIVE {EDGES},
{hops('(SELECT min(src) AS ref FROM edges)', 'edges')},
d AS (SELECT ref, depth FROM depths)
SELECT l.ref, CAST(coalesce(depth, -1) AS BIGINT) AS step_depth FROM lines l LEFT JOIN d USING (ref)""",
    "axial_local": f"""WITH {EDGES},
deg AS (SELECT src, count(*) AS d FROM edges GROUP BY src),
ctl AS (SELECT e.src, sum(1.0 / d) AS control FROM edges e JOIN deg ON deg.src = e.dst GROUP BY e.src),
two AS (SELECT src, dst FROM edges UNION SELECT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src),
r AS (SELECT src, count(*) AS reach FROM two GROUP BY src)
SELECT l.ref, round(coalesce(control, -1.0), 6) AS control, round(coalesce(d / (reach - 1), -1.0), 6) AS controllability
FROM lines l LEFT JOIN deg ON deg.src = l.ref LEFT JOIN ctl ON ctl.src = l.ref LEFT JOIN r ON r.src = l.ref""",
    "axial_integration_rn": axial_global(None, None),
    "axial_integration_r3": axial_global(3, 3),
    "axial_integration_r2_frontier": axial_global(2, 2),
    "axial_choice": f"""WITH RECURSIVE {EDGES},
{reach("lines", "edges")},
{PARENTS.format(edges="edges")},
up(root, target, via) AS (SELECT root, ref, p FROM parent UNION ALL SELECT up.root, up.target, parent.p FROM up JOIN parent ON parent.root = up.root AND parent.ref = up.via),
wt AS (SELECT ref, weight / 1000 AS w FROM lines),
c AS (SELECT via AS ref, count(*) AS c, sum(t.w * r.w) AS cw FROM up JOIN wt t ON t.ref = target JOIN wt r ON r.ref = up.root WHERE via <> up.root GROUP BY via),
pairs AS (SELECT d.root, d.ref, 0.5 * t.w * r.w AS v FROM depths d JOIN wt t ON t.ref = d.ref JOIN wt r ON r.ref = d.root WHERE d.depth > 0),
e AS (SELECT ref, sum(v) AS e FROM (SELECT ref, v FROM pairs UNION ALL SELECT root, v FROM pairs) GROUP BY ref),
s AS (SELECT root AS ref, count(*) AS n, sum(w) AS tw FROM depths JOIN wt USING (ref) GROUP BY root),
k AS (SELECT ref, n, tw, coalesce(c, 0) AS c, coalesce(cw, 0) + coalesce(e, 0) AS cw FROM s LEFT JOIN c USING (ref) LEFT JOIN e USING (ref))
SELECT ref, round(CASE WHEN n > 2 THEN CAST(c AS DOUBLE) ELSE -1.0 END, 4) AS choice, round(CASE WHEN n > 2 THEN 2 * c / ((n - 1) * (n - 2)) ELSE -1.0 END, 4) AS choice_norm,
  round(CASE WHEN n > 2 THEN cw ELSE -1.0 END, 4) AS choice_weighted, round(CASE WHEN n > 2 AND tw <> 0 THEN 2 * cw / (tw * tw) ELSE -1.0 END, 4) AS choice_weighted_norm FROM k""",
    "axial_shortest_path": f"""WITH RECURSIVE {EDGES},
{hops("(SELECT min(src) AS ref FROM edges)", "edges")},
{PARENTS.format(edges="edges")},
up(via) AS (SELECT arg_max(ref, depth * 1000000 - ref) FROM depths UNION ALL SELECT p FROM up JOIN parent ON parent.ref = up.via)
SELECT ref, CAST(depth AS BIGINT) AS depth, CAST(depth AS BIGINT) AS "order" FROM depths JOIN up ON via = ref""",
    "visual_shortest_path": f"""WITH RECURSIVE {SIGHT},
{WAY.rstrip(",")}
SELECT b AS target, via AS ref, CAST(k AS BIGINT) AS "order", CAST(0 AS BIGINT) AS linked FROM up, g""",
    "axial_weighted_depth": f"""WITH RECURSIVE {EDGES},
{reach("lines", "edges")}
SELECT root AS ref, round(CASE WHEN count(*) > 1 THEN sum(depth * weight) / sum(weight) ELSE -1.0 END, 6) AS mean_depth_weighted, round(sum(weight), 6) AS total_weight
FROM depths JOIN lines USING (ref) GROUP BY root""",
    "links_unlinks": f"""WITH {EDGES},
extra AS (SELECT a.ref AS a, b.ref AS b FROM lines a JOIN lines b ON b.ref = a.ref + 1 WHERE a.ref % 10 = 0),
gone AS (SELECT src, dst FROM edges WHERE src % 7 = 0 AND src < dst)
(SELECT src, dst FROM edges UNION SELECT a, b FROM extra UNION SELECT b, a FROM extra) EXCEPT (SELECT src, dst FROM gone UNION SELECT dst, src FROM gone)""",
    "unlink_crossings": f"""WITH {EDGES},
p AS (SELECT a.ref AS a, b.ref AS b, a.x1, a.y1, a.x2 - a.x1 AS dx, a.y2 - a.y1 AS dy,
  ((b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1)) / nullif((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1), 0) AS t
  FROM edges e JOIN lines a ON a.ref = e.src JOIN lines b ON b.ref = e.dst WHERE e.src < e.dst)
SELECT a, b, round(x1 + t * dx, 6) AS x, round(y1 + t * dy, 6) AS y FROM p WHERE t IS NOT NULL""",
    "copurchase_components_depth": f"""WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_quantity >= 49),
edges AS MATERIALIZED (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM l a JOIN l b USING (l_orderkey) WHERE a.l_partkey <> b.l_partkey),
{hops('(SELECT min(src) AS ref FROM edges)', 'edges')},
d AS (SELECT ref, depth FROM depths)
SELECT n.src AS ref, CAST(coalesce(depth, -1) AS BIGINT) AS step_depth FROM (SELECT DISTINCT src FROM edges) n LEFT JOIN d ON d.ref = n.src""",
    "quick_tidy": f"""WITH {LINES},
every AS (SELECT ref, x1, y1, x2, y2 FROM lines UNION ALL SELECT ref + 100000, x2, y2, x1, y1 FROM lines WHERE ref % 5 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN (x1, y1) <= (x2, y2) THEN (x1, y1, x2, y2) ELSE (x2, y2, x1, y1) END ORDER BY ref DESC) AS k FROM every)
SELECT ref, x1, y1, x2, y2 FROM r WHERE k = 1""",
    "tidy_lines": f"""WITH {LINES},
p AS (SELECT ref, least((x1, y1), (x2, y2)) AS a, greatest((x1, y1), (x2, y2)) AS b FROM (SELECT ref, x1, y1, x2, y2 FROM lines)),
q AS (SELECT ref, a[1] AS ax, a[2] AS ay, b[1] AS bx, b[2] AS bz FROM p),
s AS (SELECT *, CASE WHEN ax = bx THEN NULL ELSE round((bz - ay) / (bx - ax), 9) END AS slope, round(CASE WHEN ax = bx THEN ax ELSE ay - (bz - ay) / (bx - ax) * ax END, 9) + 0.0 AS c,
  CASE WHEN ax = bx THEN ay ELSE ax END AS lo, CASE WHEN ax = bx THEN bz ELSE bx END AS hi FROM q),
r AS (SELECT *, max(hi) OVER (PARTITION BY slope, c ORDER BY lo, hi, ref ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY slope, c ORDER BY lo, hi, ref ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT min(ref) AS ref, arg_min(ax, lo) AS x1, arg_min(ay, lo) AS y1, arg_max(bx, hi) AS x2, arg_max(bz, hi) AS y2 FROM i GROUP BY slope, c, island""",
    "segment_split": f"WITH {SPLIT} SELECT axial_ref AS ref, count(*) AS pieces, round(sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)), 6) AS length FROM numbered GROUP BY axial_ref",
    "segment_connectivity": f"""WITH {LINES},
{_ends("lines")},
e AS (SELECT src, sum(weight) AS a, count(*) AS c FROM segedges GROUP BY src)
SELECT ref, round(coalesce(a, 0.0), 6) AS angular_connectivity, coalesce(c, 0) AS connectivity, round(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2), 6) AS segment_length FROM lines LEFT JOIN e ON e.src = ref""",
    "segment_of_split_connectivity": f"""WITH {SPLIT},
{_ends("numbered")},
e AS (SELECT src, sum(weight) AS a, count(*) AS c FROM segedges GROUP BY src)
SELECT ref, round(coalesce(a, 0.0), 6) AS angular_connectivity, coalesce(c, 0) AS connectivity, round(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2), 6) AS segment_length, axial_ref FROM numbered LEFT JOIN e ON e.src = ref""",
    "push_axial_to_segment": f"""WITH {SPLIT.replace(LINES, EDGES)},
c AS (SELECT l.ref, count(e.dst) AS connectivity FROM lines l LEFT JOIN edges e ON e.src = l.ref GROUP BY l.ref)
SELECT axial_ref, connectivity AS axial_connectivity, count(*) AS pieces FROM numbered n JOIN c ON c.ref = n.axial_ref GROUP BY axial_ref, connectivity""",
    "lattice_grid_connections": f"""WITH {SIGHT}, {STEPS},
near AS (SELECT s.src, bit FROM sight s JOIN steps ON s.dx = steps.dx AND s.dy = steps.dy)
SELECT f.ref, CAST(coalesce(sum(1 << bit), 0) AS BIGINT) AS grid_connections FROM f LEFT JOIN near ON src = ref GROUP BY f.ref""",
    "lattice_blocked_adjacent": f"WITH {CELLS}, {STEPS} SELECT a.ref, coalesce(bool_or(NOT b.filled), false) AS blocked_adjacent FROM cells a CROSS JOIN steps LEFT JOIN cells b ON b.x = a.x + dx AND b.y = a.y + dy GROUP BY a.ref",
    "lattice_flood_fill": f"""WITH RECURSIVE {NEAR},
{hops('(SELECT min(ref) AS ref FROM cells WHERE filled)', 'near')}
SELECT ref, CAST(depth AS BIGINT) AS depth FROM depths""",
    "lattice_visibility_moments": f"WITH {SIGHT} SELECT f.ref, count(dst) AS connectivity, round(coalesce(sum(dist), 0.0), 6) AS first_moment, round(coalesce(sum(dist * dist), 0.0), 6) AS second_moment FROM f LEFT JOIN sight ON src = f.ref GROUP BY f.ref",
    "lattice_bin_counts": f"WITH {SIGHT} SELECT src AS ref, {', '.join(f'count(*) FILTER (WHERE bin = {k}) AS bin{k}' for k in range(32))} FROM sight GROUP BY src",
    "lattice_bin_distances": f"WITH {SIGHT} SELECT src AS ref, CAST(bin AS BIGINT) AS bin, round(max(dist), 6) AS distance FROM sight GROUP BY src, bin",
    "lattice_grid": "SELECT CAST((x << 16) + y AS BIGINT) AS ref, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, x * CAST(0.5 AS DOUBLE) AS px, y * CAST(0.5 AS DOUBLE) AS py FROM range(21) a(x), range(13) b(y)",
    "lattice_line_cells": f"""WITH {LINES},
s AS (SELECT ref, x1, y1, x2, y2, unnest(range(CAST(floor(least(x1, x2) + 0.5) AS BIGINT), CAST(floor(greatest(x1, x2) + 0.5) AS BIGINT) + 1)) AS x FROM lines),
t AS (SELECT *, unnest(range(CAST(floor(least(y1, y2) + 0.5) AS BIGINT), CAST(floor(greatest(y1, y2) + 0.5) AS BIGINT) + 1)) AS y FROM s),
u AS (SELECT *, [(x2 - x1) * (y + j * 0.5 - y1) - (y2 - y1) * (x + i * 0.5 - x1) for i in [-1, 1]] AS lo FROM t CROSS JOIN (VALUES (-1), (1)) v(j)),
g AS (SELECT ref, x, y, min(list_min(lo)) AS a, max(list_max(lo)) AS b FROM u GROUP BY ref, x, y)
SELECT ref, x, y FROM g WHERE a <= 0 AND b >= 0""",
    "visual_local": f"""WITH {SIGHT},
deg AS (SELECT src, count(*) AS k FROM sight GROUP BY src),
sec AS (SELECT a.src, b.dst FROM sight a JOIN sight b ON a.dst = b.src),
u AS (SELECT src, count(DISTINCT dst) AS reach FROM sec GROUP BY src),
t AS (SELECT src, count(*) AS tri FROM sec SEMI JOIN sight USING (src, dst) GROUP BY src),
c AS (SELECT s.src, sum(1.0 / k) AS control FROM sight s JOIN deg ON deg.src = s.dst GROUP BY s.src)
SELECT f.ref, round(CASE WHEN k > 1 THEN coalesce(tri, 0) / (k * (k - 1)) ELSE -1.0 END, 6) AS clustering, round(CASE WHEN k > 1 THEN control ELSE -1.0 END, 6) AS control, round(CASE WHEN k > 1 THEN k / reach ELSE -1.0 END, 6) AS controllability
FROM f LEFT JOIN deg ON deg.src = f.ref LEFT JOIN u ON u.src = f.ref LEFT JOIN t ON t.src = f.ref LEFT JOIN c ON c.src = f.ref""",
    "visual_global_r3": _visual_global(3),
    "visual_global_rn": _visual_global(None),
    "visual_global_linked": _visual_global(None, linked=True),
    "visual_step_depth": f"""WITH RECURSIVE {SIGHT},
{hops('(SELECT min(ref) AS ref FROM f)', 'sight')},
d AS (SELECT ref, depth FROM depths)
SELECT f.ref, CAST(coalesce(depth, 0) AS BIGINT) AS step_depth FROM f LEFT JOIN d USING (ref)""",
    "through_vision": f"""WITH {SIGHT},
s AS (SELECT x1, y1, dx, dy, greatest(abs(dx), abs(dy)) AS n, unnest(range(1, CAST(greatest(abs(dx), abs(dy)) AS BIGINT))) AS i FROM sight),
r AS (SELECT CAST(floor(x1 + dx * i / n + 0.5) AS INTEGER) AS x, CAST(floor(y1 + dy * i / n + 0.5) AS INTEGER) AS y, count(*) AS c FROM s GROUP BY ALL)
SELECT ref, coalesce(c, 0) AS through_vision FROM f LEFT JOIN r USING (x, y)""",
    "isovist_zone": f"""WITH {SIGHT},
o AS (SELECT DISTINCT f.ref FROM f JOIN lines ON f.x = lines.x1 AND f.y = lines.y1),
d AS (SELECT ref, min(dist) AS d FROM (SELECT dst AS ref, dist FROM sight WHERE src IN (SELECT ref FROM o) UNION ALL SELECT ref, 0.0 FROM o) GROUP BY ref)
SELECT f.ref, round(coalesce(d, -1.0), 6) AS distance, round(coalesce(1 / ((d + 1) * (d + 1)), -1.0), 6) AS inverse_square FROM f LEFT JOIN d USING (ref)""",
    "path_zones": f"""WITH RECURSIVE {SIGHT},
{WAY}
o AS (SELECT DISTINCT via AS ref FROM up),
d AS (SELECT ref, min(dist) AS d FROM (SELECT dst AS ref, dist FROM sight WHERE src IN (SELECT ref FROM o) UNION ALL SELECT ref, 0.0 FROM o) GROUP BY ref)
SELECT f.ref, CAST(d IS NOT NULL AS BIGINT) AS visual_zone, round(coalesce(d, -1.0), 6) AS metric_zone, round(coalesce(1 / (d + 1), -1.0), 6) AS inverse_zone FROM f LEFT JOIN d USING (ref)""",
    "link_data": f"""WITH {CELLS},
{LINKS},
two AS (SELECT a AS ref, b AS link_to FROM p UNION ALL SELECT b, a FROM p)
SELECT t.ref, link_to, 1.0::DOUBLE AS link_visual_cost, round(2 * sqrt((c.x - e.x) ** 2 + (c.y - e.y) ** 2), 6) AS link_metric_cost, 1.0::DOUBLE AS link_angular_cost FROM two t JOIN cells c ON c.ref = t.ref JOIN cells e ON e.ref = link_to""",
    **{f"push_points_to_zones_{k}": _push(v) for k, v in (("min", "min"), ("max", "max"), ("avg", "avg"), ("tot", "sum"))},
    "push_zones_to_points": f"WITH {ZONES} SELECT p.ref, round(coalesce(avg(zone), -1.0), 6) AS pushed, count(zone) AS n FROM points p LEFT JOIN inside i ON i.point = p.ref GROUP BY p.ref",
    "push_zones_to_lines": f"WITH {LINES}, {SCALED} SELECT l.ref, coalesce(max(CAST(zone AS DOUBLE)), -1.0) AS pushed, count(zone) AS n FROM lines l LEFT JOIN touch ON line = l.ref GROUP BY l.ref",
    "push_lines_to_zones": f"WITH {LINES}, {SCALED} SELECT z.ref, round(coalesce(sum(touch.weight), -1.0), 6) AS pushed, count(touch.weight) AS n FROM big z LEFT JOIN touch ON zone = z.ref GROUP BY z.ref",
    "push_lines_to_lines": f"""WITH {LINES},
moved AS (SELECT ref + 1000000 AS ref, x1 + 0.5 AS x1, y1 + 0.5 AS y1, x2 + 0.5 AS x2, y2 + 0.5 AS y2 FROM lines)
SELECT a.ref, round(coalesce(avg(b.weight), -1.0), 6) AS pushed, count(b.weight) AS n FROM moved a LEFT JOIN lines b ON {MEET} GROUP BY a.ref""",
    "push_zones_to_zones": f"""WITH {LINES}, {SCALED},
moved AS (SELECT ref + 100 AS ref, x1 + 1.1 AS x1, y1 + 0.7 AS y1, x2 + 1.1 AS x2, y2 + 0.7 AS y2 FROM big)
SELECT m.ref, coalesce(sum(CAST(z.ref AS DOUBLE)), -1.0) AS pushed, count(z.ref) AS n FROM moved m LEFT JOIN big z ON z.x1 < m.x2 AND m.x1 < z.x2 AND z.y1 < m.y2 AND m.y1 < z.y2 GROUP BY m.ref""",
    "polygon_measures": f"WITH {ZONES} SELECT ref, round((x2 - x1) * (y2 - y1), 6) AS area, round((x1 + x2) / 2, 6) AS cx, round((y1 + y2) / 2, 6) AS cy, round(2 * (x2 - x1 + y2 - y1), 6) AS perimeter, true AS ccw FROM zones",
    "trail_measures": """WITH e AS (SELECT user_id AS ref, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS x, value AS y FROM events),
s AS (SELECT ref, x, y, lag(y) OVER w AS p, lead(y) OVER w AS q FROM e WINDOW w AS (PARTITION BY ref ORDER BY x)),
t AS (SELECT ref, sqrt(1 + (q - y) ** 2) AS len, CASE WHEN p IS NOT NULL AND q IS NOT NULL THEN acos(greatest(-1.0, least(1.0, (1 + (y - p) * (q - y)) / sqrt((1 + (y - p) ** 2) * (1 + (q - y) ** 2))))) / (pi() / 2) END AS turn FROM s)
SELECT ref, round(coalesce(sum(len), 0.0), 4) AS length, round(coalesce(sum(turn), 0.0), 4) AS deviation FROM t GROUP BY ref""",
    "line_touch_kinds": f"WITH {LINES} SELECT a.ref AS a, b.ref AS b, CAST(CASE WHEN {CROSS} THEN 2 ELSE 1 END AS BIGINT) AS kind FROM lines a JOIN lines b ON a.ref < b.ref AND {MEET}",
    "packed_refs": f"WITH {CELLS} SELECT ref, CAST((x << 16) + (y & 65535) AS BIGINT) AS packed, CAST(x AS BIGINT) AS back_x, CAST(y AS BIGINT) AS back_y FROM cells",
    "nearest_line": f"""WITH {LINES}, {CELLS},
p AS (SELECT ref, x + 0.25 AS px, y + 0.5 AS py FROM cells),
t AS (SELECT p.ref, l.ref AS line, px, py, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy, greatest(0.0, least(1.0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) AS t FROM p, lines l),
d AS (SELECT ref, line, sqrt((x1 + t * dx - px) ** 2 + (y1 + t * dy - py) ** 2) AS raw, round(raw, 6) AS distance FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY distance, line) AS k FROM d WHERE raw <= 2)
SELECT ref, line, distance FROM r WHERE k = 1""",
    "attr_stats": f"""WITH {ATTRS} SELECT 'price' AS "column", count(price) AS n, round(min(price), 6) AS least, round(max(price), 6) AS greatest, round(sum(price), 6) AS total FROM attrs
UNION ALL SELECT 'size', count(size), round(min(size), 6), round(max(size), 6), round(sum(size), 6) FROM attrs""",
    "attr_normalised": f"WITH {ATTRS} SELECT ref, round((price - (SELECT min(price) FROM attrs)) / ((SELECT max(price) FROM attrs) - (SELECT min(price) FROM attrs)), 6) AS normalised FROM attrs",
    "attr_selection_average": f"WITH {ATTRS} SELECT round(coalesce(avg(price), -1.0), 6) AS average FROM attrs WHERE ref % 3 = 0",
    "attr_row_index": f"WITH {ATTRS} SELECT ref, row_number() OVER (ORDER BY ref) - 1 AS idx FROM attrs",
    "attr_sorted": f"WITH {ATTRS} SELECT ref, size FROM attrs ORDER BY size, ref",
    "attr_value_range": f"WITH {ATTRS} SELECT ref, size FROM attrs WHERE size BETWEEN 10 AND 20",
    "attr_in_region": f"WITH {CELLS} SELECT ref, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM cells WHERE x BETWEEN 3 AND 20 AND y BETWEEN 2 AND 9",
    "layer_visible_rows": f"WITH {ATTRS} SELECT ref, layer_key FROM attrs WHERE layer_key & 36 <> 0",
    "selection_to_layer": f"WITH {ATTRS} SELECT ref, CASE WHEN price < 1200 THEN layer_key | 2 ELSE layer_key & ~2 END AS layer_key FROM attrs",
    "import_attributes": f"WITH {ATTRS} SELECT ref, round(CASE WHEN ref % 4 = 1 THEN price * 2 ELSE -1.0 END, 6) AS double_price FROM attrs",
    "categorical_codes": """WITH v AS (SELECT p_brand AS value, min(p_partkey) AS first FROM part GROUP BY p_brand),
c AS (SELECT value, row_number() OVER (ORDER BY first) - 1 AS code, count(*) OVER () AS n FROM v)
SELECT p_partkey AS ref, CASE WHEN n > 32 THEN -1 ELSE code END AS code FROM part JOIN c ON value = p_brand""",
    "formula_update": f"""WITH {ATTRS} SELECT ref, round(CASE WHEN size > 25 AND price > 1000 THEN ln(price) - 1 WHEN size % 2 = 0 THEN size * size / 3 - 1 WHEN size = 25 THEN -1.0 ELSE 1 / (size - 25) - 1 END, 6) AS result FROM attrs""",
    "formula_select": f"WITH {ATTRS} SELECT ref FROM attrs WHERE (size > 40 OR price < 950) AND ref % 2 <> 1",
    "formula_loop": f"WITH {ATTRS} SELECT ref, round(6 * size, 6) AS result FROM attrs",
    "formula_setvalue": """WITH a AS (SELECT p_partkey AS ref, p_retailprice AS price, CAST(p_size AS DOUBLE) AS size, CAST(1 << (p_partkey % 8) AS BIGINT) AS layer_key FROM part)
SELECT ref, round(price + CASE WHEN size > 25 THEN size * 2 ELSE 1 END, 6) AS price, CASE WHEN size > 25 THEN 0 ELSE size END AS size, layer_key, CASE WHEN size > 25 THEN 0 ELSE size END AS result FROM a""",
    "formula_setvalue_loop": "SELECT p_partkey AS ref, CAST(3 * p_size + 1 AS DOUBLE) AS price, CAST(p_size + 3 AS DOUBLE) AS size, CAST(1 << (p_partkey % 8) AS BIGINT) AS layer_key FROM part",
    **dict.fromkeys(("formula_neighbours", "formula_connections"), f"""WITH {EDGES},
c AS (SELECT l.ref, CAST(count(e.dst) AS DOUBLE) AS c FROM lines l LEFT JOIN edges e ON e.src = l.ref GROUP BY l.ref)
SELECT l.ref, round(coalesce(avg(c.c), -1.0), 6) AS mean_neighbour FROM lines l LEFT JOIN edges e ON e.src = l.ref LEFT JOIN c ON c.ref = e.dst GROUP BY l.ref"""),
}

#: The same over what cells see at any distance.
UNLIMITED = SIGHT.replace(" AND b.x BETWEEN a.x - 3 AND a.x + 3 AND b.y BETWEEN a.y - 3 AND a.y + 3 WHERE (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) <= 9", "")
for _name, _of in {"moments": "lattice_visibility_moments", "bin_counts": "lattice_bin_counts", "bin_distances": "lattice_bin_distances", "step_depth": "visual_step_depth", "through_vision": "through_vision"}.items():
    ORACLES[f"unlimited_{_name}"] = ORACLES[_of].replace(SIGHT, UNLIMITED)
ORACLES["visual_global_rn"] = ORACLES["visual_global_rn"].replace(SIGHT, UNLIMITED)
