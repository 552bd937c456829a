"""Ties, whole jobs and searches of graphs beyond earlier limits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import drawing, lattice, vga
from netloom.operators import traverse as V
from tests.test_space import LINES, SHAPES, grid, no_walls


def test_nearest_shape_ties_by_rounded_distance(spark):
    """Both lines are 0.782624 away, the first by more in the last bits."""
    at = [(0, (42.0, 32.0), (40.0, 33.0)), (1, (40.0, 30.0), (42.0, 31.0))]
    d = spark.createDataFrame([(ref, "a", "line", [a, b], False) for ref, a, b in at], SHAPES)
    points = spark.createDataFrame([(7, 41.25, 31.5)], "ref long, x double, y double")
    assert [tuple(r) for r in drawing.nearest_shape(points, d, 2.0).collect()] == [(7, 0, 0.782624)]


def _crosses(a, b, w):
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    c, d = w[:2], w[2:]
    return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0


@pytest.mark.parametrize("reach", [0.5, 3.0, 20.0])
def test_sight_within_a_reach_joins_no_pairs(spark, reach):
    """Tiles of cells see what brute force sees, beyond one tile and below zero, and no pair of cells is joined or shuffled."""
    rng = np.random.default_rng(3)
    at = {(int(x), int(y)) for x, y in rng.integers(-60, 60, (300, 2))} | {(x, y) for x in range(-3, 4) for y in range(45, 52)}
    cells = spark.createDataFrame([(k, x, y, True) for k, (x, y) in enumerate(sorted(at))], "ref long, x int, y int, filled boolean")
    lines = [(*p, *(p + rng.integers(-6, 7, 2))) for p in rng.integers(-60, 60, (200, 2)).astype(float)] + [(-100.0, 48.5, 100.0, 48.5)]
    walls = spark.createDataFrame([(k, *map(float, w)) for k, w in enumerate(lines)], LINES)
    edges = lattice.visibility(cells, walls, reach)
    assert "Join" not in edges._jdf.queryExecution().optimizedPlan().toString()
    refs = {k: p for k, p in enumerate(sorted(at))}
    want = {(i, j) for i, p in refs.items() for j, q in refs.items() if i != j and (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= reach**2 and not any(_crosses(p, q, w) for w in lines)}
    assert {(r.src, r.dst) for r in edges.collect()} == want
    bits = {r.ref: r.grid_connections for r in lattice.grid_connections(cells, edges).collect()}
    plain = {r.ref: r.grid_connections for r in lattice.grid_connections(cells, edges.select("src", "dst")).collect()}
    assert bits == plain


def test_searches_stream_edges_to_one_task(spark, monkeypatch):
    """Graphs beyond the kernel's limit are searched from one origin, with the rows of the form for small graphs; long paths take no round of joins a level."""
    cells = grid(spark, 40, 3, {(7, 1), (20, 0), (31, 2)})
    edges = V.checkpointed(lattice.visibility(cells, no_walls(spark), 3.0))
    corner = lattice.blocked_adjacent(cells)
    g = vga.metric_graph(cells, edges, corner)
    for kind in ("metric", "angular"):
        cost, angle, _ = vga.metric_search(g, [0], angular=kind == "angular")
        monkeypatch.setattr(V, "KERNEL_EDGES", 10)
        monkeypatch.setattr(V.is_small, "__defaults__", (10,))
        got = {r.ref: (r.depth, r.angle) for r in vga.depth_map(cells, edges, corner, [0], kind).collect()}
        hit = np.isfinite(cost)
        assert got == dict(zip(g.refs.tolist(), zip(np.where(hit, cost, 0.0).tolist(), np.where(hit, angle, 0.0).tolist())))
        far = int(g.refs[np.argmax(np.where(hit, cost, -1.0))])
        path = vga.shortest_path(cells, edges, corner, 0, [far], kind).collect()
        assert {0, far} <= {r.ref for r in path}
    # by hops: the default limit takes graphs of millions of edges in a task, without a checkpoint for each level
    assert V.multi_source_depth.__defaults__[-1] >= 100_000_000
    assert V.shortest_path.__defaults__[-1] >= 100_000_000


@pytest.fixture(scope="module")
def strip(spark, tmp_path_factory):
    """A lattice of 3 x 24 cells with a blocked one in each third row, and a wall."""
    at = tmp_path_factory.mktemp("strip")
    cells = [(50 * y + x, 5 if x == 1 and y % 3 == 0 else 20, 1.0) for y in range(24) for x in range(3)]
    spark.createDataFrame(cells, "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{at}/part.parquet")
    spark.createDataFrame([(1, 3, 1.0), (2, 8, 1.0), (3, 20, 1.0)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{at}/supplier.parquet")
    return str(at), sum(size > 10 for _, size, _ in cells)


@pytest.mark.parametrize("name", ["metric_global", "angular_global"])
def test_global_measures_have_no_radius(spark, strip, name):
    """Every cell reaches every other one, far beyond 5 steps or one turn."""
    from netloom.plans.catalog import QUERIES

    path, n = strip
    assert {r.node_count for r in QUERIES[name](spark, path).collect()} == {n}


def test_agents_see_at_any_distance(spark, strip):
    """Agents of the query look across the lattice: the moves are those over the whole visibility graph."""
    from netloom.operators import agents
    from netloom.plans.catalog import QUERIES
    from netloom.sources import fixtures as fx

    cells, walls = fx.part_lattice(spark, strip[0]), fx.supplier_lines(spark, strip[0])
    filled = cells.filter("filled")
    moves = agents.run(filled, lattice.visibility(cells, walls), lattice.neighbour_edges(cells), agents.Settings(steps=200, rate=0.5))
    want = {tuple(r) for r in agents.gate_counts(filled, moves).collect()}
    assert {tuple(r) for r in QUERIES["agent_gate_counts"](spark, strip[0]).collect()} == want


def test_visual_global_rn_sees_at_any_distance(spark, strip):
    """Cells of one column see each other over 24 rows, so no depth needs more than a few steps."""
    from netloom.plans.catalog import QUERIES

    assert max(r.mean_depth for r in QUERIES["visual_global_rn"](spark, strip[0]).collect()) < 2.5


@pytest.mark.parametrize("kind", ["moments", "bin_counts", "bin_distances"])
def test_sums_of_sight_take_no_pairs(spark, strip, kind):
    from netloom.sources import fixtures as fx

    cells, walls = fx.part_lattice(spark, strip[0]), fx.supplier_lines(spark, strip[0])
    rows = lambda df: sorted(tuple(round(v, 6) for v in r) for r in df.collect())
    assert rows(lattice.sight_sums(cells, walls, kind)) == rows(lattice.sight_sums(cells, walls, kind, kernel_cells=0))
