"""Lattices, isovists, pushing values, formulas, attribute tables, readers and writers, drawings, agents."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.functions import formula as FX
from netloom.functions import geometry as G
from netloom.operators import agents, drawing, lattice, vga
from netloom.operators import attributes as A
from netloom.operators import push as P
from netloom.operators import traverse as V
from netloom.operators.spatial import box, prefixed, spatial_join
from netloom.sources import readers, writers

LINES = "ref long, x1 double, y1 double, x2 double, y2 double"
SHAPES = "ref long, layer string, shape_type string, points array<struct<x:double,y:double>>, closed boolean"


def grid(spark, w, h, hole=()):
    return spark.createDataFrame([(y * w + x, x, y, (x, y) not in hole) for y in range(h) for x in range(w)], "ref long, x int, y int, filled boolean")


def no_walls(spark):
    return spark.createDataFrame([], LINES)


def test_open_room_sees_itself(spark):
    cells = grid(spark, 4, 3)
    edges = V.checkpointed(lattice.visibility(cells, no_walls(spark), 10.0))
    assert edges.count() == 12 * 11
    local = vga.visual_local(cells, edges).collect()
    assert all(r.clustering == pytest.approx(1) and r.controllability == pytest.approx(11 / 12) for r in local)
    glob = vga.visual_global(cells, edges).collect()
    assert all(r.mean_depth == 1 and r.integration_hh == -1 for r in glob)
    total = lattice.moments(cells, edges).agg(F.sum("connectivity")).first()[0]
    assert total == 132 and sum(lattice.bin_counts(edges).agg(*[F.sum(f"bin{k}") for k in range(32)]).first()) == 132


@pytest.mark.parametrize("limit", [None, 1, 2, 3])
def test_linked_levels(spark, limit):
    """The kernel and the frontier against a search that treats the cells of a link one by one."""
    rng = np.random.default_rng(8)
    cells = grid(spark, 6, 5).select("ref")
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 30, (34, 2)) if a != b}
    sees = {(a, b) for p in pairs for a, b in (p, p[::-1])}
    edges = spark.createDataFrame(sorted(sees), "src long, dst long")
    order = rng.permutation(30)[:12].reshape(6, 2)
    links = [tuple(sorted(map(int, p))) for p in order]
    twin = dict(links) | {b: a for a, b in links}
    want = []
    for root in range(30):
        closed, level, front = set(), 0, {root}
        while front:
            counted = 0
            nxt = set()
            for c in sorted(front):
                if c in closed:
                    continue
                counted += 1
                closed.add(c)
                if limit is None or level < limit:
                    for at in (c, twin.get(c)):
                        nxt |= {b for a, b in sees if a == at}
                    closed |= {twin[c]} if c in twin else set()
            want += [(root, level, counted)] if counted else []
            front, level = nxt - closed, level + 1
    for small in (True, False):
        got = vga.linked_levels(cells, edges, spark.createDataFrame(links, "a long, b long"), limit, small=small)
        assert sorted(map(tuple, got.select("root", "depth", "n").collect())) == want, small


def test_links_shorten_depths(spark):
    cells = spark.createDataFrame([(k, k, 0, True) for k in range(4)], "ref long, x int, y int, filled boolean")
    edges = spark.createDataFrame([(0, 1), (1, 0), (2, 3), (3, 2)], "src long, dst long")
    links = lattice.merge(cells, spark.createDataFrame([], "a long, b long"), spark.createDataFrame([(2, 1)], "a long, b long"))
    got = {r.ref: (r.node_count, r.mean_depth) for r in vga.visual_global(cells, edges, links=links).collect()}
    assert got == {0: (3, 1.5), 1: (3, 1.0), 2: (3, 1.0), 3: (3, 1.5)}
    assert {r.node_count for r in vga.visual_global(cells, edges).collect()} == {2}
    none = vga.visual_global(cells, edges, links=links.limit(0))
    assert sorted(map(tuple, none.collect())) == sorted(map(tuple, vga.visual_global(cells, edges).collect()))


def test_wall_blocks_sight_and_fill(spark):
    cells = grid(spark, 4, 4)
    wall = spark.createDataFrame([(0, 1.5, -1.0, 1.5, 9.0)], LINES)
    edges = lattice.visibility(cells, wall, 10.0)
    assert edges.count() == 2 * 8 * 7
    assert lattice.flood_fill(cells, cells.filter("ref = 0").select("ref"), wall).count() == 8
    assert lattice.flood_fill(cells, cells.filter("ref = 0").select("ref")).count() == 16


def test_unlimited_sight(spark):
    """The kernel, the joins and plain tests of every pair give the same edges, with walls that end on cells or cross behind the cut of the circle."""
    rng = np.random.default_rng(5)
    rows = [(k, int(k % 11), int(k // 11), bool(rng.random() < 0.8)) for k in range(99)]
    cells = spark.createDataFrame(rows, "ref long, x int, y int, filled boolean")
    lines = [(i, *(float(v) for v in (rng.integers(0, 10, 4) if i % 2 else rng.random(4) * 10))) for i in range(12)] + [(20, 4.0, 4.0, 4.0, 4.0)]
    walls = spark.createDataFrame(lines, LINES)
    cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    apart = lambda p, q, w: cross(p, q, w[1:3]) * cross(p, q, w[3:5]) < 0 and cross(w[1:3], w[3:5], p) * cross(w[1:3], w[3:5], q) < 0
    at = {r: (x, y) for r, x, y, filled in rows if filled}
    want = {(a, b) for a in at for b in at if a != b and not any(apart(at[a], at[b], w) for w in lines)}
    pairs = lambda df: sorted((r.src, r.dst, r.bin, round(r.dist, 9)) for r in df.collect())
    kernel = pairs(lattice.visibility(cells, walls))
    assert {k[:2] for k in kernel} == want and len(kernel) == len(want) < len(at) * (len(at) - 1)
    assert kernel == pairs(lattice.visibility(cells, walls, kernel_cells=0)) == pairs(lattice.visibility(cells, walls, 40.0))
    assert lattice.visibility(cells, walls.limit(0)).count() == len(at) * (len(at) - 1)
    for size in (0, 10):
        assert lattice.visibility(cells.limit(0), walls, kernel_cells=size).count() == 0


def test_semi_join_keeps_rows_by_value(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0, None), (1, 0.0, 0.0, 1.0, 1.0, None), (2, 5.0, 5.0, 6.0, 6.0, "x")], LINES + ", name string")
    b = prefixed(spark.createDataFrame([(7, 0.0, 1.0, 1.0, 0.0)], LINES), "b_")
    join = lambda how: [r.ref for r in spatial_join(a, b, box(a), box(b, "b_x1", "b_y1", "b_x2", "b_y2"), F.lit(True), 1.0, how).collect()]
    assert join("left_semi") == [1, 1] and join("left_anti") == [2]


def test_setvalue_and_marks(spark):
    df = spark.createDataFrame([(1, 2.0, 5), (2, None, 7), (3, 9.0, 0)], "ref long, `a b` double, n int")
    # a branch that doesn't write keeps the column; what was written is read back; a mark starts as none
    text = 'if value("n") > 4\n    setvalue("n", value("n") * 2)\n    setmark(value("n"))\nif mark() is none\n    return 100\nmark() + 1'
    got = {r.ref: (r.n, r.out) for r in FX.update(df, "out", text).collect()}
    assert got == {1: (10.0, 11.0), 2: (14.0, 15.0), 3: (0.0, 100.0)}
    got = {r.ref: (r["a b"], r.n) for r in FX.execute(df, 'setvalue("a b", value("n") / 2.0)', F.col("ref") == 1).collect()}
    assert got == {1: (2.5, 5), 2: (None, 7), 3: (9.0, 0)}
    loop = 'for i in range(0, 2)\n    setvalue("n", value("n") + 1)\nvalue("n")'
    assert {r.ref: (r.n, r.out) for r in FX.update(df, "out", loop, F.col("ref") < 3).collect()} == {1: (7.0, 7.0), 2: (9.0, 9.0), 3: (0.0, -1.0)}
    assert FX.execute(df, "1 + 1").columns == df.columns and FX.execute(df.limit(0), loop).count() == 0
    for bad in ('setvalue("Ref Number", 1)', 'setvalue("nope", 1)', 'setvalue("n", "x")', 'setvalue("n")', "mark(1)", "setmark()"):
        with pytest.raises(FX.FormulaError):
            FX.execute(df, bad).collect()
            FX.update(df, "out", bad).collect()


def test_bins(spark):
    want = {(1, 0): 0, (5, 1): 1, (3, 1): 2, (5, 4): 3, (1, 1): 4, (0, 1): 8, (-1, 1): 12, (-1, 0): 16, (-1, -1): 20, (0, -1): 24, (1, -1): 28, (5, -1): 31, (4, 5): 5, (1, 5): 7, (-1, 5): 9, (-5, -1): 17}
    df = spark.createDataFrame([(*k, v) for k, v in want.items()], "dx int, dy int, want int")
    assert df.filter(G.which_bin("dx", "dy") != F.col("want")).count() == 0


def test_links(spark):
    cells = grid(spark, 4, 3)
    none = spark.createDataFrame([], "a long, b long")
    links = lattice.merge(cells, none, spark.createDataFrame([(0, 11)], "a long, b long"))
    for bad in ((0, 5), (3, 3), (2, 99)):
        with pytest.raises(lattice.InvalidLink):
            lattice.merge(cells, links, spark.createDataFrame([bad], "a long, b long"))
    assert lattice.unmerge(links, links).count() == 0
    with pytest.raises(lattice.InvalidLink):
        lattice.unmerge(links, spark.createDataFrame([(1, 2)], "a long, b long"))
    cost = {r.ref: r for r in lattice.link_data(cells, links, 2.0).collect()}
    assert cost[0].link_to == 11 and cost[0].link_metric_cost == pytest.approx(2 * math.hypot(3, 2))


def test_metric_paths_turn_at_corners(spark):
    """Around a wall of blocked cells the path bends at its end; lengths are in cells."""
    cells = grid(spark, 5, 5, hole={(2, k) for k in range(4)})
    wall = spark.createDataFrame([(0, 2.0, -1.0, 2.0, 3.5)], LINES)
    edges = V.checkpointed(lattice.visibility(cells, wall, 10.0))
    corner = lattice.blocked_adjacent(cells)
    got = {r.ref: r for r in vga.depth_map(cells, edges, corner, [0]).collect()}
    assert got[4].depth >= 2 * math.hypot(2, 3.5) - 1e-9 and got[4].straight == 4
    assert got[5].depth == 1
    angular = {r.ref: r for r in vga.depth_map(cells, edges, corner, [0], "angular").collect()}
    assert angular[5].depth == 0 and angular[4].depth > 0.5
    for kind in ("visual", "metric", "angular"):
        path = vga.shortest_path(cells, edges, corner, 0, [4], kind).orderBy("order").collect()
        assert path[0].ref == 4 and path[0].order == 0 and path[1].order == 2 and path[-1].ref == 0
    linked = {r.ref: r for r in vga.depth_map(cells, edges, corner, [0], links={(0, 4): 1.0}).collect()}
    assert linked[4].depth == 1
    m = {r.ref: r for r in vga.metric(cells, edges, corner).collect()}
    assert m[0].node_count == 21 and m[0].mean_distance > m[0].mean_straight
    a = {r.ref: r for r in vga.angular(cells, edges, corner).collect()}
    assert a[0].mean_depth == pytest.approx(sum(r.depth for r in angular.values()) / 21)


def test_square_isovist(spark):
    s = 4.0
    room = [(0.0, 0.0, s, 0.0), (s, 0.0, s, s), (s, s, 0.0, s), (0.0, s, 0.0, 0.0)]
    walls = spark.createDataFrame([(i, *w) for i, w in enumerate(room)], LINES)
    r = vga.isovists(spark.createDataFrame([(1, 2.0, 2.0)], "ref long, x double, y double"), walls).first()
    assert r.area == pytest.approx(s * s, rel=1e-5) and r.perimeter == pytest.approx(4 * s, rel=1e-5)
    assert r.compactness == pytest.approx(math.pi / 4, rel=1e-5) and r.occlusivity == pytest.approx(0, abs=1e-4)
    assert r.min_radial == pytest.approx(2, rel=1e-5) and r.max_radial == pytest.approx(2 * math.sqrt(2), rel=1e-5) and r.drift_magnitude == pytest.approx(0, abs=1e-5)
    blind = walls.union(spark.createDataFrame([(9, 3.0, 1.0, 3.0, 3.0)], LINES))
    r = vga.isovists(spark.createDataFrame([(1, 2.0, 2.0)], "ref long, x double, y double"), blind).first()
    assert r.area == pytest.approx(16 - 3, rel=1e-4) and r.occlusivity == pytest.approx(2 * math.hypot(1, 1), rel=1e-4)
    part = spark.createDataFrame([(1, 2.0, 2.0, 0.0, 90.0)], "ref long, x double, y double, angle double, view_angle double")
    assert vga.isovists(part, walls).first().area == pytest.approx(4, rel=1e-4)


def test_polygon_geometry(spark):
    rows = [(0, [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]), (1, [(0.0, 0.0), (0.0, 3.0), (4.0, 3.0), (4.0, 0.0)]), (2, [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)])]
    df = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in p]) for i, p in rows], "ref long, points array<struct<x:double,y:double>>")
    cx, cy = G.centroid("points")
    got = df.select("ref", G.signed_area("points").alias("a"), cx.alias("cx"), cy.alias("cy"), G.perimeter("points").alias("p"), G.point_in_polygon(F.lit(1.0), F.lit(1.0), "points").alias("inside"), G.point_in_polygon(F.lit(3.5), F.lit(2.5), "points").alias("corner"), G.angular_deviation("points").alias("turn")).orderBy("ref").collect()
    assert [r.a for r in got] == [12, -12, 8] and [r.inside for r in got] == [True] * 3 and [r.corner for r in got] == [True, True, False]
    assert got[0].cx == got[1].cx == 2 and got[2].cy == pytest.approx(4 / 3) and got[0].p == 14 and got[0].turn == pytest.approx(2)


@pytest.mark.parametrize("how,want", [("max", [5.0, -1.0]), ("min", [2.0, -1.0]), ("avg", [3.5, -1.0]), ("tot", [7.0, -1.0]), ("none", [-1.0, -1.0])])
def test_push(spark, how, want):
    points = spark.createDataFrame([(0, 0.5, 0.5, 2.0), (1, 0.6, 0.2, 5.0), (2, 0.1, 0.1, -1.0), (3, 9.0, 9.0, 8.0)], "ref long, x double, y double, value double")
    box = lambda x, y: [{"x": x + a, "y": y + b} for a, b in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))]
    zones = spark.createDataFrame([(0, box(0.0, 0.0)), (1, box(3.0, 3.0))], "ref long, points array<struct<x:double,y:double>>")
    got = P.points_to_polygons(points, zones, how, 0.7).orderBy("ref").collect()
    assert [r.pushed for r in got] == want and [r.n for r in got] == [2, 0]


# --- formulas


def evaluated(spark, text, **row):
    df = spark.createDataFrame([(1, *map(float, row.values()))], "ref long" + "".join(f", {k} double" for k in row))
    return FX.update(df, "out", text).first()["out"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("1 + 2 * 3 ^ 2", 19),
        ("7 / 2", 3),
        ("-7 / 2", -3),
        ("7 / 2.0", 3.5),
        ("7 % 4", 3),
        ("1.0 / 0", -1),
        ("2 ^ 3 ^ 2", 512),
        ("-2 ^ 2", -4),
        ("true and false or true", 1),
        ("1 == 1 and not 2 > 3", 1),
        ("log(1000) + ln(e)", 4),
        ("len(range(0, 5)) + len([1, 2])", 7),
        ("a = [1, 2, 3]\na.append(9)\na[-1] + a[0]", 10),
        ('value("x") + value("Ref Number")', 6),
        ("if value(\"x\") > 4:\n    return 10\n20", 10),
        ("if value(\"x\") > 9:\n    return 10\n20", 20),
        ("a = 1\nif value(\"x\") > 9:\n    a = 2\nelif value(\"x\") > 4:\n    a = 3\na * 2", 6),
        ("t = 0\nfor k in range(1, 4):\n    t = t + k\nt", 6),
        ("n = 0\nwhile n < 5:\n    n = n + 2\nreturn n", 6),
        ("5 is 5.0", 1),
        ('"a" is 1', 0),
        ("sqrt(-1)", -1),
    ],
)
def test_formulas(spark, text, want):
    assert evaluated(spark, text, x=5) == pytest.approx(want)


@pytest.mark.parametrize("text", ["1 +", "\t1", "value(\"nothing\")", "1 == \"a\"", "nobody", "if 1:\n2", "1 2", "range(0, 1, 0)"])
def test_formula_faults(spark, text):
    with pytest.raises(FX.FormulaError):
        evaluated(spark, text, x=5)


def test_formula_selection(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "ref long, x double")
    got = FX.update(df, "x", 'value("x") * 10', F.col("ref") > 1).orderBy("ref").collect()
    assert [r.x for r in got] == [1, 20, 30]
    assert FX.select(df, 'value("x") >= 2').count() == 2


def test_connections(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 40.0), (4, 80.0)], "ref long, `a b` double")
    edges = spark.createDataFrame([(1, 2, "fwd", 0), (1, 3, "back", 8), (2, 1, "back", 16), (3, 1, "fwd", 24)], "src long, dst long, side string, bin int")
    run = lambda text, **more: {r.ref: r.got for r in FX.update(df, "got", text, edges=edges, **more).collect()}
    assert run("len(connections())") == {1: 2, 2: 1, 3: 1, 4: 0}
    assert run('t = 0\nfor n in connections():\n    t = t + n.value("a b")\nt + value("a b")') == {1: 70, 2: 30, 3: 50, 4: 80}
    assert run('connections("all")[0].value("a b")') == {1: 20, 2: 10, 3: 10, 4: -1}
    assert run('connections("back")[0].value("Ref Number")') == {1: 3, 2: 1, 3: -1, 4: -1}
    assert run("len(connections(24)) + 10 * len(connections(\"forward\"))") == {1: 10, 2: 0, 3: 11, 4: 0}
    written = FX.execute(df, 't = 0\nfor n in connections():\n    t = t + n.value("a b")\nsetvalue("a b", t)', edges=edges)
    assert written.columns == df.columns and {r.ref: r["a b"] for r in written.collect()} == {1: 60, 2: 10, 3: 10, 4: 0}
    assert {r.ref for r in FX.select(df, "len(connections()) > 1", edges).collect()} == {1}
    for text in ('connections("left")', "connections(32)", 'connections()[0].value("nothing")'):
        with pytest.raises(FX.FormulaError):
            run(text)
    with pytest.raises(FX.FormulaError):
        FX.update(df, "got", "len(connections())")


# --- attribute tables


def test_attribute_table(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (2, 1, 7.0), (4, 1, 5.0)], "ref long, layer_key long, v double")
    assert A.get_or_insert(df, "v").columns == df.columns and A.insert_or_reset(df, "v").filter("v is not null").count() == 0
    assert A.add_row(df, 9).count() == 4 and A.remove_row(df, 2).count() == 2
    for bad in (lambda: A.add_row(df, 1), lambda: A.remove_row(df, 7)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        A.rename_column(df, "nothing", "x")
    assert [r.idx for r in A.with_row_index(df).orderBy("ref").collect()] == [0, 1, 2]
    assert [r.ref for r in A.sorted_index(df, "v").collect()] == [1, 4, 2]
    assert [r.normalised for r in A.normalised(df, "v").orderBy("ref").collect()] == [0, 1, 0]
    assert A.selection_average(df, "v", F.lit(False)).first().average == -1
    with pytest.raises(ValueError):
        A.import_attributes(df, spark.createDataFrame([(8, 1.0)], "Ref long, z double"))
    layers = A.Layers()
    layers.add("one")
    with pytest.raises(ValueError):
        layers.add("one")
    pushed = layers.push_selection(df, "one", F.col("v") > 5)
    layers.show("one")
    assert pushed.filter(layers.is_visible()).select("ref").collect()[0].ref == 2
    assert [r.c for r in df.select(A.colour_ramp((F.col("v") - 5) / 2).alias("c")).collect()] == ["#0000ff", "#ff0000", "#0000ff"]


# --- readers and writers


def save(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_tables(spark, tmp_path):
    p = save(tmp_path, "points.csv", '"Easting","northing",Ref,land_use,size\n1,2,7,shop,3\n4,5,9,house,x\n')
    got = readers.read_shapes(spark, p, "csv").orderBy("ref").collect()
    assert [(r.ref, r.shape_type, r.points[0].x, r["Land Use"], r["Size"]) for r in got] == [(7, "point", 1, 0, 3), (9, "point", 4, 1, 0)]
    p = save(tmp_path, "lines.tsv", "x1\ty1\tx2\ty2\n0\t0\t1\t1\n2\t2\t3\t3\n")
    assert sorted(r.ref for r in readers.read_shapes(spark, p, "tsv").collect()) == [0, 1]
    with pytest.raises(readers.ImportFault):
        readers.read_table(spark, save(tmp_path, "one.csv", "x\n1\n"))
    with pytest.raises(readers.ImportFault):
        readers.read_shapes(spark, save(tmp_path, "none.csv", "a,b\n1,2\n"), "csv")
    many = spark.createDataFrame([(i, f"k{i}") for i in range(40)], "ref long, v string")
    assert {r.code for r in readers.category_codes(many, "v", "ref").collect()} == {-1}
    assert readers.parse_isovist("1,2") == (1, 2, 0, 360)
    with pytest.raises(readers.ImportFault):
        readers.parse_isovist("1,2,3")


def test_text_formats(spark, tmp_path):
    shapes = readers.read_shapes(spark, save(tmp_path, "a.cat", "# c\nbegin polygon\n0 0\n1 0\n1 1\nend\nbegin polyline\n0 0\n2 2\nend\n"), "cat")
    assert [(r.shape_type, len(r.points), r.closed) for r in shapes.orderBy("ref").collect()] == [("polygon", 3, True), ("line", 2, False)]
    writers.write_lines(writers.cat(shapes), str(tmp_path / "out_cat"))
    again = "".join(x.read_text() for x in sorted((tmp_path / "out_cat").glob("part-*")))
    assert [len(s[2]) for s in readers.parse_cat(again)] == [3, 2]
    mif, mid = writers.mif(shapes.withColumn("v", F.lit(2.5)), ["v"])
    writers.write_lines(mif, str(tmp_path / "out_mif"))
    writers.write_lines(mid, str(tmp_path / "out_mid"))
    text = "".join(x.read_text() for x in sorted((tmp_path / "out_mif").glob("part-*")))
    assert [(s[1], len(s[2])) for s in readers.parse_mif(text)] == [("polygon", 3), ("line", 2)]
    got = readers.read_mif_attributes(spark, str(tmp_path / "out_mif"), str(tmp_path / "out_mid"))
    assert got.columns == ["ref", "v"] and {r.v for r in got.collect()} == {2.5}
    row = list(" " * 228)
    row[0], row[55:58], row[190:200], row[200:209], row[209:219], row[219:228] = "1", "A41", " -71000000", "+42000000", " -71100000", "+42100000"
    t = readers.read_shapes(spark, save(tmp_path, "t.rt1", "".join(row) + "\n" + "2" + " " * 240), "rt1").collect()
    assert len(t) == 1 and t[0].layer == "A4" and t[0].points[1].y == pytest.approx(42.1)


DXF = """0
SECTION
2
BLOCKS
0
BLOCK
2
B
10
1
20
0
0
LINE
8
0
10
1
20
0
11
2
21
0
0
ENDBLK
0
ENDSEC
0
SECTION
2
ENTITIES
0
LINE
8
walls
10
0
20
0
11
3
21
4
0
LINE
8
walls
10
1
20
1
11
1
21
1
0
LWPOLYLINE
8
p
70
1
10
0
20
0
10
1
20
0
10
1
20
1
0
POLYLINE
8
p
70
0
0
VERTEX
10
0
20
0
0
VERTEX
10
5
20
0
0
VERTEX
10
5
20
5
0
SEQEND
0
CIRCLE
8
c
10
0
20
0
40
2
0
ARC
8
c
10
0
20
0
40
1
50
270
51
90
0
INSERT
8
i
2
B
10
10
20
0
41
2
42
2
50
90
0
POINT
8
x
10
1
20
2
0
ENDSEC
0
EOF
"""


def test_dxf(spark, tmp_path):
    got = readers.read_shapes(spark, save(tmp_path, "d.dxf", DXF), "dxf").orderBy("ref").collect()
    assert [(r.layer, r.shape_type) for r in got] == [("walls", "line"), ("p", "polygon"), ("p", "polyline"), ("c", "polygon"), ("c", "polyline"), ("i", "line"), ("x", "point")]
    assert len(got[3].points) == 64 and (got[4].points[0].y, got[4].points[-1].y) == pytest.approx((-1, 1))
    assert [(p.x, p.y) for p in got[5].points] == [pytest.approx((10, 0)), pytest.approx((10, 2))]


def test_ntf():
    text = "0205LANDLINE\n050001Wall\\0%\n07" + " " * 44 + "0000400000" + "0000300000" + "0%\n23000001" + " " * 8 + "00010%\n" + "21" + "000001" + "1" + "0002" + "00100" + "00200" + " " + "00300" + "00400" + " 0%\n"
    got = readers.parse_ntf(text)
    assert got == [("Wall", "line", [(400001.0, 300002.0), (400003.0, 300004.0)], False)]


def test_exports(spark, tmp_path):
    nodes = spark.createDataFrame([(3, 0.0, 0.0), (5, 2.0, 1.0), (8, 4.0, 2.0)], "ref long, x double, y double")
    edges = spark.createDataFrame([(3, 5), (5, 3), (5, 8), (8, 5)], "src long, dst long")
    dot = [r.value for r in writers.dot_graph(nodes, edges).orderBy("part", "at").collect()]
    assert dot == ["strict graph {", "    0 -- 1", "    1 -- 2", "}"]
    net = [r.value for r in writers.pajek(nodes, edges).orderBy("part", "at").collect()]
    assert net[0] == "*Vertices 3" and net[2] == '2 "5" 0.500000 0.250000' and net[-1] == "2 3 1"
    assert writers.connection_pairs(edges).count() == 2
    assert writers.summary(nodes.withColumn("b", F.lit(1.5)).withColumn("a", F.lit(2.0)), ("ref", "x", "y")).columns == ["Ref", "x", "y", "a", "b"]
    writers.save_project(str(tmp_path / "p"), {"nodes": nodes, "edges": edges})
    assert writers.load_project(spark, str(tmp_path / "p"), ["nodes"])["nodes"].count() == 3


# --- drawings and agents


def shapes_of(spark, rows):
    return spark.createDataFrame([(i, "l", k, [{"x": float(x), "y": float(y)} for x, y in p], k == "polygon") for i, (k, p) in enumerate(rows)], SHAPES)


def test_conversions(spark):
    d = shapes_of(spark, [("line", [(0, 0), (4, 0)]), ("polyline", [(2, -1), (2, 1), (5, 1)]), ("line", [(0, 0), (4, 0)])])
    lines, edges = drawing.to_axial(d)
    assert lines.count() == 3 and edges.count() == 4
    segments, _ = drawing.axial_to_segments(lines, attributes=["Drawing Layer"])
    assert segments.count() == 5 and {r["Axial Drawing Layer"] for r in segments.collect()} == {"l"}
    square = lambda x: ("polygon", [(x, 0), (x + 1, 0), (x + 1, 1), (x, 1)])
    _, touching = drawing.to_convex(shapes_of(spark, [square(0), square(1), square(5)]))
    assert sorted(map(tuple, touching.collect())) == [(0, 1), (1, 0)]
    _, ends = drawing.to_segments(d)
    assert ends.filter("weight > 0.99").count() == 2
    with pytest.raises(drawing.EmptyDrawing):
        drawing.to_axial(shapes_of(spark, [("point", [(0, 0)])]))


def test_shape_edits(spark):
    d = shapes_of(spark, [("line", [(0, 0), (1, 0)])])
    d = drawing.add_shape(d, [(5, 5), (6, 6)], "line")
    d = drawing.close_shape(drawing.append_point(d, 1, (7, 5)), 1)
    r = d.filter("ref = 1").first()
    assert r.closed and r.shape_type == "polygon" and len(r.points) == 3
    with pytest.raises(ValueError):
        drawing.add_shape(d, [(0, 0)], "point", ref=1)
    assert drawing.remove_shape(d, 0).count() == 1
    points = spark.createDataFrame([(0, 0.0, 0.0)], "ref long, x double, y double")
    octagon = drawing.points_to_polygons(points, 1.0).select(G.signed_area("points").alias("a")).first().a
    assert octagon == pytest.approx(2 * math.sqrt(2)) and drawing.disk_triangles(points, 1.0).count() == drawing.circle_lines(points, 1.0).count() == 32
    cells = spark.createDataFrame([(0, 0), (1, 0)], "x int, y int")
    assert drawing.outline(cells).count() == 6
    walls = spark.createDataFrame([(0, 2.0, -1.0, 2.0, 1.0), (1, 3.0, -1.0, 3.0, 1.0)], LINES)
    line = spark.createDataFrame([(7, 0.0, 0.0, 4.0, 0.0)], LINES)
    assert drawing.cut_lines(line, walls).first().x2 == 2


def test_all_line_map(spark):
    room = [(0.0, 0.0, 6.0, 0.0), (6.0, 0.0, 6.0, 6.0), (6.0, 6.0, 0.0, 6.0), (0.0, 6.0, 0.0, 0.0)]
    block = [(2.0, 2.0, 4.0, 2.0), (4.0, 2.0, 4.0, 4.0), (4.0, 4.0, 2.0, 4.0), (2.0, 4.0, 2.0, 2.0)]
    walls = spark.createDataFrame([(i, *w) for i, w in enumerate(room + block)], LINES)
    lines = V.checkpointed(drawing.all_lines(walls, (1.0, 1.0)))
    got = {(r.x1, r.y1, r.x2, r.y2) for r in lines.collect()}
    assert (0.0, 2.0, 6.0, 2.0) in got and (0.0, 0.0, 6.0, 0.0) in got and (2.0, 0.0, 2.0, 6.0) in got
    from netloom.operators.axial import line_edges

    edges = V.checkpointed(line_edges(lines, 1e-6))
    subsets, minimal = drawing.fewest_lines(lines, edges)
    assert 0 < minimal.count() <= subsets.count() <= lines.count()
    with pytest.raises(ValueError):
        drawing.all_lines(walls, (50.0, 0.0))


@pytest.mark.parametrize("rule", agents.RULES)
def test_agents(spark, rule):
    cells = grid(spark, 6, 6)
    sight = V.checkpointed(lattice.visibility(cells, no_walls(spark), 4.0))
    steps = lattice.neighbour_edges(cells).select("src", "dst")
    occ = lattice.bin_distances(sight).withColumnRenamed("distance", "occ_distance") if "occlusion" in rule else None
    program = agents.Program([0.1, 0.2, 0.3, 0.4] + [0.5] * 4 + [0.7] * 4) if rule == "evolved" else None
    s = agents.Settings(steps=30, rate=0.4, life=20, rule=rule, seed=3, program=program)
    moves = agents.run(cells, sight, steps, s, occ)
    rows = sorted(map(tuple, moves.collect()))
    assert rows and rows == sorted(map(tuple, agents.run(cells, sight, steps, s, occ).collect()))
    at = {(a, t): c for a, t, c in rows}
    assert all(max(abs(at[a, t] % 6 - at[a, t + 1] % 6), abs(at[a, t] // 6 - at[a, t + 1] // 6)) <= 1 for a, t in at if (a, t + 1) in at)
    counts = agents.gate_counts(cells.filter("filled"), moves)
    assert counts.agg(F.sum("gate_count")).first()[0] == len(rows)
    assert agents.trails(moves, cells, 2).count() <= 2


def test_genes_drive_agents(spark):
    """The order, the shares and the chances decide where an agent looks, and walks of different programs differ."""
    off, dist = np.array([0, 2, -2, 7, -7]), np.array([4.0, 3.0, 9.0, 8.0, 1.0])
    look = lambda *genes: np.flatnonzero(agents.evolved_sight(agents.Program(list(genes)), 15, off, dist, np.random.default_rng(1))).tolist()
    near, far = (0.1, 0.2, 0.3, 0.4), (0.4, 0.3, 0.2, 0.1)
    share, always, never = (0.6,) * 4, (1.0,) * 4, (0.0,) * 4
    assert look(*near, *share, *always) == [2] and look(*far, *share, *always) == [3]
    assert look(*near, *share, *never) == [0] and look(*near, *(0.9,) * 4, *always) == [0]
    assert look(*near, 0.3, *share[1:], *always) in ([1], [2])
    cells = grid(spark, 7, 7)
    sight, steps = lattice.visibility(cells, no_walls(spark), 12.0), lattice.neighbour_edges(cells)
    walks = []
    for genes in ([*near, *share, *always], [*near, *share, *never]):
        s = agents.Settings(steps=20, rate=0.5, life=15, rule="evolved", seed=3, program=agents.Program(genes))
        walks.append(sorted(map(tuple, agents.run(cells, sight, steps, s).collect())))
    assert walks[0] and walks[1] and walks[0] != walks[1]
    for bad in (None, agents.Program([0.5])):
        with pytest.raises(ValueError):
            agents.Settings(rule="evolved", program=bad)


def test_agent_programs():
    rng = np.random.default_rng(0)
    population = [agents.Program([k / 10] * 4, fitness=k) for k in range(10)]
    nxt = agents.evolve(population, rng)
    assert len(nxt) == 10 and np.mean([p.genes[0] for p in nxt]) > 0.45
    assert agents.load_program(agents.save_program(nxt[0])) == nxt[0]
    with pytest.raises(ValueError):
        agents.Settings(rule="nothing")


def test_shape_relations(spark):
    d = shapes_of(spark, [("polygon", [(0, 0), (4, 0), (4, 4), (0, 4)]), ("line", [(1, 1), (2, 2)]), ("line", [(-1, 2), (9, 2)]), ("point", [(3, 3)]), ("polygon", [(20, 20), (21, 20), (21, 21)]), ("line", [(8, 0), (8, 5)])])
    got = {tuple(r) for r in drawing.shape_connections(d).collect()}
    assert {p for p in got if p[0] < p[1]} == {(0, 1), (0, 2), (0, 3), (1, 2), (2, 5)}
    assert {r.ref for r in drawing.shapes_in_region(d, (7, -1, 10, 10)).collect()} == {2, 5}
    points = spark.createDataFrame([(0, 1.0, 3.0), (1, 8.5, 4.0), (2, 50.0, 50.0)], "ref long, x double, y double")
    assert {r.ref: r.shape for r in drawing.shape_at(points, d, 2.0).collect()} == {0: 0, 1: 5, 2: -2}
    assert {r.ref: round(r.distance, 6) for r in drawing.nearest_shape(points, d, 2.0).collect()} == {0: 1.0, 1: 0.5}
    lines = spark.createDataFrame([(0, 0.0, 0.0, 4.0, 0.0), (1, 0.0, 5.0, 4.0, 5.0)], LINES)
    more = spark.createDataFrame([(2, 2.0, -1.0, 2.0, 6.0)], LINES)
    none = spark.createDataFrame([], "src long, dst long")
    assert sorted(map(tuple, drawing.connect_added(lines, none, more).collect())) == [(0, 2), (1, 2), (2, 0), (2, 1)]


def test_cells_and_occlusions(spark):
    cells = grid(spark, 4, 3)
    some = cells.filter("ref < 2").select("ref")
    links = spark.createDataFrame([(0, 5), (3, 4)], "a long, b long")
    cleared, left = lattice.clear_cells(cells, links, some)
    assert cleared.filter("filled").count() == 10 and left.count() == 1
    assert writers.merge_lines(cells, links).count() == 2 and writers.point_list(cleared).count() == 10
    edges = V.checkpointed(lattice.visibility(cells, no_walls(spark), 10.0))
    assert {r.ref: r.node_bins for r in lattice.node_bins(edges, 0).collect()}[1] == 3
    room = [(0.0, 0.0, 9.0, 0.0), (9.0, 0.0, 9.0, 9.0), (9.0, 9.0, 0.0, 9.0), (0.0, 9.0, 0.0, 0.0), (4.0, 3.0, 4.0, 6.0)]
    walls = spark.createDataFrame([(i, *w) for i, w in enumerate(room)], LINES)
    got = vga.occlusions(spark.createDataFrame([(1, 2.0, 4.5)], "ref long, x double, y double"), walls).collect()
    assert {r.bin for r in got} == {3, 29} and all(r.occ_distance > 1.5 for r in got)
    assert spark.range(1).select(lattice.pick_cell(F.lit(1.0), 3, 4).alias("c"), lattice.pick_cell(F.lit(0.0), 3, 4).alias("d")).first() == (11, 0)
