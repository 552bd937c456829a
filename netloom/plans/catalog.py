"""The package's queries over the test tables, by name, and their SQL (oracles.py). Each runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import formula as FX
from netloom.functions import geometry as G
from netloom.operators import agents
from netloom.operators import attributes as A
from netloom.operators import axial as X
from netloom.operators import lattice as L
from netloom.operators import push as P
from netloom.operators import segment as S
from netloom.operators import traverse as V
from netloom.operators import vga
from netloom.sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, counts as long, so that results compare by value."""
    kinds = dict(df.dtypes)
    return df.select([(F.round(c, digits) + F.lit(0.0)).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) if kinds[c] in ("int", "smallint", "tinyint") or kinds[c].startswith("decimal") else F.col(c) for c in df.columns])


def _network(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = fx.supplier_lines(spark, d)
    return lines, V.checkpointed(X.line_edges(lines, cell=4.0))


def _first(edges: DataFrame) -> DataFrame:
    """ref: the least node that has an edge."""
    return edges.agg(F.min("src").alias("ref")).filter("ref is not null")


# --- line networks


@query
def axial_edges(spark, d):
    return X.line_edges(fx.supplier_lines(spark, d), cell=4.0)


@query
def axial_connectivity(spark, d):
    lines, edges = _network(spark, d)
    return _r(X.connectivity(lines, edges))


@query
def axial_step_depth(spark, d):
    lines, edges = _network(spark, d)
    return _r(X.step_depth(lines, edges, _first(edges)))


@query
def axial_local(spark, d):
    lines, edges = _network(spark, d)
    return _r(X.local_measures(lines, edges))


_GLOBAL = ("ref", "node_count", "mean_depth", "integration_hh", "integration_p", "integration_tekl", "ra", "rra", "total_depth", "ra_penn", "entropy", "relativised_entropy", "intensity", "harmonic_mean_depth")


@query
def axial_integration_rn(spark, d):
    lines, edges = _network(spark, d)
    return _r(X.integration(X.levels(lines, edges)).select(*_GLOBAL))


@query
def axial_integration_r3(spark, d):
    lines, edges = _network(spark, d)
    return _r(X.integration(X.levels(lines, edges, limit=3), 3).select(*_GLOBAL))


@query
def axial_integration_r2_frontier(spark, d):
    """The same by the frontier loop, the form for graphs beyond the kernel."""
    lines, edges = _network(spark, d)
    levels = V.all_pairs_frontier(edges, lines, 2).groupBy("root", "depth").agg(F.count("*").alias("n")).withColumn("w", F.lit(0.0))
    return _r(X.integration(levels, 2).select(*_GLOBAL))


@query
def axial_weighted_depth(spark, d):
    lines, edges = _network(spark, d)
    return _r(X.integration(X.levels(lines, edges, "weight")).select("ref", "mean_depth_weighted", "total_weight"))


@query
def axial_choice(spark, d):
    lines, edges = _network(spark, d)
    return _r(X.choice(lines.withColumn("weight", F.col("weight") / 1000), edges, "weight"), 4)


@query
def axial_shortest_path(spark, d):
    lines, edges = _network(spark, d)
    start = edges.agg(F.min("src")).first()[0]
    far = V.multi_source_depth(edges, _first(edges)).orderBy(F.desc("depth"), "ref").first()
    return _r(V.shortest_path(edges, start, far["ref"]))


@query
def links_unlinks(spark, d):
    lines, edges = _network(spark, d)
    refs = lines.select("ref")
    extra = refs.filter("ref % 10 = 0").select(F.col("ref").alias("a"), (F.col("ref") + 1).alias("b")).join(refs.select(F.col("ref").alias("b")), "b", "left_semi").select("a", "b")
    gone = edges.filter("src % 7 = 0 and src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return X.unlink(X.link(edges, extra), gone)


@query
def unlink_crossings(spark, d):
    lines, edges = _network(spark, d)
    pairs = edges.filter("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return _r(X.unlink_points(lines, pairs).filter("x is not null"))


@query
def copurchase_components_depth(spark, d):
    """Depth from the least part of a graph of many parts that don't reach each other."""
    edges = V.checkpointed(fx.copurchase_edges(spark, d))
    nodes = edges.select(F.col("src").alias("ref")).distinct()
    return _r(X.step_depth(nodes, edges, _first(edges)))


@query
def quick_tidy(spark, d):
    lines = fx.supplier_lines(spark, d)
    copies = lines.filter("ref % 5 = 0").select((F.col("ref") + 100000).alias("ref"), F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"), "weight")
    return _r(S.quick_tidy(lines.unionByName(copies)).select("ref", "x1", "y1", "x2", "y2"))


@query
def tidy_lines(spark, d):
    return _r(S.tidy(fx.supplier_lines(spark, d)))


# --- segments


def _segments(spark, d):
    segments = V.checkpointed(S.split_lines(fx.supplier_lines(spark, d), cell=4.0))
    return segments, V.checkpointed(S.segment_edges(segments))


@query
def segment_split(spark, d):
    segments, _ = _segments(spark, d)
    return _r(segments.groupBy(F.col("axial_ref").alias("ref")).agg(F.count("*").alias("pieces"), F.sum("length").alias("length")))


@query
def segment_connectivity(spark, d):
    """Angular connectivity of drawn lines that share ends."""
    lines = fx.supplier_lines(spark, d)
    return _r(S.connectivity(lines, S.segment_edges(lines)).drop("axial_ref"))


@query
def segment_of_split_connectivity(spark, d):
    segments, edges = _segments(spark, d)
    return _r(S.connectivity(segments, edges))


@query
def push_axial_to_segment(spark, d):
    lines, edges = _network(spark, d)
    segments = S.split_lines(lines, cell=4.0)
    got = P.push_by_key(X.connectivity(lines, edges).select("ref", "connectivity"), segments.select("ref", "axial_ref"), "axial_ref", "axial_")
    return _r(got.groupBy("axial_ref", "axial_connectivity").agg(F.count("*").alias("pieces")))


@query
def segment_angular(spark, d):
    segments, edges = _segments(spark, d)
    return _r(S.angular(segments, edges, [None, 2.0]))


@query
def segment_tulip(spark, d):
    segments, edges = _segments(spark, d)
    return _r(S.tulip(segments, edges, radius=6.0, radius_type="metric"))


@query
def segment_tulip_leaf_choice(spark, d):
    segments, edges = _segments(spark, d)
    return _r(S.tulip(segments, edges, radius=2.0, radius_type="angular", leaf_choice=True))


@query
def segment_metric(spark, d):
    segments, edges = _segments(spark, d)
    return _r(S.metric(segments, edges, radius=6.0))


@query
def segment_topological(spark, d):
    segments, edges = _segments(spark, d)
    return _r(S.metric(segments, edges, radius=6.0, kind="topological"))


@query
def segment_metric_totals(spark, d):
    segments, edges = _segments(spark, d)
    return _r(S.metric(segments, edges, radius=6.0).select("ref", "mean_depth", "mean_depth_slw", "total_depth", "total_nodes", "total_length"), 5)


@query
def segment_topological_totals(spark, d):
    segments, edges = _segments(spark, d)
    return _r(S.topological_totals(segments, edges), 5)


@query
def segment_tulip_totals(spark, d):
    segments, edges = _segments(spark, d)
    return _r(S.tulip_totals(segments, edges), 5)


def _step(kind):
    def run(spark, d):
        segments, edges = _segments(spark, d)
        origin = edges.agg(F.min("src")).first()[0]
        return _r(S.step_depth(segments, edges, [origin], kind))

    return run


def _path(kind):
    def run(spark, d):
        segments, edges = _segments(spark, d)
        a = edges.agg(F.min("src")).first()[0]
        far = S.step_depth(segments, edges, [a], kind).orderBy(F.desc("step_depth"), "ref").first()
        return _r(S.shortest_path(segments, edges, a, far["ref"], kind))

    return run


for _kind in ("metric", "topological", "tulip"):
    QUERIES[f"segment_{_kind}_step_depth"] = _step(_kind)
    QUERIES[f"segment_{_kind}_shortest_path"] = _path(_kind)


# --- lattices


def _lattice(spark, d):
    return fx.part_lattice(spark, d)


def _sight(spark, d, reach=3.0):
    cells = _lattice(spark, d)
    return cells, V.checkpointed(L.visibility(cells, fx.supplier_lines(spark, d), reach))


def _seen_once(spark, d, reach=3.0):
    """What is read once isn't written first."""
    cells = _lattice(spark, d)
    return cells, L.visibility(cells, fx.supplier_lines(spark, d), reach)


def _unlimited(spark, d):
    """What is read once isn't written first."""
    cells = _lattice(spark, d)
    return cells, L.visibility(cells, fx.supplier_lines(spark, d))


def _least_filled(cells: DataFrame) -> DataFrame:
    return cells.filter("filled").agg(F.min("ref").alias("ref"))


@query
def lattice_grid_connections(spark, d):
    return L.grid_connections(*_seen_once(spark, d))


@query
def lattice_blocked_adjacent(spark, d):
    return L.blocked_adjacent(_lattice(spark, d))


@query
def lattice_flood_fill(spark, d):
    cells = _lattice(spark, d)
    return _r(L.flood_fill(cells, _least_filled(cells)))


@query
def lattice_visibility_moments(spark, d):
    cells, edges = _seen_once(spark, d)
    return _r(L.moments(cells, edges))


@query
def lattice_bin_counts(spark, d):
    _, edges = _seen_once(spark, d)
    return _r(L.bin_counts(edges))


@query
def lattice_bin_distances(spark, d):
    _, edges = _seen_once(spark, d)
    return _r(L.bin_distances(edges))


@query
def lattice_grid(spark, d):
    return _r(L.set_grid(spark, (0.0, 0.0, 10.0, 6.0), 0.5))


@query
def lattice_line_cells(spark, d):
    return _r(L.line_cells(fx.supplier_lines(spark, d), (0.0, 0.0), 1.0))


@query
def visual_local(spark, d):
    return _r(vga.near_local(_lattice(spark, d), fx.supplier_lines(spark, d), 3.0))


@query
def visual_global_r3(spark, d):
    return _r(vga.near_global(_lattice(spark, d), fx.supplier_lines(spark, d), 3.0, 3))


@query
def visual_global_rn(spark, d):
    cells, edges = _unlimited(spark, d)
    return _r(vga.visual_global(cells, V.checkpointed(edges)))


@query
def visual_global_linked(spark, d):
    cells, edges = _sight(spark, d)
    return _r(vga.visual_global(cells, edges, links=_links(cells)))


@query
def visual_step_depth(spark, d):
    cells, edges = _sight(spark, d)
    return _r(vga.visual_step_depth(cells, edges, _least_filled(cells)))


@query
def agent_gate_counts(spark, d):
    filled = _lattice(spark, d).filter("filled")
    moves = agents.run(filled, None, None, agents.Settings(steps=200, rate=0.5), walls=fx.supplier_lines(spark, d))
    return agents.gate_counts(filled, moves)


@query
def through_vision(spark, d):
    cells, edges = _seen_once(spark, d)
    return L.through_vision(cells, edges)


@query
def unlimited_moments(spark, d):
    return _r(L.sight_sums(_lattice(spark, d), fx.supplier_lines(spark, d), "moments"))


@query
def unlimited_bin_counts(spark, d):
    return L.sight_sums(_lattice(spark, d), fx.supplier_lines(spark, d), "bin_counts")


@query
def unlimited_bin_distances(spark, d):
    return _r(L.sight_sums(_lattice(spark, d), fx.supplier_lines(spark, d), "bin_distances"))


@query
def unlimited_step_depth(spark, d):
    cells = _lattice(spark, d)
    return _r(vga.unlimited_step_depth(cells, fx.supplier_lines(spark, d), _least_filled(cells)))


@query
def unlimited_through_vision(spark, d):
    return L.sight_through(_lattice(spark, d), fx.supplier_lines(spark, d))


@query
def isovist_zone(spark, d):
    cells, edges = _seen_once(spark, d)
    starts = fx.supplier_lines(spark, d).select(F.col("x1").alias("x"), F.col("y1").alias("y")).distinct()
    return _r(L.isovist_zone(cells, edges, cells.filter("filled").join(starts, ["x", "y"], "left_semi").select("ref")))


def _links(cells: DataFrame) -> DataFrame:
    f = cells.filter("filled")
    pairs = f.filter("ref % 40 = 0").select(F.col("ref").alias("a"), (F.col("ref") + 7).alias("b")).join(f.select(F.col("ref").alias("b")), "b", "left_semi").select("a", "b")
    return L.merge(cells, pairs.limit(0), pairs)


@query
def link_data(spark, d):
    cells = _lattice(spark, d)
    return _r(L.link_data(cells, _links(cells), 2.0))


def _sight_corner(spark, d):
    """The lattice with what its cells see and which are beside a blocked one."""
    cells, edges = _sight(spark, d)
    return cells, edges, L.blocked_adjacent(cells)


@query
def metric_global(spark, d):
    return _r(vga.metric(*_sight_corner(spark, d)))


@query
def angular_global(spark, d):
    return _r(vga.angular(*_sight_corner(spark, d)))


@query
def metric_depth(spark, d):
    cells, edges, corner = _sight_corner(spark, d)
    return _r(vga.depth_map(cells, edges, corner, [_least_filled(cells).first()[0]]))


@query
def metric_global_distances(spark, d):
    return _r(vga.metric(*_sight_corner(spark, d), radius=5.0).drop("mean_angle"))


@query
def metric_depth_lengths(spark, d):
    return _r(metric_depth(spark, d).drop("angle"))


@query
def metric_depth_link_lengths(spark, d):
    return _r(QUERIES["metric_depth_link_cost"](spark, d).drop("angle"))


@query
def angular_depth(spark, d):
    cells, edges, corner = _sight_corner(spark, d)
    return _r(vga.depth_map(cells, edges, corner, [_least_filled(cells).first()[0]], "angular"))


@query
def metric_depth_link_cost(spark, d):
    cells, edges, corner = _sight_corner(spark, d)
    ends = cells.filter("filled").agg(F.min("ref"), F.max("ref")).first()
    return _r(vga.depth_map(cells, edges, corner, [ends[0]], links={(ends[0], ends[1]): 1.0}))


def _vga_path(kind):
    def run(spark, d):
        cells, edges, corner = _sight_corner(spark, d)
        ends = cells.filter("filled").agg(F.min("ref"), F.max("ref")).first()
        return _r(vga.shortest_path(cells, edges, corner, ends[0], [ends[1]], kind))

    return run


for _kind in ("visual", "metric", "angular"):
    QUERIES[f"{_kind}_shortest_path"] = _vga_path(_kind)


@query
def path_zones(spark, d):
    cells, edges = _sight(spark, d)
    ends = cells.filter("filled").agg(F.min("ref"), F.max("ref")).first()
    return _r(vga.path_zones(cells, edges, vga.shortest_path(cells, edges, None, ends[0], [ends[1]], "visual").select("ref")))


@query
def isovist_measures(spark, d):
    """Isovists of the lattice's points within a room around the drawing and the lattice."""
    lines = fx.supplier_lines(spark, d)
    cells = _lattice(spark, d).filter("filled")
    far = lines.select(F.greatest("x1", "x2", "y1", "y2").alias("m")).union(cells.select(F.greatest("x", "y") + 1.0))
    w = far.agg(F.max("m").alias("m"))
    room = w.select(F.explode(F.array(*[F.struct(*[v.alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), c)]) for c in ((F.lit(-3.0), F.lit(-3.0), F.col("m") + 1, F.lit(-3.0)), (F.col("m") + 1, F.lit(-3.0), F.col("m") + 1, F.col("m") + 1), (F.col("m") + 1, F.col("m") + 1, F.lit(-3.0), F.col("m") + 1), (F.lit(-3.0), F.col("m") + 1, F.lit(-3.0), F.lit(-3.0)))])).alias("c")).select("c.*")
    points = cells.select("ref", (F.col("x") + 0.37).alias("x"), (F.col("y") + 0.41).alias("y"))
    return _r(vga.isovists(points, lines.select("x1", "y1", "x2", "y2").union(room)), 4)


# --- pushing values


def _zones(spark, d):
    return fx.nation_zones(spark, d)


def _push(how):
    def run(spark, d):
        return _r(P.points_to_polygons(fx.embedding_points(spark, d), _zones(spark, d), how, 0.2))

    return run


for _how in ("min", "max", "avg", "tot"):
    QUERIES[f"push_points_to_zones_{_how}"] = _push(_how)


@query
def push_zones_to_points(spark, d):
    zones = _zones(spark, d).withColumn("value", F.col("ref").cast("double"))
    return _r(P.polygons_to_points(zones, fx.embedding_points(spark, d), "avg", 0.2))


def _scaled_zones(spark, d):
    """The zones stretched over the lines' drawing."""
    z = _zones(spark, d)
    s = lambda p: F.struct((p["x"] * 12 + 4.25).alias("x"), (p["y"] * 12 + 4.25).alias("y"))
    return z.select("ref", F.transform("points", s).alias("points"), F.col("ref").cast("double").alias("value"))


@query
def push_zones_to_lines(spark, d):
    return _r(P.polygons_to_lines(_scaled_zones(spark, d), fx.supplier_lines(spark, d), "max", 2.0, crossings=False))


@query
def push_lines_to_zones(spark, d):
    return _r(P.lines_to_polygons(fx.supplier_lines(spark, d).withColumnRenamed("weight", "value"), _scaled_zones(spark, d), "tot", 2.0, crossings=False))


@query
def push_lines_to_lines(spark, d):
    lines = fx.supplier_lines(spark, d).withColumnRenamed("weight", "value")
    moved = lines.select((F.col("ref") + 1000000).alias("ref"), *[(F.col(c) + 0.5).alias(c) for c in ("x1", "y1", "x2", "y2")])
    return _r(P.lines_to_lines(lines, moved, "avg", 4.0))


@query
def push_zones_to_zones(spark, d):
    zones = _scaled_zones(spark, d)
    moved = zones.select((F.col("ref") + 100).alias("ref"), F.transform("points", lambda p: F.struct((p["x"] + 1.1).alias("x"), (p["y"] + 0.7).alias("y"))).alias("points"))
    return _r(P.polygons_to_polygons(zones, moved, "tot", 3.0))


# --- geometry


@query
def polygon_measures(spark, d):
    z = _zones(spark, d)
    cx, cy = G.centroid("points")
    return _r(z.select("ref", F.abs(G.signed_area("points")).alias("area"), cx.alias("cx"), cy.alias("cy"), G.perimeter("points").alias("perimeter"), (G.signed_area("points") > 0).alias("ccw")))


@query
def trail_measures(spark, d):
    t = fx.event_trails(spark, d)
    return _r(t.select("ref", G.perimeter("points", closed=False).alias("length"), G.angular_deviation("points").alias("deviation")), 4)


@query
def line_touch_kinds(spark, d):
    from netloom.operators.spatial import box, prefixed, spatial_join

    l = fx.supplier_lines(spark, d).select("ref", "x1", "y1", "x2", "y2")
    a, b = prefixed(l, "a_"), prefixed(l, "b_")
    met = spatial_join(a, b, box(a, "a_x1", "a_y1", "a_x2", "a_y2"), box(b, "b_x1", "b_y1", "b_x2", "b_y2"), (F.col("a_ref") < F.col("b_ref")) & G.lines_intersect("a_", "b_"), 4.0)
    return _r(met.select(F.col("a_ref").alias("a"), F.col("b_ref").alias("b"), G.touch_kind("a_", "b_").alias("kind")))


@query
def packed_refs(spark, d):
    cells = _lattice(spark, d).select("ref", "x", "y", G.pack_ref("x", "y").alias("packed"))
    x, y = G.unpack_ref("packed")
    return _r(cells.select("ref", "packed", x.alias("back_x"), y.alias("back_y")))


@query
def nearest_line(spark, d):
    """For each point of the lattice, the nearest line within 2 and its distance; the smaller ref of equally near ones."""
    from netloom.operators.spatial import box, prefixed, spatial_join

    p = _lattice(spark, d).select(F.col("ref").alias("p_ref"), (F.col("x") + 0.25).alias("p_x"), (F.col("y") + 0.5).alias("p_y"))
    l = prefixed(fx.supplier_lines(spark, d).select("ref", "x1", "y1", "x2", "y2"), "l_")
    at = {"lo_x": F.col("p_x") - 2, "hi_x": F.col("p_x") + 2, "lo_y": F.col("p_y") - 2, "hi_y": F.col("p_y") + 2}
    dist = G.point_line_distance("p_x", "p_y", "l_x1", "l_y1", "l_x2", "l_y2")
    near = spatial_join(p, l, at, box(l, "l_x1", "l_y1", "l_x2", "l_y2"), dist <= 2, 4.0).withColumn("distance", F.round(dist, 6))
    return _r(near.groupBy(F.col("p_ref").alias("ref")).agg(F.min(F.struct("distance", "l_ref")).alias("m")).select("ref", F.col("m.l_ref").alias("line"), F.col("m.distance").alias("distance")))


# --- attribute tables


def _attrs(spark, d):
    return fx.part_attributes(spark, d)


@query
def attr_stats(spark, d):
    return _r(A.stats(_attrs(spark, d), ["price", "size"]))


@query
def attr_normalised(spark, d):
    return _r(A.normalised(_attrs(spark, d), "price").select("ref", "normalised"))


@query
def attr_selection_average(spark, d):
    return _r(A.selection_average(_attrs(spark, d), "price", F.col("ref") % 3 == 0))


@query
def attr_row_index(spark, d):
    return _r(A.with_row_index(_attrs(spark, d)).select("ref", "idx"))


@query
def attr_sorted(spark, d):
    return _r(A.sorted_index(_attrs(spark, d), "size").select("ref", "size"))


@query
def attr_value_range(spark, d):
    return _r(A.in_range(_attrs(spark, d), "size", 10, 20).select("ref", "size"))


@query
def attr_in_region(spark, d):
    return _r(A.in_region(_lattice(spark, d), "x", "y", (3, 2, 20, 9)).select("ref", "x", "y"))


@query
def layer_visible_rows(spark, d):
    layers = A.Layers()
    for k in range(1, 8):
        layers.add(f"layer {k}")
    for k in (2, 5):
        layers.show(f"layer {k}")
    return _r(_attrs(spark, d).filter(layers.is_visible()).select("ref", "layer_key"))


@query
def selection_to_layer(spark, d):
    layers = A.Layers()
    layers.add("cheap")
    return _r(layers.push_selection(_attrs(spark, d), "cheap", F.col("price") < 1200).select("ref", "layer_key"))


@query
def import_attributes(spark, d):
    values = _attrs(spark, d).filter("ref % 4 = 1").select(F.col("ref").alias("Ref"), (F.col("price") * 2).alias("double_price"))
    return _r(A.legacy(A.import_attributes(_attrs(spark, d), values)).select("ref", "double_price"))


@query
def categorical_codes(spark, d):
    from netloom.sources.readers import category_codes

    p = fx.table(spark, d, "part").select(F.col("p_partkey").alias("ref"), F.col("p_brand").alias("value"))
    return _r(category_codes(p, "value", "ref"))


@query
def formula_update(spark, d):
    text = 'if value("size") > 25 and value("price") > 1000:\n    x = ln(value("price"))\nelif value("size") % 2 == 0:\n    x = value("size") ^ 2 / 3\nelse:\n    x = 1 / (value("size") - 25)\nx - 1'
    return _r(FX.update(_attrs(spark, d), "result", text).select("ref", "result"))


@query
def formula_select(spark, d):
    return FX.select(_attrs(spark, d), 'value("size") > 40 or value("price") < 950 and not (value("Ref Number") % 2 == 1)').select("ref")


@query
def formula_loop(spark, d):
    return _r(FX.update(_attrs(spark, d), "result", 't = 0\nfor k in range(0, 4):\n    t = t + k * value("size")\nt').select("ref", "result"))


MARKS = """if value("size") > 25
    setmark(value("size") * 2)
    setvalue("size", 0)
else
    setmark(1)
setvalue("price", value("price") + mark())
value("size")"""


@query
def formula_setvalue(spark, d):
    return _r(FX.update(fx.part_attributes(spark, d), "result", MARKS))


@query
def formula_setvalue_loop(spark, d):
    return _r(FX.execute(fx.part_attributes(spark, d), """setmark(0)
for i in range(0, 3)
    setmark(mark() + value("size"))
    setvalue("size", value("size") + i)
setvalue("price", mark())"""))


@query
def formula_connections(spark, d):
    lines, edges = _network(spark, d)
    table = X.connectivity(lines, edges).select("ref", F.col("connectivity").cast("double").alias("c"))
    text = 't = 0\nfor n in connections():\n    t = t + n.value("c")\nif len(connections()) > 0:\n    return t / len(connections())\n-1'
    return _r(FX.update(table, "mean_neighbour", text, edges=edges).select("ref", "mean_neighbour"))


@query
def formula_neighbours(spark, d):
    lines, edges = _network(spark, d)
    table = X.connectivity(lines, edges).select("ref", F.col("connectivity").cast("double").alias("c"))
    got = FX.neighbour_lists(table, edges, ["c"])
    return _r(got.select("ref", F.coalesce(F.aggregate("connections_c", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("connections_c"), F.lit(0)), F.lit(-1.0)).alias("mean_neighbour")))
