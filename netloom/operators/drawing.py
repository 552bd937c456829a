"""Drawings: conversions between maps, shape edits, generated geometry, the all-line map and its fewest-line reductions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import geometry as G
from netloom.operators import axial as X
from netloom.operators import segment as S
from netloom.operators import traverse as V
from netloom.operators.spatial import box, cell_size, points_box, prefixed, spatial_join
from netloom.sources.readers import lines_of


class EmptyDrawing(ValueError):
    """A map that nothing can be made of."""


def _not_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise EmptyDrawing(f"the drawing has no {what}")
    return df


def free_name(name: str, taken: list[str]) -> str:
    """name, with a number behind it if it is taken."""
    k, out = 1, name
    while out in taken:
        out, k = f"{name} {k}", k + 1
    return out


def to_axial(shapes: DataFrame, attributes: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Lines and edges of a drawing's sides, tidied; attributes of the shapes may come along, and the column layer says where a line was drawn."""
    sides = _not_empty(lines_of(shapes), "lines")
    tidied = S.quick_tidy(sides)
    keep = shapes.select(F.col("ref").alias("shape_ref"), F.col("layer").alias("Drawing Layer"), *[F.col(f"`{c}`").alias(free_name(c, ["Drawing Layer", "ref"])) for c in attributes])
    lines = tidied.join(keep, "shape_ref", "left").withColumnRenamed("shape_ref", "Data Map Ref")
    lines = V.checkpointed(lines)
    return lines, V.checkpointed(X.line_edges(lines))


def to_convex(shapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Polygons and the edges between those that touch."""
    polygons = _not_empty(shapes.filter((F.col("shape_type") == "polygon") & F.col("closed")), "polygons").select("ref", "points")
    a, b = prefixed(polygons, "a_"), prefixed(polygons, "b_")
    cell = cell_size(polygons, points_box("points"))
    side = lambda e, f: (G.cross(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"], f["a"]["x"], f["a"]["y"]) * G.cross(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"], f["b"]["x"], f["b"]["y"]) <= 1e-12)
    near = lambda e, f: (F.least(e["a"]["x"], e["b"]["x"]) <= F.greatest(f["a"]["x"], f["b"]["x"])) & (F.least(f["a"]["x"], f["b"]["x"]) <= F.greatest(e["a"]["x"], e["b"]["x"])) & (F.least(e["a"]["y"], e["b"]["y"]) <= F.greatest(f["a"]["y"], f["b"]["y"])) & (F.least(f["a"]["y"], f["b"]["y"]) <= F.greatest(e["a"]["y"], e["b"]["y"]))
    touch = F.exists(G._edges("a_points"), lambda e: F.exists(G._edges("b_points"), lambda f: near(e, f) & side(e, f) & side(f, e)))
    met = spatial_join(a, b, points_box("a_points"), points_box("b_points"), (F.col("a_ref") != F.col("b_ref")) & touch, cell)
    return polygons, met.select(F.col("a_ref").alias("src"), F.col("b_ref").alias("dst")).distinct()


def to_segments(shapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drawn lines as they are, linked where ends coincide."""
    lines = S.quick_tidy(_not_empty(lines_of(shapes), "lines")).withColumnRenamed("shape_ref", "Data Map Ref")
    lines = V.checkpointed(lines)
    return lines, S.segment_edges(lines)


def axial_to_segments(lines: DataFrame, edges: DataFrame | None = None, stub: float = 1e-6, attributes: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """An axial map's lines cut at junctions, with the lines' attributes pushed under the prefix "Axial "."""
    segments = V.checkpointed(S.split_lines(lines, stub))
    if attributes:
        renamed = lines.select(F.col("ref").alias("axial_ref"), *[F.col(f"`{c}`").alias(f"Axial {c}") for c in attributes])
        return segments.join(renamed, "axial_ref", "left"), S.segment_edges(segments)
    return segments, S.segment_edges(segments)


# --- relations between shapes


def shapes_in_region(shapes: DataFrame, region: tuple[float, float, float, float]) -> DataFrame:
    """Shapes whose boxes touch a region x1, y1, x2, y2."""
    b = points_box("points")
    x1, y1, x2, y2 = region
    return shapes.filter((b["lo_x"] <= x2) & (b["hi_x"] >= x1) & (b["lo_y"] <= y2) & (b["hi_y"] >= y1))


def _first_side(p: str) -> dict[str, F.Column]:
    at = F.col(p)
    return {"x1": at[0]["x"], "y1": at[0]["y"], "x2": at[1]["x"], "y2": at[1]["y"]}


def shape_connections(shapes: DataFrame) -> DataFrame:
    """src, dst of shapes that are in contact: points and lines in or across polygons, sides that meet, polygons that overlap."""
    s = shapes.select("ref", "points", (F.col("closed") & (F.size("points") > 2)).alias("solid"))
    a, b = prefixed(s, "a_"), prefixed(s, "b_")
    meet = lambda e, f: (G.cross(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"], f["a"]["x"], f["a"]["y"]) * G.cross(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"], f["b"]["x"], f["b"]["y"]) <= 0)
    sides = lambda p: F.when(F.col(f"{p}solid"), G._edges(f"{p}points")).otherwise(F.slice(G._edges(f"{p}points"), F.lit(1), F.size(f"{p}points") - 1))
    span = lambda e, f, k: (F.least(e["a"][k], e["b"][k]) <= F.greatest(f["a"][k], f["b"][k])) & (F.least(f["a"][k], f["b"][k]) <= F.greatest(e["a"][k], e["b"][k]))
    crossing = F.exists(sides("a_"), lambda e: F.exists(sides("b_"), lambda f: span(e, f, "x") & span(e, f, "y") & meet(e, f) & meet(f, e)))
    inside = lambda p, q: F.col(f"{q}solid") & F.exists(f"{p}points", lambda v: G.point_in_polygon(v["x"], v["y"], f"{q}points"))
    cell = cell_size(shapes, points_box("points"))
    met = spatial_join(a, b, points_box("a_points"), points_box("b_points"), (F.col("a_ref") != F.col("b_ref")) & (crossing | inside("a_", "b_") | inside("b_", "a_")), cell)
    return met.select(F.col("a_ref").alias("src"), F.col("b_ref").alias("dst")).distinct()


def connect_added(lines: DataFrame, edges: DataFrame, added: DataFrame) -> DataFrame:
    """edges with those of added lines (same columns as lines), which are compared with all."""
    core = ("ref", "x1", "y1", "x2", "y2")
    a, b = prefixed(added.select(*core), "a_"), prefixed(lines.select(*core).union(added.select(*core)), "b_")
    met = spatial_join(a, b, box(a, "a_x1", "a_y1", "a_x2", "a_y2"), box(b, "b_x1", "b_y1", "b_x2", "b_y2"), (F.col("a_ref") != F.col("b_ref")) & G.lines_intersect("a_", "b_"), cell_size(lines, box(lines)))
    return edges.union(met.select("a_ref", "b_ref")).union(met.select("b_ref", "a_ref")).distinct()


def nearest_shape(points: DataFrame, shapes: DataFrame, reach: float) -> DataFrame:
    """ref, shape, distance: the open shape (a side of it) nearest to each point (ref, x, y) within a reach; the smaller ref of equally near ones,
    by distances rounded to 6 digits, since equal ones differ in their last bits."""
    p = points.select(F.col("ref").alias("p_ref"), F.col("x").alias("p_x"), F.col("y").alias("p_y"))
    l = prefixed(lines_of(shapes.filter("not closed")).select("shape_ref", "x1", "y1", "x2", "y2"), "l_")
    around = {"lo_x": F.col("p_x") - reach, "hi_x": F.col("p_x") + reach, "lo_y": F.col("p_y") - reach, "hi_y": F.col("p_y") + reach}
    d = G.point_line_distance("p_x", "p_y", "l_x1", "l_y1", "l_x2", "l_y2")
    near = spatial_join(p, l, around, box(l, "l_x1", "l_y1", "l_x2", "l_y2"), d <= reach, 2 * reach).withColumn("d", F.round(d, 6))
    return near.groupBy(F.col("p_ref").alias("ref")).agg(F.min(F.struct("d", "l_shape_ref")).alias("m")).select("ref", F.col("m.l_shape_ref").alias("shape"), F.col("m.d").alias("distance"))


def shape_at(points: DataFrame, shapes: DataFrame, reach: float) -> DataFrame:
    """ref, shape: the topmost (last) polygon that a point lies in, else the nearest open shape within a reach, else -2."""
    p = points.select(F.col("ref").alias("p_ref"), F.col("x").alias("p_x"), F.col("y").alias("p_y"))
    b = prefixed(shapes.filter("closed").select("ref", "points"), "b_")
    at = {"lo_x": F.col("p_x"), "hi_x": F.col("p_x"), "lo_y": F.col("p_y"), "hi_y": F.col("p_y")}
    hit = spatial_join(p, b, at, points_box("b_points"), G.point_in_polygon("p_x", "p_y", "b_points"), cell_size(shapes, points_box("points")))
    top = hit.groupBy(F.col("p_ref").alias("ref")).agg(F.max("b_ref").alias("top"))
    return points.select("ref").join(top, "ref", "left").join(nearest_shape(points, shapes, reach), "ref", "left").select("ref", F.coalesce("top", "shape", F.lit(-2)).alias("shape"))


# --- edits and generated shapes


def next_ref(shapes: DataFrame) -> int:
    found = shapes.agg(F.max("ref")).first()[0]
    return 0 if found is None else found + 1


def add_shape(shapes: DataFrame, points: list[tuple[float, float]], kind: str, ref: int | None = None) -> DataFrame:
    """shapes with one more; its ref is the next free one unless one is given."""
    ref = next_ref(shapes) if ref is None else ref
    if not shapes.filter(F.col("ref") == ref).isEmpty():
        raise ValueError(f"shape {ref} exists")
    row = shapes.sparkSession.createDataFrame([(ref, None, kind, [{"x": float(x), "y": float(y)} for x, y in points], kind == "polygon")], "ref long, layer string, shape_type string, points array<struct<x:double,y:double>>, closed boolean")
    return shapes.unionByName(row, allowMissingColumns=True)


def move_shape(shapes: DataFrame, ref: int, points: list[tuple[float, float]]) -> DataFrame:
    to = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])
    return shapes.withColumn("points", F.when(F.col("ref") == ref, to).otherwise(F.col("points")))


def append_point(shapes: DataFrame, ref: int, point: tuple[float, float]) -> DataFrame:
    p = F.array(F.struct(F.lit(float(point[0])).alias("x"), F.lit(float(point[1])).alias("y")))
    shapes = shapes.withColumn("points", F.when(F.col("ref") == ref, F.concat("points", p)).otherwise(F.col("points")))
    return shapes.withColumn("shape_type", F.when((F.col("ref") == ref) & (F.size("points") > 2) & ~F.col("closed"), "polyline").otherwise(F.col("shape_type")))


def close_shape(shapes: DataFrame, ref: int) -> DataFrame:
    here = (F.col("ref") == ref) & (F.size("points") > 2)
    return shapes.withColumns({"closed": F.when(here, True).otherwise(F.col("closed")), "shape_type": F.when(here, "polygon").otherwise(F.col("shape_type"))})


def remove_shape(shapes: DataFrame, ref: int) -> DataFrame:
    return shapes.filter(F.col("ref") != ref)


def points_to_polygons(points: DataFrame, radius: float, sides: int = 8) -> DataFrame:
    """An octagon around each point (ref, x, y)."""
    return points.select("ref", F.lit(None).cast("string").alias("layer"), F.lit("polygon").alias("shape_type"), G.circle_points("x", "y", radius, sides).alias("points"), F.lit(True).alias("closed"))


def disk_triangles(points: DataFrame, radius: float, sides: int = 32) -> DataFrame:
    """ref, k, x1, y1, x2, y2, x3, y3: triangles that fill a disk around each point."""
    ring = points.select("ref", "x", "y", G.circle_points("x", "y", radius, sides).alias("p"))
    at = lambda k: F.get("p", k % sides)
    ring = ring.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    return ring.select("ref", "k", F.col("x").alias("x1"), F.col("y").alias("y1"), at(F.col("k"))["x"].alias("x2"), at(F.col("k"))["y"].alias("y2"), at(F.col("k") + 1)["x"].alias("x3"), at(F.col("k") + 1)["y"].alias("y3"))


def circle_lines(points: DataFrame, radius: float, sides: int = 32) -> DataFrame:
    """ref, k, x1, y1, x2, y2: the sides of a circle around each point."""
    return disk_triangles(points, radius, sides).select("ref", "k", F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x3").alias("x2"), F.col("y3").alias("y2"))


def outline(cells: DataFrame) -> DataFrame:
    """Sides between a set of cells (x, y) and what is outside it, as unit lines; n_parts counts the pieces the set falls into."""
    c = cells.select("x", "y").distinct()
    spots = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    out = c.select("x", "y", F.explode(spots).alias("s")).select(F.col("x").alias("cx"), F.col("y").alias("cy"), "s.*", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    edge = out.join(c, ["x", "y"], "left_anti")
    mx, my = F.col("cx") + F.col("dx") / 2, F.col("cy") + F.col("dy") / 2
    return edge.select((mx - F.col("dy") / 2).alias("x1"), (my + F.col("dx") / 2).alias("y1"), (mx + F.col("dy") / 2).alias("x2"), (my - F.col("dx") / 2).alias("y2"))


def first_crossing(lines: DataFrame, walls: DataFrame, exclude_ends: bool = True, cell: float | None = None) -> DataFrame:
    """ref, wall, t: the first wall that each line crosses and how far along; lines that cross none are left out. A wall that shares the line's
    start doesn't count unless asked for."""
    a, b = prefixed(lines.select("ref", "x1", "y1", "x2", "y2"), "a_"), prefixed(walls.select("ref", "x1", "y1", "x2", "y2"), "b_")
    met = spatial_join(a, b, box(a, "a_x1", "a_y1", "a_x2", "a_y2"), box(b, "b_x1", "b_y1", "b_x2", "b_y2"), G.lines_intersect("a_", "b_"), cell or cell_size(lines, box(lines)))
    _, _, along = G.meeting_point("a_", "b_")
    met = met.withColumn("t", along).filter("t is not null")
    if exclude_ends:
        met = met.filter("t > 1e-9")
    return met.groupBy(F.col("a_ref").alias("ref")).agg(F.min(F.struct("t", "b_ref")).alias("m")).select("ref", F.col("m.b_ref").alias("wall"), F.col("m.t").alias("t"))


def cut_lines(lines: DataFrame, walls: DataFrame) -> DataFrame:
    """Lines shortened at the first wall they cross."""
    hit = first_crossing(lines, walls).select("ref", "t")
    t = F.coalesce("t", F.lit(1.0))
    return lines.join(hit, "ref", "left").withColumns({"x2": F.col("x1") + (F.col("x2") - F.col("x1")) * t, "y2": F.col("y1") + (F.col("y2") - F.col("y1")) * t}).drop("t")


# --- all-line and fewest-line maps


def _clear(px, py, qx, qy, walls: np.ndarray) -> bool:
    """Does the line p-q cross no wall inside both?"""
    d1 = (qx - px) * (walls[:, 1] - py) - (qy - py) * (walls[:, 0] - px)
    d2 = (qx - px) * (walls[:, 3] - py) - (qy - py) * (walls[:, 2] - px)
    wx, wy = walls[:, 2] - walls[:, 0], walls[:, 3] - walls[:, 1]
    e1 = wx * (py - walls[:, 1]) - wy * (px - walls[:, 0])
    e2 = wx * (qy - walls[:, 1]) - wy * (qx - walls[:, 0])
    eps = 1e-9
    return not bool(((d1 * d2 < -eps) & (e1 * e2 < -eps)).any())


def _free(x: float, y: float, walls: np.ndarray, seed: tuple[float, float]) -> bool:
    """Is a point on a wall, or on the same side of all walls as the seed: an even number of walls between them?"""
    wx, wy = walls[:, 2] - walls[:, 0], walls[:, 3] - walls[:, 1]
    px, py = x - walls[:, 0], y - walls[:, 1]
    t = np.clip((px * wx + py * wy) / (wx * wx + wy * wy), 0, 1)
    if np.hypot(px - t * wx, py - t * wy).min() < 1e-9:
        return True
    # the seed is moved a little, so that the line to it meets no wall's end
    sx, sy = seed[0] + 1.37e-7, seed[1] + 2.11e-7
    d1 = (sx - x) * (walls[:, 1] - y) - (sy - y) * (walls[:, 0] - x)
    d2 = (sx - x) * (walls[:, 3] - y) - (sy - y) * (walls[:, 2] - x)
    e1, e2 = wx * py - wy * px, wx * (sy - walls[:, 1]) - wy * (sx - walls[:, 0])
    return int(((d1 > 0) != (d2 > 0)).astype(int) @ ((e1 > 0) != (e2 > 0)).astype(int)) % 2 == 0


def _extend(px, py, qx, qy, walls: np.ndarray, far: float, seed: tuple[float, float]) -> tuple[float, float]:
    """How far the ray from p through q can be followed in free space or along walls."""
    dx, dy = qx - px, qy - py
    n = math.hypot(dx, dy)
    dx, dy = dx / n, dy / n
    wx, wy = walls[:, 2] - walls[:, 0], walls[:, 3] - walls[:, 1]
    det = dx * wy - dy * wx
    ax, ay = walls[:, 0] - px, walls[:, 1] - py
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (ax * wy - ay * wx) / det
        s = (ax * dy - ay * dx) / det
    ok = (np.abs(det) > 1e-12) & (t > n - 1e-9) & (s >= -1e-9) & (s <= 1 + 1e-9)
    stops = np.unique(np.concatenate([[n], np.round(t[ok], 9)]))
    for k, stop in enumerate(stops.tolist()):
        step = min(1e-4 * far, (stops[k + 1] - stop) / 2) if k + 1 < len(stops) else 1e-4 * far
        if not _free(px + dx * (stop + step), py + dy * (stop + step), walls, seed):
            return px + dx * stop, py + dy * stop
    return px + dx * stops[-1], py + dy * stops[-1]


def all_lines(walls: DataFrame, seed: tuple[float, float]) -> DataFrame:
    """ref, x1, y1, x2, y2: every line between two corners that see each other, run on at both ends until it meets a wall, each line once.

    walls: ref, x1, y1, x2, y2 of the space's boundary and obstacles; seed: a point inside. Corners are dealt over tasks; walls, whose number is
    checked, go to each. Corners where walls run almost straight on make no lines.
    """
    if not V.is_small(walls):
        raise ValueError("too many walls to send to every task")
    w = walls.select("x1", "y1", "x2", "y2").toPandas().to_numpy(float)
    ends: dict[tuple[float, float], list[tuple[float, float]]] = {}
    for x1, y1, x2, y2 in w:
        ends.setdefault((round(x1, 9), round(y1, 9)), []).append((x2 - x1, y2 - y1))
        ends.setdefault((round(x2, 9), round(y2, 9)), []).append((x1 - x2, y1 - y2))

    def bends(directions: list[tuple[float, float]]) -> bool:
        if len(directions) != 2:
            return True
        (ax, ay), (bx, by) = directions
        return abs(ax * bx + ay * by) / (math.hypot(ax, ay) * math.hypot(bx, by)) <= 0.999

    corners = np.array(sorted(p for p, d in ends.items() if bends(d)))
    low, high = np.minimum(w[:, :2], w[:, 2:]).min(axis=0), np.maximum(w[:, :2], w[:, 2:]).max(axis=0)
    if not (low <= seed).all() or not (seed <= high).all():
        raise ValueError("the seed lies outside the walls")
    far = 2 * float(np.hypot(*(high - low)))
    spark = walls.sparkSession
    shared = spark.sparkContext.broadcast((w, corners, far, seed))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, corners, far, seed = shared.value
        for f in frames:
            rows = []
            for i in f["id"].tolist():
                px, py = corners[i]
                for qx, qy in corners[i + 1 :]:
                    if _clear(px, py, qx, qy, w) and _free((px + qx) / 2, (py + qy) / 2, w, seed):
                        a, b = _extend(qx, qy, px, py, w, far, seed), _extend(px, py, qx, qy, w, far, seed)
                        rows.append((*min(a, b), *max(a, b)))
            if rows:
                yield pd.DataFrame(rows, columns=["x1", "y1", "x2", "y2"])

    got = spark.range(len(corners)).repartition(max(1, min(len(corners), 2 * spark.sparkContext.defaultParallelism))).mapInPandas(run, "x1 double, y1 double, x2 double, y2 double")
    r = lambda c: F.round(c, 6) + F.lit(0.0)
    unique = got.select(*[r(c).alias(c) for c in ("x1", "y1", "x2", "y2")]).distinct().filter("x1 <> x2 or y1 <> y2")
    from netloom.operators.attributes import with_row_index

    return with_row_index(unique.withColumn("ref", F.struct("x1", "y1", "x2", "y2"))).select(F.col("idx").cast("long").alias("ref"), "x1", "y1", "x2", "y2")


def fewest_lines(lines: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(subsets, minimal): lines left when those whose neighbours are all another's neighbours go, shortest first; and what is left when lines then go
    one by one, shortest first, as long as each neighbour keeps more than one other and the map stays whole.

    The removal is sequential by nature and runs on the driver over a graph whose size is checked.
    """
    if not V.is_small(edges):
        raise ValueError("the map is too large for a sequential reduction")
    l = lines.withColumn("length", G.length("x1", "y1", "x2", "y2")).select("ref", "length").toPandas()
    near: dict[int, set[int]] = {r: set() for r in l["ref"]}
    for a, b in edges.select("src", "dst").toPandas().itertuples(index=False):
        near[a].add(b)
    order = [r for _, _, r in sorted((len(near[r]), x, r) for r, x in zip(l["ref"], l["length"]))]
    left = {r: set(n) for r, n in near.items()}

    def drop(r: int) -> None:
        for n in left.pop(r):
            if n in left:
                left[n].discard(r)

    for r in order:
        if any(left[r] - {n} <= left[n] and len(left[n]) > len(left[r]) - 1 for n in left[r] if n in left):
            drop(r)
    subsets = set(left)
    for r in order:
        if r in left and len(left[r]) > 0 and all(len(left[n]) > 2 for n in left[r]) and _whole_without(left, r):
            drop(r)
    spark = lines.sparkSession

    def kept(refs: set[int]) -> DataFrame:
        return lines.join(spark.createDataFrame([(int(r),) for r in sorted(refs)], "ref long"), "ref", "left_semi")

    return kept(subsets), kept(set(left))


def _whole_without(graph: dict[int, set[int]], gone: int) -> bool:
    """Do the neighbours of a node still reach each other without it?"""
    near = graph[gone]
    start = next(iter(near))
    seen, todo = {start}, [start]
    while todo and not near <= seen:
        for n in graph[todo.pop()]:
            if n != gone and n not in seen:
                seen.add(n)
                todo.append(n)
    return near <= seen
