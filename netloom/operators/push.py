"""Pushing values from one map to another: a spatial join, then an aggregate for each row of the receiving map.

Undefined values (null or -1) are skipped and not counted. A receiving row that nothing reaches gets -1, and 0 as its count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions import geometry as G
from netloom.operators.spatial import box, points_box, prefixed, spatial_join

HOW = {"max": F.max, "min": F.min, "avg": F.avg, "tot": F.sum}


def gather(to: DataFrame, pairs: DataFrame, how: str) -> DataFrame:
    """ref, pushed, n of each row of `to`; pairs: ref, value of each match."""
    value = F.when(F.col("value") != -1, F.col("value"))
    got = pairs.groupBy("ref").agg((F.max(F.lit(-1.0)) if how == "none" else HOW[how](value)).alias("pushed"), F.count(value).alias("n"))
    return to.select("ref").join(got, "ref", "left").select("ref", F.coalesce("pushed", F.lit(-1.0)).alias("pushed"), F.coalesce("n", F.lit(0)).alias("n"))


def points_to_polygons(points: DataFrame, polygons: DataFrame, how: str, cell: float) -> DataFrame:
    """points: ref, x, y, value; polygons: ref, points."""
    a, b = prefixed(points, "a_"), prefixed(polygons.select("ref", "points"), "b_")
    at = {"lo_x": F.col("a_x"), "hi_x": F.col("a_x"), "lo_y": F.col("a_y"), "hi_y": F.col("a_y")}
    hits = spatial_join(a, b, at, points_box("b_points"), G.point_in_polygon("a_x", "a_y", "b_points"), cell)
    return gather(polygons, hits.select(F.col("b_ref").alias("ref"), F.col("a_value").alias("value")), how)


def polygons_to_points(polygons: DataFrame, points: DataFrame, how: str, cell: float) -> DataFrame:
    """polygons: ref, points, value."""
    a, b = prefixed(points.select("ref", "x", "y"), "a_"), prefixed(polygons.select("ref", "points", "value"), "b_")
    at = {"lo_x": F.col("a_x"), "hi_x": F.col("a_x"), "lo_y": F.col("a_y"), "hi_y": F.col("a_y")}
    hits = spatial_join(a, b, at, points_box("b_points"), G.point_in_polygon("a_x", "a_y", "b_points"), cell)
    return gather(points, hits.select(F.col("a_ref").alias("ref"), F.col("b_value").alias("value")), how)


def line_in_polygon(p: str, points: str, crossings: bool = True) -> Column:
    """An end inside, or (with crossings) an edge that the line meets."""
    inside = G.point_in_polygon(f"{p}x1", f"{p}y1", points) | G.point_in_polygon(f"{p}x2", f"{p}y2", points)
    if not crossings:
        return inside
    x1, y1, x2, y2 = (F.col(f"{p}{k}") for k in ("x1", "y1", "x2", "y2"))

    def met(e: Column) -> Column:
        a, b = e["a"], e["b"]
        s1, s2 = G.cross(x1, y1, x2, y2, a["x"], a["y"]), G.cross(x1, y1, x2, y2, b["x"], b["y"])
        t1, t2 = G.cross(a["x"], a["y"], b["x"], b["y"], x1, y1), G.cross(a["x"], a["y"], b["x"], b["y"], x2, y2)
        return (s1 * s2 <= 0) & (t1 * t2 <= 0) & ~((s1 == 0) & (s2 == 0))

    return inside | F.exists(G._edges(points), met)


def polygons_to_lines(polygons: DataFrame, lines: DataFrame, how: str, cell: float, crossings: bool = True) -> DataFrame:
    """Values of polygons that lines lie in or (with crossings) meet, for each line."""
    a, b = prefixed(lines.select("ref", "x1", "y1", "x2", "y2"), "a_"), prefixed(polygons.select("ref", "points", "value"), "b_")
    hits = spatial_join(a, b, box(a, "a_x1", "a_y1", "a_x2", "a_y2"), points_box("b_points"), line_in_polygon("a_", "b_points", crossings), cell)
    return gather(lines, hits.select(F.col("a_ref").alias("ref"), F.col("b_value").alias("value")), how)


def lines_to_polygons(lines: DataFrame, polygons: DataFrame, how: str, cell: float, crossings: bool = True) -> DataFrame:
    a, b = prefixed(lines.select("ref", "x1", "y1", "x2", "y2", "value"), "a_"), prefixed(polygons.select("ref", "points"), "b_")
    hits = spatial_join(a, b, box(a, "a_x1", "a_y1", "a_x2", "a_y2"), points_box("b_points"), line_in_polygon("a_", "b_points", crossings), cell)
    return gather(polygons, hits.select(F.col("b_ref").alias("ref"), F.col("a_value").alias("value")), how)


def lines_to_lines(lines: DataFrame, to: DataFrame, how: str, cell: float) -> DataFrame:
    """Values of the lines that each line meets."""
    a, b = prefixed(to.select("ref", "x1", "y1", "x2", "y2"), "a_"), prefixed(lines.select("ref", "x1", "y1", "x2", "y2", "value"), "b_")
    hits = spatial_join(a, b, box(a, "a_x1", "a_y1", "a_x2", "a_y2"), box(b, "b_x1", "b_y1", "b_x2", "b_y2"), G.lines_intersect("a_", "b_"), cell)
    return gather(to, hits.select(F.col("a_ref").alias("ref"), F.col("b_value").alias("value")), how)


def polygons_to_polygons(polygons: DataFrame, to: DataFrame, how: str, cell: float) -> DataFrame:
    """Values of polygons with a corner in the receiving one, the other way round, or with edges that meet."""
    a, b = prefixed(to.select("ref", "points"), "a_"), prefixed(polygons.select("ref", "points", "value"), "b_")

    def corner_in(p: str, q: str) -> Column:
        return F.exists(p, lambda v: G.point_in_polygon(v["x"], v["y"], q))

    def meet(e: Column, f: Column) -> Column:
        s1, s2 = (G.cross(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"], f[k]["x"], f[k]["y"]) for k in ("a", "b"))
        t1, t2 = (G.cross(f["a"]["x"], f["a"]["y"], f["b"]["x"], f["b"]["y"], e[k]["x"], e[k]["y"]) for k in ("a", "b"))
        return (s1 * s2 < 0) & (t1 * t2 < 0)

    edges = F.exists(G._edges("a_points"), lambda e: F.exists(G._edges("b_points"), lambda f: meet(e, f)))
    hits = spatial_join(a, b, points_box("a_points"), points_box("b_points"), corner_in("a_points", "b_points") | corner_in("b_points", "a_points") | edges, cell)
    return gather(to, hits.select(F.col("a_ref").alias("ref"), F.col("b_value").alias("value")), how)


def push_by_key(source: DataFrame, to: DataFrame, key: str, prefix: str) -> DataFrame:
    """Columns of `source` (keyed by ref) onto rows of `to` that name it in column `key`, their names prefixed."""
    renamed = source.select(F.col("ref").alias(key), *[F.col(c).alias(f"{prefix}{c}") for c in source.columns if c != "ref"])
    return to.join(renamed, key, "left")
