"""Spatial joins: shapes meet in cells of a uniform grid by an equi-join, exact predicates follow.

Catalyst would run a join on geometric conditions as a nested loop. Here each side's box is spread over the grid cells it covers and the join key is the
cell, so rows shuffle by cell and AQE splits crowded cells. A pair that shares several cells is kept in one only: the cell with the lower left
corner of the boxes' common part.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def box(df: DataFrame, x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2") -> dict[str, Column]:
    return {"lo_x": F.least(x1, x2), "lo_y": F.least(y1, y2), "hi_x": F.greatest(x1, x2), "hi_y": F.greatest(y1, y2)}


def points_box(points: str = "points") -> dict[str, Column]:
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return {"lo_x": F.array_min(x), "lo_y": F.array_min(y), "hi_x": F.array_max(x), "hi_y": F.array_max(y)}


def cell_size(df: DataFrame, bounds: dict[str, Column]) -> float:
    """Twice the mean side of the boxes, which keeps a shape within a few cells; 1 if there is no extent."""
    side = F.greatest(bounds["hi_x"] - bounds["lo_x"], bounds["hi_y"] - bounds["lo_y"])
    found = df.agg(F.avg(side)).first()[0]
    return 2 * found if found else 1.0


def spatial_join(left: DataFrame, right: DataFrame, left_box: dict[str, Column], right_box: dict[str, Column], on: Column, cell: float, how: str = "inner") -> DataFrame:
    """Pairs of rows whose boxes touch and that satisfy `on`. how: inner, left_semi or left_anti. Column names of the sides must differ."""
    if how != "inner":
        hits = prefixed(spatial_join(left, right, left_box, right_box, on, cell).select(*left.columns).distinct(), "_hit_")
        return left.join(hits, reduce(and_, (F.col(f"`{c}`").eqNullSafe(F.col(f"`_hit_{c}`")) for c in left.columns)), how)
    cells = lambda lo, hi: F.sequence(F.floor(lo / cell), F.floor(hi / cell))

    def spread(df: DataFrame, bounds: dict[str, Column], p: str) -> DataFrame:
        df = df.withColumns({f"_{p}{k}": v for k, v in bounds.items()})
        df = df.withColumn("_cx", F.explode(cells(F.col(f"_{p}lo_x"), F.col(f"_{p}hi_x"))))
        return df.withColumn("_cy", F.explode(cells(F.col(f"_{p}lo_y"), F.col(f"_{p}hi_y"))))

    owner = (F.floor(F.greatest("_alo_x", "_blo_x") / cell) == F.col("_cx")) & (F.floor(F.greatest("_alo_y", "_blo_y") / cell) == F.col("_cy"))
    both = spread(left, left_box, "a").join(spread(right, right_box, "b"), ["_cx", "_cy"]).filter(owner & on)
    return both.select(*left.columns, *right.columns)


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(f"{prefix}{c}") for c in df.columns])
