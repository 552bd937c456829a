"""Spatial data sets derived from the relational test tables, so that operators run over real inputs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref, x1, y1, x2, y2, weight: a line for each supplier on a square grid, its direction by nation; zero lengths left out."""
    s = table(spark, sf_dir, "supplier")
    width = s.agg(F.greatest(F.lit(2), F.floor(F.sqrt(F.count("*")))).cast("long").alias("w"))
    s = s.filter("s_nationkey <> 12").crossJoin(F.broadcast(width))  # one row
    x, y = F.col("s_suppkey") % F.col("w"), F.floor(F.col("s_suppkey") / F.col("w"))
    return s.select(
        F.col("s_suppkey").cast("long").alias("ref"),
        x.cast("double").alias("x1"),
        y.cast("double").alias("y1"),
        (x + F.col("s_nationkey") % 5 - 2).cast("double").alias("x2"),
        (y + F.floor(F.col("s_nationkey") / 5) - 2).cast("double").alias("y2"),
        F.col("s_acctbal").alias("weight"),
    )


def part_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref, x, y, filled, price: parts on a grid of 50 columns; parts of size 10 or less are blocked cells."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("ref"), (F.col("p_partkey") % 50).cast("int").alias("x"), F.floor(F.col("p_partkey") / 50).cast("int").alias("y"), (F.col("p_size") > 10).alias("filled"), F.col("p_retailprice").alias("price"))


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref, x, y, value: the first two components of each vector, the label as attribute."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("ref"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.col("label").cast("double").alias("value"))


def nation_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref, points, x1, y1, x2, y2: 5 x 5 rectangles over the unit square about the origin, one per nation."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("ref"), (F.col("n_nationkey") % 5).alias("c"), F.floor(F.col("n_nationkey") / 5).alias("r"))
    n = n.select("ref", *((F.lit(-0.5) + F.col(k) * 0.2).alias(v) for k, v in (("c", "x1"), ("r", "y1"))), *((F.lit(-0.5) + (F.col(k) + 1) * 0.2).alias(v) for k, v in (("c", "x2"), ("r", "y2"))))
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return n.withColumn("points", F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2")))


def part_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref, price, size, layer_key: an attribute table whose layers are the brands' numbers."""
    p = table(spark, sf_dir, "part")
    layer = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p_partkey") % 8).cast("int"))
    return p.select(F.col("p_partkey").alias("ref"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"), layer.alias("layer_key"))


def event_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref, points: each user's events in time order as a polyline of (order, value)."""
    e = table(spark, sf_dir, "events")
    p = e.groupBy(F.col("user_id").alias("ref")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("e"))
    return p.select("ref", F.transform("e", lambda v, i: F.struct(i.cast("double").alias("x"), v["value"].alias("y"))).alias("points"))


def copurchase_edges(spark: SparkSession, sf_dir: str, least: float = 49) -> DataFrame:
    """src, dst: parts bought in one order in large quantities, both ways."""
    l = table(spark, sf_dir, "lineitem").filter(F.col("l_quantity") >= least).select("l_orderkey", "l_partkey").distinct()
    other = l.withColumnRenamed("l_partkey", "dst")
    return l.join(other, "l_orderkey").filter("l_partkey <> dst").select(F.col("l_partkey").alias("src"), "dst").distinct()
