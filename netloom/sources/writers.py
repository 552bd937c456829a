"""Writing maps: tables, edge lists, Pajek, DOT, MIF, CAT. Text sinks make lines with format_string and leave writing to Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(df: DataFrame, first: tuple[str, ...]) -> DataFrame:
    """Ref and coordinates, then the other columns by name, numbers with 8 decimals."""
    rest = sorted(c for c in df.columns if c not in (*first, "layer_key"))
    kinds = dict(df.dtypes)
    return df.select(*[F.col(c).alias("Ref") if c == "ref" else F.col(c) for c in first], *[F.format_string("%.8f", F.col(f"`{c}`").cast("double")).alias(c) if kinds[c] in ("double", "float") else F.col(f"`{c}`") for c in rest])


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.option("header", True).option("sep", sep).csv(path)


def bin_summary(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """x, y, bin0 to bin31 of each filled cell."""
    from netloom.operators.lattice import bin_counts

    got = cells.filter("filled").select("ref", "x", "y").join(bin_counts(edges), "ref", "left")
    return got.select("x", "y", *[F.coalesce(f"bin{k}", F.lit(0)).alias(f"bin{k}") for k in range(32)])


def connection_pairs(edges: DataFrame) -> DataFrame:
    """RefFrom, RefTo: each undirected pair once."""
    return edges.filter("src < dst").select(F.col("src").alias("RefFrom"), F.col("dst").alias("RefTo")).distinct()


def row_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """refA, refB by row numbers, each pair once."""
    from netloom.operators.attributes import with_row_index

    idx = with_row_index(nodes.select("ref")).select("ref", "idx")
    a, b = idx.select(F.col("ref").alias("src"), F.col("idx").alias("refA")), idx.select(F.col("ref").alias("dst"), F.col("idx").alias("refB"))
    return edges.filter("src < dst").join(a, "src").join(b, "dst").select("refA", "refB")


def point_list(cells: DataFrame) -> DataFrame:
    """Ref, x, y of filled cells."""
    return cells.filter("filled").select(F.col("ref").alias("Ref"), "x", "y")


def merge_lines(cells: DataFrame, links: DataFrame) -> DataFrame:
    """x1, y1, x2, y2 of each link between cells."""
    a, b = (cells.select(F.col("ref").alias(k), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}")) for k, n in (("a", 1), ("b", 2)))
    return links.join(a, "a").join(b, "b").select("x1", "y1", "x2", "y2")


def segment_pairs(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("refA"), F.col("dst").alias("refB"), F.col("weight").alias("ss_weight"), F.when(F.col("side") == "fwd", 0).otherwise(1).alias("for_back"), "dir")


def link_pairs(links: DataFrame, unlinks: DataFrame) -> DataFrame:
    """refA, refB, link: 1 for links, 0 for unlinks."""
    return links.select(F.col("a").alias("refA"), F.col("b").alias("refB"), F.lit(1).alias("link")).union(unlinks.select("a", "b", F.lit(0)))


def _numbered(*parts: DataFrame) -> DataFrame:
    """Blocks of lines in order: part, then place within it."""
    out = None
    for k, p in enumerate(parts):
        q = p.select(F.lit(k).alias("part"), F.col("at").cast("long").alias("at"), F.col("value").cast("string").alias("value"))
        out = q if out is None else out.union(q)
    return out


def write_lines(blocks: DataFrame, path: str) -> None:
    """A text file in the order of the blocks; sorted by range, so several files follow each other by name."""
    blocks.repartitionByRange(F.col("part"), F.col("at")).sortWithinPartitions("part", "at").select("value").write.text(path)


def dot_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    spark = nodes.sparkSession
    pairs = row_pairs(nodes, edges)
    line = lambda text: spark.range(1).select(F.lit(0).alias("at"), F.lit(text).alias("value"))
    return _numbered(line("strict graph {"), pairs.select((F.col("refA") * F.lit(1 << 31) + F.col("refB")).alias("at"), F.format_string("    %d -- %d", "refA", "refB").alias("value")), line("}"))


def pajek(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes: ref, x, y. Coordinates are brought to the unit square by the longer side."""
    from netloom.operators.attributes import with_row_index

    spark = nodes.sparkSession
    idx = with_row_index(nodes.select("ref", "x", "y"))
    box = nodes.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("side"), F.count("*").alias("n"))
    unit = lambda c, o: F.coalesce(F.try_divide(F.col(c) - F.col(o), F.col("side")), F.lit(0.0))
    head = box.select(F.lit(0).alias("at"), F.format_string("*Vertices %d", "n").alias("value"))
    vertices = idx.crossJoin(F.broadcast(box)).select(F.col("idx").alias("at"), F.format_string('%d "%d" %.6f %.6f', F.col("idx") + 1, "ref", unit("x", "x0"), unit("y", "y0")).alias("value"))  # one row
    arcs = spark.range(1).select(F.lit(0).alias("at"), F.lit("*Edges").alias("value"))
    pairs = row_pairs(nodes, edges).select((F.col("refA") * F.lit(1 << 31) + F.col("refB")).alias("at"), F.format_string("%d %d 1", F.col("refA") + 1, F.col("refB") + 1).alias("value"))
    return _numbered(head, vertices, arcs, pairs)


def cat(shapes: DataFrame) -> DataFrame:
    """Polylines and polygons as CAT blocks."""
    s = shapes.filter(F.col("shape_type").isin("line", "polyline", "polygon"))
    rows = F.concat(F.array(F.when(F.col("closed"), "begin polygon").otherwise("begin polyline")), F.transform("points", lambda p: F.format_string("%s %s", p["x"], p["y"])), F.array(F.lit("end")))
    return _numbered(s.select(F.col("ref").alias("at"), F.array_join(rows, "\n").alias("value")))


def mif(shapes: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Lines of a MIF and of its MID, shapes in order of refs."""
    spark = shapes.sparkSession
    head = ["Version 300", 'Charset "Neutral"', 'Delimiter ","', f"Columns {len(columns) + 1}", "  ref Integer", *[f"  {c.replace(' ', '_')} Float" for c in columns], "Data"]
    top = spark.createDataFrame([(k, v) for k, v in enumerate(head)], "at long, value string")
    at = lambda p: F.format_string("%s %s", p["x"], p["y"])
    all_points = F.array_join(F.transform("points", at), "\n")
    body = (
        F.when(F.col("shape_type") == "point", F.concat(F.lit("Point "), at(F.col("points")[0])))
        .when(F.col("shape_type") == "line", F.concat(F.lit("Line "), at(F.col("points")[0]), F.lit(" "), at(F.col("points")[1])))
        .when(F.col("closed"), F.concat(F.lit("Region 1\n"), F.size("points").cast("string"), F.lit("\n"), all_points))
        .otherwise(F.concat(F.lit("Pline "), F.size("points").cast("string"), F.lit("\n"), all_points))
    )
    mid = shapes.select(F.col("ref").alias("at"), F.concat_ws(",", F.col("ref").cast("string"), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-1")) for c in columns]).alias("value"))
    return _numbered(top, shapes.select(F.col("ref").alias("at"), body.alias("value"))), _numbered(mid)


def save_project(path: str, tables: dict[str, DataFrame]) -> None:
    """A project as a folder of Parquet tables."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_project(spark, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
