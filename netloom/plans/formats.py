"""Queries over file formats and drawings, by name, and the SQL that checks them: tables are written in a format, read back by its reader, and compared
with what SQL makes of the tables themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import axial as X
from netloom.operators import drawing as D
from netloom.operators import lattice as L
from netloom.operators import traverse as V
from netloom.plans.oracles import CELLS, EDGES, LINES, MEET, SIGHT, SPLIT, ZONES
from netloom.sources import fixtures as fx
from netloom.sources import readers as R
from netloom.sources import writers as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    from netloom.plans.catalog import _r as rounded

    return rounded(df, digits)


def _lines(spark, d) -> DataFrame:
    return fx.supplier_lines(spark, d)


def _shapes(spark, d) -> DataFrame:
    """The lines and the zones of the nations as shapes; refs of zones are negative."""
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    lines = _lines(spark, d).select("ref", F.lit(None).cast("string").alias("layer"), F.lit("line").alias("shape_type"), F.array(at("x1", "y1"), at("x2", "y2")).alias("points"), F.lit(False).alias("closed"), "weight")
    zones = fx.nation_zones(spark, d).select((-1 - F.col("ref")).alias("ref"), F.lit(None).cast("string"), F.lit("polygon"), "points", F.lit(True), F.lit(0.0))
    return lines.union(zones)


def _ends(df: DataFrame, *more: str) -> DataFrame:
    """The first and last point of each shape."""
    p = F.col("points")
    return df.select(*more, p[0]["x"].alias("x1"), p[0]["y"].alias("y1"), F.element_at(p, -1)["x"].alias("x2"), F.element_at(p, -1)["y"].alias("y2"))


# --- tables


@query(f"WITH {LINES} SELECT ref, x1, y1, x2, y2, weight FROM lines")
def csv_lines(spark, d):
    path = V.new_path(spark, "csv")
    W.write_csv(_lines(spark, d).withColumnRenamed("ref", "Ref"), path)
    return _r(_ends(R.read_shapes(spark, path, "csv"), "ref", F.col("Weight").alias("weight")))


@query("SELECT vec_id AS ref, round(CAST(embedding[1] AS DOUBLE), 6) AS x, round(CAST(embedding[2] AS DOUBLE), 6) AS y, CAST(label AS DOUBLE) AS value FROM embeddings")
def tsv_points(spark, d):
    path = V.new_path(spark, "tsv")
    W.write_csv(fx.embedding_points(spark, d).select(F.col("ref").alias("Ref"), F.col("x").alias("Easting"), F.col("y").alias("Northing"), "value"), path, "\t")
    s = R.read_shapes(spark, path, "tsv")
    return _r(s.select("ref", F.col("points")[0]["x"].alias("x"), F.col("points")[0]["y"].alias("y"), F.col("Value").alias("value")))


@query("SELECT CAST(p_partkey AS VARCHAR) AS part, p_name AS name, p_brand AS brand FROM part")
def csv_table(spark, d):
    path = V.new_path(spark, "csv")
    W.write_csv(fx.table(spark, d, "part").select(F.col("p_partkey").alias(" part "), F.col("p_name").alias("name"), F.col("p_brand").alias("brand")), path)
    return R.read_table(spark, path)


@query("""WITH v AS (SELECT p_type AS value, min(p_partkey) AS first FROM part GROUP BY p_type), c AS (SELECT value, row_number() OVER (ORDER BY first) - 1 AS code, count(*) OVER () AS n FROM v)
SELECT p_partkey AS ref, CAST(CASE WHEN n > 32 THEN -1 ELSE code END AS DOUBLE) AS kind, CAST(p_size AS DOUBLE) AS size FROM part JOIN c ON value = p_type""")
def csv_numeric_columns(spark, d):
    """Columns of a table of points as numbers: texts become codes, or -1 if there are too many of them."""
    path = V.new_path(spark, "csv")
    p = fx.table(spark, d, "part")
    W.write_csv(p.select(F.col("p_partkey").alias("Ref"), (F.col("p_partkey") % 50).alias("x"), F.floor(F.col("p_partkey") / 50).alias("y"), F.col("p_type").alias("kind_of"), F.col("p_size").alias("size")), path)
    return _r(R.read_shapes(spark, path, "csv").select("ref", F.col("Kind Of").alias("kind"), F.col("Size").alias("size")))


@query(f"WITH {LINES} SELECT CAST(ref AS BIGINT) AS a, CAST(ref + 1 AS BIGINT) AS b, x1 AS x, y1 AS y, x1, y1, x2, y2, 90.0::DOUBLE AS angle, 120.0::DOUBLE AS view_angle FROM lines")
def csv_entities(spark, d):
    """Points, lines, isovists and pairs of refs parsed from one table."""
    path = V.new_path(spark, "csv")
    W.write_csv(_lines(spark, d).select(F.col("ref").alias("RefFrom"), (F.col("ref") + 1).alias("RefTo"), F.col("x1").alias("X"), F.col("y1").alias("Y"), F.col("x1").alias("X_1"), "y1", "x2", "y2", F.lit(90).alias("Angle"), F.lit(120).alias("ViewAngle")).withColumnRenamed("X_1", "x1"), path)
    t = R.read_table(spark, path)
    pairs, points, lines, isovists = R.parse_ref_pairs(t), R.parse_points(t), R.parse_lines(t), R.parse_isovists(t)
    from netloom.operators.attributes import with_row_index

    number = lambda df: with_row_index(df.withColumn("ref", F.monotonically_increasing_id())).drop("ref")
    out = number(pairs).join(number(points), "idx").join(number(lines), "idx").join(number(isovists).select("idx", "angle", "view_angle"), "idx")
    return _r(out.drop("idx"))


# --- drawings


@query(f"""WITH {LINES}, {ZONES},
s AS (SELECT 'line' AS kind, false AS closed, 2 AS n, x1, y1, x2, y2 FROM lines UNION ALL SELECT 'polygon', true, 4, x1, y1, x1, y2 FROM zones)
SELECT kind, closed, CAST(n AS BIGINT) AS n, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM s""")
def cat_shapes(spark, d):
    path = V.new_path(spark, "cat")
    W.write_lines(W.cat(_shapes(spark, d)), path)
    return _r(_ends(R.read_shapes(spark, path, "cat"), F.col("shape_type").alias("kind"), "closed", F.size("points").alias("n")))


@query(f"""WITH {LINES}, {ZONES},
s AS (SELECT 'line' AS kind, 2 AS n, x1, y1, x2, y2 FROM lines UNION ALL SELECT 'polygon', 4, x1, y1, x1, y2 FROM zones)
SELECT kind, CAST(n AS BIGINT) AS n, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM s""")
def mif_shapes(spark, d):
    path = V.new_path(spark, "mif")
    W.write_lines(W.mif(_shapes(spark, d), ["weight"])[0], path)
    return _r(_ends(R.read_shapes(spark, path, "mif"), F.col("shape_type").alias("kind"), F.size("points").alias("n")))


@query(f"WITH {LINES}, {ZONES} SELECT ref, weight FROM lines UNION ALL SELECT -1 - ref, 0.0::DOUBLE FROM zones")
def mif_attributes(spark, d):
    head, rows = V.new_path(spark, "mif"), V.new_path(spark, "mid")
    mif, mid = W.mif(_shapes(spark, d), ["weight"])
    W.write_lines(mif, head)
    W.write_lines(mid, rows)
    return _r(R.read_mif_attributes(spark, head, rows))


def _dxf(*codes: tuple[int, str | Column]) -> Column:
    """Group codes and values, a line each."""
    return F.concat_ws("\n", *[x for code, value in codes for x in (F.lit(f"{code:3d}"), F.lit(value) if isinstance(value, str) else value.cast("string"))])


@query(f"""WITH {LINES}, n AS (SELECT ref, x1, y1, x2, y2, CAST(ref % 25 AS VARCHAR) AS layer FROM lines),
s AS (SELECT layer, 'line' AS kind, 2 AS n, x1, y1, x2, y2 FROM n UNION ALL SELECT layer, 'point', 1, x1, y1, x1, y1 FROM n
  UNION ALL SELECT layer, 'polygon', 3, x1, y1, x1, y1 + 1 FROM n UNION ALL SELECT layer, 'polyline', 3, x1, y1, x1 + 2, y1 FROM n
  UNION ALL SELECT layer, 'line', 2, x1, y1, x1, y1 + 2 FROM n)
SELECT layer, kind, CAST(n AS BIGINT) AS n, x1, y1, x2, y2 FROM s""")
def dxf_shapes(spark, d):
    """Drawings of points, lines, polylines of both kinds and inserted blocks (scaled by 2 and turned by a right angle), one for each layer."""
    t = _lines(spark, d).withColumn("layer", (F.col("ref") % 25).cast("string"))
    x, y, layer = F.col("x1"), F.col("y1"), F.col("layer")
    entity = F.concat_ws(
        "\n",
        _dxf((0, "POINT"), (8, layer), (10, x), (20, y)),
        _dxf((0, "LINE"), (8, layer), (10, x), (20, y), (11, F.col("x2")), (21, F.col("y2"))),
        _dxf((0, "LWPOLYLINE"), (8, layer), (90, "3"), (70, "1"), (10, x), (20, y), (10, x + 1), (20, y), (10, x), (20, y + 1)),
        _dxf((0, "POLYLINE"), (8, layer), (66, "1"), (0, "VERTEX"), (10, x), (20, y), (0, "VERTEX"), (10, x + 1), (20, y + 1), (0, "VERTEX"), (10, x + 2), (20, y), (0, "SEQEND")),
        _dxf((0, "INSERT"), (8, layer), (2, "MARK"), (10, x), (20, y), (41, "2"), (42, "2"), (50, "90")),
    )
    head = _dxf((0, "SECTION"), (2, "BLOCKS"), (0, "BLOCK"), (2, "MARK"), (10, "1"), (20, "1"), (0, "LINE"), (8, "0"), (10, "1"), (20, "1"), (11, "2"), (21, "1"), (0, "ENDBLK"), (0, "ENDSEC"), (0, "SECTION"), (2, "ENTITIES"))
    files = t.groupBy("layer").agg(F.array_join(F.array_sort(F.collect_list(entity)), "\n").alias("body"))
    path = V.new_path(spark, "dxf")
    files.select("layer", F.concat_ws("\n", head, "body", _dxf((0, "ENDSEC"), (0, "EOF"))).alias("value")).repartition("layer").write.partitionBy("layer").text(path)
    return _r(_ends(R.read_shapes(spark, f"{path}/*", "dxf"), "layer", F.col("shape_type").alias("kind"), F.size("points").alias("n")))


@query(f"WITH {LINES} SELECT CASE WHEN ref % 2 = 0 THEN 'A1' ELSE 'B2' END AS layer, x1, y1, x2, y2 FROM lines WHERE ref % 3 <> 0")
def tiger_lines(spark, d):
    path = V.new_path(spark, "rt1")
    kind = F.when(F.col("ref") % 3 == 0, "H1").otherwise(F.when(F.col("ref") % 2 == 0, "A1").otherwise("B2"))  # water is left out
    n = lambda c, w: F.format_string(f"%+0{w}d", (F.col(c) * 1_000_000).cast("long"))
    text = F.concat(F.rpad(F.lit("1"), 55, " "), F.rpad(kind, 135, " "), n("x1", 10), n("y1", 9), n("x2", 10), n("y2", 9))
    _lines(spark, d).select(text).write.text(path)
    return _r(_ends(R.read_shapes(spark, path, "rt1"), "layer"))


@query(f"WITH {LINES} SELECT 'Road ' || CAST(ref % 4 AS VARCHAR) AS layer, round(x1 + 100, 6) AS x1, round(y1 + 200, 6) AS y1, round(x2 + 100, 6) AS x2, round(y2 + 200, 6) AS y2 FROM lines")
def ntf_lines(spark, d):
    t = _lines(spark, d).withColumn("kind", (F.col("ref") % 4).cast("string"))
    n = lambda c: F.format_string("%05d", (F.col(c) * 100).cast("long"))
    record = F.concat_ws("\n", F.concat(F.lit("23"), F.rpad(F.lit(""), 14, " "), F.lpad("kind", 4, "0"), F.lit("0%")), F.concat(F.lit("21"), F.rpad(F.lit(""), 7, " "), F.lit("0002"), n("x1"), n("y1"), F.lit(" "), n("x2"), n("y2"), F.lit(" 0%")))
    names = F.concat_ws("\n", *[F.lit(f"05000{k}Road {k}\\0%") for k in range(4)])
    place = F.concat(F.rpad(F.lit("07"), 46, " "), F.lit("0000000100"), F.lit("0000000200"), F.lit("0%"))
    path = V.new_path(spark, "ntf")
    t.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list(record)), "\n").alias("body")).select("kind", F.concat_ws("\n", F.lit("01 0%"), names, place, "body", F.lit("99 0%")).alias("value")).repartition("kind").write.partitionBy("kind").text(path)
    return _r(_ends(R.read_shapes(spark, f"{path}/*", "ntf"), "layer"))


# --- what is written


@query(f"""WITH {CELLS} SELECT c.ref AS "Ref", CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, printf('%.8f', p_retailprice) AS price FROM cells c JOIN part ON p_partkey = ref WHERE filled""")
def lattice_summary(spark, d):
    return _r(W.summary(fx.part_lattice(spark, d).filter("filled").drop("filled"), ("ref", "x", "y")))


@query(f"""WITH {LINES} SELECT ref AS "Ref", x1, y1, x2, y2, printf('%.8f', weight) AS weight FROM lines""")
def shape_summary(spark, d):
    return _r(W.summary(_lines(spark, d), ("ref", "x1", "y1", "x2", "y2")))


@query(f"""WITH {CELLS} SELECT ref AS "Ref", CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM cells WHERE filled""")
def point_list(spark, d):
    return _r(W.point_list(fx.part_lattice(spark, d)))


def _sight(spark, d) -> tuple[DataFrame, DataFrame]:
    from netloom.plans.catalog import _seen_once

    return _seen_once(spark, d)


@query(f"""WITH {SIGHT} SELECT CAST(f.x AS BIGINT) AS x, CAST(f.y AS BIGINT) AS y, {', '.join(f'count(src) FILTER (WHERE bin = {k}) AS bin{k}' for k in range(32))} FROM f LEFT JOIN sight ON src = ref GROUP BY f.x, f.y""")
def bin_summary(spark, d):
    return _r(W.bin_summary(*_sight(spark, d)))


@query(f"""WITH {SIGHT} SELECT src AS "RefFrom", dst AS "RefTo" FROM sight WHERE src < dst""")
def lattice_connections(spark, d):
    return W.connection_pairs(_sight(spark, d)[1])


@query(f"""WITH {EDGES}, i AS (SELECT ref, row_number() OVER (ORDER BY ref) - 1 AS k FROM lines)
SELECT a.k AS "refA", b.k AS "refB" FROM edges JOIN i a ON a.ref = src JOIN i b ON b.ref = dst WHERE src < dst""")
def axial_connections(spark, d):
    lines = _lines(spark, d)
    return _r(W.row_pairs(lines, X.line_edges(lines, cell=4.0)))


@query(f"""WITH {EDGES} SELECT a AS "refA", b AS "refB", CAST(link AS BIGINT) AS link FROM (
  SELECT a.ref AS a, b.ref AS b, 1 AS link FROM lines a JOIN lines b ON b.ref = a.ref + 1 UNION ALL SELECT src, dst, 0 FROM edges WHERE src < dst)""")
def link_unlink_pairs(spark, d):
    lines = _lines(spark, d)
    refs = lines.select("ref")
    links = refs.select(F.col("ref").alias("a"), (F.col("ref") + 1).alias("b")).join(refs.withColumnRenamed("ref", "b"), "b", "left_semi").select("a", "b")
    return _r(W.link_pairs(links, X.line_edges(lines, cell=4.0).filter("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))))


@query(f"""WITH {CELLS}, p AS (SELECT a.ref AS a, b.ref AS b FROM cells a JOIN cells b ON b.ref = a.ref + 7)
SELECT CAST(a.x AS BIGINT) AS x1, CAST(a.y AS BIGINT) AS y1, CAST(b.x AS BIGINT) AS x2, CAST(b.y AS BIGINT) AS y2 FROM p JOIN cells a ON a.ref = p.a JOIN cells b ON b.ref = p.b""")
def merge_lines(spark, d):
    cells = fx.part_lattice(spark, d)
    refs = cells.select("ref")
    pairs = refs.select(F.col("ref").alias("a"), (F.col("ref") + 7).alias("b")).join(refs.withColumnRenamed("ref", "b"), "b", "left_semi").select("a", "b")
    return _r(W.merge_lines(cells, pairs))


_ROWS = f"""WITH {EDGES}, i AS (SELECT ref, x1, y1, row_number() OVER (ORDER BY ref) - 1 AS k FROM lines),
e AS (SELECT a.k AS a, b.k AS b FROM edges JOIN i a ON a.ref = src JOIN i b ON b.ref = dst WHERE src < dst)"""


@query(f"""{_ROWS} SELECT 'strict graph {{' AS value UNION ALL SELECT printf('    %d -- %d', a, b) FROM e UNION ALL SELECT '}}'""")
def dot_graph(spark, d):
    lines = _lines(spark, d)
    path = V.new_path(spark, "dot")
    W.write_lines(W.dot_graph(lines, X.line_edges(lines, cell=4.0)), path)
    return spark.read.text(path)


@query(f"""{_ROWS}, b AS (SELECT min(x1) AS x0, min(y1) AS y0, greatest(max(x1) - min(x1), max(y1) - min(y1)) AS side, count(*) AS n FROM i)
SELECT printf('*Vertices %d', n) AS value FROM b UNION ALL SELECT printf('%d "%d" %.6f %.6f', k + 1, ref, (x1 - x0) / side, (y1 - y0) / side) FROM i, b UNION ALL SELECT '*Edges' UNION ALL SELECT printf('%d %d 1', a + 1, b + 1) FROM e""")
def pajek_graph(spark, d):
    lines = _lines(spark, d)
    path = V.new_path(spark, "pajek")
    W.write_lines(W.pajek(lines.select("ref", F.col("x1").alias("x"), F.col("y1").alias("y")), X.line_edges(lines, cell=4.0)), path)
    return spark.read.text(path)


@query(f"WITH {EDGES} SELECT 'lines' AS kind, ref AS a, CAST(NULL AS BIGINT) AS b, weight FROM lines UNION ALL SELECT 'edges', src, dst, NULL FROM edges")
def project_tables(spark, d):
    """A project written and read back."""
    path = V.new_path(spark, "project")
    lines = _lines(spark, d)
    W.save_project(path, {"lines": lines, "edges": X.line_edges(lines, cell=4.0)})
    got = W.load_project(spark, path, ["lines", "edges"])
    none = lambda t: F.lit(None).cast(t)
    return _r(got["lines"].select(F.lit("lines").alias("kind"), F.col("ref").alias("a"), none("long").alias("b"), "weight").union(got["edges"].select(F.lit("edges"), "src", "dst", none("double"))))


# --- drawings as maps


@query(f"""WITH {LINES}, {ZONES}, s AS (SELECT ref, x1, y1, x2, y2 FROM lines UNION ALL SELECT -1 - ref, x1, y1, x2, y1 FROM zones UNION ALL SELECT -1 - ref, x2, y1, x2, y2 FROM zones
  UNION ALL SELECT -1 - ref, x2, y2, x1, y2 FROM zones UNION ALL SELECT -1 - ref, x1, y2, x1, y1 FROM zones)
SELECT ref AS shape_ref, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM s""")
def shape_sides(spark, d):
    return _r(R.lines_of(_shapes(spark, d)).drop("ref"))


@query(f"WITH {EDGES} SELECT src, dst FROM edges")
def connected_shapes(spark, d):
    """Contacts of drawn lines, found as those of shapes."""
    return D.shape_connections(_shapes(spark, d).filter("ref >= 0"))


@query(f"WITH {EDGES} SELECT src, dst FROM edges")
def connections_of_added_lines(spark, d):
    """Lines with refs of one parity are added to the others."""
    lines = _lines(spark, d)
    old, new = lines.filter("ref % 2 = 0"), lines.filter("ref % 2 = 1")
    return D.connect_added(old, X.line_edges(old, cell=4.0), new).select("src", "dst")


@query(f"""WITH {LINES}, {CELLS},
t AS (SELECT p.ref, l.ref AS shape, px, py, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy, greatest(0.0, least(1.0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) AS t FROM (SELECT ref, x + 0.25 AS px, y + 0.5 AS py FROM cells) p, lines l),
d AS (SELECT ref, shape, sqrt((x1 + t * dx - px) ** 2 + (y1 + t * dy - py) ** 2) AS raw, round(raw, 6) AS distance FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY distance, shape) AS k FROM d WHERE raw <= 2)
SELECT ref, shape, distance FROM r WHERE k = 1""")
def nearest_shapes(spark, d):
    points = fx.part_lattice(spark, d).select("ref", (F.col("x") + 0.25).alias("x"), (F.col("y") + 0.5).alias("y"))
    return _r(D.nearest_shape(points, _shapes(spark, d).filter("ref >= 0"), 2.0))


@query(f"WITH {ZONES} SELECT p.ref, CAST(coalesce(max(-1 - zone), -2) AS BIGINT) AS shape FROM points p LEFT JOIN inside i ON i.point = p.ref GROUP BY p.ref")
def shapes_at_points(spark, d):
    return _r(D.shape_at(fx.embedding_points(spark, d).select("ref", "x", "y"), _shapes(spark, d).filter("ref < 0"), 0.001))


@query(f"WITH {LINES} SELECT ref FROM lines WHERE greatest(x1, x2) >= 1 AND least(x1, x2) <= 4 AND greatest(y1, y2) >= 2 AND least(y1, y2) <= 5")
def drawn_in_region(spark, d):
    return D.shapes_in_region(_shapes(spark, d).filter("ref >= 0"), (1.0, 2.0, 4.0, 5.0)).select("ref")


@query(f"""WITH {ZONES}, p AS (SELECT ref, x, y FROM points), c AS (SELECT ref, k, x + 0.5 * cos(2 * pi() * k / 32) AS x1, y + 0.5 * sin(2 * pi() * k / 32) AS y1, x + 0.5 * cos(2 * pi() * (k + 1) / 32) AS x2, y + 0.5 * sin(2 * pi() * (k + 1) / 32) AS y2 FROM p, range(32) r(k))
SELECT ref, count(*) AS sides, round(sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)), 5) AS around, round(avg(x1), 5) AS x, round(avg(y1), 5) AS y FROM c GROUP BY ref""")
def circles(spark, d):
    s = D.circle_lines(fx.embedding_points(spark, d).select("ref", "x", "y"), 0.5)
    return _r(s.groupBy("ref").agg(F.count("*").alias("sides"), F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("around"), F.avg("x1").alias("x"), F.avg("y1").alias("y")), 5)


@query(f"""WITH {ZONES} SELECT ref, CAST(32 AS BIGINT) AS n, round(16 * 0.25 * sin(2 * pi() / 32), 5) AS area FROM points""")
def disks(spark, d):
    t = D.disk_triangles(fx.embedding_points(spark, d).select("ref", "x", "y"), 0.5)
    area = F.abs((F.col("x2") - F.col("x1")) * (F.col("y3") - F.col("y1")) - (F.col("x3") - F.col("x1")) * (F.col("y2") - F.col("y1"))) / 2
    return _r(t.groupBy("ref").agg(F.count("*").alias("n"), F.sum(area).alias("area")), 5)


_CROSSING = f"""c AS (SELECT a.ref, b.ref AS wall, a.x1, a.y1, a.x2, a.y2, ((b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1)) / nullif((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1), 0) AS t
  FROM (SELECT ref, x1 + 0.25 AS x1, y1 + 0.125 AS y1, x2 + 0.25 AS x2, y2 + 0.125 AS y2 FROM lines) a JOIN lines b ON {MEET})"""


@query(f"""WITH {LINES}, {_CROSSING}, f AS (SELECT ref, min(t) AS t FROM c WHERE t > 1e-9 GROUP BY ref)
SELECT l.ref, round(x1 + 0.25, 6) AS x1, round(y1 + 0.125, 6) AS y1, round(x1 + 0.25 + coalesce(t, 1) * (x2 - x1), 6) AS x2, round(y1 + 0.125 + coalesce(t, 1) * (y2 - y1), 6) AS y2 FROM lines l LEFT JOIN f USING (ref)""")
def lines_cut_at_walls(spark, d):
    lines = _lines(spark, d)
    moved = lines.select("ref", (F.col("x1") + 0.25).alias("x1"), (F.col("y1") + 0.125).alias("y1"), (F.col("x2") + 0.25).alias("x2"), (F.col("y2") + 0.125).alias("y2"))
    return _r(D.cut_lines(moved, lines.select("ref", "x1", "y1", "x2", "y2")).select("ref", "x1", "y1", "x2", "y2"))


@query(f"""WITH {LINES}, every AS (SELECT ref, x1, y1, x2, y2, row_number() OVER (PARTITION BY CASE WHEN (x1, y1) <= (x2, y2) THEN (x1, y1, x2, y2) ELSE (x2, y2, x1, y1) END ORDER BY ref DESC) AS k FROM lines)
SELECT shape_ref, x1, y1, x2, y2, connectivity FROM (SELECT a.ref AS shape_ref, a.x1, a.y1, a.x2, a.y2, count(b.ref) AS connectivity FROM every a LEFT JOIN every b ON b.k = 1 AND a.ref <> b.ref AND {MEET} WHERE a.k = 1 GROUP BY ALL)""")
def drawing_to_axial(spark, d):
    lines, edges = D.to_axial(_shapes(spark, d).filter("ref >= 0"))
    n = edges.groupBy(F.col("src").alias("ref")).agg(F.count("*").alias("connectivity"))
    return _r(lines.join(n, "ref", "left").select(F.col("Data Map Ref").alias("shape_ref"), "x1", "y1", "x2", "y2", F.coalesce("connectivity", F.lit(0)).alias("connectivity")))


@query(f"""WITH {ZONES}, e AS (SELECT a.ref AS src, count(b.ref) AS n FROM zones a LEFT JOIN zones b ON a.ref <> b.ref AND abs(a.ref % 5 - b.ref % 5) <= 1 AND abs(a.ref // 5 - b.ref // 5) <= 1 GROUP BY a.ref) SELECT -1 - src AS ref, n AS touching FROM e""")
def drawing_to_convex(spark, d):
    polygons, edges = D.to_convex(_shapes(spark, d).filter("ref < 0"))
    return _r(polygons.select("ref").join(edges.groupBy(F.col("src").alias("ref")).agg(F.count("*").alias("touching")), "ref", "left").select("ref", F.coalesce("touching", F.lit(0)).alias("touching")))


@query(f"""WITH {CELLS}, f AS (SELECT x, y FROM cells WHERE filled),
s AS (SELECT f.x, f.y, dx, dy FROM f, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) v(dx, dy)) SELECT count(*) AS sides FROM s ANTI JOIN f o ON o.x = s.x + dx AND o.y = s.y + dy""")
def lattice_outline(spark, d):
    return D.outline(fx.part_lattice(spark, d).filter("filled")).agg(F.count("*").alias("sides"))


@query(f"WITH {CELLS} SELECT coalesce(CAST(max(CASE WHEN filled AND x = 3 AND y = 2 THEN p_retailprice END) AS DOUBLE), -2.0) AS value FROM cells JOIN part ON p_partkey = ref")
def lattice_value_at(spark, d):
    return _r(L.cell_at(fx.part_lattice(spark, d), 3.2, 1.9, "price"))


@query(f"""WITH {SPLIT}, l AS (SELECT ref, weight FROM lines) SELECT axial_ref, count(*) AS pieces, round(any_value(weight), 6) AS weight FROM numbered JOIN l ON l.ref = axial_ref GROUP BY axial_ref""")
def axial_map_to_segments(spark, d):
    lines = _lines(spark, d)
    segments, _ = D.axial_to_segments(lines, None, attributes=["weight"])
    pushed = next(c for c in segments.columns if c.lower() == "axial weight")
    return _r(segments.groupBy("axial_ref").agg(F.count("*").alias("pieces"), F.max(f"`{pushed}`").alias("weight")))
