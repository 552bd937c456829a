"""Reading drawings and tables into DataFrames of shapes: ref, layer, shape_type, points, closed.

Text formats whose records stand alone are read line by line with built-in functions. Formats whose records refer to each other (DXF blocks, NTF
continuations, MIF with MID) are parsed a whole file at a time, each file in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHAPES = "ref bigint, layer string, shape_type string, points array<struct<x:double,y:double>>, closed boolean"
#: More distinct texts than this in a column and it gets no codes.
MAX_CATEGORIES = 32


class ImportFault(ValueError):
    pass


def read_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as text, quotes trimmed from the header; a header of one cell or a ragged row is an error (the latter when rows are read)."""
    df = spark.read.option("header", True).option("sep", sep).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    if len(df.columns) < 2:
        raise ImportFault("the header needs two columns at least")
    return df.toDF(*[c.strip().strip('"') for c in df.columns])


def column_name(name: str) -> str:
    """Underscores become spaces, words start with a capital."""
    return " ".join(w[:1].upper() + w[1:].lower() for w in name.replace("_", " ").split(" "))


def category_codes(df: DataFrame, column: str, order: str) -> DataFrame:
    """ref, code: numbers of texts in the order of their first rows; -1 for all if there are more than 32 texts."""
    first = df.groupBy(column).agg(F.min(order).alias("_first"))
    n = first.agg(F.count("*").alias("_n"))
    few = first.orderBy("_first").limit(MAX_CATEGORIES + 1)  # bounded, so one task ranks them
    ranked = few.withColumn("code", F.row_number().over(Window.orderBy("_first")) - 1).select(column, "code")
    joined = df.join(F.broadcast(ranked), column, "left").crossJoin(F.broadcast(n))
    return joined.select("ref", F.when(F.col("_n") > MAX_CATEGORIES, -1).otherwise(F.col("code")).alias("code"))


def numeric_columns(df: DataFrame, skip: set[str], order: str) -> DataFrame:
    """Columns of text as numbers: each cell's value if it is one, else the code of its text."""
    out = df
    for c in [c for c in df.columns if c not in skip]:
        texts = out.filter(F.col(f"`{c}`").try_cast("double").isNull()).select("ref", F.col(f"`{c}`").alias("value"), F.col(order).alias("_o"))
        codes = category_codes(texts.select("ref", "value", "_o"), "value", "_o").withColumnRenamed("code", "_code")
        out = out.join(codes, "ref", "left").withColumn("_value", F.coalesce(F.col(f"`{c}`").try_cast("double"), F.col("_code").cast("double")))
        out = out.drop("_code", c).withColumnRenamed("_value", column_name(c))
    return out


def _pick(df: DataFrame, *names: str) -> str | None:
    return next((c for c in df.columns if c.strip().lower() in names), None)


def shapes_from_table(df: DataFrame) -> DataFrame:
    """Points (x and y, or easting and northing) or lines (x1, y1, x2, y2) with refs if the table has them, else numbered by row; attributes follow."""
    ref = _pick(df, "ref")
    x, y = _pick(df, "x", "easting"), _pick(df, "y", "northing")
    ends = [_pick(df, k) for k in ("x1", "y1", "x2", "y2")]
    number = F.col(f"`{ref}`").cast("long") if ref else F.monotonically_increasing_id()
    point = lambda a, b: F.struct(F.col(f"`{a}`").cast("double").alias("x"), F.col(f"`{b}`").cast("double").alias("y"))
    if x and y:
        points, kind, used = F.array(point(x, y)), "point", [x, y]
    elif all(ends):
        points, kind, used = F.array(point(*ends[:2]), point(*ends[2:])), "line", ends
    else:
        raise ImportFault("the table has neither points nor lines")
    rest = [c for c in df.columns if c not in (*used, ref)]
    out = df.select(number.alias("ref"), F.lit(None).cast("string").alias("layer"), F.lit(kind).alias("shape_type"), points.alias("points"), F.lit(False).alias("closed"), *[F.col(f"`{c}`") for c in rest])
    if not ref:
        from netloom.operators.attributes import with_row_index

        out = with_row_index(out).withColumn("ref", F.col("idx").cast("long")).drop("idx")
    return numeric_columns(out, {"ref", "layer", "shape_type", "points", "closed"}, "ref") if rest else out


def read_shapes(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """kind: csv, tsv, cat, rt1, ntf, dxf or mif."""
    if kind in ("csv", "tsv"):
        return shapes_from_table(read_table(spark, path, "," if kind == "csv" else "\t"))
    whole = {"cat": parse_cat, "ntf": parse_ntf, "dxf": parse_dxf, "mif": parse_mif}
    if kind == "rt1":
        return read_tiger(spark, path)
    if kind not in whole:
        raise ImportFault(f"{kind} isn't known")
    return _whole_files(spark, path, whole[kind])


def _whole_files(spark: SparkSession, path: str, parse: Callable[[str], list[tuple]]) -> DataFrame:
    """Shapes of each file: (layer, kind, points, closed), numbered across files by file and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                rows = [{"path": name, "k": k, "layer": r[0], "shape_type": r[1], "points": [{"x": float(x), "y": float(y)} for x, y in r[2]], "closed": r[3]} for k, r in enumerate(parse(text))]
                yield pa.RecordBatch.from_pylist(rows, schema=_PARSED)

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    rows = files.mapInArrow(run, "path string, k long, layer string, shape_type string, points array<struct<x:double,y:double>>, closed boolean")
    sizes = rows.groupBy("path").agg(F.count("*").alias("n"))
    offset = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per file
    return rows.join(F.broadcast(offset), "path").select((F.col("before") + F.col("k")).alias("ref"), "layer", "shape_type", "points", "closed")


_PARSED = pa.schema([("path", pa.string()), ("k", pa.int64()), ("layer", pa.string()), ("shape_type", pa.string()), ("points", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), ("closed", pa.bool_())])


def parse_cat(text: str) -> list[tuple]:
    """Blocks `begin polygon` or `begin polyline`, a line of x y each, `end`. Two points make a line."""
    out, kind, points = [], None, []
    for line in text.splitlines():
        line = line.split("#")[0].strip().lower()
        if not line:
            continue
        if line.startswith("begin"):
            kind, points = line.split()[-1], []
        elif line == "end":
            if kind and len(points) > 1:
                out.append((None, "line" if len(points) == 2 else kind, points, kind == "polygon" and len(points) > 2))
            kind = None
        elif kind:
            x, y = line.split()[:2]
            points.append((float(x), float(y)))
    return out


def read_tiger(spark: SparkSession, path: str) -> DataFrame:
    """Record type 1 by fixed columns: the class at 55, ends at 190 to 228 in millionths of a degree. Classes A and B, a layer for each."""
    t = spark.read.text(path)
    cut = lambda at, n: F.substring("value", at + 1, n)
    number = lambda at, n: F.trim(F.regexp_replace(cut(at, n), "\\+", "")).cast("double") / 1e6
    t = t.filter(F.substring("value", 1, 1) == "1").withColumn("layer", cut(55, 2)).filter(F.substring("layer", 1, 1).isin("A", "B"))
    points = F.array(*[F.struct(number(a, 10).alias("x"), number(b, 9).alias("y")) for a, b in ((190, 200), (209, 219))])
    t = t.select(F.monotonically_increasing_id().alias("ref"), "layer", F.lit("line").alias("shape_type"), points.alias("points"), F.lit(False).alias("closed"))
    return t.filter(F.forall("points", lambda p: p["x"].isNotNull() & p["y"].isNotNull()))


def parse_ntf(text: str) -> list[tuple]:
    """Line geometry of NTF: a layer per feature code, coordinates in hundredths and offset as section headers say."""
    records: list[str] = []
    for line in text.splitlines():
        line = line.rstrip("\r")
        body, more = (line[:-2], line[-2] == "1") if line.endswith("%") and len(line) > 1 else (line, False)
        if records and records[-1].endswith("\x01"):
            records[-1] = records[-1][:-1] + (body[2:] if body.startswith("00") else body)
        else:
            records.append(body)
        if more:
            records[-1] += "\x01"
    names: dict[str, str] = {}
    east = north = 0.0
    digits = 5
    out: list[list] = []
    for r in records:
        kind = r[:2]
        if kind == "02":
            digits = 6 if "meridian" in r.lower() else 5
        elif kind == "05":
            names[r[2:6]] = r[6:].split("\\")[0].strip() or r[2:6]
        elif kind == "07":
            east, north = _float(r[46:56]), _float(r[56:66])
        elif kind == "23":
            out.append([r[16:20].strip(), []])
        elif kind == "14" and out and "FC" in r:
            out[-1][0] = r[r.index("FC") + 2 :][:4]
        elif kind == "21" and out:
            n, at = int(_float(r[9:13])), 13
            for _ in range(n):
                x, y = r[at : at + digits], r[at + digits : at + 2 * digits]
                if len(y) < digits:
                    break
                out[-1][1].append((_float(x) / 100 + east, _float(y) / 100 + north))
                at += 2 * digits + 1
    return [(names.get(code, code), "line" if len(p) == 2 else "polyline", p, False) for code, p in out if len(p) > 1]


def _float(x: str) -> float:
    try:
        return float(x)
    except ValueError:
        return 0.0


def _arc(cx: float, cy: float, rx: float, ry: float, start: float, end: float, turn: float = 0.0, resolution: int = 64) -> list[tuple[float, float]]:
    """Points along an arc from start to end, counter-clockwise; degrees."""
    span = (end - start) % 360 or 360
    n = max(1, int(math.ceil(span * resolution / 360)))
    out = []
    for k in range(n + 1):
        a = math.radians(start + span * k / n)
        x, y = rx * math.cos(a), ry * math.sin(a)
        c, s = math.cos(turn), math.sin(turn)
        out.append((cx + x * c - y * s, cy + x * s + y * c))
    return out


class _Dxf:
    """Group codes of a drawing, its blocks, and the shapes of its entities."""

    def __init__(self, text: str):
        lines = text.splitlines()
        self.pairs = [(int(a.strip()), b.strip()) for a, b in zip(lines[::2], lines[1::2]) if a.strip().lstrip("-").isdigit()]
        self.blocks: dict[str, tuple[tuple[float, float], list]] = {}

    def items(self) -> Iterator[tuple[str, list[tuple[int, str]]]]:
        """Each record by its name, with what follows up to the next."""
        name, body = "", []
        for code, value in self.pairs:
            if code == 0:
                if name:
                    yield name, body
                name, body = value.upper(), []
            else:
                body.append((code, value))
        if name:
            yield name, body

    def shapes(self) -> list[tuple]:
        section, out, block, open_line = "", [], None, None
        for name, body in self.items():
            get = dict(reversed(body))
            if name == "SECTION":
                section = get.get(2, "").upper()
                continue
            if name in ("ENDSEC", "EOF"):
                section = ""
                continue
            if section == "BLOCKS" and name == "BLOCK":
                block = []
                self.blocks[get.get(2, "")] = ((_float(get.get(10, "0")), _float(get.get(20, "0"))), block)
                continue
            if name == "ENDBLK":
                block = None
                continue
            if section not in ("ENTITIES", "BLOCKS"):
                continue
            into = out if section == "ENTITIES" else block
            if into is None:
                continue
            if name == "POLYLINE":
                open_line = (get.get(8), [], bool(int(_float(get.get(70, "0"))) & 1))
            elif name == "VERTEX" and open_line:
                open_line[1].append((_float(get.get(10, "0")), _float(get.get(20, "0"))))
            elif name == "SEQEND" and open_line:
                into.append(("shape", *_poly(*open_line)))
                open_line = None
            elif name == "INSERT":
                into.append(("insert", body))
            else:
                got = self.entity(name, body, get)
                if got:
                    into.append(("shape", *got))
        return [s for s in self.flat(out, set()) if s]

    def entity(self, name: str, body: list, get: dict) -> tuple | None:
        f = lambda code, other=0.0: _float(get[code]) if code in get else other
        layer = get.get(8)
        if name == "POINT":
            return layer, "point", [(f(10), f(20))], False
        if name == "LINE":
            a, b = (f(10), f(20)), (f(11), f(21))
            return (layer, "line", [a, b], False) if a != b else None
        if name == "LWPOLYLINE":
            xs, ys = [_float(v) for c, v in body if c == 10], [_float(v) for c, v in body if c == 20]
            return _poly(layer, list(zip(xs, ys)), bool(int(f(70)) & 1))
        if name == "CIRCLE":
            return layer, "polygon", _arc(f(10), f(20), f(40), f(40), 0, 360)[:-1], True
        if name == "ARC":
            return layer, "polyline", _arc(f(10), f(20), f(40), f(40), f(50), f(51)), False
        if name == "ELLIPSE":
            major = math.hypot(f(11), f(21))
            start, end = math.degrees(f(41)), math.degrees(f(42, 2 * math.pi))
            points = _arc(f(10), f(20), major, major * f(40, 1.0), start, end, math.atan2(f(21), f(11)))
            whole = abs(end - start - 360) < 1e-6
            return layer, "polygon" if whole else "polyline", points[:-1] if whole else points, whole
        if name == "SPLINE":
            xs, ys = [_float(v) for c, v in body if c == 10], [_float(v) for c, v in body if c == 20]
            return _poly(layer, list(zip(xs, ys)), bool(int(f(70)) & 1))
        return None

    def flat(self, entries: list, above: set[str]) -> Iterator[tuple]:
        """Shapes with inserts replaced by what their blocks hold, scaled, turned and moved; a block within itself is left out."""
        for kind, *rest in entries:
            if kind == "shape":
                yield tuple(rest)
                continue
            get = dict(reversed(rest[0]))
            name = get.get(2, "")
            if name not in self.blocks or name in above:
                continue
            (bx, by), inner = self.blocks[name]
            f = lambda code, other: _float(get[code]) if code in get else other  # noqa: E731, B023
            sx, sy, turn = f(41, 1.0), f(42, 1.0), math.radians(f(50, 0.0))
            c, s = math.cos(turn), math.sin(turn)
            for layer, shape, points, closed in self.flat(inner, above | {name}):
                moved = [((x - bx) * sx, (y - by) * sy) for x, y in points]
                yield get.get(8) if layer == "0" else layer, shape, [(f(10, 0.0) + x * c - y * s, f(20, 0.0) + x * s + y * c) for x, y in moved], closed


def _poly(layer, points: list, closed: bool) -> tuple | None:
    if len(points) < 2:
        return None
    if len(points) == 2:
        return (layer, "line", points, False) if points[0] != points[1] else None
    return layer, "polygon" if closed else "polyline", points, closed


def parse_dxf(text: str) -> list[tuple]:
    return _Dxf(text).shapes()


def parse_mif(text: str) -> list[tuple]:
    """Point, Line, Pline (also Multiple) and Region of a MIF; each part of a multiple is a shape."""
    words = [w for line in text.splitlines() for w in line.replace("(", " ").replace(")", " ").split()]
    lower = [w.lower() for w in words]
    at = lower.index("data") + 1 if "data" in lower else 0
    out = []

    def pairs(n: int) -> list[tuple[float, float]]:
        nonlocal at
        got = [(float(words[at + 2 * k]), float(words[at + 2 * k + 1])) for k in range(n)]
        at += 2 * n
        return got

    while at < len(words):
        word = lower[at]
        at += 1
        if word == "point":
            out.append((None, "point", pairs(1), False))
        elif word == "line":
            out.append((None, "line", pairs(2), False))
        elif word == "pline":
            parts = 1
            if lower[at] == "multiple":
                parts, at = int(words[at + 1]), at + 2
            for _ in range(parts):
                n, at = int(words[at]), at + 1
                out.append((None, "line" if n == 2 else "polyline", pairs(n), False))
        elif word == "region":
            parts, at = int(words[at]), at + 1
            for _ in range(parts):
                n, at = int(words[at]), at + 1
                out.append((None, "polygon", pairs(n), True))
    return out


def read_mif_attributes(spark: SparkSession, mif_path: str, mid_path: str) -> DataFrame:
    """ref (a column of that name, else the row's number) and the numeric columns of a MID, whose names and kinds its MIF declares; empty cells are -1."""
    every = spark.read.text(mif_path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"), "value")
    data = every.filter(F.lower(F.trim("value")) == "data").agg(F.min(F.struct("path", "at")).alias("data"))
    head = every.crossJoin(F.broadcast(data)).filter(F.col("data").isNull() | (F.struct("path", "at") < F.col("data")))  # one row; the lines up to the word Data
    lines = [r["value"] for r in head.orderBy("path", "at").select("value").collect()]  # a header, of a line for each column
    start = next(i for i, x in enumerate(lines) if x.strip().lower().startswith("columns"))
    n = int(lines[start].split()[1])
    columns = [x.split()[:2] for x in lines[start + 1 : start + 1 + n]]
    sep = next((x.split('"')[1] for x in lines if x.strip().lower().startswith("delimiter")), "\t")
    numeric = [(k, name) for k, (name, kind) in enumerate(columns) if kind.split("(")[0].lower() in ("integer", "smallint", "decimal", "float")]
    from netloom.operators.attributes import with_row_index

    raw = spark.read.option("sep", sep).csv(mid_path)
    own = next((k for k, name in numeric if name.lower() == "ref"), None)
    if own is not None:  # the refs that a map was written with
        rest = [(k, name) for k, name in numeric if k != own]
        return raw.select(F.col(raw.columns[own]).cast("long").alias("ref"), *[F.coalesce(F.col(raw.columns[k]).cast("double"), F.lit(-1.0)).alias(name) for k, name in rest])
    cells = raw.select(F.monotonically_increasing_id().alias("ref"), *[F.coalesce(F.col(raw.columns[k]).cast("double"), F.lit(-1.0)).alias(name) for k, name in numeric])
    return with_row_index(cells).withColumn("ref", F.col("idx").cast("long")).drop("idx")


def parse_points(df: DataFrame) -> DataFrame:
    """x, y of a table with these headers in any case."""
    return _numbers(df, {"x": ("x",), "y": ("y",)})


def parse_lines(df: DataFrame) -> DataFrame:
    return _numbers(df, {k: (k,) for k in ("x1", "y1", "x2", "y2")})


def parse_isovists(df: DataFrame) -> DataFrame:
    """x, y, angle, view_angle."""
    return _numbers(df, {"x": ("x",), "y": ("y",), "angle": ("angle",), "view_angle": ("viewangle",)})


def parse_isovist(text: str) -> tuple[float, float, float, float]:
    """x,y or x,y,angle,viewangle; a whole turn if no angles are given."""
    cells = [float(x) for x in text.split(",")]
    if len(cells) not in (2, 4):
        raise ImportFault(f"an isovist has two or four numbers, not {len(cells)}")
    return (*cells, 0.0, 360.0) if len(cells) == 2 else tuple(cells)


def parse_ref_pairs(df: DataFrame) -> DataFrame:
    """a, b of columns reffrom and refto."""
    got = _numbers(df, {"a": ("reffrom",), "b": ("refto",)})
    return got.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))


def _numbers(df: DataFrame, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    found: dict[str, Column] = {}
    for name, headers in wanted.items():
        c = _pick(df, *headers)
        if c is None:
            raise ImportFault(f"no column {headers[0]}")
        found[name] = F.col(f"`{c}`").cast("double").alias(name)
    return df.select(*found.values())


def lines_of(shapes: DataFrame) -> DataFrame:
    """ref, shape_ref, x1, y1, x2, y2: each shape's sides, closing sides too; points have none."""
    ring = F.when(F.col("closed"), F.concat("points", F.slice("points", 1, 1))).otherwise(F.col("points"))
    s = shapes.filter(F.size("points") > 1).select(F.col("ref").alias("shape_ref"), F.posexplode(F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("k", "s"))
    from netloom.operators.attributes import with_row_index

    flat = s.select("shape_ref", "k", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))
    return with_row_index(flat.withColumn("ref", F.struct("shape_ref", "k"))).withColumn("ref", F.col("idx").cast("long")).drop("idx", "k")
