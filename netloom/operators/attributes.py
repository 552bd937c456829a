"""The attribute table: a row per ref, any number of numeric columns, null for what is undefined (-1 at the edge, see legacy())."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_LAYERS = 64


def insert_or_reset(df: DataFrame, name: str) -> DataFrame:
    """A column of undefined values; one of that name loses its values."""
    return df.withColumn(name, F.lit(None).cast("double"))


def get_or_insert(df: DataFrame, name: str) -> DataFrame:
    return df if name in df.columns else insert_or_reset(df, name)


def remove_column(df: DataFrame, name: str) -> DataFrame:
    _require(df, name)
    return df.drop(name)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    _require(df, old)
    return df.withColumnRenamed(old, new)


def _require(df: DataFrame, name: str) -> None:
    if name not in df.columns:
        raise KeyError(f"no column {name!r}")


def add_row(df: DataFrame, ref: int) -> DataFrame:
    """A row of undefined values on layer 0; an error if the ref is taken."""
    if not df.filter(F.col("ref") == ref).isEmpty():
        raise ValueError(f"row {ref} exists")
    fresh = df.sparkSession.range(1).select(*[F.lit(ref).cast(f.dataType).alias(f.name) if f.name == "ref" else F.lit(1).cast(f.dataType).alias(f.name) if f.name == "layer_key" else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
    return df.unionByName(fresh)


def remove_row(df: DataFrame, ref: int) -> DataFrame:
    if df.filter(F.col("ref") == ref).isEmpty():
        raise ValueError(f"no row {ref}")
    return df.filter(F.col("ref") != ref)


def with_row_index(df: DataFrame) -> DataFrame:
    """idx: the rank of each ref from 0. Sorted and counted by partition, so no single task sees all rows."""
    spread = df.repartitionByRange(F.col("ref")).sortWithinPartitions("ref").withColumn("_p", F.spark_partition_id())
    counts = spread.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row per partition
    ranked = spread.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy("ref")))
    return ranked.join(F.broadcast(before), "_p").withColumn("idx", F.col("_before") + F.col("_k") - 1).drop("_p", "_k", "_before")


def stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, least, greatest, total of each column over its defined values, in one pass."""
    known = [F.when(F.col(c) != -1, F.col(c)) for c in columns]
    parts = [F.struct(F.lit(c).alias("column"), F.count(k).alias("n"), F.min(k).alias("least"), F.max(k).alias("greatest"), F.sum(k).alias("total")) for c, k in zip(columns, known)]
    return df.agg(F.array(*parts).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def normalised(df: DataFrame, column: str) -> DataFrame:
    """normalised: (value - least) / (greatest - least); 0.5 if all are equal, -1 if the value is undefined."""
    bounds = df.agg(F.min(F.when(F.col(column) >= 0, F.col(column))).alias("_lo"), F.max(column).alias("_hi"))
    value = F.when(F.col(column).isNull() | (F.col(column) < 0), -1.0).when(F.col("_lo") == F.col("_hi"), 0.5).otherwise((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return df.crossJoin(F.broadcast(bounds)).withColumn("normalised", value).drop("_lo", "_hi")  # one row


def selection_average(df: DataFrame, column: str, selected: Column) -> DataFrame:
    """The mean over selected rows, -1 if there is none."""
    return df.agg(F.coalesce(F.avg(F.when(selected, F.col(column))), F.lit(-1.0)).alias("average"))


def increment(column: str, by: float) -> Column:
    """value + by, an undefined value counting 0."""
    return F.greatest(F.coalesce(F.col(column), F.lit(0.0)), F.lit(0.0)) + by


def in_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.filter(F.col(column).between(low, high))


def in_region(df: DataFrame, x: str, y: str, region: tuple[float, float, float, float]) -> DataFrame:
    x1, y1, x2, y2 = region
    return df.filter(F.col(x).between(x1, x2) & F.col(y).between(y1, y2))


def sorted_index(df: DataFrame, column: str) -> DataFrame:
    """Rows by value, ties and undefined values by ref."""
    return df.orderBy(F.coalesce(column, F.lit(-1.0)), "ref")


def legacy(df: DataFrame, keep: tuple[str, ...] = ("ref", "layer_key")) -> DataFrame:
    """Undefined values as -1."""
    kinds = dict(df.dtypes)
    return df.select([F.col(c) if c in keep or kinds[c] not in ("double", "float", "int", "bigint") else F.when(F.isnan(c) | F.col(c).isNull(), -1).otherwise(F.col(c)).cast(kinds[c]).alias(c) if kinds[c] in ("double", "float") else F.coalesce(c, F.lit(-1)).cast(kinds[c]).alias(c) for c in df.columns])


class Layers:
    """Names of up to 64 layers, the mask of visible ones, and conditions on layer_key."""

    def __init__(self):
        self.names, self.visible = ["Everything"], 1

    def add(self, name: str) -> int:
        if name in self.names:
            raise ValueError(f"layer {name!r} exists")
        if len(self.names) == MAX_LAYERS:
            raise ValueError("no layer is free")
        self.names.append(name)
        return len(self.names) - 1

    def show(self, name: str, on: bool = True) -> None:
        i = self.names.index(name)
        if i == 0:
            self.visible = 1 if on else 0
        elif on:
            self.visible = self.visible & ~1 | 1 << i
        else:
            self.visible &= ~(1 << i)

    @staticmethod
    def _signed(mask: int) -> int:
        return mask - (1 << 64) if mask >> 63 else mask

    def is_visible(self) -> Column:
        return F.col("layer_key").bitwiseAND(F.lit(self._signed(self.visible)).cast("long")) != 0

    def push_selection(self, df: DataFrame, name: str, selected: Column) -> DataFrame:
        """Selected rows join the layer, others leave it."""
        bit = self._signed(1 << self.names.index(name))
        on, off = F.col("layer_key").bitwiseOR(F.lit(bit).cast("long")), F.col("layer_key").bitwiseAND(F.lit(~bit).cast("long"))
        return df.withColumn("layer_key", F.when(selected, on).otherwise(off))


def import_attributes(df: DataFrame, values: DataFrame) -> DataFrame:
    """Joins numeric columns by Ref; a Ref that the table lacks is an error, a column that it has is replaced."""
    key = next((c for c in values.columns if c.lower() == "ref"), None)
    if key is None:
        raise ValueError("the values have no Ref")
    values = values.withColumnRenamed(key, "ref").withColumn("ref", F.col(key).cast("long"))
    strange = values.join(df.select("ref"), "ref", "left_anti").select("ref").limit(1).collect()
    if strange:
        raise ValueError(f"no row {strange[0]['ref']}")
    fresh = [c for c in values.columns if c != "ref"]
    return df.drop(*fresh).join(values.select("ref", *[F.col(c).cast("double").alias(c) for c in fresh]), "ref", "left")


def colour_ramp(value: Column, low: tuple[int, int, int] = (0, 0, 255), high: tuple[int, int, int] = (255, 0, 0)) -> Column:
    """A linear ramp of colours over a normalised value as #rrggbb; null if undefined."""
    part = lambda a, b: F.lpad(F.lower(F.hex((a + (b - a) * value).cast("int"))), 2, "0")
    return F.when(value >= 0, F.concat(F.lit("#"), *[part(a, b) for a, b in zip(low, high)]))
