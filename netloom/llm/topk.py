"""Exact top-k search: tiled matrix products of queries and shards, a partial selection per tile, a merge per query.

Queries and candidates are dealt to tiles of bounded size; each pair of a query tile and a shard is one group whose product is
one matrix multiplication in double precision, exact for integers below 2**53. A tile keeps k rows per query; Spark's group
limit on the rank window merges these in two levels, in each task and then per query.

Vectors that are null, or hold null or non-finite components, take no part; an empty vector scores 0. If lengths differ, the
shorter vector counts as padded with zeros. Ties go to the smaller id; rows that repeat an id are queries and candidates of their own: each
such query has its own list of k. A query's own id is no candidate of it, in whatever row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm._spark import cut

#: Rows of a query tile and of a shard.
QUERY_TILE, SHARD = 4096, 16384


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector (array<double>) of the rows whose components are all there and finite."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.filter(F.col(vector_col).isNotNull() & fine).select(F.col(id_col).alias("id"), v.alias("v"))


def _matrix(values: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(values), width))
    for i, x in enumerate(values):
        out[i, : len(x)] = x
    return out


def top_k(queries: DataFrame, candidates: DataFrame, k: int, query_tile: int = QUERY_TILE, shard: int = SHARD) -> DataFrame:
    """query_id, rank from 1, id, score: the k best inner products of each query. Both tables have columns id and v."""
    # equal queries are searched once; a number stands for id and vector
    kinds = cut(queries.groupBy("id", "v").agg(F.count("*").alias("times")).withColumn("query", F.monotonically_increasing_id()), "queries")
    n_q, n_c = kinds.count(), candidates.count()
    tiles, shards = max(1, math.ceil(n_q / query_tile)), max(1, math.ceil(n_c / shard))
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q = kinds.select("query", "id", "v", spread("query", tiles).alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    c = candidates.select("id", "v", spread("id", shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))

    def product(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": np.empty(0, np.int64), "id": np.empty(0, np.int64), "score": np.empty(0)})
        right = right.sort_values("id", kind="stable")
        ids, own, number = right["id"].to_numpy(), left["id"].to_numpy(), left["query"].to_numpy()
        width = max(int(left["v"].map(len).max()), int(right["v"].map(len).max()), 1)
        b = _matrix(right["v"], width)
        out = []
        for at in range(0, len(left), 512):
            mine = own[at : at + 512]
            s = _matrix(left["v"].iloc[at : at + 512], width) @ b.T
            s[mine[:, None] == ids[None, :]] = -np.inf
            m = min(k, s.shape[1])
            least = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
            row, col = np.nonzero((s >= least[:, None]) & (s > -np.inf))
            value = s[row, col]
            order = np.lexsort((ids[col], -value, row))
            row, col, value = row[order], col[order], value[order]
            first = np.searchsorted(row, row, "left")
            keep = np.arange(len(row)) - first < k
            out.append(pd.DataFrame({"query": number[at : at + 512][row[keep]], "id": ids[col[keep]], "score": value[keep]}))
        return pd.concat(out)

    best = q.groupBy("tile", "shard").cogroup(c.groupBy("tile", "shard")).applyInPandas(product, "query bigint, id bigint, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    named = kinds.select("query", F.col("id").alias("query_id"), F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("_"))
    return best.join(named, "query").select("query_id", "rank", "id", "score")


def query(embeddings: DataFrame) -> DataFrame:
    """op8: vectors as floor(256 * x), queries whose vec_id is divisible by 50, 5 best each."""
    base = valid_vectors(embeddings, "vec_id", "embedding").withColumn("v", F.transform("v", lambda x: F.floor(256 * x).cast("double")))
    found = top_k(base.filter(F.col("id") % 50 == 0), base, 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("score").cast("long").alias("score"))


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY s.r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
