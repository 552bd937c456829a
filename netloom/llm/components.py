"""Connected components of a graph too large for one machine: alternating large-star and small-star rounds on a table of edges.

Each task first contracts what edges it holds to a forest. If what is left has at most CHUNK edges, one task finishes it; else every round writes its edges to the shared folder; the rounds end when a round
changes nothing. The smallest id of a component is its label. Nulls in an edge and loops are ignored; repeated edges count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm._spark import cut, discard

#: Edges that a task contracts at once.
CHUNK = 1 << 20


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n-1 joined by edges a-b: the smallest node of each one's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(nxt := label[label], label):
            label = nxt
        if np.array_equal(label, before):
            return label


def _forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def contracted(held: list[pd.DataFrame]) -> pd.DataFrame:
        edges = pd.concat(held)
        nodes, flat = np.unique(edges[["a", "b"]].to_numpy().ravel(), return_inverse=True)
        flat = flat.reshape(-1, 2)
        label = roots(len(nodes), flat[:, 0], flat[:, 1])
        more = label != np.arange(len(nodes))
        return pd.DataFrame({"a": nodes[label[more]], "b": nodes[more]})

    held, n = [], 0
    for f in frames:
        held.append(f)
        n += len(f)
        if n >= CHUNK:
            yield contracted(held)
            held, n = [], 0
    if held:
        yield contracted(held)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and component of each node that has an edge. The result is a written table."""
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b")
    e = cut(e.mapInPandas(_forest, "a bigint, b bigint").distinct(), "edges")
    seen = None
    if e.count() <= CHUNK:  # bounded, so one task holds it
        done = cut(e.coalesce(1).mapInPandas(_forest, "a bigint, b bigint"), "edges")
        discard(e)
        return _labelled(done)
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()
        # small star: of each node and its smaller neighbours, all join the smallest
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).filter("a <> b").distinct()
        nxt = cut(small, "edges")
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_if(F.col("a") > F.col("b"))).first()
        discard(e)
        e = nxt
        if state == seen:
            break
        seen = state
    return _labelled(e)


def _labelled(e: DataFrame) -> DataFrame:
    return e.select(F.col("b").alias("id"), F.col("a").alias("component")).union(e.select("a", "a").distinct())
