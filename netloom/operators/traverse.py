"""Traversals: breadth-first depths and shortest paths, by a frontier of rows or by a kernel per root.

The frontier loop keeps everything in DataFrames: one join a level, its result written to the checkpoint folder, so neither lineage nor memory grows.
The kernel sends the adjacency to every task once, if it has at most KERNEL_EDGES edges (12 bytes each), and solves roots independently; larger graphs
take the frontier loop by themselves.
"""

from __future__ import annotations

import atexit
import heapq
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: The largest adjacency that is sent to tasks: below 100 MB.
KERNEL_EDGES = 8_000_000
#: The largest graph that one task searches by itself: some 30 MB.
TASK_EDGES = 2_000_000
#: The largest graph that one task searches from one origin, edges streamed to it: some 2 GB with one column of edges.
SEARCH_EDGES = 150_000_000
#: Roots that a task of the kernel takes.
ROOTS_A_TASK = 256
#: Roots whose levels are found together, a bit each: four words a node.
ROOTS_AT_ONCE = 256


def _checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where none is set, as in local tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not found:
            found = tempfile.mkdtemp(prefix="netloom-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
        context.setCheckpointDir(found)
    return context._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, kind: str) -> str:
    """A path of its own in the checkpoint folder."""
    return f"{_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def is_small(edges: DataFrame, limit: int = KERNEL_EDGES) -> bool:
    return edges.limit(limit + 1).count() <= limit


def in_one_task(edges: DataFrame, origins: DataFrame, solve: Callable[[Adjacency, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """What `solve` makes of a graph and its origins (numbers of nodes), in one task; the caller has checked the size."""
    return graph_in_one_task(origins, edges, lambda g, refs: solve(g, np.unique(np.searchsorted(g.refs, refs))), schema)


def graph_in_one_task(nodes: DataFrame, edges: DataFrame, solve: Callable[[Adjacency, np.ndarray], pd.DataFrame], schema: str, node_columns: tuple[str, ...] = (), edge_columns: tuple[str, ...] = ()) -> DataFrame:
    """What `solve` makes of a graph and the refs of `nodes`, in one task; columns are sent as doubles. Edges stream in sorted, so the task holds
    4 bytes for each and 8 for each of its columns."""
    double = lambda df, names: [F.col(c).cast("double").alias(c) if c in names else F.lit(None).cast("double").alias(c) for c in (*node_columns, *edge_columns)]
    rows = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), *double(edges, edge_columns))
    rows = rows.union(nodes.select(F.col("ref").cast("long"), F.lit(None).cast("long"), *double(nodes, node_columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, node_values, sources, degrees, targets = [], [], [], [], []
        edge_values: dict[str, list] = {c: [] for c in edge_columns}
        for b in batches:
            column = {k: b.column(k) for k in range(b.num_columns)}
            node = column[1].is_null().to_numpy(zero_copy_only=False)
            src = column[0].to_numpy(zero_copy_only=False)
            if node.any():
                own.append(src[node])
                node_values.append([column[2 + k].filter(pa.array(node)).to_numpy(zero_copy_only=False) for k in range(len(node_columns))])
                keep = pa.array(~node)
                src, column = src[~node], {k: c.filter(keep) for k, c in column.items()}
            if len(src):
                dst = column[1].to_numpy(zero_copy_only=False)
                known, n = np.unique(src, return_counts=True)
                sources.append(known)
                degrees.append(n)
                small = np.abs(dst).max() < 1 << 31
                targets.append(dst.astype(np.int32) if small else dst)
                for k, c in enumerate(edge_columns):
                    edge_values[c].append(column[2 + len(node_columns) + k].to_numpy(zero_copy_only=False))
        none = np.empty(0, np.int64)
        own_refs = np.concatenate([*own, none])
        refs = np.unique(np.concatenate([own_refs, *sources]))
        if len(refs):
            refs = np.unique(np.concatenate([refs, *(t[refs[np.minimum(np.searchsorted(refs, t), len(refs) - 1)] != t] for t in targets)]))
        degree = np.zeros(len(refs) + 1, np.int64)
        for known, n in zip(sources, degrees):
            np.add.at(degree, np.searchsorted(refs, known) + 1, n)
        graph = Adjacency.__new__(Adjacency)
        graph.refs, graph.start = refs, np.cumsum(degree)
        graph.target = _joined(targets, int(graph.start[-1]), np.int32, lambda t: np.searchsorted(refs, t))
        graph.edge = {c: _joined(edge_values[c], int(graph.start[-1]), np.float64, lambda v: v) for c in edge_columns}
        graph.node = {}
        at = np.searchsorted(refs, own_refs)
        for k, c in enumerate(node_columns):
            graph.node[c] = np.zeros(len(refs))
            graph.node[c][at] = np.concatenate([v[k] for v in node_values]) if node_values else none
        yield from pa.Table.from_pandas(solve(graph, np.unique(own_refs)), schema=arrow, preserve_index=False).to_batches(1 << 16)

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return rows.repartition(1).sortWithinPartitions("src", "dst").mapInArrow(run, schema)


def _joined(parts: list[np.ndarray], n: int, kind: type, change: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Parts, changed, in one array; each part goes when it is copied."""
    out, at = np.empty(n, kind), n
    while parts:
        part = parts.pop()
        out[at - len(part) : at] = change(part)
        at -= len(part)
    return out


def tables_in_one_task(nodes: DataFrame, edges: DataFrame, solve: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What `solve` makes of the rows of two tables, in one task; the caller has checked their size."""
    one = lambda df: df.withColumn("_one", F.lit(0)).groupBy("_one")
    return one(nodes).cogroup(one(edges)).applyInPandas(lambda v, e: solve(v.drop(columns="_one"), e.drop(columns="_one")), schema)


def least_costs(steps: DataFrame, roots: DataFrame, limit: float | None = None) -> DataFrame:
    """root, node, cost: least costs by rounds of relaxation for all roots at once, the form for graphs of any size. steps: src, dst, cost (not negative);
    roots: root, node. Each round joins what got cheaper with its steps and is written to the checkpoint folder."""
    best = frontier = checkpointed(roots.select("root", "node", F.lit(0.0).alias("cost")))
    onward = steps.select(F.col("src").alias("node"), F.col("dst").alias("_to"), F.col("cost").alias("_step"))
    while True:
        offers = frontier.join(onward, "node").groupBy("root", F.col("_to").alias("node")).agg(F.min(F.col("cost") + F.col("_step")).alias("cost"))
        if limit is not None:
            offers = offers.filter(F.col("cost") <= limit + 1e-9)
        known = best.select("root", "node", F.col("cost").alias("_known"))
        frontier = checkpointed(offers.join(known, ["root", "node"], "left").filter(F.col("_known").isNull() | (F.col("cost") < F.col("_known") - 1e-9)).drop("_known"))
        if frontier.isEmpty():
            return best
        best = checkpointed(best.join(frontier.select("root", "node"), ["root", "node"], "left_anti").union(frontier))


def multi_source_depth(edges: DataFrame, origins: DataFrame, limit: int | None = None, task_edges: int = SEARCH_EDGES) -> DataFrame:
    """ref, depth: hops from the nearest origin. edges: src, dst; origins: ref. Up to task_edges edges and origins are solved in one task."""
    if edges.limit(task_edges + 1).count() <= task_edges and origins.limit(task_edges + 1).count() <= task_edges:

        def solve(graph: Adjacency, sources: np.ndarray) -> pd.DataFrame:
            depth, _ = graph.depths(sources, limit)
            hit = np.flatnonzero(depth >= 0)
            return pd.DataFrame({"ref": graph.refs[hit], "depth": depth[hit]})

        return in_one_task(edges, origins, solve, "ref long, depth int")
    seen = frontier = checkpointed(origins.select("ref").distinct().withColumn("depth", F.lit(0)))
    level = 0
    while limit is None or level < limit:
        level += 1
        reached = frontier.join(edges, frontier["ref"] == edges["src"]).select(F.col("dst").alias("ref")).distinct()
        frontier = checkpointed(reached.join(seen, "ref", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def all_pairs_frontier(edges: DataFrame, roots: DataFrame, limit: int | None = None) -> DataFrame:
    """root, ref, depth of every pair within reach, by a frontier of rows for all roots at once."""
    seen = frontier = checkpointed(roots.select(F.col("ref").alias("root"), "ref", F.lit(0).alias("depth")))
    level = 0
    while limit is None or level < limit:
        level += 1
        reached = frontier.select("root", F.col("ref").alias("src")).join(edges, "src").select("root", F.col("dst").alias("ref")).distinct()
        frontier = checkpointed(reached.join(seen, ["root", "ref"], "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


class Adjacency:
    """Compressed rows of a graph: of node i (the i-th ref) neighbours target[start[i]:start[i + 1]], each with columns of its edge."""

    def __init__(self, refs: np.ndarray, src: np.ndarray, dst: np.ndarray, **columns: np.ndarray):
        self.refs = refs
        a, b = np.searchsorted(refs, src), np.searchsorted(refs, dst)
        order = np.lexsort((b, a))
        self.target = b[order].astype(np.int32)
        self.start = np.searchsorted(a[order], np.arange(len(refs) + 1))
        self.edge = {k: v[order] for k, v in columns.items()}
        self.node: dict[str, np.ndarray] = {}

    def neighbours(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All neighbours of several nodes, and which node each belongs to."""
        n = self.start[nodes + 1] - self.start[nodes]
        where = np.repeat(self.start[nodes] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return self.target[where], np.repeat(nodes, n)

    def depths(self, root: int | np.ndarray, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Depth of every node (-1: not reached) from a root or the nearest of several, and the smallest node one level up."""
        depth = np.full(len(self.refs), -1, np.int32)
        parent = np.full(len(self.refs), -1, np.int32)
        level, front = 0, np.atleast_1d(root).astype(np.int64)
        depth[front] = 0
        while len(front) and (limit is None or level < limit):
            level += 1
            got, by = self.neighbours(front)
            fresh = depth[got] < 0
            got, by = got[fresh], by[fresh]
            order = np.lexsort((by, got))
            got, first = np.unique(got[order], return_index=True)
            depth[got], parent[got] = level, by[order][first]
            front = got
        return depth, parent


def collect_adjacency(nodes: DataFrame, edges: DataFrame, node_columns: tuple[str, ...] = (), edge_columns: tuple[str, ...] = ()) -> Adjacency:
    """The adjacency of a graph whose size is_small() has checked, on the driver."""
    return adjacency_of(nodes.select("ref", *node_columns).toPandas(), edges.select("src", "dst", *edge_columns).toPandas(), node_columns, edge_columns)


def adjacency_of(v: pd.DataFrame, e: pd.DataFrame, node_columns: tuple[str, ...] = (), edge_columns: tuple[str, ...] = ()) -> Adjacency:
    v = v.sort_values("ref")
    out = Adjacency(v["ref"].to_numpy(), e["src"].to_numpy(), e["dst"].to_numpy(), **{c: e[c].to_numpy() for c in edge_columns})
    out.node = {c: v[c].to_numpy() for c in node_columns}
    return out


def per_root(spark: SparkSession, graph: Adjacency, roots: DataFrame, solve: Callable[[Adjacency, int], pd.DataFrame | None], schema: str) -> DataFrame:
    """What `solve` gives for each root (a node's number), roots dealt over tasks."""
    shared = spark.sparkContext.broadcast(graph)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        for f in frames:
            for root in np.searchsorted(g.refs, f["ref"].to_numpy()).tolist():
                got = solve(g, root)
                if got is not None and len(got):
                    yield got

    tasks = max(1, min(-(-len(graph.refs) // 16), 4 * spark.sparkContext.defaultParallelism, -(-len(graph.refs) // ROOTS_A_TASK) + spark.sparkContext.defaultParallelism))
    return roots.select("ref").repartition(tasks, "ref").mapInPandas(run, schema)


def near_order(graph: Adjacency, size: int = ROOTS_AT_ONCE) -> np.ndarray:
    """The nodes, near ones beside each other: balls of some nodes, so that searches from a ball go the same way."""
    start, target = graph.start.tolist(), graph.target.tolist()
    taken = bytearray(len(graph.refs))
    out: list[int] = []
    for first in range(len(graph.refs)):
        seeds = [first]
        while seeds:
            seed = seeds.pop()
            if taken[seed]:
                continue
            taken[seed] = 1
            ball, k = [seed], 0
            while k < len(ball):
                for v in target[start[ball[k]] : start[ball[k] + 1]]:
                    if not taken[v]:
                        if len(ball) < size:
                            taken[v] = 1
                            ball.append(v)
                        else:
                            seeds.append(v)
                k += 1
            out += ball
    return np.array(out, np.int64)


def level_sums(graph: Adjacency, roots: np.ndarray, limit: int | None, values: np.ndarray) -> np.ndarray:
    """Sums of values (m x nodes) by level, value and root: breadth first from all roots at once, a bit for each root."""
    n, words = len(graph.refs), -(-len(roots) // 64)
    back = getattr(graph, "_back", None)
    if back is None:  # who leads to a node
        order = np.argsort(graph.target, kind="stable")
        by = np.repeat(np.arange(n, dtype=np.int32), np.diff(graph.start))[order]
        back = graph._back = np.searchsorted(graph.target[order], np.arange(n + 1)), by
    into, by = back
    seen, front = np.zeros((n, words), np.uint64), np.zeros((n, words), np.uint64)
    k = np.arange(len(roots))
    np.bitwise_or.at(front, (roots, k // 64), np.left_shift(np.uint64(1), (k % 64).astype(np.uint64)))
    here = np.unique(roots)
    seen[here] = front[here]
    out = [_bit_sums(front[here], values[:, here], len(roots))]
    marked = np.zeros(n, bool)
    while len(here) and (limit is None or len(out) <= limit):
        got, _ = graph.neighbours(here)
        marked[got] = True
        to = np.flatnonzero(marked)
        marked[to] = False
        to = to[~(seen[to] == _FULL).all(axis=1)]
        count = into[to + 1] - into[to]
        first = np.cumsum(count) - count
        where = np.repeat(into[to] - first, count) + np.arange(count.sum())
        new = np.bitwise_or.reduceat(front[by[where]], first, axis=0) & ~seen[to] if len(to) else front[:0]
        front[here] = 0
        fresh = new.any(axis=1)
        here, new = to[fresh], new[fresh]
        if not len(here):
            break
        seen[here] |= new
        front[here] = new
        out.append(_bit_sums(new, values[:, here], len(roots)))
    return np.stack(out)


_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


#: The bits of each byte, the lowest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(float)


def _bit_sums(bits: np.ndarray, values: np.ndarray, roots: int) -> np.ndarray:
    """Sums of values (m x rows) for each bit set in rows of words: first by place and value of a byte, as few bytes have bits."""
    each = np.ascontiguousarray(bits).view(np.uint8)
    wide = each.shape[1]
    flat = np.flatnonzero(each.reshape(-1) != 0)
    row = flat // wide
    key = (flat - row * wide) * 256 + each.reshape(-1)[flat]
    sums = [np.bincount(key, v[row], wide * 256).reshape(wide, 256) @ _BITS for v in values]
    return np.stack([s.reshape(-1)[:roots] for s in sums])


def per_ball(spark: SparkSession, graph: Adjacency, solve: Callable[[Adjacency, np.ndarray], pd.DataFrame], schema: str, order: np.ndarray | None = None, most: int = ROOTS_AT_ONCE) -> DataFrame:
    """What `solve` gives for balls of near roots (numbers of nodes, at most so many), together all nodes, dealt over tasks."""
    shared = spark.sparkContext.broadcast((graph, near_order(graph) if order is None else order))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, order = shared.value
        for f in frames:
            for k in f["id"]:
                yield solve(g, order[k * size : (k + 1) * size])

    # small graphs are dealt to all tasks
    size = max(1, min(most, -(-len(graph.refs) // spark.sparkContext.defaultParallelism)))
    balls = -(-len(graph.refs) // size)
    tasks = max(1, min(balls, 8 * spark.sparkContext.defaultParallelism))
    return spark.range(0, balls, 1, tasks).mapInPandas(run, schema)


def ball_levels(graph: Adjacency, roots: np.ndarray, limit: int | None = None, weight: np.ndarray | None = None) -> pd.DataFrame:
    """root, depth, n, w of several roots."""
    values = np.ones((1, len(graph.refs))) if weight is None else np.stack([np.ones(len(graph.refs)), weight])
    sums = level_sums(graph, roots, limit, values)
    root, depth = np.nonzero(sums[:, 0, :].T)
    return pd.DataFrame({"root": graph.refs[roots[root]], "depth": depth.astype(np.int32), "n": sums[depth, 0, root].astype(np.int64), "w": sums[depth, -1, root] if weight is not None else 0.0})


def dijkstra(graph: Adjacency, sources: dict[int, float], cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least cost of every node from any source (inf: not reached), and the node before it; ties go to the smaller node."""
    dist = np.full(len(graph.refs), np.inf)
    parent = np.full(len(graph.refs), -1, np.int64)
    heap = [(d, s) for s, d in sources.items()]
    heapq.heapify(heap)
    for s, d in sources.items():
        dist[s] = d
    done = np.zeros(len(graph.refs), bool)
    start, target = graph.start, graph.target
    while heap:
        d, u = heapq.heappop(heap)
        if done[u]:
            continue
        done[u] = True
        for k in range(start[u], start[u + 1]):
            v, nd = target[k], d + cost[k]
            if nd < dist[v] - 1e-12 or abs(nd - dist[v]) <= 1e-12 and not done[v] and u < parent[v]:
                dist[v], parent[v] = min(nd, dist[v]), u
                heapq.heappush(heap, (nd, int(v)))
    return dist, parent


def path_to(parent: np.ndarray, source: int, to: int) -> list[int]:
    """Nodes from source to `to`; empty if not reached."""
    out = [to]
    while out[-1] != source:
        if parent[out[-1]] < 0:
            return []
        out.append(int(parent[out[-1]]))
    return out[::-1]


def shortest_path(edges: DataFrame, source: int, to: int, task_edges: int = SEARCH_EDGES) -> DataFrame:
    """ref, depth, order along one shortest path by hops, the smallest ref before each node; in one task, or found by a frontier and walked back level by level."""
    origins = edges.sparkSession.range(1).select(F.lit(source).cast("long").alias("ref"))
    if edges.limit(task_edges + 1).count() <= task_edges:

        def solve(graph: Adjacency, sources: np.ndarray) -> pd.DataFrame:
            depth, before = graph.depths(sources)
            end = int(np.searchsorted(graph.refs, to))
            known = end < len(graph.refs) and graph.refs[end] == to
            path = path_to(before, int(sources[0]), end) if known else []
            return pd.DataFrame({"ref": graph.refs[path], "depth": depth[path], "order": depth[path]}) if path else pd.DataFrame({"ref": np.empty(0, np.int64), "depth": np.empty(0, np.int32), "order": np.empty(0, np.int32)})

        return in_one_task(edges, origins, solve, "ref long, depth int, order int")
    depth = checkpointed(multi_source_depth(edges, origins, task_edges=task_edges))
    found = depth.filter(F.col("ref") == to).first()
    if found is None:
        return depth.limit(0).withColumn("order", F.lit(0))
    path = here = depth.filter(F.col("ref") == to)
    for level in range(found["depth"] - 1, -1, -1):
        back = here.join(edges, here["ref"] == edges["dst"]).select(F.col("src").alias("ref"))
        here = checkpointed(back.join(depth.filter(F.col("depth") == level), "ref").orderBy("ref").limit(1).select("ref", "depth"))
        path = path.union(here)
    return path.withColumn("order", F.col("depth"))


def level_counts(pairs: DataFrame) -> DataFrame:
    """root, depth, n: how many nodes lie at each depth."""
    return pairs.groupBy("root", "depth").agg(F.count("*").alias("n"))


def first_per(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_k = 1").drop("_k")
