"""Analyses of the visibility graph: visual (hops), metric, angular; local and global; depth maps and shortest paths; isovists."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import measures as M
from netloom.operators import lattice as L
from netloom.operators import traverse as V


def visual_local(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """ref, clustering, control, controllability; -1 for cells that see one other or none."""
    e = edges.select("src", "dst")
    degree = e.groupBy("src").agg(F.count("*").alias("k"))
    second = e.select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid")
    union = second.groupBy("src").agg(F.countDistinct("dst").alias("reach"))
    closed = second.join(e, ["src", "dst"], "left_semi").groupBy("src").agg(F.count("*").alias("triangles"))
    control = e.join(degree.select(F.col("src").alias("dst"), "k"), "dst").groupBy("src").agg(F.sum(1 / F.col("k")).alias("control"))
    got = degree.join(control, "src").join(union, "src").join(closed, "src", "left").filter("k > 1")
    got = got.select(F.col("src").alias("ref"), F.try_divide(F.coalesce("triangles", F.lit(0)), F.col("k") * (F.col("k") - 1)).alias("clustering"), "control", (F.col("k") / F.col("reach")).alias("controllability"))
    return _with_undefined(cells, got)


def _with_undefined(cells: DataFrame, got: DataFrame) -> DataFrame:
    filled = cells.filter("filled").select("ref").join(got, "ref", "left")
    return filled.select("ref", *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("clustering", "control", "controllability")])


def _local_of(g: V.Adjacency, own: np.ndarray) -> pd.DataFrame:
    k = np.diff(g.start)
    mid, src = g.neighbours(own)
    at = np.full(len(k), -1, np.int64)
    at[own] = np.arange(len(own))
    control = np.bincount(at[src], 1 / k[mid], len(own))
    sees, reached = (np.zeros(len(own) * len(k), bool) for _ in range(2))
    sees[at[src] * len(k) + mid] = True
    n = k[mid]
    where = np.repeat(g.start[mid] - np.cumsum(n) + n, n) + np.arange(n.sum())
    pair = np.repeat(at[src], n) * len(k) + g.target[where]  # by two steps
    reached[pair] = True
    triangles = np.bincount(pair[sees[pair]] // len(k), minlength=len(own))
    reach = reached.reshape(len(own), -1).sum(axis=1)
    more = k[own] > 1
    k = k[own][more]
    return pd.DataFrame({"ref": g.refs[own][more], "clustering": triangles[more] / (k * (k - 1)), "control": control[more], "controllability": k / reach[more]})


def near_local(cells: DataFrame, walls: DataFrame, reach: float) -> DataFrame:
    """visual_local() of sight within a reach, tile by tile, so that no edge and no pair of edges is shuffled."""
    c = cells.filter("filled").select("ref", "x", "y")
    return _with_undefined(cells, L.near_graphs(c, walls, reach, 2, _local_of, "ref long, clustering double, control double, controllability double"))


def near_global(cells: DataFrame, walls: DataFrame, reach: float, radius: int) -> DataFrame:
    """visual_global() of sight within a reach, up to some hops, tile by tile, so that no edge and no pair of cells is shuffled."""
    c = cells.filter("filled").select("ref", "x", "y")

    def solve(g: V.Adjacency, own: np.ndarray) -> pd.DataFrame:
        return pd.concat([V.ball_levels(g, own[k : k + V.ROOTS_AT_ONCE], radius)[["root", "depth", "n"]] for k in range(0, len(own), V.ROOTS_AT_ONCE)])

    placed = L.near_graphs(c, walls, reach, radius, solve, "root long, depth int, n long")
    nowhere = c.filter("x is null or y is null").select(F.col("ref").cast("long").alias("root"), F.lit(0).alias("depth"), F.lit(1).cast("long").alias("n"))
    return _global_measures(placed.union(nowhere))


def _linked_levels(g: V.Adjacency, root: int, twin: np.ndarray, limit: int | None) -> pd.DataFrame:
    depth = np.full(len(g.refs), -1, np.int32)  # -2: led on from with its twin, which counts for both
    depth[root], level, front = 0, 0, np.array([root])
    while len(front) and (limit is None or level < limit):
        double = (twin[front] >= 0) & (twin[front] < front) & np.isin(twin[front], front)
        depth[front[double]] = -2
        front = front[~double]
        other = twin[front][twin[front] >= 0]
        depth[other] = -2
        level += 1
        got, _ = g.neighbours(np.concatenate([front, other]))
        front = np.unique(got[depth[got] == -1])
        depth[front] = level
    n = np.bincount(depth[depth >= 0])
    return pd.DataFrame({"root": g.refs[root], "depth": np.arange(len(n)), "n": n})


def _linked_graph(cells: DataFrame, e: DataFrame, links: DataFrame) -> tuple[V.Adjacency, np.ndarray]:
    """The graph, and for each node the one that a link joins it to, or -1."""
    graph = V.collect_adjacency(cells.select("ref"), e)
    twin = np.full(len(graph.refs), -1, np.int64)
    # links end at cells, at most one a cell, so there are no more of them than cells
    ends = links.join(cells.select(F.col("ref").alias("a")), "a", "left_semi").join(cells.select(F.col("ref").alias("b")), "b", "left_semi").toPandas()
    a, b = np.searchsorted(graph.refs, ends["a"]), np.searchsorted(graph.refs, ends["b"])
    twin[a], twin[b] = b, a
    return graph, twin


def linked_levels(cells: DataFrame, edges: DataFrame, links: DataFrame, limit: int | None = None, small: bool | None = None) -> DataFrame:
    """root, depth, n: cells (ref) at each depth (up to a limit) from each cell, where links (a, b) join two cells into one place: the one reached first
    counts and leads on from both, the other doesn't count. At the limit nothing leads on, so both of a link's cells count if both are reached there only.

    small: whether the graph goes to every task; by its size if not given.
    """
    e, links = edges.select("src", "dst"), links.select("a", "b")
    if limit is None and (V.is_small(e) and V.is_small(cells) if small is None else small):
        # without a limit the cells of a place are one node
        graph, twin = _linked_graph(cells, e, links)
        place = np.arange(len(graph.refs))
        linked = np.flatnonzero(twin >= 0)
        place[linked] = np.minimum(linked, twin[linked])
        kept, at = np.unique(place, return_inverse=True)
        src, dst = np.repeat(at, np.diff(graph.start)), at[graph.target]
        pairs = np.unique((src * len(kept) + dst)[src != dst])
        joined = V.Adjacency(np.arange(len(kept)), pairs // max(1, len(kept)), pairs % max(1, len(kept)))
        own = np.full((len(kept), 2), -1, np.int64)  # the refs of each place
        own[:, 0] = graph.refs[kept]
        second = np.flatnonzero(place != np.arange(len(place)))
        own[at[second], 1] = graph.refs[second]

        def solve(g: V.Adjacency, roots: np.ndarray) -> pd.DataFrame:
            got = V.ball_levels(g, roots)[["root", "depth", "n"]]
            other = own[got["root"], 1]
            return pd.concat([got.assign(root=own[got["root"], 0]), got.assign(root=other)[other >= 0]])

        return V.per_ball(cells.sparkSession, joined, solve, "root long, depth int, n long")
    if V.is_small(e) and V.is_small(cells) if small is None else small:
        graph, twin = _linked_graph(cells, e, links)
        return V.per_root(cells.sparkSession, graph, cells, lambda g, r: _linked_levels(g, r, twin, limit), "root long, depth int, n long")
    place = V.checkpointed(cells.select("ref").join(links.select(F.col("b").alias("ref"), "a"), "ref", "left").select("ref", F.coalesce("a", "ref").alias("place")))
    at = lambda name, column: place.select(F.col("ref").alias(name), F.col("place").alias(column))
    from_place = e.join(at("src", "_from"), "src").select(F.col("_from").alias("src"), "dst")
    joined = V.checkpointed(from_place.join(at("dst", "_to"), "dst").select("src", F.col("_to").alias("dst")).filter("src <> dst").distinct())
    roots = place.select(F.col("place").alias("ref")).distinct()
    if limit is None:
        counts = V.level_counts(V.all_pairs_frontier(joined, roots))
    else:
        near = V.checkpointed(V.all_pairs_frontier(joined, roots, limit - 1))
        rim = near.filter(F.col("depth") == limit - 1).select("root", F.col("ref").alias("src")).join(from_place.distinct(), "src").select("root", "dst").distinct()
        rim = rim.join(at("dst", "ref"), "dst").join(near, ["root", "ref"], "left_anti").select("root", F.col("dst").alias("ref"), F.lit(limit).alias("depth"))
        counts = V.level_counts(near.unionByName(rim))
    return counts.join(at("_root", "root"), "root").select(F.col("_root").alias("root"), "depth", "n")


def visual_global(cells: DataFrame, edges: DataFrame, radius: int | None = None, links: DataFrame | None = None) -> DataFrame:
    """Node count, mean depth, integration and entropy of each filled cell; links (a, b, as merge() makes them) join two cells into one place (linked_levels)."""
    from netloom.operators.axial import levels

    c = cells.filter("filled").select("ref")
    return _global_measures(levels(c, edges.select("src", "dst"), limit=radius) if links is None else linked_levels(c, edges, links, radius))


def _global_measures(within: DataFrame) -> DataFrame:
    """The measures of visual_global() from root, depth, n."""
    deep = F.col("depth") > 0
    base = within.groupBy("root").agg(F.sum("n").alias("n"), F.sum(F.col("depth") * F.col("n")).alias("t"), F.collect_list(F.when(deep, F.struct("depth", F.col("n").alias("c")))).alias("levels"))
    n, t = F.col("n"), F.col("t")
    mean = F.try_divide(t, n - 1)
    fine, more = (n > 2) & (mean > 1), n > 1
    ra = F.try_divide(2 * (mean - 1), n - 2)
    p = lambda x: F.try_divide(x["c"], n - 1)
    und = M.or_undefined
    return base.select(
        F.col("root").alias("ref"),
        n.alias("node_count"),
        und(more, mean).alias("mean_depth"),
        und(fine, F.try_divide(M.d_value(n), ra)).alias("integration_hh"),
        und(fine, F.try_divide(M.p_value(n), ra)).alias("integration_p"),
        und(fine, M.tekl(n, t)).alias("integration_tekl"),
        und(more, F.aggregate("levels", F.lit(0.0), lambda acc, x: acc - p(x) * F.log2(p(x)))).alias("entropy"),
        und(more, F.aggregate("levels", F.lit(0.0), lambda acc, x: acc + p(x) * (F.log2(p(x)) - M.log2_poisson(mean, x["depth"], x["depth"] + 1)))).alias("relativised_entropy"),
    )


def visual_step_depth(cells: DataFrame, edges: DataFrame, origins: DataFrame, unreached: int = 0) -> DataFrame:
    """ref, step_depth from the origins; unreached cells have 0 unless another value is asked for."""
    return _step_depths(cells, V.multi_source_depth(edges.select("src", "dst"), origins), unreached)


def unlimited_step_depth(cells: DataFrame, walls: DataFrame, origins: DataFrame, unreached: int = 0) -> DataFrame:
    """visual_step_depth() of sight at any distance, without its edges."""
    return _step_depths(cells, L.sight_depths(cells, walls, origins), unreached)


def _step_depths(cells: DataFrame, depth: DataFrame, unreached: int) -> DataFrame:
    return cells.filter("filled").select("ref").join(depth, "ref", "left").select("ref", F.coalesce("depth", F.lit(unreached)).alias("step_depth"))


def metric_graph(cells: DataFrame, edges: DataFrame, corner: DataFrame) -> V.Adjacency:
    """The visibility graph with distances and coordinates; corner (ref, blocked_adjacent) tells which cells paths may turn at."""
    return V.collect_adjacency(*_metric_tables(cells, edges, corner, V.KERNEL_EDGES), ("x", "y", "turn"), ("dist",))


def _metric_tables(cells: DataFrame, edges: DataFrame, corner: DataFrame, limit: int = V.SEARCH_EDGES) -> tuple[DataFrame, DataFrame]:
    if not V.is_small(edges, limit):
        raise ValueError("the visibility graph doesn't fit the kernel")
    nodes = cells.filter("filled").join(corner, "ref", "left").select("ref", "x", "y", F.coalesce("blocked_adjacent", F.lit(False)).alias("turn"))
    return nodes, edges.select("src", "dst", "dist")


def metric_search(g: V.Adjacency, sources: list[int], spacing: float = 1.0, angular: bool = False, link_cost: dict[tuple[int, int], float] | None = None, limit: float = math.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cost, turn (in right angles) and node before of each node on its best path. Paths turn only at cells beside a blocked one.

    The cost is the length, or with angular the turn, ties going to the shorter path. link_cost: extra edges and what they cost.
    The search ends beyond the limit; costs above it aren't final.
    """
    import heapq

    n = len(g.refs)
    # plain lists, which a loop reads faster than arrays
    x, y, turn_here = g.node["x"].astype(float).tolist(), g.node["y"].astype(float).tolist(), g.node["turn"].tolist()
    best, angle, before = [math.inf] * n, [math.inf] * n, [-1] * n
    done = bytearray(n)
    extra: dict[int, list[tuple[int, float]]] = {}
    for (a, b), c in (link_cost or {}).items():
        extra.setdefault(a, []).append((b, c))
        extra.setdefault(b, []).append((a, c))
    heap = []
    for s in sources:
        best[s] = angle[s] = 0.0
        heap.append((0.0, 0.0, s))
    heapq.heapify(heap)
    start = set(sources)
    while heap:
        d, tie, u = heapq.heappop(heap)
        if d > limit:
            break
        if done[u]:
            continue
        done[u] = True
        steps = [(v, c, True) for v, c in extra.get(u, ())]
        if u in start or turn_here[u]:
            lo, hi = g.start[u], g.start[u + 1]
            steps += [(v, w, False) for v, w in zip(g.target[lo:hi].tolist(), g.edge["dist"][lo:hi].tolist())]
        p = before[u]
        for v, w, jump in steps:
            if done[v]:
                continue
            t = 0.0
            if p >= 0 and not jump:
                ax, ay, bx, by = x[u] - x[p], y[u] - y[p], x[v] - x[u], y[v] - y[u]
                norm = math.hypot(ax, ay) * math.hypot(bx, by)
                t = math.acos(max(-1.0, min(1.0, (ax * bx + ay * by) / norm))) / (math.pi / 2) if norm else 0.0
            a = angle[u] + t
            if angular:
                key, second = a, tie + w
            else:
                key, second = d + w * (1.0 if jump else spacing), a
            if key < best[v] - 1e-12:
                best[v], angle[v], before[v] = key, a, u
                heapq.heappush(heap, (key, second, v))
    return np.array(best), np.array(angle), np.array(before, np.int64)


def metric(cells: DataFrame, edges: DataFrame, corner: DataFrame, radius: float | None = None, spacing: float = 1.0) -> DataFrame:
    """ref, mean_angle, mean_distance, mean_straight, node_count over cells within a path length; means count the cell itself."""
    g = metric_graph(cells, edges, corner)

    def solve(g: V.Adjacency, r: int) -> pd.DataFrame:
        limit = radius if radius is not None else np.inf
        dist, angle, _ = metric_search(g, [r], spacing, limit=limit)
        hit = np.isfinite(dist) & (dist <= limit)
        straight = np.hypot(g.node["x"][hit] - g.node["x"][r], g.node["y"][hit] - g.node["y"][r]) * spacing
        n = int(hit.sum())
        return pd.DataFrame({"ref": [g.refs[r]], "mean_angle": [angle[hit].sum() / n], "mean_distance": [dist[hit].sum() / n], "mean_straight": [straight.sum() / n], "node_count": [n]})

    return V.per_root(cells.sparkSession, g, cells.filter("filled"), solve, "ref long, mean_angle double, mean_distance double, mean_straight double, node_count long")


def angular(cells: DataFrame, edges: DataFrame, corner: DataFrame, radius: float | None = None) -> DataFrame:
    """ref, mean_depth, total_depth, node_count over cells within a turn; the mean counts the cell itself."""
    g = metric_graph(cells, edges, corner)

    def solve(g: V.Adjacency, r: int) -> pd.DataFrame:
        limit = radius if radius is not None else np.inf
        cost, _, _ = metric_search(g, [r], angular=True, limit=limit)
        hit = np.isfinite(cost) & (cost <= limit)
        n = int(hit.sum())
        return pd.DataFrame({"ref": [g.refs[r]], "mean_depth": [cost[hit].sum() / n], "total_depth": [cost[hit].sum()], "node_count": [n]})

    return V.per_root(cells.sparkSession, g, cells.filter("filled"), solve, "ref long, mean_depth double, total_depth double, node_count long")


def depth_map(cells: DataFrame, edges: DataFrame, corner: DataFrame, origins: list[int], kind: str = "metric", spacing: float = 1.0, links: dict[tuple[int, int], float] | None = None) -> DataFrame:
    """ref, depth, angle, straight from the origins: one search, in one task. Unreached cells have 0; straight only for one origin."""

    def solve(g: V.Adjacency, refs: np.ndarray) -> pd.DataFrame:
        at = np.searchsorted(g.refs, origins).tolist()
        place = lambda r: int(np.searchsorted(g.refs, r))
        cost, angle, _ = metric_search(g, at, spacing, kind == "angular", {(place(a), place(b)): c for (a, b), c in (links or {}).items()})
        hit = np.isfinite(cost)
        straight = np.hypot(g.node["x"] - g.node["x"][at[0]], g.node["y"] - g.node["y"][at[0]]) * spacing if len(at) == 1 else np.full(len(cost), -1.0)
        return pd.DataFrame({"ref": g.refs, "depth": np.where(hit, cost, 0.0), "angle": np.where(hit, angle, 0.0), "straight": straight})

    return V.graph_in_one_task(*_metric_tables(cells, edges, corner), solve, "ref long, depth double, angle double, straight double", ("x", "y", "turn"), ("dist",))


def shortest_path(cells: DataFrame, edges: DataFrame, corner: DataFrame | None, source: int, targets: list[int], kind: str = "metric", links: dict[tuple[int, int], float] | None = None) -> DataFrame:
    """target, ref, order, linked of the cells along the best path from source to each target: order 0 at the target, then 2, 3, ... towards the source;
    linked is 1 at both ends of a link that the path takes. links (not for visual paths): pairs of cells and what the step between them costs.

    Visual paths go by hops in a graph of any size, the smallest ref before each cell; the others are found in one task.
    """
    if kind == "visual":
        found = []
        for t in targets:
            path = V.shortest_path(edges.select("src", "dst"), source, t)
            last = Window.partitionBy(F.lit(t))
            back = F.max("order").over(last) - F.col("order")  # a path's rows
            found.append(path.select(F.lit(t).cast("long").alias("target"), "ref", F.when(back == 0, 0).otherwise(back + 1).cast("int").alias("order"), F.lit(0).alias("linked")))
        return reduce(DataFrame.union, found)

    def solve(g: V.Adjacency, refs: np.ndarray) -> pd.DataFrame:
        place = lambda r: int(np.searchsorted(g.refs, r))
        costs = {(place(a), place(b)): c for (a, b), c in (links or {}).items()}
        _, _, before = metric_search(g, [place(source)], angular=kind == "angular", link_cost=costs)
        sees = lambda a, b: b in g.target[g.start[a] : g.start[a + 1]]
        rows = []
        for t in targets:
            path = V.path_to(before, place(source), place(t))
            jumps = {(a, b) for a, b in zip(path, path[1:]) if ((a, b) in costs or (b, a) in costs) and not sees(a, b)}
            ends = {x for pair in jumps for x in pair}
            rows += [(int(t), int(g.refs[n]), 0 if k == 0 else k + 1, int(n in ends)) for k, n in enumerate(reversed(path))]
        return pd.DataFrame(rows, columns=["target", "ref", "order", "linked"])

    return V.graph_in_one_task(*_metric_tables(cells, edges, corner), solve, "target long, ref long, order int, linked int", ("x", "y", "turn"), ("dist",))


def path_zones(cells: DataFrame, edges: DataFrame, path: DataFrame) -> DataFrame:
    """ref, visual_zone, metric_zone, inverse_zone: what a path (ref) sees, the least distance to it, and 1 / (distance + 1)."""
    seen = edges.join(path.select(F.col("ref").alias("src")).distinct(), "src", "left_semi").select(F.col("dst").alias("ref"), "dist").union(path.select("ref", F.lit(0.0)))
    near = seen.groupBy("ref").agg(F.min("dist").alias("d"))
    return cells.filter("filled").select("ref").join(near, "ref", "left").select("ref", F.col("d").isNotNull().cast("int").alias("visual_zone"), F.coalesce("d", F.lit(-1.0)).alias("metric_zone"), F.coalesce(1 / (F.col("d") + 1), F.lit(-1.0)).alias("inverse_zone"))


#: Pairs of a wall and a ray that are tested at once.
TESTS_AT_ONCE = 1 << 20


def _first_walls(a: np.ndarray, b: np.ndarray, start: float, rel: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which wall (ends a, b) each ray from the origin meets first, and how far away (inf: none). Rays have directions d at angles rel, sorted, from start.

    The nearest walls go first, each meets the rays within its angle, and rays that end before the walls left are done.
    """
    w = b - a
    length, across = np.hypot(w[:, 0], w[:, 1]), a[:, 0] * w[:, 1] - a[:, 1] * w[:, 0]
    along = np.clip(np.divide(-(a * w).sum(axis=1), length * length, out=np.zeros(len(a)), where=length > 0), 0, 1)
    away = np.hypot(*(a + w * along[:, None]).T)
    around = 2 * math.pi
    slack = 1e-9 + 2e-9 * length / np.maximum(away, 1e-6)
    angle = np.arctan2(a[:, 1], a[:, 0])
    turn = np.mod(np.arctan2(b[:, 1], b[:, 0]) - angle + math.pi, around) - math.pi
    lo = np.mod(np.where(turn >= 0, angle, angle + turn) - slack - start, around)
    hi = lo + np.abs(turn) + 2 * slack
    on = away < 1e-6  # the origin lies on the wall
    lo, hi = np.where(on, 0.0, lo), np.where(on, around, hi)
    order = np.argsort(away, kind="stable")
    dist, hit = np.full(len(rel), np.inf), np.zeros(len(rel), np.int64)
    left = np.arange(len(rel))
    at, size = 0, 64
    while at < len(order):
        left = left[dist[left] >= away[order[at]] * (1 - 1e-9) - 1e-9]
        if not len(left):
            break
        walls = order[at : at + size]
        round_ = walls[hi[walls] > around]  # an interval over the end of the circle is two
        angles = rel[left]
        walls, low, high = np.concatenate([walls, round_]), np.concatenate([lo[walls], np.zeros(len(round_))]), np.concatenate([hi[walls], hi[round_] - around])
        first = np.searchsorted(angles, low, "left")
        count = np.searchsorted(angles, high, "right") - first
        upto, k = np.cumsum(count), 0
        while k < len(walls):
            end = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + TESTS_AT_ONCE, "right")))
            n = count[k:end]
            p = np.repeat(walls[k:end], n)
            q = left[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[k:end], n)]
            det = d[q, 0] * w[p, 1] - d[q, 1] * w[p, 0]
            with np.errstate(divide="ignore", invalid="ignore"):
                t, s = across[p] / det, (a[p, 0] * d[q, 1] - a[p, 1] * d[q, 0]) / det
            ok = (np.abs(det) > 1e-15) & (t > 1e-12) & (s >= -1e-9) & (s <= 1 + 1e-9)
            p, q, t = p[ok], q[ok], t[ok]
            was = dist.copy()
            np.minimum.at(dist, q, t)
            best = t == dist[q]
            p, q = p[best], q[best]
            hit[q[dist[q] < was[q]]] = len(a)
            np.minimum.at(hit, q, p)  # of equally near walls the first
            k = end
        at, size = at + size, 2 * size
    return hit, dist


def isovist_polygon(px: float, py: float, walls: np.ndarray, start: float = 0.0, width: float = 2 * math.pi) -> tuple[np.ndarray, float]:
    """Corners of what is seen from a point among walls (n x 4), and the length of its edges that lie on no wall. Rays go to each wall's ends
    and just past them, in order of angle from `start` over `width`."""
    a, b = walls[:, :2] - (px, py), walls[:, 2:] - (px, py)
    full = width >= 2 * math.pi - 1e-9
    ends = np.concatenate([a, b])
    angles = np.arctan2(ends[:, 1], ends[:, 0])
    eps = 1e-7
    rays = np.unique(np.concatenate([angles - eps, angles + eps] + ([] if full else [np.array([start, start + width])])))
    rel = np.mod(rays - start, 2 * math.pi)
    keep = np.ones(len(rel), bool) if full else (rel <= width + 1e-12) | (rel >= 2 * math.pi - 1e-12)
    rel = np.sort(np.where(rel >= 2 * math.pi - 1e-12, 0.0, rel)[keep])
    theta = start + rel
    d = np.stack([np.cos(theta), np.sin(theta)], axis=1)
    hit, dist = _first_walls(a, b, start, rel, d)
    seen = np.isfinite(dist)
    hit, dist, d = hit[seen], dist[seen], d[seen]
    corners = d * dist[:, None]
    if not full:
        corners = np.concatenate([np.zeros((1, 2)), corners])
        hit = np.concatenate([[-1], hit])
    nxt, nxt_hit = np.roll(corners, -1, axis=0), np.roll(hit, -1)
    gaps = np.hypot(*(nxt - corners).T)
    open_edge = (hit != nxt_hit) & (gaps > 1e-5) & (hit >= 0) & (nxt_hit >= 0)
    return corners + (px, py), float(gaps[open_edge].sum())


def isovist_measures(px: float, py: float, corners: np.ndarray, occluded: float) -> dict[str, float]:
    p = corners - (px, py)
    q = np.roll(p, -1, axis=0)
    cross = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
    area = abs(cross.sum()) / 2
    edge = q - p
    length = np.hypot(edge[:, 0], edge[:, 1])
    around = length.sum()
    c = ((p + q) * cross[:, None]).sum(axis=0) / (3 * cross.sum()) if area else np.zeros(2)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.clip(np.where(length > 0, -(p * edge).sum(axis=1) / (length * length), 0), 0, 1)
    least = np.hypot(*(p + edge * t[:, None]).T).min()
    return {
        "area": area,
        "compactness": 4 * math.pi * area / around**2 if around else -1.0,
        "drift_angle": math.degrees(math.atan2(c[1], c[0])) % 360,
        "drift_magnitude": float(np.hypot(*c)),
        "min_radial": float(least),
        "max_radial": float(np.hypot(p[:, 0], p[:, 1]).max()),
        "occlusivity": occluded,
        "perimeter": float(around),
    }


def occluded_edges(px: float, py: float, walls: np.ndarray) -> list[tuple[int, float]]:
    """(bin, length) of the isovist's edges that lie on no wall and are longer than 1.5: what is hidden behind a corner lies in that direction."""
    corners, _ = isovist_polygon(px, py, walls)
    p = corners - (px, py)
    q = np.roll(p, -1, axis=0)
    a, b = np.hypot(p[:, 0], p[:, 1]), np.hypot(q[:, 0], q[:, 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        radial = np.abs(p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0]) / (a * b) < 1e-5
    out = []
    for k in np.flatnonzero(radial & (np.abs(a - b) > 1.5)).tolist():
        angle = math.atan2(p[k, 1], p[k, 0])
        out.append((int(round(angle / (2 * math.pi) * 32)) % 32, float(abs(a[k] - b[k]))))
    return out


def _dealt(points: DataFrame) -> DataFrame:
    """Points over tasks: few files hold many."""
    return points.repartition(max(1, math.ceil(points.count() / V.ROOTS_A_TASK)), "ref")


def occlusions(points: DataFrame, walls: DataFrame) -> DataFrame:
    """ref, bin, occ_distance: the longest hidden edge in each angular bin of points (ref, x, y)."""
    if not V.is_small(walls):
        raise ValueError("too many walls to send to every task")
    shared = points.sparkSession.sparkContext.broadcast(walls.select("x1", "y1", "x2", "y2").toPandas().to_numpy(float))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(r.ref, b, d) for r in f.itertuples() for b, d in occluded_edges(r.x, r.y, shared.value)]
            if rows:
                yield pd.DataFrame(rows, columns=["ref", "bin", "occ_distance"])

    got = _dealt(points).select("ref", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).mapInPandas(run, "ref long, bin int, occ_distance double")
    return got.groupBy("ref", "bin").agg(F.max("occ_distance").alias("occ_distance"))


ISOVIST = "ref long, area double, compactness double, drift_angle double, drift_magnitude double, min_radial double, max_radial double, occlusivity double, perimeter double"


def isovists(points: DataFrame, walls: DataFrame) -> DataFrame:
    """The isovist measures of points (ref, x, y and optionally angle, view_angle in degrees) among walls (x1, y1, x2, y2) that enclose them.

    Walls go to every task, so their number is checked.
    """
    if not V.is_small(walls):
        raise ValueError("too many walls to send to every task")
    shared = points.sparkSession.sparkContext.broadcast(walls.select("x1", "y1", "x2", "y2").toPandas().to_numpy(float))
    partial = {"angle", "view_angle"} <= set(points.columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples():
                start, width = (math.radians(r.angle - r.view_angle / 2), math.radians(r.view_angle)) if partial else (0.0, 2 * math.pi)
                corners, occluded = isovist_polygon(r.x, r.y, shared.value, start, width)
                if len(corners) > 2:
                    rows.append({"ref": r.ref} | isovist_measures(r.x, r.y, corners, occluded))
            if rows:
                yield pd.DataFrame(rows)

    return _dealt(points).select("ref", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *(["angle", "view_angle"] if partial else [])).mapInPandas(run, ISOVIST)
