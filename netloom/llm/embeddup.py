"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

Vectors with equal labels are compared by cosine in double precision. A hash rotates a vector by three rounds of random signs and a fast
Hadamard transform and takes the axis (with sign) of the largest component; HASHES of them make a bucket of one of TABLES tables. A vector
lies in its own bucket and is also probed in the PROBES next likely ones of each table. Only buckets that hold a vector's company
get vectors sent to them; a bucket of any size is cut into blocks, each pair of blocks is one matrix product in one task. A pair that meets in
several buckets counts in the first. What leaves a task is each vector's count of links and a forest of the links, never the pairs.

Vectors that are null, zero, or hold null or non-finite components link with nothing, nor do rows with a null label; each of these is a class of
its own. Equal vectors of a label are compared once and counted as often as they occur, and rows that repeat a vec_id are vectors of their own.
Vectors of different lengths link with nothing of another length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm._spark import cut
from netloom.llm.components import components, roots
from netloom.llm.minhash import mix
from netloom.llm.topk import valid_vectors

COSINE, TABLES, HASHES, PROBES, BLOCK = 0.93, 10, 2, 3, 2048
ROUNDS = 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def signs(seed: int, d: int) -> np.ndarray:
    return 1.0 - 2.0 * (mix(np.arange(d, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 20)) >> np.uint64(63)).astype(float)


def codes(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """n x tables x (1 + probes) bucket numbers: each vector's own bucket, then those it is probed in, likeliest first."""
    n, dim = x.shape
    d = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, d))
    padded[:, :dim] = x
    out = np.zeros((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        axis, size = [], []
        for k in range(hashes):
            y = padded
            for r in range(ROUNDS):
                y = hadamard(y * signs((t * hashes + k) * ROUNDS + r, d))
            both = np.concatenate([y, -y], axis=1)
            best = np.argpartition(-both, probes, axis=1)[:, : probes + 1]
            value = np.take_along_axis(both, best, axis=1)
            order = np.argsort(-value, axis=1, kind="stable")
            axis.append(np.take_along_axis(best, order, axis=1))
            size.append(np.take_along_axis(value, order, axis=1))
        own = np.zeros(n, np.int64)
        for k in range(hashes):
            own = own * (2 * d) + axis[k][:, 0]
        out[:, t, 0] = own
        # one step off the own bucket: hash k takes its j-th best axis instead; the least loss comes first
        loss = np.concatenate([size[k][:, :1] - size[k][:, 1:] for k in range(hashes)], axis=1)
        moved = np.concatenate([own[:, None] + (axis[k][:, 1:] - axis[k][:, :1]) * (2 * d) ** (hashes - 1 - k) for k in range(hashes)], axis=1)
        pick = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        out[:, t, 1:] = np.take_along_axis(moved, pick, axis=1)
    return out


def _met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tables in which pairs of vectors (rows of codes) meet, in their kinds: own buckets equal, a's own probed by b, b's own by a."""
    own = a[:, :, 0] == b[:, :, 0]
    by_b = (a[:, :, :1] == b[:, :, 1:]).any(axis=2)
    by_a = (b[:, :, :1] == a[:, :, 1:]).any(axis=2)
    return np.stack([own, by_b, by_a], axis=2).reshape(len(a), -1)


def _links(ids: np.ndarray, x: np.ndarray, code: np.ndarray, mult: np.ndarray, own: np.ndarray, block: np.ndarray, blocks: tuple[int, int], table: int, cosine: float) -> pd.DataFrame | None:
    """Links of one pair of blocks of a bucket, as counts and a forest. own: does the bucket be the vector's own."""
    left, right = np.flatnonzero(block == blocks[0]), np.flatnonzero(block == blocks[1])
    found_a, found_b = [], []
    for at in range(0, len(left), 1024):
        rows = left[at : at + 1024]
        i, j = np.nonzero(x[rows] @ x[right].T >= cosine)
        i, j = rows[i], right[j]
        ok = (own[i] | own[j]) & ((ids[i] < ids[j]) if blocks[0] == blocks[1] else (i != j))
        i, j = i[ok], j[ok]
        swap = ids[i] > ids[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        if not len(i):
            continue
        for part in range(0, len(i), 1 << 15):
            a, b = i[part : part + (1 << 15)], j[part : part + (1 << 15)]
            first = _met(code[a], code[b]).argmax(axis=1)
            here = 3 * table + np.where(own[a] & own[b], 0, np.where(own[a], 1, 2))
            take = first == here
            found_a.append(a[take])
            found_b.append(b[take])
    if not found_a:
        return None
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    if not len(a):
        return None
    n = np.bincount(a, mult[b], len(ids)) + np.bincount(b, mult[a], len(ids))
    has = np.flatnonzero(n)
    order = np.argsort(ids, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    root = order[roots(len(ids), place[a], place[b])[place]]
    return pd.DataFrame({"id": ids[has], "n": n[has].astype(np.int64), "root": ids[root[has]]})


def near_duplicates(df: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    fine = valid_vectors(rows.withColumn("key", F.struct("vec_id", "label")), "key", "embedding").select("id.*", "v")
    fine = fine.filter(F.col("label").isNotNull() & F.exists("v", lambda x: x != 0))
    groups = fine.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("mult"))
    groups = cut(groups.withColumn("id", F.monotonically_increasing_id()), "vectors")

    def hashed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            ids = batch.column("id").to_numpy()
            sizes = batch.column("v").value_lengths().to_numpy()
            flat = batch.column("v").flatten().to_numpy()
            starts = np.cumsum(sizes) - sizes
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                for part in range(0, len(at), 4096):
                    mine = at[part : part + 4096]
                    x = flat[starts[mine][:, None] + np.arange(size)[None, :]]
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    got = codes(x).reshape(len(mine), -1)
                    width = got.shape[1]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(mine) + 1, dtype=np.int32) * width), pa.array(got.ravel()))
                    unit = pa.ListArray.from_arrays(pa.array(np.arange(len(mine) + 1, dtype=np.int32) * size), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[mine]), lists, unit, pa.array(np.full(len(mine), size, np.int32))], names=["id", "codes", "unit", "dim"])

    hashes = cut(groups.select("id", "v").mapInArrow(hashed, "id bigint, codes array<bigint>, unit array<double>, dim int"), "codes")
    vectors = hashes.join(groups.select("id", "label", "mult"), "id")
    slots = vectors.select("id", "label", "dim", F.posexplode("codes").alias("at", "code"))
    slots = slots.select("id", "label", "dim", (F.col("at") / (1 + PROBES)).cast("int").alias("t"), "code", (F.col("at") % (1 + PROBES) == 0).alias("own"))
    bucket = ["label", "dim", "t", "code"]
    busy = slots.groupBy(*bucket).agg(F.count("*").alias("size"), F.count_if("own").alias("own_size")).filter("size > 1 and own_size > 0").drop("own_size")
    parts = F.ceil(F.col("size") / block).cast("int")
    mine = F.pmod(F.xxhash64("id", "t"), parts).cast("int")
    placed = slots.join(busy, bucket).withColumn("parts", parts).withColumn("block", mine)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.select("id", *bucket, "own", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    full = placed.join(vectors.select("id", "codes", "unit", "mult"), "id")
    task = [*bucket, "x", "y"]
    full = full.withColumn("task", F.xxhash64(*task)).repartition("task").sortWithinPartitions("task", *task)

    def linked(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])

        def solved(batch: pa.RecordBatch, edges: np.ndarray) -> pa.RecordBatch | None:
            out = []
            ids, mult = batch.column("id").to_numpy(), batch.column("mult").to_numpy()
            own, block_no = batch.column("own").to_numpy(zero_copy_only=False), batch.column("block").to_numpy()
            x, y, t = batch.column("x").to_numpy(), batch.column("y").to_numpy(), batch.column("t").to_numpy()
            code = batch.column("codes").flatten().to_numpy().reshape(len(ids), TABLES, 1 + PROBES)
            flat, dims = batch.column("unit").flatten().to_numpy(), batch.column("dim").to_numpy().astype(np.int64)
            ends = np.cumsum(dims)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if b - a < 2:
                    continue
                unit = flat[ends[a] - dims[a] : ends[b - 1]].reshape(b - a, -1)
                got = _links(ids[a:b], unit, code[a:b], mult[a:b], own[a:b], block_no[a:b], (x[a], y[a]), int(t[a]), cosine)
                if got is not None:
                    out.append(got)
            return pa.RecordBatch.from_pandas(pd.concat(out), schema=schema, preserve_index=False) if out else None

        held: list[pa.RecordBatch] = []  # rows of the group that may go on in the next batch
        for batch in frames:
            batch = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0] if held else batch
            keys = [batch.column(c).to_numpy() for c in ("task", "label", "dim", "t", "code", "x", "y")]
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            edges = np.flatnonzero(new)
            if len(edges) > 1:
                out = solved(batch.slice(0, edges[-1]), edges)
                if out is not None:
                    yield out
            held = [batch.slice(edges[-1])]
        if held:
            out = solved(held[0], np.array([0, held[0].num_rows]))
            if out is not None:
                yield out

    links = cut(full.mapInArrow(linked, "id bigint, n bigint, root bigint"), "links")
    counts = links.groupBy("id").agg(F.sum("n").alias("n"))
    found = components(links.select(F.col("root").alias("a"), F.col("id").alias("b")))
    classes = groups.join(found, "id", "left").join(counts, "id", "left").select("label", "v", "mult", "least", F.coalesce("component", "id").alias("component"), F.coalesce("n", F.lit(0)).alias("n"))
    smallest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = classes.join(smallest, "component").select("label", "v", (F.col("n") + F.col("mult") - 1).alias("n_links"), "component_id")
    usable = fine.join(classes, ["label", "v"]).select("vec_id", "n_links", "component_id")
    again = fine.groupBy("vec_id").agg(F.count("*").alias("fine"))
    rest = rows.select("vec_id").groupBy("vec_id").agg(F.count("*").alias("every")).join(again, "vec_id", "left")
    rest = rest.select("vec_id", F.explode_outer(F.when(F.col("every") > F.coalesce("fine", F.lit(0)), F.sequence(F.lit(1).cast("long"), F.col("every") - F.coalesce("fine", F.lit(0))))).alias("k")).filter("k is not null")
    rest = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return usable.union(rest).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def query(embeddings: DataFrame) -> DataFrame:
    """The columns of op3 for a table of embeddings."""
    return near_duplicates(embeddings)


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
