"""Sharding by size-tiered compaction: arrivals become small immutable shards, runs of similar size merge into target-sized files, and a
versioned manifest says which files hold the data.

A run is a folder that one Spark job wrote whole. A version of the manifest is one file that is written aside and then gets its
final name, which fails if another writer took the version: readers see the old version or the new one, never a mixture. On local
file systems the name is a hard link, elsewhere a rename that doesn't overwrite; both are atomic and exclusive there and on HDFS. Stores whose rename is
a copy (plain object stores) give no such promise and need a lock around commit(). A job that dies leaves files that no manifest names.
vacuum() deletes those once they are old enough to be no other writer's, and spares what kept versions name. Nothing is read by the driver but
file names, sizes and row counts.

Rows are kept as they are: nulls, empty texts, repeated rows and any columns. An empty arrival adds no run.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm._spark import fresh_names, new_path

#: Bytes of a merged file; runs of a tier that merge; growth from tier to tier.
TARGET, FANOUT, FIRST_TIER = 128 << 20, 4, 1 << 20


@dataclass(frozen=True)
class Run:
    path: str
    files: int
    bytes: int
    rows: int

    @property
    def tier(self) -> int:
        return 0 if self.bytes <= FIRST_TIER else 1 + int(math.log(self.bytes / FIRST_TIER, FANOUT))


class CommitConflict(RuntimeError):
    """Another writer has committed the version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target, fanout
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._jvm.Path("/".join(parts))

    def versions(self) -> list[int]:
        at = self._path(self.root, "manifest")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def runs(self, version: int | None = None) -> list[Run]:
        known = self.versions()
        if not known:
            return []
        at = self._path(self.root, "manifest", f"v{known[-1] if version is None else version:08d}.json")
        stream = self._fs.open(at)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Run(**r) for r in json.loads(text)["runs"]]

    def commit(self, runs: list[Run], base: int) -> int:
        """Makes version base + 1 name these runs; base is the version they were worked out from (0: none)."""
        final = self._path(self.root, "manifest", f"v{base + 1:08d}.json")
        aside = self._path(self.root, "manifest", f".{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps({"version": base + 1, "runs": [r.__dict__ for r in runs]}).encode()))
        finally:
            out.close()
        try:
            self._name(aside, final)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise CommitConflict(f"version {base + 1} exists") from e
            raise
        finally:
            self._fs.delete(aside, False)
        return base + 1

    def _name(self, aside, final) -> None:
        """Gives a file its final name unless there is one; exactly one of several writers succeeds."""
        if self._fs.getScheme() == "file":
            paths = self.spark._jvm.java.nio.file.Paths
            near = lambda p: paths.get(self._fs.makeQualified(p).toUri())
            self.spark._jvm.java.nio.file.Files.createLink(near(final), near(aside))
            return
        context = self._jvm.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(aside, final, self.spark.sparkContext._gateway.new_array(getattr(self._jvm, "Options$Rename"), 0))

    def _write(self, df: DataFrame) -> Run | None:
        path = f"{self.root}/runs/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return self._run(path, df)

    def _run(self, path: str, df: DataFrame) -> Run | None:
        """The run that lies at path with the columns of df; an empty one is deleted."""
        files = [s for s in self._fs.listStatus(self._path(path)) if s.getPath().getName().startswith("part-")]
        rows = self.spark.read.schema(df.schema).parquet(path).count()  # from the files' footers
        if not rows:
            self._fs.delete(self._path(path), True)
            return None
        return Run(path, len(files), sum(s.getLen() for s in files), rows)

    def append(self, df: DataFrame) -> int:
        """A new run of small shards, one for each of the arrival's partitions, and a version that names it."""
        return self._named(self._write(df))

    def _named(self, run: Run | None) -> int:
        base = (self.versions() or [0])[-1]
        return self.commit([*self.runs(), run], base) if run else base

    def append_many(self, df: DataFrame, arrival: Column) -> list[int]:
        """A run for each value of `arrival` (a whole number), in their order, compacting after each. One job reads df and writes them all."""
        (column,) = fresh_names(df, "arrival")
        path = f"{self.root}/runs/{uuid.uuid4().hex}"
        df.withColumn(column, arrival.cast("int")).write.option("compression", "zstd").partitionBy(column).parquet(path)
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(path)) if s.isDirectory()]
        out = []
        for k in sorted(int(n.rpartition("=")[2]) for n in found if n.startswith(f"{column}=")):
            moved = f"{self.root}/runs/{uuid.uuid4().hex}"
            if not self._fs.rename(self._path(path, f"{column}={k}"), self._path(moved)):
                raise OSError(f"{path}: arrival {k} can't be moved")
            out.append(self._named(self._run(moved, df)))
            self.compact()
        self._fs.delete(self._path(path), True)
        return out

    def compact(self) -> int:
        """Merges tiers that hold `fanout` runs, from the smallest up, until none does; a version for each merge."""
        while True:
            base, runs = (self.versions() or [0])[-1], self.runs()
            tiers: dict[int, list[Run]] = {}
            for r in runs:
                tiers.setdefault(r.tier, []).append(r)
            full = [t for t in sorted(tiers) if len(tiers[t]) >= self.fanout]
            if not full:
                return base
            merged = tiers[full[0]]
            files = max(1, math.ceil(sum(r.bytes for r in merged) / self.target))
            whole = self.spark.read.parquet(*(r.path for r in merged))
            run = self._write(whole.coalesce(files))
            self.commit([r for r in runs if r not in merged] + [run], base)

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(*(r.path for r in self.runs(version)))

    def vacuum(self, keep: int | None = None, older_than: float = 86400.0) -> int:
        """Deletes runs that none of the last `keep` versions names (None: of all versions), if they are older than so many seconds (younger ones may be another
        writer's), then the manifests of the versions that aren't kept; returns how many runs. Every version left can be read."""
        known = self.versions()
        kept = known if keep is None else known[-keep:]
        for v in known:
            if v not in kept:
                self._fs.delete(self._path(self.root, "manifest", f"v{v:08d}.json"), False)
        named = {r.path.rpartition("/")[2] for v in kept for r in self.runs(v)}
        at, gone, limit = self._path(self.root, "runs"), 0, (time.time() - older_than) * 1000
        for s in self._fs.listStatus(at) if self._fs.exists(at) else []:
            if s.getPath().getName() not in named and s.getModificationTime() <= limit:
                gone += self._fs.delete(s.getPath(), True)
        return gone


def shard_arrivals(docs: DataFrame, arrivals: int = 8, target: int = TARGET) -> ShardStore:
    """Appends a table in so many arrivals, by ranges of doc_id, compacting after each. Rows without a doc_id come with the first."""
    spark = docs.sparkSession
    store = ShardStore(spark, new_path(spark, "shards"), target)
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    step = (high - low) // arrivals + 1 if low is not None else 1
    store.append_many(docs, F.coalesce(((F.col("doc_id") - F.lit(low)) / step).cast("int"), F.lit(0)))
    return store


def query(docs: DataFrame) -> DataFrame:
    """op10: what the store's last version holds, read back: each document once with its text's hash."""
    store = shard_arrivals(docs)
    store.vacuum(keep=1, older_than=0)  # no one else writes to this store
    rows = store.read() if store.runs() else docs
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", F.length(text).cast("long").alias("chars"), F.sha2(text, 256).alias("text_sha256"))


ORACLE_SQL = "SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents"
