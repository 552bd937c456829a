"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Where byte_bpe_50k.json and the other public vocabularies lie.
TOKENIZERS = "/opt/tokenizers"

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark (the path may be any store that Spark reaches)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file: the installed package's if there is one, else below TOKENIZERS."""
    import importlib.util

    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return public_tokenizers.path(name)
    return f"{TOKENIZERS}/{name}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own in a local session without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="netloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _own_dirs[app] = f"file://{own}"
    return _own_dirs[app]


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/netloom/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame, kind: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, kind)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._netloom_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the table that cut() wrote, once nothing reads it any more."""
    path = getattr(df, "_netloom_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, each with as many underscores ahead as keep it apart from the columns of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose text column holds about max_bytes at most (a single longer row stays whole)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = max(1, batch.column(column).nbytes // n)
        step = max(1, max_bytes // size)
        start = 0
        while start < n:
            part = batch.slice(start, step)
            while part.num_rows > 1 and part.column(column).nbytes > 2 * max_bytes:
                part = part.slice(0, part.num_rows // 2)
            yield part
            start += part.num_rows


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, in batches of about `limit` bytes that end where a group ends."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < limit:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        keys = whole.column(key).to_numpy()
        last = np.flatnonzero(keys[1:] != keys[:-1])
        if len(last):
            yield whole.slice(0, last[-1] + 1)
            whole = whole.slice(last[-1] + 1)
        held, size = [whole], whole.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's values; null counts as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]
