"""Packing: documents, in order, into sequences of at most `window` tokens.

Within a run of documents (about RUN_TOKENS tokens, one task's rows in their order) dynamic programming chooses the cuts among
document ends, sentence ends and, inside sentences longer than HARD_STEP tokens, every HARD_STEP-th token. The cost of a sequence is
its padding plus a penalty if its end truncates a document or a sentence. A sequence is padded to the window unless its length is a
power of two; padding falls linearly with the start of a sequence, so the best start within a window's reach is the front of a
monotone queue, and the few starts at a power of two before the end are looked up.

Null texts count as empty: their document is the end token alone. Repeated rows are documents of their own.
"""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm._spark import slices, texts_of
from netloom.llm.bpe import load

#: Tokens of a run; penalties, in tokens of padding, for a cut at a sentence end and inside a sentence.
RUN_TOKENS, SENTENCE_CUT, HARD_CUT = 1 << 19, 0.25, 4.0
#: Tokens between possible cuts where sentences are longer than that; a power of two, a window at most.
HARD_STEP = 64

PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def choose_cuts(ends: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """Where sequences end. ends: rising positions of possible cuts, the last is the run's end, none more than window apart; penalty: of each cut."""
    pos = np.concatenate([[0], ends]).astype(np.int64)
    n = len(pos)
    powers = [1 << k for k in range(window.bit_length()) if 1 << k < window]
    jumps: list[list[int]] = [[] for _ in range(n)]
    for p in powers:
        want = pos - p
        at = np.searchsorted(pos, want)
        hit = np.flatnonzero((want >= 0) & (pos[np.minimum(at, n - 1)] == want))
        for j, i in zip(hit.tolist(), at[hit].tolist()):
            jumps[j].append(i)
    where, extra = pos.tolist(), [0.0, *penalty.tolist()]
    cost, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # (cost + position of a start, its index), rising
    for j in range(1, n):
        low = where[j] - window
        while where[queue[0][1]] < low:
            queue.popleft()
        key, i = queue[0]
        best, start = key - low, i
        for i in jumps[j]:
            if cost[i] < best:
                best, start = cost[i], i
        best += extra[j]
        cost[j], back[j] = best, start
        key = best + where[j]
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], n - 1
    while j:
        cuts.append(where[j])
        j = back[j]
    return cuts[::-1]


@functools.lru_cache(2)
def _sentence_ends(path: str) -> np.ndarray:
    """For each token id: does its text end a sentence or line?"""
    return np.array([x.endswith((b".", b"!", b"?", b"\n", b"\xe3\x80\x82")) for x in load(path).pieces], bool)


def pack_run(docs: list[np.ndarray], sentence_end: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence ends of a run, and all its tokens. docs: token ids of each document."""
    tokens = np.concatenate(docs)
    doc_ends = np.cumsum([len(x) for x in docs])
    total = len(tokens)
    soft = np.flatnonzero(sentence_end[tokens]) + 1
    soft = soft[soft < total]
    ends = np.union1d(soft, doc_ends)
    step = min(HARD_STEP, window)
    gaps = np.diff(ends, prepend=0)
    wide = gaps > step
    hard = [np.arange(a - g + step, a, step) for a, g in zip(ends[wide].tolist(), gaps[wide].tolist())]
    # the run's tail can always be cut at powers of two from its end
    tail, left = [], total % window
    at = total - left
    for bit in range(window.bit_length(), -1, -1):
        if left >> bit & 1:
            at += 1 << bit
            tail.append(at)
    every = np.unique(np.concatenate([ends, *hard, np.array([x for x in [total - total % window, *tail] if 0 < x <= total], np.int64)]))
    penalty = np.full(len(every), HARD_CUT)
    penalty[np.isin(every, soft)] = SENTENCE_CUT
    penalty[np.isin(every, doc_ends)] = 0.0
    return np.array(choose_cuts(every, penalty, window), np.int64), tokens


def pack_documents(df: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: document, where the piece starts in it, its length and ids (little-endian unsigned 32-bit), and its place in a sequence.

    One pass without a shuffle; runs end with the task, so a rerun of a lost task gives the same pieces. Memory is bounded by
    a run and the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, soft = load(tokenizer_path), _sentence_ends(tokenizer_path)
        part = TaskContext.get().partitionId() << 36
        made = 0
        held_ids: list = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, size
            cuts, tokens = pack_run(held, soft, window)
            lengths = np.array([len(x) for x in held], np.int64)
            doc_ends = np.cumsum(lengths)
            edges = np.union1d(cuts, doc_ends)
            starts = np.concatenate([[0], edges[:-1]])
            doc = np.searchsorted(doc_ends, starts, "right")
            seq = np.searchsorted(cuts, starts, "right")
            seq_start = np.concatenate([[0], cuts])[seq]
            data = tokens.astype("<u4").tobytes()
            ids = pa.array([data[4 * a : 4 * b] for a, b in zip(starts.tolist(), edges.tolist())], pa.binary())
            names = pa.array(held_ids, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(doc)), pa.array(starts - (doc_ends - lengths)[doc]), pa.array(edges - starts), ids, pa.array(lengths[doc]), pa.array(part + made + seq), pa.array(starts - seq_start)],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            made += len(cuts)
            held_ids.clear()
            held.clear()
            size = 0

        for batch in slices(batches, text_col):
            for key, text in zip(batch.column(id_col).to_pylist(), texts_of(batch, text_col)):
                ids = bpe.encode(text)
                ids.append(end_id)
                held_ids.append(key)
                held.append(np.array(ids, np.int32))
                size += len(ids)
                if size >= RUN_TOKENS:
                    yield from flush()
        if held:
            yield from flush()

    return df.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, PIECES)


def query(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The digest columns of op9 for a table of documents."""
    return pack_documents(docs, tokenizer_path).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
