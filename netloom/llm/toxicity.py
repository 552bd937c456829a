"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of the embeddings of its hash and of the hashes of its first four and five letters. Filters of one, two and
three words run over the whole text; the largest response of each filter goes into a logistic output, so the score is a
probability. Labels are learnt from a bounded sample of the labelled rows, those of least hash (max_train rows and max_words words, parameters: in order of
the hash, a row whose words would go beyond max_words is passed over); the sample keeps the share of toxic rows, so scores need no recalibration for it. A threshold for each language is chosen on a part of the sample that
isn't trained on; languages with too few toxic rows get the threshold chosen over all of them. Language sets thresholds only; it is no input of a score.

A row without a doc_id isn't held out, and isn't learnt from either. Null and empty texts have no words and get the score of a text without any response. Null labels don't count; of several
labels of a document the highest does, and of rows that repeat a doc_id one is learnt from. Repeated rows are scored alike. With no label of either kind all scores are 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm._spark import cut, discard, fresh_names, slices, texts_of

#: Rows of the embedding table, its width, filters of each width, filter widths.
BUCKETS, WIDTH, FILTERS, SPANS = 1 << 17, 8, 8, (1, 2, 3)
MAX_TRAIN, MAX_WORDS, EPOCHS, BATCH, RATE = 6000, 8_000_000, 8, 64, 0.15
#: Every fifth row of the sample sets thresholds. Toxic rows a language needs there for a threshold of its own.
CALIBRATION, LEAST_TOXIC, DEFAULT_THRESHOLD = 5, 12, 0.3

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(word: str) -> tuple[int, int, int]:
    import xxhash

    return tuple(xxhash.xxh32_intdigest(x) % BUCKETS for x in (word, f"{word[:4]}\0", f"{word[:5]}\1"))


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]  # of each span: span x WIDTH x FILTERS
    bias: np.ndarray  # of each filter
    weight: np.ndarray
    offset: float
    thresholds: dict = field(default_factory=dict)
    threshold: float = DEFAULT_THRESHOLD

    def responses(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Of each span, the filters' responses at each place of a text padded by zeros."""
        out = []
        for span, w in zip(SPANS, self.filters):
            n = len(vectors)
            h = np.zeros((n, FILTERS), np.float32)
            for o in range(span):
                h[: n - o] += vectors[o:] @ w[o]
            out.append(h)
        return out


def _tops(h: np.ndarray, starts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The largest response of each text: at its words or the first place behind them, where a filter sees nothing. The places after that, whose filters
    would see the next text, don't count."""
    bounds = np.stack([starts, starts + words + 1], axis=1).ravel()
    return np.maximum.reduceat(h, bounds)[::2]


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)[:-1]])


def train(docs: list[np.ndarray], labels: np.ndarray, langs: list[str | None], seed: int = 7) -> Model:
    """docs: of each text the features of its words (n x 3)."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.05, (BUCKETS + 1, WIDTH)).astype(np.float32)
    e[BUCKETS] = 0  # stands between texts
    filters = [rng.normal(0, 0.3, (s, WIDTH, FILTERS)).astype(np.float32) for s in SPANS]
    bias = np.zeros(FILTERS * len(SPANS), np.float32)
    weight = rng.normal(0, 0.3, FILTERS * len(SPANS)).astype(np.float32)
    usable = np.array([len(x) > 0 for x in docs], bool)
    held = np.arange(len(docs)) % CALIBRATION == CALIBRATION - 1
    mine = np.flatnonzero(usable & ~held)
    rate = float(labels[~held].mean()) if (~held).any() else 0.0
    if not len(mine) or rate in (0.0, 1.0):
        return Model(e, filters, bias, weight * 0, -50.0 if rate == 0 else 50.0)
    offset = float(np.log(rate / (1 - rate)))
    model = Model(e, filters, bias, weight, offset)
    sums = [np.full_like(x, 1e-6) for x in (e, bias, weight, *filters)]
    off_sum = 1e-6
    gap = np.full((max(SPANS), 3), BUCKETS)
    epochs = EPOCHS * max(1, min(6, 3000 // len(mine)))
    for _ in range(epochs):
        rng.shuffle(mine)
        for at in range(0, len(mine), BATCH):
            pick = mine[at : at + BATCH]
            ids = np.concatenate([np.concatenate([docs[i], gap]) for i in pick])
            sizes = np.array([len(docs[i]) + len(gap) for i in pick])
            starts = _starts(sizes)
            x = e[ids[:, 0]] + e[ids[:, 1]] + e[ids[:, 2]]
            hs = model.responses(x)
            words = sizes - len(gap)
            top = np.concatenate([_tops(h, starts, words) for h in hs], axis=1) + bias
            act = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(act @ weight + model.offset, -30, 30)))
            d = ((p - labels[pick]) / len(pick)).astype(np.float32)
            g_weight = act.T @ d + 1e-4 * weight
            g_act = np.outer(d, weight) * (top > 0)
            g_e_rows, g_e = [], []
            for k, (span, w, h) in enumerate(zip(SPANS, filters, hs)):
                g = g_act[:, k * FILTERS : (k + 1) * FILTERS]
                hit_row, value = _argmax(h, starts, words + 1), g
                g_w = np.zeros_like(w)
                for o in range(span):
                    rows = np.minimum(hit_row + o, len(x) - 1)  # pick x FILTERS
                    v = x[rows]  # pick x FILTERS x WIDTH
                    g_w[o] = np.einsum("df,dfw->wf", value, v)
                    g_e_rows.append(rows.ravel())
                    g_e.append((value[:, :, None] * w[o].T[None]).reshape(-1, WIDTH))
                i = 3 + k
                sums[i] += g_w * g_w
                w -= RATE * g_w / np.sqrt(sums[i])
            rows, grads = np.concatenate(g_e_rows), np.concatenate(g_e)
            live = np.any(grads != 0, axis=1)
            rows, grads = rows[live], grads[live]
            flat = ids[rows].ravel()
            uniq, inv = np.unique(flat, return_inverse=True)
            total = np.zeros((len(uniq), WIDTH), np.float32)
            np.add.at(total, inv, np.repeat(grads, 3, axis=0))
            total[uniq == BUCKETS] = 0
            sums[0][uniq] += total * total
            e[uniq] -= RATE * total / np.sqrt(sums[0][uniq])
            g_bias = g_act.sum(axis=0)
            sums[1] += g_bias * g_bias
            bias -= RATE * g_bias / np.sqrt(sums[1])
            sums[2] += g_weight * g_weight
            weight -= RATE * g_weight / np.sqrt(sums[2])
            g_off = float(d.sum())
            off_sum += g_off * g_off
            model.offset -= RATE * g_off / off_sum**0.5
    check = np.flatnonzero(held)
    scores = score_features(model, [docs[i] for i in check])
    model.threshold = best_threshold(scores, labels[check])
    for lang in {langs[i] for i in check} - {None}:
        own = np.array([langs[i] == lang for i in check])
        if labels[check][own].sum() >= LEAST_TOXIC:
            model.thresholds[lang] = best_threshold(scores[own], labels[check][own])
    return model


def _argmax(h: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Row of the largest response of each text and filter."""
    return np.stack([s + h[s : s + n].argmax(axis=0) for s, n in zip(starts.tolist(), sizes.tolist())])


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the range of thresholds with the best F1, kept within 0.1 and 0.9."""
    if not labels.any():
        return DEFAULT_THRESHOLD
    order = np.argsort(-scores)
    s, y = scores[order], labels[order]
    f1 = 2 * np.cumsum(y) / (np.arange(1, len(y) + 1) + y.sum())
    ends = np.flatnonzero(np.append(s[1:] != s[:-1], True))
    k = ends[np.argmax(f1[ends])]
    low = s[k + 1] if k + 1 < len(s) else 0.0
    return float(np.clip((s[k] + low) / 2, 0.1, 0.9))


class Scorer:
    """Scores texts word by word from a table of what each known word adds to each filter; the table is bounded."""

    def __init__(self, model: Model, limit: int = 1 << 17):
        self.model, self.limit = model, limit
        self.columns = np.concatenate([w.transpose(1, 0, 2).reshape(WIDTH, -1) for w in model.filters], axis=1)  # WIDTH x (spans' offsets x FILTERS)
        self.reset()

    def reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1, self.columns.shape[1]), np.float32)

    def indexed(self, words: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        except KeyError:
            new = list(set(words).difference(self.rows))
            ids = np.array([features(w) for w in new])
            vectors = self.model.embedding[ids].sum(axis=1)
            n = len(self.rows) + 1
            self.rows.update(zip(new, range(n, n + len(new))))
            while len(self.table) < n + len(new):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[n : n + len(new)] = vectors @ self.columns
            return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))

    def __call__(self, texts: list[str]) -> np.ndarray:
        if len(self.rows) > self.limit:
            self.reset()
        if not texts:
            return np.empty(0)
        found = [words_of(x) for x in texts]
        gap = np.zeros(max(SPANS), np.int64)
        flat = self.indexed([w for x in found for w in x])
        sizes = np.array([len(x) for x in found])
        ids = np.concatenate([y for n, s in zip(sizes.tolist(), _starts(sizes).tolist()) for y in (flat[s : s + n], gap)])
        starts = _starts(sizes + len(gap))
        top, col = [], 0
        for span in SPANS:
            h = self.table[ids, col : col + FILTERS]
            for o in range(1, span):
                h[:-o] += self.table[ids[o:], col + o * FILTERS : col + (o + 1) * FILTERS]
            top.append(_tops(h, starts, sizes))
            col += span * FILTERS
        act = np.maximum(np.concatenate(top, axis=1) + self.model.bias, 0)
        z = act.astype(float) @ self.model.weight.astype(float) + self.model.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score_features(model: Model, docs: list[np.ndarray]) -> np.ndarray:
    out = []
    for ids in docs:
        x = np.concatenate([model.embedding[ids].sum(axis=1) if len(ids) else np.zeros((0, WIDTH), np.float32), np.zeros((max(SPANS), WIDTH), np.float32)])
        top = np.concatenate([h.max(axis=0) for h in model.responses(x)]) + model.bias
        out.append(1 / (1 + np.exp(-np.clip(float(np.maximum(top, 0) @ model.weight) + model.offset, -30, 30))))
    return np.array(out)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_words: int = MAX_WORDS) -> Model:
    """A model from at most max_train labelled rows that aren't held out, those whose hashed doc_id is least, and at most max_words words."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple] = {}
        for batch in slices(batches, "text"):
            out = []
            for text in texts_of(batch, "text"):
                words = words_of(text)
                for w in set(words).difference(seen):
                    seen[w] = features(w)
                out.append(np.array([seen[w] for w in words], np.int32).tobytes())
                if len(seen) > 1 << 18:
                    seen.clear()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), batch.column("lang"), pa.array(out, pa.binary())], names=["doc_id", "toxic", "lang", "ids"])

    have = docs.select("doc_id", "text", (F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")).alias("lang"))
    rows = have.join(F.broadcast(sample), "doc_id")  # at most max_train rows of two numbers
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "toxic")).alias("r")).select("doc_id", "r.toxic", "r.lang", "r.text")  # a repeated id counts once
    rows = rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("toxic", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("ids", T.BinaryType())]))
    rows = cut(rows, "sample")
    ordered = rows.select("doc_id", (F.octet_length("ids") / 12).cast("long").alias("n"), F.xxhash64("doc_id").alias("h")).toArrow().to_pylist()  # max_train rows of numbers
    ordered.sort(key=lambda r: (r["h"], r["doc_id"]))
    taken, words = [], 0
    for r in ordered:
        if words + r["n"] <= max_words:
            taken.append(r["doc_id"])
            words += r["n"]
    if len(taken) < len(ordered):
        rows = rows.filter(F.col("doc_id").isin(taken))
    got = rows.toArrow().to_pylist()
    discard(rows)
    got.sort(key=lambda r: (r["doc_id"], r["ids"]))
    x = [np.frombuffer(r["ids"], np.int32).reshape(-1, 3) for r in got[:max_train]]
    return train(x, np.array([r["toxic"] for r in got[:max_train]], float), [r["lang"] for r in got[:max_train]])


NAMES = ("score", "threshold", "rejected")


def score(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str | None = "lang", names: tuple[str, ...] = NAMES) -> DataFrame:
    """docs with score, threshold (of the row's language) and rejected, under these names. Columns that have them are replaced."""
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, k) for c, k in zip(names, (T.DoubleType(), T.DoubleType(), T.BooleanType())))])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: BUCKETS x WIDTH numbers
    lang_col = lang_col if lang_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model)
        for batch in slices(batches, text_col, 2 << 20):
            scores = scorer(texts_of(batch, text_col))
            langs = batch.column(lang_col).to_pylist() if lang_col else [None] * batch.num_rows
            limits = np.array([model.thresholds.get(x, model.threshold) for x in langs])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array(limits), pa.array(scores >= limits)], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of op7 for a table of documents."""
    model = fit(docs, labels)
    scored = score(docs.select("doc_id", "text", "lang"), model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def keep_clean(spark, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with their own columns, whatever their names."""
    names = tuple(fresh_names(docs, *NAMES))
    return score(docs, fit(docs, labels), names=names).filter(~F.col(names[2])).select(*docs.columns)
