"""MinHash near-dedup with ProbMinHash signatures.

A document is the multiset of its shingles of five words (lower case, split at white space; a document of one to four words is
one shingle). Every shingle is a Poisson process whose rate is its count: arrivals come after exponential waits drawn from the
shingle's hash, each at a register drawn from it, and a register keeps the shingle that arrives first. Once a shingle's next arrival is later
than the latest register of its document it stops. The share of equal registers estimates the probability Jaccard similarity of two documents.

Registers are cut into bands; documents that agree in a band meet in a bucket. Links among the members of a bucket are verified exactly from the texts:

1. Each document is compared with one head, of the smallest members of its buckets that which most of them have in common. This is linear, and joins
   nearly all copies; a head with many documents is cut into blocks.
2. Buckets whose members aren't all connected by then are searched in full, but for pairs that are connected. Of buckets with equal members one is
   searched. The largest connected part of a bucket is its main part, which needs no comparison within: the rest is cut into blocks, the main part, too,
   and each pair of blocks with one of the rest is a group. In a group common shingles are counted by an inverted list, and what leaves it is a forest.

So copies never expand into rows of pairs, no link within a bucket is lost, and chains of buckets aren't searched as a whole. Texts with equal
word sequences are one class from the start. Links aren't counted, as those between documents known to be connected aren't looked for.

Documents without a word (null texts, too) are linked with nothing. Rows are told apart by doc_id and a hash of the text: rows that repeat a doc_id with
another text are documents of their own, and of rows equal in both (nulls, too) one is kept at most. Further columns are ignored. A null doc_id counts as an id that comes after all others: such rows are linked and kept
like others, and the class_id is null where all rows of a class have none.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm._spark import cut, slices, texts_of, whole_groups
from netloom.llm.components import components, roots

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 25, 6
#: Documents of a block at most, and at least where a bucket is cut (into eight blocks, if they are no larger); shingles in so many documents of a group and more are counted by a matrix product.
BLOCK, LEAST_BLOCK, COMMON = 1024, 256, 48

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer (splitmix64)."""
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, those met lately from a bounded cache."""

    def __init__(self, limit: int = 1 << 19):
        self.known: dict[str, int] = {}
        self.limit = limit

    def __call__(self, words: list[str]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > self.limit:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in set(words).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_hashes(word_hashes: np.ndarray, n: int = WORDS) -> np.ndarray:
    """A hash for each run of n words; of all words, if there are fewer."""
    if not len(word_hashes):
        return word_hashes
    n = min(n, len(word_hashes))
    h = np.full(len(word_hashes) - n + 1, n, np.uint64)
    for k in range(n):
        h = (h ^ mix(word_hashes[k : len(word_hashes) - n + 1 + k])) * _MIX[1]
        h ^= h >> np.uint64(29)
    return h


def prob_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """Signatures (n_docs x registers). doc, element, weight: a row per document and distinct element, documents numbered from 0."""
    best = np.full(n_docs * registers, np.inf)
    sig = np.zeros(n_docs * registers, np.uint64)
    time = np.zeros(len(doc))
    last = np.full(n_docs, np.inf)
    k = np.uint64(0)
    while len(doc):
        k += np.uint64(1)
        r = mix(element ^ (np.full(1, k) * _MIX[2]))
        time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / weight
        live = time < last[doc]
        doc, element, weight, time, r = doc[live], element[live], weight[live], time[live], r[live]
        at = doc * registers + (mix(r) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(best, at, time)
        won = best[at] == time
        sig[at[won]] = element[won]
        last = best.reshape(n_docs, registers).max(axis=1)
    return sig.reshape(n_docs, registers)


def probability_jaccard(a: Counter, b: Counter) -> float:
    """Exact: the sum over common elements i of 1 / sum over j of max(a_j / a_i, b_j / b_i)."""
    if not a or not b:
        return 0.0
    every = list(a.keys() | b.keys())
    x = np.array([a.get(k, 0) for k in every], float)
    y = np.array([b.get(k, 0) for k in every], float)
    both = (x > 0) & (y > 0)
    kinds, times = np.unique(np.stack([x[both], y[both]], axis=1), axis=0, return_counts=True)
    return sum(n / np.maximum(x / p, y / q).sum() for (p, q), n in zip(kinds.tolist(), times.tolist()))


def shingle_counts(text: str) -> Counter:
    words = text.lower().split()
    if len(words) < WORDS:
        return Counter([tuple(words)] if words else [])
    return Counter(zip(*(words[k:] for k in range(WORDS))))


def _count_common(into: np.ndarray, token: np.ndarray, doc: np.ndarray) -> None:
    """Adds, for each pair of documents, how many tokens they have in common; a document has a token once."""
    order = np.argsort(token, kind="stable")
    token, doc = token[order], doc[order]
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.empty(0, np.int64)
    count = np.diff(start, append=len(token))
    wide, n_wide = start[count >= COMMON], count[count >= COMMON]
    for at in range(0, len(wide), 2048):
        part, n = wide[at : at + 2048], n_wide[at : at + 2048]
        m = np.zeros((len(into), len(part)), np.float32)
        m[doc[np.repeat(part - np.cumsum(n) + n, n) + np.arange(n.sum())], np.repeat(np.arange(len(part)), n)] = 1
        into += m @ m.T
    for n in range(2, COMMON):
        here = start[count == n]
        if len(here):
            rows = doc[here[:, None] + np.arange(n)[None, :]]
            np.add.at(into, (np.repeat(rows, n, axis=1).ravel(), np.tile(rows, (1, n)).ravel()), 1)


def shingle_weights(text: str, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's shingles, rising, and how often each occurs."""
    h = np.sort(shingle_hashes(hashes(text.lower().split())))
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    return h[first], np.diff(first, append=len(h))


def like_first(texts: list[str], similarity: float, hashes: WordHashes) -> np.ndarray:
    """Is each text at least so similar to the first? With bounds as in similar_pairs()."""
    head, weights = shingle_weights(texts[0], hashes)
    total, counts, out = weights.sum(), None, np.zeros(len(texts), bool)
    for k, text in enumerate(texts):
        h, w = shingle_weights(text, hashes)
        at = np.minimum(np.searchsorted(head, h), len(head) - 1)
        both = head[at] == h
        x, y = w[both], weights[at[both]]
        lesser, greater = np.minimum(x, y).sum(), np.maximum(x, y).sum()
        every = (similarity - 1e-6) * (w.sum() + total - lesser)
        out[k] = lesser >= every
        if lesser < every <= greater:
            counts = counts or shingle_counts(texts[0])
            out[k] = probability_jaccard(counts, shingle_counts(text)) >= similarity - 1e-9
    return out


def similar_pairs(texts: list[str], block: np.ndarray, similarity: float, hashes: WordHashes, part: np.ndarray | None = None) -> np.ndarray:
    """Label of each text: the first text that links of at least the similarity connect it with. Texts are compared within block 0, if there is no other, or
    between blocks 0 and 1; those of one part aren't compared.

    With x and y the counts of shingles, both the sum of the lesser counts and the sum of the greater counts of common shingles, over the sum of all greater counts, bound
    the similarity; only where it lies between them it is worked out pair by pair.
    """
    shingles, weights = [], []
    for text in texts:
        h, w = shingle_weights(text, hashes)
        shingles.append(h)
        weights.append(w)
    n = len(texts)
    doc = np.repeat(np.arange(n), [len(x) for x in shingles])
    token, weight = np.concatenate(shingles), np.concatenate(weights)
    size = np.bincount(doc, weight, n)
    common = np.zeros((n, n), np.float32)
    _count_common(common, token, doc)
    lesser, greater = common, common
    again = np.flatnonzero(weight > 1)
    if len(again):  # the second of equal shingles is a token of its own, and so on
        times = weight[again] - 1
        k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + 1
        lesser = common.copy()
        _count_common(lesser, mix(np.repeat(token[again], times) ^ (k.astype(np.uint64) * _MIX[2])), np.repeat(doc[again], times))
        order = np.argsort(token, kind="stable")
        by_token = token[order]
        lo, hi = np.searchsorted(by_token, token[again], "left"), np.searchsorted(by_token, token[again], "right")
        spread = hi - lo
        other = doc[order[np.repeat(lo - np.cumsum(spread) + spread, spread) + np.arange(spread.sum())]]
        excess = np.zeros((n, n), np.float32)
        np.add.at(excess, (np.repeat(doc[again], spread), other), np.repeat(times, spread))
        greater = 2 * common + excess + excess.T - lesser
    every = size[:, None] + size[None, :] - lesser
    allowed = np.triu(np.ones((n, n), bool), 1) & (common > 0)
    if block.any():
        allowed &= block[:, None] != block[None, :]
    if part is not None:
        allowed &= part[:, None] != part[None, :]
    eps = 1e-6
    linked = allowed & (lesser >= (similarity - eps) * every)
    label = roots(n, *np.nonzero(linked))
    counts: dict[int, Counter] = {}
    for i, j in zip(*(x.tolist() for x in np.nonzero(allowed & ~linked & (greater >= (similarity - eps) * every)))):
        if label[i] != label[j]:
            for k in (i, j):
                if k not in counts:
                    counts[k] = shingle_counts(texts[k])
            if probability_jaccard(counts[i], counts[j]) >= similarity - 1e-9:
                low, high = sorted((label[i], label[j]))
                label[label == high] = low
    return label


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, tag, hash of the word sequence, and band keys of each document (doc_id, tag, text) that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "text", 8 << 20):
            ids, tags, names, doc, element = [], [], [], [], []
            for key, tag, text in zip(batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), texts_of(batch, "text")):
                words = text.lower().split()
                if words:
                    h = hashes(words)
                    element.append(shingle_hashes(h))
                    ids.append(key)
                    tags.append(tag)
                    names.append(hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest())
            if not ids:
                continue
            sizes = [len(x) for x in element]
            doc, element = np.repeat(np.arange(len(ids)), sizes), np.concatenate(element)
            order = np.lexsort((element, doc))
            doc, element = doc[order], element[order]
            first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (element[1:] != element[:-1])]))
            weight = np.diff(first, append=len(doc)).astype(float)
            sig = prob_minhash(doc[first], element[first], weight, len(ids), bands * rows).reshape(len(ids), bands, rows)
            keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(ids), bands)).copy()
            for k in range(rows):
                keys = mix(keys ^ sig[:, :, k])
            offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * bands)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(names, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel()))], names=["doc_id", "tag", "words", "bands"])

    return docs.select("doc_id", "tag", "text").mapInArrow(run, "doc_id bigint, tag bigint, words binary, bands array<bigint>")


def _groups(batch: pa.RecordBatch, *keys: str) -> list[tuple[int, int]]:
    """First row and the row after the last of each run of rows with equal keys."""
    new = np.ones(batch.num_rows, bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in (batch.column(c).to_numpy() for c in keys)], axis=0)
    edges = [*np.flatnonzero(new).tolist(), batch.num_rows]
    return list(zip(edges, edges[1:]))


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def _like_heads(heads: DataFrame, texts: DataFrame, similarity: float, block: int) -> DataFrame:
    """a, b: of the pairs of a head (a) and a document (id, greater) those that are similar."""
    sizes = cut(heads.groupBy("a").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")), "sizes")  # so that a crowded head can be split in the join
    rows = heads.join(sizes, "a").select("a", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), "id")
    rows = rows.union(sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), F.col("a")))
    full = rows.join(texts, "id").withColumn("task", F.xxhash64("a", "part")).repartition("task").sortWithinPartitions("task", "a", "part", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in whole_groups(batches, "task", 8 << 20):
            ids = batch.column("id").to_numpy()
            a, b = [], []
            for lo, hi in _groups(batch, "task", "a", "part"):
                like = like_first(batch.column("text").slice(lo, hi - lo).to_pylist(), similarity, hashes)
                like[0] = False
                b.append(ids[lo:hi][like])
                a.append(np.full(len(b[-1]), ids[lo]))
            yield _pairs(a, b)

    return full.mapInArrow(run, "a bigint, b bigint")


def _between_parts(members: DataFrame, texts: DataFrame, similarity: float, block: int) -> DataFrame:
    """a, b: forests of the links between documents (id) of a bucket that lie in different parts. main: the largest part of a bucket, of most
    documents; n: documents of the bucket."""
    mine = F.least(F.lit(float(block)), F.greatest(F.lit(float(min(LEAST_BLOCK, block))), F.col("n") / 8))
    whole = F.col("n") <= mine
    rest = F.when(whole, 1).otherwise(F.ceil((F.col("n") - F.col("most")) / mine)).cast("int")
    more = F.when(whole, 0).otherwise(F.ceil(F.col("most") / mine)).cast("int")
    of_main = (F.col("part") == F.col("main")) & ~whole
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.greatest(n, F.lit(1))).cast("int")
    placed = members.withColumns({"rest": rest, "more": more}).withColumn("block", F.when(of_main, F.col("rest") + dealt(F.col("more"))).otherwise(dealt(F.col("rest"))))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(of_main, F.col("rest")).otherwise(F.col("rest") + F.col("more")) - 1)))
    placed = placed.select("band", "key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "part")
    full = placed.join(texts, "id").withColumn("task", F.xxhash64("band", "key", "x", "y"))
    full = full.repartition("task").sortWithinPartitions("task", "band", "key", "x", "y", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in whole_groups(batches, "task", 8 << 20):
            ids, place, part, x = (batch.column(c).to_numpy() for c in ("id", "block", "part", "x"))
            a, b = [], []
            for lo, hi in _groups(batch, "task", "band", "key", "x", "y"):
                if hi - lo > 1:
                    label = similar_pairs(batch.column("text").slice(lo, hi - lo).to_pylist(), (place[lo:hi] != x[lo]).astype(int), similarity, hashes, part[lo:hi])
                    more = np.flatnonzero(label != np.arange(hi - lo))
                    a.append(ids[lo + label[more]])
                    b.append(ids[lo + more])
            if a:
                yield _pairs(a, b)

    return full.mapInArrow(run, "a bigint, b bigint")


def _links(spread: DataFrame, texts_of_ids: Callable[[DataFrame], DataFrame], similarity: float, block: int) -> DataFrame:
    """a, b: links that connect what is similar and meets in a bucket. spread: id, band, key."""
    bucket = ["band", "key"]
    crowded = cut(spread.groupBy(*bucket).agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n"), "heads")  # so that a crowded bucket can be split in the join
    members = cut(spread.join(crowded, bucket), "members")
    texts = cut(texts_of_ids(members.select("id").distinct()), "texts")
    shared = members.filter("a <> id").groupBy("id", "a").agg(F.count("*").alias("n"))
    heads = cut(shared.groupBy("id").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")), "heads")
    first = cut(_like_heads(heads, texts, similarity, block), "links")
    parts = components(first).withColumnRenamed("component", "part")
    known = cut(members.join(parts, "id", "left").select("id", *bucket, F.coalesce("part", "id").alias("part")), "members")
    each = known.groupBy(*bucket, "part").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.bit_xor(F.xxhash64("id")).alias("mix"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("mix2"))
    mixed = each.groupBy(*bucket).agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("part", F.struct("n", -F.col("part"))).alias("main"), F.min("low").alias("low"), F.max("high").alias("high"), F.bit_xor("mix").alias("mix"), F.bit_xor("mix2").alias("mix2"))
    mixed = mixed.filter("n > most")
    compared = heads.select(F.lit(2).cast("long").alias("n"), F.col("a").alias("low"), F.col("id").alias("high"))  # buckets of a head and its document
    mixed = mixed.join(compared, ["n", "low", "high"], "left_anti")
    mixed = mixed.groupBy("n", "low", "high", "mix", "mix2").agg(F.min(F.struct(*bucket, "main", "most")).alias("one")).select("n", "one.*")  # equal members: one bucket
    return first.union(_between_parts(known.join(cut(mixed, "mixed"), bucket), texts, similarity, block))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, tag (a hash of the text), text: rows equal in doc_id and tag are equal."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text")


def _same_key(tag: str = "tag") -> Column:
    """Is a row's key that of the other side (of_id, of_tag)? Null ids are equal."""
    return F.col("doc_id").cast("long").eqNullSafe(F.col("of_id")) & (F.col(tag) == F.col("of_tag"))


def row_classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """doc_id, tag, n, class_id, kept for each n rows equal in doc_id and text. One key of a class is kept: that of the least doc_id, then the least tag."""
    base = _keyed(docs)
    sketches = cut(sketch(base, bands, rows), "sketch")
    # equal word sequences are one class, numbered as it is written; its first row stands for it
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag"))
    classes = cut(sketches.groupBy("words").agg(first.alias("first"), F.min_by("bands", "tag").alias("bands")).withColumn("id", F.monotonically_increasing_id()), "classes")
    spread = classes.select("id", F.posexplode("bands").alias("band", "key"))

    def texts_of_ids(ids: DataFrame) -> DataFrame:
        standing = ids.join(classes, "id").select("id", F.col("first.doc_id").alias("of_id"), F.col("first.tag").alias("of_tag"))
        return base.join(standing, _same_key()).groupBy("id").agg(F.min("text").alias("text"))  # equal rows count once

    found = components(cut(_links(spread, texts_of_ids, similarity, block), "links"))
    final = classes.select("words", "id", "first").join(found, "id", "left").select("words", "first", F.coalesce("component", "id").alias("class"))
    final = final.join(final.groupBy("class").agg(F.min("first").alias("least")), "class").select("words", "least")
    of = sketches.select("doc_id", "tag", "words").distinct().join(final, "words").select(F.col("doc_id").alias("of_id"), F.col("tag").alias("of_tag"), "least")
    kinds = base.groupBy("doc_id", "tag").agg(F.count("*").alias("n"))
    least = F.col("least")
    class_id = F.when(least.isNull(), F.col("doc_id")).otherwise(least["doc_id"])
    kept = least.isNull() | (least["doc_id"].eqNullSafe(F.col("doc_id")) & (least["tag"] == F.col("tag")))
    return kinds.join(of, _same_key(), "left").select("doc_id", "tag", "n", class_id.alias("class_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), kept (true for one row of the class) of each document."""
    found = row_classes(docs, similarity, bands, rows, block)
    return found.select("doc_id", "class_id", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), "n"), lambda k: F.col("kept") & (k == 1))).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that near_duplicates() keeps; any one of rows equal in doc_id and text."""
    kept = cut(row_classes(docs).filter("kept").select(F.col("doc_id").alias("of_id"), F.col("tag").alias("of_tag"), F.col("n").alias("_n")), "kept")
    rows = docs.withColumn("_tag", F.xxhash64("text"))
    one = rows.join(kept, _same_key("_tag"))
    again = one.filter("_n > 1").dropDuplicates(["doc_id", "_tag"])
    return one.filter("_n = 1").union(again).select(*docs.columns)


def query(docs: DataFrame) -> DataFrame:
    """op4: the class of each document."""
    return near_duplicates(docs)
