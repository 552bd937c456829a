"""Suffix-array dedup: removes what a string of `length` symbols covers which also starts anywhere else. Symbols are the bytes of a text in UTF-8, or its
words (between white space, told apart by 64-bit hashes; a text without white space is one word).

The method is column-wise multi-document construction of a collection's Burrows-Wheeler order: one symbol of every string is inserted a round, from
the right, and each round derives the order of the new suffixes, the column of symbols before them and their common prefixes from
the round before. To spread over a cluster the collection is first cut where equal windows must meet:

1. Anchors. Of the hashes of all grams of `gram` symbols in a window of `length` symbols the least (leftmost) is the window's anchor. It depends on the
   window only, so equal windows have equal anchors at equal offsets. Anchors whose hash occurs once are dropped.
2. Strings. Around every other anchor the symbols that windows with it can span form a string, aligned at the anchor. Equal strings are
   one, with a count: copies collapse before they meet.
3. Columns. In a group of strings with equal grams two windows can be equal only at equal distance from the anchor, so each round orders suffixes of
   equal columns only (the positional form of the transform): a stable sort of the last order by the symbol inserted, with common
   prefixes as one more than the least within the range that the order jumps. Rows come to the construction from Spark's sorted files as a sequential stream,
   and a window is repeated where a common prefix reaches `length`.
4. Groups with more than GROUP strings are regrouped by longer grams, for sub-ranges of offsets each, so that strings equal there
   collapse again; at a single offset the gram is the whole window and a count suffices. No string is dropped and no group is gathered.

Null texts count as empty. Matches never cross documents. Rows that repeat a doc_id are documents of their own. Of what repeats every occurrence is
removed, the first one, too. Further columns pass through, whatever their names. Lists of a document's anchors are no longer than its text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm._spark import cut, discard, fresh_names, slices, whole_groups
from netloom.llm.minhash import WordHashes, mix

#: Bytes of a string that may not repeat; words of one, where symbols are words. Grams are half as long.
LENGTH, WORDS = 400, 50
#: Strings that one group may hold; bytes of strings that a task builds at once.
GROUP, BATCH_BYTES = 4096, 12 << 20
#: Ranges of offsets that a group too large is cut into.
REFINE = 8

_BASE = 0x9E3779B97F4A7C15
_letters = mix(np.arange(256, dtype=np.uint64))
_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse modulo 2**64, n of them at least."""
    if not _tables or len(_tables[0]) < n:
        size = max(n, 1 << 17)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _tables[:] = made
    return _tables[0], _tables[1]


class Symbols:
    """Reads a text as an array of bytes or of hashes of words. Pieces of arrays travel as their bytes, `size` a symbol."""

    def __init__(self, words: bool):
        self.words, self.size, self.kind = words, 8 if words else 1, np.uint64 if words else np.uint8
        self.hashes = WordHashes() if words else None

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        return self.hashes(text.split()) if self.words else np.frombuffer(text.encode(), np.uint8)

    def matrix(self, strings: list[bytes], left: np.ndarray, before: int, width: int) -> tuple[np.ndarray, int]:
        """The strings as rows, each with `left` symbols ahead of column `before`, and the number that stands where there is none (above all others)."""
        if self.words:
            kinds, rank = np.unique(np.frombuffer(b"".join(strings), np.uint64), return_inverse=True)
            rank, end, kind = rank.astype(np.int32), len(kinds), np.int32
        else:
            rank, end, kind = np.frombuffer(b"".join(strings), np.uint8), 256, np.uint16
        out = np.full((len(strings), width), end, kind)
        sizes = np.array([len(x) for x in strings]) // self.size
        at = 0
        for i, (n, k) in enumerate(zip(sizes.tolist(), left.tolist())):
            out[i, before - k : before - k + n] = rank[at : at + n]
            at += n
        return out, end


def prefix_hashes(symbols: np.ndarray) -> np.ndarray:
    out = np.zeros(len(symbols) + 1, np.uint64)
    values = _letters[symbols] if symbols.dtype == np.uint8 else mix(symbols)
    np.cumsum(values * _powers(len(symbols) + 1)[0][: len(symbols)], out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the symbols from each start to each end, by content only."""
    back = _powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * back[start] + (end - start).astype(np.uint64))


def anchors(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of a text's anchors, hashes of their grams, hashes of the strings around them."""
    none = np.empty(0, np.int64)
    if len(raw) < length:
        return none, none, none
    prefix = prefix_hashes(raw)
    n = len(raw) - gram + 1
    place = np.arange(n)
    h = range_hashes(prefix, place, place + gram)
    width = length - gram + 1
    # the place in the low bits makes the leftmost of equal values the least, and tells where it is
    bits = np.uint64(max(1, n.bit_length()))
    key = (h >> bits << bits) | place.astype(np.uint64)
    pad = -n % width
    full = np.concatenate([key, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, width)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = len(raw) - length + 1
    least = np.minimum(right[:starts], left[width - 1 : width - 1 + starts]) & ((np.uint64(1) << bits) - np.uint64(1))
    at = least[np.concatenate([[True], least[1:] != least[:-1]])].astype(np.int64)
    lo, hi = np.maximum(at - (length - gram), 0), np.minimum(at + length, len(raw))
    around = range_hashes(prefix, lo, hi) ^ mix((at - lo).astype(np.uint64))
    return at, h[at].view(np.int64), around.view(np.int64)


def columns(strings: np.ndarray, group: np.ndarray, length: int, first: int, end: int = 256) -> np.ndarray:
    """For strings aligned in columns (m x W, `end` where there is no symbol), sorted by group: does the window of `length`
    at each column up to `first` also start at that column of another string of the group?

    A round inserts the symbols of one column, from the right. order: strings by group and suffix; common: what
    neighbours in order have in common.
    """
    m, width = strings.shape
    found = np.zeros((m, first + 1), bool)
    order = np.arange(m)
    fresh = np.concatenate([[True], group[1:] != group[:-1]])
    common = np.where(fresh, 0, 0).astype(np.int32)
    by_column = np.ascontiguousarray(strings.T)
    base = group.astype(np.int64) * (end + 1)
    for c in range(width - 1, -1, -1):
        symbol = by_column[c][order]
        key = base + symbol  # order keeps groups together, so base needs no reordering
        perm = np.argsort(key, kind="stable")
        a, b = perm[:-1], perm[1:]
        same = (key[a] == key[b]) & (symbol[b] != end)
        nxt = np.zeros(m, np.int32)
        hit = np.flatnonzero(same)
        if len(hit):
            bounds = np.empty(2 * len(hit), np.int64)
            bounds[::2], bounds[1::2] = a[hit] + 1, b[hit] + 1
            nxt[hit + 1] = 1 + np.minimum.reduceat(np.append(common, 0), bounds)[::2]
        order, common = order[perm], nxt
        if c <= first:
            long = common >= length
            long[:-1] |= long[1:]
            found[order[long], c] = True
    return found


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of True in a matrix."""
    edge = np.zeros((len(mask), mask.shape[1] + 2), np.int8)
    edge[:, 1:-1] = mask
    step = np.diff(edge, axis=1)
    row, lo = np.nonzero(step == 1)
    return row, lo, np.nonzero(step == -1)[1] - 1


def _anchor_rows(docs: DataFrame, length: int, gram: int, words: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols(words)
        for batch in slices(batches, "text"):
            ids, tags, found = [], [], []
            for key, tag, text in zip(batch.column("doc").to_pylist(), batch.column("tag").to_pylist(), batch.column("text").to_pylist()):
                got = anchors(symbols(text), length, gram)
                ids.append(np.full(len(got[0]), key, np.int64))
                tags.append(np.full(len(got[0]), tag, np.int64))
                found.append(got)
            at, h, around = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(tags)), pa.array(at.astype(np.int32)), pa.array(h), pa.array(around)], names=["doc", "tag", "at", "gram", "around"])

    return docs.mapInArrow(run, "doc bigint, tag bigint, at int, gram bigint, around bigint")


def _strings(reps: DataFrame, texts: DataFrame, length: int, gram: int, words: bool) -> DataFrame:
    """The symbols around the anchor that stands for each class: gram, around, n, left (symbols ahead of the anchor), string."""
    wanted = reps.groupBy("doc", "tag").agg(F.collect_list(F.struct("at", "gram", "around", "n")).alias("wanted"))
    before = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols(words)
        for batch in slices(batches, "text"):
            out = []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                data = symbols(text).tobytes()
                for w in wanted:
                    lo = max(w["at"] - before, 0)
                    out.append((w["gram"], w["around"], w["n"], w["at"] - lo, data[symbols.size * lo : symbols.size * (w["at"] + length)]))
            names = ("gram", "around", "n", "left", "string")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=list(names))

    joined = texts.join(wanted, ["doc", "tag"]).select("text", "wanted")
    return joined.mapInArrow(run, "gram bigint, around bigint, n bigint, left int, string binary")


def _built(strings: DataFrame, length: int, before: int, words: bool) -> DataFrame:
    """gram, around, lo, hi: ranges of window starts, counted from the anchor, that repeat. One row a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols(words)
        for batch in whole_groups(batches, "gram", BATCH_BYTES):
            gram, left, n = batch.column("gram").to_numpy(), batch.column("left").to_numpy(), batch.column("n").to_numpy()
            data = batch.column("string").to_pylist()
            matrix, end = symbols.matrix(data, left, before, before + length)
            group = np.cumsum(np.concatenate([[0], gram[1:] != gram[:-1]]))
            found = columns(matrix, group, length, before, end)
            whole = np.flatnonzero(n > 1)  # each of its windows is in another place, too
            place = np.arange(before + 1)
            sizes = np.array([len(x) for x in data]) // symbols.size
            begin = before - left
            found[whole] = (place[None, :] >= begin[whole, None]) & (place[None, :] + length <= (begin + sizes)[whole, None])
            row, lo, hi = runs(found)
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(gram[row]), batch.column("around").take(pa.array(row)), pa.array((lo - before).astype(np.int32)), pa.array((hi - before).astype(np.int32))], names=["gram", "around", "lo", "hi"])

    return strings.repartition("gram").sortWithinPartitions("gram", "around").mapInArrow(run, "gram bigint, around bigint, lo int, hi int")


def _pieces(strings: DataFrame, length: int, before: int, width: int, words: bool) -> DataFrame:
    """Each string cut for ranges of `width` offsets, with what all windows of a range share as the new gram. The old gram and the range go into its
    hash, so that one place of a text, reached from two anchors, never meets itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        size = Symbols(words).size
        for batch in slices(batches, "string"):
            out = []
            for gram, around, n, left, x in zip(*(batch.column(c).to_pylist() for c in ("gram", "around", "n", "left", "string"))):
                for o in range(0, min(before, left) + 1, width):
                    # windows that start o to o + width - 1 symbols ahead of the anchor, which moves o symbols to the left
                    lo, hi = max(left - o - width + 1, 0), min(left - o + length, len(x) // size)
                    shared = x[size * (left - o) : size * (left - o - width + 1 + length)]
                    if len(shared) == size * (length - width + 1) and hi - lo >= length:
                        piece = x[size * lo : size * hi]
                        out.append((gram, around, o, n, xxhash.xxh3_64_intdigest(shared, (gram + o * _BASE) % (1 << 64)) - (1 << 63), xxhash.xxh3_64_intdigest(piece, left - o - lo) - (1 << 63), left - o - lo, piece))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["parent", "class", "o", "n", "gram", "around", "left", "string"])

    return strings.mapInArrow(run, "parent bigint, class bigint, o int, n bigint, gram bigint, around bigint, left int, string binary")


def _refined(strings: DataFrame, length: int, before: int, group: int, words: bool) -> DataFrame:
    """As _built(), for groups of any size: pieces of strings collapse where they are equal, and meet in smaller groups."""
    width = -(-(before + 1) // REFINE)
    pieces = cut(_pieces(strings, length, before, width, words), "pieces")
    merged = pieces.groupBy("gram", "around").agg(F.sum("n").alias("n"), F.first("left").alias("left"), F.first("string").alias("string"))
    if width == 1:
        found = merged.filter("n > 1").select("gram", "around", F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    else:
        merged = cut(merged, "strings")
        sizes = merged.groupBy("gram").agg(F.count("*").alias("k"))
        sized = merged.join(sizes, "gram")
        found = _built(sized.filter((F.col("k") <= group) & ((F.col("k") > 1) | (F.col("n") > 1))).drop("k"), length, width - 1, words)
        if not sizes.filter(F.col("k") > group).isEmpty():
            found = found.union(_refined(cut(sized.filter(F.col("k") > group).drop("k"), "strings"), length, width - 1, group, words))
    at = pieces.select("parent", "class", "o", "gram", "around").join(found, ["gram", "around"])
    return at.select(F.col("parent").alias("gram"), F.col("class").alias("around"), (F.col("lo") - F.col("o")).alias("lo"), (F.col("hi") - F.col("o")).alias("hi"))


def _keys(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """The id (a null has a number of its own), and a hash of the text, which tells rows that repeat an id apart."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)).cast("long")), F.xxhash64(text)


def repeated_starts(docs: DataFrame, length: int = LENGTH, gram: int | None = None, group: int = GROUP, words: bool = False) -> tuple[DataFrame, DataFrame]:
    """For documents with columns doc, tag, text: (doc, tag, starts), ranges of the starts of windows that are also elsewhere, as an array of lo, hi
    (a range may go beyond the text's last window); and (doc, tag, text) of documents that may have such windows. Both are written tables."""
    gram = gram or length // 2
    before = length - gram
    every = cut(_anchor_rows(docs.select("doc", "tag", "text"), length, gram, words), "anchors")
    shared = cut(every.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "grams")  # so that a crowded gram can be split in the join
    found = cut(every.join(shared, "gram"), "anchors")
    discard(every)
    discard(shared)
    texts = docs.select("doc", "tag", "text").join(found.select("doc", "tag").distinct(), ["doc", "tag"]).dropDuplicates(["doc", "tag"])
    texts = cut(texts, "texts")
    classes = cut(found.groupBy("gram", "around").agg(F.count("*").alias("n"), F.min(F.struct("doc", "tag", "at")).alias("rep")), "classes")
    sizes = cut(classes.groupBy("gram").agg(F.count("*").alias("k")).filter("k > 1"), "sizes")  # as for grams
    sized = cut(classes.join(sizes, "gram", "left").select("gram", "around", "n", "rep.*", F.coalesce("k", F.lit(1)).alias("k")), "classes")
    discard(classes)
    copies = sized.filter("k = 1").select("gram", "around", F.lit(-before).alias("lo"), F.lit(0).alias("hi"))
    ranges = copies.union(_built(_strings(sized.filter((F.col("k") > 1) & (F.col("k") <= group)), texts, length, gram, words), length, before, words))
    hot = sized.filter(F.col("k") > group)
    strings = None
    if not hot.isEmpty():
        strings = cut(_strings(hot, texts, length, gram, words), "strings")
        ranges = ranges.union(_refined(strings, length, before, group, words))
    at = found.join(ranges, ["gram", "around"]).select("doc", "tag", F.struct((F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi")).alias("r"))
    starts = cut(at.groupBy("doc", "tag").agg(F.collect_list("r").alias("starts")), "starts")
    for done in (found, sizes, sized, strings):
        discard(done)
    return starts, texts


def spans_of(starts: list[dict] | None, n: int, length: int) -> list[tuple[int, int]]:
    """Maximal spans that windows with these starts cover in a text of n symbols."""
    out: list[list[int]] = []
    for lo, hi in sorted((max(r["lo"], 0), min(r["hi"], n - length)) for r in starts or ()):
        if hi < lo:
            continue
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + length)
        else:
            out.append([lo, hi + length])
    return [(a, b) for a, b in out]


def _without(data: bytes | str, spans: list[tuple[int, int]]) -> bytes | str:
    edges = [0, *(x for s in spans for x in s), len(data)]
    return data[:0].join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


_WORD = re.compile(r"\S+")


def _word_spans(text: str, starts: list[dict], length: int) -> list[tuple[int, int]]:
    """Spans of characters, from the first to the last letter of the words that windows with these starts cover."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in spans_of(starts, len(at), length)]


def remove_repeats(docs: DataFrame, length: int | None = None, group: int = GROUP, words: bool = False, removed_col: str | None = "removed") -> DataFrame:
    """docs with what repeats taken out of text, n_chars counted anew if there is such a column, and the column removed_col (one of that name is replaced;
    None: no such column): array of start, end of the spans in the old text, in its bytes, or its characters where symbols are words. Of a
    character that loses a byte nothing stays."""
    length = length or (WORDS if words else LENGTH)
    doc, tag, ranges_col = fresh_names(docs, "doc", "tag", "starts")
    key, text_hash = _keys()
    starts, _ = repeated_starts(docs.select(key.alias("doc"), text_hash.alias("tag"), "text"), length, group=group, words=words)
    starts = starts.toDF(doc, tag, ranges_col)
    joined = docs.withColumns({doc: key, tag: text_hash}).join(starts, [doc, tag], "left").select(*(c for c in docs.columns if c != removed_col), ranges_col)
    fields = [f for f in joined.schema.fields if f.name != ranges_col]
    if removed_col:
        fields.append(T.StructField(removed_col, T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))))
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches, "text"):
            texts, counts, spans = [], [], []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column(ranges_col).to_pylist()):
                got = []
                if ranges and words:
                    got = _word_spans(text, ranges, length)
                    text = _without(text, got)
                elif ranges:
                    data = text.encode()
                    got = spans_of(ranges, len(data), length)
                    text = _without(data, got).decode("utf-8", "ignore")
                texts.append(text)
                counts.append(len(text or ""))
                spans.append([{"start": a, "end": b} for a, b in got])
            new = {"text": pa.array(texts, pa.string())}
            if removed_col:
                new[removed_col] = pa.array(spans, kind)
            if "n_chars" in batch.schema.names and "n_chars" != removed_col:
                new["n_chars"] = pa.array(counts, batch.schema.field("n_chars").type)
            names = [f.name for f in schema.fields]
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names=names)

    return joined.mapInArrow(run, schema)


def remove_passages(docs: DataFrame) -> DataFrame:
    """docs without the passages of WORDS words and more that also occur elsewhere (every occurrence goes, the first, too), with the same columns; for a
    pipeline. A passage of so many words is often shorter than LENGTH bytes, hence words as symbols. n_chars is counted anew."""
    return remove_repeats(docs, words=True, removed_col=None).select(*docs.columns)


def query(docs: DataFrame, length: int = LENGTH, group: int = GROUP, words: int = WORDS) -> DataFrame:
    """The digest columns of op5 for a table of documents, then passage_words: words in passages of `words` words and more that also start elsewhere."""
    key, text_hash = _keys()
    keyed = docs.select("doc_id", key.alias("doc"), text_hash.alias("tag"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist()):
                data = text.encode()
                spans = spans_of(ranges, len(data), length)
                out.append((sum(b - a for a, b in spans), len(spans), hashlib.sha256(_without(data, spans)).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tag"), *(pa.array(c) for c in zip(*out))], names=["doc", "tag", "gone", "spans", "rest"])

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = [sum(b - a for a, b in spans_of(ranges, len(text.split()), words)) for text, ranges in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tag"), pa.array(out, pa.int64())], names=["doc", "tag", "words"])

    def told(length: int, by_words: bool, f: Callable, schema: str) -> DataFrame:
        starts, texts = repeated_starts(keyed, length, group=group, words=by_words)
        out = cut(texts.join(starts, ["doc", "tag"]).mapInArrow(f, schema), "spans")
        discard(starts)
        discard(texts)
        return out

    changed = told(length, False, run, "doc bigint, tag bigint, gone bigint, spans bigint, rest string")
    passages = told(words, True, covered, "doc bigint, tag bigint, words bigint")
    text = F.coalesce("text", F.lit(""))
    base = keyed.select("doc_id", "doc", "tag", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return base.join(changed, ["doc", "tag"], "left").join(passages, ["doc", "tag"], "left").select(
        "doc_id", "n_bytes", whole("gone").alias("n_removed"), whole("spans").alias("n_spans"), F.coalesce("rest", "sha").alias("kept_sha256"), whole("words").alias("passage_words")
    )


#: By brute force: a hash of every window.
ORACLE_SQL = r"""
WITH numbered_documents AS MATERIALIZED (SELECT doc_id, text, row_number() OVER () AS r FROM documents),
d AS (SELECT doc_id, r, hex(encode(coalesce(text, ''))) AS h FROM numbered_documents),
n AS (SELECT *, length(h) // 2 AS n FROM d),
w AS (SELECT r, s, md5(substr(h, 2 * s + 1, 800)) AS k FROM (SELECT r, h, unnest(range(0, n - 399)) AS s FROM n WHERE n >= 400)),
again AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
starts AS (SELECT r, s FROM w SEMI JOIN again USING (k)),
marked AS (SELECT r, s, CASE WHEN s - lag(s) OVER (PARTITION BY r ORDER BY s) <= 400 THEN 0 ELSE 1 END AS fresh FROM starts),
numbered AS (SELECT r, s, sum(fresh) OVER (PARTITION BY r ORDER BY s) AS span FROM marked),
spans AS (SELECT r, min(s) AS a, max(s) + 400 AS b FROM numbered GROUP BY r, span),
edges AS (SELECT r, a, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM spans UNION ALL SELECT n.r, n, coalesce(max(b), 0) FROM n LEFT JOIN spans USING (r) GROUP BY n.r, n),
kept AS (SELECT r, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a, before) AS k FROM edges JOIN n USING (r) GROUP BY r),
gone AS (SELECT r, sum(b - a) AS removed, count(*) AS spans FROM spans GROUP BY r),
split AS (SELECT r, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS l FROM numbered_documents),
pw AS (SELECT r, s, md5(array_to_string(l[s : s + 49], ' ')) AS k FROM (SELECT r, l, unnest(range(1, len(l) - 48)) AS s FROM split WHERE len(l) >= 50)),
pagain AS (SELECT k FROM pw GROUP BY k HAVING count(*) > 1),
pstarts AS (SELECT r, s, coalesce(lead(s) OVER (PARTITION BY r ORDER BY s), s + 50) - s AS step FROM pw SEMI JOIN pagain USING (k)),
pwords AS (SELECT r, sum(least(step, 50)) AS words FROM pstarts GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256,
  CAST(coalesce(words, 0) AS BIGINT) AS passage_words
FROM n JOIN kept USING (r) LEFT JOIN gone USING (r) LEFT JOIN pwords USING (r)
"""
