"""Token counts without tokens: the best segmentation's size under a unigram vocabulary.

An Aho-Corasick automaton enumerates the pieces that end at each character; dynamic programming carries the best score and the number of pieces
that reach it. Rules are those of the tokenizers library's Unigram model: a piece replaces the best so far only if its score is higher, the
earliest start comes first, and a character that no piece of one character covers may be unknown at the lowest score less 10. Unknown
characters count as their UTF-8 bytes if the vocabulary has byte pieces, else each run of them counts once.

Spaces become the mark U+2581, and one is put in front of a text. Pieces bear that mark at their start only and their scores are whole numbers,
so a text falls apart exactly into units that start with marks; a unit is counted once and kept in a bounded cache. A
vocabulary without both properties is applied to whole texts instead.

Null and empty texts have 0 tokens. Repeated rows are counted alike; other columns pass through, but for one named n_tokens.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from netloom.llm._spark import slices, texts_of

MARK = "▁"
UNKNOWN_PENALTY = 10.0
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class UnigramCounter:
    """vocabulary: (piece, score) of ordinary pieces. lowest: the least score of all pieces, special ones included."""

    def __init__(self, vocabulary: list[tuple[str, float]], lowest: float | None = None, byte_fallback: bool = True, cache: int = 1 << 19):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece and not self.automaton.exists(piece):
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = (min(s for _, s in vocabulary) if lowest is None else lowest) - UNKNOWN_PENALTY
        self.byte_fallback, self.limit = byte_fallback, cache
        self.apart = all(MARK not in p.lstrip(MARK) and float(s).is_integer() for p, s in vocabulary) and MARK in self.single
        self.cache: dict[str, int] = {}

    def segment_size(self, text: str) -> int:
        """The number of pieces of the best segmentation of a text whose spaces are marks already."""
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        size, open_run = [0] * (n + 1), [False] * (n + 1)  # open_run: the last piece is unknown
        best[0] = 0.0
        matches = self.automaton.iter(text)
        pending = next(matches, None)
        for end in range(1, n + 1):
            top, count, run = None, 0, False
            while pending is not None and pending[0] == end - 1:  # the longest piece comes first
                length, score = pending[1]
                start = end - length
                value = best[start] + score
                if top is None or value > top:
                    top, count, run = value, size[start] + 1, False
                pending = next(matches, None)
            letter = text[end - 1]
            if letter not in self.single:
                value = best[end - 1] + self.unknown
                if top is None or value > top:
                    top, run = value, True
                    count = size[end - 1] + (len(letter.encode()) if self.byte_fallback else not open_run[end - 1])
            best[end], size[end], open_run[end] = top, count, run
        return size[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        if not self.apart:
            return self.segment_size(text)
        units, cache = _UNIT.findall(text), self.cache
        try:
            return sum(map(cache.__getitem__, units))
        except KeyError:
            if len(cache) > self.limit:
                cache.clear()
            for u in set(units).difference(cache):
                cache[u] = self.segment_size(u)
            return sum(map(cache.__getitem__, units))


@functools.lru_cache(1)
def load(path: str) -> UnigramCounter:
    """The pieces and scores of a sentencepiece model file, used as a unigram vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.vocab_size())
    plain = [(model.id_to_piece(i), float(model.get_score(i))) for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    return UnigramCounter(plain, min(float(model.get_score(i)) for i in ids), any(model.is_byte(i) for i in ids))


def count_tokens(df: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """df with n_tokens of each whole text; one pass without a shuffle, in memory bounded by the cache and the longest text."""
    df = df.drop("n_tokens")
    schema = T.StructType([*df.schema.fields, T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(model_path)
        for batch in slices(batches, text_col):
            n = pa.array([counter.count(x) for x in texts_of(batch, text_col)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n], names=[*batch.schema.names, "n_tokens"])

    return df.mapInArrow(run, schema)


def query(docs: DataFrame, model_path: str) -> DataFrame:
    """op6: the token count of each document."""
    return count_tokens(docs.select("doc_id", "text"), model_path).select("doc_id", "n_tokens")
