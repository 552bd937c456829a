"""Byte-level BPE: encoding with reuse of content-defined chunks, and decoding.

A rolling hash over the bytes cuts each text into chunks that start at the same places wherever a passage
recurs. A chunk is encoded once and kept in a bounded cache, so passages that documents share are not encoded
again. A cut may fall inside a word, where tokens of two chunks don't join up to the tokens of the whole text;
there a window around the join is encoded anew and widened until its first and last tokens agree with those of
the chunks on both sides. Windows begin and end in front of white space that follows a visible character, which
no token crosses, so agreement there means agreement with the encoding of the whole text.

Nulls count as empty texts, which have no tokens. Repeated rows give repeated results; columns other than the
text pass through, and the result column replaces a column of the same name.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm._spark import slices, texts_of

#: Fixed value: the word pattern of byte-level BPE as its authors published it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: One cut in so many bytes on average, and bytes of text that the cache of a task may hold.
CHUNK_BITS, CACHE_BYTES = 10, 24 << 20
#: Bytes that the rolling hash sees.
HASH_WINDOW = 16

_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[9, 10, 13, 32]] = True
#: Bytes that can't end a white-space character: visible ASCII, and of the others those that end none in Unicode.
_VISIBLE_END = np.zeros(256, bool)
_VISIBLE_END[0x21:0x7F] = True
_VISIBLE_END[0x80:] = True
_VISIBLE_END[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _gears() -> np.ndarray:
    """A 32-bit number for each byte, from a multiplicative rule."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(17)
    x = (x ^ (x >> np.uint64(13))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x >> np.uint64(32)).astype(np.uint32)


class ByteBpe:
    """A byte-level BPE from a tokenizers JSON file; encode() gives the ids of the tokenizers library with add_special_tokens=False."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        letters = byte_letters()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = {k: v for k, v in model["vocab"].items() if k not in self.special}
        raw = {bytes(letters[c] for c in k): v for k, v in vocab.items()}
        merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
        plain = (
            spec["normalizer"] is None
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and not (model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
            and merged == sorted(merged)
            and all(not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) for x in spec["added_tokens"])
        )
        if plain:  # ids rank the merges, so an encoder by ranks gives the same tokens and is faster
            import tiktoken

            self._fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=raw, special_tokens=self.special)
        else:
            from tokenizers import Tokenizer

            self._fast, self._slow = None, Tokenizer.from_file(path)
            self._slow.no_truncation()
            self._slow.no_padding()
        n = max([*raw.values(), *self.special.values()]) + 1
        self.pieces: list[bytes] = [b""] * n
        for k, v in raw.items():
            self.pieces[v] = k
        for k, v in self.special.items():
            self.pieces[v] = k.encode()
        self.piece_bytes = np.array([len(x) for x in self.pieces], np.int64)

    def encode(self, text: str) -> list[int]:
        if self._fast is None:
            return self._slow.encode(text, add_special_tokens=False).ids
        if any(x in text for x in self.special):
            return self._fast.encode(text, allowed_special="all")
        return self._fast.encode_ordinary(text)

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, special tokens stay."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


class ChunkedEncoder:
    """Encodes texts by chunks; encodings of chunks and windows stay in a cache of two generations that is bounded in bytes."""

    def __init__(self, bpe: ByteBpe, chunk_bits: int = CHUNK_BITS, cache_bytes: int = CACHE_BYTES):
        self.bpe, self.mask, self.limit = bpe, np.uint32((1 << chunk_bits) - 1), cache_bytes
        self.new: dict[str, np.ndarray] = {}
        self.old: dict[str, np.ndarray] = {}
        self.held = 0
        self.hits = self.misses = self.widened = 0
        self.gears = _gears()

    def ids(self, piece: str) -> np.ndarray:
        got = self.new.get(piece)
        if got is None:
            got = self.old.get(piece)
            if got is None:
                got = np.array(self.bpe.encode(piece), np.int32)
                self.misses += 1
            else:
                self.hits += 1
            self.held += len(piece) + got.nbytes
            if self.held > self.limit:
                self.new, self.old, self.held = {}, self.new, 0
            self.new[piece] = got
        else:
            self.hits += 1
        return got

    def cuts(self, raw: np.ndarray) -> np.ndarray:
        """Where the rolling hash of the bytes before asks for a cut, at starts of characters only."""
        if len(raw) <= 2 * HASH_WINDOW:
            return np.empty(0, np.int64)
        h = self.gears[raw]
        step = 1
        while step < HASH_WINDOW:
            nxt = h.copy()
            nxt[step:] += h[:-step] << np.uint32(step)
            h, step = nxt, 2 * step
        at = np.flatnonzero((h[HASH_WINDOW - 1 : -1] >> np.uint32(7)) & self.mask == 0) + HASH_WINDOW
        return at[(raw[at] & 0xC0) != 0x80]

    def encode(self, text: str) -> np.ndarray:
        data = text.encode()
        raw = np.frombuffer(data, np.uint8)
        cuts = self.cuts(raw)
        if not len(cuts):
            return self.ids(text)
        n = len(data)
        safe = np.flatnonzero(_ASCII_SPACE[raw[1:]] & _VISIBLE_END[raw[:-1]]) + 1
        edges = [0, *cuts.tolist(), n]
        chunks = [self.ids(data[a:b].decode()) for a, b in zip(edges, edges[1:])]
        ends = [np.cumsum(self.bpe.piece_bytes[c]) + a for c, a in zip(chunks, edges)]

        def span(lo: int, hi: int, first: int) -> np.ndarray | None:
            """Tokens of the chunks over bytes lo to hi, if tokens begin and end there; first: the chunk that holds lo."""
            parts, k = [], first
            while lo < hi:
                b = min(hi, edges[k + 1])
                i = np.searchsorted(ends[k], lo, "right") if lo > edges[k] else 0
                j = np.searchsorted(ends[k], b, "left") + 1
                if lo > edges[k] and (i == 0 or ends[k][i - 1] != lo) or ends[k][j - 1] != b:
                    return None
                parts.append(chunks[k][i:j])
                lo, k = b, k + 1
            return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.int32)

        out, done, k = [], 0, 0  # done: bytes whose tokens are in out
        at_chunk = 0
        while k < len(cuts):
            s = int(np.searchsorted(safe, cuts[k], "left"))
            wide, e_wide = 1, 1
            while True:
                a = int(safe[s - 1 - wide]) if s - 1 - wide >= 0 else 0
                if a < done:
                    a = done
                t = int(np.searchsorted(safe, cuts[k], "right"))
                last = k
                while True:  # joins that the window reaches are repaired with it
                    e = int(safe[t + e_wide]) if t + e_wide < len(safe) else n
                    nxt = int(np.searchsorted(cuts, e, "right")) - 1
                    if nxt <= last or e == n:
                        break
                    last = nxt
                    t = int(np.searchsorted(safe, cuts[last], "right"))
                last = max(last, int(np.searchsorted(cuts, e, "left")) - 1)
                window = self.ids(data[a:e].decode())
                w_ends = np.cumsum(self.bpe.piece_bytes[window]) + a
                # the tokens before the last safe place ahead of the first join, and after the first behind the last, must agree
                left = int(safe[s - 1]) if s >= 1 and safe[s - 1] > a else a
                right_i = int(np.searchsorted(safe, cuts[last], "right"))
                right = int(safe[right_i]) if right_i < len(safe) and safe[right_i] < e else e
                ok = True
                if left > a and a >= edges[k]:
                    mine = span(a, left, k)
                    ok = mine is not None and np.array_equal(window[: len(mine)], mine)
                if ok and right < e and e <= edges[last + 2]:
                    mine = span(right, e, last + 1)
                    ok = mine is not None and (not len(mine) or np.array_equal(window[-len(mine) :], mine))
                if ok and a > done:
                    ok = span(done, a, at_chunk) is not None
                if ok or (a <= done and e == n):
                    break
                self.widened += 1
                wide, e_wide = 2 * wide + 1, 2 * e_wide + 1
            if a > done:
                out.append(span(done, a, at_chunk))
            out.append(window)
            done = e
            k = last + 1
            at_chunk = int(np.searchsorted(cuts, done, "right"))
        if done < n:
            rest = span(done, n, at_chunk)
            out.append(rest if rest is not None else self.ids(data[done:].decode()))
        return np.concatenate(out)


def _with(df: DataFrame, column: str, kind: T.DataType) -> tuple[DataFrame, T.StructType]:
    df = df.drop(column)
    return df, T.StructType([*df.schema.fields, T.StructField(column, kind)])


def encode_documents(df: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """df with the column ids_col: the token ids of each whole text.

    One pass over the table without a shuffle: what documents of a task share is encoded once there. Memory is bounded by
    the cache and the longest text.
    """
    df, schema = _with(df, ids_col, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkedEncoder(load(tokenizer_path), chunk_bits)
        for batch in slices(batches, text_col):
            got = [encoder.encode(x) for x in texts_of(batch, text_col)]
            offsets = np.zeros(len(got) + 1, np.int32)
            np.cumsum([len(x) for x in got], out=offsets[1:])
            values = pa.array(np.concatenate(got) if got else np.empty(0, np.int32))
            ids = pa.ListArray.from_arrays(pa.array(offsets), values)
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, ids_col])

    return df.mapInArrow(run, schema)


def decode_documents(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with the column out_col: the text of each row's ids, special tokens included. Null ids give the empty text."""
    df, schema = _with(df, out_col, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for batch in slices(batches, ids_col):
            column = batch.column(ids_col)
            ids = column.flatten().to_numpy(zero_copy_only=False).tolist()
            texts, at = [], 0
            for n in column.value_lengths().to_pylist():
                n = n or 0
                texts.append(bpe.decode(ids[at : at + n]))
                at += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out_col])

    return df.mapInArrow(run, schema)


def query(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The digest columns of op2 for a table of documents."""
    encoded = encode_documents(docs.select("doc_id", "text"), tokenizer_path).drop("text")
    both = decode_documents(encoded, tokenizer_path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
