"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netloom.llm import bpe, chat, embeddup, minhash, packing, sharding, suffix, tokencount, topk, toxicity
from netloom.llm._spark import table, tokenizer_file

BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": lambda s, d: chat.query(table(s, d, "conversations")),
    "op2_bpe": lambda s, d: bpe.query(table(s, d, "documents"), tokenizer_file(BYTE_BPE)),
    "op3_embedding_neardup": lambda s, d: embeddup.query(table(s, d, "embeddings")),
    "op4_minhash": lambda s, d: minhash.query(table(s, d, "documents")),
    "op5_suffix_array": lambda s, d: suffix.query(table(s, d, "documents")),
    "op6_token_counts": lambda s, d: tokencount.query(table(s, d, "documents"), tokenizer_file(PIECES)),
    "op7_toxicity": lambda s, d: toxicity.query(table(s, d, "documents"), table(s, d, "labels")),
    "op8_topk": lambda s, d: topk.query(table(s, d, "embeddings")),
    "op9_packing": lambda s, d: packing.query(table(s, d, "documents"), tokenizer_file(BYTE_BPE)),
    "op10_sharding": lambda s, d: sharding.query(table(s, d, "documents")),
}

ORACLES: dict[str, str] = {
    "op1_chat_format": chat.ORACLE_SQL,
    "op3_embedding_neardup": embeddup.ORACLE_SQL,
    "op5_suffix_array": suffix.ORACLE_SQL,
    "op8_topk": topk.ORACLE_SQL,
    "op10_sharding": sharding.ORACLE_SQL,
}
