"""Queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, hnsw, langid, mixing, oracles, quality, sharding, simhash, suffix_dedup, winnowing
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


#: Where the vocabulary files are, unless the library that carries them is installed.
TOKENIZERS = "/opt/tokenizers"


def vocabulary_json(name: str = "word_bpe_49k.json") -> str:
    """The text of a public vocabulary file; its folder is a parameter of this module."""
    found = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(found.origin) if found else TOKENIZERS
    with open(os.path.join(folder, name), encoding="utf-8") as file:
        return file.read()


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.op2_mixing(docs, docs.where("lang IS NOT NULL").selectExpr("doc_id", "lang AS domain"))


def queries() -> dict[str, Query]:
    return {
        "op1_simhash_near_dedup": lambda s, d: simhash.op1_simhash_near_dedup(table(s, d, "documents")),
        "op2_source_mixing": op2,
        "op3_suffix_array_dedup": lambda s, d: suffix_dedup.op3_suffix_array_dedup(table(s, d, "documents")),
        "op4_quality_classifier": lambda s, d: quality.op4_quality(table(s, d, "documents"), table(s, d, "labels")),
        "op5_document_fingerprints": lambda s, d: winnowing.op5_document_fingerprints(table(s, d, "documents")),
        "op6_chat_formatting": lambda s, d: chat.op6_chat_formatting(table(s, d, "conversations")),
        "op7_embedding_near_dedup": lambda s, d: hnsw.op7_embedding_near_dedup(table(s, d, "embeddings")),
        "op8_bpe_encode_decode": lambda s, d: bpe.op8_bpe(table(s, d, "documents"), vocabulary_json()),
        "op9_sharding": lambda s, d: sharding.op9_sharding(table(s, d, "documents")),
        "op10_language_id": lambda s, d: langid.op10_language_id(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_suffix_array_dedup": oracles.SUFFIX,
        "op6_chat_formatting": oracles.CHAT,
        "op7_embedding_near_dedup": oracles.VECTORS,
    }
