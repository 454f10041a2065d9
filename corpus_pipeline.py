"""A corpus pipeline of five operators: quality, near copies, repeated passages, mixing, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written and read again as the next one's docs. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm import bpe, mixing, quality, simhash, suffix_dedup
from voxlake.llm.common import stash, table
from voxlake.llm.registry import vocabulary_json

#: No SQL expresses the classifier; the tests compare the stages with plain versions.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays."""
    return simhash.one_of_each(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of some 50 words (``PASSAGE`` bytes) that repeat are cut out; n_chars follows the text."""
    return suffix_dedup.without_repeats(docs, suffix_dedup.PASSAGE)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, and none goes, so that the languages' tokens come nearest to the target weights."""
    return mixing.mixed(docs, docs.where("lang IS NOT NULL").select("doc_id", F.col("lang").alias("domain")), floor=1.0)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) and the digest of their decoding."""
    out = bpe.encode_and_decode(docs, vocabulary_json())
    return out.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", simhash_stage),
    ("suffix-array dedup", suffix_stage),
    ("mixing to target weights", mixing_stage),
    ("bpe encoding", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, f"stage-{k}")
    return docs
