"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lowered, shingles are three
words joined by a space, a shingle's hash is XXH64 of its UTF-8 bytes (seed 42),
and a bit of the fingerprint is set when it is set in over half of the hashes.

Two fingerprints within three bits either agree or differ in at least one of
three blocks of the 64 bits. With that block erased at most two bits differ,
and half of that radius is one: every fingerprint emits, for each erased block,
the rest and all its one-bit variants (131 rows in all). Fingerprints that meet
on a variant are candidates; a pair is accepted only at its canonical variant,
so it comes out once, and only if at most three of all 64 bits differ.

Defined results: a null or wordless text has fingerprint zero; fewer than three
words make one shingle; rows with equal texts share a fingerprint; an empty
table gives no rows; a null doc_id is kept and never becomes a component id
while a non-null one exists. Extra columns of the input are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, row_key, ship, stash, text_digest

ship(__name__)

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_GAPS = re.compile(rb"[\x20\x09-\x0D]+")
_BIT_TABLE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PIECE = 1 << 16


def _bit_counts(hashes: list[int]) -> np.ndarray:
    """How many of the hashes set each of the 64 bits, by a histogram of each byte."""
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BIT_TABLE for k in range(8)])


def fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit integer; shingles are taken in pieces, so memory stays bounded."""
    words = [w for w in _GAPS.split((text or "").encode("utf-8", "replace").translate(_LOWER)) if w]
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    stops = ends[min(SHINGLE_WORDS, len(words)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _PIECE):
        counts += _bit_counts([digest(line[a:b], SEED) for a, b in zip(starts[at : at + _PIECE], stops[at : at + _PIECE])])
    value = int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")
    return value - (1 << 64) if value >> 63 else value


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _blocks() -> list[tuple[int, int, list[int]]]:
    """For each block: mask of the bits that stay, a mark in the erased bits, the one-bit flips."""
    spans, out = [(0, 22), (22, 43), (43, 64)], []
    for k, (low, high) in enumerate(spans):
        erased = ((1 << high) - 1) ^ ((1 << low) - 1)
        keep = ((1 << 64) - 1) ^ erased
        out.append((_signed(keep), k << low, [_signed(1 << i) for i in range(64) if keep >> i & 1]))
    return out


def variants(nodes: DataFrame) -> DataFrame:
    """Rows ``(key, fp)``: each fingerprint's ball of radius one around each of its erased forms."""
    plans = [(keep, _signed((mark ^ flip) & ((1 << 64) - 1))) for keep, mark, flips in _blocks() for flip in [0, *flips]]
    masks = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(x).cast("long").alias("x")) for k, x in plans])
    ball = F.transform(masks, lambda m: F.col("fp").bitwiseAND(m["k"]).bitwiseXOR(m["x"]))
    return nodes.select("fp", F.explode(F.array_distinct(ball)).alias("key"))


def links(nodes: DataFrame) -> DataFrame:
    """Pairs ``(u, v)``, u < v, of distinct fingerprints with at most three differing bits, each once."""
    v = variants(nodes)
    cases = []
    for keep, mark, _ in _blocks():
        rest = f"((a.fp ^ b.fp) & {keep}L)".replace("-9223372036854775808L", "(-9223372036854775807L - 1L)")
        cases.append(f"WHEN bit_count({rest}) <= 2 THEN ((a.fp & {keep}L) ^ {mark}L) ^ CASE WHEN bit_count({rest}) = 2 THEN {rest} ^ ({rest} & ({rest} - 1L)) ELSE 0L END")
    at_home = f"a.key = CASE {' '.join(cases)} END"
    condition = F.expr("a.key = b.key AND a.fp < b.fp") & F.expr(f"bit_count(a.fp ^ b.fp) <= {RADIUS}") & F.expr(at_home)
    # a merge join whatever the statistics say: they don't know that each row became 131
    return v.alias("a").hint("merge").join(v.alias("b").hint("merge"), condition).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def _rooted(prints: DataFrame, row: Column) -> DataFrame:
    """``(fp, first, root)``: of each fingerprint the least ``row`` and the root of its component."""
    nodes = stash(prints.groupBy("fp").agg(F.min(row).alias("first")), "nodes")
    found = components(links(nodes))
    return nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row: fingerprint and least doc_id reachable over links."""
    prints = stash(docs.select("doc_id", _fingerprints(F.col("text")).alias("fp")), "fingerprints")
    roots = _rooted(prints, F.col("doc_id"))
    named = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = roots.join(named, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def op1_simhash_near_dedup(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Keep one row of every group: of its rows with the least doc_id (null last) one with the least digest of its text.

    Rows are known by doc_id and a 128-bit digest of the text, so null and repeated ids keep a row in each of their groups."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), row_key().alias("key"), text_digest().alias("digest"))
    prints = stash(rows.select("row.doc_id", "key", "digest", _fingerprints(F.col("row.text")).alias("fp")), "fingerprints")
    roots = _rooted(prints, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "digest"))
    keep = roots.groupBy("root").agg(F.min("first").alias("first")).select("first.key", "first.digest")
    # copies go before texts travel, so a large group of them does not meet in one task
    return rows.dropDuplicates(["key", "digest"]).join(keep, ["key", "digest"], "left_semi").select("row.*")
