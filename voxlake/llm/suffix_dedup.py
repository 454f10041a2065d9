"""Suffix-array deduplication: bytes covered by a string of ``length`` bytes that starts anywhere else.

The suffixes of all bytes would be more rows than a cluster can shuffle in
reasonable space, so the difference cover is laid in two steps.

*Sampled positions.* Of every ``SPAN`` neighbouring positions the one whose
16-byte gram has the least hash is an anchor (rightmost of equals). Equal
strings of ``length`` bytes thus have their first anchor at the same offset, and
``length - SPAN + 1`` bytes after it. An anchor's symbol names these bytes and
the distance to the next anchor. Anchors whose bytes occur at one place
only cannot lie in a repeated string and are dropped; what is left are strings
of symbols, about one for fifty bytes of repeated text. Keys that a sixteenth of
the texts shows to be frequent are known to be repeated and are dealt by place.

*Suffix array.* These strings are sorted by the distributed difference-cover
algorithm of ``suffix_order`` (sampled triples, recursion on names, merge of
the rest). Neighbours in that order are compared symbol by symbol; the longest
prefix that an anchor shares with a neighbour is a repeated string of bytes, and
every string of ``length`` bytes inside it is repeated.

*Ends.* The suffixes between anchors are merged last: a repeated string may
begin before its first anchor and end inside its last symbol. Anchors with a
string that the suffix array leaves undecided meet all anchors with
the same bytes after them, each with its whole surroundings, and every string
is compared there (by offset and 128-bit hash); decided anchors bear witness
once for equal surroundings. Groups of over ``CROWD`` anchors, which
a task should not hold, send single strings instead, which the shuffle spreads.

Copies of a whole text are read once; a text of ``length`` bytes or more that occurs
twice is removed whole.

Defined results: a null text counts as empty; texts shorter than ``length`` lose
nothing; strings are judged on the input; rows with equal doc_id are rows of
their own; an empty table gives no rows; extra columns are ignored by the query
and kept by ``without_repeats``, which drops the remains of a character that
lost some of its bytes.

``LENGTH`` is the query's. ``PASSAGE`` bytes, some 50 words, are what a corpus
pipeline cuts, which must also catch passages shorter than 400 bytes.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, returning, ship, stash, tidy
from .suffix_order import places, suffix_ranks

ship(__name__)

LENGTH = 400
PASSAGE = 272
GRAM = 16
SPAN = 96
DEPTH = 9
CROWD = 1 << 16
LEAST = 2 * SPAN
#: Keys that occur ``HOT`` times in a sixteenth of the texts, the most frequent ``HOT_KEYS`` of them.
HOT = 32
HOT_KEYS = 1 << 12
_LOW = np.uint64(127)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    n = len(data) - GRAM + 1
    words = np.empty(n + 8, np.uint64)
    for j in range(8):
        part = np.frombuffer(data[j : j + (len(data) - j) // 8 * 8].tobytes(), "<u8")
        words[j::8] = part[: len(words[j::8])]
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15) ^ words[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def anchors(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors, and the first and last start of the strings of ``length`` bytes whose first anchor each is."""
    starts = len(data) - length + 1
    if starts <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    h = _gram_hashes(np.frombuffer(data, np.uint8))
    blocks = -(-len(h) // SPAN) + 1
    key = np.full(blocks * SPAN, np.iinfo(np.uint64).max, np.uint64)
    key[: len(h)] = h
    key = (key & ~_LOW).reshape(blocks, SPAN) | (_LOW - np.arange(SPAN, dtype=np.uint64))
    ahead = np.minimum.accumulate(key, 1).ravel()
    back = np.minimum.accumulate(key[:, ::-1], 1)[:, ::-1].ravel()
    p = np.arange(starts)
    left, right = back[p], ahead[p + SPAN - 1]
    take = (right | _LOW) <= (left | _LOW)
    block = np.where(take, (p + SPAN - 1) // SPAN, p // SPAN)
    at = block * SPAN + (_LOW - (np.where(take, right, left) & _LOW)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], first, np.concatenate([first[1:] - 1, [starts - 1]])


def _positive(x: int) -> int:
    return x & ((1 << 63) - 1)


def _anchor_rows(batches, length, hot=()):
    """Of (tid, text): ``(bytes_key, tid, packed, hot)`` of each anchor; a text that a task has met is not parsed again."""
    schema = pa.schema([("bytes_key", pa.int64()), ("tid", pa.int64()), ("packed", pa.int64()), ("hot", pa.bool_())])
    met: set[int] = set()
    for batch in (b for whole in batches for b in pieces(whole, 256)):
        for tid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = (text or "").encode("utf-8", "replace")
            if len(data) < length or tid in met:
                continue
            if len(met) < 1 << 20:
                met.add(tid)
            s, lo, hi = anchors(data, length)
            view = memoryview(data)
            for at in range(0, len(s), 1 << 16):
                c, a, b = s[at : at + (1 << 16)], lo[at : at + (1 << 16)], hi[at : at + (1 << 16)]
                gap = np.diff(np.append(c, s[at + len(c)] if at + len(c) < len(s) else c[-1]))
                keys = [_positive(xxhash.xxh3_64_intdigest(view[i : i + length - SPAN + 1])) for i in c.tolist()]
                packed = (c << 24) | ((c - a) << 16) | ((c - b) << 8) | gap
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.full(len(c), tid), pa.int64()), pa.array(packed, pa.int64()), pa.array([k in hot for k in keys], pa.bool_())], schema=schema)


def _flat(batch, *fields: str):
    """Of a batch of (tid, found): for each row the number of found, and the fields of all found end to end."""
    found = batch.column(1)
    sizes = np.diff(found.offsets.to_numpy())
    flat = found.flatten()
    return batch.column(0).to_numpy(), sizes, *(flat.field(f).to_numpy(zero_copy_only=False) for f in fields)


def _strings(batches, length):
    """Of texts with their repeated anchors: rows of the reduced strings. A string ends where the next anchor was dropped."""
    schema = pa.schema([("sid", pa.int64()), ("pos", pa.int64()), ("sym", pa.int64()), ("packed", pa.int64()), ("bytes_key", pa.int64()), ("ahead", pa.list_(pa.int64())), ("reach", pa.list_(pa.int32()))])
    for batch in (b for whole in batches for b in pieces(whole, 256)):
        tids, sizes, packed, keys = _flat(batch, "packed", "bytes_key")
        if not len(packed):
            continue
        text = np.repeat(np.arange(len(tids)), sizes)
        order = np.lexsort((packed, text))
        packed, keys = packed[order], keys[order]
        s, gap = packed >> 24, packed & 255
        cut = np.append(True, (s[:-1] + gap[:-1] != s[1:]) | (text[:-1] != text[1:]))
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (gap.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xC2B2AE3D27D4EB4F)
        symbols = (mixed >> np.uint64(1)).astype(np.int64)
        # of each anchor as many symbols of its string as it takes to decide any string that begins within two spans after it
        ends = np.append(np.flatnonzero(cut)[1:], len(s))[np.cumsum(cut) - 1]
        line = s + text * (1 << 40)
        far = np.searchsorted(line, line + 3 * SPAN - 1, "right") + 1
        n = np.minimum(ends, np.maximum(np.arange(len(s)) + 1, far)) - np.arange(len(s))
        offsets = np.append(0, np.cumsum(n))
        at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - np.arange(len(s)), n)
        ahead = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(symbols[at]))
        reach = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array((s[at] - np.repeat(s, n) + length - SPAN + 1).astype(np.int32)))
        pos = np.arange(len(s)) + np.cumsum(cut)
        yield pa.RecordBatch.from_arrays([pa.array(tids[text]), pa.array(pos), pa.array(symbols), pa.array(packed), pa.array(keys), ahead, reach], schema=schema)


def _undecided(batches, length):
    """Of texts with their anchors and longest repeats: every anchor, whether a string of it is undecided."""
    schema = pa.schema([("tid", pa.int64()), ("bytes_key", pa.int64()), ("packed", pa.int64()), ("undecided", pa.bool_()), ("begin", pa.int64()), ("end", pa.int64())])
    for batch in (b for whole in batches for b in pieces(whole, 256)):
        tids, sizes, packed, keys, m = _flat(batch, "packed", "bytes_key", "m")
        if not len(packed):
            continue
        text = np.repeat(np.arange(len(tids)), sizes)
        order = np.lexsort((packed, text))
        packed, keys, m = packed[order], keys[order], m[order].astype(np.int64)
        shift = text * (1 << 40)
        s = packed >> 24
        lo, hi = s - (packed >> 16 & 255), s - (packed >> 8 & 255)
        # all strings of an anchor are decided by a repeat that begins before the first and ends after the last
        far = np.append(0, np.maximum.accumulate(s + shift + m))
        open_ = far[np.searchsorted(s + shift, lo + shift, "right")] < hi + shift + length
        known = m >= length
        yield pa.RecordBatch.from_arrays([pa.array(tids[text]), pa.array(keys), pa.array(packed), pa.array(open_), pa.array(np.where(known, s, 0)), pa.array(np.where(known, s + m, 0))], schema=schema)


def _surroundings(batches, length):
    """Of (text, anchors to compare): each anchor with the bytes of all its strings.

    A decided anchor only bears witness, so a task sends one of those with equal surroundings."""
    schema = pa.schema([("bytes_key", pa.int64()), ("tid", pa.int64()), ("packed", pa.int64()), ("undecided", pa.bool_()), ("crowded", pa.bool_()), ("around", pa.binary())])
    met: set[int] = set()
    sent: set[bytes] = set()
    for batch in (b for whole in batches for b in pieces(whole, 256)):
        for tid, text, found in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if tid in met:
                continue
            met.add(tid)
            data = (text or "").encode("utf-8", "replace")
            rows = []
            for f in found:
                s = f["packed"] >> 24
                around = data[s - (f["packed"] >> 16 & 255) : s - (f["packed"] >> 8 & 255) + length]
                if not f["undecided"]:
                    mark = xxhash.xxh3_128_digest(around) + (f["packed"] >> 8 & 65535).to_bytes(2, "little")
                    if mark in sent:
                        continue
                    if len(sent) < 1 << 17:
                        sent.add(mark)
                rows.append((f["bytes_key"], tid, f["packed"], f["undecided"], f["crowded"], around))
            for at in range(0, len(rows), 4096):
                part = rows[at : at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], field.type) for k, field in enumerate(schema)], schema=schema)


def _bounds(packed: int) -> tuple[int, int, int]:
    """Place of the anchor, first and last start of its strings."""
    s = packed >> 24
    return s, s - (packed >> 16 & 255), s - (packed >> 8 & 255)


def _runs(starts: list[int], length: int) -> list[tuple[int, int]]:
    """Bytes covered by strings at these starts, as (begin, end)."""
    out: list[list[int]] = []
    for p in sorted(starts):
        if out and p <= out[-1][1]:
            out[-1][1] = p + length
        else:
            out.append([p, p + length])
    return [tuple(x) for x in out]


def repeated_in_group(group: dict, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """Spans (tid, begin, end) of the undecided anchors' strings that occur twice, or at a decided anchor.

    ``group`` holds (tid, packed) -> (undecided, surroundings); offset after offset, so only the strings of one are held."""
    members = [(tid, *_bounds(packed), undecided, memoryview(around)) for (tid, packed), (undecided, around) in group.items()]
    starts: dict[tuple, list[int]] = {}
    if not any(m[4] for m in members):
        return []
    for o in range(min(s - hi for _, s, _, hi, _, _ in members), max(s - lo for _, s, lo, _, _, _ in members) + 1):
        seen: dict[bytes, int] = {}
        here = []
        for k, (_, s, lo, hi, undecided, around) in enumerate(members):
            p = s - o
            if lo <= p <= hi:
                h = xxhash.xxh3_128_digest(around[p - lo : p - lo + length])
                seen[h] = seen.get(h, 0) + (1 if undecided else 2)
                if undecided:
                    here.append((k, p, h))
        for k, p, h in here:
            if seen[h] > 1:
                starts.setdefault(k, []).append(p)
    return [(members[k][0], a, b) for k, ps in starts.items() for a, b in _runs(ps, length)]


def _compared(frames, length):
    """Of partitions sorted by bytes_key: the spans of every group's repeated strings."""
    key, group = None, {}  # copies of a text send an anchor once more
    done: list[tuple[int, int, int]] = []
    frame_of = lambda rows: pd.DataFrame(rows, columns=["tid", "begin", "end"])
    for frame in frames:
        for k, tid, packed, undecided, around in zip(frame["bytes_key"], frame["tid"], frame["packed"], frame["undecided"], frame["around"]):
            if k != key and group:
                done += repeated_in_group(group, length)
                group.clear()
            key = k
            group[tid, int(packed)] = (undecided, around)
        if len(done) > 10_000:
            yield frame_of(done)
            done = []
    yield frame_of(done + repeated_in_group(group, length))


def _single_strings(frames, length):
    for frame in frames:
        rows = []
        for k, tid, packed, undecided, around in zip(frame["bytes_key"], frame["tid"], frame["packed"], frame["undecided"], frame["around"]):
            s, lo, hi = _bounds(int(packed))
            rows += [(k, tid, s - p, p, undecided, xxhash.xxh3_128_digest(around[p - lo : p - lo + length])) for p in range(lo, hi + 1)]
        yield pd.DataFrame(rows, columns=["bytes_key", "tid", "o", "begin", "undecided", "h"])


def longest_repeats(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(tid, bytes_key, packed, m)``: for each repeated anchor the longest string of bytes from it, by whole symbols, that a neighbour in suffix order shares."""
    grouped = found.groupBy("tid").agg(F.collect_list(F.struct("packed", "bytes_key")).alias("found"))
    schema = "sid long, pos long, sym long, packed long, bytes_key long, ahead array<long>, reach array<int>"
    strings = stash(grouped.mapInArrow(returning(partial(_strings, length=length)), schema), "strings")
    ranks = suffix_ranks(strings.select("sid", "pos", "sym"), DEPTH)
    tidy(found)
    order = places(ranks, ["rank", "sid", "pos"], "place").select("sid", "pos", "place")
    ordered = strings.select("sid", "pos", "packed", "bytes_key", "ahead", "reach").join(order, ["sid", "pos"])
    # blocks of the order; a block's first and last row also stand in the block beside it
    size = 1024
    block, inside = F.floor(F.col("place") / size), F.col("place") % size
    beside = F.array_compact(F.array(block, F.when(inside == 0, block - 1), F.when(inside == size - 1, block + 1)))
    dealt = ordered.withColumn("block", F.explode(beside))
    w = Window.partitionBy("block").orderBy("place")

    def shared(other):
        unlike = F.array_position(F.zip_with("ahead", other, lambda a, b: a.eqNullSafe(b)), F.lit(False))
        least = F.least(F.size("ahead"), F.size(other))
        return F.when(other.isNull(), 0).when(unlike == 0, least).otherwise(F.least(least, (unlike - 1).cast("int")))

    met = dealt.withColumn("up", F.lag("ahead").over(w)).withColumn("down", F.lead("ahead").over(w)).where(F.col("block") == F.floor(F.col("place") / size))
    best = met.withColumn("r", F.greatest(shared(F.col("up")), shared(F.col("down"))))
    out = best.select(F.col("sid").alias("tid"), "bytes_key", "packed", F.when(F.col("r") > 0, F.element_at("reach", F.greatest(F.col("r"), F.lit(1)))).otherwise(0).alias("m"))
    return stash(out, "repeats")


def text_id(salt: int):
    return F.xxhash64(F.coalesce("text", F.lit("")), F.lit(salt))


def _settled_salt(docs: DataFrame) -> tuple[DataFrame, int]:
    """Texts with their counts, under a salt for which no two different texts share an id."""
    salt = 0
    while True:
        sums = docs.select(text_id(salt).alias("tid"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))
        texts = stash(sums.groupBy("tid").agg(F.count("*").alias("n"), F.min("sha").alias("a"), F.max("sha").alias("b")), "texts")
        if texts.where("a <> b").isEmpty():
            return texts.select("tid", "n"), salt
        salt += 1


def frequent_keys(keyed: DataFrame, length: int) -> frozenset[int]:
    """Keys that occur at many places in a sixteenth of the texts: repeated for certain, and too many for one task."""
    some = keyed.where(F.pmod("tid", F.lit(16)) == 3).mapInArrow(returning(partial(_anchor_rows, length=length)), _ANCHORS)
    counted = some.groupBy("bytes_key").agg(F.count("*").alias("n"), F.min("tid").alias("a"), F.max("tid").alias("b"))
    return frozenset(r["bytes_key"] for r in counted.where(f"n >= {HOT} AND a <> b").orderBy(F.desc("n"), "bytes_key").limit(HOT_KEYS).collect())


_ANCHORS = "bytes_key long, tid long, packed long, hot boolean"


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, int]:
    """``(tid, whole, spans)`` of the texts that lose bytes, and the salt of their ids."""
    texts, salt = _settled_salt(docs)
    keyed = docs.select(text_id(salt).alias("tid"), "text")
    long = keyed.where(F.octet_length("text") >= length)
    rows = long.mapInArrow(returning(partial(_anchor_rows, length=length, hot=frequent_keys(long, length))), _ANCHORS)
    # a key occurs twice if its places differ in text or position; frequent ones need no meeting and go anywhere
    rows = rows.withColumn("meet", F.when(F.col("hot"), F.xxhash64("tid", "packed")).otherwise(F.col("bytes_key")))
    w = Window.partitionBy("meet")
    differ = [(F.min(c).over(w).alias(f"{c}_a"), F.max(c).over(w).alias(f"{c}_b")) for c in ("tid", "packed")]
    several = rows.select("*", *(x for pair in differ for x in pair)).where("hot OR tid_a <> tid_b OR packed_a <> packed_b")
    found = stash(several.select("tid", "bytes_key", "packed").distinct(), "anchors")
    tidy(docs)
    repeats = longest_repeats(found, length)
    tidy(docs)
    told = repeats.groupBy("tid").agg(F.collect_list(F.struct("packed", "bytes_key", "m")).alias("found")).mapInArrow(returning(partial(_undecided, length=length)), "tid long, bytes_key long, packed long, undecided boolean, begin long, end long")
    told = stash(told, "decided")
    # of keys with an undecided string all anchors are asked; counts aggregate before they meet
    keys = told.groupBy("bytes_key").agg(F.max("undecided").alias("ask"), F.count("*").alias("members")).where("ask")
    # a table of its own, so that both sides of the join are plain exchanges, of which Spark splits the large partitions
    keys = stash(keys, "asked-keys")
    asked = told.join(keys, "bytes_key").withColumn("crowded", F.col("members") > CROWD)
    asked = stash(asked.groupBy("tid").agg(F.collect_list(F.struct("packed", "bytes_key", "undecided", "crowded")).alias("found")), "asked")
    around = keyed.join(asked, "tid").select("tid", "text", "found").mapInArrow(returning(partial(_surroundings, length=length)), "bytes_key long, tid long, packed long, undecided boolean, crowded boolean, around binary")
    around = stash(around, "around")
    tidy(docs)
    few = around.where("NOT crowded").repartition("bytes_key").sortWithinPartitions("bytes_key").mapInPandas(returning(partial(_compared, length=length)), "tid long, begin long, end long")
    single = around.where("crowded").mapInPandas(returning(partial(_single_strings, length=length)), "bytes_key long, tid long, o int, begin long, undecided boolean, h binary").distinct()
    counted = single.groupBy("bytes_key", "o", "h").agg(F.sum(F.when(F.col("undecided"), 1).otherwise(2)).alias("n")).where("n > 1")
    many = single.where("undecided").join(counted, ["bytes_key", "o", "h"], "left_semi").select("tid", "begin", (F.col("begin") + length).alias("end"))
    sure = told.where("end > 0").select("tid", "begin", "end")
    spans = stash(sure.unionByName(few).unionByName(many), "spans").groupBy("tid").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    copied = texts.where("n > 1").select("tid", F.lit(True).alias("whole"))
    return stash(spans.join(copied, "tid", "full").select("tid", F.coalesce("whole", F.lit(False)).alias("whole"), "spans"), "removed"), salt


def with_removal(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(row, n_bytes, spans, kept)``: each row of ``docs`` as a struct, the removed places as pairs, the kept bytes."""
    if not LEAST <= length <= 1 << 20:
        raise ValueError(f"strings of {LEAST} bytes at least")
    removed, salt = repeated_spans(docs, length)
    tidy(docs)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), text_id(salt).alias("tid"))
    cut = _removal_udf(length)(F.col("row.text"), F.col("spans"), F.coalesce("whole", F.lit(False)))
    return keyed.join(removed, "tid", "left").withColumn("cut", cut).select("row", "cut.*")


def _removal_udf(length: int):
    pair = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept", T.BinaryType())])

    @F.pandas_udf(pair)
    def cut(texts: pd.Series, spans: pd.Series, whole: pd.Series) -> pd.DataFrame:
        out = [removal(t, s, w, length) for t, s, w in zip(texts, spans, whole)]
        return pd.DataFrame({"n_bytes": [x[0] for x in out], "spans": [x[1] for x in out], "kept": [x[2] for x in out]})

    return cut


def removal(text: str | None, spans, whole: bool, length: int = LENGTH) -> tuple[int, list[list[int]], bytes]:
    """Length of the text in bytes, its maximal removed runs, and the bytes that stay."""
    data = (text or "").encode("utf-8", "replace")
    pairs = [(0, len(data))] if whole and len(data) >= length else sorted((int(s["begin"]), int(s["end"])) for s in (spans if spans is not None else []))
    merged: list[list[int]] = []
    for a, b in pairs:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    edges = [0, *(x for ab in merged for x in ab), len(data)]
    return len(data), merged, b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def op3_suffix_array_dedup(docs: DataFrame) -> DataFrame:
    out = with_removal(docs.select("doc_id", "text"))
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return out.select("row.doc_id", "n_bytes", lost.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def _decoded(kept: pd.Series) -> pd.Series:
    return pd.Series([bytes(k).decode("utf-8", "ignore") for k in kept])


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes cut out of its texts; n_chars, where there is one, follows the text."""
    out = with_removal(docs, length)
    text = F.when(F.col("row.text").isNotNull(), F.pandas_udf(_decoded, T.StringType())(F.col("kept")))
    out = out.withColumn("text", text)
    changed = {"text": F.col("text"), "n_chars": F.char_length("text")}
    return out.select(*[(changed[f.name].cast(f.dataType) if f.name in changed else F.col(f"row.{f.name}")).alias(f.name) for f in docs.schema])
