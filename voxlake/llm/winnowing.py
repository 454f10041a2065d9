"""Document fingerprints by winnowing, in DataFrame functions only.

Tokens are the runs of characters other than space and the control spaces; a
gram is five tokens (all of them where there are fewer). A gram's hash rolls
over the token hashes as a polynomial in a fixed base modulo the prime
2^31 - 1. Of every window of eight neighbouring grams the least hash is chosen,
the rightmost of equals, and kept with its position, so any run of at least
twelve tokens that two texts share leaves a common hash in both fingerprints.

Hash and position travel in one integer, the hash above and the complement of
the position below: the least integer of a window is then its least hash with
the rightmost tie. Windows are built by doubling (two, four, eight grams), which
takes three passes over the array instead of one pass for each window.

The successor of a document in descending doc_id is found without a global
sort: ids are cut into ranges at approximate quantiles, every range is ordered
on its own, and the first row of each range is also sent to the range before
it (the first of all to the last), so each row finds its successor in its range.
An id that fills several ranges, or the null id, is cut by a hash of the text.
The ranges are a constant array, searched in two steps of its square root.

Defined results: a null text counts as empty; an empty text (or one of white
space only) has the empty fingerprint; two empty fingerprints have likeness 1,
an empty and a non-empty one 0; rows with equal doc_id follow each other in the
order of their texts; null ids come last; a single document is its own
successor; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 5
WINDOW = 8
PRIME = (1 << 31) - 1
BASE = 1_000_003
_POSITION = (1 << 31) - 1


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the chosen integers of column ``text``, in order of position.

    Every stage is a column of its own, so each array is computed once."""
    cols = df.columns
    at, upto = F.col("_at"), lambda a, n: F.slice(a, 1, F.greatest(n, F.lit(0)))
    tokens = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda t: t != "")
    df = df.withColumn("_hashes", F.transform(tokens, lambda t: F.xxhash64(t).bitwiseAND(PRIME)))
    df = df.withColumn("_n", F.size("_hashes")).withColumn("_at", F.col("_hashes"))
    for k in range(1, GRAM):
        # a step is at most 2^31 * 2^20 + 2^31, well inside 63 bits
        rest = F.slice(F.col("_hashes"), k + 1, F.greatest(F.col("_n") - k, F.lit(0)))
        df = df.withColumn("_at", F.zip_with(upto(at, F.col("_n") - k), rest, lambda a, b: (a * BASE + b) % PRIME))
    whole = F.aggregate("_hashes", F.lit(0).cast("long"), lambda a, b: (a * BASE + b) % PRIME)
    df = df.withColumn("_at", F.when(F.col("_n").between(1, GRAM - 1), F.array(whole)).otherwise(at))
    df = df.withColumn("_at", F.transform(at, lambda h, i: F.shiftleft(h, 31) + (F.lit(_POSITION) - i)))
    span = 1
    while span < WINDOW:
        # a text with fewer grams than a window is one window
        left = F.size(at) - span
        doubled = F.zip_with(upto(at, left), F.slice(at, span + 1, F.greatest(left, F.lit(0))), lambda a, b: F.least(a, b))
        df = df.withColumn("_at", F.when(left > 0, doubled).when(F.size(at) > 0, F.array(F.array_min(at))).otherwise(at))
        span *= 2
    return df.withColumn(out, F.array_distinct(at)).select(*cols, out)


def with_hashes(df: DataFrame, chosen: str, out: str) -> DataFrame:
    return df.withColumn(out, F.array_distinct(F.transform(chosen, lambda x: F.shiftright(x, 31))))


def as_text(chosen: Column) -> Column:
    """``hash@position`` in order of position, space-joined."""
    return F.array_join(F.transform(chosen, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, 31))), F.lit("@"), F.lit(_POSITION) - x.bitwiseAND(_POSITION))), " ")


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Add the Jaccard likeness of two sets of hashes."""
    cols = df.columns
    df = df.withColumn("_both", F.size(F.array_intersect(a, b))).withColumn("_either", F.size(a) + F.size(b) - F.col("_both"))
    return df.withColumn(out, F.when(F.col("_either") == 0, F.lit(1.0)).otherwise(F.col("_both") / F.col("_either"))).select(*cols, out)


def _numbers(values: list[int]) -> Column:
    """A constant array column; as one string literal, which the optimizer folds."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _below(edges: list[int], x: Column) -> Column:
    """How many of the sorted edges are less than ``x``."""
    step = max(1, math.isqrt(len(edges)))
    coarse = F.size(F.filter(_numbers(edges[step - 1 :: step]), lambda e: e < x)) if len(edges) >= step and edges else F.lit(0)
    return coarse * step + F.size(F.filter(F.slice(_numbers(edges or [0]), coarse * step + 1, F.lit(step)), lambda e: e < x)) if edges else F.lit(0)


def plan_ranges(cuts: list[int], nulls: int, rows: int, ranges: int) -> tuple[list[int], list[int], list[int]]:
    """Of quantiles of the ids: sorted edges, and of each span (ids up to an edge, those above the last, null ids)
    its parts and the number of its first part; parts count up in descending order of ids, null ids last."""
    often = Counter(cuts)
    # an id that is several quantiles at once has a span of its own
    edges = sorted({e for b, n in often.items() for e in ((b - 1, b) if n > 1 else (b,))})
    parts = [often[e] if often.get(e, 0) > 1 else 1 for e in edges] + [1]
    last = max(1, round(ranges * nulls / max(rows, 1)))
    first, at = [0] * len(parts), 0
    for k in range(len(parts) - 1, -1, -1):
        first[k], at = at, at + parts[k]
    return edges, [*parts, last], [*first, at]


def with_successor(docs: DataFrame, columns: dict[str, str], ranges: int) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, ...) with ``columns`` of the next row in descending doc_id."""
    told = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], max(10_000, 100 * ranges)).alias("c"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.count("*").alias("n")).first()
    edges, parts, first = plan_ranges(list(told["c"] or []), told["nulls"], told["n"], ranges)
    docs = docs.withColumn("_h", F.pmod(F.xxhash64("text"), F.lit(1 << 31))).withColumn("_g", F.xxhash64(F.lit(1), "text"))
    docs = docs.withColumn("_span", F.when(F.col("doc_id").isNull(), len(edges) + 1).otherwise(_below(edges, F.col("doc_id"))))
    inside = F.shiftright(F.col("_h") * F.element_at(_numbers(parts), F.col("_span") + 1), 31)
    docs = docs.withColumn("_part", (F.element_at(_numbers(first), F.col("_span") + 1) + inside).cast("int"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id")).alias("down"), "_h", "_g")
    heads = sorted((r["_part"], r["head"]) for r in docs.groupBy("_part").agg(F.min(order).alias("head")).collect())
    if not heads:
        return docs.withColumns({k: F.lit(None).cast(docs.schema[c].dataType) for k, c in columns.items()}).drop("_h", "_g", "_span", "_part")
    # by number of the part: the head's hashes and id, and the part before it; parts without rows are -1
    size = heads[-1][0] + 1
    before, ids, h, g = [-1] * size, [0] * size, [-1] * size, [0] * size
    for k, (part, head) in enumerate(heads):
        before[part], ids[part], h[part], g[part] = heads[k - 1][0], -(head["down"] or 0), head["_h"], head["_g"]
    of = lambda values: F.element_at(_numbers(values), F.col("_part") + 1)
    leads = (F.col("_h") == of(h)) & (F.col("_g") == of(g)) & (F.coalesce("doc_id", F.lit(0)) == of(ids))
    places = F.array_compact(F.array(F.struct(F.col("_part").alias("r"), F.lit(0).alias("guest")), F.when(leads, F.struct(of(before).cast("int").alias("r"), F.lit(1).alias("guest")))))
    dealt = docs.withColumn("_place", F.explode(places))
    w = Window.partitionBy("_place.r").orderBy("_place.guest", F.desc_nulls_last("doc_id"), "_h", "_g", "text")
    return dealt.withColumns({k: F.lead(c).over(w) for k, c in columns.items()}).where("_place.guest = 0").drop("_place", "_h", "_g", "_span", "_part")


def op5_document_fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    # several ranges for each task, so that tasks come out even
    ranges = ranges or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = with_fingerprint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), "text", "chosen")
    df = with_successor(own, {"next_text": "text", "next_chosen": "chosen"}, max(2, ranges))
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    df = df.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "chosen", "next_chosen")
    df = with_fingerprint(df, "edited", "edited_chosen")
    for name in ("", "edited_", "next_"):
        df = with_hashes(df, f"{name}chosen", f"{name}hashes")
    df = with_likeness(df, "hashes", "edited_hashes", "near_edited")
    df = with_likeness(df, "hashes", "next_hashes", "near_next")
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("chosen")).alias("fingerprint"),
        as_text(F.col("edited_chosen")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
