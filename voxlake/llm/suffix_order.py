"""Distributed difference-cover suffix sorting (DC3) of many strings of symbols.

Suffixes at positions 1 and 2 modulo 3 are the sample. Their triples of symbols
are sorted and named by rank; if names repeat, the strings of names (one for
each residue) are sorted by recursion. The remaining suffixes and the sample are
merged: any two of the three residue classes compare by at most two symbols and
a sample rank, so three sorts, one for each pair of classes, give every suffix
the number of smaller ones in each class, and these add up to its rank.

Sorts are range-partitioned; a rank is the place inside the partition plus the
sizes of the partitions before.
Strings end where a position is missing; an end sorts before every symbol.
Symbols are not negative.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, stash

ship(__name__)

_END = -1
_CLASS_GAP = 3**25


def places(df: DataFrame, columns: list[str], name: str, own: str | None = None) -> DataFrame:
    """``df`` with ``name``: the place of each row in the order of ``columns``, from 0, without gaps.

    With ``own``, a column of small numbers, also ``own_place``: the place among
    the rows with the same number. Partitions are ranges of the order, of which
    Spark joins small neighbours by their measured size; only their sizes reach the
    driver."""
    ordered = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    kinds = T.StructType([*df.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("inside", T.LongType()), T.StructField("own_inside", T.LongType())])
    ordered = stash(ordered.mapInArrow(_counted(own), kinds), "ordered")
    sizes = ordered.groupBy("part", *([own] if own else [])).agg(F.count("*").alias("n")).collect()
    parts = max((r["part"] for r in sizes), default=-1) + 1

    def offset(of: dict[int, int]) -> Column:
        starts = np.cumsum([0, *(of.get(p, 0) for p in range(parts))]).tolist()
        return F.element_at(F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>"), F.col("part") + 1)

    whole: dict[int, int] = {}
    each: dict[int, dict[int, int]] = {}
    for r in sizes:
        whole[r["part"]] = whole.get(r["part"], 0) + r["n"]
        if own:
            each.setdefault(r[own], {})[r["part"]] = r["n"]
    out = ordered.withColumn(name, offset(whole) + F.col("inside"))
    if own:
        before = F.lit(0).cast("bigint")
        for value, of in each.items():
            before = F.when(F.col(own) == value, offset(of)).otherwise(before)
        out = out.withColumn("own_place", before + F.col("own_inside"))
    return out.drop("part", "inside", "own_inside")


def _counted(own: str | None):
    """Number the rows of a partition, all and by the value of ``own``."""

    def run(batches):
        from pyspark import TaskContext

        part, seen, by = TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            n = batch.num_rows
            inside = np.arange(seen, seen + n)
            seen += n
            owns = np.zeros(n, np.int64)
            if own:
                values = batch.column(batch.schema.get_field_index(own)).to_numpy(zero_copy_only=False)
                for v in np.unique(values):
                    hit = values == v
                    owns[hit] = by.get(v, 0) + np.arange(hit.sum())
                    by[v] = by.get(v, 0) + int(hit.sum())
            columns = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(inside), pa.array(owns)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "inside", "own_inside"])

    return run


def _next(column: str, by: int) -> Column:
    """The value ``by`` positions on in the same string, or the end."""
    w = Window.partitionBy("sid").orderBy("pos")
    out = F.lit(_END).cast("long")
    for k in range(1, by + 1):
        out = F.when(F.lead("pos", k).over(w) == F.col("pos") + by, F.lead(column, k).over(w)).otherwise(out)
    return F.coalesce(out, F.lit(_END).cast("long"))


def suffix_ranks(strings: DataFrame, depth: int | None = None, _covers: int = 1) -> DataFrame:
    """``(sid, pos, rank)`` for strings given as rows ``(sid, pos, sym)``.

    Ranks rise with the order of suffixes. With ``depth``, recursion stops once
    names cover that many symbols: suffixes that agree that far keep
    neighbouring ranks in any order."""
    rows = stash(strings.select("sid", F.col("pos").cast("long").alias("pos"), F.col("sym").cast("long").alias("s0")).withColumns({"s1": _next("s0", 1), "s2": _next("s0", 2)}), "triples")
    sample = rows.where("pos % 3 <> 0")
    triples = sample.groupBy("s0", "s1", "s2").agg(F.count("*").alias("n"))
    names = places(triples, ["s0", "s1", "s2"], "name")
    told = names.agg(F.max("n").alias("most"), F.count("*").alias("n")).first()
    named = stash(sample.join(names.drop("n"), ["s0", "s1", "s2"]).select("sid", "pos", "name"), "named")
    if (told["most"] or 1) == 1 or (depth is not None and _covers * 3 >= depth):
        ranks = named.withColumnRenamed("name", "rank")
    else:
        folded = F.floor(F.col("pos") / 3) + F.when(F.col("pos") % 3 == 2, _CLASS_GAP).otherwise(0)
        deeper = suffix_ranks(named.select("sid", folded.alias("pos"), F.col("name").alias("sym")), depth, _covers * 3)
        ranks = named.withColumn("at", folded).join(deeper.withColumnRenamed("pos", "at"), ["sid", "at"]).select("sid", "pos", "rank")
    # merge
    whole = rows.select("sid", "pos", "s0", "s1").join(ranks, ["sid", "pos"], "left").withColumn("rank", F.coalesce("rank", F.lit(_END).cast("long")))
    whole = whole.withColumns({"r1": _next("rank", 1), "r2": _next("rank", 2), "c": (F.col("pos") % 3).cast("int")})
    whole = stash(whole, "merge")
    # smaller suffixes in both classes of a pair; those of a suffix's own class, which both its pairs count, come off once
    told = None
    for (a, b), keys in {(0, 1): ["s0", "r1"], (0, 2): ["s0", "s1", "r2"], (1, 2): ["rank"]}.items():
        pair = places(whole.where(F.col("c").isin(a, b)).select("sid", "pos", "c", *keys), keys + ["c", "sid", "pos"], "place", own="c")
        off = {(0, 1): F.col("c") == 1, (0, 2): F.lit(True), (1, 2): F.lit(False)}[a, b]
        pair = pair.select("sid", "pos", (F.col("place") - F.when(off, F.col("own_place")).otherwise(0)).alias("v"))
        told = pair if told is None else told.unionByName(pair)
    return stash(told.groupBy("sid", "pos").agg(F.sum("v").alias("rank")), "ranks")
