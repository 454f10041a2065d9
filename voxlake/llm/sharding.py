"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

Every shard owns ``VNODES`` points of a ring of 2^32 positions. A row stands at
the hash of its doc_id, crc32 and size and is taken by the owner of the next
point clockwise; a shard takes no more rows than its bound, and rows that find it full go on
clockwise to the next point of a shard with room. Law ``rows``: the bounds are
the floor or ceiling of rows over shards and add up to all rows, so shard sizes
differ by at most one.

Rows never meet on one machine for this. The ring is cut into cells (arcs
between neighbouring points, cut again into ``CUTS`` equal parts); only the
count of each cell reaches the driver, where the walk round the ring gives each
cell's rows to shards as runs of ranks. The number of cells and runs depends on
shards, points and cuts alone, not on the rows. A row then needs its rank in its
own small cell, and a look at the runs of that cell.

Every copy of a text is a key of its own: bounded loads would have to split a
large group of copies in any case. ``text_crc32`` shows the groups.

Defined results: a null text has size 8 and the crc32 of no bytes, 0; rows
with a null or repeated doc_id stand apart by their texts, and only rows equal in
id and text share a position; fewer rows than shards leave some shards empty; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 24
VNODES = 64
CUTS = 8
RING = 1 << 32


def ring_points(shards: int) -> list[tuple[int, int]]:
    """(position, shard) of all points, in order of position, positions unique."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for v in range(VNODES):
            at = xxhash.xxh64_intdigest(f"shard {shard} point {v}".encode(), 42) % RING
            while at in taken:
                at = (at + 1) % RING
            taken[at] = shard
    return sorted(taken.items())


def cell_starts(points: list[tuple[int, int]]) -> list[int]:
    """Sorted first positions of the cells; a cell ends where the next begins. Cell 0 begins at 0."""
    starts = {0}
    edges = [p + 1 for p, _ in points]
    for a, b in zip([0, *edges], [*edges, RING]):
        starts |= {a + (b - a) * k // CUTS for k in range(CUTS)} if b > a else set()
    return sorted(s for s in starts if s < RING)


def bounds(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def plan(counts: list[int], starts: list[int], points: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int]]:
    """Runs (cell, first rank, shard, slot of the first rank).

    Cells are served clockwise. A cell's rows go to its own point's shard while
    it has room, the rest to the next point clockwise whose shard has room."""
    room, used = list(room), [0] * len(room)
    at = [p for p, _ in points]
    runs = []
    for cell, (n, start) in enumerate(zip(counts, starts)):
        k, rank = bisect.bisect_left(at, start) % len(points), 0
        while rank < n:
            shard = points[k % len(points)][1]
            take = min(n - rank, room[shard])
            if take:
                runs.append((cell, rank, shard, used[shard]))
                rank, room[shard], used[shard] = rank + take, room[shard] - take, used[shard] + take
            else:
                k += 1
    return runs


def _numbers(values: list[int]):
    """A constant array column; as one string literal, which the optimizer folds."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def op9_sharding(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    points = ring_points(shards)
    starts = cell_starts(points)
    width = RING // 4096
    text = F.col("text")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit(0).alias("_at"),
    ).withColumn("_at", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(RING)))
    # a cell's number: the cells before the row's 1/4096 of the ring, and those that begin in it up to the row
    slices = [bisect.bisect_left(starts, k * width) for k in range(4097)]
    groups = ["|".join(str(s) for s in starts[slices[k] : slices[k + 1]]) for k in range(4096)]
    rows = rows.withColumn("_part", F.shiftright("_at", 20).cast("int"))
    inside = F.split(F.element_at(F.split(F.lit(",".join(groups)), ","), F.col("_part") + 1), r"\|")
    before = F.element_at(_numbers(slices), F.col("_part") + 1)
    rows = rows.withColumn("_cell", (before - 1 + F.size(F.filter(inside, lambda s: (s != "") & (s.try_cast("bigint") <= F.col("_at"))))).cast("int")).drop("_part")
    found = {r["_cell"]: r["n"] for r in rows.groupBy("_cell").agg(F.count("*").alias("n")).collect()}
    counts = [found.get(c, 0) for c in range(len(starts))]
    runs = plan(counts, starts, points, bounds(sum(counts), shards))
    cells = [r[0] for r in runs]
    first = [bisect.bisect_left(cells, c) for c in range(len(starts) + 1)]
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy(F.col("_at"), F.col("doc_id"), "text_crc32", "size")) - 1
    rows = rows.withColumn("_rank", rank.cast("long"))
    # the run that holds the rank is the last of the cell's runs that begins at or before it
    rows = rows.withColumn("_first", F.element_at(_numbers(first), F.col("_cell") + 1).cast("int")).withColumn("_count", F.element_at(_numbers(first), F.col("_cell") + 2).cast("int") - F.col("_first"))
    rows = rows.withColumn("_begins", F.slice(_numbers([r[1] for r in runs] or [0]), F.col("_first") + 1, F.col("_count")))
    rows = rows.withColumn("_run", F.col("_first") + F.size(F.filter("_begins", lambda b: b <= F.col("_rank"))))
    pick = lambda k: F.element_at(_numbers([r[k] for r in runs] or [0]), F.col("_run"))
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        pick(2).cast("int").alias("shard"),
        (pick(3) + F.col("_rank") - pick(1)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
