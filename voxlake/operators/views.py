"""Explode views of chunk tables: sections, blocks, biomes, entities and counts.

Functions apply to palettes before cells are exploded, and filters on sections
and palettes come first: a section has 4096 cells, its palette a few names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coords as C
from ..functions import packing as P


def sections(chunks: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row for each section: its chunk, index and arrays; empty ones only on request."""
    named = chunks.select("dimension", "x", "z", F.posexplode("sections").alias("section_index", "s"))
    out = named.select("dimension", "x", "z", "section_index", F.col("s").isNull().alias("missing"), "s.*")
    return out if keep_empty else out.where("NOT missing").drop("missing")


def unpacked(sections_: DataFrame, palette: str, data: str, out: str) -> DataFrame:
    """``sections`` with the index array of a palette."""
    wide = sections_.withColumn("_bits", P.bits_per_entry(F.size(palette)))
    return wide.withColumn(out, P.unpack_array(F.col(data), F.col("_bits"))).drop("_bits")


def blocks(chunks: DataFrame, min_section: int = -4, only: str | None = None, known: Column | None = None) -> DataFrame:
    """``(dimension, x, y, z, block)`` of all cells that are not air.

    ``only`` keeps one block and prunes sections whose palette lacks it;
    ``known`` (an array of names) turns other names into air."""
    s = sections(chunks).where(~P.is_empty_palette(F.col("block_palette")))
    if only is not None:
        s = s.where(F.array_contains("block_palette", only))
    if known is not None:
        s = s.withColumn("block_palette", F.transform("block_palette", lambda b: F.when(F.array_contains(known, b), b).otherwise(F.lit(C.AIR))))
        s = s.where(~F.forall("block_palette", lambda b: b == C.AIR))
    cells = P.explode_cells(s.select("dimension", "x", "z", "section_index", "block_palette", "block_data"), "block_palette", "block_data")
    named = cells.withColumn("block", P.entry_or_first(F.col("block_palette"), F.col("pi"))).where((F.col("block") != C.AIR) & (F.lit(True) if only is None else F.col("block") == only))
    return _placed(named, "block", min_section)


def biomes(chunks: DataFrame, min_section: int = -4) -> DataFrame:
    """``(dimension, x, y, z, biome)`` of all cells of sections that are there."""
    s = sections(chunks).select("dimension", "x", "z", "section_index", "biome_palette", "biome_data")
    cells = P.explode_cells(s, "biome_palette", "biome_data")
    named = cells.withColumn("biome", F.coalesce(P.entry_or_first(F.col("biome_palette"), F.col("pi")), F.lit(C.PLAINS)))
    return _placed(named, "biome", min_section)


def biome_counts(chunks: DataFrame) -> DataFrame:
    """``(dimension, x, z, section_index, biome, cells)``: indices are counted before they get names."""
    s = sections(chunks).select("dimension", "x", "z", "section_index", "biome_palette", "biome_data")
    counted = P.explode_cells(s, "biome_palette", "biome_data").groupBy("dimension", "x", "z", "section_index", "pi").agg(F.count("*").alias("n"), F.first("biome_palette").alias("biome_palette"))
    named = counted.withColumn("biome", F.coalesce(P.entry_or_first(F.col("biome_palette"), F.col("pi")), F.lit(C.PLAINS)))
    return named.groupBy("dimension", "x", "z", "section_index", "biome").agg(F.sum("n").alias("cells"))


def _placed(cells: DataFrame, value: str, min_section: int) -> DataFrame:
    lx, ly, lz = C.from_linear(F.col("li"))
    return cells.select("dimension", C.absolute(F.col("x"), lx).alias("x"), C.absolute(F.col("section_index") + min_section, ly).alias("y"), C.absolute(F.col("z"), lz).alias("z"), value)


def block_entities(chunks: DataFrame) -> DataFrame:
    b = chunks.select("dimension", "x", "z", F.explode("block_entities").alias("b"))
    lx, lz = C.unpack_xz(F.col("b.packed_xz"))
    return b.select("dimension", C.absolute(F.col("x"), lx).alias("x"), F.col("b.y").alias("y"), C.absolute(F.col("z"), lz).alias("z"), F.coalesce(F.nullif("b.id", F.lit("")), F.lit("minecraft:unknown")).alias("id"), "b.data")


def entities(chunks: DataFrame) -> DataFrame:
    return chunks.select("dimension", F.col("x").alias("chunk_x"), F.col("z").alias("chunk_z"), F.explode("entities").alias("e")).select("dimension", "chunk_x", "chunk_z", "e.*")


def scheduled_ticks(chunks: DataFrame) -> DataFrame:
    t = chunks.select("dimension", "x", "z", F.explode("scheduled_ticks").alias("t"))
    lx, lz = C.unpack_xz(F.col("t.packed_xz"))
    return t.select("dimension", C.absolute(F.col("x"), lx).alias("x"), F.col("t.y").alias("y"), C.absolute(F.col("z"), lz).alias("z"), F.coalesce(F.nullif("t.block", F.lit("")), F.lit(C.AIR)).alias("block"), "t.tick")


def block_type_sections(chunks: DataFrame) -> DataFrame:
    """How many section palettes hold each block state."""
    return sections(chunks).select(F.explode("block_palette").alias("block")).groupBy("block").agg(F.count("*").alias("sections"))


def entity_type_counts(chunks: DataFrame) -> DataFrame:
    return entities(chunks).groupBy("id").agg(F.count("*").alias("entities"))


def world_info(chunks: DataFrame, min_section: int, max_section: int) -> DataFrame:
    """Chunk count and block range (exclusive top)."""
    return chunks.agg(F.count("*").alias("chunks")).select("chunks", F.lit(min_section * 16).alias("min_y"), F.lit(max_section * 16).alias("max_y"))


def vector_or_zero(v: Column, n: int = 3) -> Column:
    """The vector if it has ``n`` components, else the zero vector."""
    return F.when(F.size(v) == n, v).otherwise(F.array(*[F.lit(0.0).cast("float")] * n))


def uuid_from_ints(parts: Column) -> Column:
    """A UUID's text from four signed 32-bit integers, most significant first."""
    octets = F.array_join(F.transform(parts, lambda i: F.lower(F.lpad(F.hex(i.cast("bigint").bitwiseAND((1 << 32) - 1)), 8, "0"))), "")
    return F.concat_ws("-", *[F.substring(octets, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
