"""Coordinate and key arithmetic of a world of 16x16x16 sections, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the data model.
SECTION = 16
CELLS = 4096
AIR = "minecraft:air"
PLAINS = "minecraft:plains"


def chunk_of(c: Column) -> Column:
    """Chunk coordinate of a block coordinate (floor for negatives)."""
    return F.shiftright(c, 4)


def local_of(c: Column) -> Column:
    return c.bitwiseAND(15)


def section_index(y: Column, min_section: int) -> Column:
    return F.shiftright(y, 4) - min_section


def linear_index(x: Column, y: Column, z: Column) -> Column:
    """y*256 + z*16 + x of the local coordinates."""
    return local_of(y) * 256 + local_of(z) * 16 + local_of(x)


def from_linear(i: Column) -> tuple[Column, Column, Column]:
    """Local (x, y, z) of a linear index."""
    return local_of(i), local_of(F.shiftright(i, 8)), local_of(F.shiftright(i, 4))


def absolute(chunk: Column, local: Column) -> Column:
    return chunk * SECTION + local


def pack_xz(x: Column, z: Column) -> Column:
    return local_of(x) + local_of(z) * 16


def unpack_xz(p: Column) -> tuple[Column, Column]:
    return local_of(p), local_of(F.shiftright(p, 4))


def chunk_key(x: Column, z: Column) -> Column:
    """One 64-bit key of a chunk; by multiplication, which every engine agrees on for negatives."""
    return x.cast("bigint") * F.lit(1 << 32) + z.cast("bigint").bitwiseAND((1 << 32) - 1)


def quart_index(x: Column, y: Column, z: Column) -> Column:
    """Index of a 4x4x4 biome cell inside a section, from block coordinates."""
    q = lambda c: F.shiftright(local_of(c), 2)
    return q(y) * 16 + q(z) * 4 + q(x)


def dimension_problem(low: Column, high: Column) -> Column:
    """``ok``, or the first bound that a section range breaks."""
    return F.when(low < -128, "min").when(high > 128, "max").when(low >= high, "order").when(high - low > 512, "count").otherwise("ok")


def within_sections(y: Column, low: int, high: int) -> Column:
    return section_index(y, low).between(0, high - low - 1)
