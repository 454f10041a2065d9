"""Sizes and values of the wire format's scalars, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .packing import bound

#: Decode limits in bytes.
MAX_STRING = 1 << 20
MAX_BYTES = 1 << 24


def zigzag(n: Column) -> Column:
    n = n.cast("bigint")
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def unzigzag(u: Column) -> Column:
    return F.shiftrightunsigned(u, 1).bitwiseXOR(F.when(u.bitwiseAND(1) == 1, F.lit(-1).cast("bigint")).otherwise(F.lit(0).cast("bigint")))


def varint_size(n: Column) -> Column:
    """Bytes of the zig-zag varint of ``n``: groups of seven bits."""
    return ((F.length(F.bin(zigzag(n))) + 6) / 7).cast("int")


def varint_hex(n: Column) -> Column:
    """The varint's bytes, as lower-case hex: ten groups of seven bits in two numbers, cut to the size."""

    def together(v: Column, first: int, count: int) -> Column:
        out = F.lit(0).cast("bigint")
        for k in range(first, first + count):
            more = F.when(v["size"] > k + 1, F.lit(128)).otherwise(F.lit(0)).cast("bigint")
            out = F.shiftleft(out, 8).bitwiseOR(F.shiftrightunsigned(v["u"], 7 * k).bitwiseAND(127)).bitwiseOR(more)
        return F.lpad(F.hex(out), 2 * count, "0")

    given = F.struct(zigzag(n).alias("u"), varint_size(n).alias("size"))
    return bound(given, lambda v: F.lower(F.substring(F.concat(together(v, 0, 7), together(v, 7, 3)), F.lit(1), 2 * v["size"])))


def varint_value(hexed: Column) -> Column:
    """The integer of a varint given as hex: two numbers of seven and three bytes, taken apart by shifts."""
    number = lambda part: F.conv(part, 16, 10).cast("bigint")
    halves = bound(F.rpad(hexed, 20, "0"), lambda h: F.struct(number(F.substring(h, 1, 14)).alias("a"), number(F.substring(h, 15, 6)).alias("b")))

    def joined(v: Column) -> Column:
        groups = [F.shiftright(v[c], 8 * (n - 1 - k)).bitwiseAND(127) for c, n in (("a", 7), ("b", 3)) for k in range(n)]
        out = groups[0]
        for k, g in enumerate(groups[1:], 1):
            out = out.bitwiseOR(F.shiftleft(g, 7 * k))
        return out

    return bound(bound(halves, joined), unzigzag)


def be_int(hexed: Column, bits: int = 32) -> Column:
    """Two's complement value of big-endian hex, up to 32 bits."""
    v = F.conv(hexed, 16, 10).cast("bigint")
    return F.when(v >= 1 << (bits - 1), v - (1 << bits)).otherwise(v)


def string_size(s: Column) -> Column:
    """Bytes of a string on the wire: length and content."""
    n = F.octet_length(s)
    return n + varint_size(n)


def string_fits(s: Column) -> Column:
    return F.octet_length(s) <= MAX_STRING


def bytes_fit(b: Column) -> Column:
    return F.octet_length(b) <= MAX_BYTES


def section_size(palette: Column, words: Column, biomes: Column, biome_words: Column) -> Column:
    """Bytes of a section on the wire: four counted lists."""
    text = lambda p: varint_size(F.size(p)) + F.aggregate(p, F.lit(0), lambda a, s: a + string_size(s))
    data = lambda w: varint_size(F.size(w)) + 8 * F.size(w)
    return text(palette) + data(words) + text(biomes) + data(biome_words)
