"""From cells to chunks: last-wins, palettes, packed words, assembled chunks, and the import of dense volumes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coords as C
from ..functions import packing as P
from ..functions import states as S

SECTION_KEYS = ["dimension", "cx", "cz", "si"]


def last_wins(rows: DataFrame, keys: Sequence[str], sequence: Sequence[str]) -> DataFrame:
    """Of rows with equal keys the one with the highest sequence; partial maxima meet, whole groups never do."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*sequence)).alias("_last"))
    return best.select(*keys, "_last.*").select(*rows.columns)


def addressed(cells: DataFrame, min_section: int = -4, max_section: int = 20, quarts: bool = False) -> DataFrame:
    """Cells ``(dimension, x, y, z, ...)`` with chunk, section and linear index; those outside the sections go."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    inside = cells.where(C.within_sections(y, min_section, max_section))
    index = C.quart_index(x, y, z) if quarts else C.linear_index(x, y, z)
    return inside.withColumns({"cx": C.chunk_of(x), "cz": C.chunk_of(z), "si": C.section_index(y, min_section), "li": index}).drop("x", "y", "z")


def palettes(cells: DataFrame, value: str, first: str | None = None, by_first_seen: bool = False, keys: Sequence[str] = SECTION_KEYS) -> DataFrame:
    """``(*keys, value, pi)``: each section's names with their palette index.

    In order of name or of the least linear index; ``first`` takes index 0 and is never listed otherwise."""
    seen = cells.groupBy(*keys, value).agg(F.min("li").alias("_least"))
    if first is not None:
        seen = seen.where(F.col(value) != first)
    order = ["_least"] if by_first_seen else [value]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - (1 if first is None else 0)
    return seen.select(*keys, value, rank.cast("int").alias("pi"))


def section_columns(cells: DataFrame, value: str, first: str | None, cells_per_section: int, prefix: str, by_first_seen: bool = False) -> DataFrame:
    """``(*keys, <prefix>_palette, <prefix>_data)`` of cells that are unique by key and index."""
    entries = palettes(cells, value, first, by_first_seen)
    listed = entries.groupBy(*SECTION_KEYS).agg(F.array_sort(F.collect_list(F.struct("pi", value))).alias("_e"))
    names = F.transform("_e", lambda e: e[value])
    listed = listed.select(*SECTION_KEYS, (names if first is None else F.concat(F.array(F.lit(first)), names)).alias(f"{prefix}_palette"))
    listed = listed.withColumn("bits", P.bits_per_entry(F.size(f"{prefix}_palette")))
    sized = entries.join(listed.select(*SECTION_KEYS, "bits"), SECTION_KEYS)
    words = P.pack_cells(cells.join(sized, [*SECTION_KEYS, value]), SECTION_KEYS, "li", "pi", "bits")
    held = words.groupBy(*SECTION_KEYS).agg(F.map_from_entries(F.collect_list(F.struct("w", "word"))).alias("_w"))
    count = F.ceil(F.lit(cells_per_section) / P.per_word(F.col("bits"))).cast("int")
    data = F.when(F.col("bits") == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), lambda w: F.coalesce(F.try_element_at("_w", w), F.lit(0).cast("bigint"))))
    return listed.join(held, SECTION_KEYS, "left").select(*SECTION_KEYS, f"{prefix}_palette", data.alias(f"{prefix}_data"))


def assemble(block_cells: DataFrame, biome_cells: DataFrame | None = None, grid: DataFrame | None = None, count: int = 24, quarts: bool = False) -> DataFrame:
    """Chunks ``(dimension, x, z, sections)`` from addressed cells.

    ``block_cells`` has ``block``, ``biome_cells`` has ``biome``; sections without
    blocks are null; ``grid`` (dimension, cx, cz) adds chunks without content."""
    blocks = section_columns(block_cells, "block", C.AIR, C.CELLS, "block")
    if biome_cells is None:
        both = blocks.withColumns({"biome_palette": F.array(F.lit(C.PLAINS)), "biome_data": F.array().cast("array<bigint>")})
    else:
        biomes = section_columns(biome_cells, "biome", None, 64 if quarts else C.CELLS, "biome", by_first_seen=True)
        both = blocks.join(biomes, SECTION_KEYS, "left").withColumns({"biome_palette": F.coalesce("biome_palette", F.array(F.lit(C.PLAINS))), "biome_data": F.coalesce("biome_data", F.array().cast("array<bigint>"))})
    s = F.struct("block_palette", "block_data", "biome_palette", "biome_data")
    held = both.groupBy("dimension", "cx", "cz").agg(F.map_from_entries(F.collect_list(F.struct("si", s.alias("s")))).alias("_s"))
    if grid is not None:
        held = grid.select("dimension", "cx", "cz").distinct().join(held, ["dimension", "cx", "cz"], "left")
    listed = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.try_element_at("_s", i))
    return held.select("dimension", F.col("cx").alias("x"), F.col("cz").alias("z"), listed.alias("sections"))


def padded(sections: Column, count: int) -> Column:
    """Exactly ``count`` sections: missing ones null, extra ones cut."""
    return F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: F.try_element_at(sections, i))


def dense_volume(spark, width: int, height: int, length: int, offset: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """``(x, y, z)`` of a box, distributed."""
    n = spark.range(width * height * length).withColumn("id", F.col("id"))
    x = (F.col("id") / (height * length)).cast("bigint")
    y = ((F.col("id") / length).cast("bigint")) % height
    return n.select((x + offset[0]).cast("int").alias("x"), (y + offset[1]).cast("int").alias("y"), (F.col("id") % length + offset[2]).cast("int").alias("z"))


def is_air(name: Column) -> Column:
    return name.isNull() | name.isin(C.AIR, "air")


def import_volume(
    cells: DataFrame,
    sequence: Sequence[str],
    mapping: DataFrame | None = None,
    properties: DataFrame | None = None,
    biomes: DataFrame | None = None,
    min_section: int = -4,
    max_section: int = 20,
    quarts: bool = False,
) -> DataFrame:
    """Chunks of a dense volume ``(dimension, x, y, z, name, biome, *sequence)``.

    ``mapping`` (from_name, to_name) translates names; a name without a row stays.
    ``properties`` (name, keys) lists the allowed property keys of a block; others
    go. ``biomes`` (biome) lists known biomes; unknown ones are dropped. Cells
    outside the sections are dropped; every chunk that a cell names exists."""
    rows = cells
    if mapping is not None:
        rows = rows.join(mapping.select(F.col("from_name").alias("name"), "to_name"), "name", "left").withColumn("name", F.coalesce("to_name", "name")).drop("to_name")
    state = F.col("name")
    if properties is not None:
        rows = rows.withColumn("_base", S.state_name(F.col("name"))).join(properties.select(F.col("name").alias("_base"), "keys"), "_base", "left")
        kept = S.allowed_properties(S.typed_properties(F.col("name")), F.coalesce("keys", F.array().cast("array<string>")))
        state = F.when(S.has_properties(F.col("name")), S.format_state(F.col("_base"), kept)).otherwise(F.col("name"))
    rows = rows.withColumn("block", state)
    grid = rows.select("dimension", C.chunk_of(F.col("x")).alias("cx"), C.chunk_of(F.col("z")).alias("cz"))
    block_cells = addressed(rows.where(~is_air(F.col("block"))).select("dimension", "x", "y", "z", "block", *sequence), min_section, max_section)
    block_cells = last_wins(block_cells, [*SECTION_KEYS, "li"], sequence)
    biome_cells = None
    if "biome" in cells.columns:
        found = rows.where("biome IS NOT NULL")
        if biomes is not None:
            found = found.join(biomes.select("biome").distinct(), "biome", "left_semi")
        found = addressed(found.select("dimension", "x", "y", "z", "biome", *sequence), min_section, max_section, quarts)
        biome_cells = last_wins(found, [*SECTION_KEYS, "li"], sequence)
    return assemble(block_cells, biome_cells, grid, max_section - min_section, quarts)


def accepted_block_entity(name: Column, tag: Column) -> Column:
    """Whether a block entity converts: it needs a name and a tag."""
    return name.isNotNull() & tag.isNotNull()


def import_block_entities(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Block entities ``(dimension, x, y, z, name, tag)`` that convert and whose chunk exists."""
    good = found.where(accepted_block_entity(F.col("name"), F.col("tag"))).withColumns({"cx": C.chunk_of(F.col("x")), "cz": C.chunk_of(F.col("z")), "packed_xz": C.pack_xz(F.col("x"), F.col("z"))})
    there = chunks.select("dimension", F.col("x").alias("cx"), F.col("z").alias("cz"))
    return good.join(there, ["dimension", "cx", "cz"], "left_semi")


def with_block_entities(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """``chunks`` with the imported block entities in their lists, as tagged data with id and place."""
    from . import columns as K

    good = import_block_entities(found, chunks)
    tags = F.create_map(F.lit("tag"), F.col("tag").cast("string"))
    data = K.block_entity_data(F.col("name"), F.col("x"), F.col("y"), F.col("z"), tags)
    return K.to_chunks(chunks, block_entities=good.select("dimension", "x", "y", "z", data.alias("data")))


def import_schematic(cells: DataFrame, sequence: Sequence[str], version: str, block_entities: DataFrame | None = None, **options) -> DataFrame:
    """The chunks of a volume and of its block entities; a volume without a version has none."""
    chunks = import_volume(cells.where(F.lit(bool(version))), sequence, **options)
    return chunks if block_entities is None else with_block_entities(chunks, block_entities)


def progress_marks(spark, total: int, step: int = 5) -> DataFrame:
    """``(percent, processed)``: after how many cells each multiple of ``step`` percent is reached first."""
    marks = spark.range(0, 101, step).select(F.col("id").alias("percent"))
    first = F.greatest(F.lit(1), F.ceil(F.col("percent") * total / 100)).cast("bigint")
    return marks.withColumn("processed", first).where((F.lit(total) > 0) & (F.floor(F.col("processed") * 100 / F.lit(max(total, 1))) == F.col("percent")))
