"""Worlds and stores: keyed chunks with a change set, and a directory of dimensions.

DataFrames do not change, so a world is a value: ``set_chunks`` returns another
world. A read-only world returns itself, or raises in strict mode.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coords as C
from ..sources import worldfile

DIMENSIONS = ("overworld", "nether", "end")
#: Settings of a new store.
DEFAULT_SETTINGS = {
    "name": "Pile", "spawnX": 0, "spawnY": 0, "spawnZ": 0, "time": 6000, "timeCycle": False, "rainTime": 0, "raining": False,
    "thunderTime": 0, "thundering": False, "weatherCycle": False, "currentTick": 0, "defaultGameMode": 2, "difficulty": 2,
}
SETTING_KINDS = {k: "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "int" if k.startswith("spawn") or k in ("defaultGameMode", "difficulty") else "bigint" for k, v in DEFAULT_SETTINGS.items()}


class ReadOnlyError(RuntimeError):
    """A change of a read-only world in strict mode."""


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("dimension", "x", "z")) -> DataFrame:
    """``new`` rows replace ``old`` rows with equal keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def dirty_chunks(chunks: DataFrame, changed: DataFrame) -> DataFrame:
    """Chunks that exist and are in the change set."""
    return chunks.join(changed, ["dimension", "x", "z"], "left_semi")


@dataclass(frozen=True)
class World:
    chunks: DataFrame
    min_section: int = -4
    max_section: int = 20
    user_data: bytes = b""
    read_only: bool = False
    strict: bool = False
    changed: DataFrame | None = None

    @staticmethod
    def create(spark: SparkSession, min_section: int = -4, max_section: int = 20) -> World:
        return World(spark.createDataFrame([], worldfile.CHUNKS), min_section, max_section)

    def problem(self) -> str:
        """``ok`` or the bound that the section range breaks."""
        low, high = self.min_section, self.max_section
        return "min" if low < -128 else "max" if high > 128 else "order" if low >= high else "count" if high - low > 512 else "ok"

    def _refused(self) -> bool:
        if self.read_only and self.strict:
            raise ReadOnlyError("the world is read-only")
        return self.read_only

    def chunk(self, x: int, z: int) -> DataFrame:
        return self.chunks.where((F.col("x") == x) & (F.col("z") == z))

    def box(self, x0: int, z0: int, x1: int, z1: int) -> DataFrame:
        """Chunks that a box of block coordinates touches: the bounds reach the scan as chunk bounds."""
        return self.chunks.where(F.col("x").between(x0 >> 4, x1 >> 4) & F.col("z").between(z0 >> 4, z1 >> 4))

    def set_chunks(self, new: DataFrame) -> World:
        if self._refused():
            return self
        keys = new.select("dimension", "x", "z")
        return replace(self, chunks=upsert(self.chunks, new), changed=keys if self.changed is None else self.changed.unionByName(keys).distinct())

    def set_user_data(self, data: bytes) -> World:
        return self if self._refused() else replace(self, user_data=bytes(data))

    def dirty(self) -> DataFrame:
        return self.chunks.where("false") if self.changed is None else dirty_chunks(self.chunks, self.changed)

    def clear_dirty(self) -> World:
        return replace(self, changed=None)

    def is_dirty(self) -> bool:
        return self.changed is not None and not self.changed.isEmpty()

    def count(self) -> int:
        return self.chunks.select("dimension", "x", "z").distinct().count()


@dataclass(frozen=True)
class Store:
    """A directory with one world file for each dimension."""

    spark: SparkSession
    path: str
    world: World
    settings: dict = field(default_factory=lambda: dict(DEFAULT_SETTINGS))
    compression: str = "default"
    streaming: bool = False
    spawns: DataFrame | None = None
    touched: bool = False

    @staticmethod
    def open(spark: SparkSession, path: str, compression: str = "default", read_only: bool = False, streaming: bool = False) -> Store:
        """Missing files are skipped; a freshly read world has no changes."""
        try:
            chunks = worldfile.read_worlds(spark, path)
            # one row for each dimension's file
            found = worldfile.read_world_headers(spark, path)
            heads = found.agg(F.min("min_section").alias("a"), F.max("max_section").alias("b"), F.max_by("user_data", F.when(F.octet_length("user_data") == 0, 0).when(F.col("dimension") == "overworld", 2).otherwise(1)).alias("u")).first()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            heads = None
        world = World(chunks, heads["a"], heads["b"], bytes(heads["u"] or b"")) if heads and heads["a"] is not None else World.create(spark)
        return Store(spark, path, replace(world, read_only=read_only), compression=compression, streaming=streaming)

    def load_column(self, dimension: str, x: int, z: int) -> DataFrame:
        """The chunk, or no row where it is missing."""
        return self.world.chunk(x, z).where(F.col("dimension") == dimension)

    def store_columns(self, new: DataFrame) -> Store:
        return replace(self, world=self.world.set_chunks(new))

    def user_data(self) -> bytes:
        return self.world.user_data

    def set_user_data(self, data: bytes) -> Store:
        """Bytes for the header of the world's files; a change that ``close`` writes."""
        return replace(self, world=self.world.set_user_data(data), touched=self.touched or not self.world.read_only)

    def set_level(self, compression: str) -> Store:
        return replace(self, compression=compression)

    def set_streaming(self, streaming: bool) -> Store:
        return replace(self, streaming=streaming)

    def save_plan(self) -> DataFrame:
        """``(dimension, chunks, changed)``: what a save would write."""
        keys = ["dimension", "x", "z"]
        marked = self.world.chunks.select(*keys).distinct().join(self.world.dirty().select(*keys).distinct().withColumn("hit", F.lit(1)), keys, "left")
        return marked.groupBy("dimension").agg(F.count("*").alias("chunks"), F.count("hit").alias("changed"))

    def save_settings(self, **changes) -> Store:
        return replace(self, settings=self.settings | changes)

    def load_spawn(self, uuid: str) -> DataFrame | None:
        return None if self.spawns is None else self.spawns.where(F.col("uuid") == uuid)

    def save_spawns(self, new: DataFrame) -> Store:
        return replace(self, spawns=new if self.spawns is None else upsert(self.spawns, new, ("uuid",)))

    def chunk_counts(self) -> DataFrame:
        return dimension_counts(self.world.chunks)

    def save(self) -> Store:
        """Write all dimensions; a read-only store writes nothing."""
        if not self.world.read_only:
            worldfile.write_worlds(self.world.chunks, self.path, compression=self.compression, streaming=self.streaming, min_section=self.world.min_section, max_section=self.world.max_section, user_data=self.world.user_data)
        return replace(self, world=self.world.clear_dirty(), touched=False)

    def close(self) -> Store:
        """Save if there are changes."""
        return self.save() if self.touched or self.world.is_dirty() else self


def route(dimension: Column) -> Column:
    """File name of a dimension."""
    out = F.lit("unknown.pile")
    for d, name in worldfile.FILES.items():
        out = F.when(dimension == d, name).otherwise(out)
    return out


def dimension_counts(chunks: DataFrame) -> DataFrame:
    """``(dimension, chunks)`` for each dimension, 0 where it has none, and ``all``."""
    found = chunks.groupBy("dimension").agg(F.count("*").alias("n"))
    dims = chunks.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, DIMENSIONS))).alias("dimension"))
    each = dims.join(found, "dimension", "left").select("dimension", F.coalesce("n", F.lit(0)).cast("bigint").alias("chunks"))
    return each.unionByName(each.agg(F.sum("chunks").alias("chunks")).select(F.lit("all").alias("dimension"), "chunks"))


def settings_from(values: Column) -> list[Column]:
    """Settings from a map of texts: each applies if it reads as its type, the spawn only as a whole; else the default."""
    out = []
    cast = {k: values[k].try_cast(kind if kind != "boolean" else "int") for k, kind in SETTING_KINDS.items()}
    spawn = cast["spawnX"].isNotNull() & cast["spawnY"].isNotNull() & cast["spawnZ"].isNotNull()
    for k, kind in SETTING_KINDS.items():
        value = cast[k] != 0 if kind == "boolean" else cast[k]
        if k.startswith("spawn"):
            value = F.when(spawn, value)
        out.append(F.coalesce(value, F.lit(DEFAULT_SETTINGS[k]).cast(kind)).alias(k))
    return out


def chunk_keys(chunks: DataFrame) -> DataFrame:
    return chunks.select("dimension", "x", "z", C.chunk_key(F.col("x"), F.col("z")).alias("chunk_key"))
