"""Columns to chunks and back: block entities, entities and scheduled ticks with their tagged data.

A column's parts are rows: block entities ``(dimension, x, y, z, data)``, entities
``(dimension, cx, cz, unique_id, uuid, data)`` and ticks ``(dimension, x, y, z,
block, tick)``; ``data`` is a tagged compound. What the file keeps beside the
data (identifier, vectors) is read from it, and views put it back.

Defined results: no data is an empty compound; a missing or wrongly typed id is
``minecraft:unknown``; vectors that have not three numbers are zero; a tick keeps
the name of its block without properties, and air where there is none; UUIDs and
user data are kept.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import coords as C
from ..functions import states as S
from ..sources import codec, nbt, worldfile
from . import views as X

for _module in (__name__, nbt.__name__, codec.__name__):
    cloudpickle.register_pickle_by_value(sys.modules[_module])

UNKNOWN = "minecraft:unknown"
NO_UUID = "00000000-0000-0000-0000-000000000000"
KEYS = ["dimension", "x", "z"]
_VECTOR = T.ArrayType(T.FloatType())


def _text(tags: dict, name: str, other: str = UNKNOWN) -> str:
    kind, value = tags.get(name, ("", None))
    return value if kind == "string" else other


def _vector(tags: dict, name: str) -> list[float]:
    kind, value = tags.get(name, ("", None))
    return [float(v) for v in value[1]] if kind == "list" and value[0] == "float" and len(value[1]) == 3 else [0.0] * 3


def _float(tags: dict, name: str) -> float:
    kind, value = tags.get(name, ("", 0.0))
    return float(value) if kind == "float" else 0.0


def block_entity_id(data: Column, order: str = "little") -> Column:
    """The ``id`` of a block entity's data."""

    @F.pandas_udf(T.StringType())
    def named(col: pd.Series) -> pd.Series:
        return pd.Series([_text(nbt.decode(bytes(x or b""), order), "id") for x in col])

    return named(data)


def encoded_entity(data: Column, unique_id: Column, order: str = "little") -> Column:
    """``(id, position, rotation, velocity, data)`` of an entity's data, which gets its UniqueID."""
    kinds = T.StructType([T.StructField("id", T.StringType()), T.StructField("position", _VECTOR), T.StructField("rotation", _VECTOR), T.StructField("velocity", _VECTOR), T.StructField("data", T.BinaryType())])

    @F.pandas_udf(kinds)
    def encode(col: pd.Series, ids: pd.Series) -> pd.DataFrame:
        rows = []
        for x, i in zip(col, ids):
            tags = nbt.decode(bytes(x or b""), order)
            whole = nbt.encode(tags | {"UniqueID": ("long", int(i))}, order)
            rows.append((_text(tags, "identifier"), _vector(tags, "Pos"), [_float(tags, "Yaw"), _float(tags, "Pitch")], _vector(tags, "Motion"), whole))
        return pd.DataFrame(rows, columns=kinds.names)

    return encode(data, F.coalesce(unique_id, F.lit(0).cast("bigint")))


def decoded_entity(e: Column, order: str = "little") -> Column:
    """``(unique_id, identifier, data)`` of a stored entity; its vectors stand in the data again."""
    kinds = T.StructType([T.StructField("unique_id", T.LongType()), T.StructField("identifier", T.StringType()), T.StructField("data", T.BinaryType())])

    @F.pandas_udf(kinds)
    def decode(data: pd.Series, ids: pd.Series, positions: pd.Series, rotations: pd.Series, velocities: pd.Series) -> pd.DataFrame:
        rows = []
        for x, name, p, r, v in zip(data, ids, positions, rotations, velocities):
            tags = nbt.decode(bytes(x or b""), order)
            if tags.get("identifier", ("",))[0] != "string" and name:
                tags["identifier"] = ("string", name)
            floats = lambda a: ("list", ("float", a.tolist()))
            tags |= {"Pos": floats(p), "Yaw": ("float", float(r[0])), "Pitch": ("float", float(r[1])), "Motion": floats(v)}
            kind, unique = tags.get("UniqueID", ("", 0))
            rows.append((int(unique) if kind == "long" else 0, _text(tags, "identifier"), nbt.encode(tags, order)))
        return pd.DataFrame(rows, columns=kinds.names)

    return decode(e["data"], e["id"], e["position"], e["rotation"], e["velocity"])


def block_entity_elements(rows: DataFrame) -> DataFrame:
    """``(dimension, cx, cz, v)``: block entities as a chunk's list holds them."""
    b = F.struct(C.pack_xz(F.col("x"), F.col("z")).cast("smallint").alias("packed_xz"), F.col("y").cast("int").alias("y"), block_entity_id(F.col("data")).alias("id"), F.coalesce("data", F.lit(b"")).alias("data"))
    return rows.select("dimension", C.chunk_of(F.col("x")).alias("cx"), C.chunk_of(F.col("z")).alias("cz"), b.alias("v"))


def entity_elements(rows: DataFrame) -> DataFrame:
    e = rows.select("dimension", "cx", "cz", F.coalesce("uuid", F.lit(NO_UUID)).alias("uuid"), encoded_entity(F.col("data"), F.col("unique_id")).alias("e"))
    return e.select("dimension", "cx", "cz", F.struct("uuid", "e.*").alias("v"))


def tick_elements(rows: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif(S.state_name(F.col("block")), F.lit("")), F.lit(C.AIR))
    t = F.struct(C.pack_xz(F.col("x"), F.col("z")).cast("smallint").alias("packed_xz"), F.col("y").cast("int").alias("y"), name.alias("block"), F.col("tick").cast("bigint").alias("tick"))
    return rows.select("dimension", C.chunk_of(F.col("x")).alias("cx"), C.chunk_of(F.col("z")).alias("cz"), t.alias("v"))


def _collected(rows: DataFrame, name: str) -> DataFrame:
    # a chunk is one row, as the format asks, so its lists meet in one place
    return rows.groupBy("dimension", F.col("cx").alias("x"), F.col("cz").alias("z")).agg(F.array_sort(F.collect_list("v")).alias(name))


def _elements(block_entities: DataFrame | None, entities: DataFrame | None, ticks: DataFrame | None) -> dict[str, DataFrame]:
    given = {"block_entities": (block_entities, block_entity_elements), "entities": (entities, entity_elements), "scheduled_ticks": (ticks, tick_elements)}
    return {name: made(rows) for name, (rows, made) in given.items() if rows is not None}


def to_chunks(chunks: DataFrame, block_entities: DataFrame | None = None, entities: DataFrame | None = None, ticks: DataFrame | None = None) -> DataFrame:
    """Whole chunks in the order of the file's schema; a part's chunk exists even where no block names it.

    ``chunks`` has ``(dimension, x, z, sections)`` and perhaps ``user_data``; lists that it has are kept where no part is given."""
    out = chunks
    for name, rows in _elements(block_entities, entities, ticks).items():
        out = out.drop(name).join(_collected(rows, name), KEYS, "full")
    kinds = T._parse_datatype_string(worldfile.CHUNKS)
    none = {"block_entities", "entities", "scheduled_ticks", "sections"}
    column = lambda f: (F.col(f.name) if f.name in out.columns else F.lit(None)).cast(f.dataType)
    return out.select(*[(F.coalesce(column(f), F.array().cast(f.dataType)) if f.name in none else F.coalesce(column(f), F.lit(b"")) if f.name == "user_data" else column(f)).alias(f.name) for f in kinds])


def write_columns(chunks: DataFrame, path: str, block_entities: DataFrame | None = None, entities: DataFrame | None = None, ticks: DataFrame | None = None, **options) -> None:
    """The files of ``to_chunks``, without its rows: elements go to the file as they are, so no list of a chunk meets in a row."""
    parts = {n: e.select("dimension", F.col("cx").alias("x"), F.col("cz").alias("z"), "v") for n, e in _elements(block_entities, entities, ticks).items()}
    worldfile.write_worlds(chunks, path, **options, **parts)


def block_entity_records(chunks: DataFrame, order: str = "little") -> DataFrame:
    """Block entities at absolute places with their scalar tags as text."""
    from .settings import nbt_scalars

    return X.block_entities(chunks).withColumn("tags", nbt_scalars(F.col("data"), order))


def entity_records(chunks: DataFrame, order: str = "little") -> DataFrame:
    """Entities with unique id and identifier, and data that holds their vectors."""
    e = X.entities(chunks)
    told = e.withColumn("_told", decoded_entity(F.struct("data", "id", "position", "rotation", "velocity"), order))
    return told.select("dimension", "chunk_x", "chunk_z", "uuid", "_told.unique_id", "_told.identifier", "position", "rotation", "velocity", "_told.data")


def block_entity_data(name: Column, x: Column, y: Column, z: Column, tags: Column, order: str = "little") -> Column:
    """A block entity's tagged data from its id, place and a map of texts."""

    @F.pandas_udf(T.BinaryType())
    def encode(names: pd.Series, xs: pd.Series, ys: pd.Series, zs: pd.Series, maps: pd.Series) -> pd.Series:
        out = []
        for n, a, b, c, m in zip(names, xs, ys, zs, maps):
            items = m.items() if isinstance(m, dict) else (m if m is not None else [])
            own = {k: ("string", v) for k, v in items if v is not None}
            out.append(nbt.encode(own | {"x": ("int", int(a)), "y": ("int", int(b)), "z": ("int", int(c))} | ({"id": ("string", n)} if n else {}), order))
        return pd.Series(out)

    return encode(name, x, y, z, tags)


def converted_entities(rows: DataFrame) -> DataFrame:
    """Entities of an imported volume ``(dimension, id, x, y, z, motion, rotation, uuid_ints)`` as chunk parts.

    A UUID comes from four integers; rows without an id are dropped; a missing UUID is derived from the row."""
    from .views import uuid_from_ints, vector_or_zero

    good = rows.where("id IS NOT NULL AND id <> ''")
    made = F.md5(F.concat_ws("|", "id", *[F.col(c).cast("string") for c in ("x", "y", "z")]))
    made = F.concat_ws("-", *[F.substring(made, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    whole = lambda c: F.floor(c).cast("int")
    e = F.struct(
        F.when(F.size("uuid_ints") == 4, uuid_from_ints(F.col("uuid_ints"))).otherwise(made).alias("uuid"),
        F.col("id"),
        F.array(*[F.col(c).cast("float") for c in ("x", "y", "z")]).alias("position"),
        vector_or_zero(F.col("rotation"), 2).alias("rotation"),
        vector_or_zero(F.col("motion")).alias("velocity"),
        block_entity_data(F.col("id"), whole(F.col("x")), whole(F.col("y")), whole(F.col("z")), F.create_map().cast("map<string,string>")).alias("data"),
    )
    return _collected(good.select("dimension", C.chunk_of(whole(F.col("x"))).alias("cx"), C.chunk_of(whole(F.col("z"))).alias("cz"), e.alias("v")), "entities")
