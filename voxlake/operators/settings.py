"""World settings as tagged binary: encode, and decode with defaults for what is missing or of another type."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import codec, nbt
from .world import DEFAULT_SETTINGS, SETTING_KINDS

for _module in (__name__, nbt.__name__, codec.__name__):
    cloudpickle.register_pickle_by_value(sys.modules[_module])
_TAGS = {"boolean": "byte", "int": "int", "bigint": "long", "string": "string"}


def encode_settings(values: dict, order: str = "little") -> bytes:
    return nbt.encode({k: (_TAGS[SETTING_KINDS[k]], int(v) if isinstance(v, bool) else v) for k, v in values.items()}, order)


def decode_settings(data: bytes, order: str = "little", defaults: dict = DEFAULT_SETTINGS) -> dict:
    """Each key applies only if it is there with its type; the spawn only as a whole. No data is an error."""
    if not data:
        raise codec.FormatError("no settings data")
    found = nbt.decode(data, order)
    good = {k: v for k, (kind, v) in found.items() if k in SETTING_KINDS and kind == _TAGS[SETTING_KINDS[k]]}
    if not all(k in good for k in ("spawnX", "spawnY", "spawnZ")):
        good = {k: v for k, v in good.items() if not k.startswith("spawn")}
    return defaults | {k: bool(v) if SETTING_KINDS[k] == "boolean" else v for k, v in good.items()}


def with_settings_bytes(df: DataFrame, out: str = "settings", order: str = "little") -> DataFrame:
    """Add the encoded form of a table whose columns are the setting names."""

    @F.pandas_udf(T.BinaryType())
    def encode(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([encode_settings({k: (bool(v) if SETTING_KINDS[k] == "boolean" else str(v) if SETTING_KINDS[k] == "string" else int(v)) for k, v in r.items()}, order) for r in rows.to_dict("records")])

    return df.withColumn(out, encode(F.struct(*SETTING_KINDS)))


def decoded_settings(data: Column, order: str = "little") -> Column:
    """A struct of all settings from their encoded form."""
    fields = T.StructType([T.StructField(k, {"boolean": T.BooleanType(), "int": T.IntegerType(), "bigint": T.LongType(), "string": T.StringType()}[kind]) for k, kind in SETTING_KINDS.items()])

    @F.pandas_udf(fields)
    def decode(col: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_settings(bytes(x), order) for x in col], columns=list(SETTING_KINDS))

    return decode(data)


def nbt_scalars(data: Column, order: str = "little") -> Column:
    """Scalar tags of a compound as a map of texts."""

    @F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
    def scalars(col: pd.Series) -> pd.Series:
        return pd.Series([nbt.plain(nbt.decode(bytes(x or b""), order)) for x in col])

    return scalars(data)


#: Names of the enumerations, by number.
GAME_MODES = ("survival", "creative", "adventure", "spectator")
DIFFICULTIES = ("peaceful", "easy", "normal", "hard")


def enum_name(number: Column, names: tuple[str, ...]) -> Column:
    """The name of a number; null where it has none."""
    return F.try_element_at(F.array(*map(F.lit, names)), F.when(number.between(0, len(names) - 1), number.cast("int") + 1).otherwise(F.lit(len(names) + 1)))


def enum_number(name: Column, names: tuple[str, ...]) -> Column:
    """The number of a name; 0 where it is unknown."""
    return F.greatest(F.array_position(F.array(*map(F.lit, names)), name) - 1, F.lit(0)).cast("int")


def to_internal(settings: DataFrame) -> DataFrame:
    """Settings with enumerations as numbers."""
    return settings.withColumns({"defaultGameMode": enum_number(F.col("defaultGameMode"), GAME_MODES), "difficulty": enum_number(F.col("difficulty"), DIFFICULTIES)})


def from_internal(settings: DataFrame) -> DataFrame:
    """Settings with enumerations as names."""
    return settings.withColumns({"defaultGameMode": enum_name(F.col("defaultGameMode"), GAME_MODES), "difficulty": enum_name(F.col("difficulty"), DIFFICULTIES)})
