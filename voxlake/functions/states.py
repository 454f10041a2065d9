"""Block states, ``name[key=value,...]``: split, parse, infer types, format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PAIRS = "array<struct<key:string,text:string>>"


def split_properties(s: Column) -> Column:
    """Pieces between commas outside brackets and braces; empty pieces go. Quotes mean nothing."""
    flat = F.filter(F.split(s, ","), lambda x: x != "")
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("now"), none.alias("out"))

    def step(a: Column, c: Column) -> Column:
        depth = a["depth"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)
        cut = (c == ",") & (a["depth"] == 0)
        out = F.when(cut & (a["now"] != ""), F.array_append(a["out"], a["now"])).otherwise(a["out"])
        return F.struct(depth.alias("depth"), F.when(cut, F.lit("")).otherwise(F.concat(a["now"], c)).alias("now"), out.alias("out"))

    # pieces that hold no bracket need no walk over their characters
    nested = F.aggregate(F.filter(F.split(s, ""), lambda x: x != ""), start, step, lambda a: F.when(a["now"] != "", F.array_append(a["out"], a["now"])).otherwise(a["out"]))
    return F.when(s.rlike(r"[\[\]{}]"), nested).otherwise(flat)


def state_name(s: Column) -> Column:
    return F.substring_index(s, "[", 1)


def has_properties(s: Column) -> Column:
    """Whether there is a bracket at all: ``name[]`` has an empty property list, ``name`` has none."""
    return F.contains(s, F.lit("["))


def state_inside(s: Column) -> Column:
    """What stands between the first bracket and one closing bracket at the end."""
    inner = F.substring(s, F.locate("[", s) + 1, F.length(s))
    return F.when(has_properties(s), F.when(F.endswith(inner, F.lit("]")), F.substring(inner, F.lit(1), F.length(inner) - 1)).otherwise(inner)).otherwise("")


def state_properties(s: Column) -> Column:
    """Pairs (key, text) in order of key; a pair without ``=`` is skipped, a later key wins."""
    with_sign = F.filter(split_properties(state_inside(s)), lambda p: F.contains(p, F.lit("=")))
    pairs = F.transform(with_sign, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.substring(p, F.call_function("locate", F.lit("="), p) + 1, F.length(p)).alias("text")))
    last = lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.greatest(F.size(ps) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"]))
    return F.array_sort(F.element_at(F.transform(F.array(pairs), last), 1))


def infer_kind(s: Column) -> Column:
    """bool, byte, string, float or int: the first kind that the text reads as; a numeric prefix is enough."""
    whole = F.regexp_extract(s, r"^[+-]?[0-9]+", 0)
    small = F.coalesce(whole.try_cast("bigint").between(-(1 << 31), (1 << 31) - 1), F.lit(False))
    return (
        F.when(s.isin("true", "false"), "bool")
        .when(s.rlike(r"^0x[0-9a-fA-F]"), "byte")
        .when((F.length(s) >= 2) & F.startswith(s, F.lit('"')) & F.endswith(s, F.lit('"')), "string")
        .when(F.contains(s, F.lit(".")) & s.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)"), "float")
        .when((whole != "") & small, "int")
        .otherwise("string")
    )


def infer_text(s: Column) -> Column:
    """The value's plain text: decimal for bytes and ints, the numeric prefix of floats, strings without their quotes."""
    kind = infer_kind(s)
    return (
        F.when(kind == "byte", F.conv(F.regexp_extract(s, r"^0x([0-9a-fA-F]{1,2})", 1), 16, 10))
        .when(kind == "int", F.regexp_extract(s, r"^[+-]?[0-9]+", 0).try_cast("int").cast("string"))
        .when(kind == "float", F.regexp_extract(s, r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)", 0))
        .when((F.length(s) >= 2) & F.startswith(s, F.lit('"')) & F.endswith(s, F.lit('"')), F.substring(s, F.lit(2), F.length(s) - 2))
        .otherwise(s)
    )


def one_decimal(x: Column) -> Column:
    """A float with one decimal, the exact binary value rounded half to even."""
    rounded = F.bround(x.cast("float").cast("double").cast("decimal(38,20)"), 1)
    return rounded.cast("decimal(38,1)").cast("string")


def format_value(kind: Column, text: Column) -> Column:
    return (
        F.when(kind == "byte", F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(text.try_cast("bigint")), 2, "0"))))
        .when(kind == "float", one_decimal(text.try_cast("float")))
        .when(kind == "string", F.concat(F.lit('"'), text, F.lit('"')))
        .otherwise(text)
    )


def format_state(name: Column, properties: Column) -> Column:
    """``name[key=value,...]`` in order of key; ``properties`` are (key, kind, text)."""
    shown = F.transform(F.array_sort(properties), lambda p: F.concat(p["key"], F.lit("="), format_value(p["kind"], p["text"])))
    return F.when(F.coalesce(F.size(properties), F.lit(0)) <= 0, name).otherwise(F.concat(name, F.lit("["), F.array_join(shown, ","), F.lit("]")))


def typed_properties(s: Column) -> Column:
    """Pairs of a state with their kinds: (key, kind, text)."""
    return F.transform(state_properties(s), lambda p: F.struct(p["key"].alias("key"), infer_kind(p["text"]).alias("kind"), infer_text(p["text"]).alias("text")))


def allowed_properties(properties: Column, allowed: Column) -> Column:
    """Only the pairs whose key is allowed."""
    return F.filter(properties, lambda p: F.array_contains(allowed, p["key"]))
