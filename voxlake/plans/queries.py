"""One query for each operator, over whole driver tables, with the same result in SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import coords as C
from ..functions import packing as P
from ..functions import states as S
from ..functions import varint as N
from ..operators import build as B
from ..operators import columns as K
from ..operators import settings as ST
from ..operators import views as X
from ..operators import world as W
from ..sources import codec, nbt
from ..sources import worldfile as WF
from ..streaming import upsert as U
from . import virtual as V
from .virtual import ADDRESSED, BLOCK_ENTITY, CELLS, ENTITY, PALETTE, PLACED, table

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _FOUND[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _FOUND.items() if s}


_KEY = "CAST({x} AS BIGINT) * 4294967296 + (CAST({z} AS BIGINT) & 4294967295)"


# --- coordinates and keys


@query(f"WITH {PLACED} SELECT DISTINCT x, z, {_KEY.format(x='x', z='z')} AS chunk_key FROM placed")
def chunk_key(spark, d):
    return V.placements(spark, d).select("x", "z").distinct().withColumn("chunk_key", V.key_of("x", "z"))


@query(f"WITH {ADDRESSED} SELECT cx, cz, si, li, st AS block FROM i")
def cell_address(spark, d):
    return V.addressed(spark, d).select("cx", "cz", "si", "li", "block")


@query("""SELECT p_partkey, CASE WHEN mn < -128 THEN 'min' WHEN mx > 128 THEN 'max' WHEN mn >= mx THEN 'order' WHEN mx - mn > 512 THEN 'count' ELSE 'ok' END AS problem
FROM (SELECT p_partkey, CAST(p_partkey % 300 AS INT) - 150 AS mn, CAST(p_size * 7 AS INT) - 170 AS mx FROM part)""")
def validate_dimensions(spark, d):
    p = table(spark, d, "part").select("p_partkey", ((F.col("p_partkey") % 300) - 150).cast("int").alias("mn"), (F.col("p_size") * 7 - 170).cast("int").alias("mx"))
    return p.select("p_partkey", C.dimension_problem(F.col("mn"), F.col("mx")).alias("problem"))


# --- the world as a keyed collection

_LAST = "row_number() OVER (PARTITION BY {k} ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) = 1"


def _chunk_table(spark, d):
    return B.last_wins(V.sequenced_chunks(spark, d), ["dimension", "x", "z"], V.SEQUENCE)


@query(f"WITH {PLACED} SELECT x, z, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM placed QUALIFY {_LAST.format(k='x, z')}")
def chunk_upsert(spark, d):
    return _chunk_table(spark, d).select("x", "z", *V.SEQUENCE)


@query(f"WITH {PLACED} SELECT x >> 4 AS cx, z >> 4 AS cz, (y >> 4) + 4 AS si, (y & 15) * 256 + (z & 15) * 16 + (x & 15) AS li, st AS block FROM placed WHERE (y >> 4) + 4 BETWEEN 0 AND 23 QUALIFY {_LAST.format(k='x, y, z')}")
def cell_last_wins(spark, d):
    a = B.addressed(V.placements(spark, d))
    return B.last_wins(a, [*B.SECTION_KEYS, "li"], V.SEQUENCE).select("cx", "cz", "si", "li", "block")


@query(f"WITH {PLACED} SELECT x, z, l_orderkey, l_linenumber FROM placed WHERE x = 3 AND z = -5 QUALIFY {_LAST.format(k='x, z')}")
def chunk_lookup(spark, d):
    return W.World(_chunk_table(spark, d)).chunk(3, -5).select("x", "z", "l_orderkey", "l_linenumber")


@query(f"WITH {ADDRESSED} SELECT cx AS x, cz AS z, {_KEY.format(x='cx', z='cz')} AS chunk_key FROM i GROUP BY cx, cz")
def chunk_scan(spark, d):
    return W.chunk_keys(V.chunks(spark, d)).select("x", "z", "chunk_key")


@query(f"WITH {PLACED} SELECT count(*) AS chunks FROM (SELECT DISTINCT x, z FROM placed)")
def chunk_count(spark, d):
    return V.placements(spark, d).select(F.count_distinct("x", "z").alias("chunks"))


_CHANGED = "changed AS (SELECT DISTINCT CAST(o_custkey % 90 - 45 AS INT) AS x, CAST(o_orderkey % 90 - 45 AS INT) AS z FROM orders WHERE o_orderstatus = 'F')"


def _changed(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return o.select(F.lit("overworld").alias("dimension"), (F.col("o_custkey") % 90 - 45).cast("int").alias("x"), (F.col("o_orderkey") % 90 - 45).cast("int").alias("z")).distinct()


@query(f"WITH {PLACED}, {_CHANGED} SELECT DISTINCT p.x, p.z FROM placed p SEMI JOIN changed c ON p.x = c.x AND p.z = c.z")
def dirty_chunks(spark, d):
    there = V.placements(spark, d).select("dimension", "x", "z").distinct()
    return W.dirty_chunks(there, _changed(spark, d)).select("x", "z")


@query(f"WITH {_CHANGED} SELECT count(*) > 0 AS dirty FROM changed")
def dirty_flag(spark, d):
    world = W.World(_chunk_table(spark, d).select("dimension", "x", "z"))
    return spark.createDataFrame([(world.set_chunks(_changed(spark, d)).is_dirty(),)], "dirty boolean")


@query("SELECT * FROM (VALUES ('fresh', false), ('changed', true), ('cleared', false), ('read-only', false)) t(state, dirty)")
def dirty_cleared(spark, d):
    world = W.World(_chunk_table(spark, d).select("dimension", "x", "z"))
    changed = world.set_chunks(_changed(spark, d))
    fixed = W.World(world.chunks, read_only=True).set_chunks(_changed(spark, d))
    states = {"fresh": world, "changed": changed, "cleared": changed.clear_dirty(), "read-only": fixed}
    return spark.createDataFrame([(k, w.is_dirty()) for k, w in states.items()], "state string, dirty boolean")


@query("SELECT * FROM (VALUES (-4, 20, 'ok', CAST(0 AS BIGINT)), (-64, 64, 'ok', 0), (-32, 0, 'ok', 0), (0, 16, 'ok', 0), (-129, 0, 'min', 0), (0, 129, 'max', 0), (5, 5, 'order', 0)) t(low, high, problem, chunks)")
def world_create(spark, d):
    worlds = [W.World.create(spark, a, b) for a, b in ((-4, 20), (-64, 64), (-32, 0), (0, 16), (-129, 0), (0, 129), (5, 5))]
    return spark.createDataFrame([(w.min_section, w.max_section, w.problem(), w.count()) for w in worlds], "low int, high int, problem string, chunks long")


@query(f"WITH {PLACED} SELECT x, z, l_orderkey FROM placed QUALIFY {_LAST.format(k='x, z')}")
def readonly_noop(spark, d):
    world = W.World(_chunk_table(spark, d), read_only=True)
    other = _chunk_table(spark, d).withColumn("l_orderkey", F.lit(-1).cast("bigint"))
    return world.set_chunks(other).chunks.select("x", "z", "l_orderkey")


@query(f"""WITH {PLACED}, {_CHANGED}, old AS (SELECT x, z, l_orderkey FROM placed QUALIFY {_LAST.format(k='x, z')})
SELECT x, z, l_orderkey FROM old o WHERE NOT EXISTS (SELECT 1 FROM changed c WHERE c.x = o.x AND c.z = o.z) UNION ALL SELECT x, z, CAST(-1 AS BIGINT) FROM changed""")
def world_set_chunks(spark, d):
    old = _chunk_table(spark, d).select("dimension", "x", "z", "l_orderkey")
    new = _changed(spark, d).withColumn("l_orderkey", F.lit(-1).cast("bigint"))
    return W.World(old).set_chunks(new).chunks.select("x", "z", "l_orderkey")


# --- sections


@query(f"WITH {ADDRESSED}, s AS (SELECT cx, cz, si FROM i GROUP BY ALL), c AS (SELECT DISTINCT cx, cz FROM s) SELECT c.cx AS x, c.cz AS z, CAST(r.k AS INT) AS section_index, s.si IS NULL AS empty FROM c CROSS JOIN (SELECT unnest(range(24)) AS k) r LEFT JOIN s ON s.cx = c.cx AND s.cz = c.cz AND s.si = r.k")
def section_is_empty(spark, d):
    s = X.sections(V.chunks(spark, d), keep_empty=True)
    return s.select("x", "z", "section_index", P.is_empty_palette(F.col("block_palette")).alias("empty"))


@query("SELECT p_partkey, n = 0 OR (n = 1 AND p_partkey % 2 = 0) AS empty, CASE WHEN n = 0 OR (n = 1 AND p_partkey % 2 = 0) THEN 35 ELSE NULL END AS encoded_bytes FROM (SELECT p_partkey, CAST(p_partkey % 3 AS INT) AS n FROM part)")
def empty_section_canonical(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 3).cast("int").alias("n"))
    first = F.when(F.col("p_partkey") % 2 == 0, C.AIR).otherwise("minecraft:stone")
    palette = F.slice(F.array(first, F.lit("minecraft:dirt")), F.lit(1), F.col("n"))
    none = F.array().cast("array<bigint>")
    size = N.section_size(F.array(F.lit(C.AIR)), none, F.array(F.lit(C.PLAINS)), none)
    empty = P.is_empty_palette(palette)
    return p.select("p_partkey", empty.alias("empty"), F.when(empty, size).alias("encoded_bytes"))


@query(f"WITH {ADDRESSED}, s AS (SELECT DISTINCT cx, cz, si FROM i), c AS (SELECT DISTINCT cx, cz FROM s), w AS (SELECT 10 AS n UNION ALL SELECT 30) SELECT c.cx AS x, c.cz AS z, w.n AS wanted, w.n AS sections, (SELECT count(*) FROM s WHERE s.cx = c.cx AND s.cz = c.cz AND s.si < w.n) AS filled FROM c CROSS JOIN w")
def section_pad_truncate(spark, d):
    c = V.chunks(spark, d)
    out = None
    for n in (10, 30):
        s = c.withColumn("sections", B.padded(F.col("sections"), n))
        one = s.select("x", "z", F.lit(n).alias("wanted"), F.size("sections").alias("n"), F.size(F.filter("sections", lambda q: q.isNotNull())).cast("bigint").alias("filled"))
        one = one.select("x", "z", "wanted", F.col("n").alias("sections"), "filled")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {PLACED} SELECT y >= -64 AND y < 320 AS inside, count(*) AS cells FROM placed GROUP BY 1")
def section_bounds(spark, d):
    p = V.placements(spark, d)
    return p.groupBy(C.within_sections(F.col("y"), -4, 20).alias("inside")).agg(F.count("*").alias("cells"))


_NAMED = "named AS (SELECT p_partkey, CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'air' WHEN 2 THEN 'minecraft:air' WHEN 3 THEN concat('minecraft:', lower(split_part(p_type, ' ', 1))) ELSE lower(p_brand) END AS name FROM part)"


def _named(spark, d):
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "air").when(k == 2, C.AIR).when(k == 3, F.concat(F.lit("minecraft:"), F.lower(F.split_part(F.col("p_type"), F.lit(" "), F.lit(1))))).otherwise(F.lower("p_brand"))
    return table(spark, d, "part").select("p_partkey", name.alias("name"))


@query(f"WITH {_NAMED} SELECT p_partkey, name FROM named WHERE name IS NOT NULL AND name NOT IN ('minecraft:air', 'air')")
def air_filter(spark, d):
    return _named(spark, d).where(~B.is_air(F.col("name")))


@query("SELECT CAST(a.k - 20 AS INT) AS x, CAST(b.k + 60 AS INT) AS y, CAST(c.k - 9 AS INT) AS z FROM (SELECT unnest(range(33)) AS k) a, (SELECT unnest(range(17)) AS k) b, (SELECT unnest(range(20)) AS k) c")
def schem_cells(spark, d):
    return B.dense_volume(spark, 33, 17, 20, (-20, 60, -9))


@query(f"WITH {PLACED} SELECT x >> 4 AS x, z >> 4 AS z, CAST(sum(CASE WHEN (y >> 4) + 4 BETWEEN 0 AND 23 AND l_linenumber > 3 THEN 1 ELSE 0 END) AS BIGINT) AS placed FROM placed GROUP BY x >> 4, z >> 4")
def import_chunk_grid(spark, d):
    p = V.placements(spark, d)
    grid = p.select(C.chunk_of(F.col("x")).alias("cx"), C.chunk_of(F.col("z")).alias("cz")).distinct()
    found = B.addressed(p.where("l_linenumber > 3")).groupBy("cx", "cz").agg(F.count("*").alias("n"))
    return grid.join(found, ["cx", "cz"], "left").select(F.col("cx").alias("x"), F.col("cz").alias("z"), F.coalesce("n", F.lit(0)).cast("bigint").alias("placed"))


# --- palettes and packing


@query("SELECT CAST(n AS INT) AS n, CASE WHEN n <= 1 THEN 0 ELSE CAST(length(ltrim(bin(n - 1), '0')) AS INT) END AS bits FROM (SELECT unnest(range(0, 4098)) AS n)")
def bits_per_entry(spark, d):
    n = spark.range(4098).select(F.col("id").cast("int").alias("n"))
    return n.select("n", P.bits_per_entry(F.col("n")).alias("bits"))


@query(f"WITH {PALETTE} SELECT cx, cz, si, st AS block, pi FROM pal")
def palette_build(spark, d):
    return B.palettes(V.addressed(spark, d), "block", C.AIR).select("cx", "cz", "si", "block", "pi")


@query(f"WITH {ADDRESSED} SELECT cx, cz, si, st AS biome, CAST(row_number() OVER (PARTITION BY cx, cz, si ORDER BY f) - 1 AS INT) AS pi FROM (SELECT cx, cz, si, st, min(li) AS f FROM i GROUP BY ALL)")
def biome_palette_first_seen(spark, d):
    a = V.addressed(spark, d).withColumnRenamed("block", "biome")
    return B.palettes(a, "biome", by_first_seen=True).select("cx", "cz", "si", "biome", "pi")


@query("SELECT p_partkey, CAST(CASE k WHEN 5 THEN 3 ELSE k END AS INT) AS place FROM (SELECT p_partkey, CASE WHEN p_partkey % 6 = 5 THEN 5 ELSE CASE WHEN p_partkey % 6 > 2 THEN 3 ELSE p_partkey % 6 END END AS k FROM part)")
def palette_find_or_add(spark, d):
    palette = F.array(*[F.lit(f"b{i}") for i in range(3)])
    return table(spark, d, "part").select("p_partkey", P.find_or_add(palette, F.concat(F.lit("b"), (F.col("p_partkey") % 6).cast("string"))).alias("place"))


_WORD = "CAST(CASE WHEN v >= 9223372036854775808 THEN v - 18446744073709551616 ELSE v END AS BIGINT)"


@query(f"""WITH {PALETTE}, v AS (SELECT i.cx, i.cz, i.si, CAST(i.li // (64 // bits) AS INT) AS w, sum(CAST(pal.pi AS HUGEINT) * (CAST(1 AS HUGEINT) << CAST((i.li % (64 // bits)) * bits AS INT))) AS v
FROM i JOIN pal USING (cx, cz, si, st) JOIN b USING (cx, cz, si) GROUP BY ALL) SELECT cx, cz, si, w, {_WORD} AS word FROM v""")
def pack_words(spark, d):
    a = V.addressed(spark, d)
    pal = B.palettes(a, "block", C.AIR)
    sized = pal.groupBy(*B.SECTION_KEYS).agg(P.bits_per_entry(F.count("*") + 1).alias("bits"))
    return P.pack_cells(a.join(pal, [*B.SECTION_KEYS, "block"]).join(sized, B.SECTION_KEYS), B.SECTION_KEYS, "li", "pi", "bits").select("cx", "cz", "si", "w", "word")


@query(f"WITH {PALETTE} SELECT i.cx, i.cz, i.si, i.li, pal.pi FROM i JOIN pal USING (cx, cz, si, st)")
def unpack_words(spark, d):
    s = X.sections(V.chunks(spark, d)).select(F.col("x").alias("cx"), F.col("z").alias("cz"), F.col("section_index").alias("si"), "block_palette", "block_data")
    return P.explode_cells(s, "block_palette", "block_data").where("pi > 0").select("cx", "cz", "si", "li", "pi")


@query(f"""WITH {PALETTE}, r AS (SELECT cx, cz, si, CAST(length(ltrim(bin(n * 5 - 1), '0')) AS INT) AS bits FROM sz),
v AS (SELECT i.cx, i.cz, i.si, CAST(i.li // (64 // bits) AS INT) AS w, sum(CAST(pal.pi AS HUGEINT) * (CAST(1 AS HUGEINT) << CAST((i.li % (64 // bits)) * bits AS INT))) AS v
FROM i JOIN pal USING (cx, cz, si, st) JOIN r USING (cx, cz, si) GROUP BY ALL) SELECT cx, cz, si, w, {_WORD} AS word FROM v""")
def repack_bits(spark, d):
    s = X.sections(V.chunks(spark, d))
    n = F.size("block_palette")
    s = s.withColumn("words", P.repack_array(F.col("block_data"), n, n * 5))
    return s.select(F.col("x").alias("cx"), F.col("z").alias("cz"), F.col("section_index").alias("si"), F.posexplode("words").alias("w", "word")).where("word <> 0")


@query("""SELECT p_partkey, CAST(w AS INT) AS w, CAST(sum(((p_partkey + w * 16 + j) % 3) << CAST(4 * j AS INT)) AS BIGINT) AS word
FROM (SELECT p_partkey, unnest(range(4)) AS w FROM part), (SELECT unnest(range(15)) AS j) GROUP BY ALL""")
def repack_biomes(spark, d):
    """64 biome entries of a palette of three at the width of a palette of fifteen; the highest entry of a word is left out."""
    p = table(spark, d, "part").select("p_partkey", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((F.col("p_partkey") + i) % 3).cast("int")).alias("ix"))
    p = p.withColumn("old", P.pack_array(F.col("ix"), F.lit(2))).withColumn("new", P.repack_array(F.col("old"), F.lit(3), F.lit(15), 64))
    words = p.select("p_partkey", F.posexplode("new").alias("w", "word"))
    return words.select("p_partkey", "w", F.col("word").bitwiseAND((1 << 60) - 1).alias("word"))


@query(f"WITH {ADDRESSED} SELECT x, y, z, st AS block FROM i")
def blocks_explode(spark, d):
    return X.blocks(V.chunks(spark, d)).select("x", "y", "z", "block")


@query(f"WITH {ADDRESSED} SELECT x, y, z, st AS block FROM i WHERE st = 'minecraft:no_3'")
def blocks_of_one_state(spark, d):
    return X.blocks(V.chunks(spark, d), only="minecraft:no_3").select("x", "y", "z", "block")


@query(f"""WITH {ADDRESSED}, f AS (SELECT cx, cz, si, arg_min(st, li) AS first_st, count(*) AS n FROM i GROUP BY ALL),
e AS (SELECT cx, cz, si, st, count(*) AS cells FROM i GROUP BY ALL UNION ALL SELECT cx, cz, si, first_st, 4096 - n FROM f)
SELECT cx, cz, si, st AS biome, CAST(sum(cells) AS BIGINT) AS cells FROM e GROUP BY ALL""")
def biomes_explode(spark, d):
    b = X.biome_counts(V.chunks(spark, d))
    return b.select(F.col("x").alias("cx"), F.col("z").alias("cz"), F.col("section_index").alias("si"), "biome", "cells")


@query(f"""WITH {ADDRESSED}, n AS (SELECT count(*) AS sections FROM (SELECT DISTINCT cx, cz, si FROM i)) SELECT sections * 4096 AS cells, sections AS sections FROM n""")
def biome_cells(spark, d):
    """Every cell of every section has a biome at a place of its own."""
    b = X.biomes(V.chunks(spark, d)).withColumn("place", C.linear_index(F.col("x"), F.col("y"), F.col("z")))
    per = b.groupBy(C.chunk_of(F.col("x")).alias("cx"), C.chunk_of(F.col("z")).alias("cz"), C.section_index(F.col("y"), -4).alias("si")).agg(F.count("*").alias("n"), F.bit_xor("place").alias("x"), F.max("place").alias("top"))
    return per.where("x = 0 AND top = 4095").agg(F.sum("n").alias("cells"), F.count("*").alias("sections"))


@query(f"WITH {PLACED} SELECT x >> 4 AS cx, z >> 4 AS cz, (y >> 4) + 4 AS si, ((y & 15) >> 2) * 16 + ((z & 15) >> 2) * 4 + ((x & 15) >> 2) AS li, st AS biome FROM placed WHERE (y >> 4) + 4 BETWEEN 0 AND 23 QUALIFY {_LAST.format(k='x >> 4, z >> 4, y >> 4, (y & 15) >> 2, (z & 15) >> 2, (x & 15) >> 2')}")
def biome_quart_cells(spark, d):
    a = B.addressed(V.placements(spark, d), quarts=True)
    return B.last_wins(a, [*B.SECTION_KEYS, "li"], V.SEQUENCE).select("cx", "cz", "si", "li", F.col("block").alias("biome"))


# --- entities, block entities, ticks


@query(f"WITH {BLOCK_ENTITY} SELECT c_custkey, (x & 15) + (z & 15) * 16 AS packed_xz, x AS back_x, z AS back_z, y FROM be")
def block_entity_positions(spark, d):
    b = V.block_entity_rows(spark, d).withColumn("packed_xz", C.pack_xz(F.col("x"), F.col("z")))
    lx, lz = C.unpack_xz(F.col("packed_xz"))
    return b.select("c_custkey", "packed_xz", C.absolute(C.chunk_of(F.col("x")), lx).alias("back_x"), C.absolute(C.chunk_of(F.col("z")), lz).alias("back_z"), "y")


@query(f"WITH {BLOCK_ENTITY}, {ADDRESSED} SELECT c_custkey, x, y, z, name FROM be WHERE tag IS NOT NULL AND name IS NOT NULL AND EXISTS (SELECT 1 FROM i WHERE i.cx = be.x >> 4 AND i.cz = be.z >> 4)")
def block_entity_semi(spark, d):
    chunks = V.addressed(spark, d).select("dimension", F.col("cx").alias("x"), F.col("cz").alias("z")).distinct()
    return B.import_block_entities(V.block_entity_rows(spark, d), chunks).select("c_custkey", "x", "y", "z", "name")


@query(f"WITH {BLOCK_ENTITY} SELECT tag IS NOT NULL AND name IS NOT NULL AS accepted, count(*) AS n FROM be GROUP BY 1")
def block_entity_reject(spark, d):
    good = B.accepted_block_entity(F.col("name"), F.col("tag"))
    return V.block_entity_rows(spark, d).groupBy(good.alias("accepted")).agg(F.count("*").alias("n"))


@query(f"WITH {BLOCK_ENTITY} SELECT coalesce(name, 'minecraft:unknown') AS id, count(*) AS n FROM be GROUP BY 1")
def unknown_id_default(spark, d):
    b = V.block_entity_rows(spark, d)
    packed = b.select("dimension", C.chunk_of(F.col("x")).alias("x"), C.chunk_of(F.col("z")).alias("z"), F.array(F.struct(C.pack_xz(F.col("x"), F.col("z")).cast("smallint").alias("packed_xz"), "y", F.coalesce("name", F.lit("")).alias("id"), F.lit(b"").alias("data"))).alias("block_entities"))
    return X.block_entities(packed).groupBy("id").agg(F.count("*").alias("n"))


@query(f"WITH {ENTITY} SELECT event_id, id, bx >> 4 AS chunk_x, bz >> 4 AS chunk_z, CASE WHEN event_id % 4 = 0 THEN 0 ELSE bx END AS px, CASE WHEN event_id % 4 = 0 THEN 0 ELSE by_ END AS py FROM ent")
def entity_vectors(spark, d):
    e = V.entities(spark, d)
    whole = F.array(*[F.col(c).cast("float") for c in ("bx", "by_", "bz")])
    v = X.vector_or_zero(F.when(F.col("event_id") % 4 == 0, F.slice(whole, 1, 2)).otherwise(whole))
    e = e.withColumn("v", v)
    return e.select("event_id", "id", C.chunk_of(F.col("bx")).alias("chunk_x"), C.chunk_of(F.col("bz")).alias("chunk_z"), F.element_at("v", 1).cast("int").alias("px"), F.element_at("v", 2).cast("int").alias("py"))


@query(f"""WITH {ENTITY}, h AS (SELECT event_id, concat(lower(lpad(hex(CAST(bx AS BIGINT) & 4294967295), 8, '0')), lower(lpad(hex(CAST(by_ AS BIGINT) & 4294967295), 8, '0')), lower(lpad(hex(CAST(bz AS BIGINT) & 4294967295), 8, '0')), lower(lpad(hex(event_id & 4294967295), 8, '0'))) AS u FROM ent)
SELECT event_id, concat_ws('-', u[1:8], u[9:12], u[13:16], u[17:20], u[21:32]) AS uuid FROM h""")
def uuid_from_ints(spark, d):
    e = V.entities(spark, d)
    return e.select("event_id", X.uuid_from_ints(F.array("bx", "by_", "bz", F.col("event_id").cast("int"))).alias("uuid"))


_TICKS = "tick AS (SELECT o_orderkey, CAST(o_custkey % 90 - 45 AS INT) AS x, CAST(o_orderkey % 320 - 64 AS INT) AS y, CAST(o_orderkey % 70 - 35 AS INT) AS z, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE concat('minecraft:', lower(o_orderstatus)) END AS block FROM orders)"


@query(f"WITH {_TICKS} SELECT x, y, z, CASE WHEN block = '' THEN 'minecraft:air' ELSE block END AS block, o_orderkey AS tick FROM tick")
def scheduled_tick_positions(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    t = o.select(k, (F.col("o_custkey") % 90 - 45).cast("int").alias("x"), (k % 320 - 64).cast("int").alias("y"), (k % 70 - 35).cast("int").alias("z"), F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("minecraft:"), F.lower("o_orderstatus"))).alias("block"))
    packed = t.select(F.lit("overworld").alias("dimension"), C.chunk_of(F.col("x")).alias("x"), C.chunk_of(F.col("z")).alias("z"), F.array(F.struct(C.pack_xz(F.col("x"), F.col("z")).cast("smallint").alias("packed_xz"), "y", "block", F.col("o_orderkey").alias("tick"))).alias("scheduled_ticks"))
    return X.scheduled_ticks(packed).select("x", "y", "z", "block", "tick")


# --- block states

_STATES = """states AS (SELECT p_partkey, CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN lower(p_brand) WHEN 1 THEN concat(lower(p_brand), '[]') WHEN 2 THEN concat(lower(p_brand), '[size=', p_size, ',lit=true]')
WHEN 3 THEN concat(lower(p_brand), '[b=1,a=0x0f,b=2.5]') WHEN 4 THEN concat(lower(p_brand), '[flag,,face="north",n=', p_partkey, ']') ELSE concat(lower(p_brand), '[w=', p_retailprice, ']') END AS state FROM part)"""


def _states(spark, d):
    k, brand = F.col("p_partkey"), F.lower("p_brand")
    state = (
        F.when(k % 6 == 0, brand)
        .when(k % 6 == 1, F.concat(brand, F.lit("[]")))
        .when(k % 6 == 2, F.concat(brand, F.lit("[size="), F.col("p_size").cast("string"), F.lit(",lit=true]")))
        .when(k % 6 == 3, F.concat(brand, F.lit("[b=1,a=0x0f,b=2.5]")))
        .when(k % 6 == 4, F.concat(brand, F.lit('[flag,,face="north",n='), k.cast("string"), F.lit("]")))
        .otherwise(F.concat(brand, F.lit("[w="), F.col("p_retailprice").cast("string"), F.lit("]")))
    )
    return table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", state.alias("state"))


@query(f"""WITH {_STATES} SELECT p_partkey, split_part(state, '[', 1) AS name, CASE CAST(p_partkey % 6 AS INT) WHEN 2 THEN concat('lit=true;size=', (SELECT p_size FROM part q WHERE q.p_partkey = s.p_partkey)) WHEN 3 THEN 'a=0x0f;b=2.5'
WHEN 4 THEN concat('face="north";n=', p_partkey) WHEN 5 THEN replace(replace(state, split_part(state, '[', 1) || '[', ''), ']', '') ELSE '' END AS props, strpos(state, '[') > 0 AS bracketed FROM states s""")
def block_state_parse(spark, d):
    props = F.array_join(F.transform(S.state_properties(F.col("state")), lambda p: F.concat(p["key"], F.lit("="), p["text"])), ";")
    return _states(spark, d).select("p_partkey", S.state_name(F.col("state")).alias("name"), props.alias("props"), S.has_properties(F.col("state")).alias("bracketed"))


@query("""SELECT p_partkey, concat(lower(p_brand), '[big=', CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END, ',data=0x', lpad(lower(hex(p_size)), 2, '0'), ',half=', CAST(p_size // 2 AS VARCHAR), CASE WHEN p_size % 2 = 0 THEN '.0' ELSE '.5' END, ',kind="', lower(p_brand), '",size=', p_size, ']') AS state FROM part""")
def block_state_format(spark, d):
    p = table(spark, d, "part")
    size = F.col("p_size").cast("string")
    pair = lambda k, kind, t: F.struct(F.lit(k).alias("key"), F.lit(kind).alias("kind"), t.alias("text"))
    props = F.array(pair("size", "int", size), pair("big", "bool", F.when(F.col("p_size") > 25, "true").otherwise("false")), pair("data", "byte", size), pair("kind", "string", F.lower("p_brand")), pair("half", "float", (F.col("p_size") / 2).cast("string")))
    return p.select("p_partkey", S.format_state(F.lower("p_brand"), props).alias("state"))


@query(f"WITH {_STATES}, inner_ AS (SELECT p_partkey, CASE WHEN strpos(state, '[') > 0 THEN rtrim(substr(state, strpos(state, '[') + 1), ']') ELSE '' END AS t FROM states), u AS (SELECT p_partkey, unnest(string_split(t, ',')) AS piece FROM inner_) SELECT p_partkey, piece, count(*) AS n FROM u WHERE piece <> '' GROUP BY ALL")
def property_split(spark, d):
    s = _states(spark, d).select("p_partkey", F.explode(S.split_properties(S.state_inside(F.col("state")))).alias("piece"))
    return s.groupBy("p_partkey", "piece").agg(F.count("*").alias("n"))


@query("""SELECT s, CASE WHEN s IN ('true', 'false') THEN 'bool' WHEN regexp_matches(s, '^0x[0-9a-fA-F]') THEN 'byte' WHEN length(s) >= 2 AND s LIKE '"%"' THEN 'string' WHEN s LIKE '%.%' AND regexp_matches(s, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)') THEN 'float'
WHEN regexp_matches(s, '^[+-]?[0-9]') AND coalesce(TRY_CAST(regexp_extract(s, '^[+-]?[0-9]+') AS BIGINT) BETWEEN -2147483648 AND 2147483647, false) THEN 'int' ELSE 'string' END AS kind
FROM (SELECT CAST(p_size AS VARCHAR) AS s FROM part UNION SELECT lower(p_brand) FROM part UNION SELECT CAST(l_orderkey * 999983 AS VARCHAR) FROM lineitem UNION SELECT concat(event_id, 'abc') FROM events UNION SELECT concat('0x', event_id % 100) FROM events UNION SELECT concat(event_id, '.5x') FROM events UNION SELECT concat('"', event_type, '"') FROM events UNION SELECT CASE WHEN value > 50 THEN 'true' ELSE 'false' END FROM events UNION SELECT concat('-', event_id) FROM events UNION SELECT concat('.', event_id) FROM events)""")
def property_infer(spark, d):
    p, e, li = table(spark, d, "part"), table(spark, d, "events"), table(spark, d, "lineitem")
    event = F.col("event_id")
    parts = [
        p.select(F.col("p_size").cast("string").alias("s")),
        p.select(F.lower("p_brand").alias("s")),
        li.select((F.col("l_orderkey") * 999983).cast("string").alias("s")),
        e.select(F.explode(F.array(F.concat(event.cast("string"), F.lit("abc")), F.concat(F.lit("0x"), (event % 100).cast("string")), F.concat(event.cast("string"), F.lit(".5x")), F.concat(F.lit('"'), F.col("event_type"), F.lit('"')), F.when(F.col("value") > 50, "true").otherwise("false"), F.concat(F.lit("-"), event.cast("string")), F.concat(F.lit("."), event.cast("string")))).alias("s")),
    ]
    out = parts[0]
    for q in parts[1:]:
        out = out.unionByName(q)
    return out.distinct().select("s", S.infer_kind(F.col("s")).alias("kind"))


@query(f"WITH {_STATES} SELECT p_partkey, CASE CAST(p_partkey % 6 AS INT) WHEN 2 THEN concat(split_part(state, '[', 1), '[lit=true]') WHEN 3 THEN concat(split_part(state, '[', 1), '[a=0x0f]') ELSE split_part(state, '[', 1) END AS state FROM states")
def property_whitelist(spark, d):
    kept = S.allowed_properties(S.typed_properties(F.col("state")), F.array(F.lit("lit"), F.lit("a")))
    return _states(spark, d).select("p_partkey", S.format_state(S.state_name(F.col("state")), kept).alias("state"))


# --- wire scalars

_INTS = "ints AS (SELECT n FROM (SELECT DISTINCT CAST(l_orderkey * 7919 - l_partkey * 104729 AS BIGINT) AS n FROM lineitem) UNION SELECT CAST(v AS BIGINT) FROM (SELECT unnest([0, 1, -1, 63, 64, -64, -65, 150, -300, 8191, 8192, 1048576, 16777216, 9223372036854775807, -9223372036854775807]) AS v))"
_ZZ = "(CASE WHEN n >= 0 THEN CAST(n AS HUGEINT) * 2 ELSE CAST(n AS HUGEINT) * -2 - 1 END)"


def _ints(spark, d):
    n = table(spark, d, "lineitem").select((F.col("l_orderkey") * 7919 - F.col("l_partkey") * 104729).alias("n"))
    fixed = F.array(*[F.lit(v).cast("bigint") for v in (0, 1, -1, 63, 64, -64, -65, 150, -300, 8191, 8192, 1048576, 16777216, 9223372036854775807, -9223372036854775807)])
    return n.unionByName(spark.range(1).select(F.explode(fixed).alias("n"))).distinct()


@query(f"WITH {_INTS} SELECT n, CAST(CASE WHEN {_ZZ} >= 9223372036854775808 THEN {_ZZ} - 18446744073709551616 ELSE {_ZZ} END AS BIGINT) AS zigzag, n AS back FROM ints")
def varint_zigzag(spark, d):
    z = N.zigzag(F.col("n"))
    return _ints(spark, d).select("n", z.alias("zigzag"), N.varint_value(N.varint_hex(F.col("n"))).alias("back"))


@query(f"WITH {_INTS} SELECT n, CAST(CASE WHEN u < 128 THEN 1 WHEN u < 16384 THEN 2 WHEN u < 2097152 THEN 3 WHEN u < 268435456 THEN 4 WHEN u < 34359738368 THEN 5 WHEN u < 4398046511104 THEN 6 WHEN u < 562949953421312 THEN 7 WHEN u < 72057594037927936 THEN 8 WHEN u < 9223372036854775808 THEN 9 ELSE 10 END AS INT) AS bytes FROM (SELECT n, {_ZZ} AS u FROM ints)")
def varint_size(spark, d):
    return _ints(spark, d).select("n", N.varint_size(F.col("n")).alias("bytes"))


@query(f"WITH {PLACED} SELECT DISTINCT x, lower(lpad(hex(CAST(x AS BIGINT) & 4294967295), 8, '0')) AS octets, CAST(x AS BIGINT) AS value FROM placed")
def be_int_decode(spark, d):
    octets = F.lower(F.lpad(F.hex(F.col("x").cast("bigint").bitwiseAND((1 << 32) - 1)), 8, "0"))
    return V.placements(spark, d).select("x").distinct().withColumn("octets", octets).withColumn("value", N.be_int(F.col("octets")))


@query("SELECT doc_id, CAST(strlen(text) AS INT) AS bytes, strlen(text) <= 1048576 AS fits FROM documents")
def string_limit_check(spark, d):
    return table(spark, d, "documents").select("doc_id", F.octet_length("text").alias("bytes"), N.string_fits(F.col("text")).alias("fits"))


_SIZE = "(CASE WHEN {n} < 64 THEN 1 WHEN {n} < 8192 THEN 2 WHEN {n} < 1048576 THEN 3 ELSE 4 END)"


@query(f"""WITH {PALETTE}, t AS (SELECT cx, cz, si, sum(strlen(st) + 1) AS s FROM pal GROUP BY ALL), k AS (SELECT cx, cz, si, n, CAST(ceil(4096 / (64 // bits)) AS BIGINT) AS w FROM b)
SELECT cx, cz, si, CAST({_SIZE.format(n='n')} + s + 14 + {_SIZE.format(n='w')} + 8 * w + 18 + 1 AS BIGINT) AS bytes FROM t JOIN k USING (cx, cz, si)""")
def encoded_size(spark, d):
    a = V.addressed(spark, d)
    s = X.sections(B.assemble(a))
    size = N.section_size(F.col("block_palette"), F.col("block_data"), F.col("biome_palette"), F.col("biome_data"))
    return s.select(F.col("x").alias("cx"), F.col("z").alias("cz"), F.col("section_index").alias("si"), size.cast("bigint").alias("bytes"))


@query("SELECT doc_id, level, level <> 'none' AND n > 1024 AS buffered FROM (SELECT doc_id, strlen(text) AS n FROM documents), (SELECT unnest(['none', 'fast', 'default', 'best']) AS level)")
def compression_decision(spark, d):
    """What the codec stores of each text as a payload, at each level."""

    @F.pandas_udf(T.BooleanType())
    def packed(texts, levels):
        import pandas as pd

        return pd.Series([codec.stored_form((t or "").encode(), level)[0] == codec.ZSTD for t, level in zip(texts, levels)])

    level = F.explode(F.array(*map(F.lit, ("none", "fast", "default", "best")))).alias("level")
    t = table(spark, d, "documents").select("doc_id", "text", level)
    return t.select("doc_id", "level", packed("text", "level").alias("buffered"))


@query("SELECT p_partkey, CAST(p_partkey % 256 AS INT) AS octet, CAST(p_size - 25 AS INT) AS whole, p_partkey * -7919 AS wide, p_name AS name, CAST(strlen(p_brand) AS INT) AS n_bytes, CAST(p_size AS DOUBLE) / 4 AS real, p_partkey - 1000 AS number, CAST(3 AS INT) AS longs, true AS ended FROM part")
def wire_roundtrip(spark, d):
    """Every scalar of the wire format written one after the other, and read again to the last byte."""
    out = "p_partkey long, octet int, whole int, wide long, name string, n_bytes int, real double, number long, longs int, ended boolean"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                w = codec.Writer()
                w.number("B", r["p_partkey"] % 256)
                w.number("i", r["p_size"] - 25)
                w.number("q", r["p_partkey"] * -7919)
                w.string(r["p_name"])
                w.bytes(r["p_brand"].encode())
                w.number("f", r["p_size"] / 4)
                w.varint(r["p_partkey"] - 1000)
                w.varint(3)
                for k in range(3):
                    w.number("q", r["p_partkey"] << k)
                q = codec.Reader(w.done())
                got = {"p_partkey": r["p_partkey"], "octet": q.number("B"), "whole": q.number("i"), "wide": q.number("q"), "name": q.string(), "n_bytes": len(q.bytes()), "real": q.number("f"), "number": q.varint()}
                rows.append(got | {"longs": sum(v == r["p_partkey"] << k for k, v in enumerate(q.longs("longs"))), "ended": q.left() == 0})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("p_partkey", pa.int64()), ("octet", pa.int32()), ("whole", pa.int32()), ("wide", pa.int64()), ("name", pa.string()), ("n_bytes", pa.int32()), ("real", pa.float64()), ("number", pa.int64()), ("longs", pa.int32()), ("ended", pa.bool_())]))

    return table(spark, d, "part").select("p_partkey", "p_size", "p_name", "p_brand").mapInArrow(run, out)


# --- dimensions, stores, settings

_DIM = "CASE CAST(n_nationkey % 4 AS INT) WHEN 0 THEN 'overworld' WHEN 1 THEN 'nether' WHEN 2 THEN 'end' ELSE 'moon' END"


def _nations(spark, d):
    k = F.col("n_nationkey") % 4
    return table(spark, d, "nation").withColumn("dimension", F.when(k == 0, "overworld").when(k == 1, "nether").when(k == 2, "end").otherwise("moon"))


@query(f"SELECT n_nationkey, dimension, CASE dimension WHEN 'overworld' THEN 'overworld.pile' WHEN 'nether' THEN 'nether.pile' WHEN 'end' THEN 'end.pile' ELSE 'unknown.pile' END AS file FROM (SELECT n_nationkey, {_DIM} AS dimension FROM nation)")
def dimension_route(spark, d):
    return _nations(spark, d).select("n_nationkey", "dimension", W.route(F.col("dimension")).alias("file"))


_SPREAD = "spread AS (SELECT CASE CAST(l_orderkey % 2 AS INT) WHEN 0 THEN 'overworld' ELSE 'nether' END AS dimension, CAST(l_partkey % 64 AS INT) - 32 AS x, CAST(l_suppkey % 64 AS INT) - 32 AS z FROM lineitem)"


def _spread(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.when(F.col("l_orderkey") % 2 == 0, "overworld").otherwise("nether").alias("dimension"), ((F.col("l_partkey") % 64) - 32).cast("int").alias("x"), ((F.col("l_suppkey") % 64) - 32).cast("int").alias("z")).distinct()


@query(f"WITH {_SPREAD} SELECT DISTINCT dimension, x, z FROM spread")
def dimension_union(spark, d):
    """A directory with one file for each dimension, written and scanned."""
    path = _folder(spark)
    WF.write_worlds(K.to_chunks(_spread(spark, d)), path, compression="none", min_section=0, max_section=1)
    return WF.read_worlds(spark, path).select("dimension", "x", "z")


@query(f"WITH {_SPREAD}, c AS (SELECT dimension, count(*) AS n FROM (SELECT DISTINCT * FROM spread) GROUP BY 1), e AS (SELECT k AS dimension, coalesce(n, 0) AS chunks FROM (SELECT unnest(['overworld', 'nether', 'end']) AS k) LEFT JOIN c ON c.dimension = k) SELECT * FROM e UNION ALL SELECT 'all', CAST(sum(chunks) AS BIGINT) FROM e")
def dimension_counts(spark, d):
    return W.dimension_counts(_spread(spark, d))


@query(f"WITH {ADDRESSED} SELECT count(*) AS chunks, -64 AS min_y, 320 AS max_y FROM (SELECT DISTINCT cx, cz FROM i)")
def world_info(spark, d):
    return X.world_info(V.chunks(spark, d), -4, 20)


@query(f"WITH {_SPREAD}, {_CHANGED} SELECT s.dimension, count(*) AS chunks, CAST(sum(CASE WHEN c.x IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM (SELECT DISTINCT * FROM spread) s LEFT JOIN changed c ON s.x = c.x AND s.z = c.z AND s.dimension = 'overworld' GROUP BY 1")
def save_plan(spark, d):
    world = W.World(_spread(spark, d), changed=_changed(spark, d))
    return W.Store(spark, "", world).save_plan()


@query("SELECT user_id, CAST(event_id % 64 AS INT) AS x, CAST(event_id % 128 AS INT) AS y, CAST(event_id % 32 AS INT) AS z FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def player_spawn_latest(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id")
    k = F.col("event_id")
    spawns = e.select("user_id", "ts", "event_id", *[(k % n).cast("int").alias(c) for c, n in (("x", 64), ("y", 128), ("z", 32))])
    return B.last_wins(spawns, ["user_id"], ["ts", "event_id"]).select("user_id", "x", "y", "z")


@query("SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS tick, count(*) AS changes FROM events GROUP BY 1")
def save_coalesce(spark, d):
    t = table(spark, d, "events")
    return U.changes_per_save(t, 3600)


@query("SELECT name, time, \"defaultGameMode\", difficulty, raining, \"timeCycle\" FROM (SELECT 'Pile' AS name, CAST(6000 AS BIGINT) AS time, 2 AS \"defaultGameMode\", 2 AS difficulty, false AS raining, false AS \"timeCycle\")")
def settings_defaults(spark, d):
    none = F.create_map().cast("map<string,string>")
    return spark.range(1).select(*W.settings_from(none)).select("name", "time", "defaultGameMode", "difficulty", "raining", "timeCycle")


_SETTINGS = "SELECT n_nationkey, n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE CAST(n_nationkey * 3 AS INT) END AS \"spawnX\", CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE CAST(n_regionkey * 5 AS INT) END AS \"spawnZ\", CASE WHEN n_nationkey % 4 = 0 THEN CAST(6000 AS BIGINT) ELSE CAST(n_nationkey AS BIGINT) * 1000 END AS time, n_nationkey % 2 = 1 AS raining FROM nation"


@query(_SETTINGS)
def settings_partial_decode(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    values = F.map_from_arrays(
        F.array(*map(F.lit, ("name", "spawnX", "spawnY", "spawnZ", "time", "raining"))),
        F.array(F.col("n_name"), (k * 3).cast("string"), F.when(k % 3 == 0, "high").otherwise("70"), (F.col("n_regionkey") * 5).cast("string"), F.when(k % 4 == 0, "noon").otherwise((k.cast("bigint") * 1000).cast("string")), (k % 2).cast("string")),
    )
    out = n.select("n_nationkey", values.alias("m"))
    return out.select("n_nationkey", *W.settings_from(F.col("m"))).select("n_nationkey", "name", "spawnX", "spawnZ", "time", "raining")


@query("SELECT n_nationkey, CASE CAST(n_nationkey % 4 AS INT) WHEN 0 THEN 'survival' WHEN 1 THEN 'creative' WHEN 2 THEN 'adventure' ELSE 'spectator' END AS game_mode, CASE CAST(n_regionkey % 4 AS INT) WHEN 0 THEN 'peaceful' WHEN 1 THEN 'easy' WHEN 2 THEN 'normal' ELSE 'hard' END AS difficulty FROM nation")
def settings_project(spark, d):
    """Numbers to names, to numbers and to names again."""
    n = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") % 4).alias("defaultGameMode"), (F.col("n_regionkey") % 4).alias("difficulty"))
    back = ST.from_internal(ST.to_internal(ST.from_internal(n)))
    return back.select("n_nationkey", F.col("defaultGameMode").alias("game_mode"), "difficulty")


# --- documented analyses and whole pipelines


@query(f"WITH {ADDRESSED} SELECT st AS block, count(DISTINCT cx * 1000000 + cz * 1000 + si) AS sections FROM i GROUP BY st UNION ALL SELECT 'minecraft:air', count(*) FROM (SELECT DISTINCT cx, cz, si FROM i)")
def block_type_sections(spark, d):
    return X.block_type_sections(V.chunks(spark, d))


@query(f"WITH {ENTITY} SELECT id, count(*) AS entities FROM ent GROUP BY id")
def entity_type_counts(spark, d):
    e = V.entities(spark, d)
    vec = lambda *c: F.array(*[F.col(x).cast("float") for x in c])
    s = F.struct(F.lit("").alias("uuid"), F.col("id"), vec("bx", "by_", "bz").alias("position"), vec("bx", "by_").alias("rotation"), vec("bx", "by_", "bz").alias("velocity"), F.lit(b"").alias("data"))
    chunks = e.groupBy(F.lit("overworld").alias("dimension"), C.chunk_of(F.col("bx")).alias("x"), C.chunk_of(F.col("bz")).alias("z")).agg(F.collect_list(s).alias("entities"))
    return X.entity_type_counts(chunks)


@query(f"WITH {PALETTE}, p AS (SELECT cx, cz, si, string_agg(st, ',' ORDER BY pi) AS names FROM pal GROUP BY ALL) SELECT cx AS x, cz AS z, si AS section_index, concat('minecraft:air,', names) AS names, CAST(ceil(4096 / (64 // bits)) AS INT) AS words FROM p JOIN b USING (cx, cz, si)")
def chunk_assemble(spark, d):
    s = X.sections(V.chunks(spark, d))
    return s.select("x", "z", "section_index", F.array_join("block_palette", ",").alias("names"), F.size("block_data").alias("words"))


@query(f"""WITH {PLACED}, named AS (SELECT *, CASE WHEN l_linenumber = 1 THEN 'air' WHEN l_linenumber = 2 THEN concat(st, '[lit=true]') WHEN l_linenumber = 3 THEN 'minecraft:stone' ELSE st END AS block FROM placed)
SELECT x, y, z, block FROM (SELECT x, y, z, block, {_LAST.format(k='x, y, z').replace(' = 1', '')} AS r FROM named WHERE block <> 'air' AND y >= -64 AND y < 320) WHERE r = 1""")
def import_pipeline(spark, d):
    n = F.col("l_linenumber")
    p = V.placements(spark, d)
    given = F.when(n == 1, "air").when(n == 2, F.concat(F.col("block"), F.lit("[lit=true,odd=3]"))).when(n == 3, "legacy:rock").otherwise(F.col("block"))
    cells = p.withColumn("name", given).select("dimension", "x", "y", "z", "name", *V.SEQUENCE)
    one = spark.range(1)
    mapping = one.select(F.lit("legacy:rock").alias("from_name"), F.lit("minecraft:stone").alias("to_name"))
    props = p.select(F.col("block").alias("name")).distinct().withColumn("keys", F.array(F.lit("lit")))
    return X.blocks(B.import_volume(cells, V.SEQUENCE, mapping, props)).select("x", "y", "z", "block")


_FLAT = "(SELECT CAST(unnest(range(-10, 10)) AS INT) AS {v})"


@query("SELECT * FROM (VALUES ('minecraft:bedrock', CAST(400 AS BIGINT)), ('minecraft:dirt', CAST(1200 AS BIGINT)), ('minecraft:grass_block', CAST(400 AS BIGINT))) t(block, sections)")
def flat_world(spark, d):
    grid = spark.range(400).select(F.lit("overworld").alias("dimension"), (F.col("id") % 20 - 10).cast("int").alias("x"), (F.floor(F.col("id") / 20) - 10).cast("int").alias("z"))
    layer = lambda name: F.struct(F.array(F.lit(name)).alias("block_palette"), F.array().cast("array<bigint>").alias("block_data"), F.array(F.lit(C.PLAINS)).alias("biome_palette"), F.array().cast("array<bigint>").alias("biome_data"))
    names = {4: "bedrock", 5: "dirt", 6: "dirt", 7: "dirt", 8: "grass_block"}
    none = F.lit(None).cast("struct<block_palette:array<string>,block_data:array<bigint>,biome_palette:array<string>,biome_data:array<bigint>>")
    chunks = grid.withColumn("sections", F.array(*[layer(f"minecraft:{names[k]}") if k in names else none for k in range(24)]))
    return X.block_type_sections(chunks)


@query("SELECT CAST(floor(epoch(ts) / 60) AS BIGINT) % 2 = 0 AS even_minute, count(*) AS n FROM events GROUP BY 1")
def change_times(spark, d):
    t = table(spark, d, "events")
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    return t.groupBy((F.floor(seconds / 60) % 2 == 0).alias("even_minute")).agg(F.count("*").alias("n"))


# --- files and tagged binary


def _folder(spark) -> str:
    """A new folder under the shared one that the session names; a temporary one for a local master alone."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = shared.removeprefix("file://") if shared else tempfile.mkdtemp(prefix="worlds-")
    return f"{base}/{uuid.uuid4().hex}"


def _written(spark, d) -> str:
    path = _folder(spark)
    WF.write_worlds(K.to_chunks(V.chunks(spark, d)), path, compression="fast")
    return path


@query(f"WITH {ADDRESSED} SELECT x, y, z, st AS block FROM i")
def scan_roundtrip(spark, d):
    """Chunks written to a world file and read again by Spark's file scan."""
    return X.blocks(WF.read_worlds(spark, _written(spark, d), whole=False)).select("x", "y", "z", "block")


@query(f"WITH {ADDRESSED} SELECT 'overworld' AS dimension, 1 AS version, -4 AS min_section, 20 AS max_section, count(*) AS chunks FROM (SELECT DISTINCT cx, cz FROM i)")
def header_probe(spark, d):
    h = WF.read_world_headers(spark, _written(spark, d))
    return h.select("dimension", F.col("version").cast("int").alias("version"), "min_section", "max_section", F.col("chunk_count").alias("chunks"))


@query("SELECT n_nationkey, n_name AS name, CAST(n_nationkey AS BIGINT) * 1000 AS time, n_nationkey % 2 = 1 AS raining, 2 AS difficulty FROM nation")
def settings_binary(spark, d):
    """Settings through their tagged binary form and back."""
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    own = {"name": F.col("n_name"), "time": k.cast("bigint") * 1000, "raining": k % 2 == 1}
    rows = n.select("n_nationkey", *[own.get(s, F.lit(W.DEFAULT_SETTINGS[s])).cast(kind).alias(s) for s, kind in W.SETTING_KINDS.items()])
    back = ST.with_settings_bytes(rows).select("n_nationkey", ST.decoded_settings(F.col("settings")).alias("s"))
    return back.select("n_nationkey", "s.name", "s.time", "s.raining", "s.difficulty")


def _tagged(name, *pairs):
    """Tagged data of rows: ``pairs`` are (tag, kind, column) and go through the codec in a worker."""
    cols, kinds = [c for _, _, c in pairs], [(tag, kind) for tag, kind, _ in pairs]

    @F.pandas_udf(T.BinaryType())
    def encode(*series):
        import pandas as pd

        out = []
        for row in zip(*series):
            tags = {}
            for (tag, kind), v in zip(kinds, row):
                if v is not None and not (isinstance(v, float) and v != v):
                    tags[tag] = ("list", ("float", [float(x) for x in v])) if kind == "vector" else (kind, int(v) if kind in ("int", "long") else float(v) if kind == "float" else v)
            out.append(nbt.encode(tags))
        return pd.Series(out)

    return encode(*cols).alias(name)


def _dealt(rows, key):
    """Rows over all cores: a compressed table has few splits for what its tags cost to encode."""
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism, key)


def _through_file(spark, chunks, **parts_and_options):
    """Columns to a world file and back as pieces of chunks, so that no list of a chunk meets in a row."""
    path = _folder(spark)
    K.write_columns(chunks, path, **parts_and_options)
    return WF.read_worlds(spark, path, whole=False)


@query(f"WITH {BLOCK_ENTITY} SELECT x, y, z, coalesce(name, 'minecraft:unknown') AS id, coalesce(tag, '-') AS tag, count(*) AS n FROM be GROUP BY ALL")
def file_block_entities(spark, d):
    """Block entities with tagged data into chunks, a world file, and back at absolute places."""
    rows = _dealt(V.block_entity_rows(spark, d), "c_custkey")
    rows = rows.select("dimension", "x", "y", "z", _tagged("data", ("id", "string", F.col("name")), ("tag", "string", F.col("tag"))))
    grid = rows.select("dimension", C.chunk_of(F.col("x")).alias("x"), C.chunk_of(F.col("z")).alias("z")).distinct()
    back = K.block_entity_records(_through_file(spark, grid, block_entities=rows, min_section=0, max_section=1))
    told = back.select("x", "y", "z", "id", F.coalesce(F.col("tags")["tag"], F.lit("-")).alias("tag"))
    return told.groupBy("x", "y", "z", "id", "tag").agg(F.count("*").alias("n"))


@query(f"""WITH {ENTITY} SELECT event_id AS unique_id, CASE WHEN event_id % 5 = 0 THEN 'minecraft:unknown' ELSE id END AS identifier, bx >> 4 AS chunk_x, bz >> 4 AS chunk_z,
CASE WHEN event_id % 4 = 0 THEN 0 ELSE bx END AS px, CASE WHEN event_id % 4 = 0 THEN 0 ELSE by_ END AS py, CAST(event_id % 90 AS INT) AS yaw, CASE WHEN event_id % 4 = 0 THEN 0 ELSE bz END AS mz FROM ent""")
def file_entities(spark, d):
    """Entities through tagged data, chunks and a world file; vectors of another length than three are zero."""
    e = _dealt(V.entities(spark, d), "event_id")
    whole = F.array(*[F.col(c).cast("float") for c in ("bx", "by_", "bz")])
    given = F.when(F.col("event_id") % 4 == 0, F.slice(whole, 1, 2)).otherwise(whole)
    data = _tagged("data", ("identifier", "string", F.when(F.col("event_id") % 5 != 0, F.col("id"))), ("Pos", "vector", given), ("Motion", "vector", given), ("Yaw", "float", (F.col("event_id") % 90).cast("float")))
    rows = e.select(F.lit("overworld").alias("dimension"), C.chunk_of(F.col("bx")).alias("cx"), C.chunk_of(F.col("bz")).alias("cz"), F.col("event_id").alias("unique_id"), F.lit(None).cast("string").alias("uuid"), data)
    grid = rows.select("dimension", F.col("cx").alias("x"), F.col("cz").alias("z")).distinct()
    back = K.entity_records(_through_file(spark, grid, entities=rows, min_section=0, max_section=1))
    i = lambda c, k: F.element_at(c, k).cast("int")
    return back.select("unique_id", "identifier", "chunk_x", "chunk_z", i("position", 1).alias("px"), i("position", 2).alias("py"), i("rotation", 1).alias("yaw"), i("velocity", 3).alias("mz"))


@query(f"WITH {_TICKS} SELECT x, y, z, CASE WHEN block = '' THEN 'minecraft:air' ELSE block END AS block, o_orderkey AS tick FROM tick")
def file_ticks(spark, d):
    """Scheduled ticks with block states into chunks, a world file, and back: names stay, properties go."""
    k = F.col("o_orderkey")
    state = F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("minecraft:"), F.lower("o_orderstatus"), F.when(k % 2 == 0, "[lit=true]").otherwise("")))
    rows = table(spark, d, "orders").select(F.lit("overworld").alias("dimension"), (F.col("o_custkey") % 90 - 45).cast("int").alias("x"), (k % 320 - 64).cast("int").alias("y"), (k % 70 - 35).cast("int").alias("z"), state.alias("block"), k.alias("tick"))
    grid = rows.select("dimension", C.chunk_of(F.col("x")).alias("x"), C.chunk_of(F.col("z")).alias("z")).distinct()
    return X.scheduled_ticks(_through_file(spark, grid, ticks=rows, min_section=0, max_section=1)).select("x", "y", "z", "block", "tick")


@query(f"""WITH {BLOCK_ENTITY}, {ADDRESSED}, {_TICKS}, k AS (SELECT DISTINCT cx, cz FROM i),
c AS (SELECT i.cx, i.cz, count(*) AS blocks FROM i GROUP BY ALL), b AS (SELECT x >> 4 AS cx, z >> 4 AS cz, count(*) AS n FROM be GROUP BY ALL), t AS (SELECT x >> 4 AS cx, z >> 4 AS cz, count(*) AS n FROM tick GROUP BY ALL)
SELECT k.cx AS x, k.cz AS z, blocks, coalesce(b.n, 0) AS block_entities, coalesce(t.n, 0) AS ticks, concat(k.cx, '/', k.cz) AS user_data FROM k JOIN c USING (cx, cz) LEFT JOIN b USING (cx, cz) LEFT JOIN t USING (cx, cz)""")
def column_to_chunk(spark, d):
    """Whole columns (cells, block entities, ticks, user data) stored, read, and counted by chunk."""
    be = _dealt(V.block_entity_rows(spark, d), "c_custkey")
    be = be.select("dimension", "x", "y", "z", _tagged("data", ("id", "string", F.col("name"))))
    k = F.col("o_orderkey")
    ticks = table(spark, d, "orders").select(F.lit("overworld").alias("dimension"), (F.col("o_custkey") % 90 - 45).cast("int").alias("x"), (k % 320 - 64).cast("int").alias("y"), (k % 70 - 35).cast("int").alias("z"), F.lit("minecraft:water").alias("block"), k.alias("tick"))
    cells = V.chunks(spark, d).withColumn("user_data", F.concat_ws("/", "x", "z").cast("binary"))
    back = _through_file(spark, cells, block_entities=be, ticks=ticks, compression="fast", streaming=True)
    keys = ["dimension", "x", "z"]
    filled = X.blocks(back).groupBy("dimension", C.chunk_of(F.col("x")).alias("x"), C.chunk_of(F.col("z")).alias("z")).agg(F.count("*").alias("blocks"))
    total = lambda c: F.sum(F.size(c)).cast("bigint")
    told = back.groupBy(*keys).agg(total("block_entities").alias("block_entities"), total("scheduled_ticks").alias("ticks"), F.max("user_data").cast("string").alias("user_data"))
    return told.join(filled, keys).select("x", "z", "blocks", "block_entities", "ticks", "user_data")


@query(f"WITH {BLOCK_ENTITY}, {ADDRESSED} SELECT x, y, z, name AS id, tag, CAST(x AS VARCHAR) AS tag_x, count(*) AS n FROM be WHERE tag IS NOT NULL AND name IS NOT NULL AND EXISTS (SELECT 1 FROM i WHERE i.cx = be.x >> 4 AND i.cz = be.z >> 4) GROUP BY ALL")
def import_block_entities(spark, d):
    """Block entities of an imported volume in the lists of its chunks, with their tags."""
    chunks = V.addressed(spark, d).select("dimension", F.col("cx").alias("x"), F.col("cz").alias("z")).distinct()
    back = K.block_entity_records(B.with_block_entities(chunks, V.block_entity_rows(spark, d)))
    told = back.select("x", "y", "z", "id", F.col("tags")["tag"].alias("tag"), F.col("tags")["x"].alias("tag_x"))
    return told.groupBy("x", "y", "z", "id", "tag", "tag_x").agg(F.count("*").alias("n"))


@query(f"""WITH {ENTITY}, h AS (SELECT *, concat(lower(lpad(hex(CAST(bx AS BIGINT) & 4294967295), 8, '0')), lower(lpad(hex(CAST(by_ AS BIGINT) & 4294967295), 8, '0')), lower(lpad(hex(CAST(bz AS BIGINT) & 4294967295), 8, '0')), lower(lpad(hex(event_id & 4294967295), 8, '0'))) AS u FROM ent WHERE event_id % 6 <> 0)
SELECT concat_ws('-', u[1:8], u[9:12], u[13:16], u[17:20], u[21:32]) AS uuid, id, bx >> 4 AS chunk_x, by_ AS py, CASE WHEN event_id % 3 = 0 THEN 0 ELSE bx END AS mx FROM h""")
def entity_convert(spark, d):
    """Entities of an imported volume as parts of chunks; those without an id are dropped."""
    e = V.entities(spark, d)
    k = F.col("event_id")
    f = lambda *c: F.array(*[F.col(x).cast("float") for x in c])
    rows = e.select(F.lit("overworld").alias("dimension"), F.when(k % 6 != 0, F.col("id")).alias("id"), F.col("bx").cast("double").alias("x"), F.col("by_").cast("double").alias("y"), F.col("bz").cast("double").alias("z"), F.when(k % 3 == 0, f("bx")).otherwise(f("bx", "by_", "bz")).alias("motion"), f("bx", "bz").alias("rotation"), F.array("bx", "by_", "bz", k.cast("int")).alias("uuid_ints"))
    out = X.entities(K.converted_entities(rows))
    i = lambda c, n: F.element_at(c, n).cast("int")
    return out.select("uuid", "id", "chunk_x", i("position", 2).alias("py"), i("velocity", 1).alias("mx"))


@query("SELECT '' AS version, CAST(0 AS BIGINT) AS chunks UNION ALL SELECT '1.20', count(*) FROM (SELECT DISTINCT (CAST(l_partkey % 64 AS INT) - 32) >> 4, (CAST(l_suppkey % 64 AS INT) - 32) >> 4 FROM lineitem)")
def version_gate(spark, d):
    """A volume without a version imports nothing."""
    cells = V.placements(spark, d).withColumnRenamed("block", "name")
    each = [B.import_schematic(cells, V.SEQUENCE, v).agg(F.count("*").alias("chunks")).select(F.lit(v).alias("version"), "chunks") for v in ("", "1.20")]
    return each[0].unionByName(each[1])


@query("SELECT percent, min(done) AS processed FROM (SELECT done, (done * 100) // 11220 AS percent FROM (SELECT unnest(range(1, 11221)) AS done)) WHERE percent % 5 = 0 GROUP BY percent")
def progress_marks(spark, d):
    return B.progress_marks(spark, 33 * 17 * 20)


@query("SELECT 'set' AS state, string_agg(r_name, '/' ORDER BY r_regionkey) AS user_data, true AS dirty FROM region UNION ALL SELECT 'read', string_agg(r_name, '/' ORDER BY r_regionkey), false FROM region UNION ALL SELECT 'read-only', string_agg(r_name, '/' ORDER BY r_regionkey), false FROM region")
def user_data_roundtrip(spark, d):
    """User data set, saved with the world and read again; a read-only store keeps what it read."""
    names = table(spark, d, "region").orderBy("r_regionkey").collect()
    store = W.Store.open(spark, _folder(spark))
    store = store.store_columns(K.to_chunks(_spread(spark, d).limit(20))).set_user_data("/".join(r["r_name"] for r in names).encode())
    store.close()
    read, fixed = W.Store.open(spark, store.path), W.Store.open(spark, store.path, read_only=True).set_user_data(b"other")
    states = {"set": store, "read": read, "read-only": fixed}
    return spark.createDataFrame([(k, v.user_data().decode(), v.touched or v.world.is_dirty()) for k, v in states.items()], "state string, user_data string, dirty boolean")


@query(f"WITH {_SPREAD}, {_CHANGED}, s AS (SELECT DISTINCT * FROM spread) SELECT dimension, x, z, bool_or(new) AS changed FROM (SELECT *, false AS new FROM s UNION ALL SELECT 'overworld', x, z, true FROM changed) GROUP BY ALL")
def store_lifecycle(spark, d):
    """A store opened empty, filled, closed, opened, changed, closed and opened once more."""
    path = _folder(spark)
    marked = lambda df, flag: K.to_chunks(df.withColumn("user_data", F.lit(flag.encode())))
    W.Store.open(spark, path).store_columns(marked(_spread(spark, d), "old")).set_level("best").close()
    W.Store.open(spark, path).store_columns(marked(_changed(spark, d), "new")).set_streaming(True).close()
    back = W.Store.open(spark, path, read_only=True)
    return back.world.chunks.select("dimension", "x", "z", (F.col("user_data").cast("string") == "new").alias("changed"))


@query(f"WITH {_CHANGED} SELECT x, z, x = 3 AND z = 3 AS found FROM (SELECT DISTINCT x, z FROM changed WHERE x = 3 AND z = 3) UNION ALL SELECT 99, 99, false")
def load_column(spark, d):
    """A stored column, and one that is missing: it gives no row."""
    store = W.Store.open(spark, _folder(spark)).store_columns(K.to_chunks(_changed(spark, d))).save()
    again = W.Store.open(spark, store.path)
    hit = again.load_column("overworld", 3, 3).select("x", "z", F.lit(True).alias("found"))
    missing = again.load_column("overworld", 99, 99).count() > 0
    return hit.unionByName(spark.createDataFrame([(99, 99, missing)], "x int, z int, found boolean"))


@query("SELECT level, streaming, CASE WHEN level = 'none' THEN 0 ELSE 1 END AS compression, streaming AS undeclared, n AS chunks FROM (SELECT unnest(['none', 'fast', 'default', 'best']) AS level), (SELECT unnest([false, true]) AS streaming), (SELECT count(*) AS n FROM (SELECT DISTINCT CAST(o_custkey % 90 - 45 AS INT), CAST(o_orderkey % 90 - 45 AS INT) FROM orders WHERE o_orderstatus = 'F'))")
def write_levels(spark, d):
    """Files written at every level, buffered and chunk by chunk: their code, declared length and chunks."""
    chunks = K.to_chunks(_changed(spark, d)).cache()
    out = []
    for level in codec.LEVELS:
        for streaming in (False, True):
            path = _folder(spark)
            WF.write_worlds(chunks, path, streaming=streaming, compression=level, min_section=0, max_section=2)
            h = WF.read_world_headers(spark, path).first()
            out.append((level, streaming, h["compression"], h["declared_len"] == 0, h["chunk_count"]))
    chunks.unpersist()
    return spark.createDataFrame(out, "level string, streaming boolean, compression int, undeclared boolean, chunks long")


@query("SELECT 'overworld' AS dimension, CAST(user_id % 50 AS INT) AS x, 0 AS z, max(event_id) AS event_id FROM events GROUP BY ALL")
def stream_upsert(spark, d):
    """Changes taken as a stream, each trigger one keyed write; the last change of a chunk is there at the end."""
    source, base = table(spark, d, "events").schema, _folder(spark)
    events = spark.readStream.schema(source).option("pathGlobFilter", "events*.parquet").parquet(d)
    changes = events.select(F.lit("overworld").alias("dimension"), (F.col("user_id") % 50).cast("int").alias("x"), F.lit(0).alias("z"), "event_id")
    U.upsert_stream(changes, f"{base}/table", f"{base}/state", ["event_id"]).awaitTermination()
    return spark.read.parquet(f"{base}/table").select("dimension", "x", "z", "event_id")
