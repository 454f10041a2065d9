import struct

import pytest
from pyspark.sql import functions as F

from voxlake.functions import packing as P
from voxlake.functions import states as S
from voxlake.functions import varint as N
from voxlake.operators import build as B
from voxlake.operators import settings as ST
from voxlake.operators import views as X
from voxlake.operators import world as W
from voxlake.sources import worldfile as WF
from voxlake.streaming import upsert as U


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


@pytest.mark.parametrize("n,bits,words,first,last", [(2, 1, 64, -6148914691236517206, -6148914691236517206), (3, 2, 128, 5270498306774157604, 2635249153387078802), (5, 3, 196, 635308410510001800, 0), (16, 4, 256, -81985529216486896, -81985529216486896), (17, 5, 342, 407901468851537952, 506284), (300, 9, 586, 108262588198420992, 195), (4096, 12, 820, 1126106098831360, 4095)])
def test_packing_of_known_words(spark, n, bits, words, first, last):
    ix = F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda i: i % n)
    df = spark.range(1).select(ix.alias("ix"), P.bits_per_entry(F.lit(n)).alias("b")).withColumn("w", P.pack_array(F.col("ix"), F.col("b")))
    r = spark.createDataFrame(df.collect(), df.schema).withColumn("back", P.unpack_array(F.col("w"), F.col("b"))).first()
    assert (r.b, len(r.w), r.w[0], r.w[-1]) == (bits, words, first, last)
    assert r.back == [i % n for i in range(4096)]


def test_packing_edges(spark):
    ints = lambda *v: F.array(*[F.lit(x).cast("bigint") for x in v])
    r = one(spark, none=P.unpack_array(ints(), F.lit(4), 8), short=P.unpack_array(ints(-1), F.lit(4), 20), zero=P.pack_array(F.array(F.lit(1)), F.lit(0)), same=P.repack_array(ints(7), F.lit(3), F.lit(4)), over=P.entry_or_first(F.array(F.lit("a"), F.lit("b")), F.lit(9)))
    assert r.none == [0] * 8 and r.short == [15] * 16 + [0] * 4 and r.zero == [] and r.same == [7] and r.over == "a"


def test_states(spark):
    cases = {"a": ("a", []), "a[]": ("a", []), "a[x]": ("a", []), "a[x=1,x=2]": ("a", [("x", "2")]), 'a[x="p,q"]': ("a", [("x", '"p')]), "a[x={b,c}]": ("a", [("x", "{b,c}")]), "a[y=[1,2],x=3]": ("a", [("x", "3"), ("y", "[1,2]")]), "a[k=v=w": ("a", [("k", "v=w")])}
    df = spark.createDataFrame([(s,) for s in cases], "s string").select("s", S.state_name(F.col("s")).alias("n"), S.state_properties(F.col("s")).alias("p"))
    assert {r.s: (r.n, [tuple(p) for p in r.p]) for r in df.collect()} == cases


def test_inference_and_format(spark):
    cases = {"true": ("bool", "true"), "0x0f": ("byte", "15"), "0X1F": ("int", "0"), '"s"': ("string", "s"), "1.5": ("float", "1.5"), "7": ("int", "7"), "12abc": ("int", "12"), "99999999999": ("string", "99999999999"), "north": ("string", "north"), "1.5x": ("float", "1.5"), "": ("string", ""), '"': ("string", '"'), "-3": ("int", "-3"), ".": ("string", ".")}
    df = spark.createDataFrame([(s,) for s in cases], "s string").select("s", S.infer_kind(F.col("s")).alias("k"), S.infer_text(F.col("s")).alias("t"))
    assert {r.s: (r.k, r.t) for r in df.collect()} == cases
    floats = spark.createDataFrame([(x,) for x in (0.25, 0.35, 1.0, -2.75, 1e6)], "x float").select("x", S.one_decimal(F.col("x")).alias("t"))
    for r in floats.collect():
        assert r.t == "%.1f" % struct.unpack("f", struct.pack("f", r.x))[0]


def test_varints(spark):
    from voxlake.sources import codec

    values = [0, 1, -1, 63, 64, -64, -65, 8191, 8192, 1 << 40, (1 << 63) - 1, -(1 << 63)]
    df = spark.createDataFrame([(v,) for v in values], "n long").select("n", N.varint_hex(F.col("n")).alias("h"), N.varint_size(F.col("n")).alias("s"), N.varint_value(N.varint_hex(F.col("n"))).alias("b"))
    for r in df.collect():
        assert r.h == codec.varint(r.n).hex() and r.s == len(r.h) // 2 and r.b == r.n


def test_dimension_problems():
    w = lambda a, b: W.World(None, a, b).problem()
    assert [w(-129, 0), w(0, 129), w(5, 5), w(-4, 20)] == ["min", "max", "order", "ok"]


def sample(spark):
    cells = spark.createDataFrame([("overworld", x, y, z, f"minecraft:{'ab'[(x + y) % 2]}", f"biome{z % 3}", x * y) for x in (-17, -1, 0, 15, 16) for y in (-64, 0, 319) for z in (-16, 3)] + [("nether", 5, 5, 5, "minecraft:air", None, 1), ("nether", 5, 400, 5, "x", None, 2)], "dimension string, x int, y int, z int, name string, biome string, seq int")
    return cells, B.import_volume(cells, ["seq"])


def test_import_and_views(spark):
    cells, chunks = sample(spark)
    got = {tuple(r) for r in X.blocks(chunks).collect()}
    assert got == {(r.dimension, r.x, r.y, r.z, r.name) for r in cells.where("dimension = 'overworld'").collect()}
    assert chunks.where("dimension = 'nether'").count() == 1  # a chunk without content exists
    only = {tuple(r) for r in X.blocks(chunks, only="minecraft:a").collect()}
    assert only == {g for g in got if g[4] == "minecraft:a"}
    unknown = X.blocks(chunks, known=F.array(F.lit("minecraft:b"))).select("block").distinct().collect()
    assert [r.block for r in unknown] == ["minecraft:b"]
    biome = {tuple(r) for r in X.biomes(chunks).collect()}
    assert {(r.dimension, r.x, r.y, r.z, r.biome) for r in cells.where("dimension = 'overworld'").collect()} <= biome


@pytest.mark.parametrize("options", [{}, {"compression": "none"}, {"streaming": True}, {"compression": "best"}])
def test_files_round_trip(spark, tmp_path, options):
    _, chunks = sample(spark)
    full = chunks.withColumns({
        "block_entities": F.array(F.struct(F.lit(163).cast("smallint").alias("packed_xz"), F.lit(-60).alias("y"), F.lit("minecraft:chest").alias("id"), F.lit(b"\1").alias("data"))),
        "entities": F.array(F.struct(F.lit("123e4567-e89b-12d3-a456-426614174000").alias("uuid"), F.lit("minecraft:zombie").alias("id"), F.array(*[F.lit(v).cast("float") for v in (1.5, 64, -2.25)]).alias("position"), F.array(*[F.lit(v).cast("float") for v in (90, 0)]).alias("rotation"), F.array(*[F.lit(v).cast("float") for v in (0.5, 0, -0.5)]).alias("velocity"), F.lit(b"").alias("data"))),
        "scheduled_ticks": F.array(F.struct(F.lit(15).cast("smallint").alias("packed_xz"), F.lit(70).alias("y"), F.lit("minecraft:water").alias("block"), F.lit(1200).cast("bigint").alias("tick"))),
        "user_data": F.lit(b"u"),
    })
    path = str(tmp_path / "w")
    WF.write_worlds(full, path, **options)
    for back in (WF.read_worlds(spark, path), spark.read.format("worldfile").load(path)):
        assert {tuple(r) for r in X.blocks(back).collect()} == {tuple(r) for r in X.blocks(full).collect()}
        assert {(r.dimension, r.chunk_x, r.chunk_z, tuple(r.position)) for r in X.entities(back).collect()} == {(r.dimension, r.chunk_x, r.chunk_z, (1.5, 64, -2.25)) for r in X.entities(full).collect()}
        assert X.scheduled_ticks(back).count() == full.count() and X.block_entities(back).first().id == "minecraft:chest"
    heads = {r.dimension: r for r in WF.read_world_headers(spark, path).collect()}
    assert heads["overworld"].chunk_count == full.where("dimension = 'overworld'").count() and heads["nether"].chunk_count == 1


def test_store(spark, tmp_path):
    _, chunks = sample(spark)
    path = str(tmp_path / "store")
    store = W.Store.open(spark, path)
    assert store.world.count() == 0 and store.settings["time"] == 6000
    full = spark.createDataFrame([], WF.CHUNKS).unionByName(chunks, allowMissingColumns=True)
    empty = {c: F.coalesce(c, F.array().cast(full.schema[c].dataType)) for c in ("block_entities", "entities", "scheduled_ticks")}
    store = store.store_columns(full.withColumns(empty).withColumn("user_data", F.lit(b"")))
    assert store.world.is_dirty() and store.world.dirty().count() == chunks.count()
    assert not store.close().world.is_dirty()
    again = W.Store.open(spark, path, read_only=True)
    assert not again.world.is_dirty() and again.world.count() == chunks.count()
    assert again.load_column("overworld", -2, -1).count() == 1 and again.load_column("overworld", 99, 99).count() == 0
    assert again.store_columns(full).world is again.world
    counts = {r.dimension: r.chunks for r in again.chunk_counts().collect()}
    assert counts["end"] == 0 and counts["nether"] == 1 and counts["all"] == chunks.count()
    spawns = store.save_spawns(spark.createDataFrame([("u", 1, 2, 3)], "uuid string, x int, y int, z int")).save_spawns(spark.createDataFrame([("u", 4, 5, 6)], "uuid string, x int, y int, z int"))
    assert [tuple(r) for r in spawns.load_spawn("u").collect()] == [("u", 4, 5, 6)]


def test_settings(spark):
    values = W.DEFAULT_SETTINGS | {"name": "é", "raining": True, "spawnX": 3, "currentTick": 1 << 40}
    data = ST.encode_settings(values)
    assert ST.decode_settings(data) == values
    part = ST.nbt.encode({"spawnX": ("int", 5), "spawnY": ("int", 5), "time": ("int", 1), "name": ("string", "n")})
    assert ST.decode_settings(part) == W.DEFAULT_SETTINGS | {"name": "n"}
    df = spark.createDataFrame([(bytes(data),)], "b binary").select(ST.decoded_settings(F.col("b")).alias("s")).select("s.*")
    assert df.first().asDict() == values
    assert ST.with_settings_bytes(df).select(ST.decoded_settings(F.col("settings")).alias("s")).first().s.asDict() == values


def test_streaming_upsert(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "dimension string, x int, z int, v string, seq int"
    for rows in ([("overworld", 0, 0, "a", 1), ("overworld", 0, 0, "b", 2), ("nether", 1, 1, "c", 1)], [("overworld", 0, 0, "d", 3), ("overworld", 7, 7, "e", 4)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        U.upsert_stream(spark.readStream.schema(schema).parquet(source), target, str(tmp_path / "state"), ["seq"]).awaitTermination()
    got = {(r.dimension, r.x, r.z, r.v) for r in spark.read.parquet(target).collect()}
    assert got == {("overworld", 0, 0, "d"), ("nether", 1, 1, "c"), ("overworld", 7, 7, "e")}
