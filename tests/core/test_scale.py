"""What must hold as tables grow: nothing computed for every element, no chunk or file whole in a worker."""

import os
import random

import pytest
from pyspark.sql import functions as F

from voxlake.functions import packing as P
from voxlake.operators import columns as K
from voxlake.sources import codec, nbt
from voxlake.sources import worldfile as WF


@pytest.mark.parametrize("use", [lambda w: P.unpack_array(w, F.lit(2), 64), lambda w: P.repack_array(w, F.lit(3), F.lit(15), 64)])
def test_words_are_computed_once(spark, use):
    df = spark.createDataFrame([([5, 6],)], "w array<bigint>").select(use(F.reverse("w")).alias("o"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("reverse(") == 1


def test_repacked_words(spark):
    """Against whole numbers: widths that differ by row, words that are missing or null, equal widths, no entries."""
    rng, count = random.Random(3), 100
    bits = lambda n: 0 if n <= 1 else (n - 1).bit_length()

    def words(entries, b):
        per = 64 // b
        got = [sum(e << (j * b) for j, e in enumerate(entries[k : k + per])) for k in range(0, len(entries), per)]
        return [w - (1 << 64) if w >> 63 else w for w in got]

    rows, want = [], {}
    for k in range(60):
        a, n = rng.choice([(3, 15), (2, 4096), (17, 300), (300, 5), (4, 3), (1, 9), (5, 16)])
        held = rng.choice([count, count, 37, 0, None])
        top = min(a, n)
        entries = [rng.randrange(top) for _ in range(held or 0)]
        old = [] if bits(a) == 0 else words(entries, bits(a))
        rows.append((k, None if held is None else old, a, n))
        want[k] = rows[-1][1] if bits(a) == bits(n) or bits(a) == 0 else words(entries + [0] * (count - len(entries)), bits(n))
    df = spark.createDataFrame(rows, "k int, w array<bigint>, a int, n int")
    assert {r.k: r.o for r in df.select("k", P.repack_array(F.col("w"), F.col("a"), F.col("n"), count).alias("o")).collect()} == want


def large_world(spark):
    """One chunk with long lists, some small ones, and two rows of equal coordinates."""
    floats = lambda n: F.array(*[F.col("k").cast("float")] * n)
    k = spark.range(3000).withColumn("k", F.col("id").cast("int"))
    text = lambda p: F.concat(F.lit(p), F.col("k").cast("string"))
    be = F.struct((F.col("k") % 256).cast("smallint").alias("packed_xz"), F.col("k").alias("y"), text("b").alias("id"), text("data").cast("binary").alias("data"))
    en = F.struct(text("u").alias("uuid"), text("e").alias("id"), floats(3).alias("position"), floats(2).alias("rotation"), floats(3).alias("velocity"), text("x").cast("binary").alias("data"))
    tick = F.struct((F.col("k") % 256).cast("smallint").alias("packed_xz"), F.col("k").alias("y"), text("t").alias("block"), (F.col("id") * 12345 - 7).alias("tick"))
    lists = k.agg(*[F.array_sort(F.collect_list(v)).alias(n) for n, v in (("block_entities", be), ("entities", en), ("scheduled_ticks", tick))])
    section = F.expr("named_struct('block_palette', array('minecraft:air', 'a'), 'block_data', transform(sequence(1, 64), i -> cast(i AS bigint)), 'biome_palette', array('p'), 'biome_data', cast(array() AS array<bigint>))")
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], WF.CHUNKS).schema}
    one = lambda x, **own: lists.select(*[own.get(n, F.lit(x) if n == "x" else F.lit(0) if n == "z" else F.lit("overworld") if n == "dimension" else F.array() if t.typeName() == "array" else F.lit(b"")).cast(t).alias(n) for n, t in kinds.items()])
    whole = {n: F.col(n) for n in ("block_entities", "entities", "scheduled_ticks")}
    out = one(1, sections=F.array(F.lit(None), section), user_data=F.lit(b"large"), **whole)
    for x in (-1, 5, 6):
        out = out.unionByName(one(x, sections=F.array(section, section), user_data=F.lit(b"small")))
    return out.unionByName(one(7, user_data=F.lit(b"first"), **whole)).unionByName(one(7, user_data=F.lit(b"last")))


def comparable(rows):
    return {r.x: r.asDict(recursive=True) for r in rows}


@pytest.mark.parametrize("level,streaming", [("fast", False), ("default", True), ("none", False), ("none", True)])
def test_large_chunks_are_stored_in_frames(spark, tmp_path, monkeypatch, level, streaming):
    monkeypatch.setattr(WF, "PIECE", 1 << 13)
    monkeypatch.setattr(WF, "SMALL", 1 << 12)
    world, path = large_world(spark), str(tmp_path / "w")
    WF.write_worlds(world, path, user_data=b"u", compression=level, streaming=streaming, min_section=0, max_section=2)
    want = comparable(world.where("user_data <> 'first'").collect())
    for v in want.values():
        v["sections"] = v["sections"] or [None] * 2
    # as any reader of the format sees it: one stream
    file = tmp_path / "w" / "overworld.pile"
    header, chunks = codec.read_world(file.read_bytes())
    chunks = {c["x"]: c for c in chunks}
    assert header.user_data == b"u" and header.chunk_count == 5 and list(chunks) == [-1, 1, 5, 6, 7] and (header.declared_len == 0) == streaming
    assert {k: {"dimension": "overworld", **c} for k, c in chunks.items()} == want
    assert comparable(WF.read_worlds(spark, path).collect()) == want
    with open(file, "rb") as f:
        frames = codec.read_index(f, file.stat().st_size)
    assert (frames is None) == (level == "none")
    if frames:
        assert len(frames) > 20
        sizes = [len(r.entities) for r in WF.read_worlds(spark, path, whole=False).collect()]
        assert sum(sizes) == 3000 and max(sizes) < 1000
    assert os.listdir(path) == ["overworld.pile"]


def test_a_list_of_frames_that_does_not_fit(spark, tmp_path):
    """Without its list, or with a wrong one, a file is read as one stream."""
    WF.write_worlds(large_world(spark), str(tmp_path / "w"), min_section=0, max_section=2)
    file = tmp_path / "w" / "overworld.pile"
    data, want = file.read_bytes(), comparable(WF.read_worlds(spark, str(tmp_path / "w")).collect())
    with open(file, "rb") as f:
        frames = codec.read_index(f, len(data))
    size = len(codec.index_frame(0, [f[1:] for f in frames]))
    wrong = [(*f[1:5], f[5] + 1) if f[4] == codec.WHOLE else f[1:] for f in frames]
    for name, end in (("none", b""), ("wrong", codec.index_frame(frames[0][0], wrong)), ("moved", codec.index_frame(frames[0][0] + 1, [f[1:] for f in frames]))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "overworld.pile").write_bytes(data[:-size] + end)
        with open(tmp_path / name / "overworld.pile", "rb") as f:
            assert codec.read_index(f, len(data) - size + len(end)) is None
        assert comparable(WF.read_worlds(spark, str(tmp_path / name)).collect()) == want


def test_elements_without_chunk_rows(spark, tmp_path):
    """Columns written element by element are the file that whole chunks give."""
    rows = spark.range(500).select(F.lit("overworld").alias("dimension"), (F.col("id") % 40 - 20).cast("int").alias("x"), F.col("id").cast("int").alias("y"), F.lit(3).alias("z"), F.lit("stone[a=b]").alias("block"), F.col("id").alias("tick"))
    grid = spark.createDataFrame([("overworld", 9, 9)], "dimension string, x int, z int")
    WF.write_worlds(K.to_chunks(grid, ticks=rows), str(tmp_path / "a"), min_section=0, max_section=1)
    K.write_columns(grid, str(tmp_path / "b"), ticks=rows, min_section=0, max_section=1)
    assert (tmp_path / "a" / "overworld.pile").read_bytes() == (tmp_path / "b" / "overworld.pile").read_bytes()
    assert WF.read_worlds(spark, str(tmp_path / "b")).count() == 5


def test_tags_of_equal_bytes_in_every_order():
    value = {"l": ("list", ("list", [("int", [1, 2]), ("string", ["é"])])), "e": ("list", ("end", [])), "c": ("compound", {"x": ("bytes", b"\0\1"), "i": ("ints", []), "q": ("longs", [-1])})}
    for order in ("big", "little"):
        data = nbt.encode(value, order)
        assert nbt.decode(data, order) == value
        for n in range(1, len(data)):
            with pytest.raises(codec.FormatError):
                nbt.decode(data[:n], order)
