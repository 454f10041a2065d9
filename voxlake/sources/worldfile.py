"""World files as DataFrames: a data source ``worldfile``, a scan through Spark's own file readers, directories of dimensions."""

from __future__ import annotations

import base64
import glob
import os
import shutil
import struct
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import codec

for _module in (codec.__name__, __name__):
    cloudpickle.register_pickle_by_value(sys.modules[_module])

_SECTION = "struct<block_palette:array<string>,block_data:array<bigint>,biome_palette:array<string>,biome_data:array<bigint>>"
CHUNKS = (
    "dimension string, x int, z int, "
    f"sections array<{_SECTION}>, "
    "block_entities array<struct<packed_xz:smallint,y:int,id:string,data:binary>>, "
    "entities array<struct<uuid:string,id:string,position:array<float>,rotation:array<float>,velocity:array<float>,data:binary>>, "
    "scheduled_ticks array<struct<packed_xz:smallint,y:int,block:string,tick:bigint>>, user_data binary"
)
WORLDS = "dimension string, version smallint, compression smallint, declared_len bigint, min_section int, max_section int, user_data binary, chunk_count bigint"
#: File names of a world directory.
FILES = {"overworld": "overworld.pile", "nether": "nether.pile", "end": "end.pile"}


def dimension_of(path: str) -> str:
    name = os.path.basename(path)
    return next((d for d, f in FILES.items() if f == name), "unknown")


def file_of(dimension: str) -> str:
    return FILES.get(dimension, "unknown.pile")


def _chunk_tuple(dimension: str, c: dict) -> tuple:
    def rows(items, *names):
        return [tuple(i[n] for n in names) for i in items]

    sections = [None if s is None else tuple(s[n] for n in ("block_palette", "block_data", "biome_palette", "biome_data")) for s in c["sections"]]
    return (
        dimension,
        c["x"],
        c["z"],
        sections,
        rows(c["block_entities"], "packed_xz", "y", "id", "data"),
        rows(c["entities"], "uuid", "id", "position", "rotation", "velocity", "data"),
        rows(c["scheduled_ticks"], "packed_xz", "y", "block", "tick"),
        c["user_data"],
    )


def _last_wins(chunks: Iterator[dict]) -> list[dict]:
    """Of chunks with equal coordinates the last."""
    return list({(c["x"], c["z"]): c for c in chunks}.values())


class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WorldReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        found = sorted(glob.glob(os.path.join(self.path, "*.pile"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        if not found:
            raise FileNotFoundError(self.path)
        return [FilePartition(p) for p in found]

    def read(self, partition):
        with open(partition.path, "rb") as file:
            content = file.read()
        for c in codec.unique_chunks(content):
            yield _chunk_tuple(dimension_of(partition.path), c)


class Written(WriterCommitMessage):
    def __init__(self, moves: list[tuple[str, str]]):
        self.moves = moves


class WorldWriter(DataSourceWriter):
    """One file for each dimension, which must arrive in one task that holds it; ``write_worlds`` holds pieces. Files appear by rename at commit."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.low, self.high = int(options.get("min_section", -4)), int(options.get("max_section", 20))
        self.level, self.streaming = options.get("compression", "default"), options.get("streaming", "false") == "true"
        self.user_data = base64.b64decode(options.get("user_data", ""))

    def write(self, rows):
        files: dict[str, tuple] = {}
        os.makedirs(self.path, exist_ok=True)
        held: dict[str, list[dict]] = {}
        for r in rows:
            held.setdefault(r["dimension"], []).append(r.asDict(recursive=True))
        for dimension, chunks in held.items():
            target = os.path.join(self.path, file_of(dimension))
            draft = f"{target}.{uuid.uuid4().hex}.tmp"
            chunks = _last_wins(iter(chunks))
            with open(draft, "wb") as out:
                codec.write_world(out, codec.Header(codec.VERSION, 0, 0, self.low, self.high, self.user_data, len(chunks)), chunks, self.level, self.streaming)
            files[dimension] = (draft, target)
        return Written(list(files.values()))

    def commit(self, messages):
        moves = [m for message in messages if message for m in message.moves]
        targets = [t for _, t in moves]
        if len(set(targets)) < len(targets):
            self.abort(messages)
            raise ValueError("a dimension arrived in more than one task; use write_worlds")
        for draft, target in moves:
            os.replace(draft, target)

    def abort(self, messages):
        for message in messages:
            for draft, _ in message.moves if message else []:
                if os.path.exists(draft):
                    os.remove(draft)


class WorldFileSource(DataSource):
    @classmethod
    def name(cls):
        return "worldfile"

    def schema(self):
        return CHUNKS

    def reader(self, schema):
        return WorldReader(self.options["path"])

    def writer(self, schema, overwrite):
        return WorldWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorldFileSource)


def _local(name: str) -> str:
    """The path of a file that Spark names by a URL of its own."""
    return os.path.normpath("/" + name.removeprefix("file:").lstrip("/"))


def _files(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """The world files at ``path``, and whether workers can open them: those of another store come whole through Spark."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pile").load(path)
    return files, all(f.startswith("file:") for f in files.inputFiles())


_FRAMES = "path string, at bigint, length bigint, x int, z int, kind int, n bigint"
#: ``CHUNKS`` in pieces: the lists of a large chunk come in several rows, ordered by ``at``; its sections are in the first, its user data in the last.
PIECES = CHUNKS + ", at bigint"


def _indexed(batches):
    """A row for each frame that holds something, or one for a file without a list of frames."""
    for batch in batches:
        for name in batch.column(0).to_pylist():
            with open(_local(name), "rb") as file:
                found = codec.read_index(file, os.path.getsize(file.name))
            rows = [(0, 0, 0, 0, -1, 0)] if found is None else [e for e in found if e[4] not in (codec.COUNT, codec.COUNT_TICKS)]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), *columns], names=["path", "at", "length", "x", "z", "kind", "n"])


def _chunk_batches(dimension: str, chunks: Iterator[dict], at: int = 0):
    schema, rows, weight = _arrow_schema().append(pa.field("at", pa.int64())), [], 0
    for c in chunks:
        rows.append(dict(zip(schema.names, (*_named(_chunk_tuple(dimension, c)), at))))
        weight += 64 + len(c["block_entities"]) + len(c["entities"]) + len(c["scheduled_ticks"])
        if weight >= 1 << 14:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            rows, weight = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _vectors(numbers: np.ndarray) -> pa.Array:
    n, width = numbers.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(numbers.astype(np.float32).ravel()))


def _part_batch(dimension: str, x: int, z: int, kind: int, n: int, data: bytes, at: int) -> pa.RecordBatch:
    """One row: a piece of a large chunk."""
    schema = _arrow_schema()
    held = dict(dimension=pa.array([dimension], pa.string()), x=pa.array([x], pa.int32()), z=pa.array([z], pa.int32()))
    name = {codec.BLOCK_ENTITIES: "block_entities", codec.ENTITIES: "entities", codec.TICKS: "scheduled_ticks"}.get(kind)
    if kind == codec.HEAD:
        r = codec.Reader(data)
        r.take(8)
        sections = [None if codec.is_empty(s := codec.read_section(r)) else s for _ in range(n)]
        held["sections"] = pa.array([sections], schema.field("sections").type)
    elif kind == codec.TAIL:
        held["user_data"] = pa.array([codec.Reader(data).bytes()], pa.binary())
    else:
        type_ = schema.field(name).type
        if kind == codec.ENTITIES:
            uuids, names, vectors, rest = codec.entity_columns(data, n)
            v = np.frombuffer(vectors, ">f4").reshape(n, 8)
            columns = [uuids, names, _vectors(v[:, :3]), _vectors(v[:, 3:5]), _vectors(v[:, 5:]), rest]
        else:
            columns = (codec.block_entity_columns if kind == codec.BLOCK_ENTITIES else codec.tick_columns)(data, n)
        fields = [type_.value_type.field(k) for k in range(type_.value_type.num_fields)]
        arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, fields)]
        held[name] = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.StructArray.from_arrays(arrays, fields=[pa.field(f.name, a.type) for f, a in zip(fields, arrays)]))
    lists = ("block_entities", "entities", "scheduled_ticks")
    arrays = [held.get(f.name, pa.array([[]] if f.name in lists else [None], f.type)) for f in schema]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([at], pa.int64())], names=[*schema.names, "at"])


def _decoded(batches):
    """Frames to rows, each read from its file alone."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for e in batch.to_pylist():
            dimension = dimension_of(e["path"])
            with open(_local(e["path"]), "rb") as file:
                if e["kind"] < 0:
                    yield from _chunk_batches(dimension, codec.unique_chunks(file.read()))
                    continue
                file.seek(e["at"])
                data = unpack.decompress(file.read(e["length"]))
            if e["kind"] == codec.WHOLE:
                # z is the number of sections here
                r = codec.Reader(data)
                yield from _chunk_batches(dimension, (codec.read_chunk(r, e["z"]) for _ in range(e["n"])), e["at"])
            else:
                yield _part_batch(dimension, e["x"], e["z"], e["kind"], e["n"], data, e["at"])


def read_worlds(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """Chunks of the world files at ``path``, listed by Spark's binary file scan from any store it knows.

    A file with a list of frames is decoded frame by frame in many tasks, any other whole in one. With ``whole`` false
    the pieces of a large chunk stay rows of their own, which every view that explodes takes; see ``PIECES``."""
    files, local = _files(spark, path)

    def decode(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from _chunk_batches(dimension_of(name), codec.unique_chunks(content.as_py()))

    if not local:
        return files.select("path", "content").mapInArrow(decode, PIECES).drop("at")
    frames = files.select("path").mapInArrow(_indexed, _FRAMES).repartition(3 * spark.sparkContext.defaultParallelism)
    pieces = frames.mapInArrow(_decoded, PIECES)
    if not whole:
        return pieces.drop("at")
    rest = ["sections", "block_entities", "entities", "scheduled_ticks", "user_data"]
    met = pieces.groupBy("dimension", "x", "z").agg(F.array_sort(F.collect_list(F.struct("at", *rest))).alias("_p"))
    first = lambda c: F.element_at(F.filter(F.col(f"_p.{c}"), lambda v: v.isNotNull()), 1)
    return met.select("dimension", "x", "z", *[(first(c) if c in ("sections", "user_data") else F.flatten(F.col(f"_p.{c}"))).alias(c) for c in rest])


def read_world_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: its header and section range."""

    def decode(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1) if batch.num_columns > 1 else [None] * len(batch)):
                h = codec.probe_header(_first_bytes(_local(name)) if content is None else content.as_py())
                rows.append({"dimension": dimension_of(name), "version": h.version, "compression": h.compression, "declared_len": h.declared_len, "min_section": h.min_section, "max_section": h.max_section, "user_data": h.user_data, "chunk_count": h.chunk_count})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("dimension", pa.string()), ("version", pa.int16()), ("compression", pa.int16()), ("declared_len", pa.int64()), ("min_section", pa.int32()), ("max_section", pa.int32()), ("user_data", pa.binary()), ("chunk_count", pa.int64())]))

    files, local = _files(spark, path)
    return files.select("path", *[] if local else ["content"]).mapInArrow(decode, WORLDS)


def _first_bytes(path: str) -> bytes:
    """So many bytes as a header can have."""
    with open(path, "rb") as file:
        return file.read(codec.MAX_BYTES + (1 << 16))


def _arrow_schema() -> pa.Schema:
    section = pa.struct([("block_palette", pa.list_(pa.string())), ("block_data", pa.list_(pa.int64())), ("biome_palette", pa.list_(pa.string())), ("biome_data", pa.list_(pa.int64()))])
    be = pa.struct([("packed_xz", pa.int16()), ("y", pa.int32()), ("id", pa.string()), ("data", pa.binary())])
    vec = pa.list_(pa.float32())
    en = pa.struct([("uuid", pa.string()), ("id", pa.string()), ("position", vec), ("rotation", vec), ("velocity", vec), ("data", pa.binary())])
    tick = pa.struct([("packed_xz", pa.int16()), ("y", pa.int32()), ("block", pa.string()), ("tick", pa.int64())])
    return pa.schema([("dimension", pa.string()), ("x", pa.int32()), ("z", pa.int32()), ("sections", pa.list_(section)), ("block_entities", pa.list_(be)), ("entities", pa.list_(en)), ("scheduled_ticks", pa.list_(tick)), ("user_data", pa.binary())])


def _named(row: tuple) -> tuple:
    """The tuple form of a chunk with its structs as dictionaries."""
    keys = {3: ("block_palette", "block_data", "biome_palette", "biome_data"), 4: ("packed_xz", "y", "id", "data"), 5: ("uuid", "id", "position", "rotation", "velocity", "data"), 6: ("packed_xz", "y", "block", "tick")}
    return tuple([None if i is None else dict(zip(keys[k], i)) for i in v] if k in keys else v for k, v in enumerate(row))


#: Raw bytes of a piece, and the size below which a chunk is one; a frame holds a piece or some of these.
PIECE, SMALL = 1 << 20, 1 << 16
#: An atom is a chunk's own row (part 1) or an element of one of its lists; ``copy`` tells rows of equal coordinates apart.
_ATOM = {"part": "int", "seq": "int", "n1": "smallint", "n2": "int", "a": "string", "b": "string", "v": "array<float>", "n3": "bigint", "data": "binary", "sections": f"array<{_SECTION}>"}
_PARTS = {"block_entities": codec.BLOCK_ENTITIES, "entities": codec.ENTITIES, "scheduled_ticks": codec.TICKS}
_PIECE = "dimension string, x int, z int, part int, no int, n int, packed boolean, raw bigint, bytes binary"


def _atom(**given: Column) -> Column:
    return F.struct(*[given.get(k, F.lit(None)).cast(t).alias(k) for k, t in _ATOM.items()])


def _element(name: str, e: Column, seq: Column) -> Column:
    """An element as an atom, whose fields in order sort as the element does."""
    own = {"part": F.lit(_PARTS[name]), "seq": seq}
    if name == "entities":
        return _atom(**own, a=e["uuid"], b=e["id"], v=F.concat(e["position"], e["rotation"], e["velocity"]), data=e["data"])
    own |= {"n1": e["packed_xz"], "n2": e["y"]}
    return _atom(**own, a=e["id"], data=e["data"]) if name == "block_entities" else _atom(**own, a=e["block"], n3=e["tick"])


def _numbered(name: str):
    return lambda e, i: _element(name, e, i)


def _atoms(chunks: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    have = {n: F.coalesce(F.col(n), F.array().cast(chunks.schema[n].dataType)) for n in _PARTS if n in chunks.columns and n not in parts}
    head = _atom(part=F.lit(codec.HEAD), seq=F.lit(0), **{k: F.col(c) for k, c in (("sections", "sections"), ("data", "user_data")) if c in chunks.columns})
    listed = F.concat(F.array(head), *[F.transform(c, _numbered(n)) for n, c in have.items()])
    # beside an explode the ids would be those of its rows
    out = chunks.withColumn("copy", F.monotonically_increasing_id()).select("dimension", "x", "z", "copy", F.explode(listed).alias("_a"))
    for n, rows in parts.items():
        out = out.unionByName(rows.select("dimension", "x", "z", F.lit(None).cast("bigint").alias("copy"), _element(n, F.col("v"), F.lit(0)).alias("_a")))
    return out.select("dimension", "x", "z", "copy", "_a.*")


def _section_bytes(sections: list | None, count: int) -> bytes:
    w = codec.Writer()
    held = list(sections or [])[:count]
    for s in held + [None] * (count - len(held)):
        codec.write_section(w, s)
    return w.done()


def _element_bytes(part: int, rows: pa.RecordBatch) -> list[bytes]:
    columns = {n: rows.column(n).to_pylist() for n in ("a", "data")}
    if part == codec.ENTITIES:
        v = rows.column("v")
        if v.null_count or not np.all(np.diff(v.offsets.to_numpy()) == 8):
            raise codec.FormatError("an entity has not eight numbers")
        numbers = v.flatten().to_numpy(zero_copy_only=False).astype(">f4").tobytes()
        return [codec.entity_bytes(u, i, numbers[32 * k : 32 * k + 32], d) for k, (u, i, d) in enumerate(zip(columns["a"], rows.column("b").to_pylist(), columns["data"]))]
    places = rows.column("n1").to_pylist(), rows.column("n2").to_pylist(), columns["a"]
    return list(map(codec.block_entity_bytes, *places, columns["data"]) if part == codec.BLOCK_ENTITIES else map(codec.tick_bytes, *places, rows.column("n3").to_pylist()))


class _Encoder:
    """Atoms of one chunk after another to pieces: a large chunk is never held whole."""

    def __init__(self, count: int, grade: int | None):
        self.count, self.pack = count, grade is not None and zstandard.ZstdCompressor(level=grade)

    def begin(self, key: tuple) -> None:
        self.key, self.copy, self.sections, self.user_data = key, None, None, b""
        self.held = {p: [] for p in _PARTS.values()}
        self.size, self.counts, self.nos = dict.fromkeys(self.held, 0), dict.fromkeys(self.held, 0), dict.fromkeys(self.held, 0)

    def row(self, part: int, n: int, data: bytes, no: int = 0) -> tuple:
        packed = bool(self.pack) and part != codec.WHOLE
        return (*self.key, part, no, n, packed, len(data), self.pack.compress(data) if packed else data)

    def add(self, part: int, elements: list[bytes]) -> Iterator[tuple]:
        for e in elements:
            self.held[part].append(e)
            self.size[part] += len(e)
            if self.size[part] >= PIECE:
                yield self.flush(part)

    def flush(self, part: int) -> tuple:
        held, self.held[part], self.size[part] = self.held[part], [], 0
        self.counts[part] += len(held)
        self.nos[part] += 1
        return self.row(part, len(held), b"".join(held), self.nos[part])

    def end(self) -> Iterator[tuple]:
        place = struct.pack(">ii", *self.key[1:])
        sections = _section_bytes(self.sections, self.count)
        small = not any(self.nos.values()) and len(sections) + len(self.user_data) + sum(self.size.values()) < SMALL
        if small:
            lists = b"".join(codec.varint(len(e)) + b"".join(e) for e in self.held.values())
            yield self.row(codec.WHOLE, 1, place + sections + lists + self._blob())
            return
        for part in self.held:
            if self.held[part]:
                yield self.flush(part)
            n = codec.varint(self.counts[part])
            # the count of a list stands before it
            yield self.row(part - 1, self.count, place + sections + n if part - 1 == codec.HEAD else n)
        yield self.row(codec.TAIL, 1, self._blob())

    def _blob(self) -> bytes:
        if len(self.user_data) > codec.MAX_BYTES:
            raise codec.FormatError(f"{len(self.user_data)} bytes where {codec.MAX_BYTES} are allowed")
        return codec.blob(self.user_data)


def _piece_batches(rows: Iterator[tuple]):
    schema = pa.schema([("dimension", pa.string()), ("x", pa.int32()), ("z", pa.int32()), ("part", pa.int32()), ("no", pa.int32()), ("n", pa.int32()), ("packed", pa.bool_()), ("raw", pa.int64()), ("bytes", pa.binary())])
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) + 64
        if size >= 4 * PIECE:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _encoded(count: int, grade: int | None):
    def pieces(batches):
        chunk = _Encoder(count, grade)
        chunk.begin(key := None)
        for batch in batches:
            if not len(batch):
                continue
            names = [c if c is not None else "" for c in batch.column("dimension").to_pylist()]
            marks = [pc.fill_null(batch.column(c), -1).to_numpy() for c in ("x", "z", "copy", "part")]
            new = np.flatnonzero(np.any([np.diff(m) != 0 for m in marks], axis=0) | np.array([a != b for a, b in zip(names, names[1:])], bool)) + 1
            edges = [0, *new.tolist(), len(batch)]
            for i, j in zip(edges, edges[1:]):
                rows = batch.slice(i, j - i)
                now = (rows.column("dimension")[0].as_py(), rows.column("x")[0].as_py(), rows.column("z")[0].as_py())
                if now != key:
                    if key is not None:
                        yield from chunk.end()
                    chunk.begin(key := now)
                copy, part = rows.column("copy")[0].as_py(), rows.column("part")[0].as_py()
                chunk.copy = copy if chunk.copy is None else chunk.copy
                if copy is not None and copy != chunk.copy:
                    continue
                if part == codec.HEAD:
                    chunk.sections, chunk.user_data = rows.column("sections")[0].as_py(), rows.column("data")[0].as_py() or b""
                else:
                    yield from chunk.add(part, _element_bytes(part, rows))
        if key is not None:
            yield from chunk.end()

    return lambda batches: _piece_batches(pieces(batches))


class _File:
    """A world file in the making: frames in order, the header in front when their number is known."""

    def __init__(self, folder: str, dimension: str | None, low: int, high: int, user_data: bytes, grade: int | None):
        self.target, self.draft = file_of(dimension), os.path.join(folder, uuid.uuid4().hex)
        self.low, self.high, self.user_data, self.grade = low, high, user_data, grade
        self.pack = None if grade is None else zstandard.ZstdCompressor(level=grade)
        self.body, self.small, self.entries = open(self.draft + ".body", "wb"), [], []
        self.raw = self.stored = self.chunks = self.waiting = 0

    def add(self, x: int, z: int, part: int, n: int, raw: int, data: bytes) -> None:
        self.raw += raw
        self.chunks += part in (codec.WHOLE, codec.HEAD)
        if part == codec.WHOLE and self.pack:
            self.small.append(data)
            self.waiting += len(data)
            if self.waiting >= PIECE:
                self.flush()
            return
        self.flush()
        self._put(x, z, part, n, data)

    def flush(self) -> None:
        if self.small:
            self._put(0, self.high - self.low, codec.WHOLE, len(self.small), self.pack.compress(b"".join(self.small)))
            self.small, self.waiting = [], 0

    def _put(self, x: int, z: int, kind: int, n: int, data: bytes) -> None:
        self.body.write(data)
        self.stored += len(data)
        if self.pack:
            self.entries.append((len(data), x, z, kind, n))

    def done(self, level: str, streaming: bool) -> tuple[str, str]:
        self.flush()
        self.body.close()
        header = next(codec.payload_parts(codec.Header(codec.VERSION, 0, 0, self.low, self.high, self.user_data, self.chunks), []))
        self.raw += len(header)
        first = self.pack.compress(header) if self.pack else header
        code = codec.RAW if self.grade is None else codec.ZSTD
        if not streaming and self.pack and not codec.compress_decision(level, self.raw, self.stored + len(first)):
            code = codec.RAW
        head = codec.head(code, 0 if streaming else self.raw)
        with open(self.draft, "wb") as out, open(self.draft + ".body", "rb") as body:
            out.write(head)
            out.write(first if code == codec.ZSTD else header)
            if self.pack and code == codec.RAW:
                body = zstandard.ZstdDecompressor().stream_reader(body, read_across_frames=True)
            shutil.copyfileobj(body, out, PIECE)
            if code == codec.ZSTD:
                out.write(codec.index_frame(len(head), [(len(first), 0, 0, codec.COUNT, 0), *self.entries]))
        os.remove(self.draft + ".body")
        return self.draft, self.target


def write_worlds(chunks: DataFrame, path: str, user_data: bytes = b"", streaming: bool = False, compression: str = "default", min_section: int = -4, max_section: int = 20, **parts: DataFrame) -> None:
    """Write each dimension to its file under ``path``; of chunks with equal coordinates one is written.

    ``parts`` (``block_entities``, ``entities``, ``scheduled_ticks``) are elements ``(dimension, x, z, v)`` in place of the
    chunks' lists; they make chunks where there are none. Chunks become pieces, which are encoded and compressed in many
    tasks; a dimension is one file, so one task puts its pieces behind each other. Streaming always compresses and
    declares no length. Files appear by rename when all are written."""
    register(chunks.sparkSession)
    low, high, grade = int(min_section), int(max_section), codec.LEVELS.get(compression, codec.LEVELS["default"])
    order = ["dimension", "x", "z", F.col("copy").desc_nulls_last(), "part", "seq", "n1", "n2", "a", "b", "v", "n3", "data"]
    dealt = _atoms(chunks, parts).repartition("dimension", "x", "z").sortWithinPartitions(*order)
    pieces = dealt.mapInArrow(_encoded(high - low, grade), _PIECE)
    folder = os.path.join(path, f".draft-{uuid.uuid4().hex}")

    def join(batches):
        file, name = None, None
        os.makedirs(folder, exist_ok=True)
        made = []
        for batch in batches:
            for k in range(len(batch)):
                dimension, x, z, part, _, n, _, raw, data = (c[k].as_py() for c in batch.columns)
                if file is None or dimension != name:
                    if file is not None:
                        made.append(file.done(compression, streaming))
                    file, name = _File(folder, dimension, low, high, user_data, grade), dimension
                file.add(x, z, part, n, raw, data)
        if file is not None:
            made.append(file.done(compression, streaming))
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], pa.string()) for i in (0, 1)], names=["draft", "target"])

    files = pieces.repartition(len(FILES) + 1, F.col("dimension")).sortWithinPartitions("dimension", "x", "z", "part", "no")
    try:
        moves = [tuple(r) for r in files.mapInArrow(join, "draft string, target string").collect()]
        if len({t for _, t in moves}) < len(moves):
            raise ValueError("more than one dimension has no file name of its own")
        for draft, target in moves:
            os.replace(draft, os.path.join(path, target))
    finally:
        shutil.rmtree(folder, ignore_errors=True)
