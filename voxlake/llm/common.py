"""What several operators of this subpackage share: tables, lineage cuts, components.

Lineage is cut by writing Parquet to the shared folder named in
``spark.checkpoint.dir``: the files outlive a lost executor, are columnar and
compressed, and are read again like any table.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(module: str) -> None:
    """Let executors run functions of a module that only the driver can import."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where it is set; a temporary folder otherwise, which only a local master may use."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not (context.master or "").startswith("local") or (context.master or "").startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir().rstrip("/")


#: Paths of the tables that this process wrote with ``stash``, until ``drop_stashes``.
_WRITTEN: list[str] = []


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a durable lineage cut."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def drop_stashes(spark: SparkSession) -> int:
    """Delete the written tables, once no result that reads them is needed any more; how many there were."""
    n = len(_WRITTEN)
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def tidy(df: DataFrame) -> None:
    """Let go of the shuffle files of finished steps.

    Spark removes them once nothing refers to them, which it learns from the
    garbage collector; the first round frees the plans, the second their files."""
    for _ in range(2):
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def pieces(batch, rows: int = 512):
    """A batch in short pieces, so that what is made of long texts stays small."""
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def give_back() -> None:
    """Return what a Python worker holds but does not use to the system: workers wait for later tasks and stages beside the ones at work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def returning(run):
    """``run`` over the batches of a task, after which its memory goes back to the system."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def row_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))


def text_digest() -> Column:
    """Two independent 64-bit hashes of the text, as one value that joins and groups."""
    return F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))


def sampled(rows: DataFrame, order: str, most: int, most_bytes: int) -> DataFrame:
    """Of rows with a hash ``order`` and a ``text`` those with the least hash: ``most`` rows at most, and at most
    ``most_bytes`` of text in all (the first row in any case). Only hashes and lengths reach the driver for this."""
    thin = rows.groupBy(order).agg(F.max(F.octet_length("text")).alias("n")).orderBy(order).limit(most).collect()
    bound, total = None, 0
    for row in thin:
        total += row["n"] or 0
        if bound is not None and total > most_bytes:
            break
        bound = row[order]
    return rows.where(F.lit(False) if bound is None else F.col(order) <= bound)


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3; rows of fold 1 are held out of all learning."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold_of(doc_id) == 1, F.lit(False))


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph given as rows ``(u, v)``.

    Alternating large-star and small-star rounds (each a join on the node with
    its least neighbour), until a round changes no edge. Returns
    ``(node, root)`` for every node with at least one edge to another node,
    root being the least node of its component. An empty input gives no rows.
    """
    e = stash(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _signature(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stash(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = stash(small.distinct(), "edges")
        now = _signature(e)
        if now == seen:
            break
        seen = now
    # at rest every edge leads from a node to the root of its star
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
