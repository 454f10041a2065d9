"""A virtual world over the driver's tables: deterministic cells, entities and settings, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coords as C
from ..operators import build as B


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SEQUENCE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a block placed at (x, y, z); y passes the top of the world on purpose."""
    name = F.concat(F.lit("minecraft:"), F.lower("l_returnflag"), F.lower("l_linestatus"), F.lit("_"), F.col("l_linenumber").cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        F.lit("overworld").alias("dimension"),
        ((F.col("l_partkey") % 64) - 32).cast("int").alias("x"),
        (F.col("l_quantity").cast("int") * 8 - 64 + (F.col("l_orderkey") % 8)).cast("int").alias("y"),
        ((F.col("l_suppkey") % 64) - 32).cast("int").alias("z"),
        name.alias("block"),
        *SEQUENCE,
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block for each position: the greatest name."""
    return placements(spark, sf_dir).groupBy("dimension", "x", "y", "z").agg(F.max("block").alias("block"))


def addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.addressed(cells(spark, sf_dir))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells as assembled chunks, block names serving as biomes too."""
    a = addressed(spark, sf_dir)
    return B.assemble(a, a.withColumnRenamed("block", "biome"))


def sequenced_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk coordinates of every line item with its sequence."""
    p = placements(spark, sf_dir)
    return p.select("dimension", F.col("x"), F.col("z"), *SEQUENCE)


#: The same tables in SQL, as WITH entries.
PLACED = """placed AS (SELECT CAST(l_partkey % 64 AS INT) - 32 AS x,
  CAST(CAST(l_quantity AS INT) * 8 - 64 + l_orderkey % 8 AS INT) AS y, CAST(l_suppkey % 64 AS INT) - 32 AS z,
  concat('minecraft:', lower(l_returnflag), lower(l_linestatus), '_', CAST(l_linenumber AS VARCHAR)) AS st,
  l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)"""
CELLS = PLACED + ", cells AS (SELECT x, y, z, max(st) AS st FROM placed GROUP BY ALL)"
ADDRESSED = CELLS + """, i AS (SELECT x, y, z, x >> 4 AS cx, z >> 4 AS cz, (y >> 4) + 4 AS si,
  (y & 15) * 256 + (z & 15) * 16 + (x & 15) AS li, st FROM cells WHERE (y >> 4) + 4 BETWEEN 0 AND 23)"""
PALETTE = ADDRESSED + """, pal AS (SELECT cx, cz, si, st, CAST(row_number() OVER (PARTITION BY cx, cz, si ORDER BY st) AS INT) AS pi
  FROM (SELECT DISTINCT cx, cz, si, st FROM i)), sz AS (SELECT cx, cz, si, CAST(count(*) + 1 AS INT) AS n FROM pal GROUP BY ALL),
  b AS (SELECT cx, cz, si, n, CAST(length(ltrim(bin(n - 1), '0')) AS INT) AS bits FROM sz)"""
ENTITY = """ent AS (SELECT event_id, concat('minecraft:', event_type) AS id, CAST(user_id % 200 AS INT) - 100 AS bx,
  CAST(event_id % 300 AS INT) AS by_, CAST(user_id % 77 AS INT) - 38 AS bz FROM events)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.concat(F.lit("minecraft:"), F.col("event_type")).alias("id"),
        ((F.col("user_id") % 200) - 100).cast("int").alias("bx"),
        (F.col("event_id") % 300).cast("int").alias("by_"),
        ((F.col("user_id") % 77) - 38).cast("int").alias("bz"),
    )


def block_entity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as block entities; every seventh has no name, every fifth no tag."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        "c_custkey",
        F.lit("overworld").alias("dimension"),
        ((k * 7) % 90 - 45).cast("int").alias("x"),
        (k % 320 - 64).cast("int").alias("y"),
        ((k * 11) % 90 - 45).cast("int").alias("z"),
        F.when(k % 7 != 0, F.lower("c_mktsegment")).alias("name"),
        F.when(k % 5 != 0, F.lit("t")).alias("tag"),
    )


BLOCK_ENTITY = """be AS (SELECT c_custkey, CAST((c_custkey * 7) % 90 - 45 AS INT) AS x, CAST(c_custkey % 320 - 64 AS INT) AS y,
  CAST((c_custkey * 11) % 90 - 45 AS INT) AS z, CASE WHEN c_custkey % 7 <> 0 THEN lower(c_mktsegment) END AS name,
  CASE WHEN c_custkey % 5 <> 0 THEN 't' END AS tag FROM customer)"""


def key_of(x: str, z: str):
    return C.chunk_key(F.col(x), F.col(z))
