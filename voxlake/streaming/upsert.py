"""Streaming upserts: micro-batches of chunks into a table, last change wins.

A trigger coalesces bursts: all changes since the last one become one write.
Only the dimensions that a batch touches are rewritten.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.build import last_wins
from ..operators.world import upsert

KEYS = ["dimension", "x", "z"]


def merge_batch(table_path: str, batch: DataFrame, sequence: list[str]) -> None:
    """Upsert one batch into Parquet partitioned by dimension, each partition written anew and swapped in."""
    spark = batch.sparkSession
    new = last_wins(batch, KEYS, sequence)
    try:
        old = spark.read.parquet(table_path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        old = None
    merged = new if old is None else upsert(old.join(new.select("dimension").distinct(), "dimension", "left_semi"), new)
    draft = f"{table_path}/_draft-{uuid.uuid4().hex}"
    merged.write.partitionBy("dimension").parquet(draft)
    spark.read.parquet(draft).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dimension").parquet(table_path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(draft)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def upsert_stream(changes: DataFrame, table_path: str, checkpoint: str, sequence: list[str], interval: str | None = None):
    """Start the stream; without an interval it takes what is there and ends."""
    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: merge_batch(table_path, batch, sequence))
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def changes_per_save(events: DataFrame, seconds: int) -> DataFrame:
    """How many saves a timer would make of change times ``ts`` (bursts within a tick are one), and their sizes."""
    seconds_in = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    tick = F.floor(seconds_in / seconds)
    return events.groupBy(tick.alias("tick")).agg(F.count("*").alias("changes"))
