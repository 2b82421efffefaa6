"""Streaming last-write-wins registers over a log that grows by files (an extension of the batch engine)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.entries import LOG


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(LOG).parquet(path)


def stream_registers(log: DataFrame) -> DataFrame:
    """The last write of each key so far, kept in the state store; one partial maximum for each key and task is shuffled."""
    last = F.max(F.struct("hlc", "pid", "commit_version", "seq", "value", "deleted")).alias("m")
    return log.groupBy("key").agg(last).select("key", "m.hlc", "m.pid", "m.value", "m.deleted")


def start_registers(log: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    return stream_registers(log).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
