"""Incremental ingest with Structured Streaming: late rows, repeated deliveries, running counters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import ensure_checkpoint_dir
from corpusloom.sources import table


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as an unbounded one; its schema is that of the batch table, never inferred again."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip(chr(47))}/{name}.parque[t]")  # a pattern, so that a single file will do


def once(df: DataFrame, mode: str = "complete") -> DataFrame:
    """What a stream amounts to after all that is there now; for results of bounded size, such as counters."""
    spark, name = df.sparkSession, f"stream_{uuid.uuid4().hex}"
    at = f"{ensure_checkpoint_dir(spark)}/{name}"
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", at).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def once_to_files(df: DataFrame) -> DataFrame:
    """What a stream appends of all that is there now, written as files in the shared folder and read from there, for
    results that grow with the input."""
    spark, name = df.sparkSession, f"stream_{uuid.uuid4().hex}"
    at = f"{ensure_checkpoint_dir(spark)}/{name}"
    q = df.writeStream.outputMode("append").format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/rows")


def first_deliveries(conversations: DataFrame, late: str) -> DataFrame:
    """Every conversation once; what was seen is kept as state until the watermark, ``late`` behind the newest row, has
    passed it, so ``late`` bounds the state and is the caller's to choose."""
    return conversations.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["conv_id"])


def part_counters(conversations: DataFrame) -> DataFrame:
    """(part_split, n_conversations, n_messages) so far."""
    return conversations.groupBy("part_split").agg(F.count(F.lit(1)).alias("n_conversations"), F.sum(F.greatest(F.lit(0), F.coalesce(F.size("messages"), F.lit(0)))).alias("n_messages"))


def document_counters(documents: DataFrame, late: str, every: str = "7 days") -> DataFrame:
    """(week, n_docs, n_bytes) by the time of loading, in tumbling windows; late rows count in their own window."""
    w = documents.where("loaded_at is not null").withWatermark("loaded_at", late).groupBy(F.window("loaded_at", every).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n_bytes")).select(F.col("w.start").alias("week"), "n_docs", "n_bytes")
