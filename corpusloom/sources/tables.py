"""Table readers. Every reader is lazy; column pruning and filters reach the Parquet scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "conversations", "rendered_batches", "run_history", "eval_items", "source_specs", "source_parts", "render_specs",
    "common_words",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; a table is a Parquet file or a folder of them."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; one of {', '.join(TABLES)}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_parts(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Explicit list of Parquet shards, never a glob, projected to ``columns``."""
    if not paths:
        raise ValueError("name at least one shard")
    return spark.read.parquet(*paths).select(*columns)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompts of a JSON document ``{"prompts": [...]}`` as rows ``(prompt_no, prompt)``, numbered from 0."""
    doc = spark.read.json(path, multiLine=True)
    return doc.select(F.posexplode("prompts").alias("prompt_no", "prompt"))
