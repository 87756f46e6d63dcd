"""Exact ranks without moving a hot group to one task.

A plain ``row_number`` over a key sends every row of the key to one task. Here rows get a bucket from their order hash,
the buckets are counted (pre-aggregated on the map side), running totals over at most ``BUCKETS`` rows per key give each
bucket its offset, and the row number is taken inside (key, bucket) only. A group of 10^11 rows has buckets of 1.5 million
rows, which is what one sort holds; smaller groups have as many buckets as rows at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BUCKETS = 1 << 16


def spread_rank(df: DataFrame, keys: Sequence[str], order: Column, out: str = "rank", ties: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """``df`` with ``out``: the rank, from 0, of each row among the rows of equal ``keys``, ordered by the hexadecimal
    digest ``order`` and then by the ``ties`` columns. Null keys form a group of their own."""
    staged = df.withColumn("__digest", order).withColumn(
        "__bucket", (F.conv(F.substring("__digest", 1, 8), 16, 10).cast("bigint") * F.lit(buckets) / F.lit(1 << 32)).cast("int")
    )
    group = [*keys, "__bucket"]
    counts = staged.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn(
        "__before",
        F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).drop("__n")
    same = Window.partitionBy(*group).orderBy("__digest", *ties)
    local = staged.withColumn("__row", F.row_number().over(same))
    b = before.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__bucket").alias("__kb"), "__before")
    on = F.col("__bucket") == F.col("__kb")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    ranked = local.join(b, on)
    return ranked.withColumn(out, F.col("__before") + F.col("__row") - 1).select(*df.columns, out)
