"""Schedules and window sampling rules."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LR_DEFAULTS = {"steps": 1000, "warmup": 100, "decay_frac": 0.2, "peak": 3e-4, "floor": 0.0}


def lr_schedule(spark: SparkSession, steps: int, warmup: int, decay_frac: float, peak: float, floor: float) -> DataFrame:
    """(step, lr, cosine): warm-up, hold and linear decay over the last part; and a cosine over the same steps."""
    s, start = F.col("step"), steps - int(steps * decay_frac)
    held = F.when(s < warmup, (s + 1) / warmup).when(s < start, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), (F.lit(steps) - s) / max(1, steps - start)))
    cosine = F.lit(0.5) * (1 + F.cos(F.lit(math.pi) * s / steps))
    return spark.range(steps).select(F.col("id").alias("step"), F.round(F.lit(floor) + F.lit(peak - floor) * held, 10).alias("lr")).withColumn("cosine", F.round(F.lit(floor) + F.lit(peak - floor) * cosine, 10))


def band_windows(first: int | None, last: int | None, frac: float, n_windows: int, block: int) -> tuple[int, int] | None:
    """(lo, hi) windows wholly inside a band of tokens, or None without a band. The share and the bound come together;
    a band that holds no whole window can't be drawn from."""
    if not 0 <= frac <= 1:
        raise ValueError("frac lies between 0 and 1")
    if (frac > 0) != (first is not None):
        raise ValueError("a band needs a share and a lower bound, both or neither")
    if first is None:
        return None
    lo, hi = min(n_windows, math.ceil(first / block)), min(n_windows, (last if last is not None else n_windows * block) // block)
    if hi <= lo:
        raise ValueError(f"no window lies inside tokens {first} to {last}")
    return lo, hi
