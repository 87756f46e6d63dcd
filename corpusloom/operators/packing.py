"""First fit decreasing over a histogram: exact, and on runs of equal bins instead of single ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ranking import spread_rank


def first_fit(histogram: dict[int, int], block: int) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first bin, items in each bin) of runs, as first fit in decreasing length would place them.
    Bins that look alike lie side by side, so their number stays small whatever the number of items."""
    runs, placed, bins = [], [], 0  # a run: first bin, bins, room
    for k in sorted((k for k in histogram if 0 < k <= block), reverse=True):
        left, rank, after = histogram[k], 0, []
        for first, n, room in runs:
            fit = room // k
            if left and fit:
                full = min(n, left // fit)
                if full:
                    placed.append((k, rank, first, fit))
                    after.append((first, full, room - fit * k))
                    rank, left = rank + full * fit, left - full * fit
                if full < n:
                    if left and left < fit:
                        placed.append((k, rank, first + full, left))
                        after.append((first + full, 1, room - left * k))
                        rank, left, full = rank + left, 0, full + 1
                    if full < n:
                        after.append((first + full, n - full, room))
            else:
                after.append((first, n, room))
        fit = block // k
        if left:
            full, rest = divmod(left, fit)
            if full:
                placed.append((k, rank, bins, fit))
                after.append((bins, full, block - fit * k))
            if rest:
                placed.append((k, rank + full * fit, bins + full, rest))
                after.append((bins + full, 1, block - rest * k))
            bins += full + (rest > 0)
        runs = after
    return placed


def ffd_pack(items: DataFrame, keys: list[str], size: str, order: Column, block: int) -> DataFrame:
    """(*keys, size, bin): the histogram (at most ``block`` rows) is packed on the driver, ranks are distributed."""
    fit = items.where((F.col(size) > 0) & (F.col(size) <= block))
    hist = {r[0]: r[1] for r in fit.groupBy(size).count().collect()}
    plan = sorted(((k << 40) + rank, first, each) for k, rank, first, each in first_fit(hist, block))
    sent = items.sparkSession.sparkContext.broadcast(tuple(np.array(c, np.int64) for c in zip(*plan)) if plan else None)
    names = [*keys, size, "bin"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, first, each = sent.value
            n, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (size, "rank"))
            at = np.searchsorted(code, (n << 40) + rank, "right") - 1
            bin_ = first[at] + (rank - (code[at] & ((1 << 40) - 1))) // each[at]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-1]), pa.array(bin_)], names)

    ranked = spread_rank(fit.select(*keys, size), [size], order, ties=keys).select(*keys, size, F.col("rank").cast("bigint").alias("rank"))
    types = dict(items.dtypes)
    return ranked.mapInArrow(place, ", ".join(f"{c} {types[c]}" for c in (*keys, size)) + ", bin bigint")
