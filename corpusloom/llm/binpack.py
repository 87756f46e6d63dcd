"""Filling bins of fixed capacity with documents measured in tokens.

The whole length histogram (at most ``capacity`` entries, so its size does not grow with the corpus) goes to the driver.
There the configuration linear program is solved by multiplicative weights: large lengths are grouped into classes of
equal count and rounded up, each class has a weight, and each round a knapsack dynamic program prices the best bin
filling under the present weights and lowers the weights of the classes it covers. Nine tenths of each filling's bins, rounded down, get real
lengths dealt into their slots in runs; the rest, with the short lengths held back on purpose, goes by best fit into
what is left open. All of it works on runs (bins from, number of bins, copies of a length in each), whose number is
bounded by rounds and capacity. Executors then turn the rank of an item among items of its length into its bin.

Texts longer than a bin are cut into full bins and a rest. Null and empty texts have size 0 and no bin (null). Ties
among items of one length fall to the digest of the key, then the key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import encode
from corpusloom.operators.ranking import spread_rank
from corpusloom.session import cut


def price(sizes: np.ndarray, values: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """Bounded knapsack by dynamic programming: copies of each size in the filling of greatest value."""
    best, taken = np.zeros(capacity + 1), []
    for j, s in enumerate(sizes):
        left, unit = int(min(most[j], capacity // s)), 1
        while left > 0:
            k = min(unit, left)
            w = int(s) * k
            if w > capacity:
                break
            better = best[: capacity + 1 - w] + values[j] * k
            take = better > best[w:]
            taken.append((j, k, w, take))
            best = best.copy()
            best[w:][take] = better[take]
            left, unit = left - k, unit * 2
    copies, c = np.zeros(len(sizes), np.int64), capacity
    for j, k, w, take in reversed(taken):
        if c >= w and take[c - w]:
            copies[j] += k
            c -= w
    return copies


def fractional(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, eta: float = 0.25) -> list[tuple[np.ndarray, float]]:
    """Multiplicative weights for the configuration program: (filling, number of bins), their total near the optimum."""
    weight, chosen = np.ones(len(sizes)), {}
    for _ in range(rounds):
        a = price(sizes, weight / counts, counts, capacity)
        gain = a / counts
        weight *= np.exp(-eta * gain / gain.max())
        weight /= weight.max()
        chosen[a.tobytes()] = chosen.get(a.tobytes(), 0) + 1
    made = [(np.frombuffer(k, np.int64), n / rounds) for k, n in chosen.items()]
    covered = sum(a * n for a, n in made) / counts
    bins = 1 / np.median(covered[covered > 0])
    return [(a, n * bins) for a, n in made]


class Plan:
    """Bins in runs: (first bin, bins, {length: copies in each})."""

    def __init__(self, histogram: dict[int, int], capacity: int, rounds: int = 300, classes: int = 128, short: int = 8, kept: float = 0.9):
        self.capacity, self.runs, self.next, self.kept = capacity, [], 0, kept
        left = {int(k): int(v) for k, v in histogram.items() if k > 0 and v > 0}
        large = sorted((k for k in left if k > capacity // short), reverse=True)
        if large:
            self._linear(large, left, rounds, classes)
        self._best_fit(left)

    def _open(self, bins: int, fill: dict[int, int]) -> None:
        self.runs.append((self.next, bins, fill))
        self.next += bins

    def _linear(self, large: list[int], left: dict[int, int], rounds: int, classes: int) -> None:
        # linear grouping: classes of about equal count, each rounded up to its largest length
        per, groups, n = sum(left[k] for k in large) / classes, [[]], 0
        for k in large:
            if n >= per * len(groups) and groups[-1]:
                groups.append([])
            groups[-1].append(k)
            n += left[k]
        sizes, counts = np.array([g[0] for g in groups]), np.array([float(sum(left[k] for k in g)) for g in groups])
        for a, bins in sorted(fractional(sizes, counts, self.capacity, rounds), key=lambda x: -x[1]):
            todo = math.floor(bins * self.kept)
            slots = [j for j in np.flatnonzero(a) for _ in range(int(a[j]))]
            while todo > 0:
                # the longest remaining length of each slot's class; the run is as long as all of them last
                fill: dict[int, int] = {}
                for j in slots:
                    k = next((k for k in groups[j] if left[k] > fill.get(k, 0)), None)
                    if k is not None:
                        fill[k] = fill.get(k, 0) + 1
                if sum(fill.values()) < len(slots):  # a class has run out: what is left goes by best fit
                    break
                n = min(todo, *(left[k] // c for k, c in fill.items()))
                for k, c in fill.items():
                    left[k] -= n * c
                self._open(n, fill)
                todo -= n

    def _best_fit(self, left: dict[int, int]) -> None:
        room: dict[int, list[tuple[int, int, dict[int, int]]]] = {}

        def put(first: int, n: int, fill: dict[int, int]) -> None:
            if n:
                room.setdefault(self.capacity - sum(k * c for k, c in fill.items()), []).append((first, n, fill))

        for r in self.runs:
            put(*r)
        for k in sorted(left, reverse=True):
            n = left[k]
            while n:
                at = min((r for r in room if r >= k), default=None)
                if at is None:
                    each = min(n, self.capacity // k)
                    bins = n // each
                    put(self.next, bins, {k: each})
                    self.next += bins
                    n -= bins * each
                    continue
                first, bins, fill = room[at].pop()
                if not room[at]:
                    del room[at]
                each = min(n, at // k)
                use = min(bins, n // each)
                put(first + use, bins - use, fill)
                put(first, use, fill | {k: fill.get(k, 0) + each})
                n -= use * each
        self.runs = sorted(r for rs in room.values() for r in rs)

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For items by length and rank: (length and first rank as one key, first bin, copies in a bin)."""
        seen: dict[int, int] = {}
        rows = []
        for first, bins, fill in self.runs:
            for k, c in fill.items():
                rows.append(((k << 40) + seen.get(k, 0), first, c))
                seen[k] = seen.get(k, 0) + bins * c
        rows.sort()
        return tuple(np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3


def token_sizes(df: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: encode.Vocabulary | None = None) -> DataFrame:
    """(key, size): tokens of each text; nothing but the counts leaves the workers."""
    sent = (vocabulary or encode.Vocabulary(df.sparkSession)).sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encode.encoder(sent)
        for whole in batches:
            for b in encode.chunks(whole, text):
                bound = e.encode(b.column(text).to_pylist())[1]
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(np.diff(bound).astype(np.int64))], [key, "size"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, size bigint")


def fill_bins(sizes: DataFrame, key: str = "doc_id", capacity: int = 2048, rounds: int = 300) -> DataFrame:
    """(key, piece, start, size, bin) from (key, size): every item once, or in pieces if it is larger than a bin."""
    sizes = cut(sizes.select(key, "size"))
    cap = F.lit(capacity)
    pieces = sizes.select(
        key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest((F.col("size") - 1) / cap, F.lit(0)).cast("bigint"))).alias("piece"), F.col("size").alias("whole")
    ).select(key, "piece", (F.col("piece") * cap).alias("start"), F.least(cap, F.col("whole") - F.col("piece") * cap).cast("bigint").alias("size"))
    counted = pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity + 1 rows
    plan = Plan({r["size"]: r["n"] for r in counted}, capacity, rounds)
    sent = sizes.sparkSession.sparkContext.broadcast(plan.segments())
    names = [key, "piece", "start", "size", "bin"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, first, copies = sent.value
        base = code & ((1 << 40) - 1)
        for b in batches:
            size, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("size", "rank"))
            at = np.maximum(np.searchsorted(code, (size << 40) + rank, "right") - 1, 0)
            bin_ = first[at] + (rank - base[at]) // copies[at] if len(code) else np.zeros(len(size), np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-1]), pa.array(bin_, pa.int64(), mask=size == 0)], names)

    ranked = spread_rank(pieces, ["size"], F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("piece").cast("string"))), ties=[key, "piece"])
    kind = sizes.schema[key].dataType.simpleString()
    return ranked.select(*names[:-1], F.col("rank").cast("bigint").alias("rank")).mapInArrow(place, f"`{key}` {kind}, piece bigint, start bigint, size bigint, bin bigint")


def fill_report(bins: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: bins used, tokens, the least number of bins possible by volume, the share of space filled."""
    total = bins.agg(F.countDistinct("bin").alias("bins"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("tokens"))
    return total.select("bins", "tokens", F.ceil(F.col("tokens") / capacity).alias("least_bins"), (F.col("tokens") / (F.col("bins") * capacity)).alias("filled"))


def fill_check(bins: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: items, bins above the capacity, items that have no bin though they have tokens, and whether at most two in
    a hundred bins, and ten, more are used than the volume asks for."""
    load = bins.where("bin is not null").groupBy("bin").agg(F.sum("size").alias("load"))
    full = load.agg(F.count_if(F.col("load") > capacity).alias("overfull"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("load"), F.lit(0)).alias("tokens"))
    items = bins.agg(F.countDistinct("doc_id").alias("items"), F.count_if(F.col("bin").isNull() & (F.col("size") > 0)).alias("lost"))
    return items.crossJoin(F.broadcast(full)).select("items", "overfull", "lost", (F.col("n") <= 1.02 * F.ceil(F.col("tokens") / capacity) + 10).alias("tight"))  # one row each
