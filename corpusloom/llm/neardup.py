"""The same or nearly the same record in different splits.

Documents of equal words (see ``words``) are one class, and one signature stands for it. Two kinds of shingles are
hashed minwise into banded buckets:

- single words, each with the part of the text it stands in and the number of its occurrence there. A text has one part
  for about ``UNIT`` words, a power of two of them. The rule asks for 80 % of the words in the same order, so changes that
  are spread over a text leave two thirds of these shingles in common (0.8 of 1.2), however they are spread, while
  texts that share only their vocabulary have few, since order counts;
- runs of three words, of which cuts and insertions of whole stretches, which shift the parts, leave most in common.

Only buckets with a training and an evaluation class give candidates. A candidate whose signatures agree too little is
left out (in 240 minima by two bits: 0.42 where 0.6 is expected, four deviations), then the exact Jaccard similarity of
counted words, which the rule bounds from below, and the longest common subsequence decide. Links between classes, with
the members of every class, are the result; ``cross_split_pairs`` expands them to pairs of documents.

A text whose length is near a power of two would have more parts than its partner, so evaluation classes, the smaller
side, also have the shingles of the neighbouring number of parts.

Null texts and texts under ``least`` words are left out, as are rows of another split. Ties and repeated rows of one
document count once. Hot buckets are joined by key, so adaptive execution can split them; nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import encode
from corpusloom.llm.words import Ids, common_in_order, shared
from corpusloom.session import cut

UNIT, MOST = 40, 20  # words of a part, and the power of two of parts at most
WORD_ROWS, WORD_BANDS = 5, 48
RUN, RUN_ROWS, RUN_BANDS = 3, 4, 20
P, R = WORD_ROWS * WORD_BANDS, RUN_ROWS * RUN_BANDS
WORDS_AGREE, RUNS_AGREE = 0.42, 0.4  # estimated similarity of a candidate, in one of the two
_RNG = np.random.default_rng(20240607)
_XOR = _RNG.integers(0, 1 << 32, P + R, dtype=np.uint32)
_MUL = _RNG.integers(0, 1 << 31, P + R, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SMALL = 500_000  # candidate documents up to which their ids are broadcast (8 bytes each); beyond, the join is shuffled


def level(n: float) -> int:
    """The power of two of parts of a text of n words."""
    return min(MOST, max(0, round(math.log2(max(n, 1) / UNIT))))


def levels(n: int, share: float) -> list[int]:
    """The own power and then the others that a partner of n words may have."""
    own = level(n)
    return [own, *sorted({level(n * share), level(n / share)} - {own})]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def placed(ids: np.ndarray, power: int) -> np.ndarray:
    """Hashed words with their part of 2 ** power and their occurrence in it."""
    n = len(ids)
    part = (np.arange(n, dtype=np.uint64) << np.uint64(power)) // np.uint64(n)
    x = np.sort(ids.astype(np.uint64) | part << np.uint64(32))
    at = np.arange(n, dtype=np.uint64)
    first = np.maximum.accumulate(np.where(np.append(True, x[1:] != x[:-1]), at, np.uint64(0)))
    return _mixed(x ^ (at - first) * np.uint64(0xA0761D6478BD642F))


def runs(ids: np.ndarray) -> np.ndarray:
    """Hashed runs of three words."""
    x = ids.astype(np.uint64)
    h = x[: len(x) - RUN + 1].copy()
    for k in range(1, RUN):
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ x[k : len(x) - RUN + 1 + k]
    return _mixed(h)


def minima(sets: list[np.ndarray], lo: int, hi: int, kind: type) -> np.ndarray:
    """(sets, hi - lo): the last bits of each set's minimum under every permutation."""
    flat = np.concatenate(sets)
    start = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), hi - lo), kind)
    for p in range(lo, hi):
        out[:, p - lo] = np.minimum.reduceat((flat ^ _XOR[p]) * _MUL[p], start).astype(kind)
    return out


def signatures(documents: DataFrame, least: int = 20, share: float = 0.8) -> DataFrame:
    """(doc_id, training, n_words, same, words, more, runs): ``same`` is equal for equal words, the others are minima;
    ``more`` is for the other numbers of parts, for evaluation documents only."""
    schema = "doc_id bigint, training boolean, n_words int, same bigint, words binary, more binary, runs binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        number = Ids()
        for whole in batches:
            for b in encode.chunks(whole, "text", 1_000_000):
                doc, ids, train = [], [], []
                for d, t, s in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("split").to_pylist()):
                    x = number(t)
                    if len(x) >= max(least, RUN):
                        doc.append(d), ids.append(x), train.append(s == "train")
                if not doc:
                    continue
                own = minima([placed(x, level(len(x))) for x in ids], 0, P, np.uint8)
                r = minima([runs(x) for x in ids], P, P + R, np.uint16)
                other = [(i, k) for i, x in enumerate(ids) if not train[i] for k in levels(len(x), share)[1:]]
                more = [b""] * len(doc)
                if other:
                    for (i, _), m in zip(other, minima([placed(ids[i], k) for i, k in other], 0, P, np.uint8)):
                        more[i] += m.tobytes()
                same = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in ids], np.uint64).view(np.int64)
                cols = [
                    pa.array(doc, pa.int64()), pa.array(train), pa.array([len(x) for x in ids], pa.int32()), pa.array(same),
                    pa.array([m.tobytes() for m in own], pa.binary()), pa.array(more, pa.binary()), pa.array([m.tobytes() for m in r], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "training", "n_words", "same", "words", "more", "runs"])

    rows = documents.where(F.col("split").isin("train", "val", "test") & F.col("text").isNotNull()).select("doc_id", "text", "split")
    return rows.mapInArrow(run, schema)


def _matrix(col: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(-1, width)


def _keys(evaluation: bool, share: float):
    """Rows (key, same, n_words) of every class: minima of a band, the band, and the power of parts in one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = np.arange(WORD_BANDS, dtype=np.uint64) << np.uint64(41)
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                b = whole.slice(lo, 4096)
                n, same = b.column("n_words").to_numpy(), b.column("same").to_numpy()
                sets = [(np.arange(len(n)), np.array([level(k) for k in n.tolist()], np.uint64), _matrix(b.column("words"), np.uint8, P))]
                if evaluation:
                    power = [levels(k, share)[1:] for k in n.tolist()]
                    sets.append((np.repeat(np.arange(len(n)), [len(p) for p in power]), np.array([k for p in power for k in p], np.uint64), _matrix(b.column("more"), np.uint8, P)))
                made = []
                for row, power, m in sets:
                    key = np.zeros((len(row), WORD_BANDS), np.uint64)
                    for k in range(WORD_ROWS):
                        key |= m[:, k::WORD_ROWS].astype(np.uint64) << np.uint64(8 * k)
                    made.append(((key | band | (power << np.uint64(48))[:, None]).ravel(), np.repeat(row, WORD_BANDS)))
                m = _matrix(b.column("runs"), np.uint16, R)
                key = (np.arange(RUN_BANDS, dtype=np.uint64) + np.uint64(1) << np.uint64(56)) + np.zeros((len(n), 1), np.uint64)
                for k in range(RUN_ROWS):
                    key |= (m[:, k::RUN_ROWS] & np.uint16(0xFFF)).astype(np.uint64) << np.uint64(12 * k)
                made.append((key.ravel(), np.repeat(np.arange(len(n)), RUN_BANDS)))
                key, row = (np.concatenate(x) for x in zip(*made))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(same[row]), pa.array(n[row])], ["key", "same", "n_words"])

    return run


def _bits(m: np.ndarray) -> np.ndarray:
    """Two bits of every minimum, four to a byte."""
    m = (m & 3).astype(np.uint8)
    return m[:, ::4] | m[:, 1::4] << 2 | m[:, 2::4] << 4 | m[:, 3::4] << 6


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size = [len(x) // P for x in b.column("more").to_pylist()]
        own, r = _bits(_matrix(b.column("words"), np.uint8, P)), _bits(_matrix(b.column("runs"), np.uint16, R))
        more, at = _bits(_matrix(b.column("more"), np.uint8, P)), np.concatenate(([0], np.cumsum(size)))
        sketch = [r[i].tobytes() + own[i].tobytes() + more[at[i] : at[i + 1]].tobytes() for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column("same"), b.column("n_words"), pa.array(sketch, pa.binary())], ["same", "n_words", "sketch"])


def _similarity(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    apart = x ^ y
    apart = (apart | apart >> 1) & 0x55
    return (1 - np.bitwise_count(apart).sum(1) / bits - 0.25) / 0.75


def _alike(share: float):
    """Candidates whose signatures agree, for one of the two kinds of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, r = P // 4, R // 4
        for b in batches:
            out = b.select(["same_a", "same_b"])
            if b.num_rows:
                x, y = b.column("sketch_a").to_pylist(), b.column("sketch_b").to_pylist()
                own = [level(n) for n in b.column("n_words_a").to_pylist()]
                at = [levels(n, share).index(k) if k in levels(n, share) else 0 for n, k in zip(b.column("n_words_b").to_pylist(), own)]
                parts = lambda rows: np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
                by_words = _similarity(parts([s[r : r + w] for s in x]), parts([s[r + k * w : r + (k + 1) * w] for s, k in zip(y, at)]), P)
                by_runs = _similarity(parts([s[:r] for s in x]), parts([s[:r] for s in y]), R)
                out = out.filter(pa.array((by_words >= WORDS_AGREE) | (by_runs >= RUNS_AGREE)))
            yield out

    return run


def _numbers(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the wanted documents: picked by broadcast if they are few, else by a shuffled join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Ids()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([number(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], ["doc_id", "ids"])

    side = F.broadcast(wanted) if wanted.count() <= SMALL else wanted
    picked = documents.where(F.col("split").isin("train", "val", "test")).select("doc_id", "text").join(side, "doc_id")
    return picked.mapInArrow(run, "doc_id bigint, ids binary").dropDuplicates(["doc_id"])


def _verify(share: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            jaccard, order = [], []
            for x, y in zip(f["ids_a"], f["ids_b"]):
                a, b = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both, most = shared(a, b), max(len(a), len(b), 1)
                jaccard.append(both / max(1, len(a) + len(b) - both))
                # words in common, in any order, bound the common subsequence
                order.append(common_in_order(a, b) / most if both >= share * most else 0.0)
            out = f[["same_a", "same_b"]].assign(jaccard=jaccard, in_order=order)
            yield out[(out["jaccard"] >= share / (2 - share) - 1e-12) & (out["in_order"] >= share)]

    return run


def cross_split_classes(documents: DataFrame, share: float = 0.8, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """Links (same_a, same_b, jaccard, in_order) from classes with training documents to classes with evaluation
    documents, and the members (doc_id, same, training) of all classes."""
    rows = cut(signatures(documents, least, share))
    side = F.when(F.col("training"), F.lit(1)).otherwise(F.lit(2))
    classes = rows.groupBy("same", "n_words").agg(F.bit_or(side).alias("sides"), F.first("words").alias("words"), F.max("more").alias("more"), F.first("runs").alias("runs"))
    train, held = classes.where("sides & 1 > 0"), classes.where("sides & 2 > 0")
    named = lambda d, s: d.select(*(F.col(c).alias(c if c == "key" else f"{c}_{s}") for c in d.columns))
    key = "key bigint, same bigint, n_words int"
    a, b = named(train.mapInArrow(_keys(False, share), key), "a"), named(held.mapInArrow(_keys(True, share), key), "b")
    near = (F.col("n_words_a") >= share * F.col("n_words_b")) & (F.col("n_words_b") >= share * F.col("n_words_a"))
    met = a.join(b, "key").where(near & (F.col("same_a") != F.col("same_b"))).select("same_a", "same_b").distinct()
    sketch = "same bigint, n_words int, sketch binary"
    close = met.join(named(train.mapInArrow(_sketches, sketch), "a"), "same_a").join(named(held.mapInArrow(_sketches, sketch), "b"), "same_b")
    pairs = cut(close.select("same_a", "n_words_a", "sketch_a", "same_b", "n_words_b", "sketch_b").mapInArrow(_alike(share), "same_a bigint, same_b bigint"))
    first = rows.groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.bit_or(side).alias("sides"))
    wanted = first.join(pairs.select(F.col("same_a").alias("same")).union(pairs.select("same_b")).distinct(), "same").select("same", "doc_id")
    ids = wanted.join(_numbers(documents, wanted.select("doc_id")), "doc_id").select("same", "ids")
    joined = pairs.join(named(ids, "a"), "same_a").join(named(ids, "b"), "same_b").select("same_a", "same_b", "ids_a", "ids_b")
    found = joined.mapInPandas(_verify(share), "same_a bigint, same_b bigint, jaccard double, in_order double")
    equal = first.where("sides = 3").select(F.col("same").alias("same_a"), F.col("same").alias("same_b"), F.lit(1.0).alias("jaccard"), F.lit(1.0).alias("in_order"))
    return found.unionByName(equal), rows.select("doc_id", "same", "training").distinct()


def cross_split_pairs(documents: DataFrame, share: float = 0.8, least: int = 20) -> DataFrame:
    """(train_id, eval_id, jaccard, in_order): every pair of documents over the border between training and evaluation."""
    links, members = cross_split_classes(documents, share, least)
    train = members.where("training").select(F.col("same").alias("same_a"), F.col("doc_id").alias("train_id"))
    held = members.where("not training").select(F.col("same").alias("same_b"), F.col("doc_id").alias("eval_id"))
    return links.join(train, "same_a").join(held, "same_b").select("train_id", "eval_id", "jaccard", "in_order")


def overlap_report(documents: DataFrame, share: float = 0.8, least: int = 20) -> DataFrame:
    """(split, source, pairs, eval_docs, train_docs) of the overlaps, by the evaluation document's split and source.
    Counted on classes; no pair of documents is written out."""
    from corpusloom.llm.mix import clean_source

    links, members = cross_split_classes(documents, share, least)
    about = documents.where("split in ('val', 'test')").select("doc_id", "split", clean_source(F.col("source")).alias("source")).distinct()
    held = members.where("not training").join(about, "doc_id").groupBy(F.col("same").alias("same_b"), "split", "source").agg(F.count(F.lit(1)).alias("n_b"))
    train = members.where("training").groupBy(F.col("same").alias("same_a")).agg(F.count(F.lit(1)).alias("n_a"))
    all_ = links.select("same_a", "same_b").join(train, "same_a").join(held, "same_b")
    of = lambda c, n: all_.groupBy("split", "source", c).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("pairs"), F.first(n).alias(n)).groupBy("split", "source").agg(F.sum("pairs").alias("pairs"), F.sum(n).alias(n))
    b, a = of("same_b", "n_b"), of("same_a", "n_a").drop("pairs")
    joined = b.alias("b").join(a.alias("a"), F.col("b.split").eqNullSafe(F.col("a.split")) & F.col("b.source").eqNullSafe(F.col("a.source")))
    return joined.select("b.split", "b.source", "pairs", F.col("n_b").alias("eval_docs"), F.col("n_a").alias("train_docs"))
