"""Chat examples as token arrays, their packed stream, and windows with masked targets, in the byte profile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import packing
from corpusloom.operators.stream import BYTE_ID, digest

# Ids of the marker that opens an example, of a turn's begin and end, and of padding; the masked target.
EOT_ID, BEGIN_ID, END_ID, PAD_ID, MASKED = 0, 1, 2, 3, -100
_LINE = int(BYTE_ID[10])
ARRAYS = "conv_id bigint, chunk bigint, ids array<smallint>, target array<tinyint>, truncated boolean"


def _lists(rows: list[np.ndarray], kind: type) -> pa.ListArray:
    edge = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate(rows).astype(kind) if rows else np.zeros(0, kind)))


def chat_arrays(turns: DataFrame, most: int) -> DataFrame:
    """(conv_id, chunk, ids, target, truncated) of (conv_id, turns): pairs of turns are gathered into an example as long as
    it stays within ``most`` tokens, a longer one is cut there, and left out if nothing to learn is left. An example
    begins at its first token; an odd last turn goes."""
    bytes_ = BYTE_ID.astype(np.int16)

    def message(role: str, content: str) -> tuple[np.ndarray, np.ndarray]:
        r, c = (bytes_[np.frombuffer(t.encode(), np.uint8)] for t in (role, content))
        ids = np.concatenate([[BEGIN_ID], r, [_LINE], c, [END_ID, _LINE]])
        target = np.zeros(len(ids), np.int8)
        if role == "assistant":
            target[len(r) + 2 :] = 1
        return ids, target

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, chunk, ids, target, cut = [], [], [], [], []
            for conv, ts in zip(b.column("conv_id").to_pylist(), b.column("turns").to_pylist()):
                said = [message(t["role"], t["content"]) for t in ts[: len(ts) // 2 * 2]]
                size = np.array([len(a[0]) + len(c[0]) for a, c in zip(said[::2], said[1::2])], np.int64)
                begin, no = 0, 0
                while begin < len(size):
                    fit = int(np.searchsorted(1 + np.cumsum(size[begin:]), most, "right"))
                    end = begin + max(1, fit)
                    x = np.concatenate([[EOT_ID], *(m[0] for m in said[2 * begin : 2 * end])])
                    y = np.concatenate([[0], *(m[1] for m in said[2 * begin : 2 * end])])
                    if len(x) <= most or y[:most].any():
                        key.append(conv), chunk.append(no), ids.append(x[:most]), target.append(y[:most]), cut.append(len(x) > most)
                    begin, no = end, no + 1
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(chunk, pa.int64()), _lists(ids, np.int16), _lists(target, np.int8), pa.array(cut, pa.bool_())], ["conv_id", "chunk", "ids", "target", "truncated"])

    clean = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), T.strip_specials(t["content"]).alias("content")))
    return turns.where("size(turns) >= 2").select("conv_id", clean.alias("turns")).mapInArrow(run, ARRAYS)


def packed(arrays: DataFrame, block: int, seed: int = 42) -> DataFrame:
    """(bin, ids, target, start): whole examples first-fit decreasing in bins of ``block`` tokens, longest first; padding
    behind them begins a segment of its own, and one bin more holds a single pad token, so that the last full bin is a
    whole window. A bin gathers at most ``block`` tokens."""
    sized = arrays.select("conv_id", "chunk", F.size("ids").cast("bigint").alias("n_tokens"))
    order = digest("pack", "conv_id", "chunk", seed=seed)
    bins = packing.ffd_pack(sized, ["conv_id", "chunk"], "n_tokens", order, block)
    rows = bins.withColumn("d", order).join(arrays.select("conv_id", "chunk", "ids", "target"), ["conv_id", "chunk"])
    key = F.struct((-F.col("n_tokens")).alias("n"), "d", "conv_id", "chunk", "ids", "target")
    held = rows.groupBy("bin").agg(F.array_sort(F.collect_list(key)).alias("e"))
    pad = F.lit(block) - F.aggregate("e", F.lit(0), lambda n, x: n + F.size(x["ids"]))
    filled = lambda c, kind, value: F.concat(F.flatten(F.transform("e", lambda x: x[c])), F.array_repeat(F.lit(value).cast(kind), pad.cast("int")))
    first = lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: (i == 1).cast("tinyint"))
    starts = F.concat(F.flatten(F.transform("e", lambda x: first(F.size(x["ids"])))), F.when(pad > 0, first(pad.cast("int"))).otherwise(F.array().cast("array<tinyint>")))
    full = held.select("bin", filled("ids", "smallint", PAD_ID).alias("ids"), filled("target", "tinyint", 0).alias("target"), starts.alias("start"))
    last = bins.agg((F.max("bin") + 1).alias("bin")).where("bin is not null")
    one = lambda v, kind: F.array(F.lit(v).cast(kind))
    return full.unionByName(last.select("bin", one(PAD_ID, "smallint").alias("ids"), one(0, "tinyint").alias("target"), one(1, "tinyint").alias("start")))


def masked_samples(placed: DataFrame, block: int) -> DataFrame:
    """(window, x, y, seg) of a flat stream of (tok_offset, ids, target), a row an example: the next token where it is to be
    learnt, else the mask; what comes before the first example that begins in a window is masked, all of it if none does.
    Segments count the beginnings."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for off, ids, target in zip(b.column("tok_offset").to_pylist(), b.column("ids").to_pylist(), b.column("target").to_pylist()):
                for w in range(max(0, (off - 1) // block), (off + len(ids) - 1) // block + 1):
                    lo, hi = max(w * block, off), min(w * block + block + 1, off + len(ids))
                    if hi > lo:
                        for c, v in zip(out, (w, lo, lo == off, np.array(ids[lo - off : hi - off]), np.array(target[lo - off : hi - off]))):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_()), _lists(out[3], np.int16), _lists(out[4], np.int8)], ["window", "at", "begins", "ids", "target"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where, xs, ys, segs = [], [], [], []
            for w, p in zip(b.column("window").to_pylist(), b.column("p").to_pylist()):
                ids, target = (np.concatenate([x[c] for x in p]) for c in ("ids", "target"))
                if len(ids) != block + 1:
                    continue
                start = np.zeros(block + 1, np.int32)
                start[[x["at"] - w * block for x in p if x["begins"]]] = 1
                start = start[:block]
                head = int(start.argmax()) if start.any() else block
                keep = (target[1:] > 0) & (np.arange(block) >= head)
                where.append(w), xs.append(ids[:-1]), ys.append(np.where(keep, ids[1:], MASKED)), segs.append(np.cumsum(start))
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), *(_lists(c, np.int32) for c in (xs, ys, segs))], ["window", "x", "y", "seg"])

    cut = placed.select("tok_offset", "ids", "target").mapInArrow(pieces, "window bigint, at bigint, begins boolean, ids array<smallint>, target array<tinyint>")
    whole = cut.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("at", "begins", "ids", "target"))).alias("p"))
    return whole.mapInArrow(joined, "window bigint, x array<int>, y array<int>, seg array<int>")
