"""The token stream of plain documents in the byte profile, in row form: one row per document, never one per token.

A document is its separator (line end, marker, line end) and the bytes of its text; the marker opens the document, so a
stream begins with one token that belongs to none, and the last document is one token shorter than its row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import N_RESERVED
from corpusloom.operators.ranking import BUCKETS

_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES += [b for b in range(256) if b not in set(_BYTES)]
#: Token id of each byte: behind the reserved block, by its rank in the byte-level alphabet.
BYTE_ID = np.zeros(256, np.int32)
BYTE_ID[_BYTES] = np.arange(256, dtype=np.int32) + N_RESERVED
SEP_IDS = (int(BYTE_ID[10]), 0, int(BYTE_ID[10]))


def digest(tag: str, *keys: str, seed: int = 42) -> Column:
    """The portable shuffle key of a row."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), *(F.col(k).cast("string") for k in keys)))


def ordered(df: DataFrame, order: Column, value: Column, out: str = "tok_offset", ties: tuple[str, ...] = (), buckets: int = BUCKETS) -> DataFrame:
    """``df`` with its rank and the sum of ``value`` before it, in the order of ``order``, in two phases: totals of at
    most ``buckets`` ranges of the digest, then sums inside each range."""
    staged = df.withColumn("__d", order).withColumn("__v", value.cast("bigint")).withColumn("__b", (F.conv(F.substring("__d", 1, 8), 16, 10).cast("bigint") * buckets / (1 << 32)).cast("int"))
    total = staged.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"), F.sum("__v").alias("__s"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = total.select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__s0"))
    local = Window.partitionBy("__b").orderBy("__d", *ties)
    inner = staged.withColumn("__r", F.row_number().over(local) - 1).withColumn("__c", F.coalesce(F.sum("__v").over(local.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inner.join(base, "__b").select(*df.columns, (F.col("__n0") + F.col("__r")).alias("rank"), (F.col("__s0") + F.col("__c")).alias(out))


def layout(docs: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, n_tokens, rank, tok_offset) of every document of (doc_id, text), in pool order."""
    sized = docs.select("doc_id", (F.octet_length("text") + len(SEP_IDS)).alias("n_tokens"))
    return ordered(sized, digest("pool", "doc_id", seed=seed), F.col("n_tokens"), ties=("doc_id",))


def lengths(laid: DataFrame) -> DataFrame:
    """(doc_id, rank, start, n): where each document's marker stands and how far the next one is."""
    size = laid.agg(F.max("rank").alias("last"))
    return laid.join(F.broadcast(size), how="cross").select("doc_id", "rank", (F.col("tok_offset") + 1).alias("start"), (F.col("n_tokens") - (F.col("rank") == F.col("last")).cast("int")).alias("n"))  # one row


def byte_ids(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): separator and bytes of each text, by table lookup on the Arrow buffer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sep = np.array(SEP_IDS, np.int32)
        for b in batches:
            raw = [t.encode() for t in b.column(text).to_pylist()]
            size = np.fromiter((len(r) for r in raw), np.int64, len(raw)) + len(sep)
            bound = np.concatenate(([0], np.cumsum(size)))
            flat = np.empty(int(bound[-1]), np.int32)
            inner = np.ones(len(flat), bool)
            for i, s in enumerate(sep):
                flat[bound[:-1] + i] = s
                inner[bound[:-1] + i] = False
            flat[inner] = BYTE_ID[np.frombuffer(b"".join(raw), np.uint8)]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(flat))], [key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"{key} bigint, ids array<int>")


def token_histogram(ids: DataFrame) -> DataFrame:
    """(token, n): counted per partition first, so at most a vocabulary of rows leaves each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << 17, np.int64)
        for b in batches:
            n += np.bincount(b.column("ids").flatten().to_numpy(), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["token", "n"])

    return ids.select("ids").mapInArrow(run, "token int, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def sort_by_length(docs: DataFrame) -> DataFrame:
    """(doc_id, n, new_rank, new_start) from (doc_id, rank, start, n): stable by length; ranks of one length are taken
    per range of the old rank, lengths are added up over distinct lengths only."""
    hist = docs.groupBy("n").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    base = hist.select("n", F.coalesce(F.sum("__c").over(w), F.lit(0)).alias("__r0"), F.coalesce(F.sum(F.col("__c") * F.col("n")).over(w), F.lit(0)).alias("__s0"))
    part = docs.withColumn("__p", F.floor(F.col("rank") / 100_000))
    sizes = part.groupBy("n", "__p").agg(F.count(F.lit(1)).alias("__m"))
    prior = sizes.select("n", "__p", F.coalesce(F.sum("__m").over(Window.partitionBy("n").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    local = part.withColumn("__k", F.row_number().over(Window.partitionBy("n", "__p").orderBy("rank")) - 1)
    within = F.col("__b") + F.col("__k")
    return local.join(prior, ["n", "__p"]).join(base, "n").select("doc_id", "n", (F.col("__r0") + within).alias("new_rank"), (F.lit(1) + F.col("__s0") + within * F.col("n")).alias("new_start"))


def length_index(docs: DataFrame, quantiles: int = 128) -> DataFrame:
    """(min_tokens, token_offset, doc_offset) ascending: at every mark, where documents of that length or more begin in
    the sorted stream. Marks: a fixed ladder, document-rank quantiles, and half octaves from its end
    up to the longest. No documents, no marks. Computed on the histogram of lengths."""
    hist = docs.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    spark = docs.sparkSession
    total, longest = hist.agg(F.coalesce(F.sum("c"), F.lit(0)), F.max("n")).first()  # one row
    if not total:
        return spark.createDataFrame([], "min_tokens bigint, token_offset bigint, doc_offset bigint")
    # the length at a rank: the first one, in order of documents up to it, that reaches beyond; ranks stand between lengths
    upto = hist.select(F.sum("c").over(Window.orderBy("n")).alias("at"), F.lit(0).alias("kind"), F.col("n").cast("bigint").alias("n"))
    asked = spark.range(quantiles + 1).select(F.least(F.lit(total - 1), F.floor(F.lit(total) * F.col("id") / quantiles)).cast("bigint").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("n"))
    ahead = F.first("n", ignorenulls=True).over(Window.orderBy("at", "kind").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ranks = upto.unionByName(asked).select("kind", ahead.alias("min_tokens")).where("kind = 1").select("min_tokens")
    fixed = [*LADDER, *(min(longest, int(32768 * 2.0 ** (k / 2))) for k in range(1, 65) if longest > 32768)]
    marks = spark.createDataFrame([(m,) for m in fixed], "min_tokens bigint").union(ranks).distinct()
    # running sums over lengths and marks in one order, a mark in front of its own length
    line = hist.select(F.col("n").cast("bigint").alias("min_tokens"), F.lit(1).alias("kind"), "c").unionByName(marks.select("min_tokens", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("c")))
    before = Window.orderBy("min_tokens", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = line.select("min_tokens", "kind", F.sum(F.col("c") * F.col("min_tokens")).over(before).alias("s"), F.sum("c").over(before).alias("d"))
    return sums.where("kind = 0").select("min_tokens", (F.col("s") + 1).cast("bigint").alias("token_offset"), F.col("d").cast("bigint").alias("doc_offset"))


# The length ladder.
LADDER = (256, 512, 1024, 2048, 3072, 4096, 6144, 8192, 12288, 16384, 24576, 32768)


def windows(docs: DataFrame, laid: DataFrame, block: int) -> DataFrame:
    """(window, tokens): ``block + 1`` tokens of each full window of (doc_id, text). A text meets its place first and is
    encoded and cut there, so that only pieces of windows, two bytes a token, move; a window gathers a bounded number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sep = np.array(SEP_IDS, np.int16)
        table = BYTE_ID.astype(np.int16)
        for b in batches:
            where, at, parts = [], [], []
            for t, off in zip(b.column("text").to_pylist(), b.column("tok_offset").to_pylist()):
                ids = np.concatenate([sep, table[np.frombuffer(t.encode(), np.uint8)]])
                for w in range(max(0, (off - 1) // block), (off + len(ids) - 1) // block + 1):
                    lo, hi = max(w * block, off), min(w * block + block + 1, off + len(ids))
                    if hi > lo:
                        where.append(w), at.append(lo), parts.append(ids[lo - off : hi - off])
            edge = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int16)
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(at, pa.int64()), pa.ListArray.from_arrays(pa.array(edge), pa.array(flat))], ["window", "at", "piece"])

    placed = docs.select("doc_id", "text").join(laid.select("doc_id", "tok_offset"), "doc_id").select("text", "tok_offset")
    pieces = placed.mapInArrow(run, "window bigint, at bigint, piece array<smallint>")
    joined = pieces.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"))
    return joined.select("window", F.flatten(F.transform("p", lambda x: x["piece"])).cast("array<int>").alias("tokens")).where(F.size("tokens") == block + 1)


def _rows(b: pa.RecordBatch, block: int) -> np.ndarray:
    col = b.column("tokens")
    off = col.offsets.to_numpy()
    return col.values.to_numpy()[off[0] : off[-1]].reshape(b.num_rows, block + 1)


def samples(cut: DataFrame, block: int) -> DataFrame:
    """(window, x, y, seg): inputs, next tokens, and the number of markers at or before each input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = _rows(b, block)
            edge = pa.array((np.arange(b.num_rows + 1) * block).astype(np.int32))
            flat = lambda m: pa.ListArray.from_arrays(edge, pa.array(np.ascontiguousarray(m, np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([b.column("window"), flat(t[:, :-1]), flat(t[:, 1:]), flat(np.cumsum(t[:, :-1] == 0, axis=1))], ["window", "x", "y", "seg"])

    return cut.select("window", "tokens").mapInArrow(run, "window bigint, x array<int>, y array<int>, seg array<int>")


def segment_counts(cut: DataFrame, block: int) -> DataFrame:
    """(window, segments, pairs): the last segment id of a window and how many (query, earlier or same token) pairs of
    one segment it has, from the lengths of its segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seg = np.cumsum(_rows(b, block)[:, :-1] == 0, axis=1)
            row = np.repeat(np.arange(b.num_rows), block)
            size = np.bincount(row * (block + 1) + seg.ravel(), minlength=b.num_rows * (block + 1)).reshape(b.num_rows, block + 1)
            last = seg[:, -1] if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("window"), pa.array(last.astype(np.int64)), pa.array((size * (size + 1) // 2).sum(1).astype(np.int64))], ["window", "segments", "pairs"])

    return cut.select("window", "tokens").mapInArrow(run, "window bigint, segments bigint, pairs bigint")


def n_windows(docs: DataFrame, block: int) -> int:
    """Full windows of the stream of (text): an aggregate of one row."""
    n = docs.agg(F.sum(F.octet_length("text") + len(SEP_IDS))).first()[0] or 0
    return max(0, (n - 1) // block)
