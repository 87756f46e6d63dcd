"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

``encode_documents`` gives every row once. Null and empty texts have an empty list. The string of a special token inside
a text is ordinary text. Lone surrogates cannot occur in Parquet strings. Clashing names: the operator reads only the two
columns it is told, so any further column is ignored. Very long texts are one row like others; a run without a boundary
(a megabyte of one letter) is merged with a heap in n log n.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import pretokenize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE = 400_000  # distinct slices a worker remembers
LONG = 256  # bytes from which a slice is merged with a heap
NONE = 1 << 60  # the rank of a pair that is no token


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one slice: the pair of lowest rank is merged first, the leftmost of equals."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) >= LONG:
        return _merge_long(piece, ranks)
    cut = list(range(len(piece) + 1))
    rank = [ranks.get(piece[i : i + 2], NONE) for i in cut[:-2]]
    while rank and (best := min(rank)) != NONE:
        at = rank.index(best)
        del cut[at + 1], rank[at]
        if at < len(rank):
            rank[at] = ranks.get(piece[cut[at] : cut[at + 2]], NONE)
        if at:
            rank[at - 1] = ranks.get(piece[cut[at - 1] : cut[at + 1]], NONE)
    return [ranks[piece[a:b]] for a, b in zip(cut, cut[1:])]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(piece)
    end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = bytearray(b"\1" * n)
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        if not alive[i] or (j := right[i]) >= n or end[j] - i != size:
            continue
        alive[j], end[i], right[i] = 0, end[j], right[j]
        if right[i] < n:
            left[right[i]] = i
            if (r := ranks.get(piece[i : end[right[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[right[i]] - i))
        if (h := left[i]) >= 0 and (r := ranks.get(piece[h : end[i]])) is not None:
            heapq.heappush(heap, (r, h, end[i] - h))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes batches of texts; slices already merged are remembered."""

    def __init__(self, ranks: dict[bytes, int], classes: np.ndarray):
        self.ranks, self.classes = ranks, classes
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = array("i")
        self.start = array("q", [0])

    def _keys(self, pieces: list[str]) -> np.ndarray:
        """Where in ``start`` each distinct slice's ids are; slices not seen yet are merged."""
        known, out = self.known, [0] * len(pieces)
        for i, p in enumerate(pieces):
            if (k := known.get(p)) is None:
                self.flat.extend(merge(p.encode(), self.ranks))
                known[p] = k = len(self.start) - 1
                self.start.append(len(self.flat))
            out[i] = k
        return np.array(out, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin and the last end, where each slice's ids begin, the code
        point of its text at which each slice begins)."""
        if len(self.known) > CACHE:
            self._reset()
        full = [t or "" for t in texts]
        size = np.fromiter((len(t) for t in full), np.int64, len(full))
        joined = "\0".join(full) + "\0"
        raw = joined.encode()
        cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        stop = np.cumsum(size + 1) - 1
        cps[stop] = pretokenize.SENTINEL
        begin = pretokenize.boundaries(cps, self.classes)
        last = np.searchsorted(begin, stop)  # the sentinels are boundaries; they are no slices
        # slices lie end to end, so boundaries in bytes make them an Arrow array without a copy
        if len(raw) == len(cps):
            edge = np.append(begin, len(raw)).astype(np.int32)
        else:
            width = 1 + (cps > 0x7F).astype(np.int8) + (cps > 0x7FF) + (cps > 0xFFFF)
            width[stop] = 1
            edge = np.append(0, np.cumsum(width, dtype=np.int32))[np.append(begin, len(cps))].astype(np.int32)
        cells = pa.StringArray.from_buffers(len(begin), pa.py_buffer(edge), pa.py_buffer(raw)).dictionary_encode()
        key = self._keys(cells.dictionary.to_pylist())[cells.indices.to_numpy()]
        real = np.ones(len(begin), bool)
        real[last] = False
        key = key[real]
        start = np.frombuffer(self.start, np.int64)
        count = start[key + 1] - start[key]
        total = np.concatenate(([0], np.cumsum(count)))
        source = np.repeat(start[key] - total[:-1], count) + np.arange(total[-1])
        slices = np.concatenate(([0], last + 1 - np.arange(1, len(full) + 1)))  # slices before each text
        first = begin[real] - np.repeat(np.concatenate(([0], stop[:-1] + 1)), np.diff(slices))
        ids = np.frombuffer(self.flat, np.int32)[source] if self.flat else np.zeros(0, np.int32)
        del start
        return ids, total[slices], total[:-1], first


class Vocabulary:
    """A vocabulary read on the driver and sent to the executors once; its size is that of a public file."""

    def __init__(self, spark: SparkSession, path: str = VOCABULARY):
        self.sent = spark.sparkContext.broadcast((read_ranks(path), pretokenize.class_table()))


_ENCODERS: dict[int, Encoder] = {}


def encoder(sent) -> Encoder:
    """The worker's encoder for a sent vocabulary; workers are reused, so slices stay known over tasks."""
    value = sent.value
    if (e := _ENCODERS.get(id(value[1]))) is None:
        _ENCODERS.clear()
        e = _ENCODERS[id(value[1])] = Encoder(*value)
    return e


def chunks(batch: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes of text each, at least a row."""
    col = batch.column(column)
    size = np.asarray(pc.binary_length(col).fill_null(0), np.int64) if batch.num_rows else np.zeros(0, np.int64)
    group, begin = np.cumsum(size) // most, 0
    for end in [*(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]:
        if end > begin:
            yield batch.slice(begin, end - begin)
        begin = end


def encode_documents(df: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: Vocabulary | None = None, *, offsets: bool = False) -> DataFrame:
    """(key, ids), and with ``offsets`` also ``slice_id`` and ``slice_char``: the index in ids and the code point in the
    text at which each pre-token begins, enough to decode any span."""
    sent = (vocabulary or Vocabulary(df.sparkSession)).sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(sent)
        for whole in batches:
            for b in chunks(whole, text):
                ids, bound, at, char = e.encode(b.column(text).to_pylist())
                cols = [b.column(key), pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(ids))]
                if offsets:
                    n = pa.array(np.searchsorted(at, bound).astype(np.int32))
                    row = np.repeat(bound[:-1], np.diff(np.asarray(n)))
                    cols += [pa.ListArray.from_arrays(n, pa.array((at - row).astype(np.int32))), pa.ListArray.from_arrays(n, pa.array(char.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(cols, names)

    names = [key, "ids"] + (["slice_id", "slice_char"] if offsets else [])
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, ids array<int>" + (", slice_id array<int>, slice_char array<int>" if offsets else "")
    return df.select(key, text).mapInArrow(run, schema)


def decode(ids: list[int], ranks: dict[bytes, int]) -> str:
    back = {v: k for k, v in ranks.items()}
    return b"".join(back[i] for i in ids).decode("utf-8", "replace")
