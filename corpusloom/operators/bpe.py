"""Byte pair encoding trained here: distributed counts, merges over linked token positions, Arrow encoding.

A vocabulary is 256 bytes and one id per merge, in order. Ties between pairs go to the smaller left, then right id.

Distinct chunks lie as tokens in a few arrays. Up to ``LOCAL`` tokens are merged on the driver: every pair knows the places
where it began, a queue of counts gives the next pair, and a merge costs what it changes. More than that stays on the
cluster, in rounds: pairs are counted in every partition, and as many of the most frequent ones as cannot influence each
other are merged at once, until what can still be merged fits the driver. Both give the same merges; no chunk is left out.

Pairs that are certainly never merged are not kept. As many distinct chunks as there are merges, each ``least`` times or
more, need a token each before a pair below ``least`` has its turn; and no pair ever becomes more frequent.
"""

from __future__ import annotations

import heapq
import itertools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import SPACE
from corpusloom.session import cut

CHUNK = rf"{SPACE}*[^\s\x1c-\x1f\x85\p{{Z}}]+|{SPACE}+"
_CHUNK = re.compile(r"\s*\S+|\s+")
LOCAL = 56_000_000  # tokens that are merged on the driver, eight bytes each
SHORT = 64  # bytes of a chunk that is encoded together with others
SHIFT, PART = 20, 21  # bits of a token in a pair's code; of a place in a part that is sorted at once


def chunk_counts(docs: DataFrame) -> DataFrame:
    """(chunk, n): words with the white space before them, counted with a partial count on the map side."""
    return docs.select(F.explode(F.regexp_extract_all("text", F.lit(CHUNK), F.lit(0))).alias("chunk")).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(left, right, n): adjacent bytes inside chunks, overlapping, weighted by the chunk's count. A partition adds up a
    matrix of 256 by 256 and sends what is not zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(65536)
        for b in batches:
            raw = [c.encode() for c in b.column("chunk").to_pylist()]
            size = np.fromiter((len(r) for r in raw), np.int64, len(raw))
            if not size.sum():
                continue
            x = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
            row = np.repeat(np.arange(len(raw)), size)
            inside = row[:-1] == row[1:]
            total += np.bincount((x[:-1] * 256 + x[1:])[inside], b.column("n").to_numpy()[row[:-1][inside]], 65536)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at // 256).astype(np.int32)), pa.array((at % 256).astype(np.int32)), pa.array(total[at].astype(np.int64))], ["left", "right", "n"])

    return chunks.mapInArrow(run, "left int, right int, n bigint").groupBy("left", "right").agg(F.sum("n").alias("n"))


def replaced(flat: np.ndarray, pair: tuple[int, int], new: int) -> np.ndarray:
    """Which positions of a flat token array hold the pair, as ``new``; the token behind is marked -2. Of overlapping
    places (a pair of equal tokens) every second one of a run counts, from its left end."""
    hit = np.flatnonzero((flat[:-1] == pair[0]) & (flat[1:] == pair[1]))
    if pair[0] == pair[1]:
        hit = hit[_every_second(hit)]
    out = flat.copy()
    out[hit], out[hit + 1] = new, -2
    return out


def merged(ids: list[int], pair: tuple[int, int], new: int) -> list[int]:
    """The pair replaced from left to right, without overlap."""
    x = replaced(np.array(ids, np.int64), pair, new) if len(ids) > 1 else np.array(ids, np.int64)
    return x[x != -2].tolist()


def _first(code: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first) if len(first) else np.zeros(0, np.int64)


def _every_second(hit: np.ndarray, wide: int = 1) -> np.ndarray:
    """Of places where a pair of equal tokens lies, every second one of a run, from its left end."""
    run = np.maximum.accumulate(np.where(np.r_[True, np.diff(hit) > wide], np.arange(len(hit)), 0)) if len(hit) else hit
    return (np.arange(len(hit)) - run) % 2 == 0


def _counted(token: np.ndarray, ends: np.ndarray, weights: np.ndarray, border: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By parts of an array: places of pairs, sorted by pair, and of every pair its code, first of its places and count."""
    step = 1 << PART
    for lo in range(0, len(token) - 1, step):
        x, y = token[lo : lo + step], token[lo + 1 : lo + step + 1]
        at = np.flatnonzero((x[: len(y)] != border) & (y != border))
        key = (x[at].astype(np.int64) << SHIFT | y[at]) << PART | at
        key.sort()
        at, code = (key & step - 1) + lo, key >> PART
        first = _first(code)
        yield at, code[first], first, _sums(weights[np.searchsorted(ends, at, "right")], first)


def _added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Codes of all parts, and the sums of the columns beside them."""
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    code, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    out = [np.zeros(len(code), np.int64) for _ in parts[0][1:]]
    for k, x in enumerate(out):
        np.add.at(x, where, np.concatenate([p[k + 1] for p in parts]))
    return code, *out


class _Line:
    """All chunks in one array with a border before, between and behind them. A token stands at the first and the last of
    its places, so the one before place i is at i - 1 and the one behind it is where its size says: no links are kept.
    ``ends`` and ``weights`` say up to which place a chunk counts how often. Pairs of fewer than ``least`` are left out with
    their places: a pair never grows, nor do pairs made from it become more frequent than it is."""

    def __init__(self, token: np.ndarray, ends: np.ndarray, weights: np.ndarray, border: int, least: int):
        self.token, self.ends, self.weights, self.border, self.least = token, ends, weights, border, max(1, least)
        self.size = np.ones(border, np.int32)
        self.total: dict[int, int] = {}
        self.places: dict[int, list[np.ndarray]] = {}
        parts = [(at.astype(np.int32 if len(token) < 1 << 31 else np.int64), *rest) for at, *rest in _counted(token, ends, weights, border)]
        code, total = _added([(p[1], p[3]) for p in parts])[:2]
        self.total = dict(zip(code[total >= self.least].tolist(), total[total >= self.least].tolist()))
        parts.reverse()
        while parts:
            at, code, first, _ = parts.pop()
            for c, lo, hi in zip(code.tolist(), first.tolist(), [*first[1:].tolist(), len(at)]):
                if c in self.total:
                    self.places.setdefault(c, []).append(at[lo:hi].copy())
        self.queue = [(-n, c) for c, n in self.total.items()]
        heapq.heapify(self.queue)

    def _weight(self, at: np.ndarray) -> np.ndarray:
        return self.weights[np.searchsorted(self.ends, at, "right")]

    def best(self) -> int | None:
        while self.queue:
            n, code = self.queue[0]
            now = self.total.get(code, 0)
            if now == -n:
                return code
            heapq.heappop(self.queue)
            if now:
                heapq.heappush(self.queue, (-now, code))
        return None

    def _less(self, left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> None:
        code = left.astype(np.int64) << SHIFT | right
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = _first(code)
        for c, n in zip(code[first].tolist(), _sums(weight[order], first).tolist()):
            if (now := self.total.get(c)) is not None:
                if now - n >= self.least:
                    self.total[c] = now - n
                else:
                    del self.total[c], self.places[c]

    def _more(self, left: np.ndarray, right: np.ndarray, weight: np.ndarray, at: np.ndarray) -> None:
        code = left.astype(np.int64) << SHIFT | right
        order = np.argsort(code, kind="stable")
        code, at = code[order], at[order]
        first = _first(code)
        for c, n, lo, hi in zip(code[first].tolist(), _sums(weight[order], first).tolist(), first.tolist(), [*first[1:].tolist(), len(at)]):
            if n >= self.least:
                self.total[c] = n
                self.places[c] = [at[lo:hi].copy()]
                heapq.heappush(self.queue, (-n, c))

    def join(self, code: int, new: int) -> None:
        a, b = code >> SHIFT, code & (1 << SHIFT) - 1
        token, size, border = self.token, self.size, self.border
        del self.total[code]
        held = self.places.pop(code)
        i = held[0] if len(held) == 1 else np.concatenate(held)
        wide = int(size[a])
        i = i[token[i] == a]
        i = np.sort(i[token[i + wide] == b])
        if a == b:
            i = i[_every_second(i, wide)]
        size[new] = wide + size[b]
        j, k = i + wide, i + int(size[new])
        weight, left, right = self._weight(i), token[i - 1], token[k]
        token[j - 1] = token[j] = border + 1  # no token
        token[i] = token[k - 1] = new
        alone = (left != border) & (token[i - 1] != new)  # beside another new one, that one's right side counts
        inside = right != border
        before, behind = left[alone], right[inside]
        self._less(before, np.full(len(before), a, token.dtype), weight[alone])
        self._less(np.full(len(behind), b, token.dtype), behind, weight[inside])
        self._more(before, np.full(len(before), new, token.dtype), weight[alone], i[alone] - size[before])
        self._more(np.full(len(behind), new, token.dtype), token[k[inside]], weight[inside], i[inside])


def _apart(counted: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Of pairs (count, left, right), most frequent first, those that may be merged in one round: none begins with a token
    that another ends with. A merge then takes nothing from the next ones, and what it makes comes behind the first pair that
    is left out, which it was made from. Of a pair of equal tokens half as many new ones can remain."""
    lefts, rights, floor, out = set(), set(), 0, []
    for n, a, b in sorted(counted, key=lambda p: (-p[0], p[1:])):
        if a in rights or b in lefts or n <= floor:
            break
        out.append((a, b))
        lefts.add(a)
        rights.add(b)
        floor = max(floor, n / 2) if a == b else floor
    return out


def _merge_all(token: np.ndarray, ends: np.ndarray, batch: list[tuple[int, int, int]], border: int) -> tuple[np.ndarray, np.ndarray]:
    """The array with pairs of one round (left, right, new) replaced."""
    left, right = np.zeros(border + 1, bool), np.zeros(border + 1, bool)
    left[[p[0] for p in batch]] = right[[p[1] for p in batch]] = True
    codes, new = map(np.array, zip(*sorted((a << SHIFT | b, c) for a, b, c in batch)))
    hit = np.flatnonzero(left[token[:-1]] & right[token[1:]])
    code = token[hit].astype(np.int64) << SHIFT | token[hit + 1]
    which = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
    good = codes[which] == code
    for a, b, _ in batch:
        if a == b:
            same = np.flatnonzero(good & (code == (a << SHIFT | b)))
            good[same] = _every_second(hit[same])
    hit, which = hit[good], which[good]
    out, keep = token.copy(), np.ones(len(token), bool)
    out[hit], keep[hit + 1] = new[which], False
    return out[keep], ends - np.searchsorted(hit + 1, ends)


def _shrunk(token: np.ndarray, ends: np.ndarray, live: np.ndarray, border: int) -> tuple[np.ndarray, np.ndarray]:
    """The array without tokens that are in no pair of ``live``, and with borders where a pair is in none."""
    code = token[:-1].astype(np.int64) << SHIFT | token[1:]
    held = np.zeros(len(token) + 1, bool)  # the pair that ends at a place, with one more behind
    if len(live):
        held[1:-1] = live[np.minimum(np.searchsorted(live, code), len(live) - 1)] == code
    keep = held[:-1] | held[1:]
    close = held[:-1] & ~held[1:]  # a border follows
    many = keep.astype(np.int8) + close
    keep_at = np.cumsum(many) - many + 1
    out = np.full(int(many.sum()) + 1, border, token.dtype)
    out[keep_at[keep]] = token[keep]
    return out, 1 + np.concatenate([[0], np.cumsum(many)])[ends]


_STATE = "token binary, ends binary, weights binary"


def _unpacked(b: pa.RecordBatch, dtype: type) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for x, e, w in zip(*(b.column(c).to_pylist() for c in ("token", "ends", "weights"))):
        yield np.frombuffer(x, dtype), np.frombuffer(e, np.int64), np.frombuffer(w, np.int64)


def _packed(columns: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in c], pa.binary()) for c in zip(*columns)], names)


def _lines(chunks: DataFrame, border: int, dtype: type) -> DataFrame:
    """Chunks of two bytes and more as arrays of about 4M tokens, with the runs of equal counts and their numbers of chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def made() -> pa.RecordBatch:
            n = np.concatenate([x[2] for x in held])
            ends = 1 + np.cumsum(np.concatenate([x[1] for x in held]))
            last = np.flatnonzero(np.r_[n[1:] != n[:-1], True])
            token = np.concatenate([np.full(1, border, dtype), *(x[0] for x in held)])
            return _packed([(token, ends[last], n[last], np.diff(last, prepend=-1).astype(np.int64))], ["token", "ends", "weights", "rows"])

        for b in batches:
            raw = [c.encode() for c in b.column("chunk").to_pylist()]
            size = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
            if len(raw):
                token = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8).astype(dtype)
                token[np.cumsum(size) - 1] = border
                held.append((token, size, b.column("n").to_numpy()))
            if sum(len(x[0]) for x in held) >= 1 << 22:
                yield made()
                held.clear()
        if held:
            yield made()

    return chunks.sortWithinPartitions("n").mapInArrow(run, f"{_STATE}, rows binary")


def _least(lines: DataFrame, merges: int) -> tuple[int, int]:
    """How many tokens there are, and a count that no pair to be merged is below: that of the chunk whose place by count is
    the number of merges, 1 if there are not so many."""
    total: dict[int, int] = {}
    tokens = 0
    for r in lines.select("weights", "rows", F.octet_length("token").alias("size")).toLocalIterator():
        tokens += r["size"]
        for n, k in zip(np.frombuffer(r["weights"], np.int64).tolist(), np.frombuffer(r["rows"], np.int64).tolist()):
            total[n] = total.get(n, 0) + k
    for n in sorted(total, reverse=True):
        merges -= total[n]
        if merges <= 0:
            return tokens, n
    return tokens, 1


def _train_here(state: DataFrame, tokens: int, out: list[tuple[int, int]], merges: int, border: int, dtype: type, least: int) -> list[tuple[int, int]]:
    """From merge ``len(out)`` on; ``tokens`` is the length of all arrays."""
    token, ends, weights, n = np.full(tokens + 1, border, dtype), [], [], 0
    for r in state.toLocalIterator():
        x = np.frombuffer(r["token"], dtype)
        token[n : n + len(x)] = x
        ends.append(np.frombuffer(r["ends"], np.int64) + n)
        weights.append(np.frombuffer(r["weights"], np.int64))
        n += len(x)
    if not n:
        return out
    line, out = _Line(token[: n + 1], np.concatenate(ends), np.concatenate(weights), border, least), [*out]
    while len(out) < merges and (code := line.best()) is not None:
        line.join(code, 256 + len(out))
        out.append((code >> SHIFT, code & (1 << SHIFT) - 1))
    return out


def _train_apart(state: DataFrame, merges: int, border: int, dtype: type, least: int, local: int, wide: int = 1000, keep: int = 8) -> tuple[DataFrame, int, list[tuple[int, int]]]:
    """Rounds on the cluster, until what can still be merged has ``local`` tokens or fewer. A round's merges are applied
    where the arrays lie; every ``keep`` rounds they are written, without the tokens that no merge can reach any more."""

    def counted(batches: list[list[tuple[int, int, int]]]):
        def run(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: list[tuple[np.ndarray, ...]] = []
            for b in data:
                for token, ends, weights in _unpacked(b, dtype):
                    for batch in batches:
                        token, ends = _merge_all(token, ends, batch, border)
                    parts += [(code, n, np.diff(first, append=len(at))) for at, code, first, n in _counted(token, ends, weights, border)]
                    parts = [_added(parts)]
            code, n, places = _added(parts)
            for lo in range(0, len(code), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 100_000]) for x in (code, n, places)], ["code", "n", "places"])

        return state.mapInArrow(run, "code bigint, n bigint, places bigint").groupBy("code").agg(F.sum("n").alias("n"), F.sum("places").alias("places")).where(F.col("n") >= least)

    def written(batches: list[list[tuple[int, int, int]]], live: np.ndarray) -> DataFrame:
        sent = state.sparkSession.sparkContext.broadcast(live)

        def run(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in data:
                for token, ends, weights in _unpacked(b, dtype):
                    for batch in batches:
                        token, ends = _merge_all(token, ends, batch, border)
                    token, ends = _shrunk(token, ends, sent.value, border)
                    yield _packed([(token, ends, weights)], ["token", "ends", "weights"])

        return cut(state.mapInArrow(run, _STATE))

    out, batches = [], []
    while len(out) < merges:
        top = counted(batches).orderBy(F.desc("n"), "code").limit(wide).collect()
        batch = _apart([(r["n"], r["code"] >> SHIFT, r["code"] & (1 << SHIFT) - 1) for r in top])[: merges - len(out)]
        if not batch:
            break
        batches.append([(a, b, 256 + len(out) + k) for k, (a, b) in enumerate(batch)])
        out += batch
        if len(batches) >= keep:
            live = np.sort(np.array([r["code"] for r in counted(batches).select("code").toLocalIterator()], np.int64))
            state, batches = written(batches, live), []
            tokens = (state.agg(F.sum(F.octet_length("token"))).first()[0] or 0) // np.dtype(dtype).itemsize
            if tokens <= local:
                return state, tokens, out
    return state.limit(0), 0, out


def train(chunks: DataFrame, merges: int, local: int = LOCAL) -> list[tuple[int, int]]:
    """The merges, most frequent pair first, until there are ``merges`` or no pair is left. Chunks are distinct; null ones
    don't count."""
    border = 256 + merges
    if border + 2 > 1 << SHIFT:
        raise ValueError(f"more than {(1 << SHIFT) - 258} merges")
    dtype = np.uint16 if border + 2 <= 1 << 16 else np.uint32
    lines = cut(_lines(chunks.where("chunk is not null and n > 0 and octet_length(chunk) > 1").select("chunk", F.col("n").cast("bigint")), border, dtype))
    size, least = _least(lines, merges)
    state, tokens, out = lines.drop("rows"), size // np.dtype(dtype).itemsize, []
    if tokens > local:
        state, tokens, out = _train_apart(state, merges, border, dtype, least, local)
    return _train_here(state, tokens, out, merges, border, dtype, least) if tokens else out


def merges_table(spark: SparkSession, merges: list[tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame([(i, a, b, 256 + i) for i, (a, b) in enumerate(merges)], "rank int, left int, right int, new_id int")


def encode_chunk(chunk: bytes, made: dict[tuple[int, int], int]) -> list[int]:
    """Ids of a chunk: the applicable merge of lowest id first, the leftmost place of equals."""
    ids, size = list(chunk), len(chunk)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    queue = [(new, i) for i in range(size - 1) if (new := made.get((ids[i], ids[i + 1]))) is not None]
    heapq.heapify(queue)
    while queue:
        new, i = heapq.heappop(queue)
        j = after[i]
        if ids[i] < 0 or j >= size or made.get((ids[i], ids[j])) != new:
            continue
        k, h = after[j], before[i]
        ids[i], ids[j], after[i] = new, -1, k
        if k < size:
            before[k] = i
            if (x := made.get((new, ids[k]))) is not None:
                heapq.heappush(queue, (x, i))
        if h >= 0 and (x := made.get((ids[h], new))) is not None:
            heapq.heappush(queue, (x, h))
    return [x for x in ids if x >= 0]


def encode_chunks(chunks: list[bytes], made: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all chunks in one array, and how many each has. In every round each chunk's lowest merge is made at all of its
    places: a pair with the new token in it is of a higher merge. Chunks of more than ``SHORT`` bytes are encoded alone."""
    none = np.iinfo(np.int64).max
    codes = np.append(np.array(list(made), np.int64).reshape(-1, 2) @ (1 << 32, 1), none)  # the last is behind all pairs
    order = np.argsort(codes)
    codes, ids = codes[order], np.append(np.array(list(made.values()), np.int64), none)[order]

    def merge_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left << 32 | right
        at = np.searchsorted(codes, code)
        return np.where(codes[at] == code, ids[at], none)

    rows, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(chunks), 20_000):
        raw = chunks[lo : lo + 20_000]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        for i in np.flatnonzero(size > SHORT).tolist():
            x = encode_chunk(raw[i], made)
            rows.append(np.full(len(x), lo + i))
            tokens.append(np.array(x, np.int64))
        row = np.repeat(np.arange(lo, lo + len(raw)), np.where(size > SHORT, 0, size))
        token = np.frombuffer(b"".join([c for c in raw if len(c) <= SHORT]), np.uint8).astype(np.int64)
        new = np.full(len(token), none)
        new[:-1] = np.where(row[:-1] == row[1:], merge_of(token[:-1], token[1:]), none)
        while len(token):
            first = _first(row)
            low = np.repeat(np.minimum.reduceat(new, first), np.diff(first, append=len(row)))
            live = low < none
            rows.append(row[~live])
            tokens.append(token[~live])
            row, token, new, low = row[live], token[live], new[live], low[live]
            hit = np.flatnonzero(new == low)
            hit = hit[_every_second(hit)]
            token[hit] = low[hit]
            keep = np.ones(len(token), bool)
            keep[hit + 1] = False
            row, token, new = row[keep], token[keep], new[keep]
            hit -= np.arange(len(hit))
            for i in (hit, hit[hit > 0] - 1):
                j = np.minimum(i + 1, len(row) - 1)
                new[i] = np.where((j > i) & (row[i] == row[j]), merge_of(token[i], token[j]), none)
    row = np.concatenate(rows)
    return np.concatenate(tokens)[np.argsort(row, kind="stable")].astype(np.int32), np.bincount(row, minlength=len(chunks)).astype(np.int32)


class _Numbers(dict):
    """Every chunk's number, in the order in which they come."""

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        return n


class _Encoder:
    """Encodes each chunk once, until it has met 500,000 of them."""

    def __init__(self, made: dict[tuple[int, int], int]):
        self.made = made
        self._clear()

    def _clear(self) -> None:
        self.known, self.flat, self.size = _Numbers(), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def lists(self, texts: pa.Array) -> pa.Array:
        """The ids of every text; a null one has none."""
        if len(self.known) > 500_000:
            self._clear()
        which, ends = array("i"), [0]
        for t in texts:
            which.extend(map(self.known.__getitem__, _CHUNK.findall(t.as_py() or "")))
            ends.append(len(which))
        fresh = [c.encode() for c in itertools.islice(self.known, len(self.size), None)]
        flat, size = encode_chunks(fresh, self.made)
        self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        at = np.frombuffer(which, np.int32)
        n = self.size[at]
        to = np.cumsum(n, dtype=np.int32)
        begin = np.cumsum(self.size, dtype=np.int32) - self.size
        where = np.repeat(begin[at] - (to - n), n)
        where += np.arange(len(where), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(np.append(np.zeros(1, np.int32), to)[ends]), pa.array(self.flat[where]))


def _few(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batches in slices, for what is held beside them grows with their rows."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def encode(docs: DataFrame, merges: list[tuple[int, int]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids); a worker encodes each chunk once. The merges, bounded by the vocabulary's size, are sent to the workers."""
    sent = docs.sparkSession.sparkContext.broadcast({p: 256 + i for i, p in enumerate(merges)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(sent.value)
        for b in _few(batches):
            yield pa.RecordBatch.from_arrays([b.column(key), encoder.lists(b.column(text))], [key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"{key} bigint, ids array<int>")


def vocabulary(merges: list[tuple[int, int]]) -> list[bytes]:
    out = [bytes([i]) for i in range(256)]
    for a, b in merges:
        out.append(out[a] + out[b])
    return out


def texts(ids: pa.ListArray, vocab: pa.LargeBinaryArray) -> pa.Array:
    """The texts of lists of ids: the bytes of all lie in one buffer, of which every text is a stretch."""
    taken = vocab.take(ids.flatten())
    _, at, data = taken.buffers()
    at = np.frombuffer(at, np.int64)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
    rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(at[ends].copy()), data or pa.py_buffer(b"")])
    try:
        return rows.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:  # no UTF-8
        return pa.array([x.as_py().decode("utf-8", "replace") for x in rows], pa.string())


def decode(ids: DataFrame, merges: list[tuple[int, int]], key: str = "doc_id") -> DataFrame:
    """(key, text): bytes of the ids, with a replacement mark where they are no UTF-8."""
    sent = ids.sparkSession.sparkContext.broadcast(vocabulary(merges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pa.array(sent.value, pa.large_binary())
        for b in _few(batches):
            yield pa.RecordBatch.from_arrays([b.column(key), texts(b.column("ids"), vocab)], [key, "text"])

    return ids.select(key, "ids").mapInArrow(run, f"{key} bigint, text string")
