"""Splitting items above a size limit into ordered pieces at natural boundaries.

Sizes are UTF-8 bytes (the byte profile). The atoms of an item are its sentences, or, of a sentence that is no piece by
itself, its words, or the characters of such a word. Adjacent atoms are held in a heap by the strength of the boundary
between them (character, word, sentence, line, paragraph, turn; then the smaller pair, then the earlier one), and the
weakest boundary is merged first as long as the two together, with the overlap, are within the limit; the first piece,
which repeats nothing, has the whole limit. A piece begins with at most the last ``overlap`` bytes of the one before: from
the first word that begins in them, or, if none does, from the first whole code point.

Null texts and null contents have size 0; an item without a limit, or within it, is not split. Where the overlap would
leave no room for a character, the item is cut with the largest overlap that does; ``overlap_used`` reports the one of
each item. Under a limit of less than 4 bytes a code point may be larger than a piece. An item delivered twice is split once.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHAR, WORD, SENTENCE, LINE, PARAGRAPH, TURN = range(6)
_ENDS = re.compile(r"\n[^\S\n]*\n\s*|\n|(?<=[.!?…])[\"'”’)\]]*[^\S\n]+|(?<=[。！？؟।])[」』”]?")
_WORDS = re.compile(r"\s*\S+\s*")


def _atoms(text: str, most: int, first: int) -> list[tuple[int, int]]:
    """(bytes, strength of the boundary behind) of each atom of one turn; the first sentence may have ``first`` bytes."""
    out, begin = [], 0
    stops = [(m.end(), PARAGRAPH if m[0].count("\n") > 1 else LINE if "\n" in m[0] else SENTENCE) for m in _ENDS.finditer(text)]
    for end, kind in [*stops, (len(text), TURN)]:
        if end <= begin:
            continue
        size = len(text[begin:end].encode())
        if size <= (most if out else first):
            out.append((size, kind))
        else:
            words = [m[0] for m in _WORDS.finditer(text[begin:end])] or [text[begin:end]]
            for w in words:
                n = len(w.encode())
                out += [(n, WORD)] if n <= most else [(len(c.encode()), CHAR) for c in w]
                out[-1] = (out[-1][0], WORD)
            out[-1] = (out[-1][0], kind)
        begin = end
    return out


def overlap_for(limit: int, overlap: int) -> int:
    """The overlap, or the largest one that leaves room for a code point."""
    return max(0, min(overlap, limit - 4))


def pieces(turns: list[str], limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(from, to, overlap) in bytes of the joined turns: consecutive pieces, each with the bytes it repeats in front."""
    overlap = overlap_for(limit, overlap)
    most = max(limit - overlap, 1)
    atoms: list[tuple[int, int]] = []
    for t in turns:
        if a := _atoms(t, most, most if atoms else max(limit, 1)):
            atoms += a
            atoms[-1] = (atoms[-1][0], TURN)
    n = len(atoms)
    size, right, left, version = [a[0] for a in atoms], list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
    heap = [(atoms[i][1], size[i] + size[i + 1], i, 0, 0) for i in range(n - 1)]
    heapq.heapify(heap)
    kind, alive = [a[1] for a in atoms], [True] * n
    while heap:
        _, both, i, vi, vj = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j >= n or version[i] != vi or version[j] != vj or both > (most if i else max(limit, 1)):
            continue
        alive[j], size[i], kind[i], right[i] = False, both, kind[j], right[j]
        version[i] += 1
        if right[i] < n:
            k = right[i]
            left[k] = i
            heapq.heappush(heap, (kind[i], size[i] + size[k], i, version[i], version[k]))
        if (h := left[i]) >= 0:
            heapq.heappush(heap, (kind[h], size[h] + size[i], h, version[h], version[i]))
    raw, out, at = "".join(turns).encode(), [], 0
    for i in range(n):
        if alive[i]:
            back = min(overlap, at)
            while back and raw[at - back] & 0xC0 == 0x80:
                back -= 1
            tail = raw[max(0, at - back - 1) : at]
            if back and (m := re.search(rb"\s\S", tail)):  # a word that begins there, the first one also if it begins at once
                back = len(tail) - m.start() - 1
            out.append((at - back, at + size[i], back))
            at += size[i]
    return out


def _split(overlap: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for kind, key, limit, turns in zip(f["item_table"], f["item_id"], f["limit"], f["turns"]):
                turns = [t or "" for t in turns]
                raw, edge = "".join(turns).encode(), [0]
                for t in turns:
                    edge.append(edge[-1] + len(t.encode()))
                for no, (a, b, back) in enumerate(pieces(turns, int(limit), overlap)):
                    first = min(bisect.bisect_right(edge, a) - 1, len(turns) - 1)
                    last = max(bisect.bisect_left(edge, b) - 1, 0)
                    rows.append((kind, key, no, a, b, back, overlap_for(int(limit), overlap), first, last, raw[a:b].decode()))
            yield pd.DataFrame(rows, columns=["item_table", "item_id", "piece", "start", "stop", "overlap", "overlap_used", "first_turn", "last_turn", "text"])

    return run


def oversized(items: DataFrame, specs: DataFrame) -> DataFrame:
    """Items (item_table, item_id, render_spec, turns) larger than the limit of their spec, with it, each once."""
    size = F.aggregate("turns", F.lit(0).cast("bigint"), lambda s, t: s + F.coalesce(F.octet_length(t), F.lit(0)))
    limits = specs.where("max_example_tokens is not null").groupBy(F.col("spec_name").alias("render_spec")).agg(F.min("max_example_tokens").alias("limit"))
    large = items.where(F.col("item_id").isNotNull() & F.col("turns").isNotNull()).withColumn("size", size)
    return large.join(limits, "render_spec").where("size > limit").dropDuplicates(["item_table", "item_id"])


def items_of(documents: DataFrame, conversations: DataFrame) -> DataFrame:
    """Both tables in one form; a document is an item of one turn."""
    d = documents.select(F.lit("documents").alias("item_table"), F.col("doc_id").alias("item_id"), "render_spec", F.array("text").alias("turns"))
    c = conversations.select(F.lit("conversations").alias("item_table"), F.col("conv_id").alias("item_id"), "render_spec", F.transform("messages", lambda m: m["content"]).alias("turns"))
    return d.unionByName(c)


def split_oversized(items: DataFrame, specs: DataFrame, overlap: int = 64) -> DataFrame:
    """(item_table, item_id, piece, start, stop, overlap, overlap_used, first_turn, last_turn, text) of every item above its limit."""
    schema = "item_table string, item_id bigint, piece int, start bigint, stop bigint, overlap int, overlap_used int, first_turn int, last_turn int, text string"
    return oversized(items, specs).select("item_table", "item_id", "limit", "turns").mapInPandas(_split(overlap), schema)


def coverage(pieces: DataFrame, items: DataFrame, specs: DataFrame) -> DataFrame:
    """(item_table, item_id, size, within) of every item that was split: the bytes its pieces hold without what they
    repeat, and whether every piece is within the limit and begins where the one before ends."""
    limits = oversized(items, specs).select("item_table", "item_id", "limit")
    fresh = F.col("start") + F.col("overlap")
    g = pieces.groupBy("item_table", "item_id").agg(F.sum(F.col("stop") - fresh).alias("size"), F.max(F.col("stop") - F.col("start")).alias("most"), F.max("stop").alias("stop"), F.min(fresh).alias("begin"))
    return g.join(limits, ["item_table", "item_id"]).select("item_table", "item_id", "size", ((F.col("most") <= F.col("limit")) & (F.col("size") == F.col("stop")) & (F.col("begin") == 0)).alias("within"))
