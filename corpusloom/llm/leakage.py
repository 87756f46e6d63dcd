"""Held-out questions inside training documents, by latent semantic retrieval.

The words of the questions and answers are the vocabulary; a document becomes the numbers of its words in it. Document
frequencies are counted over the whole corpus. A randomised singular value decomposition of the TF-IDF passage matrix is
computed in distributed passes (each partition adds up its part of A'(A X), a vocabulary times rank numbers), fitted on
the passages of at most ``fit_documents`` documents, taken by a digest of their id. Then every passage of every document
is projected, half whitened and compared by cosine with windows of the questions: a stated query set against all rows, in
blocks. A window is at most half of its question, so that a question of which half stands in a text has a window that
stands there as a whole; windows of questions under 24 words are compared with passages of half the size.

Around a found passage, word pairs in common near one offset leave the places that can hold half of the question; an
alignment decides: a local one in which a match counts 1 and an exchanged, missing or added word -2, and whose matched
words are at least half of the question's (``how`` is 'stretch'). A place without such a stretch is a 'paraphrase' if
six tenths of the question's words stand in it in order (longest common subsequence) and the answer's words do as well.
Items with the same question share one search and count each. Items are searched in parts of about ``part_words`` words,
which bounds what is sent to the workers.

Documents of another split and null or blank texts are left out. A question without words leaks nowhere. Any further
columns are ignored; a repeated document row counts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import encode
from corpusloom.llm.words import common_in_order, words
from corpusloom.session import cut

BLOCK, RANK = 12, 224
COLUMNS = 8192  # columns of the passage matrix at most; words of a larger vocabulary share them
COSINE = 0.5
SCHEMA = "doc_id bigint, item_id bigint, dataset_name string, matched double, how string, answer_present boolean"


def numbered(documents: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, ids): the numbers of the words of every training document, the vocabulary's size for any other word."""
    small = len(vocabulary) < 1 << 15
    sent, other = documents.sparkSession.sparkContext.broadcast(vocabulary), len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        for whole in batches:
            for b in encode.chunks(whole, "text"):
                ids = [[get(w, other) for w in words(t)] for t in b.column("text").to_pylist()]
                bound = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.fromiter((k for x in ids for k in x), np.int16 if small else np.int32, int(bound[-1]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(bound), pa.array(flat))], ["doc_id", "ids"])

    return documents.where("split = 'train' and text is not null").select("doc_id", "text").mapInArrow(run, f"doc_id bigint, ids array<{'smallint' if small else 'int'}>")


def _lists(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    col = b.column("ids")
    off = col.offsets.to_numpy()
    return col.values.to_numpy()[off[0] : off[-1]].astype(np.int32), (off - off[0]).astype(np.int64)


def _blocks(flat: np.ndarray, off: np.ndarray, other: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers of each block, padded with ``other``; number of blocks of each document)."""
    size = np.diff(off)
    n = -(-size // block)
    row = np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), size)
    at = np.arange(len(flat)) - np.repeat(off[:-1], size)
    out = np.full((int(n.sum()), block), other, np.int32)
    out[row + at // block, at % block] = flat
    return out, n


def frequencies(docs: DataFrame, other: int) -> tuple[int, np.ndarray]:
    """(documents, document frequency of each word of the vocabulary): its size bounds what reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(other + 1, np.int64), 0
        for b in batches:
            flat, off = _lists(b)
            doc = np.repeat(np.arange(b.num_rows, dtype=np.int64), np.diff(off))
            df += np.bincount(np.unique(doc * (other + 1) + flat) % (other + 1), minlength=other + 1)
            n += b.num_rows
        df[other] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["word", "n"])

    got = docs.mapInArrow(run, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(other + 1, np.int64)
    df[got["word"].to_numpy()] = got["n"].to_numpy()
    return int(df[other]), df[:other]


def _gather(blocks: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sums of the table's rows over each block's words."""
    out = np.zeros((len(blocks), table.shape[1]), np.float32)
    for i in range(0, len(blocks), 2048):
        for col in blocks[i : i + 2048].T:
            out[i : i + 2048] += table[col]
    return out


def _normal(spark: SparkSession, docs: DataFrame, x: np.ndarray, other: int) -> tuple[np.ndarray, np.ndarray]:
    """(A'AX, (AX)'(AX)) for the block matrix A of ``docs`` (word weights are in X)."""
    sent, k = spark.sparkContext.broadcast(x.astype(np.float32)), x.shape[1]
    step = 512

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, g, table = np.zeros((other + 1, k), np.float32), np.zeros((k, k)), sent.value
        for b in batches:
            blocks, _ = _blocks(*_lists(b), other, BLOCK)
            if not len(blocks):
                continue
            y = _gather(blocks, table)
            g += y.T @ y
            flat = blocks.ravel()
            order = np.argsort(flat, kind="stable")
            order = order[: np.searchsorted(flat[order], other)]
            word, row = flat[order], order // BLOCK
            if not len(word):
                continue
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            edge = np.append(first, len(word))
            for c in range(0, len(first), 256):
                d = min(c + 256, len(first))
                z[word[first[c:d]]] += np.add.reduceat(y[row[edge[c] : edge[d]]], first[c:d] - edge[c], axis=0)
        rows = [(i, z[i : i + step].tobytes()) for i in range(0, other, step)] + [(-1, g.tobytes())]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "sums"])

    def add(f: pd.DataFrame) -> pd.DataFrame:
        kind = np.float64 if f["part"].iloc[0] < 0 else np.float32
        total = reduce(np.add, (np.frombuffer(s, kind).astype(np.float64) for s in f["sums"]))
        return pd.DataFrame({"part": f["part"].iloc[:1], "sums": [total.tobytes()]})

    got = {r["part"]: np.frombuffer(r["sums"]) for r in docs.mapInArrow(run, "part int, sums binary").groupBy("part").applyInPandas(add, "part int, sums binary").toLocalIterator()}
    sent.destroy()
    z = np.zeros((other + 1, k))
    for i, s in got.items():
        if i >= 0:
            z[i : i + step] = s.reshape(-1, k)[: len(z) - i]
    z[other] = 0
    return z, got[-1].reshape(k, k) if -1 in got else np.zeros((k, k))


def latent_space(docs: DataFrame, n: int, df: np.ndarray, fit_documents: int = 5_000, rank: int = RANK) -> np.ndarray:
    """Half-whitened projection of the vocabulary's words and, as a row of zeros, of any other, by a randomised range finder
    with one power step. The sample of documents is written once, in eight parts."""
    spark, other = docs.sparkSession, len(df)
    column = np.arange(other) % COLUMNS
    idf = np.append(np.where(df > 0, np.log((n + 1) / (df + 1)) + 0.1, 0), 0)[:, None]  # what stands in no document says nothing
    share = min(1.0, fit_documents / max(n, 1))
    sample = docs if share >= 1 else docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = cut(sample.repartition(8))
    x = np.random.default_rng(7).standard_normal((min(other, COLUMNS), min(rank + 8, max(1, other))))

    def spread(x: np.ndarray) -> np.ndarray:
        return np.vstack([x[column], np.zeros((1, x.shape[1]))]) * idf

    def folded(z: np.ndarray) -> np.ndarray:
        out = np.zeros((min(other, COLUMNS), z.shape[1]))
        np.add.at(out, column, (z * idf)[:-1])
        return out

    for _ in range(2):
        z, _ = _normal(spark, sample, spread(x), other)
        x, _ = np.linalg.qr(folded(z))
    _, g = _normal(spark, sample, spread(x), other)
    value, vector = np.linalg.eigh(g)
    value, vector = value[::-1][:rank], vector[:, ::-1][:, :rank]
    return (spread(x @ vector) / (value + 0.05 * value[0] + 1e-9) ** 0.25).astype(np.float32)  # half whitened; directions hardly seen in the sample are damped


class Question:
    """A question's words, and its word pairs sorted for lookup."""

    def __init__(self, ids: np.ndarray, other: int):
        self.ids, self.other = ids, other
        code = ids[:-1].astype(np.int64) * (other + 1) + ids[1:]
        self.order = np.argsort(code, kind="stable")
        self.pairs = code[self.order]

    def place(self, text: np.ndarray, around: int = 4) -> tuple[int, int]:
        """(offset of the text's words to the question's near which most word pairs are equal, how many are)."""
        code = text[:-1].astype(np.int64) * (self.other + 1) + text[1:]
        lo, hi = np.searchsorted(self.pairs, code, "left"), np.searchsorted(self.pairs, code, "right")
        n = hi - lo
        if not (total := int(n.sum())):
            return 0, 0
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(total)
        shift = len(self.ids) + around
        count = np.bincount(np.repeat(np.arange(len(code)), n) - self.order[at] + shift, minlength=len(text) + shift + around + 1)
        sums = np.concatenate(([0], np.cumsum(count)))
        near = sums[2 * around + 1 :] - sums[: -2 * around - 1]
        best = int(near.argmax())
        return best + around - shift, int(near[best])


class Places:
    """``Question.place`` for many passages of one array at once. The pairs of all questions are numbered, those of the array
    are looked up once, and only those that some question has are compared."""

    def __init__(self, questions: list[Question], other: int):
        self.other, self.size = other, np.array([len(q.ids) for q in questions], np.int64)
        code = np.concatenate([q.pairs for q in questions])
        which = np.repeat(np.arange(len(questions), dtype=np.int64), [len(q.pairs) for q in questions])
        self.pairs, number = np.unique(code, return_inverse=True)
        key = which * len(self.pairs) + number  # ascending: a question's pairs are sorted
        self.at = np.concatenate([q.order for q in questions])
        self.keys, self.first, self.n = np.unique(key, return_index=True, return_counts=True)
        self.most = np.ones(len(questions), np.int64)  # places of a pair in a question
        if len(self.pairs):
            np.maximum.at(self.most, self.keys // len(self.pairs), self.n)

    def __call__(self, flat: np.ndarray, which: np.ndarray, lo: np.ndarray, hi: np.ndarray, around: int = 4, cells: int = 1 << 20) -> list[tuple[int, int]]:
        """``place`` of the words from ``lo`` to ``hi`` for the question ``which``, of each; about ``cells`` comparisons at a time."""
        if not len(self.pairs):
            return [(0, 0)] * len(which)
        code = flat[:-1].astype(np.int64) * (self.other + 1) + flat[1:]
        number = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        seen = np.flatnonzero(self.pairs[number] == code)
        number = number[seen]
        width = hi - lo + self.size[which] + 2 * around + 1
        work = width * self.most[which]
        part = (np.cumsum(work) - work) // cells
        out: list[tuple[int, int]] = []
        for a, b in zip(edge := np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), [*edge[1:], len(part)]):
            out += self._some(seen, number, which[a:b], lo[a:b], hi[a:b], width[a:b], around)
        return out

    def _some(self, seen: np.ndarray, number: np.ndarray, which: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: np.ndarray, around: int) -> list[tuple[int, int]]:
        c, i = _ranges(np.searchsorted(seen, lo), np.searchsorted(seen, np.maximum(lo, hi - 1)))
        key = which[c] * len(self.pairs) + number[i]
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        good = np.flatnonzero(self.keys[k] == key)
        c, i, k = c[good], i[good], k[good]
        m, at = _ranges(self.first[k], self.first[k] + self.n[k])
        c, i = c[m], i[m]
        shift, base = self.size[which] + around, np.cumsum(width) - width
        count = np.bincount(seen[i] - lo[c] - self.at[at] + shift[c] + base[c], minlength=int(width.sum()))
        sums = np.concatenate(([0], np.cumsum(count), np.full(2 * around, len(at))))
        near = sums[2 * around + 1 :] - sums[: -2 * around - 1]
        near[(base + width)[:, None] - 1 - np.arange(2 * around)] = -1  # they reach into the next passage
        most = np.maximum.reduceat(near, base)
        top = np.flatnonzero(near == np.repeat(most, width))
        best = top[np.searchsorted(top, base)] - base + around - shift
        return list(zip(np.where(most > 0, best, 0).tolist(), most.tolist()))


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges, one after another: (number of the range, value)."""
    n = np.maximum(hi - lo, 0)
    return np.repeat(np.arange(len(n)), n), np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


class Scale:
    """Windows of questions of like length, and the block size of the passages they are compared with."""

    def __init__(self, questions: list[np.ndarray], which: list[int], block: int, other: int):
        self.block, wins, owner = block, [], []
        for i in which:
            x = questions[i]
            w = min(2 * block, max(min(block, 12) if block == BLOCK else 1, len(x) // 2))
            for s in sorted({*range(0, max(1, len(x) - w + 1), max(1, w // 3)), max(0, len(x) - w)}):
                wins.append(x[s : s + w])
                owner.append(i)
        self.wins = np.full((len(wins), 2 * block), other, np.int32)
        for i, w in enumerate(wins):
            self.wins[i, : len(w)] = w
        self.owner = np.array(owner, np.int64)
        size = np.array([len(w) for w in wins], float)
        self.least = np.minimum(COSINE, 0.8 * np.sqrt(size / (2 * block))).astype(np.float32)


def candidates(scale: Scale, q: np.ndarray, space: np.ndarray, flat: np.ndarray, off: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
    """(document, question) -> (first, last) word of the passages whose cosine with a window of the question is high."""
    other = len(space) - 1
    blocks, count = _blocks(flat, off, other, scale.block)
    if not len(blocks):
        return {}
    doc = np.repeat(np.arange(len(off) - 1), count)
    start = (np.arange(len(blocks)) - np.repeat(np.cumsum(count) - count, count)) * scale.block
    e = _gather(blocks, space)
    same = np.append(doc[1:] == doc[:-1], False)
    e[:-1][same[:-1]] += e[1:][same[:-1]]
    norm = np.linalg.norm(e, axis=1)
    some = np.flatnonzero(norm > 1e-6)
    e = e[some] / norm[some, None]
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for i in range(0, len(e), 1024):
        hit = np.flatnonzero((e[i : i + 1024] @ q >= scale.least).ravel())
        p, w = some[hit // q.shape[1] + i], hit % q.shape[1]
        for d, o, s in zip(doc[p].tolist(), scale.owner[w].tolist(), start[p].tolist()):
            lo, hi = found.get((d, o), (s, s))
            found[d, o] = min(lo, s), max(hi, s)
    return found


def align(q: np.ndarray, d: np.ndarray) -> int:
    """Most matched words of a local alignment of q with d: match 1, exchanged, missing or added word -2."""
    return aligned([(q, d)])[0]


def aligned(pairs: list[tuple[np.ndarray, np.ndarray]], cells: int = 1 << 14) -> list[int]:
    """``align`` of each pair; those of like length go side by side, filled up with words that match nothing."""
    out, by_size = [0] * len(pairs), sorted(range(len(pairs)), key=lambda k: (len(pairs[k][1]), len(pairs[k][0])))
    while by_size:
        some, wide = [by_size.pop()], 0
        wide = len(pairs[some[0]][0])
        while by_size and (len(some) + 1) * max(wide, len(pairs[by_size[-1]][0])) <= cells:
            some.append(by_size.pop())
            wide = max(wide, len(pairs[some[-1]][0]))
        for k, m in zip(some, _aligned([pairs[k] for k in some])):
            out[k] = m
    return out


def _aligned(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[int]:
    n, size = max(len(q) for q, _ in pairs), max(len(d) for _, d in pairs)
    left, right = np.full((len(pairs), n), -1, np.int64), np.full((size, len(pairs), 1), -2, np.int64)
    for k, (q, d) in enumerate(pairs):
        left[k, : len(q)], right[: len(d), k, 0] = q, d
    score, hit = np.zeros((len(pairs), n + 1), np.int32), np.zeros((len(pairs), n + 1), np.int32)
    best = np.zeros(len(pairs), np.int32)
    step = 2 * np.arange(n + 1, dtype=np.int32)
    for word in right:
        match = left == word
        s, h = np.zeros_like(score), np.zeros_like(hit)
        s[:, 1:], h[:, 1:] = score[:, :-1] + np.where(match, np.int32(1), np.int32(-2)), hit[:, :-1] + match
        skip = score - 2
        take = skip > s
        s, h = np.where(take, skip, s), np.where(take, hit, h)
        # a missing word: the best score to the left, less two for each step
        run = s + step
        top = np.maximum.accumulate(run, axis=1)
        src = np.maximum.accumulate(np.where(run == top, step // 2, 0), axis=1)
        take = top - step > s
        s, h = np.where(take, top - step, s), np.where(take, np.take_along_axis(h, src, 1), h)
        live = s > 0
        score, hit = s * live, h * live
        best = np.maximum(best, hit.max(axis=1))
    return best.tolist()


def contains(text: np.ndarray, part: np.ndarray) -> bool:
    """Whether the words of ``part`` stand in the text one after another."""
    if not len(part) or len(part) > len(text):
        return False
    whole, some = text.tobytes(), part.astype(text.dtype).tobytes()
    at = whole.find(some)
    while at > 0 and at % text.itemsize:  # it begins inside a number
        at = whole.find(some, at + 1)
    return at >= 0


def _near(n: int, size: int, first: int, last: int, block: int) -> tuple[int, int]:
    """From and up to which of ``size`` words a question of ``n`` is sought around passages found in a document."""
    return max(0, first - n - block), min(size, last + 2 * block + n)


def judged(question: Question, text: np.ndarray, first: int, last: int, block: int, answers: list[np.ndarray]) -> tuple[str | None, float]:
    """(stretch, paraphrase or None; share of the question's words) of a document near the passages found in it."""
    lo, hi = _near(len(question.ids), len(text), first, last, block)
    return judged_all([(question, text[lo:hi], answers)], [question.place(text[lo:hi])])[0]


def judged_all(near: list[tuple[Question, np.ndarray, list[np.ndarray]]], places: list[tuple[int, int]]) -> list[tuple[str | None, float]]:
    """``judged`` of each question, the words near the passages and its answers; places: of the question in these words."""
    jobs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k, ((question, text, _), (at, pairs)) in enumerate(zip(near, places)):
        n, q = len(question.ids), question.ids
        if n < 6 or pairs >= max(1, 0.2 * n - 1):
            around = text[max(0, at - BLOCK) : max(0, at + n + BLOCK)] if n >= 6 else text
            # an alignment matches no more words than the longest common subsequence has
            if 2 * common_in_order(q, around) >= n:
                jobs[k] = q, around
    matched, out = dict(zip(jobs, aligned([*jobs.values()]))), []
    for k, ((question, text, answers), (at, _)) in enumerate(zip(near, places)):
        n, q = len(question.ids), question.ids
        how, share = None, 0.0
        if 2 * (m := matched.get(k, 0)) >= n:
            how, share = "stretch", m / n
        elif n >= 6 and any(contains(text, a) for a in answers):
            room = text[max(0, at - n // 4) : max(0, at + n + n // 4)]
            if (m := common_in_order(q, room)) >= 0.6 * n:
                how, share = "paraphrase", m / n
        out.append((how, share))
    return out


def _parts(items: DataFrame, part_words: int) -> Iterator[list[tuple[list[str], list[tuple[int, str, list[str]]]]]]:
    """Parts of the items: (question's words, [(item, data set, answer's words)])."""
    asked: dict[tuple[str, ...], list] = {}
    size = 0
    for r in items.select("item_id", "dataset_name", "question", "choices", "answer_key").toLocalIterator():
        if not (q := tuple(words(r["question"]))):
            continue
        c = r["choices"]
        answer = next((t for t, k in zip(c["text"] or [], c["label"] or []) if k == r["answer_key"]), None) if c and r["answer_key"] else None
        a = words(answer)
        asked.setdefault(q, []).append((r["item_id"], r["dataset_name"], a))
        size += len(q) + len(a)
        if size >= part_words:
            yield list(asked.items())
            asked, size = {}, 0
    if asked:
        yield list(asked.items())


def _search(documents: DataFrame, part: list, fit_documents: int) -> DataFrame | None:
    spark = documents.sparkSession
    vocabulary: dict[str, int] = {}
    for q, held in part:
        for w in (*q, *(w for _, _, a in held for w in a)):
            vocabulary.setdefault(w, len(vocabulary))
    other = len(vocabulary)
    number = lambda ws: np.array([vocabulary[w] for w in ws], np.int32)
    asked = [(number(q), [(i, d, number(a)) for i, d, a in held]) for q, held in part]
    docs = cut(numbered(documents, vocabulary))
    n, df = frequencies(docs, other)
    if not n:
        return None
    space = latent_space(docs, n, df, fit_documents)
    ids = [q for q, _ in asked]
    scales = [Scale(ids, which, block, other) for block, which in ((BLOCK, [i for i, x in enumerate(ids) if len(x) >= 24]), (BLOCK // 2, [i for i, x in enumerate(ids) if len(x) < 24])) if which]
    sent = spark.sparkContext.broadcast((space, scales, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, scales, asked = sent.value
        questions = [Question(x, other) for x, _ in asked]
        places, vectors = Places(questions, other), []
        for s in scales:
            v = _gather(s.wins, space)
            vectors.append(np.ascontiguousarray((v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-9)).T))
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                flat, off = _lists(b)
                key, rows = b.column("doc_id").to_pylist(), []
                for s, v in zip(scales, vectors):
                    if not (found := candidates(s, v, space, flat, off)):
                        continue
                    doc, which = np.array([*found], np.int64).T
                    near = np.array([_near(len(questions[i].ids), int(off[d + 1] - off[d]), *at, s.block) for (d, i), at in found.items()], np.int64)
                    lo, hi = (near + off[doc][:, None]).T
                    asks = [(questions[i], flat[x:y], [a for _, _, a in asked[i][1]]) for i, x, y in zip(which.tolist(), lo.tolist(), hi.tolist())]
                    for d, i, (how, m) in zip(doc.tolist(), which.tolist(), judged_all(asks, places(flat, which, lo, hi))):
                        if how:
                            text = flat[off[d] : off[d + 1]]
                            rows += [(key[d], item, name, m, how, contains(text, a)) for item, name, a in asked[i][1]]
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=cols), pa.schema(types), preserve_index=False)

    cols = ["doc_id", "item_id", "dataset_name", "matched", "how", "answer_present"]
    types = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("dataset_name", pa.string()), ("matched", pa.float64()), ("how", pa.string()), ("answer_present", pa.bool_())]
    return docs.mapInArrow(run, SCHEMA).dropDuplicates(["doc_id", "item_id"])


def leaks(documents: DataFrame, items: DataFrame, fit_documents: int = 5_000, part_words: int = 300_000) -> DataFrame:
    """(doc_id, item_id, dataset_name, matched, how, answer_present): documents that hold at least half of a question in
    a stretch, or a paraphrase of it with its answer."""
    found = [x for part in _parts(items, part_words) if (x := _search(documents, part, fit_documents)) is not None]
    return reduce(DataFrame.unionAll, found) if found else documents.sparkSession.createDataFrame([], SCHEMA)
