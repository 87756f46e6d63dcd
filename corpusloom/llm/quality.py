"""Per-document text statistics, and how far each text is from natural prose of its language.

Every line is sentences, list entry, table row or junk by its words and layout; the shares of a text's characters in each
are statistics beside counts and ratios of words, characters, lines and common words. Per language, mean and covariance of
prose, which most texts are, are estimated robustly: from medians and quartiles, in concentration steps that keep the
three quarters nearest to the present centre, over all rows. A step adds up sums of outer products by bins of distance in
the partitions; sums of at most bins times languages are what reaches the driver. The squared Mahalanobis distance of a
text to its language's centre is split into one contribution per statistic. Texts beyond the limit whose lines are mostly
of one kind are the rows of which centres of lists, tables and junk are estimated, by concentration steps as well. A text
beyond the limit gets the kind whose centre is nearest, in the scatter of all kinds together; that may be prose, as for
prose with a short list. Any other text is prose. A language with few texts leans on the centre of all, in which the
share of common words has no weight.

Null and blank texts have zero counts, null ratios, no distance and the kind null; texts under ``least`` characters get
statistics and a distance but the kind null.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import encode
from corpusloom.session import cut

STATS = (
    "log_words", "mean_word_length", "symbol_ratio", "digit_ratio", "upper_ratio", "line_end_share", "common_share", "distinct_share",
    "log_words_per_line", "short_line_share", "space_ratio", "log_longest_word", "squeezed", "list_share", "table_share", "junk_share",
)
#: The spread a statistic has at least, so that one that never varies in prose still has a scale.
FLOOR = np.array([0.5, 0.4, 0.01, 0.01, 0.02, 0.15, 0.03, 0.08, 0.5, 0.15, 0.03, 0.25, 0.05, 0.05, 0.05, 0.05])
LANGS = ("en", "fr", "de", "es", "ru", "ar", "zh", "ja", "other")
KINDS = ("prose", "list", "table", "junk")
SETS = 100_000  # common words up to which they are sent as sets; more are sent as sorted hashes of 8 bytes
KEPT, BINS = 0.75, 32
LIMIT = len(STATS) + 2.5 * math.sqrt(2 * len(STATS))  # about the 0.99 quantile of chi-square

_TAGS = re.compile(r"</?(?:p|br|b|i|em|strong|span|a|h[1-6]|body|html|article|section)\b[^<>]{0,200}>|<\|[a-z_0-9]+\|>", re.I)
_BREAK = re.compile(r"\r\n?|[\x85  \x0b\x0c]")
_MARK = re.compile(r"[\s>]*(?:[-–—*•·▪◦‣○●■□☐☑✓✔➤→>+~]|\(?\d{1,3}[.):]|\(?[a-zA-Z][.)]|\(?[ivxlcIVXLC]{1,5}[.)])\s+\S")
_END = re.compile(r"[.!?…。！？؟।][\"'”’»」』)\]*_]*$")
_CELLS = re.compile(r"\t|\s{2,}|\s*\|\s*|;(?! )|,(?! )")
_ROW = re.compile(r"<t[rdh]\b", re.I)
_ENTRY = re.compile(r"\s*[,;·•|/]\s+|\s+[·•|/–]\s+")
_GAP = re.compile(r"\S {3,}\S")
_LEADER = re.compile(r"\.{3,}")
_HEX = re.compile(r"(?:0x)?[0-9a-f]*\d[0-9a-f]*|[0-9a-f]{2}", re.I)
_CLUSTER = re.compile(r"[bcdfghjklmnpqrstvwxz]{4}")
_MOJIBAKE = re.compile("[\xc2-\xf4][\x80-\xbfŒœŠšŸŽžƒˆ˜–-›€™]")
_LOG = re.compile(r"^\W{0,2}\d{2,4}[:/-]\d{2}[:/-]\d{2}\b|\b0x[0-9a-f]{4,}|\brc=-?\d|\b(?:WARN|ERR|DBG|INFO|DEBUG|ERROR|TRACE)\b")
_CODE = re.compile(r"</?[a-z][^<>]{0,80}>|&(?:[a-z]{2,6}|#\d*);?|[{}]|\bvar \w+=\d*;?")
_KANA, _HAN = re.compile("[぀-ヿ]"), re.compile("[㐀-鿿]")
_ARABIC, _CYRILLIC = re.compile("[؀-ۿ]"), re.compile("[Ѐ-ӿ]")
_GLUE = re.compile("[的了在是和就不也，。、；？！のはがをにでとも]")
_CJK_MARK = re.compile("[，。、！？]")
_VISIBLE = re.compile(r"\S")


class Hashed:
    """A large set of words by their hashes."""

    def __init__(self, words: set[str]):
        import xxhash

        self.hashes = np.sort(np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64))

    def __contains__(self, word: str) -> bool:
        import xxhash

        h = np.uint64(xxhash.xxh64_intdigest(word))
        i = int(np.searchsorted(self.hashes, h))
        return i < len(self.hashes) and bool(self.hashes[i] == h)


def language(text: str, words: list[str], common: dict[str, frozenset]) -> str:
    """By script, else the language of most common words."""
    head = text if text.isascii() else None
    if head is None:
        letters = max(1, sum(map(len, words)))
        kana, han = len(_KANA.findall(text)), len(_HAN.findall(text))
        if kana + han > 0.3 * letters:
            return "ja" if kana > 0.1 * (kana + han) else "zh"
        if len(_ARABIC.findall(text)) > 0.4 * letters:
            return "ar"
        if len(_CYRILLIC.findall(text)) > 0.4 * letters:
            return "ru"
    best, most = "other", 0
    for lang in ("en", "fr", "de", "es"):
        n = sum(map(common.get(lang, frozenset()).__contains__, words))
        if n > most:
            best, most = lang, n
    return best if most >= 0.04 * len(words) else "other"


def junk_line(u: str, words: list[str]) -> bool:
    """Garbled or machine-made: symbols, digests, encoded data, logs, tags, letters at random."""
    n = len(u)
    solid = sum(map(len, words)) or 1
    alnum = sum(map(str.isalnum, u))
    if alnum < 0.55 * solid and n >= 4:
        return True
    if len(words) >= 3 and sum(1 for w in words if _HEX.fullmatch(w)) >= 0.7 * len(words) and sum(map(str.isalpha, u)) > 0.15 * solid:
        return True
    if max(map(len, words)) >= 40 and u.isascii():
        return True
    long = [w for w in words if len(w) >= 5 and w.isascii()]
    if len(long) >= 1 and sum(1 for w in long if _CLUSTER.search(w.lower())) >= 0.45 * len(long) and sum(map(len, long)) > 0.4 * solid:
        return True
    return u.count("�") > 0.05 * n


def machine_line(u: str) -> bool:
    """Logs, code and tags, wrongly decoded bytes: junk whatever its layout."""
    return bool(_LOG.search(u)) or sum(map(len, _CODE.findall(u))) > 0.4 * len(u) or len(_MOJIBAKE.findall(u)) > 0.12 * len(u)


def table_row(u: str) -> bool:
    """Three cells or more between bars, tabs, wide gaps or unspaced semicolons and commas, or two far apart."""
    if u.count("|") >= 2 or "\t" in u.strip():
        cells = re.split(r"[|\t]", u)
    elif _GAP.search(u):
        return True
    else:
        cells = _CELLS.split(u)
    if len(cells) < 3:
        return False
    full = "".join(cells)
    return max(map(len, cells)) <= 60 and sum(map(str.isalnum, full)) + full.count(" ") + full.count("-") >= 0.7 * len(full)


def line_kind(u: str, words: list[str], hits: int, cjk: bool) -> str:
    if _ROW.search(u):
        return "table"
    if cjk:
        glue = len(_GLUE.findall(u))
        if _CJK_MARK.search(u) and glue >= 0.06 * len(u) and not _MARK.match(u) or glue >= 0.12 * len(u) and len(u) >= 14:
            return "prose"
    elif hits >= 0.12 * len(words) and len(words) >= 4:
        return "prose"
    elif hits >= 1 and len(words) >= 3 and _END.search(u) and not _MARK.match(u):
        return "prose"
    if "..." in u:
        u = _LEADER.sub(" ", u)
        words = u.split()
    if len(u) >= 8 and machine_line(u):
        return "junk"
    if table_row(u):
        return "table"
    if len(u) >= 8 and words and junk_line(u, words):
        return "junk"
    if _MARK.match(u):
        return "list"
    entries = [e for e in _ENTRY.split(u) if e]
    if len(entries) >= 4 and len(words) <= 5 * len(entries):
        return "list"
    if _END.search(u) and len(words) >= 3:
        return "prose"
    return "list" if len(words) <= 12 else "prose"


def measure(text: str | None, common: dict[str, frozenset]) -> tuple:
    """(language, words, characters, lines, *STATS, prose share), zero and null without anything visible."""
    if not text or not _VISIBLE.search(text):
        return (None, 0, len(text or ""), 0, *[None] * len(STATS), None)
    full = _BREAK.sub("\n", text) if not text.isascii() or "\r" in text or "\x0b" in text or "\x0c" in text else text
    if "<" in full:
        full = _TAGS.sub(" ", full)
    lower = full.lower()
    if not lower.isascii():
        lower = lower.translate(_LATIN)
    words = lower.split()
    lang = language(full, words, common)
    known = common.get(lang, frozenset()) or frozenset()
    cjk = lang in ("zh", "ja")
    n = len(text)
    raw = text.encode("utf-8", "replace")
    squeezed = len(zlib.compress(raw, 1)) / len(raw)
    size = {"prose": 0, "list": 0, "table": 0, "junk": 0}
    ended = short = lines = common_hits = 0
    shown = full.split("\n")
    for i, low in enumerate(lower.split("\n")):
        w = low.split()
        if not w:
            continue
        u = shown[i] if i < len(shown) else low
        hits = sum(map(known.__contains__, w))
        common_hits += hits
        kind = line_kind(u, w, hits, cjk)
        size[kind] += len(u.strip())
        lines += 1
        ended += bool(_END.search(u.rstrip()))
        short += len(w) <= 6 if not cjk else len(u) <= 14
    total = max(1, sum(size.values()))
    if n >= 100 and squeezed < (0.12 if n >= 600 else 0.2 if n >= 250 else 0.3):  # endlessly repeated
        size = {"prose": 0, "list": 0, "table": 0, "junk": total}
    count = max(1, len(words))
    solid = max(1, n - sum(map(str.isspace, text)))
    letters = max(1, sum(map(str.isalpha, text)))
    stats = (
        math.log1p(count), min(solid / count, 40.0) if not cjk else 5.0, (solid - sum(map(str.isalnum, text))) / solid, sum(map(str.isdigit, text)) / solid,
        sum(map(str.isupper, text)) / letters, ended / max(1, lines), common_hits / count if not cjk else len(_GLUE.findall(text)) / solid, len(set(words)) / count ** 0.9,
        math.log1p(count / max(1, lines)), short / max(1, lines), (n - solid) / n, math.log1p(min(max(map(len, words), default=0), 1000)) if not cjk else 3.0, squeezed,
        size["list"] / total, size["table"] / total, size["junk"] / total,
    )
    return (lang, len(words), n, lines, *stats, size["prose"] / total)


_LATIN = {ord(a): b for a, b in zip("’‘", "''")}


def measured(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, text_lang, n_words, n_chars, n_lines, *STATS, prose_share) of every document."""
    common: dict[str, set] = {}
    for r in common_words.where("lang is not null and word is not null").toLocalIterator():
        common.setdefault(r["lang"], set()).add(r["word"])
    form = frozenset if sum(map(len, common.values())) <= SETS else Hashed
    shared = documents.sparkSession.sparkContext.broadcast({k: form(v) for k, v in common.items()})
    names = ["doc_id", "text_lang", "n_words", "n_chars", "n_lines", *STATS, "prose_share"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * (len(STATS) + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = shared.value
        for whole in batches:
            for b in encode.chunks(whole, "text"):
                rows = [measure(t, sent) for t in b.column("text").to_pylist()]
                cols = [b.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), types[1:]))]
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id bigint, text_lang string, n_words bigint, n_chars bigint, n_lines bigint, " + ", ".join(f"{s} double" for s in (*STATS, "prose_share"))
    return documents.select("doc_id", "text").mapInArrow(run, schema)


Centre = tuple[np.ndarray, np.ndarray]  # mean, covariance


def _distances(x: np.ndarray, centre: Centre) -> np.ndarray:
    d = x - centre[0]
    return np.einsum("ij,jk,ik->i", d, np.linalg.inv(centre[1]), d)


def _step(stats: DataFrame, groups, centres: dict[str, Centre], kept: float) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """One concentration step: by group, (rows, sums, sums of products) of the share ``kept`` nearest to its centre, to
    the bin of distance. ``groups`` gives each row of (languages, statistics) its group, or an empty string."""
    k = len(STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], np.ndarray] = {}
        for b in batches:
            f = b.to_pandas()
            x = f[list(STATS)].to_numpy(float)
            group = groups(f["text_lang"].to_numpy(object), x)
            for g in np.unique(group[group != ""]) if len(group) else ():
                v = x[group == g]
                d = _distances(v, centres[g]) if g in centres else np.zeros(len(v))
                at = np.clip(np.floor(2 * np.log2(np.maximum(d, 1e-9))), -8, BINS - 9).astype(int) + 8
                aug = np.hstack([np.ones((len(v), 1)), v])
                for i in np.unique(at):
                    y = aug[at == i]
                    total[g, int(i)] = total.get((g, int(i)), 0) + y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in total], pa.string()), pa.array([i for _, i in total], pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["grp", "bin", "sums"])

    def add(f: pd.DataFrame) -> pd.DataFrame:
        s = sum(np.frombuffer(x) for x in f["sums"])
        return pd.DataFrame({"grp": f["grp"].iloc[:1], "bin": f["bin"].iloc[:1], "sums": [s.tobytes()]})

    schema = "grp string, bin int, sums binary"
    bins: dict[str, dict[int, np.ndarray]] = {}
    rows = stats.where(f"text_lang is not null and n_chars >= {LEAST}").select("text_lang", *STATS)
    for r in rows.mapInArrow(run, schema).groupBy("grp", "bin").applyInPandas(add, schema).toLocalIterator():
        bins.setdefault(r["grp"], {})[r["bin"]] = np.frombuffer(r["sums"]).reshape(k + 1, k + 1)
    out = {}
    for g, by in bins.items():
        n, a = sum(m[0, 0] for m in by.values()), np.zeros((k + 1, k + 1))
        for i in sorted(by):
            if a[0, 0] >= kept * n:
                break
            a = a + by[i]
        out[g] = (a[0, 0], a[0, 1:], a[1:, 1:])
    return out


def _centres(moments: dict[str, tuple[float, np.ndarray, np.ndarray]]) -> dict[str, Centre]:
    """Mean and covariance of each group; of few rows, the covariance leans to its diagonal."""
    k, out = len(STATS), {}
    for g, (n, s, ss) in moments.items():
        mean = s / n
        cov = ss / n - np.outer(mean, mean)
        weight = n / (n + 5 * k)
        out[g] = (mean, weight * cov + (1 - weight) * np.diag(np.diag(cov)) + np.diag(FLOOR**2))
    return out


def _pooled(centres: list[Centre]) -> Centre:
    """Of all languages: within and between them; the share of common words, which is a language's own, has no weight."""
    if not centres:
        return np.zeros(len(STATS)), np.eye(len(STATS))
    mean, j = np.mean([m for m, _ in centres], 0), STATS.index("common_share")
    cov = np.mean([c for _, c in centres], 0) + np.cov(np.array([m for m, _ in centres]).T, bias=True).reshape(len(STATS), -1)
    cov[j], cov[:, j] = 0, 0
    cov[j, j] = 1.0
    return mean, cov


def prose_centres(stats: DataFrame, steps: int = 3, few: int = 20) -> dict[str, Centre]:
    """Centre of prose by language, and under '*' of all; a language of fewer texts than ``few`` has none of its own, nor
    have texts of no known language."""
    quartiles = [F.percentile_approx(c, [0.25, 0.5, 0.75], 2000).alias(c) for c in STATS]
    known = stats.where(f"text_lang != 'other' and n_chars >= {LEAST}")
    start = {r["text_lang"]: r for r in known.groupBy("text_lang").agg(F.count(F.lit(1)).alias("__n"), *quartiles).collect() if r["__n"] >= few}  # a row a language
    centres: dict[str, Centre] = {}
    for lang, r in start.items():
        q = np.array([r[c] for c in STATS], float)
        centres[lang] = (q[:, 1], np.diag(np.maximum((q[:, 2] - q[:, 0]) / 1.349, FLOOR) ** 2))
    names = frozenset(centres)
    for _ in range(steps if centres else 0):
        centres = _centres(_step(stats, lambda lang, _: np.array([g if g in names else "" for g in lang], object), centres, KEPT))
    return centres | {"*": _pooled(list(centres.values()))}


def prose_distances(lang: np.ndarray, x: np.ndarray, centres: dict[str, Centre]) -> tuple[np.ndarray, np.ndarray]:
    """(contribution of every statistic, mean of the language) of each row."""
    parts, means = np.full(x.shape, np.nan), np.zeros(x.shape)
    for g in {g for g in lang if isinstance(g, str)}:
        at = lang == g
        mean, cov = centres.get(g, centres["*"])
        d = x[at] - mean
        parts[at], means[at] = d * (d @ np.linalg.inv(cov)), mean
    return parts, means


def kind_centres(stats: DataFrame, prose: dict[str, Centre], steps: int = 2) -> dict[str, Centre]:
    """Centres of lists, tables and junk, and under 'scatter' the covariance of all kinds together."""
    shares = [STATS.index(f"{k}_share") for k in KINDS[1:]]

    def seeds(lang: np.ndarray, x: np.ndarray) -> np.ndarray:
        far = prose_distances(lang, x, prose)[0].sum(1) > LIMIT
        most = x[:, shares]
        return np.where(far & (most.max(1) >= 0.8), np.array(KINDS[1:], object)[most.argmax(1)], "") if len(x) else np.zeros(0, object)

    found: dict[str, Centre] = {}
    for i in range(steps):
        found = _centres(_step(stats, seeds, found, KEPT if i else 1.0))
    pooled, out = prose["*"], {}
    for k, j in zip(KINDS[1:], shares):
        mean = pooled[0].copy()
        mean[shares], mean[j] = 0, 1
        mean[[STATS.index("line_end_share"), STATS.index("common_share")]] = 0
        out[k] = found.get(k, (mean, np.diag((3 * FLOOR) ** 2)))
    scatter = np.mean([c for _, c in (*out.values(), pooled)], 0) + np.diag((2 * FLOOR) ** 2)
    return out | {"scatter": (pooled[0], scatter)}


LEAST = 100  # characters of a text that counts for the centres


def quality(documents: DataFrame, common_words: DataFrame, least: int = LEAST) -> DataFrame:
    """The statistics with ``distance`` (squared, robust), ``contributions`` (one of each statistic, in the order of
    STATS) and ``kind``."""
    stats = cut(measured(documents, common_words))
    prose = prose_centres(stats)
    sent = stats.sparkSession.sparkContext.broadcast((prose, kind_centres(stats, prose)))  # a mean and a matrix for each of at most nine languages and three kinds

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prose, kinds = sent.value
        inverse = np.linalg.inv(kinds["scatter"][1])
        for f in frames:
            x = f[list(STATS)].to_numpy(float)
            parts, means = prose_distances(f["text_lang"].to_numpy(object), x, prose)
            distance = parts.sum(1)
            apart = [x - means, *(x - kinds[k][0] for k in KINDS[1:])]
            near = np.nan_to_num(np.stack([np.einsum("ij,jk,ik->i", d, inverse, d) for d in apart], 1))
            kind = np.where(distance > LIMIT, np.array(KINDS, object)[near.argmin(1)], "prose")
            kind[(f["n_chars"] < least).to_numpy() | np.isnan(distance)] = None
            yield f.assign(distance=distance, contributions=[None if np.isnan(p[0]) else p.tolist() for p in parts], kind=kind)

    schema = ", ".join(f"{n} {t}" for n, t in stats.dtypes) + ", distance double, contributions array<double>, kind string"
    return stats.mapInPandas(run, schema)
