"""Words of a text, free of letter case, markup, entities, punctuation, spacing, accents and Unicode forms.

A word is a run of letters and digits; in Chinese and Japanese every character is one. Null and empty texts have none.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib

import numpy as np

_CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿"
_TAG = re.compile(r"<[^<>]{1,200}>")
_MARKS = re.compile("[̀-ͯ­​-‏⁠-⁤﻿︀-️]")
_ASCII, _ANY = re.compile(r"[a-z0-9]+"), re.compile(rf"[{_CJK}]|[^\W_{_CJK}]+")


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if text.isascii():
        return _ASCII.findall(text.lower())
    return _ANY.findall(_MARKS.sub("", unicodedata.normalize("NFKD", text)).casefold())


class Ids:
    """Words to 32-bit numbers, the same in every process; words seen are remembered up to a bound."""

    def __init__(self, most: int = 500_000):
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, text: str | None) -> np.ndarray:
        known, out = self.known, []
        for w in words(text):
            if (k := known.get(w)) is None:
                k = known[w] = zlib.crc32(w.encode("utf-8", "replace"))
            out.append(k)
        if len(known) > self.most:
            known.clear()
        return np.array(out, np.uint32)


def common_in_order(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over the shorter one."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    mask = (1 << len(a)) - 1
    s = mask
    for y in b.tolist():
        if m := where.get(y):
            u = s & m
            s = ((s + u) | (s - u)) & mask
    return len(a) - s.bit_count()


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Words in both, counted as often as in the one that has fewer."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())
