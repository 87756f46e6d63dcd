"""Tokenizers as files and as numbers: saved merges, formats told apart by their keys, ids of markers, fingerprints."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from corpusloom.functions.text import special_block
from corpusloom.operators import bpe


@dataclass(frozen=True)
class Trained:
    """A vocabulary trained here: bytes and merges. It declares no special strings; a marker has an id only if the merges
    made it one."""

    merges: tuple[tuple[int, int], ...]
    vocab_size: int
    declared: tuple[str, ...] = field(default=())

    @property
    def n_vocab(self) -> int:
        """Ids there are; fewer than ``vocab_size`` where training ran out of pairs."""
        return 256 + len(self.merges)

    def encode_text(self, text: str) -> list[int]:
        made = {p: 256 + i for i, p in enumerate(self.merges)}
        return [x for c in bpe._CHUNK.findall(text) for x in bpe.encode_chunk(c.encode(), made)]

    def special_id(self, name: str) -> int:
        ids = self.encode_text(name)
        if len(ids) != 1:
            raise KeyError(f"{name!r} is no single token of this vocabulary")
        return ids[0]

    def sep_id(self, sep: str) -> int:
        """The token a separator begins with; it must hold the separator's marker."""
        first = self.encode_text(sep)[0]
        if sep.strip() not in bpe.vocabulary(list(self.merges))[first].decode("utf-8", "replace"):
            raise ValueError(f"the first token of {sep!r} does not hold its marker")
        return first

    @property
    def fingerprint(self) -> str:
        return fingerprint(0, {}, bpe.vocabulary(list(self.merges)))

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"vocab_size": self.vocab_size, "merges": [[a, b, 256 + i] for i, (a, b) in enumerate(self.merges)]}, f)


@dataclass(frozen=True)
class Declared:
    """The byte profile: a block of special strings, then the bytes."""

    declared: tuple[str, ...] = tuple(special_block())

    @property
    def n_vocab(self) -> int:
        return len(self.declared) + 256

    def special_id(self, name: str) -> int:
        if name not in self.declared:
            raise KeyError(f"{name!r} is not declared")
        return self.declared.index(name)

    def sep_id(self, sep: str) -> int:
        return self.special_id(sep.strip())

    @property
    def fingerprint(self) -> str:
        from corpusloom.operators.stream import _BYTES

        named = {s: i for i, s in enumerate(self.declared) if not s.startswith("<|reserved_")}
        return fingerprint(len(self.declared) - len(named), named, [bytes([b]) for b in _BYTES], len(self.declared))


def fingerprint(reserved: int, named: dict[str, int], tokens: list[bytes], first: int = 0) -> str:
    """Eight hex digits over the number of reserved ids, the named ones and every token with its id, a line each."""
    lines = [str(reserved), *(f"{k}={v}" for k, v in sorted(named.items())), *(f"{first + i}={t.hex()}" for i, t in enumerate(tokens))]
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:8]


def load(path: str):
    """A tokenizer file by its top-level keys: ``merges`` with ``vocab_size`` is one of ``Trained.save``; ``model`` is the
    format of the public tokenizers library, which must be installed."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    if "model" in data:
        from tokenizers import Tokenizer

        return Tokenizer.from_str(json.dumps(data))
    if "merges" in data and "vocab_size" in data:
        pairs = [(a, b) for a, b, _ in sorted(data["merges"], key=lambda m: m[2])]
        if [m[2] for m in sorted(data["merges"], key=lambda m: m[2])] != list(range(256, 256 + len(pairs))):
            raise ValueError(f"{path}: merges are not numbered from 256")
        return Trained(tuple(pairs), data["vocab_size"])
    raise ValueError(f"{path}: no known tokenizer format, keys {sorted(data)}")


def train(spark: SparkSession, docs: DataFrame, vocab_size: int = 32_000) -> Trained:
    """From (text); stops early when no pairs are left."""
    if vocab_size < 256:
        raise ValueError("256 bytes need 256 ids")
    return Trained(tuple(bpe.train(bpe.chunk_counts(docs), vocab_size - 256)), vocab_size)
