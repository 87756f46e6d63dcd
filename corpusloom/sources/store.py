"""Committed corpora: token rows as Parquet, and a meta record written last.

A corpus is a folder ``<root>/<name>`` with ``tokens`` and ``meta.json``. It exists if its meta does: the tokens are written
to a folder beside it and moved into place, and the meta is moved in behind them, so an interrupted write leaves nothing
that a reader would take for a corpus, and the next build writes it again. Files go through the session's file system, so
the root may be any shared folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class MissingCorpus(FileNotFoundError):
    pass


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, root: str, name: str) -> bool:
    fs, p, _ = _fs(spark, f"{root}/{name}/meta.json")
    return fs.exists(p)


def write(tokens: DataFrame, root: str, name: str, meta: dict) -> None:
    """The tokens, then the meta. ``meta`` must be serialisable without NaN."""
    spark, tag = tokens.sparkSession, uuid.uuid4().hex
    record = json.dumps(meta, indent=2, allow_nan=False)
    fs, home, path = _fs(spark, f"{root}/{name}")
    draft = path(f"{root}/.{name}-{tag}")
    tokens.write.parquet(f"{draft.toString()}/tokens")
    fs.delete(path(home, "meta.json"), False)
    fs.delete(path(home, "tokens"), True)
    fs.mkdirs(home)
    if not fs.rename(path(draft, "tokens"), path(home, "tokens")):
        raise OSError(f"could not move the tokens of {name} into place")
    out = fs.create(path(draft, "meta.json"), True)
    out.write(bytearray(record.encode()))
    out.close()
    if not fs.rename(path(draft, "meta.json"), path(home, "meta.json")):
        raise OSError(f"could not commit {name}")
    fs.delete(draft, True)


def read_meta(spark: SparkSession, root: str, name: str) -> dict:
    if not exists(spark, root, name):
        raise MissingCorpus(f"{root}/{name} has no meta.json; build it first")
    return json.loads(spark.read.text(f"{root}/{name}/meta.json", wholetext=True).first()[0])


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    read_meta(spark, root, name)
    return spark.read.parquet(f"{root}/{name}/tokens")


def build(spark: SparkSession, root: str, parts: dict[str, Callable[[], tuple[DataFrame, dict]]]) -> list[str]:
    """Builds what is missing, in the order given, and names it. A part is a name and what makes (tokens, meta)."""
    made = []
    for name, make in parts.items():
        if not exists(spark, root, name):
            tokens, meta = make()
            write(tokens, root, name, meta)
            made.append(name)
    return made


def inspect(spark: SparkSession, root: str, names: list[str]) -> list[tuple[str, bool, dict | None]]:
    """(name, is it there, its meta) without building anything."""
    return [(n, e, read_meta(spark, root, n) if e else None) for n in names for e in [exists(spark, root, n)]]


def prune(spark: SparkSession, root: str, live: list[str], delete: bool = False) -> list[tuple[str, int]]:
    """(folder, bytes) under the root that no live corpus has, interrupted drafts too; deleted if asked."""
    fs, p, _ = _fs(spark, root)
    if not fs.exists(p):
        return []
    found = [(s.getPath(), fs.getContentSummary(s.getPath()).getLength()) for s in fs.listStatus(p)]
    orphans = [(x, n) for x, n in found if x.getName() not in live]
    if delete:
        for x, _ in orphans:
            fs.delete(x, True)
    return sorted((x.getName(), n) for x, n in orphans)


def manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, size, sha256) of files, read where they lie."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, paths: list[str], wanted: DataFrame) -> DataFrame:
    """Files whose size or digest is not that of the wanted (path, size, sha256), or that are missing."""
    have = manifest(spark, paths).select("path", F.col("size").alias("s"), F.col("sha256").alias("d"))
    return wanted.join(have, "path", "left").where("not (size <=> s and sha256 <=> d)").select("path")


def log_metrics(metrics: DataFrame, path: str) -> None:
    """Rows appended as CSV with a header."""
    metrics.write.mode("append").csv(path, header=True)


def assert_compatible(meta: dict, *, vocab_size: int, tokenizer_fingerprint: str, doc_mask: bool, block_size: int) -> None:
    """Raises where a model and a corpus would train on different things."""
    if vocab_size != meta["vocab_size"]:
        raise ValueError(f"the model has {vocab_size} ids, the corpus {meta['vocab_size']}")
    if tokenizer_fingerprint != meta["tokenizer_fingerprint"]:
        raise ValueError(f"the corpus was built with tokenizer {meta['tokenizer_fingerprint']}, this is {tokenizer_fingerprint}")
    if meta["has_start"] and not doc_mask:
        raise ValueError("examples of a packed corpus would see each other without a document mask")
    if not meta["has_start"] and meta["sep_id"] is None:
        raise ValueError("neither starts nor a separator tell documents apart")
    if meta["pack"] == "bfd" and block_size != meta["pack_block"]:
        raise ValueError(f"bins of {meta['pack_block']} tokens do not fit windows of {block_size}")


def sort_by_length(spark: SparkSession, root: str, name: str, to: str) -> None:
    """A flat corpus of whole documents (doc_id, ids, n_tokens, rank, tok_offset) in the order of their lengths under a
    new name, its tokens as they are. Lengths and the token total must come out the same; the meta says what it was
    sorted from and holds the length index."""
    from corpusloom.operators import stream

    meta, rows = read_meta(spark, root, name), read(spark, root, name)
    if meta["pack"] != "flat" or meta["has_target"] or meta["has_start"]:
        raise ValueError(f"{name} is no flat corpus of plain documents")
    laid = stream.lengths(rows.select("doc_id", "n_tokens", "rank", "tok_offset"))
    moved = rows.select("doc_id", "ids").join(stream.sort_by_length(laid), "doc_id")
    index = [list(r) for r in stream.length_index(laid).orderBy("min_tokens").collect()]  # at most 205 marks
    write(moved, root, to, meta | {"pack": "sorted", "length_index": index, "sorted_from": name})
    lengths = lambda d: d.groupBy("n").count()
    was, now = lengths(laid), lengths(read(spark, root, to))
    if not was.exceptAll(now).isEmpty() or not now.exceptAll(was).isEmpty():
        fs, p, path = _fs(spark, f"{root}/{to}")
        fs.delete(path(p, "meta.json"), False)
        raise ValueError(f"{to} does not hold the documents of {name}")
