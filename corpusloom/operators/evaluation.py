"""Metrics over given texts, scores and probabilities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def repetition(docs: DataFrame, span: int = 20, times: int = 3) -> DataFrame:
    """(doc_id, looping): whether some ``span`` words occur ``times`` times. Grams are numbered by doubling (of 1, 2, 4, ...
    words, and the last step overlaps), all texts of a batch at once, so equal numbers are equal words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = [(t or "").split() for t in b.column("text").to_pylist()]
            size = np.array([len(w) for w in split], np.int64)
            number: dict[str, int] = {}
            gram = np.fromiter((number.setdefault(w, len(number)) for ws in split for w in ws), np.int64, int(size.sum()))
            row, width = np.repeat(np.arange(len(split)), size), 1
            while width < span and len(gram):
                step = min(width, span - width)
                inside = row[:-step] == row[step:]
                row = row[:-step][inside]
                gram = np.unique(np.stack([gram[:-step][inside], gram[step:][inside]]), axis=1, return_inverse=True)[1].reshape(-1) if len(row) else row
                width += step
            pair, count = np.unique(np.stack([row, gram]), axis=1, return_counts=True) if len(gram) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
            looping = np.zeros(len(split), bool)
            looping[pair[0][count >= times]] = True
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(looping)], ["doc_id", "looping"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, looping boolean")


def mc_items(items: DataFrame, first: int = 200) -> DataFrame:
    """(item_id, question, options, answer): the first items whose key is one of their labels; answer counts from 0."""
    ok = items.where(F.col("answer_key").isNotNull() & F.array_contains("choices.label", F.col("answer_key"))).orderBy("item_id").limit(first)
    return ok.select("item_id", "question", F.col("choices.text").alias("options"), (F.array_position("choices.label", F.col("answer_key")) - 1).cast("bigint").alias("answer"))


def mc_accuracy(tokens: DataFrame) -> DataFrame:
    """One row from (item_id, answer, option, logp), a row a token: items, and the share whose option of the best mean, the
    first of equals, is right."""
    scored = tokens.groupBy("item_id", "answer", "option").agg(F.avg("logp").alias("logp"))
    best = scored.groupBy("item_id", "answer").agg(F.max_by("option", F.struct("logp", -F.col("option"))).alias("said"))
    return best.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum((F.col("said") == F.col("answer")).cast("int")) / F.greatest(F.lit(1), F.count(F.lit(1))), 6).alias("accuracy"))


def top_p(p: DataFrame, mass: float) -> DataFrame:
    """(row_id, token, p) kept: tokens by falling probability as long as what is before them is under ``mass``, rescaled."""
    w = Window.partitionBy("row_id").orderBy(F.desc("p"), "token")
    before = F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("p")
    kept = p.withColumn("before", before).where(F.col("before") < mass)
    return kept.select("row_id", "token", (F.col("p") / F.sum("p").over(Window.partitionBy("row_id"))).alias("p"))


def decode_batches(prompts: DataFrame, new_tokens: int, vocab: int, most: int = 64_000_000) -> DataFrame:
    """(n_tokens, batch, n_prompts): prompts of one length in rectangles of at most ``most`` cells."""
    rows = F.greatest(F.lit(1), F.floor(F.lit(most) / ((F.col("n_tokens") + new_tokens) * vocab)))
    sized = prompts.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).withColumn("rows", rows)
    b = sized.withColumn("batch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / F.col("rows")))))
    return b.select("n_tokens", "batch", F.least(F.col("rows"), F.col("n") - F.col("batch") * F.col("rows")).cast("bigint").alias("n_prompts"))


def latest_runs(history: DataFrame) -> DataFrame:
    """Each run once."""
    w = Window.partitionBy("run_id").orderBy(F.col("started_at").asc_nulls_last(), F.col("updates").desc_nulls_last())
    return history.where("run_id is not null").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def format_compliance(texts: DataFrame, cap: int) -> DataFrame:
    """One row from (doc_id, text): answers, the shares that stop before ``cap`` bytes, reach it, begin a role, fall back to
    the end-of-text marker, or repeat themselves, and their mean bytes; of no answers, zeros."""
    from corpusloom.functions.text import EOT, IM_START

    n = F.greatest(F.lit(1), F.count(F.lit(1)))
    share = lambda c: F.round(F.count_if(c) / n, 6)
    looping = repetition(texts).agg(F.round(F.count_if("looping") / n, 6).alias("repetition"))
    size = F.octet_length("text")
    counted = texts.agg(
        F.count(F.lit(1)).alias("n"), share(size < cap).alias("stopped"), share(size >= cap).alias("hit_cap"), F.round(F.coalesce(F.sum(F.least(size, F.lit(cap))), F.lit(0)) / n, 6).alias("mean_len"),
        share(F.col("text").contains(IM_START)).alias("stray_role"), share(F.col("text").contains(EOT)).alias("relapsed_to_eot"),
    )
    return counted.crossJoin(F.broadcast(looping))  # one row each
