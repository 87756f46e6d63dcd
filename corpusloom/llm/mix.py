"""Mixing sources to target weights.

Per mix, each part may give at most ``max_repeats`` times its available records (at most ``cap`` of them). The weights
are tempered: a part's share is its weight to the power 1 - t times its share of what the parts can give to the power t.
At t = 0 these are the target weights, at t = 1 every part is used alike. The exponent is bisected to the least t at
which no part is asked for more than it can give, and shares become whole budgets by largest remainder. A budget is
realised as block permutations: a part's records in the order of a seeded digest, as often as needed, each block
rotated by its own offset, the last one cut at the budget.

A part falls short if the exponent that its own share would need is above 0.

A mix that cannot be filled at all gets all that its parts can give. Specs without ``n_train_docs`` and parts without a
weight are left out; a part without ``max_repeats`` may repeat without limit, one without records gives nothing.
Records are training documents whose text is not null or blank; sources are compared trimmed and in lower case.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.ranking import spread_rank

BLANK = r"^[\s\p{Z}\x{85}\x{1c}-\x{1f}\x{feff}\x{200b}-\x{200d}\x{2060}]*$"


def clean_source(source: Column) -> Column:
    return F.lower(F.regexp_replace(source, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def pool(documents: DataFrame) -> DataFrame:
    """(doc_id, dataset_name, config, size) of the records a mix may draw on; size is the text's bytes."""
    usable = documents.where((F.col("split") == "train") & F.col("text").isNotNull() & ~F.col("text").rlike(BLANK))
    return usable.select("doc_id", "dataset_name", clean_source(F.col("source")).alias("config"), F.octet_length("text").alias("size"))


def temper(weights: np.ndarray, limits: np.ndarray, total: int) -> tuple[float, np.ndarray]:
    """(exponent, share of each part): the least exponent that respects the limits."""
    reach = limits.sum()
    if reach <= total:
        return 1.0, limits / max(reach, 1)
    with np.errstate(divide="ignore"):
        lw, ll = np.log(weights / weights.sum()), np.log(limits / reach)

    def share(t: float) -> np.ndarray:
        z = np.where(limits > 0, (1 - t) * lw + t * ll, -np.inf) if t else np.where(limits > 0, lw, -np.inf)
        q = np.exp(z - z.max())
        return q / q.sum()

    if (share(0.0) * total <= limits).all():
        return 0.0, share(0.0)
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if (share(mid) * total <= limits).all() else (mid, high)
    return high, share(high)


def own_exponents(weights: np.ndarray, limits: np.ndarray, total: int) -> np.ndarray:
    """The least exponent at which a part's own tempered share fits what it can give: 0 for a part that fills its target
    share, more for one that falls short of it, 1 at most."""
    reach = max(limits.sum(), 1)

    def asked(t: float) -> np.ndarray:
        return weights ** (1 - t) * (limits / reach) ** t * total if t else weights * total

    low, high = np.zeros(len(weights)), np.where(asked(0.0) <= limits, 0.0, 1.0)
    for _ in range(40):
        mid = (low + high) / 2
        fits = np.array([asked(t)[k] <= limits[k] for k, t in enumerate(mid)])
        high, low = np.where(fits, mid, high), np.where(fits, low, mid)
    return np.where(asked(0.0) <= limits, 0.0, high)


def budgets(weights: np.ndarray, limits: np.ndarray, total: int) -> tuple[float, np.ndarray]:
    t, q = temper(weights, limits, total)
    want = q * min(total, limits.sum())
    whole = np.minimum(np.floor(want + 1e-9), limits)
    for i in sorted(range(len(want)), key=lambda i: (whole[i] - want[i], i)):
        if whole.sum() < min(total, limits.sum()) and whole[i] < limits[i]:
            whole[i] += 1
    return t, whole.astype(np.int64)


def plan_mix(documents: DataFrame, specs: DataFrame, parts: DataFrame) -> DataFrame:
    """One row per part of a mix: target, what is available, the limit, the budget, and whether the part falls short of
    its own share. Grouping and counting are distributed; a group of the last step is the parts of one spec."""
    counts = pool(documents).groupBy("dataset_name", "config").agg(F.count(F.lit(1)).alias("n_docs"))
    targets = (
        parts.where("weight is not null").select("spec_name", "part_no", clean_source(F.col("config")).alias("config"), F.col("config").alias("part_config"), "cap", "weight", "max_repeats")
        .join(specs.where("n_train_docs is not null").select("spec_name", "dataset_name", "n_train_docs", "seed"), "spec_name")
        .join(counts, ["dataset_name", "config"], "left")
    )
    ready = targets.withColumn("available", F.least(F.coalesce("n_docs", F.lit(0)), F.greatest(F.coalesce("cap", F.coalesce("n_docs", F.lit(0))), F.lit(0))))

    def per_spec(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("part_no").reset_index(drop=True)
        total = int(f["n_train_docs"].iloc[0])
        limits = np.array([a * (m if not math.isnan(m) else (total if a else 0)) for a, m in zip(f["available"].astype(float), f["max_repeats"].astype(float))])
        t, quota = budgets(np.maximum(f["weight"].to_numpy(float), 1e-12), limits, total)
        own = own_exponents(f["weight"].to_numpy(float), limits, total)
        return f.assign(limit=limits.astype(np.int64), exponent=t, own_exponent=own, quota=quota, share=quota / max(quota.sum(), 1), short=own > 0)[names]

    names = ["spec_name", "part_no", "dataset_name", "config", "part_config", "seed", "n_train_docs", "weight", "max_repeats", "available", "limit", "exponent", "own_exponent", "quota", "share", "short"]
    schema = (
        "spec_name string, part_no int, dataset_name string, config string, part_config string, seed bigint, n_train_docs bigint, weight double, max_repeats int, "
        "available bigint, limit bigint, exponent double, own_exponent double, quota bigint, share double, short boolean"
    )
    return ready.groupBy("spec_name").applyInPandas(per_spec, schema)


def realise(documents: DataFrame, plan: DataFrame) -> DataFrame:
    """(spec_name, config, doc_id, block, slot, position, size): the records of every mix. ``slot`` numbers a part's records;
    ``position`` in [0, 1) interleaves the parts of a mix evenly when sorted by it."""
    drawn = plan.where("quota > 0").select("spec_name", "part_no", "dataset_name", "config", "part_config", "seed", "available", "quota")
    rows = pool(documents).join(drawn, ["dataset_name", "config"])
    ranked = spread_rank(rows, ["spec_name", "part_no"], F.md5(F.concat_ws("|", "seed", "spec_name", F.col("doc_id").cast("string"))), ties=["doc_id"])
    turn = F.pmod(F.col("rank") + F.col("block") * F.greatest(F.lit(1), (F.col("available") / 3).cast("bigint")), F.col("available"))
    blocks = ranked.where("rank < available").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), ((F.col("quota") - 1) / F.col("available")).cast("bigint"))))
    slots = blocks.withColumn("slot", F.col("block") * F.col("available") + turn).where("slot < quota")
    return slots.select("spec_name", F.col("part_config").alias("config"), "doc_id", "block", "slot", ((F.col("slot") + 0.5) / F.col("quota")).alias("position"), "size")


def shares(documents: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with what each part really gives: records, bytes, and its share of both among the mix's records."""
    given = realise(documents, plan).groupBy("spec_name", F.col("config").alias("part_config")).agg(F.count(F.lit(1)).alias("records"), F.sum("size").alias("bytes"))
    both = plan.join(given, ["spec_name", "part_config"], "left").fillna(0, ["records", "bytes"])
    of = lambda c: F.col(c) / F.nullif(F.sum(c).over(Window.partitionBy("spec_name")), F.lit(0))
    return both.withColumn("record_share", of("records")).withColumn("byte_share", of("bytes"))  # a row a part
