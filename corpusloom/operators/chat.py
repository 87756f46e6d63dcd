"""Conversations to training examples: folding, splitting at pairs of turns, truncation, and history trimming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def deduplicated(conversations: DataFrame) -> DataFrame:
    """Each conversation once, the delivery received first; of those of one time the one of the smallest digest."""
    w = Window.partitionBy("conv_id").orderBy(F.col("received_at").asc_nulls_last(), F.xxhash64("messages"), F.size("messages"))
    return conversations.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def folded(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) with system texts folded in; conversations without messages are left out."""
    c = deduplicated(conversations.select("conv_id", "messages", "received_at")).where("messages is not null")
    return c.select("conv_id", T.fold_system(F.col("messages")).alias("turns"))


def split_turns(turns: DataFrame, most: int) -> DataFrame:
    """(conv_id, pair, n_tokens, chunk): pairs of turns are gathered into a chunk as long as it stays within ``most``; a
    chunk begins with one token. One fold over a row's pairs, without a shuffle."""
    p = turns.where("size(turns) >= 2").select("conv_id", T.pair_lengths(F.col("turns")).alias("pairs"))
    start = F.struct(F.lit(1).alias("cur"), F.lit(0).alias("chunk"), F.array().cast("array<int>").alias("ids"))

    def step(a, x):
        flush = (a["cur"] + x["n"] > most) & (a["cur"] > 1)
        chunk = a["chunk"] + flush.cast("int")
        return F.struct(F.when(flush, 1 + x["n"]).otherwise(a["cur"] + x["n"]).alias("cur"), chunk.alias("chunk"), F.concat(a["ids"], F.array(chunk)).alias("ids"))

    zipped = F.arrays_zip(F.col("pairs"), F.aggregate("pairs", start, step)["ids"].alias("chunk"))
    rows = p.select("conv_id", F.explode(zipped).alias("z"))
    return rows.select("conv_id", F.col("z.pairs.pair").cast("bigint").alias("pair"), F.col("z.pairs.n").cast("bigint").alias("n_tokens"), F.col("z.chunk").cast("bigint").alias("chunk"))


def _placed(turns: DataFrame, most: int) -> DataFrame:
    """Every pair with its chunk and ``at``, the tokens of its example before it."""
    p = turns.where("size(turns) >= 2").select("conv_id", F.explode(T.pair_lengths(F.col("turns"))).alias("p"))
    flat = p.select("conv_id", F.col("p.pair").cast("bigint").alias("pair"), F.col("p.n").alias("n"), "p.n_first", "p.target_a", "p.target_b")
    rows = flat.join(split_turns(turns, most).select("conv_id", "pair", "chunk"), ["conv_id", "pair"])
    w = Window.partitionBy("conv_id", "chunk").orderBy("pair").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("at", 1 + F.coalesce(F.sum("n").over(w), F.lit(0)))


def examples(turns: DataFrame, most: int) -> DataFrame:
    """(conv_id, chunk, n_tokens, n_target, truncated, dropped): an example longer than ``most`` is cut there, and
    dropped if nothing to learn is left in it. ``n_tokens`` and ``n_target`` count what remains."""
    at = _placed(turns, most)
    seen = lambda begin, end: F.coalesce(F.greatest(F.lit(0), F.least(F.col("at") + end, F.lit(most)) - (F.col("at") + begin)), F.lit(0))
    target = seen(F.col("target_a"), F.col("n_first")) + seen(F.col("target_b"), F.col("n"))
    g = at.groupBy("conv_id", "chunk").agg((1 + F.sum("n")).alias("full"), F.sum(target).alias("n_target"))
    over = F.col("full") > most
    return g.select("conv_id", "chunk", F.least(F.col("full"), F.lit(most)).cast("bigint").alias("n_tokens"), F.col("n_target").cast("bigint").alias("n_target"), (over & (F.col("n_target") > 0)).alias("truncated"), (over & (F.col("n_target") == 0)).alias("dropped"))


def target_spans(turns: DataFrame, most: int) -> DataFrame:
    """(conv_id, chunk, begin, end): stretches of an example that are to be learnt, as far as they remain in it."""
    at = _placed(turns, most)
    ends = F.array(F.struct(F.col("target_a").alias("b"), F.col("n_first").alias("e")), F.struct(F.col("target_b").alias("b"), F.col("n").alias("e")))
    spans = at.select("conv_id", "chunk", "at", F.explode(ends).alias("s")).where("s.b is not null")
    cut = spans.select("conv_id", "chunk", (F.col("at") + F.col("s.b")).alias("begin"), F.least(F.col("at") + F.col("s.e"), F.lit(most)).alias("end"))
    return cut.where("begin < end")


def masked_windows(laid: DataFrame, spans: DataFrame, block: int) -> DataFrame:
    """(window, n_target, n_kept) of a flat stream: next tokens to be learnt, and those left when what comes before the
    first example that begins in the window is masked, all of it if none does.

    ``laid`` places examples (conv_id, chunk, n_tokens, tok_offset), ``spans`` are their stretches to learn. Stretches are
    split at window ends by arithmetic; no token gets a row."""
    first = laid.groupBy(F.floor(F.col("tok_offset") / block).alias("window")).agg(F.min("tok_offset").alias("head"))
    placed = spans.join(laid.select("conv_id", "chunk", "tok_offset"), ["conv_id", "chunk"]).select((F.col("begin") + F.col("tok_offset")).alias("b"), (F.col("end") + F.col("tok_offset")).alias("e"))
    parts = placed.withColumn("window", F.explode(F.sequence(F.floor(F.greatest(F.col("b") - 1, F.lit(0)) / block), F.floor((F.col("e") - 2) / block))))
    lo, hi = F.greatest(F.col("b"), F.col("window") * block + 1), F.least(F.col("e"), (F.col("window") + 1) * block + 1)
    inside = parts.join(first, "window", "left").select("window", F.greatest(F.lit(0), hi - lo).alias("n"), F.when(F.col("head").isNull(), 0).otherwise(F.greatest(F.lit(0), hi - F.greatest(lo, F.col("head") + 1))).alias("k"))
    counted = inside.groupBy("window").agg(F.sum("n").alias("n_target"), F.sum("k").alias("n_kept"))
    total = laid.agg(F.sum("n_tokens")).first()[0] or 0  # one row
    every = laid.sparkSession.range(max(0, (total - 1) // block)).withColumnRenamed("id", "window")
    return every.join(counted, "window", "left").select("window", F.coalesce("n_target", F.lit(0)).cast("bigint").alias("n_target"), F.coalesce("n_kept", F.lit(0)).cast("bigint").alias("n_kept"))


def counters(made: DataFrame, most: int) -> DataFrame:
    """One row: examples kept, truncated and dropped, dropped tokens, tokens and targets kept."""
    kept = ~F.col("dropped")
    return made.agg(
        F.count_if(kept).alias("n_examples"), F.count_if("truncated").alias("n_truncated"), F.count_if("dropped").alias("n_dropped"), (F.count_if("dropped") * most).alias("n_dropped_tokens"),
        F.coalesce(F.sum(F.when(kept, F.col("n_tokens"))), F.lit(0)).alias("n_tokens"), F.coalesce(F.sum(F.when(kept, F.col("n_target"))), F.lit(0)).alias("n_target"),
    )


def fit_history(conversations: DataFrame, block: int, reserve: int) -> DataFrame:
    """(conv_id, dropped, n_prompt): the oldest two turns go until the prompt and what is reserved fit, or one or fewer
    are left. Costs are bytes of role and content with four marks a turn, and a header of eleven behind them."""
    c = deduplicated(conversations.select("conv_id", "messages", "received_at")).where("messages is not null")
    said = F.filter("messages", lambda m: m["role"].isin("user", "assistant"))
    cost = F.transform(said, lambda m: F.octet_length(F.coalesce(m["content"], F.lit(""))) + F.octet_length(m["role"]) + 4)
    rows = c.select("conv_id", cost.alias("cost"))
    total = F.aggregate("cost", F.lit(0), lambda x, y: x + y)
    after = lambda s: total - F.aggregate(F.slice("cost", F.lit(1), s), F.lit(0), lambda x, y: x + y) + 12
    n = F.size("cost")
    starts = F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1, F.lit(2))
    first = F.array_min(F.filter(starts, lambda s: (after(s) + reserve <= block) | (n - s <= 1)))
    last = F.array_max(starts)  # with two turns left that do not fit, both go
    cut = F.coalesce(first, F.least(last + 2, n))
    return rows.select("conv_id", cut.cast("bigint").alias("dropped"), after(cut).cast("bigint").alias("n_prompt"))
