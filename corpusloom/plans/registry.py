"""All queries over the core operators, by name."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.sampling import LR_DEFAULTS, lr_schedule as lr
from corpusloom.functions.sampling import band_windows
from corpusloom.operators import bpe, chat, evaluation, packing, stream, tokenizer, tokens
from corpusloom.operators.ranking import spread_rank
from corpusloom.session import ensure_checkpoint_dir
from corpusloom.sources import read_parts, store, table
from corpusloom.streaming import ingest, session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
BLOCK, CHAT_MAX, SEED = 512, 2048, 42
LATE = "3650 days"  # the tables are whole histories, read at once; a running stream would take days
MERGES = 32_000 - 256  # the default vocabulary without its bytes


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.lower(F.trim("source")).alias("config"), "text", "dataset_name", "shard")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.folded(table(spark, sf_dir, "conversations"))


@query
def scan_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("source is not null").select("doc_id", "source", "n_chars")


@query
def list_splits(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.lower(F.trim("source")).alias("config"), "split").agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), "config", "split")


@query
def shard_names(spark, sf_dir):
    return spark.range(16).select(F.col("id").alias("shard_no"), F.format_string("web-dedup/train-%05d-of-%05d.parquet", "id", F.lit(104)).alias("name"))


def _parts(spark, sf_dir):
    """The parts of every mix with the numbers of their spec: a fixed, small table."""
    specs = table(spark, sf_dir, "source_specs").select("spec_name", "dataset_name", "n_train_docs", "n_val_docs")
    parts = table(spark, sf_dir, "source_parts").where("weight is not null").select("spec_name", "part_no", F.lower(F.trim("config")).alias("config"), "cap")
    return parts.join(specs, "spec_name")


@query
def part_cap(spark, sf_dir):
    """Every part's documents in random order, as many as its cap allows."""
    rows = _docs(spark, sf_dir).select("doc_id", "dataset_name", "config").join(_parts(spark, sf_dir).select("spec_name", "part_no", "dataset_name", "config", "cap"), ["dataset_name", "config"])
    ranked = spread_rank(rows, ["spec_name", "part_no"], stream.digest("part", "spec_name", "part_no", "doc_id"), ties=["doc_id"])
    return ranked.where("cap is null or rank < cap").select("spec_name", F.col("part_no").cast("bigint").alias("part_no"), "doc_id", F.col("rank").cast("bigint").alias("rank"))


def _pool(spark, sf_dir):
    """(spec_name, doc_id, rank, n_val_docs, n_train_docs): the capped parts of each mix in one random order."""
    d = part_cap(spark, sf_dir).select("spec_name", "doc_id")
    ranked = spread_rank(d, ["spec_name"], stream.digest("pool", "spec_name", "doc_id"), ties=["doc_id"])
    return ranked.join(table(spark, sf_dir, "source_specs").select("spec_name", "n_val_docs", "n_train_docs"), "spec_name")


@query
def part_union(spark, sf_dir):
    parts = table(spark, sf_dir, "source_parts").join(table(spark, sf_dir, "source_specs").select("spec_name", "dataset_name"), "spec_name")
    parts = parts.where("weight is not null").select("spec_name", "part_no", "dataset_name", F.lower(F.trim("config")).alias("config"), "cap")
    rows = _docs(spark, sf_dir).select("doc_id", "dataset_name", "config").join(parts, ["dataset_name", "config"])
    ranked = spread_rank(rows, ["spec_name", "part_no"], stream.digest("union", "spec_name", "doc_id"), ties=["doc_id"])
    return ranked.where("cap is null or rank < cap").groupBy("spec_name").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("config").alias("n_parts"))


@query
def pool_order(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id")
    return spread_rank(d, [], stream.digest("pool", "doc_id"), ties=["doc_id"]).select("doc_id", F.col("rank").cast("bigint").alias("rank"))


@query
def train_val_split(spark, sf_dir):
    """Of every mix: its first n_val_docs documents for validation, the next n_train_docs, or all, for training."""
    val = F.coalesce("n_val_docs", F.lit(0))
    r = _pool(spark, sf_dir).where((F.col("n_train_docs").isNull()) | (F.col("rank") < val + F.col("n_train_docs")))
    return r.select("spec_name", "doc_id", F.when(F.col("rank") < val, "val").otherwise("train").alias("part"))


@query
def tokenizer_sample(spark, sf_dir, n_docs: int = 10_000):
    """The documents a tokenizer is trained on: of every mix ``n_docs`` behind those of validation."""
    val = F.coalesce("n_val_docs", F.lit(0))
    return _pool(spark, sf_dir).where((F.col("rank") >= val) & (F.col("rank") < val + n_docs)).select("spec_name", "doc_id")


@query
def corpus_meta(spark, sf_dir):
    """What a flat corpus of all documents records of itself, in one pass."""
    size = _docs(spark, sf_dir).select(F.octet_length("text").alias("b"))
    t, b = F.sum(F.col("b") + 3), F.sum(F.col("b") + len(T.SEP))
    zero = F.lit(0).cast("bigint")
    own = tokenizer.Declared()
    return size.agg(
        t.alias("n_tokens"), t.alias("n_real_tokens"), zero.alias("n_pad_tokens"), b.alias("n_bytes"), F.round(t / b, 6).alias("tokens_per_byte"), F.lit(own.n_vocab).cast("bigint").alias("vocab_size"), F.lit(own.fingerprint).alias("tokenizer_fingerprint"),
        F.lit(own.sep_id(T.SEP)).cast("bigint").alias("sep_id"), F.round(F.count(F.lit(1)) / t, 6).alias("sep_frac"), F.count(F.lit(1)).alias("n_examples"), zero.alias("n_dropped"), zero.alias("n_dropped_tokens"), zero.alias("n_truncated"),
        F.lit(False).alias("has_target"), F.lit(False).alias("has_start"), F.lit("flat").alias("pack"),
    )


@query
def chat_meta(spark, sf_dir):
    """What a corpus of all conversations, packed into bins, records of itself."""
    turns = _turns(spark, sf_dir)
    made = chat.examples(turns, CHAT_MAX)
    counted = chat.counters(made, CHAT_MAX)
    bins = packing.ffd_pack(made.where("not dropped").select("conv_id", "chunk", "n_tokens"), ["conv_id", "chunk"], "n_tokens", stream.digest("pack", "conv_id", "chunk"), CHAT_MAX)
    n = bins.agg((F.coalesce(F.max("bin") + 1, F.lit(0)) * CHAT_MAX + 1).alias("total"))
    said = turns.where("size(turns) >= 2").agg(F.coalesce(F.sum(F.aggregate("turns", F.lit(0).cast("bigint"), lambda a, t: a + F.octet_length(t["content"]))), F.lit(0)).alias("n_bytes"))
    one = counted.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(said))  # one row each
    return one.select(
        F.col("total").alias("n_tokens"), F.col("n_tokens").alias("n_real_tokens"), (F.col("total") - F.col("n_tokens")).alias("n_pad_tokens"), "n_bytes", F.round(F.col("n_tokens") / F.nullif("n_bytes", F.lit(0)), 6).alias("tokens_per_byte"),
        "n_examples", "n_dropped", "n_dropped_tokens", "n_truncated", F.round(F.col("n_target") / F.col("total"), 6).alias("target_frac"), F.lit(True).alias("has_target"), F.lit(True).alias("has_start"), F.lit("bfd").alias("pack"), F.lit(CHAT_MAX).cast("bigint").alias("pack_block"),
    )


@query
def render_pretrain(spark, sf_dir):
    return stream.byte_ids(_docs(spark, sf_dir)).select("doc_id", F.size("ids").cast("bigint").alias("n"), _md5("ids").alias("ids_md5"))


def _lengths(spark, sf_dir):
    return stream.lengths(stream.layout(_docs(spark, sf_dir)))


@query
def doc_lengths(spark, sf_dir):
    return _lengths(spark, sf_dir).select("doc_id", *(F.col(c).cast("bigint").alias(c) for c in ("rank", "start", "n")))


@query
def token_histogram(spark, sf_dir):
    return stream.token_histogram(stream.byte_ids(_docs(spark, sf_dir)))


@query
def sort_by_length(spark, sf_dir):
    return stream.sort_by_length(_lengths(spark, sf_dir)).select("doc_id", *(F.col(c).cast("bigint").alias(c) for c in ("n", "new_rank", "new_start")))


@query
def sort_verify(spark, sf_dir):
    """One row: how many lengths differ between the stream and its sorted form, and how many sorted documents do not begin where the one before ends; both must be 0."""
    d = _lengths(spark, sf_dir)
    s = stream.sort_by_length(d)
    a, b = d.groupBy("n").count(), s.groupBy("n").count()
    differ = a.exceptAll(b).union(b.exceptAll(a)).agg(F.count(F.lit(1)).alias("histogram_differs"))
    bounds = s.groupBy("n").agg(F.min("new_start").alias("lo"), F.max(F.col("new_start") + F.col("n")).alias("hi"), F.countDistinct("new_start").alias("starts"), F.count(F.lit(1)).alias("rows"))
    gaps = bounds.withColumn("prev", F.lag("hi").over(Window.orderBy("n"))).agg(F.coalesce(F.sum(((F.col("lo") != F.coalesce("prev", F.lit(1))) | (F.col("starts") != F.col("rows"))).cast("bigint")), F.lit(0)).alias("gaps"))
    return differ.crossJoin(F.broadcast(gaps))


@query
def length_index(spark, sf_dir):
    return stream.length_index(_lengths(spark, sf_dir))


def _offsets(spark, sf_dir, bounds):
    """(asked, token_offset): where documents of that many tokens or more begin in the sorted stream, else its end."""
    index = length_index(spark, sf_dir)
    total = _docs(spark, sf_dir).agg(F.sum(F.octet_length("text") + 3).alias("total"))
    asked = spark.createDataFrame([(x,) for x in bounds], "asked bigint")
    found = asked.join(F.broadcast(index), F.col("min_tokens") >= F.col("asked"), "left").groupBy("asked").agg(F.min_by("token_offset", "min_tokens").alias("at"))  # at most 205 marks
    return found.crossJoin(F.broadcast(total)).select("asked", F.coalesce("at", "total").alias("token_offset"))


@query
def token_offset(spark, sf_dir):
    return _offsets(spark, sf_dir, (1, 700, 1500, 5000, 1_000_000_000))


@query
def band_docs(spark, sf_dir):
    index = length_index(spark, sf_dir)
    total = _docs(spark, sf_dir).agg(F.sum(F.octet_length("text") + 3).alias("total"))
    bands = spark.createDataFrame([("short", 0, 700), ("middle", 700, 1500), ("long", 1500, 1_000_000_000)], "band string, lo bigint, hi bigint")
    off = lambda c: F.min_by("token_offset", F.when(F.col("min_tokens") >= F.col(c), F.col("min_tokens")))
    got = bands.crossJoin(F.broadcast(index)).groupBy("band", "lo", "hi").agg(off("lo").alias("t0"), off("hi").alias("t1")).crossJoin(F.broadcast(total))
    at = got.select("band", F.coalesce("t0", "total").alias("t0"), F.coalesce("t1", "total").alias("t1"))
    near = lambda t, c: F.min_by(c, F.struct(F.abs(F.col("token_offset") - F.col(t)), F.col("min_tokens")))
    ends = at.crossJoin(F.broadcast(index)).groupBy("band").agg(near("t0", "doc_offset").alias("d0"), near("t0", "token_offset").alias("o0"), near("t1", "doc_offset").alias("d1"), near("t1", "token_offset").alias("o1"))
    return ends.select("band", (F.col("d1") - F.col("d0")).alias("n_docs"), F.round((F.col("o1") - F.col("o0")) / F.nullif(F.col("d1") - F.col("d0"), F.lit(0)), 6).alias("mean_tokens"))


def _windows(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return stream.windows(d, stream.layout(d), BLOCK)


def _samples(spark, sf_dir):
    return stream.samples(_windows(spark, sf_dir), BLOCK)


def _md5(c: str):
    return F.md5(F.concat_ws(",", F.col(c).cast("array<string>")))


@query
def window_cut(spark, sf_dir):
    return _samples(spark, sf_dir).select(F.col("window").cast("bigint").alias("window"), _md5("x").alias("x_md5"), _md5("y").alias("y_md5"))


@query
def segment_ids(spark, sf_dir):
    return _samples(spark, sf_dir).select(F.col("window").cast("bigint").alias("window"), _md5("seg").alias("seg_md5"))


@query
def window_stats(spark, sf_dir):
    s = stream.segment_counts(_windows(spark, sf_dir), BLOCK)
    return s.agg(F.count(F.lit(1)).alias("n_windows"), F.round(F.avg("segments") + 1, 6).alias("segs_per_window"))


@query
def attention_pairs(spark, sf_dir):
    return stream.segment_counts(_windows(spark, sf_dir), BLOCK).select("window", "pairs")


def _epochs(spark, sf_dir, epochs=2, seed=SEED):
    n = stream.n_windows(_docs(spark, sf_dir), BLOCK)
    rows = spark.range(n * epochs).select((F.col("id") / F.lit(max(n, 1))).cast("bigint").alias("epoch"), (F.col("id") % F.lit(max(n, 1))).alias("window"))
    r = spread_rank(rows, ["epoch"], stream.digest("epoch", "epoch", "window", seed=seed), ties=["window"])
    return r.select("epoch", F.col("rank").cast("bigint").alias("pos"), "window")


@query
def epoch_order(spark, sf_dir):
    """Windows in the order of two epochs, resumed behind the first 100 of epoch 0."""
    return _epochs(spark, sf_dir).where("epoch > 0 or pos >= 100")


@query
def shard_slices(spark, sf_dir):
    return _epochs(spark, sf_dir, 1).where("pos % 8 = 3").select("pos", "window")


@query
def replacement_sample(spark, sf_dir):
    n = _docs(spark, sf_dir).agg((F.sum(F.octet_length("text") + 3) - BLOCK).alias("n"))
    draws = spark.range(1000).crossJoin(F.broadcast(n))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(SEED)), F.lit("draw"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("bigint")
    return draws.select(F.col("id").alias("draw"), (h % F.col("n")).alias("offset"))


@query
def special_block(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(T.special_block())), "id bigint, name string").withColumn("reserved", T.is_reserved(F.col("name")))


@query
def strip_specials(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("<|im_<|endoftext|>start|>"), "text").alias("text"))
    return d.select("doc_id", F.md5(T.strip_specials(F.col("text"))).alias("text_md5"))


@query
def fold_system(spark, sf_dir):
    joined = F.concat_ws("|", F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["content"])))
    return _turns(spark, sf_dir).where("size(turns) >= 2").select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.md5(joined).alias("turns_md5"))


@query
def chat_spans(spark, sf_dir):
    s = _turns(spark, sf_dir).where("size(turns) >= 2").select("conv_id", T.chat_spans(F.col("turns")).alias("spans"))
    return s.select("conv_id", F.size("spans").cast("bigint").alias("n_spans"), F.md5(F.concat_ws("", F.transform("spans", lambda x: x["text"]))).alias("text_md5"), F.size(F.filter("spans", lambda x: x["is_target"])).cast("bigint").alias("n_target"))


@query
def span_concat(spark, sf_dir):
    """Conversations of which the bytes of the spans, one after another, are not those of the joined text; must be 0."""
    s = _turns(spark, sf_dir).where("size(turns) >= 1").select(T.chat_spans(F.col("turns")).alias("spans"))
    apart = F.concat_ws("", F.transform("spans", lambda x: F.hex(F.encode(x["text"], "UTF-8"))))
    joined = F.hex(F.encode(F.concat_ws("", F.transform("spans", lambda x: x["text"])), "UTF-8"))
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_if(apart != joined).alias("differing"))


@query
def render_prompt(spark, sf_dir):
    return _turns(spark, sf_dir).where("size(turns) >= 1").select("conv_id", F.md5(T.render_prompt(F.col("turns"))).alias("prompt_md5"))


@query
def split_turns(spark, sf_dir):
    return chat.split_turns(_turns(spark, sf_dir), CHAT_MAX)


@query
def render_chat(spark, sf_dir):
    return chat.examples(_turns(spark, sf_dir), CHAT_MAX)


@query
def truncate_drop(spark, sf_dir):
    return chat.counters(chat.examples(_turns(spark, sf_dir), CHAT_MAX), CHAT_MAX)


@query
def ffd_pack(spark, sf_dir):
    e = chat.examples(_turns(spark, sf_dir), CHAT_MAX).where("not dropped").select("conv_id", "chunk", "n_tokens")
    return packing.ffd_pack(e, ["conv_id", "chunk"], "n_tokens", stream.digest("pack", "conv_id", "chunk"), CHAT_MAX)


@query
def chunk_freq(spark, sf_dir):
    return bpe.chunk_counts(_docs(spark, sf_dir))


@query
def bpe_pair_counts(spark, sf_dir):
    return bpe.pair_counts(bpe.chunk_counts(_docs(spark, sf_dir))).orderBy(F.desc("n"), "left", "right")


@query
def bpe_train_merges(spark, sf_dir):
    return bpe.merges_table(spark, bpe.train(bpe.chunk_counts(_docs(spark, sf_dir)), MERGES))


@query
def bpe_encode(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return bpe.encode(d, bpe.train(bpe.chunk_counts(d), MERGES))


@query
def bpe_roundtrip(spark, sf_dir):
    d = _docs(spark, sf_dir)
    merges = bpe.train(bpe.chunk_counts(d), MERGES)
    return bpe.decode(bpe.encode(d, merges), merges).select("doc_id", F.md5("text").alias("text_md5"))


@query
def repetition_rate(spark, sf_dir):
    return evaluation.repetition(_docs(spark, sf_dir)).agg(F.round(F.sum(F.col("looping").cast("int")) / F.greatest(F.lit(1), F.count(F.lit(1))), 6).alias("rate"), F.count(F.lit(1)).alias("n"))


@query
def mc_items(spark, sf_dir):
    return evaluation.mc_items(table(spark, sf_dir, "eval_items"))


@query
def mc_accuracy(spark, sf_dir):
    """The bytes of an option scored by a digest in place of a model's token log-probability."""
    items = evaluation.mc_items(table(spark, sf_dir, "eval_items"))
    options = items.select("item_id", "answer", F.posexplode("options").alias("option", "text"))
    each = options.select("item_id", "answer", F.col("option").cast("bigint").alias("option"), F.explode(F.sequence(F.lit(1), F.octet_length("text"))).alias("at"))
    scored = each.select("item_id", "answer", "option", (-F.conv(F.substring(F.md5(F.concat_ws("|", "item_id", "option", "at")), 1, 6), 16, 10).cast("bigint")).alias("logp"))
    return evaluation.mc_accuracy(scored)


@query
def top_p_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang is not null and dataset_name is not null")
    n = d.groupBy("dataset_name", "lang").agg(F.count(F.lit(1)).alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("dataset_name")))
    return evaluation.top_p(p.select(F.col("dataset_name").alias("row_id"), F.col("lang").alias("token"), "p"), 0.9).withColumn("p", F.round("p", 6))


@query
def decode_batches(spark, sf_dir):
    prompts = _turns(spark, sf_dir).where("size(turns) >= 1").select("conv_id", F.octet_length(T.render_prompt(F.col("turns"))).cast("bigint").alias("n_tokens"))
    return evaluation.decode_batches(prompts, 256, 32_000)


@query
def fit_history(spark, sf_dir):
    return chat.fit_history(table(spark, sf_dir, "conversations"), CHAT_MAX, 256)


@query
def lr_schedule(spark, sf_dir):
    return lr(spark, **LR_DEFAULTS)


@query
def token_budget(spark, sf_dir):
    r = evaluation.latest_runs(table(spark, sf_dir, "run_history")).where("world_size is not null and tokens_seen is not null")
    per = F.lit(16 * 1024) * F.col("world_size") * 4
    return r.select("run_id", per.cast("bigint").alias("tokens_per_update"), F.greatest(F.lit(1), F.bround(F.col("tokens_seen") / per)).cast("bigint").alias("steps"))


@query
def run_history(spark, sf_dir):
    r = evaluation.latest_runs(table(spark, sf_dir, "run_history"))
    w = Window.partitionBy("corpus.name").orderBy("started_at", "run_id")
    return r.select(
        "run_id", F.col("corpus.name").alias("corpus_name"), F.row_number().over(w).cast("bigint").alias("pos"), F.sum("tokens_seen").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("tokens_so_far"),
        F.round(F.col("val_loss") * F.col("tokens_per_byte") / math.log(2), 6).alias("bpb"),
    )


@query
def corpus_hash(spark, sf_dir):
    """Eight hex digits of the live fields of every render spec."""
    r = table(spark, sf_dir, "render_specs")
    own = F.when(F.col("kind") == "chat", F.concat_ws(",", "messages_column", F.coalesce(F.col("max_example_tokens").cast("string"), F.lit("none")))).otherwise(F.col("text_column"))
    live = F.concat_ws("|", "kind", "sep", "pack", F.coalesce(F.col("pack_block").cast("string"), F.lit("none")), own)
    return r.select("spec_name", F.substring(F.sha2(live, 256), 1, 8).alias("hash"))


@query
def prune_orphans(spark, sf_dir):
    """Shards of documents that no part names, with their rows and bytes."""
    live = table(spark, sf_dir, "source_parts").select(F.explode("shards").alias("shard")).distinct()
    found = _docs(spark, sf_dir).where("shard is not null").groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.octet_length("text")).alias("n_bytes"))
    return found.join(live, "shard", "left_anti")


def _band(spark, sf_dir, lo: int, hi: int, frac: float):
    """(windows, first and behind the last window of the band of documents of lo to hi tokens)."""
    ends = {r["asked"]: r["token_offset"] for r in _offsets(spark, sf_dir, (lo, hi)).collect()}  # two rows
    n = stream.n_windows(_docs(spark, sf_dir), BLOCK)
    return n, *band_windows(ends[lo], ends[hi], frac, n, BLOCK)


@query
def band_order(spark, sf_dir, frac: float = 0.25):
    """One epoch over the stream sorted by length in which windows of 700 to 1500 token documents take a quarter. All of
    it would be the band alone; nothing comes again before its pool is through."""
    n, lo, hi = _band(spark, sf_dir, 700, 1500, frac)
    size = {True: hi - lo, False: n - (hi - lo)}
    total = hi - lo if frac >= 1 else int(size[False] / (1 - frac))
    want = {True: total if frac >= 1 else int(total * frac)}
    want[False] = total - want[True]
    before, upto = (F.least(F.lit(want[True]), F.floor(x * F.lit(min(frac, 1.0)))) for x in (F.col("pos"), F.col("pos") + 1))
    slots = spark.range(total).withColumnRenamed("id", "pos").select("pos", (upto > before).alias("in_band"), F.when(upto > before, before).otherwise(F.col("pos") - before).alias("k"))
    pools = []
    for inside in (True, False):
        passes = -(-want[inside] // max(1, size[inside]))
        rows = spark.range(size[inside] * passes).select((F.col("id") % F.lit(max(1, size[inside]))).alias("i"), (F.col("id") / F.lit(max(1, size[inside]))).cast("bigint").alias("rep"))
        window = F.col("i") + lo if inside else F.when(F.col("i") < lo, F.col("i")).otherwise(F.col("i") + (hi - lo))
        pools.append(rows.select(window.alias("window"), F.lit(inside).alias("in_band"), F.lit(size[inside]).alias("size"), "rep"))
    ranked = spread_rank(pools[0].unionByName(pools[1]), ["in_band", "rep"], stream.digest("band", "in_band", "rep", "window"), ties=["window"])
    drawn = ranked.select("in_band", (F.col("rep") * F.col("size") + F.col("rank")).alias("k"), "window")
    return slots.join(drawn, ["in_band", "k"]).select("pos", "in_band", "window")


@query
def bpe_merge_step(spark, sf_dir):
    """Chunks after the first merge; a merged pair shows as z, any other byte as x and its code."""
    chunks = bpe.chunk_counts(_docs(spark, sf_dir))
    best = bpe.pair_counts(chunks).orderBy(F.desc("n"), "left", "right").limit(1).select(F.concat(*(part for c in ("left", "right") for part in (F.lit("x"), F.lpad(F.hex(c), 2, "0")))).alias("pair"))
    coded = chunks.select("chunk", F.regexp_replace(F.hex(F.encode("chunk", "UTF-8")), "(..)", "x$1").alias("coded"))
    return coded.crossJoin(F.broadcast(best)).select("chunk", F.replace("coded", "pair", F.lit("z")).alias("merged"))


@query
def stream_parts(spark, sf_dir):
    return ingest.once(ingest.part_counters(ingest.first_deliveries(ingest.read(spark, sf_dir, "conversations"), LATE)))


@query
def stream_weeks(spark, sf_dir):
    got = ingest.once(ingest.document_counters(ingest.read(spark, sf_dir, "documents"), LATE))
    return got.select(F.unix_seconds("week").alias("week"), "n_docs", "n_bytes")


@query
def window_masked(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    kept = chat.examples(turns, CHAT_MAX).where("not dropped").select("conv_id", "chunk", "n_tokens")
    laid = stream.ordered(kept, stream.digest("chat", "conv_id", "chunk"), F.col("n_tokens"), ties=("conv_id", "chunk"))
    return chat.masked_windows(laid, chat.target_spans(turns, CHAT_MAX), BLOCK)


@query
def chat_arrays(spark, sf_dir):
    a = tokens.chat_arrays(_turns(spark, sf_dir), CHAT_MAX)
    return a.select("conv_id", "chunk", F.size("ids").cast("bigint").alias("n"), _md5("ids").alias("ids_md5"), _md5("target").alias("target_md5"), "truncated")


@query
def packed_stream(spark, sf_dir):
    p = tokens.packed(tokens.chat_arrays(_turns(spark, sf_dir), CHAT_MAX), CHAT_MAX)
    return p.select("bin", _md5("ids").alias("ids_md5"), _md5("target").alias("target_md5"), _md5("start").alias("start_md5"))


@query
def window_targets(spark, sf_dir):
    """Windows of the flat chat stream with the next tokens that are to be learnt; -100 stands for any other."""
    a = tokens.chat_arrays(_turns(spark, sf_dir), CHAT_MAX)
    laid = stream.ordered(a.select("conv_id", "chunk", F.size("ids").alias("n_tokens")), stream.digest("chat", "conv_id", "chunk"), F.col("n_tokens"), ties=("conv_id", "chunk"))
    placed = a.join(laid.select("conv_id", "chunk", "tok_offset"), ["conv_id", "chunk"])
    return tokens.masked_samples(placed, BLOCK).select("window", _md5("x").alias("x_md5"), _md5("y").alias("y_md5"), _md5("seg").alias("seg_md5"))


@query
def batch_merge(spark, sf_dir):
    """Counters of all batches as one, each batch as it was received first; batches without examples or drops count nothing."""
    b = table(spark, sf_dir, "rendered_batches")
    w = Window.partitionBy("batch_id", "worker").orderBy(F.col("received_at").asc_nulls_last(), F.col("finished_at").asc_nulls_last())
    first = b.withColumn("__n", F.row_number().over(w)).where("__n = 1 and (coalesce(n_examples, 0) > 0 or coalesce(n_dropped, 0) > 0)")
    names = ("n_examples", "n_dropped", "n_dropped_tokens", "n_bytes", "n_pad", "n_truncated")
    return first.agg(F.count(F.lit(1)).alias("n_batches"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names))


def _corpus_root(spark) -> str:
    import uuid

    return f"{ensure_checkpoint_dir(spark)}/corpora-{uuid.uuid4().hex}"


@query
def stored_scan(spark, sf_dir):
    """The flat corpus of all documents, written, committed and read again."""
    root, d = _corpus_root(spark), _docs(spark, sf_dir)
    laid = stream.layout(d).select("doc_id", "rank", "tok_offset")
    store.write(stream.byte_ids(d).join(laid, "doc_id"), root, "flat", corpus_meta(spark, sf_dir).first().asDict())
    return store.read(spark, root, "flat").select("doc_id", "rank", F.col("tok_offset").cast("bigint").alias("tok_offset"), _md5("ids").alias("ids_md5"))


@query
def stored_sort(spark, sf_dir):
    """The flat corpus sorted by length without encoding again: rows are moved, checked, and committed under a new name."""
    root, d = _corpus_root(spark), _docs(spark, sf_dir)
    laid = stream.layout(d)
    meta = corpus_meta(spark, sf_dir).first().asDict()
    store.write(stream.byte_ids(d).join(laid.select("doc_id", "n_tokens", "rank", "tok_offset"), "doc_id"), root, "flat", meta)
    store.sort_by_length(spark, root, "flat", "sorted")
    return store.read(spark, root, "sorted").select("doc_id", *(F.col(c).cast("bigint").alias(c) for c in ("n", "new_rank", "new_start")), F.size("ids").cast("bigint").alias("n_ids"))


@query
def corpus_names(spark, sf_dir):
    """Corpora by name before any is built: spec, part and hash of the render spec."""
    names = corpus_hash(spark, sf_dir).crossJoin(spark.createDataFrame([("train",), ("val",)], "part string"))  # two rows
    return names.select("spec_name", "part", F.concat_ws("-", "spec_name", "part", "hash").alias("name"))


@query
def preset_lookup(spark, sf_dir):
    """Source presets: data set, seed, columns and the number of parts."""
    parts = table(spark, sf_dir, "source_parts").groupBy("spec_name").agg(F.count(F.lit(1)).alias("n_parts"))
    return table(spark, sf_dir, "source_specs").join(parts, "spec_name", "left").select("spec_name", "dataset_name", "seed", F.concat_ws(",", "column_list").alias("columns"), F.coalesce("n_parts", F.lit(0)).alias("n_parts"))


@query
def window_seeds(spark, sf_dir):
    """Seeds of window sampling by source: its own for training, one far from it for validation."""
    return table(spark, sf_dir, "source_specs").select("spec_name", F.col("seed").alias("train_seed"), (F.col("seed") + 10_000).alias("val_seed"))


@query
def val_order(spark, sf_dir):
    """The order of windows that validation reads."""
    return _epochs(spark, sf_dir, 1, SEED + 10_000).select("pos", "window")


@query
def window_batches(spark, sf_dir, batch: int = 16):
    """Batches of windows in the order of an epoch; the last one may be smaller."""
    b = _epochs(spark, sf_dir, 1).select(F.floor(F.col("pos") / batch).alias("batch"), "pos", "window")
    return b.groupBy("batch").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("pos", "window"))), lambda x: x["window"].cast("string"))).alias("windows"))


@query
def epoch_steps(spark, sf_dir):
    """Steps of one to three epochs over the corpus, and the windows of a clean pass over it."""
    n = _docs(spark, sf_dir).agg(F.sum(F.octet_length("text") + 3).alias("n"))
    per = F.lit(16 * 512)
    return spark.range(1, 4).crossJoin(F.broadcast(n)).select(F.col("id").alias("epochs"), F.greatest(F.lit(1), F.bround(F.col("n") * F.col("id") / per)).cast("bigint").alias("steps"), F.greatest(F.lit(1), F.floor(F.floor((F.col("n") - 1) / BLOCK) / 16)).cast("bigint").alias("clean_pass"))


@query
def expected_segments(spark, sf_dir):
    """Segments expected in a window where a quarter of the draws is from the middle band, the rest from the short one."""
    mean = band_docs(spark, sf_dir).where("band in ('short', 'middle')").select("band", (F.lit(BLOCK) / F.greatest(F.lit(1.0), F.coalesce("mean_tokens", F.lit(1.0))) + 1).alias("s"))
    return mean.agg(F.round(F.sum(F.when(F.col("band") == "middle", 0.25).otherwise(0.75) * F.col("s")), 4).alias("expected"))


@query
def human_counts(spark, sf_dir):
    """Counts as people read them."""
    n = table(spark, sf_dir, "rendered_batches").select("batch_id", "n_bytes").distinct()
    scaled = F.when(F.coalesce("n_bytes", F.lit(0)) == 0, "-")
    for scale, suffix in ((10**9, "B"), (10**6, "M"), (10**3, "K")):
        scaled = scaled.when(F.col("n_bytes") >= scale, F.concat(F.replace(F.format_number(F.col("n_bytes") / scale, 2), F.lit(","), F.lit("")), F.lit(suffix)))
    return n.select("batch_id", "n_bytes", scaled.otherwise(F.col("n_bytes").cast("string")).alias("shown"))


@query
def mc_answer_start(spark, sf_dir, block: int = 256):
    """Where the score of an option begins when a question and it are cut from the front to a window."""
    o = table(spark, sf_dir, "eval_items").select("item_id", F.octet_length("question").alias("q"), "question", F.posexplode("choices.text").alias("option", "text"))
    whole = F.octet_length(F.concat_ws(" ", "question", "text"))
    n_ctx = F.greatest(F.lit(0), F.col("q") - F.greatest(F.lit(0), whole - block))
    return o.select("item_id", F.col("option").cast("bigint").alias("option"), n_ctx.cast("bigint").alias("n_ctx"), F.greatest(F.lit(0), n_ctx - 1).cast("bigint").alias("first"))


@query
def format_compliance(spark, sf_dir, cap: int = 256):
    """Of the last answers of all conversations, cut at ``cap`` bytes, how many stop and in which ways others fail."""
    c = chat.deduplicated(table(spark, sf_dir, "conversations").select("conv_id", "messages", "received_at"))
    last = F.element_at(F.filter("messages", lambda m: (m["role"] == "assistant") & m["content"].isNotNull()), -1)["content"]
    texts = c.where(F.exists("messages", lambda m: (m["role"] == "assistant") & m["content"].isNotNull())).select(F.col("conv_id").alias("doc_id"), last.alias("text"))
    return evaluation.format_compliance(texts, cap)


@query
def tokenizer_ids(spark, sf_dir):
    """The byte profile: ids, separator and fingerprint."""
    t = tokenizer.Declared()
    return spark.createDataFrame([(t.n_vocab, t.sep_id(T.SEP), t.special_id(T.IM_END), t.fingerprint)], "n_vocab bigint, sep_id bigint, end_id bigint, fingerprint string")


@query
def shard_scan(spark, sf_dir):
    """An explicit list of files in place of a table, projected."""
    return read_parts(spark, [f"{sf_dir.rstrip('/')}/documents.parquet"], ["doc_id", "lang"])


@query
def loss_share(spark, sf_dir):
    """Windows of the flat chat stream, and the share of their next tokens that are learnt."""
    a = tokens.chat_arrays(_turns(spark, sf_dir), CHAT_MAX)
    laid = stream.ordered(a.select("conv_id", "chunk", F.size("ids").alias("n_tokens")), stream.digest("chat", "conv_id", "chunk"), F.col("n_tokens"), ties=("conv_id", "chunk"))
    s = tokens.masked_samples(a.join(laid.select("conv_id", "chunk", "tok_offset"), ["conv_id", "chunk"]), BLOCK)
    learnt = F.size(F.filter("y", lambda t: t != tokens.MASKED))
    return s.agg(F.count(F.lit(1)).alias("n_windows"), F.round(F.sum(learnt) / (F.count(F.lit(1)) * BLOCK), 6).alias("frac_loss_tokens"))


@query
def shard_concat(spark, sf_dir, shards: int = 8):
    """Documents dealt to shards in turn, and the shards' outputs one after another; places follow from the sizes of the
    shards before, so nothing is sorted again."""
    n = pool_order(spark, sf_dir).count()
    before = [0]
    for k in range(shards):
        before.append(before[-1] + (n - k + shards - 1) // shards)
    shard = F.col("rank") % shards
    base = F.element_at(F.array(*(F.lit(x) for x in before)), (shard + 1).cast("int"))
    return pool_order(spark, sf_dir).select("doc_id", shard.alias("shard"), (base + F.floor(F.col("rank") / shards)).cast("bigint").alias("pos"))


@query
def notebook_split(spark, sf_dir, train: int = 10_000, held_out: int = 200):
    """The small split of an interactive run: documents to train on, and a few behind them to test."""
    r = pool_order(spark, sf_dir).where(F.col("rank") < train + held_out)
    return r.select("doc_id", F.when(F.col("rank") < train, "train").otherwise("held_out").alias("part"))


@query
def chat_sessions(spark, sf_dir):
    """Messages of all conversations as a stream into sessions that keep what fits a window."""
    return session.turns_kept(session.messages(ingest.read(spark, sf_dir, "conversations")), CHAT_MAX, 256)
