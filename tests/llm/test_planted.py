"""Planted cases of mixes, pieces and kinds of text."""

import random

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import mix, quality, split
from corpusloom.sources import table

SF = "/root/testdata/sf0.001"


def test_shortfalls_are_where_the_share_exceeds_the_limit():
    r = np.random.default_rng(2)
    for _ in range(200):
        n = int(r.integers(1, 7))
        w, limits, total = r.dirichlet(np.ones(n)), r.integers(0, 60, n).astype(float), int(r.integers(1, 200))
        own = mix.own_exponents(w, limits, total)
        assert ((own > 0) == (w * total > limits)).all() and (own <= 1).all()


def test_planted_mix(spark):
    docs = [(k, "m", " Big " if k % 2 else "big", f"text {k}", "train") for k in range(20)] + [(100 + k, "m", "small", "t" * (k + 1), "train") for k in range(3)]
    docs += [(200, "m", "small", " ", "train"), (201, "m", "small", None, "train"), (202, "m", "small", "x", "val"), (203, "other", "small", "x", "train"), (204, None, None, "x", "train")]
    d = spark.createDataFrame(docs, "doc_id bigint, dataset_name string, source string, text string, split string").withColumn("size", F.lit("clash")).withColumn("rank", F.lit(1))
    specs = spark.createDataFrame([("s", "m", 20, 1), ("open", "m", None, 1)], "spec_name string, dataset_name string, n_train_docs bigint, seed bigint")
    parts = spark.createDataFrame([("s", 0, "BIG", 5, 0.5, 2), ("s", 1, "small", None, 0.4, 2), ("s", 2, "none", None, 0.1, 3), ("s", 3, "chat", None, None, 1), ("open", 0, "big", None, 1.0, 1)], "spec_name string, part_no int, config string, cap bigint, weight double, max_repeats int")
    got = {r["config"]: r for r in mix.shares(d, mix.plan_mix(d, specs, parts)).collect()}
    assert {k for k, r in got.items() if r["short"]} == {"small", "none"} and set(got) == {"big", "small", "none"}
    assert [got[k]["records"] for k in ("big", "small", "none")] == [10, 6, 0] and got["small"]["bytes"] == 2 * (1 + 2 + 3)
    assert abs(sum(r["byte_share"] for r in got.values()) - 1) < 1e-9


def test_overlap_begins_with_a_word_and_is_reported(spark):
    text = "Alpha beta gamma delta. Epsilon zeta eta theta iota. Kappa lambda mu nu xi."
    parts = split.pieces([text], 40, 12)
    raw = text.encode()
    assert len(parts) > 1 and all(back == 0 or raw[a - 1 : a].isspace() for a, _, back in parts) and any(back for _, _, back in parts)
    whole = "x" * 30 + "."  # a first sentence that fills the limit stays whole though an overlap is asked for
    assert split.pieces([whole + " Second one."], 32, 10)[0][:2] == (0, 32)
    specs = spark.createDataFrame([("s", 20)], "spec_name string, max_example_tokens bigint")
    d = spark.createDataFrame([(1, "word " * 20, "s"), (1, "word " * 20, "s")], "doc_id bigint, text string, render_spec string").withColumn("start", F.lit("clash"))
    c = spark.createDataFrame([(1, [("user", "a" * 15), ("assistant", "b" * 15)], "s")], "conv_id bigint, messages array<struct<role: string, content: string>>, render_spec string")
    items = split.items_of(d, c)
    pieces = split.split_oversized(items, specs, overlap=64).cache()
    assert {r["overlap_used"] for r in pieces.collect()} == {16}
    assert all(r["within"] for r in split.coverage(pieces, items, specs).collect())
    turns = [(r["first_turn"], r["last_turn"]) for r in pieces.where("item_table = 'conversations'").orderBy("piece").collect()]
    assert turns[0][0] == 0 and turns[-1][1] == 1


def test_mixed_texts_are_what_most_of_them_is(spark):
    r = random.Random(4)
    prose = [x["text"] for x in table(spark, SF, "documents").where("lang = 'en' and length(text) > 900 and source = 'web-dedup'").orderBy("doc_id").limit(8).collect()]
    entries = lambda n: "\n".join(f"- {r.choice(('red', 'green', 'small', 'old'))} {r.choice(('apples', 'lamps', 'boats', 'nails'))}" for _ in range(n))
    rows = "\n".join(f"{k};{r.randint(1, 99)};{r.randint(1, 999) / 10};{r.choice(('new', 'used'))}" for k in range(40))
    made = [(70_000 + k, p[:700].rsplit(".", 1)[0] + ".\n" + entries(6), "prose") for k, p in enumerate(prose[:4])]
    made += [(71_000 + k, p[:150].rsplit(" ", 1)[0] + ".\n" + entries(60), "list") for k, p in enumerate(prose[:4])]
    made += [(72_000, rows, "table"), (72_001, "9f3a 77b1c0de 0x4411 e2 ab99 17 cc03 d4e5f6 " * 12, "junk"), (72_002, None, None), (72_003, "", None), (72_004, "short text", None)]
    d = table(spark, SF, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([m[:2] for m in made], "doc_id bigint, text string")).withColumn("distance", F.lit("clash"))
    got = {x["doc_id"]: x["kind"] for x in quality.quality(d, table(spark, SF, "common_words")).where("doc_id >= 70000").collect()}
    assert got == {k: kind for k, _, kind in made}


def test_many_common_words_are_sent_as_hashes(spark):
    h = quality.Hashed({"the", "and"})
    assert "the" in h and "river" not in h and "x" not in quality.Hashed(set())
