"""Training-data operators: brute force, round trips, held-out accuracy and edge cases on small fixtures."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import binpack, encode, leakage, mix, neardup, pairs, pretokenize, quality, split
from corpusloom.llm.words import Ids, common_in_order, words
from corpusloom.sources import table

SF = "/root/testdata/sf0.001"
NEEDS_VOCABULARY = pytest.mark.skipif(not os.path.exists(encode.VOCABULARY), reason="no vocabulary files")
STRANGE = [None, "", " ", "\n\t ", "a", "Don't we'll I've 's ''s", "x" * 5000, "é́漢字かな🙂‍", "<|endoftext|> is text", "  two  spaces \n\n end ", "1½ 2024 ٣", "\x1c\x85\xa0", "a'll'b"]


@pytest.fixture(scope="module")
def enc():
    return encode.Encoder(encode.read_ranks(), pretokenize.class_table())


# 6 encoding


@NEEDS_VOCABULARY
def test_encoding_equals_the_public_library(enc):
    import tiktoken

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=encode.read_ranks(), special_tokens={})
    r = random.Random(1)
    texts = STRANGE + ["".join(r.choice("a's tmdrevlL'  \n\t1½中!?é\x85🙂") for _ in range(r.randint(0, 40))) for _ in range(3000)]
    ids, bound, at, char = enc.encode(texts)
    for i, t in enumerate(texts):
        assert ids[bound[i] : bound[i + 1]].tolist() == other.encode_ordinary(t or ""), repr(t)


@NEEDS_VOCABULARY
def test_encoding_round_trip_and_offsets(spark):
    d = spark.createDataFrame([(i, t, "clash", [1]) for i, t in enumerate(STRANGE)], "doc_id bigint, text string, size string, ids array<int>")
    rows = {r["doc_id"]: r for r in encode.encode_documents(d, offsets=True).collect()}
    ranks = encode.read_ranks()
    for i, t in enumerate(STRANGE):
        assert encode.decode(rows[i]["ids"], ranks) == (t or "")
        edge = [*rows[i]["slice_id"], len(rows[i]["ids"])]
        parts = [encode.decode(rows[i]["ids"][a:b], ranks) for a, b in zip(edge, edge[1:])]
        assert "".join(parts) == (t or "") and [len("".join(parts[:k])) for k in range(len(parts))] == rows[i]["slice_char"]
    assert encode.encode_documents(d.limit(0)).count() == 0


def test_long_merges_equal_short_ones():
    ranks = encode.read_ranks()
    for text in ("ab" * 300, "the quick brown fox" * 20, "aaaaaaaaab" * 40):
        piece = text.encode()
        long, encode.LONG = encode.LONG, 1 << 30
        short = encode.merge(piece, ranks)
        encode.LONG = long
        assert encode._merge_long(piece, ranks) == short


def test_states_by_scan_equal_a_plain_walk():
    r = np.random.default_rng(0)
    y = r.integers(0, 9, 5000).astype(np.uint8)
    s, want = 0, []
    for k in y:
        want.append(s)
        s = int(pretokenize.STEP[k, s])
    assert pretokenize.states(y, 64).tolist() == want


# 7 bins


def test_bins_hold_every_item_once(spark):
    r = random.Random(2)
    sizes = [None if i % 50 == 0 else r.choice((0, 5, 100, 100, 100, r.randint(1, 2048), 5000)) for i in range(1500)]
    d = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, size bigint").fillna(0, ["size"])
    rows = binpack.fill_bins(d, rounds=60).collect()
    load, got = {}, {}
    for x in rows:
        got.setdefault(x["doc_id"], []).append((x["piece"], x["start"], x["size"]))
        assert (x["bin"] is None) == (x["size"] == 0)
        if x["size"]:
            load[x["bin"]] = load.get(x["bin"], 0) + x["size"]
    assert max(load.values()) <= 2048 and len(load) <= 1.03 * -(-sum(load.values()) // 2048)
    for i, s in enumerate(sizes):
        p = sorted(got[i])
        assert sum(x[2] for x in p) == (s or 0) and [x[1] for x in p] == [2048 * k for k in range(len(p))]
    assert binpack.fill_bins(d.limit(0)).count() == 0
    assert binpack.fill_report(binpack.fill_bins(d.where("size = 100"), rounds=20)).first()["filled"] > 0.9


def test_pricing_equals_brute_force():
    from itertools import product

    sizes, values, most = np.array([9, 7, 4]), np.array([5.0, 3.9, 2.0]), np.array([2, 2, 3])
    best = max((sum(c * v for c, v in zip(x, values)) for x in product(range(3), range(3), range(4)) if sum(c * s for c, s in zip(x, sizes)) <= 24))
    a = binpack.price(sizes, values, most, 24)
    assert (a <= most).all() and a @ sizes <= 24 and abs(a @ values - best) < 1e-9


# 3 splitting


@pytest.mark.parametrize("limit,overlap", [(40, 8), (100, 0), (7, 6), (2, 1), (300, 64)])
def test_pieces_cover_the_text(limit, overlap):
    r = random.Random(limit)
    for _ in range(30):
        turns = ["".join(r.choice(("word ", "Satz. ", "\n", "\n\n", "漢字。", "é", "x" * 30, "🙂")) for _ in range(r.randint(0, 60))) for _ in range(r.randint(1, 3))]
        raw = "".join(turns).encode()
        at = 0
        for a, b, back in split.pieces(turns, limit, overlap):
            assert b - a <= max(limit, 4) and a + back == at and back <= overlap
            raw[a:b].decode()
            at = b
        assert at == len(raw)


def test_split_prefers_natural_boundaries(spark):
    text = "First sentence here. Second one follows.\n\nA new paragraph begins. It ends here."
    assert [text.encode()[a:b].decode() for a, b, _ in split.pieces([text], 50, 0)] == ["First sentence here. Second one follows.\n\n", "A new paragraph begins. It ends here."]
    specs = spark.createDataFrame([("s", 10), ("open", None)], "spec_name string, max_example_tokens bigint")
    docs = spark.createDataFrame([(1, "0123456789", "s"), (2, "0123456789a", "s"), (3, "x" * 99, "open"), (4, None, "s"), (5, "y" * 99, None)], "doc_id bigint, text string, render_spec string")
    m = "conv_id bigint, messages array<struct<role: string, content: string>>, render_spec string"
    convs = spark.createDataFrame([(1, [("user", "12345"), ("assistant", "678901")], "s"), (1, [("user", "12345"), ("assistant", "678901")], "s"), (2, None, "s"), (3, [("user", None)], "s")], m)
    rows = split.split_oversized(split.items_of(docs, convs), specs, overlap=2).collect()
    assert {(r["item_table"], r["item_id"]) for r in rows} == {("documents", 2), ("conversations", 1)}
    assert len({(r["item_table"], r["item_id"], r["piece"]) for r in rows}) == len(rows)


# 4 mixing


def test_tempering_respects_limits_and_targets():
    t, q = mix.budgets(np.array([0.5, 0.3, 0.2]), np.array([100.0, 100.0, 100.0]), 100)
    assert t == 0 and q.tolist() == [50, 30, 20]
    t, q = mix.budgets(np.array([0.5, 0.3, 0.2]), np.array([20.0, 100.0, 100.0]), 100)
    assert 0 < t < 1 and q.sum() == 100 and q[0] <= 20
    assert mix.budgets(np.array([0.5, 0.5]), np.array([0.0, 10.0]), 100)[1].tolist() == [0, 10]
    assert mix.budgets(np.array([1.0]), np.array([0.0]), 5)[1].tolist() == [0]


def test_mix_keeps_its_promises(spark):
    d, s, p = (table(spark, SF, t) for t in ("documents", "source_specs", "source_parts"))
    plan = mix.plan_mix(d, s, p)
    want = {(r["spec_name"], r["part_config"]): r for r in plan.collect()}
    rows = mix.realise(d, plan).collect()
    used: dict = {}
    for r in rows:
        k = (r["spec_name"], r["config"])
        used.setdefault(k, []).append(r)
    for k, r in want.items():
        got = used.get(k, [])
        assert len(got) == r["quota"] and sorted(x["slot"] for x in got) == list(range(r["quota"]))
        docs: dict = {}
        for x in got:
            docs[x["doc_id"]] = docs.get(x["doc_id"], 0) + 1
        assert len(docs) <= r["available"] and max(docs.values(), default=0) <= r["max_repeats"]
    for spec in {k[0] for k in want}:
        total = sum(r["quota"] for k, r in want.items() if k[0] == spec)
        n = next(r["n_train_docs"] for k, r in want.items() if k[0] == spec)
        assert total == min(n, sum(r["limit"] for k, r in want.items() if k[0] == spec))
    assert mix.plan_mix(d.limit(0), s, p).where("available > 0").count() == 0


# 5 near duplicates


def brute_in_order(a, b):
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
    return n[-1][-1]


def test_common_subsequence_equals_brute_force():
    r = np.random.default_rng(3)
    for _ in range(50):
        a, b = r.integers(0, 6, r.integers(0, 30)).astype(np.uint32), r.integers(0, 6, r.integers(0, 30)).astype(np.uint32)
        assert common_in_order(a, b) == brute_in_order(a.tolist(), b.tolist())


def test_cross_split_pairs_equal_brute_force(spark):
    d = table(spark, SF, "documents")
    base = d.where("text is not null").limit(60).collect()
    copy = [(10_000 + r["doc_id"], "<p>" + r["text"].upper().replace(" ", "  ") + "</p>", "test" if r["split"] == "train" else "train") for r in base[:8]]
    extra = spark.createDataFrame([*copy, (1, None, "val"), (2, "", "val")], "doc_id bigint, text string, split string")
    both = d.select("doc_id", "text", "split").unionByName(extra).withColumn("bands", F.lit("clash"))
    got = {(r["train_id"], r["eval_id"]) for r in neardup.cross_split_pairs(both).collect()}
    number = Ids()
    rows = [(r["doc_id"], r["split"], number(r["text"])) for r in both.collect() if r["split"] in ("train", "val", "test")]
    rows = [x for x in rows if len(x[2]) >= 20]
    want = set()
    for i, s, x in rows:
        for j, t, y in rows:
            if s == "train" and t != "train" and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and common_in_order(x, y) >= 0.8 * max(len(x), len(y)):
                want.add((i, j))
    assert got == want and len(got) >= 5
    assert neardup.cross_split_pairs(both.where("split = 'train'")).count() == 0


def test_words_forget_forms():
    assert words("<b>Stra&szlig;e</b> CAFÉ, café!") == ["strasse", "cafe", "cafe"] and words("漢字 ab") == ["漢", "字", "ab"] and words(None) == []


# 2 leaks


def test_alignment():
    q = np.arange(1, 13, dtype=np.uint32)
    assert leakage.align(q, q) == 12 and leakage.align(q, np.concatenate([[99], q[:6], [77], q[7:], [98]]).astype(np.uint32)) == 11
    assert leakage.align(q, np.array([50, 60, 70], np.uint32)) == 0


def test_planted_leaks_are_found(spark):
    d = table(spark, SF, "documents").select("doc_id", "text", "split").where("split = 'train'")
    items = table(spark, SF, "eval_items").orderBy("item_id").limit(30)
    asked = items.select("item_id", "question").collect()[:6]
    filler = d.where("length(text) > 900").limit(6).collect()
    planted = []
    for k, (q, f) in enumerate(zip(asked, filler)):
        w = q["question"].split()
        w[len(w) // 2] = "something"
        planted.append((90_000 + k, f["text"][:400] + "\n\n" + "  ".join(w).upper() + " " + f["text"][400:], "train"))
    more = d.unionByName(spark.createDataFrame([*planted, (95_000, None, "train"), (95_001, asked[0]["question"], "val")], "doc_id bigint, text string, split string"))
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(more, items).collect()}
    assert {(90_000 + k, q["item_id"]) for k, q in enumerate(asked)} <= got and not any(i == 95_001 for i, _ in got)
    assert leakage.leaks(more.limit(0), items).count() == 0 and leakage.leaks(more, items.limit(0)).count() == 0


# 8 quality


KNOWN = {
    "prose": "The old river moved past the town while most people were asleep. Nobody had seen the boat before, and it was gone by the morning. " * 1,
    "list": "- red apples\n- green pears\n- 12 plums\n- cherries (sour)\n- brown nuts\n- raisins\n- black grapes\n- dates\n- figs (dried)\n- wild berries",
    "table": "name;size;price\nlamp;12;3.50\nchair;44;19.00\ntable;80;45.10\nshelf;120;60.00\nmirror;50;22.75\ncarpet;200;99.95\ncurtain;180;35.00\ndesk;75;130.00",
    "junk": "7eca3802 25 9d821d02 ab5d ff3e5102 fa dbc90af4 f6 82c1 c232 42af1415 9ff9 d9ca9908 7c af c029e210 f77b6c1d 94 452a a16c5dc5 3b 85 e4",
}


def test_kinds_of_text(spark):
    prose = table(spark, SF, "documents").select("doc_id", "text")
    rows = [*((90_000 + i, t) for i, t in enumerate(KNOWN.values())), (95_000, None), (95_001, " \n"), (95_002, "short"), (95_003, "ab " * 400), (95_004, "x" * 100_000)]
    d = prose.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string")).withColumn("kind", F.lit("clash"))
    got = {r["doc_id"]: r for r in quality.quality(d, table(spark, SF, "common_words")).where("doc_id >= 90000").collect()}
    assert [got[90_000 + i]["kind"] for i in range(4)] == list(KNOWN)
    assert [got[i]["kind"] for i in (95_000, 95_001, 95_002, 95_003, 95_004)] == [None, None, None, "junk", "junk"]
    assert got[95_000]["n_words"] == 0 and got[95_000]["distance"] is None
    r = got[90_001]
    assert abs(sum(r["contributions"]) - r["distance"]) < 1e-6 * r["distance"] and len(r["contributions"]) == len(quality.STATS)
    assert quality.quality(d.limit(0), table(spark, SF, "common_words")).count() == 0


# 1 pairs


@pytest.mark.parametrize("text,seen", [(None, False), ("", False), (" ﻿‍", False), ("<p></p>", False), ("<|im_end|>", False), ("...", False), ("&nbsp;", False), ("```\n```", False), ("—", False), ("7", True), ("No.", True), ("好", True)])
def test_readable(text, seen):
    assert pairs.readable(text) is seen


def test_pair_defects_held_out(spark):
    c = table(spark, "/root/testdata/sf0.01", "conversations")
    model = pairs.fit(c, 1500)
    assert all(p > 0.93 and r > 0.8 for p, r in model.held_out.values()), model.held_out
    q = "Can you explain why the river carries the boats?"
    a = "The river flows down to the sea. Boats float on it because they are lighter than water."
    rows = [(q, a), (q, None), (q, q.upper()), (q, "I'm sorry, but I can't help with that."), (q, "Le fleuve porte les bateaux parce que le jardin est plus grand que la maison et les pierres."), (q, a + " The old harbor and the"), (None, a), (q, "Boats")]
    assert model.defects(rows) == [None, "empty", "copies_question", "refusal", "wrong_language", "truncated", None, None]
    assert model.defects([]) == []


def test_pairs_are_found_in_messages(spark):
    schema = "conv_id bigint, lang string, messages array<struct<role: string, content: string>>"
    m = [("system", "s"), ("user", "q"), ("assistant", ""), ("user", "q2"), ("tool", "x"), ("user", None), ("assistant", "a")]
    d = spark.createDataFrame([(1, "en", m), (2, None, []), (3, "en", None), (4, "en", [("user", "q")])], schema)
    assert [(r["conv_id"], r["turn"]) for r in pairs.exchanges(d).orderBy("turn").collect()] == [(1, 2), (1, 6)]
    assert [(r["conv_id"], r["turn"], r["defect"]) for r in pairs.defective(d.unionAll(d)).where("turn = 2").collect()] == [(1, 2, "empty")]
    assert pairs.defective(d.limit(0)).count() == 0
