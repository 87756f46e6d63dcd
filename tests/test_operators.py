"""Small fixtures with known answers, and brute force."""

import hashlib
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.sampling import band_windows
from corpusloom.operators import bpe, chat, evaluation, packing, stream, tokenizer, tokens
from corpusloom.operators.ranking import spread_rank
from corpusloom.plans import registry
from corpusloom.sources import read_prompts, store

MESSAGES = "conv_id bigint, messages array<struct<role: string, content: string>>, received_at timestamp"


def turns(spark, *messages):
    return spark.createDataFrame([(i, m, None) for i, m in enumerate(messages)], MESSAGES)


def test_strip_specials_reaches_a_fixpoint(spark):
    d = spark.createDataFrame([("<|im_<|endoftext|>start|>hi",), ("<|reserved_28|>a<|reserved_29|>",), ("",), ("|>|>",)], "t string")
    assert [r[0] for r in d.select(T.strip_specials(F.col("t"))).collect()] == ["hi", "a<|reserved_29|>", "", "|>|>"]


def test_fold_system(spark):
    c = turns(spark, [("system", "S"), ("user", "U"), ("assistant", "A")], [("system", "S"), ("assistant", "A"), ("user", "U")], [("system", None), ("user", None)], [], None)
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.folded(c).collect()}
    assert got == {0: [("user", "S\n\nU"), ("assistant", "A")], 1: [("assistant", "A"), ("user", "U")], 2: [("user", "")], 3: []}


def test_split_truncate_and_drop(spark):
    long = "x" * 100
    c = turns(spark, [("user", "u"), ("assistant", "a"), ("user", "odd")], [("user", long), ("assistant", "a")], [("user", "u"), ("assistant", long)], [("user", "u"), ("assistant", "a")] * 3)
    rows = {(r["conv_id"], r["chunk"]): r for r in chat.examples(chat.folded(c), 50).collect()}
    assert rows[0, 0]["n_tokens"] == 1 + (1 + 4 + 4) + (1 + 9 + 4) and not rows[0, 0]["truncated"]
    assert rows[1, 0]["dropped"] and rows[2, 0]["truncated"] and rows[2, 0]["n_tokens"] == 50
    assert [rows[3, k]["n_tokens"] for k in (0, 1)] == [47, 24]
    n = chat.counters(chat.examples(chat.folded(c), 50), 50).first()
    assert (n["n_dropped"], n["n_dropped_tokens"], n["n_truncated"]) == (1, 50, 1)


def test_history_keeps_the_last_turns(spark):
    c = turns(spark, [("user", "x" * 40), ("assistant", "y" * 40), ("user", "q")], [("user", "x" * 400)], [], [("user", "x" * 400), ("assistant", "y")])
    got = {r["conv_id"]: r["dropped"] for r in chat.fit_history(c, 60, 10).collect()}
    assert got == {0: 2, 1: 0, 2: 0, 3: 2}


def brute_first_fit(lengths, block):
    room, bins = [], []
    for k in sorted(lengths, reverse=True):
        for i, r in enumerate(room):
            if r >= k:
                room[i] -= k
                bins[i].append(k)
                break
        else:
            room.append(block - k)
            bins.append([k])
    return bins


def test_first_fit_runs_equal_brute_force():
    r = random.Random(0)
    for _ in range(60):
        block = r.choice((7, 20, 64))
        lengths = [r.randint(1, block) for _ in range(r.randint(0, 80))]
        hist = {k: lengths.count(k) for k in set(lengths)}
        made: dict[int, list[int]] = {}
        spread = {k: [] for k in hist}
        for k, rank, first, each in packing.first_fit(hist, block):
            spread[k].append((rank, first, each))
        for k, runs in spread.items():
            runs.sort()
            for (rank, first, each), nxt in zip(runs, [*[x[0] for x in runs[1:]], hist[k]]):
                for i in range(rank, nxt):
                    made.setdefault(first + (i - rank) // each, []).append(k)
        assert [sorted(made[i], reverse=True) for i in sorted(made)] == brute_first_fit(lengths, block)


def test_spread_rank_equals_row_number(spark):
    d = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("k"))
    a = spread_rank(d, ["k"], F.md5(F.col("id").cast("string")), ties=["id"], buckets=16)
    rows = a.collect()
    import hashlib

    for k in ("hot", None):
        want = sorted((r["id"] for r in rows if r["k"] == k), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        assert [r["id"] for r in sorted((r for r in rows if r["k"] == k), key=lambda r: r["rank"])] == want


def test_windows_equal_a_flat_cut(spark):
    d = spark.createDataFrame([(i, "é" * (i % 7) + "x" * (i * 13 % 90)) for i in range(40)], "doc_id bigint, text string")
    laid = stream.layout(d)
    ids = {r["doc_id"]: r["ids"] for r in stream.byte_ids(d).collect()}
    flat = [t for r in sorted(laid.collect(), key=lambda r: r["rank"]) for t in ids[r["doc_id"]]]
    got = sorted(stream.samples(stream.windows(d, laid, 32), 32).collect(), key=lambda r: r["window"])
    assert len(got) == (len(flat) - 1) // 32
    for r in got:
        w = r["window"] * 32
        x, seg, k = flat[w : w + 32], [], 0
        for t in x:
            k += t == 0
            seg.append(k)
        assert r["x"] == x and r["y"] == flat[w + 1 : w + 33] and r["seg"] == seg


def test_bpe_counts_overlap_and_round_trip(spark):
    d = spark.createDataFrame([(1, "aaa aaa"), (2, "hello world — café 🙂"), (3, ""), (4, "a")], "doc_id bigint, text string")
    chunks = bpe.chunk_counts(d)
    pairs = {(r["left"], r["right"]): r["n"] for r in bpe.pair_counts(chunks).collect()}
    assert pairs[97, 97] == 4
    merges = bpe.train(chunks, 10)
    assert merges[0] == (97, 97)
    e = bpe.encode(d, merges)
    assert {r["doc_id"]: r["ids"] for r in e.collect()}[3] == []
    assert {r["doc_id"]: r["text"] for r in bpe.decode(e, merges).collect()} == {r["doc_id"]: r["text"] for r in d.collect()}
    assert bpe.merged([97, 97, 97], (97, 97), 256) == [256, 97] and bpe.merged([97], (97, 97), 256) == [97]


def brute_merges(chunks, merges):
    held, out = [(list(c.encode()), n) for c, n in chunks], []
    for _ in range(merges):
        count = {}
        for x, n in held:
            for p in zip(x, x[1:]):
                count[p] = count.get(p, 0) + n
        if not count:
            break
        best = min(count, key=lambda p: (-count[p], p))
        out.append(best)
        held = [(bpe.merged(x, best, 255 + len(out)), n) for x, n in held]
    return out


def test_bpe_training_equals_brute_force_here_and_on_the_cluster(spark):
    r = random.Random(1)
    words = sorted({"".join(r.choice("abcé") for _ in range(r.randint(1, 8))) for _ in range(25)})
    chunks = [(w, r.randint(1, 9)) for w in words]
    want = brute_merges(chunks, 30)
    d = spark.createDataFrame(chunks, "chunk string, n bigint")
    assert bpe.train(d, 30) == want and bpe.train(d, 30, local=0) == want
    assert bpe.train(d.limit(0), 5) == [] and bpe.train(spark.createDataFrame([("a", 3), (None, 2)], "chunk string, n bigint"), 5) == []
    made = {p: 256 + i for i, p in enumerate(want)}
    for w in words:
        x = list(w.encode())
        for i, p in enumerate(want):
            x = bpe.merged(x, p, 256 + i)
        assert bpe.encode_chunk(w.encode(), made) == x


def test_bpe_training_holds_few_bytes_a_token(spark, monkeypatch):
    monkeypatch.setattr(bpe, "PART", 16, raising=False)  # small parts, as a small table has them
    r = random.Random(2)
    chunks = sorted({"".join(r.choice("abcdefghij") for _ in range(r.randint(6, 30))) for _ in range(40_000)})
    d = spark.createDataFrame([(c, r.randint(1, 3)) for c in chunks], "chunk string, n bigint")
    tracemalloc.start()
    try:
        merges = bpe.train(d, 60)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(merges) == 60 and peak < 60 * sum(map(len, chunks))


def many_words(spark):
    r = random.Random(3)
    texts = [(i, " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(6, 30))) for _ in range(100))) for i in range(300)]
    return texts, spark.createDataFrame(texts, "doc_id bigint, text string")


def driver_peak(make):
    tracemalloc.start()
    try:
        return make(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_bpe_encode_query_holds_few_bytes_a_token_on_the_driver(spark, monkeypatch):
    texts, d = many_words(spark)
    monkeypatch.setattr(bpe, "PART", 16, raising=False)
    monkeypatch.setattr(registry, "MERGES", 40)
    monkeypatch.setattr(registry, "_docs", lambda *_: d)
    e, peak = driver_peak(lambda: registry.QUERIES["bpe_encode"](spark, ""))
    assert peak < 60 * sum(len(t) for _, t in texts)
    made = {p: 256 + i for i, p in enumerate(bpe.train(bpe.chunk_counts(d), 40))}
    ids = {r["doc_id"]: r["ids"] for r in e.collect()}
    assert len(ids) == 300 and all(ids[k] == [x for c in bpe._CHUNK.findall(t) for x in bpe.encode_chunk(c.encode(), made)] for k, t in texts[:5])


def test_bpe_round_trip_query_holds_few_bytes_a_token_on_the_driver(spark, monkeypatch):
    texts, d = many_words(spark)
    monkeypatch.setattr(bpe, "PART", 16, raising=False)
    monkeypatch.setattr(registry, "MERGES", 40)
    monkeypatch.setattr(registry, "_docs", lambda *_: d)
    back, peak = driver_peak(lambda: registry.QUERIES["bpe_roundtrip"](spark, ""))
    assert peak < 60 * sum(len(t) for _, t in texts)
    assert {r["doc_id"]: r["text_md5"] for r in back.collect()} == {k: hashlib.md5(t.encode()).hexdigest() for k, t in texts}


def test_bpe_round_trip_decodes_without_an_object_an_id():
    vocab = pa.array([bytes([i]) for i in range(256)] + [b"ab", "é".encode()], pa.large_binary())
    lists = [[], [256, 97], [257, 10, 256], [195], [195, 169, 255]]
    x = pa.array([None, *lists], pa.list_(pa.int32())).slice(1)
    assert bpe.texts(x, vocab).to_pylist() == ["", "aba", "é\nab", "\ufffd", "é\ufffd"]
    assert bpe.texts(x.slice(1, 2), vocab).to_pylist() == ["aba", "é\nab"] and bpe.texts(x.slice(0, 0), vocab).to_pylist() == [] and bpe.texts(x.slice(0, 1), vocab).to_pylist() == [""]
    r, n = random.Random(7), 200_000
    many = pa.array([[r.randint(97, 122) for _ in range(n)], [256] * n], pa.list_(pa.int32()))
    back, peak = driver_peak(lambda: bpe.texts(many, vocab))
    assert back.type == pa.string() and back[1].as_py() == "ab" * n and len(back[0].as_py()) == n and peak < 2 * n


def test_bpe_encode_takes_chunks_together():
    r = random.Random(6)
    words = ["", "a", "aaaaa", "aaaaaa", "ab" * 40, "é" * 70, *("".join(r.choice("aabcé") for _ in range(r.randint(1, 90))) for _ in range(400))]
    merges = brute_merges([(w, r.randint(1, 9)) for w in words[:60]], 60)
    made = {p: 256 + i for i, p in enumerate(merges)}
    for m in (made, {}):
        flat, size = bpe.encode_chunks([w.encode() for w in words], m)
        ends = size.cumsum()
        assert [flat[e - n : e].tolist() for e, n in zip(ends, size)] == [bpe.encode_chunk(w.encode(), m) for w in words]
    assert bpe.encode_chunks([], made)[0].tolist() == [] and bpe.encode_chunks([b"ab" * 40], made)[0].tolist() == bpe.encode_chunk(b"ab" * 40, made)
    texts = [None, "", " \n", *(" ".join(r.choices(words, k=r.randint(1, 6))) for _ in range(100))]
    e = bpe._Encoder(made)
    want = [[x for c in bpe._CHUNK.findall(t or "") for x in bpe.encode_chunk(c.encode(), made)] for t in texts]
    assert e.lists(pa.array(texts[:50])).to_pylist() + e.lists(pa.array(texts[50:])).to_pylist() == want
    e.known.update((str(i) * 9, i) for i in range(len(e.known), 500_001))  # forgotten when there are too many
    assert e.lists(pa.array(texts)).to_pylist() == want and len(e.known) < 1000 and e.lists(pa.array([], pa.string())).to_pylist() == []


def test_bpe_rounds_keep_the_order_of_merges_and_hand_over(spark, monkeypatch):
    runs = [("aaa", 100), ("cd", 90)]  # what "aa" leaves is more frequent than "cd"
    assert bpe.train(spark.createDataFrame(runs, "chunk string, n bigint"), 3, local=0) == brute_merges(runs, 3) == [(97, 97), (256, 97), (99, 100)]
    r = random.Random(5)
    chunks = [(w, r.randint(1, 9)) for w in sorted({"".join(r.choice("abcdé") for _ in range(r.randint(1, 12))) for _ in range(40)})]
    d, want, apart, left = spark.createDataFrame(chunks, "chunk string, n bigint"), brute_merges(chunks, 40), bpe._train_apart, []

    def rounds(*args):
        state, tokens, out = apart(*args, keep=2)
        left.append((tokens, len(out)))
        return state, tokens, out

    monkeypatch.setattr(bpe, "_train_apart", rounds)
    assert bpe.train(d, 40, local=230) == want
    assert 0 < left[0][0] <= 230 and 0 < left[0][1] < 40


def test_rounds_stop_where_merges_touch():
    assert bpe._apart([(9, 1, 2), (8, 3, 4), (7, 2, 5), (6, 7, 8)]) == [(1, 2), (3, 4)]
    assert bpe._apart([(9, 1, 2), (7, 3, 4), (7, 2, 5)]) == [(1, 2)] and bpe._apart([(3, 1, 1), (2, 4, 5)]) == [(1, 1), (4, 5)] and bpe._apart([]) == []


def test_tokenizer_files_and_ids(spark, tmp_path):
    t = tokenizer.train(spark, spark.createDataFrame([("abab abab ab|>",)], "text string"), 260)
    t.save(str(tmp_path / "t.json"))
    assert tokenizer.load(str(tmp_path / "t.json")) == t and t.n_vocab == 260 and t.encode_text("") == [] and t.encode_text("a") == [97]
    assert t.special_id("abab") > 255 and t.fingerprint != tokenizer.Trained((), 256).fingerprint and len(t.fingerprint) == 8
    with pytest.raises(KeyError):
        t.special_id("<|im_end|>")
    with pytest.raises(ValueError):
        t.sep_id("\n<|endoftext|>\n")
    (tmp_path / "x.json").write_text('{"vocab": 1}')
    with pytest.raises(ValueError, match="vocab"):
        tokenizer.load(str(tmp_path / "x.json"))
    assert tokenizer.Declared().sep_id("\n<|endoftext|>\n") == 0 and tokenizer.Declared().n_vocab == 288
    (tmp_path / "p.json").write_text('{"prompts": ["a", "b"]}')
    assert [tuple(r) for r in read_prompts(spark, str(tmp_path / "p.json")).collect()] == [(0, "a"), (1, "b")]


META = {"pack": "flat", "has_target": False, "has_start": False, "vocab_size": 288, "tokenizer_fingerprint": "f", "sep_id": 0, "pack_block": None}


def test_a_corpus_exists_when_its_meta_does(spark, tmp_path):
    root, d = str(tmp_path), spark.createDataFrame([(1, "aa"), (2, "b")], "doc_id bigint, text string")
    laid = stream.layout(d)
    rows = stream.byte_ids(d).join(laid, "doc_id")
    with pytest.raises(store.MissingCorpus):
        store.read(spark, root, "c")
    with pytest.raises(ValueError):
        store.write(rows, root, "c", {"x": float("nan")})
    rows.write.parquet(f"{root}/c/tokens")  # an interrupted build: tokens, but no meta
    assert not store.exists(spark, root, "c") and store.build(spark, root, {"c": lambda: (rows, META)}) == ["c"] and store.build(spark, root, {"c": lambda: (rows, META)}) == []
    assert store.read(spark, root, "c").count() == 2 and store.read_meta(spark, root, "c") == META
    store.sort_by_length(spark, root, "c", "s")
    assert store.read_meta(spark, root, "s")["sorted_from"] == "c" and [r[1] for r in store.read_meta(spark, root, "s")["length_index"]][-1] == sum(r["n"] for r in store.read(spark, root, "s").collect()) + 1
    with pytest.raises(ValueError):
        store.sort_by_length(spark, root, "s", "t")
    assert [n for n, e, _ in store.inspect(spark, root, ["c", "t"]) if e] == ["c"]
    assert [n for n, _ in store.prune(spark, root, ["c"])] == ["s"] and store.prune(spark, root, ["c"], delete=True) and store.prune(spark, root, ["c"]) == []
    files = [f"{root}/c/meta.json"]
    wanted = store.manifest(spark, files)
    assert store.verify(spark, files, wanted).count() == 0 and store.verify(spark, files, wanted.withColumn("sha256", F.lit("0"))).count() == 1
    store.log_metrics(spark.createDataFrame([(1, 0.5)], "step int, loss double"), f"{root}/log")
    assert spark.read.csv(f"{root}/log", header=True).count() == 1


def test_incompatible_corpora_are_refused():
    ok = {"vocab_size": 288, "tokenizer_fingerprint": "f", "doc_mask": True, "block_size": 512}
    store.assert_compatible(META, **ok)
    packed = META | {"has_start": True, "pack": "bfd", "pack_block": 512}
    store.assert_compatible(packed, **ok)
    for meta, change in ((META, {"vocab_size": 1}), (META, {"tokenizer_fingerprint": "g"}), (packed, {"doc_mask": False}), (META | {"sep_id": None}, {}), (packed, {"block_size": 8})):
        with pytest.raises(ValueError):
            store.assert_compatible(meta, **(ok | change))


def test_packed_bins_pad_and_end(spark):
    a = [(1, 0, [0, 9, 9], [0, 1, 1], False), (2, 0, [0, 9, 9, 9, 9], [0, 0, 0, 0, 1], False), (3, 0, [0, 9], [0, 1], False), (4, 0, [0, 9, 9, 9], [0, 1, 1, 1], False)]
    got = {r["bin"]: (r["ids"], r["target"], r["start"]) for r in tokens.packed(spark.createDataFrame(a, tokens.ARRAYS), 7).collect()}
    assert [len(got[k][0]) for k in sorted(got)] == [7, 7, 1] and got[2] == ([3], [0], [1])
    assert got[0][2] == [1, 0, 0, 0, 0, 1, 0] and got[1][2] == [1, 0, 0, 0, 1, 0, 0]
    one = {r["bin"]: r["start"] for r in tokens.packed(spark.createDataFrame(a[:1], tokens.ARRAYS), 5).collect()}
    assert one == {0: [1, 0, 0, 1, 0], 1: [1]}


def test_masked_heads(spark):
    placed = spark.createDataFrame([(0, [0, 5, 5, 5, 5, 5], [0, 1, 1, 1, 1, 1]), (6, [0, 6, 6, 6, 6, 6, 6], [0, 0, 1, 1, 1, 1, 1])], "tok_offset bigint, ids array<smallint>, target array<tinyint>")
    got = {r["window"]: (r["x"], r["y"], r["seg"]) for r in tokens.masked_samples(placed, 4).collect()}
    assert got[0] == ([0, 5, 5, 5], [5, 5, 5, 5], [1, 1, 1, 1])
    assert got[1] == ([5, 5, 0, 6], [-100, -100, -100, 6], [0, 0, 1, 1])  # the head of a cut example is masked
    assert got[2] == ([6, 6, 6, 6], [-100] * 4, [0] * 4) and len(got) == 3  # no beginning, nothing to learn


def test_top_p(spark):
    p = spark.createDataFrame([("r", "a", 0.5), ("r", "b", 0.3), ("r", "c", 0.2)], "row_id string, token string, p double")
    assert {r["token"]: round(r["p"], 6) for r in evaluation.top_p(p, 0.6).collect()} == {"a": 0.625, "b": 0.375}


def test_repetition(spark):
    span = " ".join(f"w{i}" for i in range(20))
    d = spark.createDataFrame([(1, " ".join([span] * 3)), (2, " ".join([span] * 2)), (3, None)], "doc_id bigint, text string")
    assert {r["doc_id"]: r["looping"] for r in evaluation.repetition(d).collect()} == {1: True, 2: False, 3: False}


def test_bands():
    assert band_windows(None, None, 0.0, 10, 4) is None and band_windows(5, 17, 0.5, 10, 4) == (2, 4) and band_windows(5, None, 1.0, 10, 4) == (2, 10)
    for first, last, frac in ((1, 9, 1.5), (1, 9, 0.0), (None, 9, 0.5), (5, 6, 0.5)):
        with pytest.raises(ValueError):
            band_windows(first, last, frac, 10, 4)


def test_first_delivery_has_no_ties(spark):
    c = turns(spark, [("user", "a")]).unionAll(spark.createDataFrame([(0, [("user", "b")], None)], MESSAGES))
    assert len({chat.deduplicated(x).first()["messages"][0]["content"] for x in (c, c.orderBy(F.desc("messages")), c.repartition(3))}) == 1


def test_sessions_forget_from_the_front(spark):
    from corpusloom.streaming import session

    assert session.trimmed([50, 50, 10], 60, 10) == [10] and session.trimmed([400], 60, 10) == [400] and session.trimmed([], 60, 10) == []

    class State:
        exists, get = False, None

        def update(self, v):
            self.get, self.exists = v, True

    import pandas as pd

    state, run = State(), session.session(100, 10)
    rows = lambda *m: iter([pd.DataFrame([(7, i, r, c) for i, (r, c) in enumerate(m)], columns=["received", "at", "role", "content"])])
    assert next(run((1,), rows(("user", "hi"), ("assistant", "yo")), state)).iloc[0].tolist() == [1, 2, 2, 10 + 15 + 12]
    assert next(run((1,), rows(("user", "/reset"), ("user", "hi")), state)).iloc[0].tolist() == [1, 3, 1, 10 + 12]
    assert next(run((1,), rows(("user", "/quit"), ("user", "more")), state)).iloc[0].tolist() == [1, 3, 1, 10 + 12]
