"""Planted cases at the edge of the rules."""

import time

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import leakage, neardup
from corpusloom.llm.words import Ids
from corpusloom.sources import table

SF = "/root/testdata/sf0.001"


def edge_pairs(n_pairs):
    """(doc_id, text, split) of pairs of which 80 to 85 % of the words are kept: exchanged at random, each fifth exchanged, or dropped here and added there."""
    r = np.random.default_rng(11)
    rows = []
    for k in range(n_pairs):
        a = [f"w{x}" for x in r.integers(0, 1 << 30, int(r.integers(20, 400)))]
        new = iter(f"v{x}" for x in r.integers(0, 1 << 30, len(a)))
        b = list(a)
        if k % 3 == 0:
            for i in r.permutation(len(a))[: int(len(a) * r.uniform(0.15, 0.2))]:
                b[i] = next(new)
        elif k % 3 == 1:
            for i in range(4, len(a), 5):
                b[i] = next(new)
        else:
            b = [x for y in (w if i % 5 != 4 else None for i, w in enumerate(a)) if y for x in ([y, next(new)] if len(y) and r.random() < 0.2 else [y])]
            b = b if len(b) <= len(a) else a
        rows += [(2 * k, " ".join(a), "train"), (2 * k + 1, " ".join(b), "val")]
    return rows


def test_near_duplicates_at_the_edge_of_the_rule(spark):
    rows = edge_pairs(300)
    d = spark.createDataFrame(rows, "doc_id bigint, text string, split string")
    got = {(r["train_id"], r["eval_id"]): r["in_order"] for r in neardup.cross_split_pairs(d).collect()}
    assert len(got) >= 299 and all(b == a + 1 and s >= 0.8 for (a, b), s in got.items())
    assert sum(s < 0.86 for s in got.values()) >= 250


def test_counted_words_intersect_as_multisets():
    x, y = np.array([1, 1, 1, 2], np.uint32), np.array([3, 1, 1], np.uint32)
    assert len(np.intersect1d(neardup.placed(x, 0), neardup.placed(y, 0))) == 2 and len(np.unique(neardup.placed(x, 0))) == 4


def test_cuts_and_insertions_are_near_duplicates(spark):
    """A fifth cut off in front or behind, a stretch put in, a tenth cut and a tenth exchanged; of 20 to 3,000 words."""
    r, rows = np.random.default_rng(5), []
    for k in range(200):
        a = [f"w{x}" for x in r.integers(0, 1 << 30, int(np.exp(r.uniform(np.log(25), np.log(3000)))))]
        n, new = len(a), lambda m: [f"v{x}" for x in r.integers(0, 1 << 30, m)]
        c = int(n * 0.18)
        b = list(a)
        if k % 4 < 2:
            b = b[c:] if k % 4 else b[: n - c]
        elif k % 4 == 2:
            at = int(r.integers(0, n))
            b = b[:at] + new(int(n * 0.2)) + b[at:]
        else:
            b = b[n // 10 :]
            for i in r.permutation(len(b))[: int(n * 0.09)]:
                b[i] = new(1)[0]
        rows += [(2 * k, " ".join(a), "train"), (2 * k + 1, " ".join(b), "test")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, split string")
    got = {(x["train_id"], x["eval_id"]) for x in neardup.cross_split_pairs(d).collect()}
    assert len(got) >= 196 and all(b == a + 1 for a, b in got)


def test_report_counts_what_pairs_would(spark):
    d = table(spark, SF, "documents")
    some = d.where("text is not null and split = 'train'").orderBy("doc_id").limit(6)
    more = d.unionByName(some.withColumn("doc_id", F.col("doc_id") + 70_000).withColumn("split", F.lit("val"))).unionByName(some.withColumn("doc_id", F.col("doc_id") + 80_000)).unionByName(some.withColumn("doc_id", F.col("doc_id") + 90_000).withColumn("split", F.lit("test")).withColumn("source", F.lit(None).cast("string")))
    about = {r["doc_id"]: (r["split"], (r["source"] or "").strip().lower() or None) for r in more.collect()}
    want: dict = {}
    for r in neardup.cross_split_pairs(more).collect():
        x = want.setdefault(about[r["eval_id"]], (set(), set(), set()))
        x[0].add((r["train_id"], r["eval_id"])), x[1].add(r["eval_id"]), x[2].add(r["train_id"])
    got = {(r["split"], r["source"]): (r["pairs"], r["eval_docs"], r["train_docs"]) for r in neardup.overlap_report(more).collect()}
    assert got == {k: tuple(map(len, v)) for k, v in want.items()} and any(k[1] is None for k in got)


def test_part_leaks_of_short_questions(spark):
    """Half to six tenths of a short question, one word in ten exchanged, inside another text."""
    d = table(spark, SF, "documents").select("doc_id", "text", "split").where("split = 'train'")
    items = table(spark, SF, "eval_items")
    number, r = Ids(), np.random.default_rng(4)
    asked = [q for q in items.select("item_id", "question").orderBy("item_id").collect() if 24 <= len(number(q["question"])) <= 60]
    filler = [x["text"].split() for x in d.where("length(text) > 900").orderBy("doc_id").limit(40).collect()]
    planted, want = [], set()
    for k in range(120):
        q, f = asked[k % len(asked)], filler[k % len(filler)]
        w = q["question"].split()
        size = int(len(w) * r.uniform(0.57, 0.66)) + 1
        a = int(r.integers(0, len(w) - size + 1))
        part = w[a : a + size]
        for i in r.permutation(size)[: size // 10]:
            part[i] = "something"
        at = int(r.integers(0, len(f)))
        planted.append((90_000 + k, " ".join([*f[:at], *part, *f[at:]]), "train"))
        ids = number(q["question"])
        if 2 * leakage.align(ids, number(planted[-1][1])) >= len(ids):
            want.add((90_000 + k, q["item_id"]))
    more = d.unionByName(spark.createDataFrame(planted, "doc_id bigint, text string, split string"))
    for fit in (20_000, 40):
        got = {(x["doc_id"], x["item_id"]) for x in leakage.leaks(more, items, fit_documents=fit).collect()}
        assert len(want) >= 80 and want <= got, (fit, len(want), len(want & got))


def test_short_halved_and_padded_questions_leak(spark):
    """A question of 7 words, half of one of 14, one with an added word behind every fifth, and one with every sixth word exchanged."""
    d = table(spark, SF, "documents").select("doc_id", "text", "split").where("split = 'train'")
    filler = [x["text"].split() for x in d.where("length(text) > 900").orderBy("doc_id").limit(4).collect()]
    short = "seven quokkas juggle brass lanterns nearby tonight".split()
    half = "violet tapirs paint wooden trams while nine otters sing below granite arches during storms".split()
    long = [f"term{k}" for k in range(40)]
    padded = [x for k, w in enumerate(long) for x in ([w, "padding"] if k % 5 == 4 else [w])]
    swapped = [w if k % 6 != 5 else "other" for k, w in enumerate(long)]
    planted = [(90_000 + k, " ".join([*f[:50], *p, *f[50:]]), "train") for k, (f, p) in enumerate(zip(filler, (short, half[3:10], padded, swapped)))]
    items = spark.createDataFrame(
        [(1, "a", " ".join(short), None, None), (2, "a", " ".join(half), None, None), (3, "b", " ".join(long), None, None), (4, "b", " ".join(long), {"text": ["no", "yes"], "label": ["A", "B"]}, "B"), (5, None, "", None, None), (6, None, None, None, None)],
        "item_id bigint, dataset_name string, question string, choices struct<text: array<string>, label: array<string>>, answer_key string",
    )
    more = d.unionByName(spark.createDataFrame(planted, "doc_id bigint, text string, split string"))
    for words_each in (300_000, 30):  # one part, and one for nearly every item
        got = {(x["doc_id"], x["item_id"]) for x in leakage.leaks(more, items, part_words=words_each).where("how = 'stretch'").collect()}
        assert got == {(90_000, 1), (90_001, 2), (90_002, 3), (90_002, 4), (90_003, 3), (90_003, 4)}


def test_paraphrase_needs_order_and_answer():
    q = np.arange(40, dtype=np.int32)
    spread = np.array([x for k in range(40) for x in ((k, 99) if k % 2 else (k,))], np.int32)  # a word added behind every second
    assert leakage.judged(leakage.Question(q, 100), np.concatenate([spread, [77, 78]]).astype(np.int32), 0, 40, 12, [np.array([77, 78], np.int32)])[0] == "paraphrase"
    assert leakage.judged(leakage.Question(q, 100), spread, 0, 40, 12, [np.array([77, 78], np.int32)])[0] is None
    assert leakage.contains(np.array([1, 2, 3]), np.array([2, 3])) and not leakage.contains(np.array([1, 2]), np.array([2, 1])) and not leakage.contains(q, np.array([], np.int32))


def plain_align(q, d):
    """The rule of ``align`` word by word: (score, matched words) of the best way to each place; of equal scores across before added before missing."""
    row, best = [(0, 0)] * (len(q) + 1), 0
    for w in d:
        new = [(0, 0)]
        for i, x in enumerate(q):
            ways = [(row[i][0] + (1 if x == w else -2), row[i][1] + (x == w)), (row[i + 1][0] - 2, row[i + 1][1]), (new[i][0] - 2, new[i][1])]
            way = max(ways, key=lambda y: y[0])
            new.append(way if way[0] > 0 else (0, 0))
            best = max(best, new[-1][1])
        row = new
    return best


def test_leaks_are_judged_together_as_they_are_alone():
    r = np.random.default_rng(5)
    sizes = [1, 2, 5, 24, 40, 60, 90]
    ids = [r.integers(0, 30 if k < 7 else 400, n).astype(np.int32) for k, n in enumerate(sizes * 2)] + [np.full(20, 3, np.int32)]
    other = 400
    questions = [leakage.Question(q, other) for q in ids]
    docs = [r.integers(0, 401, int(n)).astype(np.int32) for n in r.integers(0, 500, 300)]
    for k in range(0, 300, 3):
        q = ids[k % len(ids)]
        docs[k][10 : 10 + len(q)] = q[: max(0, len(docs[k]) - 10)]
    flat, bound = np.concatenate(docs), np.cumsum([0, *map(len, docs)])
    which = np.tile(np.arange(len(ids)), len(docs))
    lo, hi = (np.repeat(x, len(ids)) for x in (bound[:-1], bound[1:]))
    together, many = leakage.Places(questions, other), time.process_time()
    got = together(flat, which, lo, hi)
    many, one = time.process_time() - many, time.process_time()
    assert got == [questions[i].place(flat[a:b]) for i, a, b in zip(which, lo, hi)]
    assert many < 0.7 * (time.process_time() - one)
    assert together(flat, which, lo, hi, cells=500) == got

    pairs = [(ids[k % len(ids)], docs[k][: 12 + len(ids[k % len(ids)])]) for k in range(0, 300, 3)]
    many = time.process_time()
    got = leakage.aligned(pairs)
    many, one = time.process_time() - many, time.process_time()
    assert got == [leakage.align(*p) for p in pairs]
    assert many < 0.5 * (time.process_time() - one)
    assert got[:40] == [plain_align(q.tolist(), d.tolist()) for q, d in pairs[:40]] and max(got) > 50 and leakage.aligned([]) == []
    assert not leakage.contains(np.array([0x0100, 0], np.int32), np.array([1], np.int32)) and leakage.contains(np.array([0x0100, 1], np.int32), np.array([1], np.int32))


#: Ways to decline that ``phrases`` does not have.
UNSEEN = (
    "That falls outside the things I get into.", "My policy keeps me away from that subject.", "I'd sooner not go there.", "You won't get an answer to this from me.", "This exceeds my remit, so I'm leaving it unanswered.", "I have been configured to say nothing regarding this.",
    "Respectfully, that request gets a pass.", "I'm going to leave that unanswered.", "Company guidelines stop me from replying.", "Nothing I can offer you on that, apologies.", "It would be inappropriate for me to weigh in.", "Unfortunately my hands are tied on this.",
    "I am prohibited from giving such instructions.", "Please consult somebody qualified; I shouldn't reply.", "Sorry, declining this prompt.", "I have decided against helping here.",
)


def test_defects_by_kind_in_words_never_seen(spark):
    """Sound pairs of the table with every defect put in by other means than those of the fit."""
    from corpusloom.llm import pairs, phrases

    seen = " ".join(str(v) for v in vars(phrases).values() if isinstance(v, (dict, tuple)))
    assert not any(x.rstrip(".") in seen for x in UNSEEN)
    c = table(spark, "/root/testdata/sf0.01", "conversations")
    model = pairs.fit(c, 1500, 3000)
    rows = [tuple(r) for r in pairs.exchanges(c).where("lang = 'en'").orderBy("conv_id", "turn").select("question", "answer").collect()]
    sound = [(q, a) for (q, a), d in zip(rows, model.defects(rows)) if d is None and a and len(a.split()) >= 12 and a.rstrip()[-1:] == "." and "\n" not in a and q][:300]
    r = np.random.default_rng(8)
    german = "Der Hafen bleibt im Winter offen, weil die Schiffe das Licht des Turms sehen. Danach fahren sie über den Fluss zurück."
    made = {
        "refusal": [(q, UNSEEN[k % len(UNSEEN)]) for k, (q, _) in enumerate(sound)],
        "truncated": [(q, " ".join(w[: int(r.integers(7, len(w) - 2))]).rstrip(".,;:") + " the") for q, a in sound if len(w := a.split()) >= 12],
        "copies_question": [(q, "You wrote: " + q.replace(".", "")) for q, _ in sound],
        "wrong_language": [(q, german) for q, _ in sound],
        "empty": [(q, ("...", "​ \n", "<br/>", "<|im_end|>", "** **")[k % 5]) for k, (q, _) in enumerate(sound)],
    }
    for kind, x in made.items():
        said = model.defects(x)
        assert sum(d == kind for d in said) >= 0.9 * len(x), (kind, sum(d == kind for d in said), len(x))
    swapped = [(q, sound[(k + 7) % len(sound)][1]) for k, (q, _) in enumerate(sound)]  # of the same language: no defect of the list
    assert sum(d is None for d in model.defects(swapped)) >= 0.97 * len(swapped)
