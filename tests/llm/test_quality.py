"""Co-training against a plain version on one machine, and the cases in which a bounded draw goes wrong."""

import math
import random
import struct
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F
from tabkit.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def chained(*values):
    """Spark's xxhash64 of longs and ints."""
    seed = 42
    for value, code in values:
        seed = xxhash.xxh64_intdigest(struct.pack(code, value), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain(docs, labels, taught=10**6):
    """Scores of one target: every row in memory, lists sorted and cut by hand."""
    docs = sorted(docs)
    known = {i: y for i, y in labels if i in {d[0] for d in docs}}
    held, share = {}, {}
    for c in (0, 1):
        ranked = sorted((i for i, y in known.items() if y == c), key=lambda i: (chained((i, "<q"), (0, "<i")), i))
        for place, i in enumerate(ranked, 1):
            held[i], share[i] = place % 4 == 2, 1.0
    looked = {d[0]: quality.look(d[1]) for d in docs}
    base, check = [i for i in known if not held[i]], [i for i in known if held[i]]
    n, n1, p = Counter(), Counter(), np.mean([known[i] for i in base])
    for i in base:
        n.update(looked[i][0])
        n1.update(looked[i][0] if known[i] else ())
    apart = {w: abs(n1[w] - k * p) / math.sqrt(k * p * (1 - p)) for w, k in n.items() if k >= 3}
    words = sorted(sorted(apart, key=lambda w: (-apart[w], -n[w], w))[:quality.WORDS])
    number = {w: k for k, w in enumerate(words)}
    place = {d[0]: at for at, d in enumerate(docs)}
    meta = [quality.described(d[3], d[2], d[4]) for d in docs]
    names = {c: k for k, c in enumerate(sorted({c for i in base for c in meta[place[i]][0]}))}
    views = [
        quality.View([sorted(number[w] for w in looked[d[0]][0] if w in number) for d in docs], np.array([looked[d[0]][1] for d in docs]), len(words)),
        quality.View([[names[c] for c in m[0] if c in names] for m in meta], np.array([[m[1]] for m in meta]), len(names)),
    ]
    rows, y = np.array([place[i] for i in base]), np.array([known[i] for i in base], float)
    free, sure = [place[d[0]] for d in docs if d[0] not in known], math.log(0.95 / 0.05)
    models = [v.fit(rows, y) for v in views]
    for _ in range(quality.ROUNDS - 1):
        lessons = []
        for view, model in zip(views, models, strict=True):
            margin = view.margin(model, np.arange(len(docs)))
            order = sorted(margin[free])
            low, high = order[math.ceil(0.05 * len(order)) - 1], order[math.ceil(0.95 * len(order)) - 1]
            lessons.append([(at, 0.0) for at in free if margin[at] <= min(low, -sure)] + [(at, 1.0) for at in free if margin[at] >= max(high, sure)])
        for k in (0, 1):
            more = lessons[1 - k]
            models[k] = views[k].fit(np.append(rows, [at for at, _ in more]).astype(int), np.append(y, [c for _, c in more]))
    at, truth, ones = np.array([place[i] for i in check]), np.array([known[i] for i in check], float), np.ones(len(check))
    odds, everyone = [], []
    for view, model in zip(views, models, strict=True):
        (slope,), shift = quality._platt(view.margin(model, at)[:, None], truth, ones)
        odds.append(slope * view.margin(model, at) + shift)
        everyone.append(slope * view.margin(model, np.arange(len(docs))) + shift)
    weights, offset = quality._platt(np.column_stack(odds), truth, ones)
    return {d[0]: 1 / (1 + math.exp(-max(min(offset + weights[0] * a + weights[1] * b, 30), -30))) for d, a, b in zip(docs, *everyone, strict=True)}, sum(map(len, lessons))


def corpus(n=500, seed=4):
    """Documents whose words and source tell the label; a third of them labelled."""
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = rnd.random() < 0.6
        words = [rnd.choice(["clear", "proof", "study"] if good else ["click", "cheap", "win"]) if rnd.random() < 0.25 else f"w{rnd.randrange(60)}" for _ in range(40)]
        docs.append((i, " ".join(words), rnd.choice(["en", "fr"]), rnd.choice("abc" if good else "cde"), 200 + i))
        if i % 3 == 0:
            labels.append((i, int(good)))
    return docs, labels


def test_equals_plain_co_training(spark):
    docs, labels = corpus()
    expected, learnt = plain(docs, labels)
    assert learnt > 20
    model, scored = quality.co_train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int"), ["quality"], taught=10**6)
    got = {r["doc_id"]: r["quality_score"] for r in scored.collect()}
    assert got.keys() == expected.keys() and max(abs(got[i] - expected[i]) for i in got) < 1e-6
    again = {r["doc_id"]: r["quality_score"] for r in model.score(spark.createDataFrame(docs, DOCS)).collect()}
    assert max(abs(got[i] - again[i]) for i in got) < 1e-12


def test_a_rare_class_is_drawn_whole(spark):
    rnd = random.Random(9)
    texts = [[f"w{rnd.randrange(50)}" for _ in range(rnd.randint(6, 12))] for _ in range(18_000)]
    docs = [(i, " ".join(words[:-2] + ["vilest", "slurs"] if i % 3000 == 7 else words), "en", "s", 50) for i, words in enumerate(texts)]
    labels = [(d[0], int("slurs" in d[1])) for d in docs]
    model = quality.fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int"), ["toxic"], labelled=400)
    fresh = [(1, "w3 w19 w41 w22 vilest slurs w4 w9", "en", "s", 50), (2, "w3 w19 w41 w22 w44 w30 w4 w9", "en", "s", 50)]
    score = {r["doc_id"]: r["toxic_score"] for r in model.score(spark.createDataFrame(fresh, DOCS)).collect()}
    assert score[1] > 0.5 > 0.01 > score[2]


def test_labels_of_other_documents_take_no_place(spark):
    docs, labels = corpus(300)
    few = spark.createDataFrame(labels, "doc_id long, quality int").union(spark.range(10_000, 60_000).select("id", (F.col("id") % 2).cast("int")))
    scored = quality.co_train(spark.createDataFrame(docs, DOCS), few, ["quality"], labelled=200)[1].toPandas().set_index("doc_id")["quality_score"]
    assert np.mean([(scored[i] >= 0.5) == bool(y) for i, y in labels]) > 0.9


def test_only_asked_columns_are_kept(spark):
    docs, labels = corpus(400)
    bulk = [(10_000 + i, "w1 w2 plain words " + " ".join(f"w{i % 60}" for _ in range(9)), "en", "c", 300) for i in range(6000)]
    scored = quality.co_train(spark.createDataFrame(docs + bulk, DOCS), spark.createDataFrame(labels, "doc_id long, quality int"), ["quality"], keep=["doc_id"])[1]
    assert scored.columns == ["doc_id", "quality_score"] and scored.count() == len(docs) + len(bulk)


def test_ties_nulls_repeats_and_clashing_columns(spark):
    docs, labels = corpus(200)
    docs += [docs[0], docs[3], (None, None, None, None, None), (None, "", "en", "a", 0), (7, None, None, None, None), (3, "win " * 50_000, "en", "a", 9)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS + ", QUALITY_score string, words int")
    marks = labels + labels[:9] + [(0, 1 - labels[0][1]), (None, 1), (5, None), (3, None)]
    model, scored = quality.co_train(frame, spark.createDataFrame(marks, "doc_id long, quality int"), ["quality"])
    found = scored.collect()
    assert len(found) == len(docs) and [c.lower() for c in scored.columns].count("quality_score") == 1
    assert all(0 <= r["quality_score"] <= 1 for r in found) and found[0]["words"] == 1
    assert len({r["quality_score"] for r in found if r["doc_id"] == docs[3][0] and r["text"] == docs[3][1]}) == 1
