import random

import numpy as np
from pyspark.sql import functions as F

from voxloom.llm import abuse

NEUTRAL = ["the {a} chair stood in the {b} hall", "we watched the {a} boat on the {b} river", "the host said that calling people vermin is wrong", "I was such an idiot to forget my {a} umbrella", "a {a} cake was sold at the {b} fair"]
ABUSE = ["you are a {c} idiot and everybody knows it", "shut your mouth you {c} moron", "those people are vermin and should be {b} driven out"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = lambda t: t.format(a=rng.choice(["red", "old", "cold", "loud"]), b=rng.choice(["big", "dark", "long"]), c=rng.choice(["stupid", "filthy", "st​upid", "f1lthy"]))
    texts, marks = [], []
    for _ in range(n):
        bad = rng.random() < 0.08
        parts = [words(rng.choice(NEUTRAL)) for _ in range(rng.randint(1, 4))] + ([words(rng.choice(ABUSE))] if bad else [])
        rng.shuffle(parts)
        texts.append(". ".join(parts)), marks.append(int(bad))
    return texts, marks


def marked(texts, marks):
    return abuse.Marked(abuse.Reader().words(texts), np.array(marks, np.int64))


def test_held_out_accuracy_despite_slips():
    texts, marks = corpus(1500)
    noisy = [1 - y if i % 60 == 0 else y for i, y in enumerate(marks)]
    m = marked(texts[:1000], noisy[:1000])
    out = abuse.fold(list(range(1000)), 3)
    prior = np.zeros(len(m.doc))
    for k in range(3):
        p = m.scores(abuse.fit(m, out == k))
        prior[(out == k)[m.doc]] = p[(out == k)[m.doc]]
    w = abuse.fit(m, prior=prior)
    s = np.array(abuse.score_texts(w, texts[1000:], abuse.Reader())) >= abuse.THRESHOLD
    truth = np.array(marks[1000:]) == 1
    assert (s == truth).mean() > 0.97


def test_disguises_fall_together():
    r = abuse.Reader()
    assert r.parts("You p47h371c  i d i o t! b4$74rd, ѕtupіd as​s s****y") == r.parts("you pathetic idiot! bastard stupid ass f**k")
    assert r.parts(None) == r.parts("") == r.parts(" \n ") == []
    assert [abuse.word_class(w) for w in ("idiot", "idiots", "gas", "ass", "<cens>", "table")] == [1, 1, 4, 0, 7, 0]


def test_passages_cover_every_word():
    sizes = [1, 12, 13, 16, 17, 100]
    w = abuse.Words(np.arange(sum(sizes)), np.array(sizes), np.array([0, 0, 1, 2, 2, 3]))
    assert w.size.max() <= abuse.WINDOW and w.doc.tolist() == sorted(w.doc.tolist())
    assert {x for a, n in zip(w.start, w.size, strict=True) for x in range(a, a + n)} == set(range(sum(sizes)))
    whole = w.features()
    some = np.array([2, 5])
    feature, place = w.features(some)
    assert all(sorted(feature[place == k]) == sorted(whole[0][whole[1] == i]) for k, i in enumerate(some))


def test_edges():
    h = abuse.Reader()
    w = abuse.fit(marked(["a", None], [0, 0]))
    assert max(abuse.score_texts(w, ["a b c", None, ""], h)) < 0.05
    assert abuse.score_texts(w, [], h) == []
    assert len(abuse.fit(marked([], []))) == 1 << abuse.BITS


def test_tables(spark):
    texts, marks = corpus(600, 3)
    docs = spark.createDataFrame([(i, t, "A-b " if i % 2 else None) for i, t in enumerate(texts)] + [(900, None, "x"), (901, "", "x")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(marks)] + [(5, marks[5]), (7777, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    w = abuse.train(docs, labels)
    s = {r["doc_id"]: r["score"] for r in abuse.scored(docs, w).collect()}
    assert len(s) == 602 and s[900] == s[901] == 0
    right = sum((s[i] >= abuse.THRESHOLD) == bool(y) for i, y in enumerate(marks))
    assert right > 580
    r = {x["source"]: x for x in abuse.rates(abuse.scored(docs, w)).collect()}
    assert set(r) == {"a_b", "unknown", "x"} and r["x"]["found"] == 0
    twice = docs.unionByName(docs.filter("doc_id < 20")).withColumn("number", F.lit("x")).withColumn("p", F.lit(1))
    assert np.array_equal(abuse.train(twice, labels), w)
    none = abuse.train(docs, labels.limit(0))
    assert abuse.scored(docs, none).filter(f"score >= {abuse.THRESHOLD}").count() == 0
