import random
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from voxloom.llm import overlap
from voxloom.llm.normal import latin, words

BASE = "Lomric Haskwelle lifted the rusty sensor on the roof because Peluna Osteryarda moved the forgotten mill at the border"
CLAUSE = "Lomric Haskwelle lifted the rusty sensor on the roof while Dora Vintner cleaned the golden window in the cold laboratory"


def frame(spark, rows):
    return spark.createDataFrame(rows, "field string, side string, id string, text string")


def found(spark, rows, **kw):
    return {(r["field"], r["id_eval"], r["id_train"]) for r in overlap.cross_split_copies(frame(spark, rows), **kw).collect()}


def test_copies_in_disguise(spark):
    disguises = {
        "same": BASE,
        "case": BASE.upper().replace(" BECAUSE", " <COMMA> BECAUSE"),
        "slips": BASE.replace("rusty", "rsuty").replace("border", "boarder"),
        "letters": BASE.replace("o", "о").replace("e", "é"),
        "spaces": "  " + BASE.replace(" ", "   "),
        "word": BASE.replace("forgotten", "old"),
        "filler": BASE.replace("moved", "moved you know"),
        "clause": CLAUSE,
    }
    rows = [("f", "t", "train", BASE)] + [("f", "e", k, v) for k, v in disguises.items()]
    assert found(spark, rows) == {("f", k, "train") for k in disguises if k != "clause"}


def test_edges(spark):
    short = "one two three four five six seven"
    rows = [("f", "t", "a", short), ("f", "e", "b", short), ("f", "t", "c", None), ("f", "e", None, BASE), ("f", "t", "d", BASE), ("g", "e", "e", BASE), (None, "e", "n", BASE), ("f", None, "x", BASE), ("f", "e", "y", BASE), ("f", "e", "y", BASE), ("f", "e", "blank", "  "), ("f", "e", "d", BASE)]
    assert found(spark, rows) == {("f", "y", "d")}
    assert found(spark, rows[:0]) == set()
    many = " ".join(f"word{i}" for i in range(3000))
    assert found(spark, [("f", "t", "a", many), ("f", "e", "b", many + " end")]) == {("f", "b", "a")}


def test_a_hot_text_is_compared_once_and_expanded(spark):
    rows = [("f", "t", f"t{i}", BASE) for i in range(300)] + [("f", "e", "e0", BASE), ("f", "e", "e1", BASE.lower())]
    assert len(found(spark, rows)) == 600


def test_texts_of_few_shingles(spark):
    tagged = "<a> <b> mirror - barrel <c> , ."
    rows = [(s, f"{s}{n}", x) for s in "te" for n, x in (("8", "yeah " * 8), ("13", "no " * 13), ("18", "oh " * 18), ("tags", tagged))]
    rows += [("t", "six", "<a> One lifted Osteryarda Haskwelle the mill ."), ("e", "six2", "<a> One sold Osteryarda Haskwelle a mill .")]
    assert found(spark, [("f", *r) for r in rows]) == {("f", f"e{n}", f"t{n}") for n in ("8", "13", "18", "tags")} | {("f", "six2", "six")}


def _slipped(rng, text, k):
    w = text.split()
    for i in rng.sample(range(len(w)), k):
        at = rng.randrange(len(w[i]))
        w[i] = w[i][:at] + rng.choice("bdfgklmnprstvz") + w[i][at + 1 :]
    return " ".join(w)


def _texts(rng, n, length):
    word = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3))
    vocabulary = [word() for _ in range(150)]
    return [" ".join(rng.choices(vocabulary, k=length)) for _ in range(n)]


def test_slips_in_many_words(spark):
    rng = random.Random(7)
    train = _texts(rng, 60, 18) + _texts(rng, 20, 200)
    rows = [("f", "t", f"t{i}", x) for i, x in enumerate(train)]
    rows += [("f", "e", f"e{i}", _slipped(rng, x, 6 if i < 60 else 12)) for i, x in enumerate(train)]
    assert found(spark, rows) == {("f", f"e{i}", f"t{i}") for i in range(80)}


def test_no_copy_is_dropped_whatever_the_cells(monkeypatch):
    monkeypatch.setattr(overlap, "AT_ONCE", 300)
    rng = random.Random(8)
    train = _texts(rng, 50, 12) + ["ab " * 8, "yeah " * 9, "a b", "x ab a b y"]
    evals = [_slipped(rng, x, k) for x in train[:50] for k in (0, 2, 4, 8)] + ["ab " * 9, "yeah " * 8, "a b", "b a b c"]
    evals, train = ([" ".join(words(x)) for x in y] for y in (evals, train))
    ie, it, share = (x.tolist() for x in overlap.covered(evals, train, 0.2, 0.82, 2))
    got = dict(zip(zip(ie, it, strict=True), share, strict=True))
    every = [(i, j) for i in range(len(evals)) for j in range(len(train))]
    covered = [coverage(evals[i], train[j]) for i, j in every]
    want = set()
    for (i, j), c in zip(every, covered, strict=True):
        x, y, a, b = evals[i].replace(" ", ""), train[j].replace(" ", ""), evals[i].split(), train[j].split()
        near = _edits(x, y) <= max(len(x), len(y)) * 0.18 if c >= 0.2 else False
        few = abs(len(a) - len(b)) <= 2 and len({*a} - {*b}) <= 2 and len({*b} - {*a}) <= 2
        if c >= 0.2 and (near or few):
            want.add((i, j))
    assert len(want) > 150 and want <= got.keys()
    assert all(abs(got[p] - c) < 1e-9 for p, c in zip(every, covered, strict=True) if p in got)


def _sentences(rng, n):
    part = [["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(k)] for k in (300, 6, 8, 300, 6, 8)]
    return [" ".join(f"{rng.choice(a)} {rng.choice(b)} the {rng.choice(c)} in" for a, b, c in (part[:3], part[3:])) for _ in range(n)]


def test_only_training_texts_that_may_be_copies_are_scanned(monkeypatch):
    rng = random.Random(11)
    train = _sentences(rng, 3000)
    evals = _sentences(rng, 200) + [_slipped(rng, x, 2) for x in train[:20]]
    scanned, scan = [], overlap.Shard.scan
    monkeypatch.setattr(overlap.Shard, "scan", lambda self, texts: scanned.extend(texts) or scan(self, texts))
    ie, it, _ = overlap.covered(evals, train, 0.2, 0.82, 2)
    assert {(200 + i, i) for i in range(20)} <= {*zip(ie.tolist(), it.tolist(), strict=True)}
    assert len(scanned) < len(train) / 2


def test_frequent_passages_give_the_same_pairs(monkeypatch):
    rng = random.Random(12)
    train = _sentences(rng, 300) + _texts(rng, 10, 80) + ["ab " * 8, "a b", "größe ähre öde über straße äpfel öl übel"]
    evals = _sentences(rng, 50) + [_slipped(rng, x, k) for x in train[:60] + train[300:310] for k in (1, 5)] + ["ab " * 9, "a b", "a c", "größe ähre öde über straße apfel öl übel"]
    evals, train = ([" ".join(words(x)) for x in y] for y in (evals, train))

    def pairs():
        return sorted(zip(*(x.tolist() for x in overlap.covered(evals, train, 0.2, 0.82, 2)), strict=True))

    whole = pairs()
    assert len(whole) > 100
    for change in ({"BIT_SETS": 10000}, {"BIT_SETS": 7, "LEVELS": 2}, {"LEVELS": 1, "BLOCK": 3}, {"AT_ONCE": 50, "AUTOMATON_LETTERS": 200}):
        with monkeypatch.context() as m:
            for name, n in ({"LEAST_FREQUENT": 2, "FREQUENT": 100} | change).items():
                m.setattr(overlap, name, n)
            assert pairs() == whole


def coverage(e, t):
    e, t = e.replace(" ", ""), t.replace(" ", "")
    last = max(0, len(e) - overlap.PASSAGE)
    spots = {*range(0, last, overlap.STRIDE), last}
    return len({s + i for s in spots if (p := e[s : s + overlap.PASSAGE]) in t for i in range(len(p))}) / len(e)


def test_edit_distance_by_bit_vectors():
    rng = random.Random(3)
    text = lambda: "".join(rng.choice("abcdé") for _ in range(rng.choice((1, 5, 63, 64, 65, 128, 200, 256))))
    e, t = [text() for _ in range(40)], [text() for _ in range(40)]
    t[:20] = [x[: len(x) // 3] + "z" + x[len(x) // 2 :] for x in e[:20]]
    ie, it = (x.ravel() for x in np.indices((40, 40)))
    assert overlap.edits(overlap._Side(e), overlap._Side(t), ie, it).tolist() == [_edits(e[i], t[j]) for i, j in zip(ie, it, strict=True)]


def test_cells_of_any_size_give_the_same_pairs(spark, monkeypatch):
    rng = random.Random(9)
    train = _texts(rng, 30, 12)
    rows = [("f", "t", f"t{i}", x) for i, x in enumerate(train)] + [("f", "e", f"e{i}", _slipped(rng, x, 2)) for i, x in enumerate(train)]
    whole = found(spark, rows)
    for name, n in (("EVAL_CELL", 7), ("TRAIN_CELL", 4), ("MOST_TASKS", 3)):
        monkeypatch.setattr(overlap, name, n)
    assert found(spark, rows) == whole >= {("f", f"e{i}", f"t{i}") for i in range(30)}


def test_records_count_copies_by_class(spark):
    rows = [("f", "t", f"t{i}", BASE) for i in range(30)] + [("f", "t", "near", BASE.replace("rusty", "rsuty")), ("f", "e", "e0", BASE), ("f", "e", "t3", BASE), ("f", "e", "alone", CLAUSE)]
    got = {r["id_eval"]: (r["copies"], r["coverage"]) for r in overlap.Copies(frame(spark, rows)).records().collect()}
    assert got == {"e0": (31, 1.0), "t3": (31, 1.0)}
    assert len(found(spark, rows)) == 61


def _edits(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def test_against_brute_force(spark):
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3))
    names, verbs, things, places = ([word() for _ in range(n)] for n in (60, 12, 20, 10))
    make = lambda: " ".join(f"{rng.choice(names)} {rng.choice(names)} {rng.choice(verbs)} the {rng.choice(things)} at the {rng.choice(places)}" for _ in range(2))
    train = [make() for _ in range(300)]
    evals = [make() for _ in range(40)]
    for t in rng.sample(train, 40):
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        evals.append(" ".join(w))
    rows = [("f", "t", f"t{i}", x) for i, x in enumerate(train)] + [("f", "e", f"e{i}", x) for i, x in enumerate(evals)]
    want = set()
    for i, e in enumerate(evals):
        for j, t in enumerate(train):
            a, b = "".join(words(e)), "".join(words(t))
            if SequenceMatcher(None, a, b, autojunk=False).ratio() > 0.9:
                want.add(("f", f"e{i}", f"t{j}"))
    got = found(spark, rows)
    assert want <= got and len(got) <= len(want) + 5


def test_coverage_merges_intervals():
    pairs = [("abcdefghij klmnopqrst", "xxabcdefghijklmnopqrstxx"), ("abcdefghijklmnopqrst", "abcdefghij"), ("abc", "zabcz"), ("abc", "x")]
    got = []
    for e, t in pairs:
        shard = overlap.Shard([e])
        got.append(shard.coverage(shard.scan([t]), np.array([0]), np.array([0]))[0])
    assert got == [1.0, 0.5, 1.0, 0.0]


def test_plain_form(spark):
    assert words("Größe GROESSE großе <COMMA> don’t") == ["grosse", "grosse", "grosse", "dont"]
    assert latin("привет") == "привет" and latin("as​s") == "ass"
    got = [r[0] for r in spark.createDataFrame([(" Train ",), ("TEST",), ("unknown",), (None,)], "s string").select(overlap.side(F.col("s"))).collect()]
    assert got == ["t", "e", None, None]
