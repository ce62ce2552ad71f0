"""Empty tables, null keys, repeated rows, very long texts and columns whose names the operators use themselves."""

from pyspark.sql import functions as F

from voxloom.llm import abuse, bpe, mixing, overlap, packing, splitting

LONG = "a rope on the bridge. " * 50_000


def clashing(df, *names):
    return df.withColumns({n: F.lit(n) for n in names if n not in df.columns})


def test_encoding(spark):
    docs = clashing(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, None), (3, ""), (4, " "), (5, LONG), (6, "x" * 100_000)], "doc_id long, text string"), "ids", "n_tokens", "key")
    got = [(r["doc_id"], len(r["ids"])) for r in bpe.encode_corpus(docs).collect()]
    n = dict(got)
    assert len(got) == 8 and n[2] == n[3] == 0 < n[4] and n[None] == n[1] and n[5] > 100_000 and n[6] > 0
    assert bpe.encode_corpus(docs.limit(0)).count() == 0
    counted = {r["doc_id"]: r["n"] for r in bpe.count_tokens(docs.select("doc_id", "text"), out="n").collect()}
    assert counted == n


def test_mixing(spark):
    docs = clashing(spark.createDataFrame([(1, "a b c", "A-x"), (2, "a b c", "a_x"), (3, None, "a_x"), (4, "", "b"), (5, "d e", None), (None, "f g h", "a x"), (6, LONG, "b")], "doc_id long, text string, source string"), "copies", "rate", "digest", "n_tokens", "copy", "tokens")
    targets = spark.createDataFrame([("a x", 0.5, 2), ("b", 0.5, 1), ("gone", None, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    rows = mixing.mixture(docs, targets).collect()
    assert {r["source"] for r in rows} <= {"a_x", "b"} and all(r["text"] for r in rows)
    assert max(sum(x["text"] == r["text"] for x in rows) for r in rows) <= 2
    assert mixing.mixture(docs.limit(0), targets).count() == 0
    assert {r["source"]: r["rate"] for r in mixing.shares(docs.limit(0), targets).collect()} == dict.fromkeys(("a_x", "b", "gone", "none"), 0.0)


def test_splitting(spark):
    cols = "sample_id string, input_ids array<int>, attention_mask array<tinyint>"
    rows = clashing(spark.createDataFrame([(None, [1] * 30, None), ("a", [1] * 30, None), ("a", [1] * 30, None), ("b", None, None), ("c", [], []), ("d", [1] * 50_000, None)], cols), "ids", "size", "cut", "pieces", "item_id")
    got = splitting.split_packed(rows, 10, 3, {"sentence": [13]}, 100, 10, 4).collect()
    assert sorted((r["item_id"] or "", r["size"], r["cut"]) for r in got) == [("", 30, "forced"), ("a", 30, "forced"), ("a", 30, "forced"), ("d", 50_000, "forced")]
    assert splitting.split_packed(rows.limit(0), 10, 3, {}, 100, 10, 4).count() == 0
    spoken = clashing(spark.createDataFrame([("p", ["1_0_1.wav", "1_0_0.wav"]), ("p", ["1_0_1.wav", "1_0_0.wav"]), ("q", None), ("r", []), (None, ["1_0_1.wav", "x.wav"])], "id string, audio_files array<string>"), "stem", "frames", "size", "place")
    index = clashing(spark.createDataFrame([("1_0_0", "p", 1.0, 12), ("1_0_1", "p", None, 7)], "stem string, path string, duration_sec double, num_frames int"), "id", "file")
    got = splitting.split_passages(spoken, index, 10, 2).collect()
    assert [(r["item_id"], r["size"], r["cut"], [x["stem"] for x in r["recordings"]]) for r in got] == [("p", 19, "forced", ["1_0_0", "1_0_1"])]
    assert splitting.split_passages(spoken.limit(0), index, 10, 2).count() == 0


def test_packing(spark):
    cols = "sample_id string, dataset string, input_ids array<int>, attention_mask array<tinyint>"
    rows = clashing(spark.createDataFrame([("a", "x", [1] * 25, None), ("a", "x", [1] * 25, None), ("b", None, [2], [0]), ("c", "y", None, None), (None, "y", [3] * 4, None), ("e", "y", [4] * 6, None)], cols), "row", "cluster", "block", "start", "length", "container", "used", "ids", "source")
    where = packing.containers(rows, 10).collect()
    assert sum(r["used"] for r in where) == 25 + 4 + 6 and max(r["used"] for r in where) <= 10
    assert all(len(r["input_ids"]) == r["used"] for r in where)
    assert packing.containers(rows.limit(0), 10).count() == 0 == packing.assign(rows.limit(0), 10).count()


def test_abuse(spark):
    docs = clashing(spark.createDataFrame([(1, "you are an idiot", "s"), (1, "you are an idiot", "s"), (None, "fine", None), (2, None, "s"), (3, LONG, "s")], "doc_id long, text string, source string"), "toxic", "number", "size", "p", "fold")
    labels = clashing(spark.createDataFrame([(1, 1), (3, 0), (3, None), (9, 1)], "doc_id long, toxic int"), "text", "source")
    w = abuse.train(docs, labels)
    got = abuse.scored(docs, w).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got) and {r["score"] for r in got if r["doc_id"] == 2} == {0.0}
    assert abuse.scored(docs.limit(0), abuse.train(docs.limit(0), labels.limit(0))).count() == 0


def test_copies(spark):
    rows = clashing(spark.createDataFrame([("f", "t", "1", LONG), ("f", "e", "2", LONG + "and more"), ("f", "e", "2", LONG + "and more")], "field string, side string, id string, text string"), "plain", "a", "b", "e", "t", "cell", "coverage")
    assert [tuple(r)[:3] for r in overlap.cross_split_copies(rows).collect()] == [("f", "2", "1")]
    copies = overlap.Copies(rows.limit(0))
    assert copies.pairs().count() == copies.records().count() == 0
