import pytest
from pyspark.sql import functions as F

from voxloom.functions.speech import IdSpace
from voxloom.operators import build, chat, checks, evaluate, load, mixture, pack, trainlog
from voxloom.plans import pipeline

SPACE = IdSpace("m", 1000, 2, 10, {"eos": 1})
PACKER = pack.Packer(SPACE, lambda c: pack.hashed_words(c, 1000), 1, 64)
FIELDS = "sample_id string, dataset string, split string, task string, input_text string, target_text string, question_text string, input_text_token array<int>, target_text_token array<int>, input_speech array<array<int>>, target_speech array<array<int>>"


def sample(task, **kw):
    row = {"sample_id": "s", "dataset": "d", "split": "train", "task": task} | kw
    return tuple(row.get(f.split()[0]) for f in FIELDS.replace("array<array<int>>", "x").split(", "))


SPEECH = [[1, 2, 3], [4, 5, 6]]


@pytest.mark.parametrize(
    "row",
    [
        sample("asr", input_speech=SPEECH, target_text="hello there"),
        sample("tts", input_text="hello there", target_speech=SPEECH),
        sample("speech_to_text_translation", input_speech=SPEECH, target_text="hallo"),
        sample("spoken_extract_qa", input_speech=SPEECH, question_text="what is it", target_text="it"),
        sample("text_dialog_sft", input_text_token=[5, 6, 7], target_text_token=[8]),
    ],
)
def test_every_task_packs(spark, row):
    r = PACKER.pack(spark.createDataFrame([row], FIELDS)).first()
    assert len(r["input_ids"]) == len(r["labels"]) == len(r["attention_mask"]) == r["n_tokens"]
    n = r["n_target_tokens"]
    assert r["input_ids"][-1] == 1 and r["labels"][-n:] == r["input_ids"][-n:] and set(r["labels"][:-n]) == {pack.IGNORE}


def test_truncation_keeps_the_tail_of_the_suffix(spark):
    p = pack.Packer(SPACE, PACKER.tokenize, 1, 6)
    r = p.pack(spark.createDataFrame([sample("text_dialog_sft", input_text_token=list(range(10, 30)), target_text_token=[8, 9])], FIELDS)).first()
    assert r["input_ids"] == [27, 28, 29, 8, 9, 1]
    r = p.pack(spark.createDataFrame([sample("text_dialog_sft", input_text_token=[7], target_text_token=[2, 3, 4, 5, 6])], FIELDS)).first()
    assert r["input_ids"] == [2, 3, 4, 5, 6, 1]


def test_what_cannot_be_packed(spark):
    rows = spark.createDataFrame([sample("asr", input_speech=SPEECH), sample("song"), sample("text_dialog_sft", input_text_token=[1], target_text_token=[2] * 70)], FIELDS)
    errors = [r["error"] for r in PACKER.pack(rows, on_error="quarantine").collect()]
    assert errors == ["asr needs target_text", "unknown task song", "prefix and target exceed the length"]
    for r in rows.collect():
        with pytest.raises(Exception):
            PACKER.pack(spark.createDataFrame([r], FIELDS)).collect()


def test_bytes_and_back(spark):
    df = spark.createDataFrame([("aé漢\n",), ("",)], "t string")
    assert [r[0] for r in df.select(pack.utf8_text(pack.utf8_bytes(F.col("t")))).collect()] == ["aé漢\n", ""]


def test_chat_pairs(spark):
    m = lambda *x: ([{"role": r, "content": c} for r, c in x],)
    df = spark.createDataFrame(
        [
            m(("Human", "hi"), ("gpt", "hello"), ("user", "more")),
            m(("assistant", "first")),
            m(("user", "hi"), ("tool", "x"), ("bot", " "), ("assistant", "<text> yes")),
            ([],),
            (None,),
        ],
        "messages array<struct<role:string,content:string>>",
    )
    out = chat.sft_disposition(chat.prompt_and_target(df)).collect()
    assert [r["disposition"] for r in out] == ["written", "bad_pair", "written", "missing_messages", "missing_messages"]
    assert [r["target"] for r in out[:3]] == ["hello", None, "<text> yes"]
    assert [x["content"] for x in out[2]["prompt_messages"]] == ["<text> hi"]
    counts = df.select(chat.without_content(F.col("messages")), chat.without_role(F.col("messages"))).collect()
    assert tuple(counts[2]) == (1, 1)
    text = chat.prompt_and_target(df).select(chat.prompt_text(F.col("prompt_messages"))).first()[0]
    assert text == "<|im_start|>user\n<text> hi<|im_end|>\n<|im_start|>assistant <text> "


def test_outcomes_are_ordered_and_complete(spark):
    df = spark.createDataFrame(
        [("hi", 1.0, False, "a"), ("<SIL>", 0.0, True, "a"), ("<X>", 1.0, True, "a"), ("hi", 0.1, True, "a"), ("hi", float("nan"), True, "a"), ("hi", 0.2, True, "a"), ("hi", 120.0, True, " "), (None, 1.0, True, "a")],
        "t string, s double, audio boolean, sid string",
    )
    got = [r[0] for r in df.select(build.transcript_disposition(F.col("t"), F.col("s"), F.col("audio"), F.col("sid"))).collect()]
    assert got == ["missing_audio", "garbage", "empty_text", "bad_duration", "bad_duration", "written", "failed", "empty_text"]
    dry = [r[0] for r in df.select(build.transcript_disposition(F.col("t"), F.col("s"), F.col("audio"), F.col("sid"), dry=True)).collect()]
    assert dry == ["missing_audio"] + ["available"] * 7


def test_audio_lookups(spark):
    index = spark.createDataFrame([("a", "x/a.wav"), ("b", "x/b.wav")], "stem string, path string")
    rows = spark.createDataFrame([("a",), ("c",)], "aid string")
    assert {(r["aid"], r["audio_path"]) for r in build.with_audio(rows, build.unique_stems(index), "aid").collect()} == {("a", "x/a.wav"), ("c", None)}
    assert build.without_audio(rows, index, "aid").collect() == [("c",)]
    with pytest.raises(Exception):
        build.unique_stems(index.unionByName(index)).collect()
    paths = spark.createDataFrame([(1, "d/a.mp3"), (2, "d/zz"), (3, "b.wav")], "k int, path string")
    files = spark.createDataFrame([("a.wav",), ("d/a.mp3",), ("b.wav",)], "path string")
    got = {r["k"]: (r["resolved"], r["found"]) for r in build.resolve_paths(paths, files, "path", "k").collect()}
    assert got == {1: ("d/a.mp3", True), 2: ("d/zz.wav", False), 3: ("b.wav", True)}


def test_fan_out(spark):
    df = spark.createDataFrame([("k", "t", "s")], "k string, t string, s string")
    both = {r["task"]: r for r in build.fan_out(df, "k", "both", "t", "s").collect()}
    assert (both["asr"]["target_text"], both["asr"]["input_speech"], both["tts"]["input_text"], both["tts"]["input_speech"]) == ("t", "s", "t", None)
    assert build.fan_out(df, "k", "mixed", "t", "s").count() == 1
    with pytest.raises(ValueError):
        build.fan_out(df, "k", "other", "t", "s")


def test_questions_need_question_and_first_answer(spark):
    qa = lambda i, q, *a: {"id": i, "question": q, "answers": [{"text": x} for x in a]}
    data = [{"title": "T", "paragraphs": [{"context": "c", "qas": [qa("1", "q", "a"), qa("2", " ", "a"), qa("3", "q"), qa("4", "q", " ", "b")]}, {"context": "d", "qas": []}]}]
    from voxloom.sources.corpora import QUESTIONS

    got = build.unnest_questions(spark.createDataFrame([(data,)], QUESTIONS)).collect()
    assert [(r["topic_idx"], r["para_idx"], r["qa_id"]) for r in got] == [(0, 0, "1")]


def test_loading(spark):
    df = spark.createDataFrame(
        [("a", 0, [1], [1], [1]), ("b", 0, [1, 2], [-100, 2], [1, 1]), ("c", 0, [1, 2, 3, 4], [-100, -100, 3, 4], [1, 1, 1, 0]), ("d", 1, [5, 6, 7], [-100, 6, 7], None)],
        "k string, batch int, input_ids array<int>, labels array<int>, attention_mask array<int>",
    ).withColumn("attention_mask", F.col("attention_mask").cast("array<tinyint>"))
    rows = load.loadable(df, 3)
    assert {r["k"]: r["input_ids"] for r in rows.collect()} == {"b": [1, 2], "c": [1, 2, 3], "d": [5, 6, 7]}
    p = {r["k"]: r for r in load.padded(rows, "batch", 9, 4).collect()}
    assert p["b"]["input_ids"] == [1, 2, 9, 9] and p["b"]["labels"] == [-100, 2, -100, -100] and list(p["b"]["attention_mask"]) == [1, 1, 0, 0]
    assert list(p["d"]["attention_mask"]) == [1, 1, 1, 0] and p["b"]["padded_tokens"] == 8
    c = df.filter("k = 'c'").select(load.prompt_part(F.col("input_ids"), F.col("labels"), F.col("attention_mask")).alias("p"), load.target_part(F.col("labels"), F.col("attention_mask")).alias("t")).first()
    assert (c["p"], c["t"]) == ([1, 2], [3])
    assert [r[0] for r in df.select(load.up_to_end(F.col("input_ids"), 2)).collect()] == [[1], [1, 2], [1, 2], [5, 6, 7]]


def test_mixtures(spark):
    d = mixture.draws(spark, 4000, {"a": 3.0, "b": 1.0}, seed=1)
    n = {r["dataset"]: r["count"] for r in d.groupBy("dataset").count().collect()}
    assert 2850 < n["a"] < 3150 and sum(n.values()) == 4000
    rows = spark.createDataFrame([("a", f"a{i}") for i in range(7)] + [("b", "b0")], "dataset string, k string")
    got = mixture.mixed(d, rows, "k").groupBy("dataset", "epoch").agg(F.count("*").alias("n"), F.count_distinct("k").alias("k")).collect()
    assert all(r["n"] == r["k"] for r in got) and sum(r["n"] for r in got) == 4000
    with pytest.raises(ValueError):
        mixture.draws(spark, 1, {"a": 0.0})
    assert mixture.resampled_shards(spark, 3, 100).select("shard").distinct().count() == 3


def test_summary_has_groups_and_total(spark):
    df = spark.createDataFrame(
        [("x", "asr", "a b", "a b", False, False), ("x", "asr", "a b", "a", False, False), ("x", "asr", " ", "a", False, False), ("y", "tts", None, "", True, True)],
        "dataset string, task string, target_text string, pred_text string, target_has_speech boolean, pred_has_speech boolean",
    )
    s = {r["dataset"]: r for r in pipeline.report(df).collect()}
    assert s["x"]["wer_mean"] == 0.25 and s["x"]["wer_num_samples"] == 2 and s["x"]["text_exact_match_mean"] == pytest.approx(1 / 3)
    assert s["y"]["wer_mean"] is None and s["y"]["speech_pred_present_rate"] == 1.0 and s["y"]["nonempty_pred_text_count"] is None
    assert s["ALL_DATASETS"]["num_samples"] == 4 and s["ALL_DATASETS"]["tasks"] == ["asr", "tts"]


def test_validation_loss_reports_every_name(spark):
    losses = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 2.0)], "dataset string, batch int, loss double")
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "dataset string")
    got = {r["dataset"]: (r["loss"], r["batches"]) for r in evaluate.validation_loss(losses, names).collect()}
    assert got["a"] == (2.0, 2) and got["overall"] == (2.0, 3) and got["c"][0] != got["c"][0]


def test_log_windows(spark):
    log = spark.range(60).select(F.lit("r").alias("run"), F.col("id").alias("step"), F.lit(2.0).alias("step_sec"))
    last = trainlog.timed(log, 100, "run").orderBy(F.desc("step")).first()
    assert (last["rolling_sec"], last["elapsed_sec"], last["eta_sec"]) == (2.0, 120.0, 80.0)
    assert [(r["step"], r["before"], r["stage"]) for r in trainlog.stage_changes(log, 20, "run").orderBy("step").collect()] == [(20, 0, 1), (40, 1, 2)]


def test_checks(spark):
    a = {k: 1 for k in checks.CONFIG_KEYS}
    checks.assert_equal_configs([a, dict(a)])
    with pytest.raises(ValueError, match="configuration 1 differs from the first in num_codebooks"):
        checks.assert_equal_configs([a, a | {"num_codebooks": 2}])
    with pytest.raises(ValueError):
        checks.assert_equal_configs([])
    df = spark.createDataFrame([("b",), ("a",), ("a",)], "k string")
    with pytest.raises(ValueError):
        checks.assert_unique(df, "k")
    assert checks.nth_sample(df, "k", 2).first()["k"] == "b"
    with pytest.raises(IndexError):
        checks.nth_sample(df, "k", 3)


def test_pipeline_over_segments(spark):
    from voxloom.sources.corpora import SEGMENTED

    seg = lambda s, b, e, t, tags: {"sid": s, "begin_time": b, "end_time": e, "subsets": tags, "text_tn": t}
    audios = [{"aid": "A", "source": "x", "subsets": [], "segments": [seg("1", 0.0, 1.0, "HI <PERIOD>", ["{XL}"]), seg("2", 0.0, 1.0, "<SIL>", ["{XL}"]), seg("3", 0.0, 1.0, "NO", ["{S}"]), seg("4", 0.0, 9.0, "X", None)]}, {"aid": "B", "source": "x", "subsets": [], "segments": [seg("5", 0.0, 2.0, "YO", ["{XL}"])]}]
    df = spark.createDataFrame([(audios,)], SEGMENTED)
    index = spark.createDataFrame([("A", "a.wav")], "stem string, path string")
    codes = spark.createDataFrame([("1", [[1], [2]], None)], "sid string, codes array<array<int>>, error string")
    out = {(r["sid"], r["task"]): r for r in pipeline.segment_samples(df, index, codes, "XL", "both").collect()}
    assert {k[0]: r["disposition"] for k, r in out.items()} == {"1": "written", "2": "garbage", "5": "missing_audio"}
    assert out["1", "asr"]["target_text"] == "hi." and out["1", "tts"]["target_speech"] == [[1], [2]] and out["1", "tts"]["sample_id"] == "segments-xl-tts-1"
    assert {r["disposition"] for r in pipeline.segment_samples(df, index, codes, "XL", dry=True).collect()} == {"available", "missing_audio"}


def test_rows_to_generate_for(spark):
    rows = [("a", [1, 2], [-100, 2], None), ("b", [1, 2], [1, 2], [1, 1]), ("c", [1, 2, 3], [-100, -100, 3], [1, 1, 0]), ("d", [1], [-100], [1])]
    df = spark.createDataFrame(rows, "k string, input_ids array<int>, labels array<int>, attention_mask array<tinyint>")
    got = {r["k"]: (r["prompt"], r["target"], r["budget"]) for r in load.generation_inputs(df, "k", 8, limit=2).collect()}
    assert got == {"a": ([1], [2], 9), "c": ([1, 2], [], 8)}
    assert load.generation_inputs(df, "k", 8, fixed=5).select("budget").distinct().collect() == [(5,)]


def test_batches_number_keys_only(spark):
    df = spark.createDataFrame([(k, list(range(n))) for k, n in (("a", 3), ("b", 9), ("c", 1))], "k string, input_ids array<int>")
    got = {r["k"]: (r["batch"], r["padded_length"], r["batch_rows"]) for r in load.batches(df, "k", rows=2).collect()}
    assert got == {"a": (0, 16, 2), "b": (0, 16, 2), "c": (1, 8, 1)}


def test_targets_without_labels_are_refused(spark):
    assert [r[0] for r in spark.createDataFrame([([-100],), ([-100, 1],), ([],), (None,)], "x array<int>").select(pack.has_target(F.col("x"))).collect()] == [False, True, False, False]
    packer = pack.Packer(IdSpace("m", 100, 1, 4, {}), lambda c: pack.hashed_words(c, 100), pack.IGNORE)
    cols = "sample_id string, dataset string, split string, task string, input_text string, target_text string, question_text string, input_text_token array<int>, target_text_token array<int>, input_speech array<array<int>>, target_speech array<array<int>>"
    one = spark.createDataFrame([("s", "d", "train", "text_dialog_sft", None, None, None, [1], [], None, None)], cols)
    assert packer.pack(one, on_error="quarantine").first()["error"] == "no target id remains"


def test_draws_of_an_empty_data_set_are_an_error(spark):
    rows = spark.createDataFrame([("a", "x")], "dataset string, k string")
    assert mixture.mixed(mixture.draws(spark, 5, {"a": 1.0}), rows, "k").count() == 5
    with pytest.raises(ValueError, match="no rows to draw of b"):
        mixture.mixed(mixture.draws(spark, 5, {"b": 1.0}), rows, "k")


def test_curriculum_of_draws(spark):
    got = mixture.curriculum_draws(spark, 40, {"a": (1.0, 0.0), "b": (0.0, 1.0)}, batch=2, every=5).collect()
    assert {(r["stage"], r["dataset"]) for r in got if r["stage"] in (0, 3)} == {(0, "a"), (3, "b")}


def test_names_and_maps(spark):
    df = spark.createDataFrame([("a", 3), ("b", 1), ("a", 0), (None, 2)], "v string, o int")
    assert [tuple(r) for r in checks.distinct_in_order(df, "v", "o").collect()] == [("a", 0), ("b", 1), (None, 2)]
    with pytest.raises(ValueError):
        checks.assert_known(df, ["a"], "v")
    checks.assert_known(df.filter("v = 'a'"), ["a"], "v")
    c = spark.createDataFrame([(0, {"x": 1, "y": 2}), (1, {"y": 2, "x": 1}), (2, {"x": 1}), (3, None)], "i int, m map<string,int>")
    assert sorted(tuple(r) for r in checks.differing_keys(c, "i", ["m"]).collect()) == [(2, "m"), (3, "m")]
    assert chat.ChatTemplate().opening_after("ab", "abc") == "c"
    with pytest.raises(ValueError):
        chat.ChatTemplate().opening_after("ab", "xbc")

