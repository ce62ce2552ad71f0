import math

import pytest
from pyspark.sql import functions as F

from voxloom.functions import ids, metrics, schedule, speech, text
from voxloom.functions.speech import IdSpace

SPACE = IdSpace("m", 100, 2, 10, {"eos": 1})


def one(spark, *cols, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" if isinstance(v, (str, type(None))) else f"{k} {'double' if isinstance(v, float) else 'bigint'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(*cols).first()


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HELLO <COMMA> WORLD <PERIOD>", "hello, world."),
        ("<MUSIC> <NOISE>", ""),
        ("IT <APOSTROPHE> S", "it ' s"),
        ("A<<X>>B", "a< >b"),
        ("\t A   B \n", "a b"),
        (None, ""),
    ],
)
def test_spoken_text(spark, raw, want):
    assert one(spark, text.spoken_text(F.col("t")).alias("o"), t=raw)["o"] == want


def test_squeeze_takes_unicode_white_space(spark):
    raw = "a\x0bb\x1cc\x85d\xa0e f​g"
    assert one(spark, text.squeeze(F.col("t")).alias("o"), t=raw)["o"] == " ".join(raw.split())


def test_speechless_is_one_tag_and_nothing_else(spark):
    got = [one(spark, text.is_speechless(F.col("t")).alias("o"), t=x)["o"] for x in (" <SIL> ", "<sil>", "<SIL> <SIL>", None)]
    assert got == [True, False, False, False]


def test_roles_and_fields(spark):
    assert [one(spark, text.role(F.col("t")).alias("o"), t=x)["o"] for x in (" Human ", "GPT", "tool", None)] == ["user", "assistant", "tool", ""]
    assert one(spark, text.first_filled(F.col("a"), F.col("b")).alias("o"), a=" ", b="x")["o"] == "x"
    assert one(spark, text.first_filled(F.col("a")).alias("o"), a=None)["o"] == ""


def test_task_by_hash_is_strict(spark):
    rows = spark.range(2000).select(ids.task_by_hash(F.col("id").cast("string")).alias("t")).groupBy("t").count().collect()
    assert {r["t"] for r in rows} == {"asr", "tts"} and all(r["count"] > 850 for r in rows)
    assert spark.range(50).select(ids.task_by_hash(F.col("id").cast("string"), 0.0).alias("t")).distinct().collect()[0]["t"] == "tts"
    with pytest.raises(ValueError):
        ids.task_by_hash(F.lit("x"), 1.5)


def test_ordinals_and_shards(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = {r["k"]: r["ordinal"] for r in ids.with_ordinal(rows.repartition(7), "k").collect()}
    assert got == {k: k for k in range(1000)}
    assert spark.range(10).select(ids.shard(F.col("id"), 4).alias("s")).groupBy("s").count().orderBy("s").collect() == [(0, 4), (1, 4), (2, 2)]
    with pytest.raises(ValueError):
        ids.worker_share(F.col("x"), start=5, end=5)
    with pytest.raises(ValueError):
        ids.worker_share(F.col("x"), workers=2, worker=2)


def test_speech_ids_there_and_back(spark):
    df = spark.createDataFrame([([[0, 9, 3], [1, 2, 9]],), ([[], []],), (None,)], "c array<array<int>>")
    rows = df.select("c", speech.speech_ids(F.col("c"), SPACE).alias("i"))
    got = rows.select("c", "i", speech.speech_codes(F.col("i"), SPACE).alias("b")).collect()
    assert got[0]["i"] == [100, 111, 109, 112, 103, 119] and got[0]["b"] == got[0]["c"]
    assert got[1]["i"] == [] and got[1]["b"] == [[], []] and got[2]["i"] is None


@pytest.mark.parametrize("codes", [[[1, 2]], [[1, 2], [1]], [[10], [0]], [[-1], [0]]])
def test_bad_codes_are_errors(spark, codes):
    df = spark.createDataFrame([(codes,)], "c array<array<int>>")
    with pytest.raises(Exception):
        df.select(speech.speech_ids(F.col("c"), SPACE)).collect()


@pytest.mark.parametrize("bad", [[100], [110, 101], [5, 110]])
def test_unaligned_ids_are_errors(spark, bad):
    df = spark.createDataFrame([(bad,)], "i array<int>")
    with pytest.raises(Exception):
        df.select(speech.speech_codes(F.col("i"), SPACE)).collect()


def test_modality_runs_tile_and_alternate(spark):
    x = [5, 6, 100, 111, 101, 7, 112]
    df = spark.createDataFrame([(x,), ([],)], "i array<int>")
    full, none = (r["r"] for r in df.select(speech.modality_runs(F.col("i"), SPACE).alias("r")).collect())
    assert [(r["type"], r["start"], r["stop"]) for r in full] == [("text", 0, 2), ("speech", 2, 5), ("text", 5, 6), ("speech", 6, 7)]
    assert sum((r["ids"] for r in full), []) == x and none == []
    state = speech.speech_run_state(df.withColumn("k", F.lit(1)), "k", "i", SPACE).orderBy("segment_index").collect()
    assert [(r["raw_num_tokens"], r["usable_num_tokens"], r["trimmed_incomplete_tail"], r["decodable"]) for r in state] == [(3, 2, True, True), (1, 0, True, False)]


def test_id_space():
    assert (SPACE.offset, SPACE.speech_size, SPACE.full_size, SPACE.pad_id()) == (100, 20, 120, 1)
    assert len(SPACE.config()) == 8
    with pytest.raises(ValueError):
        IdSpace("m", 10).pad_id()


def test_schedules(spark):
    s = spark.createDataFrame([(0,), (1500,), (3000,), (51500,), (100000,), (200000,)], "s int")
    got = [r[0] for r in s.select(schedule.learning_rate(F.col("s"), 100_000, 3000, 0.1)).collect()]
    want = [0.0, 0.5, 1.0, 0.1 + 0.9 * 0.5, 0.1, 0.1]
    assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(got, want, strict=True))
    assert [r[0] for r in s.select(schedule.stage(F.col("s"), 1500)).collect()] == [0, 1, 2, 3, 3, 3]
    with pytest.raises(ValueError):
        schedule.learning_rate(F.lit(1), 10, kind="step")
    with pytest.raises(ValueError):
        schedule.stage(F.lit(1), 0)
    assert schedule.accumulation_steps(64, 4, 4) == 4 and schedule.checkpoint_names(42, "end") == ("step-00000042-end", "latest")
    with pytest.raises(ValueError):
        schedule.accumulation_steps(10, 4, 4)


def test_duration_text(spark):
    s = spark.createDataFrame([(93784.9,), (3600.0,), (61.0,), (9.0,)], "s double")
    assert [r[0] for r in s.select(schedule.duration_text(F.col("s"))).collect()] == ["1d 02h 03m 04s", "01h 00m 00s", "01m 01s", "9s"]


def test_round_up(spark):
    s = spark.createDataFrame([(1,), (8,), (9,)], "n int")
    assert [r[0] for r in s.select(schedule.round_up(F.col("n"), 8)).collect()] == [8, 8, 16]
    assert [r[0] for r in s.select(schedule.round_up(F.col("n"), None)).collect()] == [1, 8, 9]


def test_metrics(spark):
    df = spark.createDataFrame([("a b c", "a x c"), ("", "a b"), ("a", " "), (None, None), ("a  b", "a b")], "p string, r string")
    wer = [r[0] for r in df.select(metrics.word_error_rate(F.col("p"), F.col("r"))).collect()]
    assert wer[:2] == [1 / 3, 1.0] and wer[2] is None and wer[3] is None and wer[4] == 0.0
    em = [r[0] for r in df.select(metrics.exact_match(F.col("p"), F.col("r"))).collect()]
    assert em == [0.0, 0.0, None, None, 1.0]
    assert metrics.bleu("the cat sat on the mat", "the cat sat on the mat") == pytest.approx(100.0)
    assert metrics.bleu("a b", "a b") == 0.0  # no four words, no score
    assert 0 < metrics.bleu("the cat sat on a mat today", "the cat sat on the mat today") < 100


def test_metric_routes(spark):
    df = spark.createDataFrame([("asr", "x"), ("tts", "gigaspeech_tts"), ("other", "commonvoice"), ("speech_to_text_translation", "covost2"), ("qa", "covost2"), ("qa", "spoken_squad"), (None, None)], "t string, d string")
    assert [r[0] for r in df.select(metrics.route(F.col("t"), F.col("d"))).collect()] == ["wer", "exact_match", "wer", "bleu", "bleu", "exact_match", "exact_match"]
