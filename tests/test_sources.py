import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import build
from voxloom.sources import audio, configs, corpora, nested, shards, sinks


def wav(path, seconds=1.0, rate=24000, channels=1):
    t = np.arange(int(seconds * rate)) / rate
    x = (np.sin(2 * np.pi * 220 * t) * 8000).astype("<i2")
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels), f.setsampwidth(2), f.setframerate(rate)
        f.writeframes(np.repeat(x, channels).tobytes())


def test_translation_tsv(spark, tmp_path):
    p = tmp_path / "a.tsv"
    p.write_text('path\tsentence\ttranslation\tclient_id\na.mp3\the "said"\ter\tc\nshort\trow\nb.mp3\tx\t\tc\nwide\t1\t2\t3\t4\n', encoding="utf-8")
    rows = corpora.translation_tsv(spark, str(p)).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["path"], r["sentence"], r["translation"]) for r in rows] == [(0, "a.mp3", 'he "said"', "er"), (1, "b.mp3", "x", "")]
    (tmp_path / "b.tsv").write_text("path\tsentence\n")
    with pytest.raises(ValueError):
        corpora.translation_tsv(spark, str(tmp_path / "b.tsv"))
    head = "path\tsentence\ttranslation\tclient_id\n"
    (tmp_path / "d").mkdir()
    for n in "ab":
        (tmp_path / "d" / f"{n}.tsv").write_text(head + f"{n}.mp3\tx\ty\tc\n" + head * (n == "b"))
    assert [r["path"] for r in corpora.translation_tsv(spark, str(tmp_path / "d")).orderBy("ordinal").collect()] == ["a.mp3", "b.mp3", "path"]
    (tmp_path / "d" / "c.tsv").write_text("x\ty\tz\tc\n")
    with pytest.raises(ValueError):
        corpora.translation_tsv(spark, str(tmp_path / "d"))


def test_clips_tsv(spark, tmp_path):
    p = tmp_path / "c.tsv"
    p.write_text('path\tsentence\ttext\na.mp3\t"two\nlines"\t\nb.mp3\t \tfrom text\n', encoding="utf-8")
    rows = corpora.clips_tsv(spark, str(p)).orderBy("path").collect()
    assert [r["text_used"] for r in rows] == ["two\nlines", "from text"]
    assert corpora.physical_rows(spark, str(p)) == 3


def test_nested_json(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"audios": [{"aid": "A", "source": "s", "segments": [{"sid": "1", "begin_time": 0, "end_time": 1.5, "subsets": ["{XL}"], "text_tn": "T"}]}]}, indent=1))
    assert build.unnest_segments(corpora.segmented_json(spark, str(tmp_path / "g.json")), "XL").first()["end_time"] == 1.5
    many = {"audios": [{"aid": f"A{i}", "segments": [{"sid": f"{i}", "subsets": ["{XL}"]}]} for i in range(9)]}
    (tmp_path / "m.json").write_text(json.dumps(many))
    got = build.unnest_segments(corpora.segmented_json(spark, str(tmp_path / "m.json")), "XL").collect()
    assert sorted((r["audio_idx"], r["aid"]) for r in got) == [(i, f"A{i}") for i in range(9)]
    (tmp_path / "q.json").write_text(json.dumps({"data": [{"title": "t", "paragraphs": [{"context": "c", "qas": [{"id": "1", "question": "q", "answers": [{"text": "a"}]}]}]}]}))
    assert build.unnest_questions(corpora.questions_json(spark, str(tmp_path / "q.json"))).first()["answer_text"] == "a"


def test_chats_keep_file_order(spark, tmp_path):
    for n in (1, 0):
        spark.createDataFrame([([{"role": "user", "content": f"{n}-{i}"}],) for i in range(3)], corpora.MESSAGES).coalesce(1).write.parquet(str(tmp_path / f"x{n}"))
        next((tmp_path / f"x{n}").glob("*.parquet")).rename(tmp_path / f"train-{n}.parquet")
    rows = corpora.chats_parquet(spark, str(tmp_path), "train-*.parquet").orderBy("ordinal").collect()
    assert [r["messages"][0]["content"] for r in rows] == ["0-0", "0-1", "0-2", "1-0", "1-1", "1-2"]


def test_audio(spark, tmp_path):
    wav(tmp_path / "1_0_0.wav", 1.0), wav(tmp_path / "1_0_10.wav", 0.5, 48000, 2), wav(tmp_path / "1_0_2.wav", 0.25)
    index = audio.file_index(spark, str(tmp_path))
    assert {r["stem"] for r in index.collect()} == {"1_0_0", "1_0_10", "1_0_2"}
    names = build.ordered_recordings(index).first()["files"]
    assert [n.rsplit("/", 1)[1] for n in names] == ["1_0_0.wav", "1_0_2.wav", "1_0_10.wav"]
    files = spark.read.format("binaryFile").load(str(tmp_path)).select(F.element_at(F.split("path", "/"), -1).alias("key"), "content")
    files = files.withColumns({"begin": F.lit(None).cast("double"), "end": F.lit(None).cast("double")})
    bad = spark.createDataFrame([("bad", bytearray(b"no"), None, None)], files.schema)
    got = {r["key"]: r for r in audio.encoded(files.unionByName(bad)).collect()}
    assert got["1_0_10.wav"]["duration_sec"] == 0.5 and len(got["1_0_0.wav"]["codes"]) == 4 and len(got["1_0_0.wav"]["codes"][0]) == 12 and got["bad"]["error"]
    x, rate = audio.decoded((tmp_path / "1_0_0.wav").read_bytes(), 0.5, 0.75)
    assert len(x) == 6000 and rate == 24000
    with pytest.raises(ValueError):
        audio.decoded((tmp_path / "1_0_0.wav").read_bytes(), 0.5, 0.5)
    rec = spark.createDataFrame([("p", 1, "b", [[3], [4]], 0.5), ("p", 0, "a", [[1], [2]], 0.25)], "passage string, place int, path string, codes array<array<int>>, duration_sec double")
    r = audio.joined_passages(rec).first()
    assert r["codes"] == [[1, 3], [2, 4]] and r["duration_sec"] == 0.75 and r["files"] == ["a", "b"]


def test_resampling_keeps_low_and_drops_high_tones():
    t = np.arange(48000) / 48000
    low, high = np.sin(2 * np.pi * 440 * t), np.sin(2 * np.pi * 17000 * t)
    got = audio.resampled(low, 48000)
    assert len(got) == 24000 and np.abs(got - np.sin(2 * np.pi * 440 * np.arange(24000) / 24000))[100:-100].max() < 1e-3
    assert np.abs(audio.resampled(high, 48000))[100:-100].max() < 0.01
    assert len(audio.resampled(np.zeros(0), 8000)) == 0 and audio.resampled(low[:8000], 8000).shape == (24000,)


def test_codes_to_a_recording_and_back(spark):
    codes = [[0, 2046, 7], [1, 2, 3], [9, 9, 9], [2046, 1024, 5]]
    rows = spark.createDataFrame([("a", codes), ("none", None), ("empty", [[], [], [], []])], "key string, codes array<array<int>>")
    got = {r["key"]: r for r in audio.decoded_codes(rows).collect()}
    x, rate = audio.decoded(bytes(got["a"]["wav"]))
    assert rate == audio.RATE and len(x) == got["a"]["samples"] == 3 * 1920 and got["none"]["error"] and got["empty"]["samples"] == 0
    assert audio.stand_in_codec(x).tolist() == codes


def test_tar_shards_there_and_back(spark, tmp_path):
    rows = [(f"k{i:03d}", json.dumps({"n": i, "t": "é"}), [i, i + 1], [1, 0], [[i, 1], [2, 3]]) for i in range(25)]
    df = spark.createDataFrame(rows, "key string, json string, a array<int>, m array<tinyint>, c array<array<int>>").repartition(2)
    arrays = F.create_map(F.lit("a"), shards.vector(F.col("a")), F.lit("m"), shards.vector(F.col("m"), "int8"), F.lit("c"), shards.matrix(F.col("c")))
    shards.write(df.withColumn("arrays", arrays), str(tmp_path / "s"), maxcount=5)
    files = sorted((tmp_path / "s").glob("*.tar"))
    back = shards.read(spark, str(tmp_path / "s"))
    got = back.select("key", "json", "arrays.a.values", "arrays.m.values", shards.rows_of(F.col("arrays.c")))
    assert sorted(tuple(r) for r in got.collect()) == rows and len(files) >= 5
    assert [p.name for p in (tmp_path / "s").iterdir() if not p.name.endswith(".tar")] == []
    assert [r["place"] for r in shards.in_order(back).orderBy("shard", "ordinal").collect()] == list(range(25))
    first = shards.inspected(str(files[0]), 0)
    assert {k: (v.dtype.name, v.shape) for k, v in first["arrays"].items()} == {"a": ("int32", (2,)), "m": ("int8", (2,)), "c": ("int32", (2, 2))}
    assert first["arrays"]["a"][0] == first["meta"]["n"]
    assert shards.write_inspection(first, str(tmp_path / "look"), {"prompt": "x" * 5000}, {"seg0": b"RIFF"}, 100) == {"prompt": "x" * 100}
    assert {p.name.split(".", 1)[1] for p in (tmp_path / "look").iterdir()} == {"meta.json", "arrays.npz", "prompt.txt", "seg0.wav"}
    with pytest.raises(IndexError):
        shards.inspected(str(files[0]), 99)
    with pytest.raises(FileNotFoundError):
        shards.resolve(_empty(tmp_path))
    assert shards.resolve("/not/there.tar") == ["/not/there.tar"] and shards.resolve(f"file:{files[0]}") == [f"file:{files[0]}"]


def test_a_failing_write_leaves_no_shard(spark, tmp_path):
    ok = F.create_map(F.lit("a"), shards.vector(F.array(F.lit(1))))
    df = spark.range(40).select(F.concat(F.lit("k"), "id").alias("key"), F.when(F.col("id") != 39, "{}").alias("json"), ok.alias("arrays"))
    with pytest.raises(Exception):  # noqa: B017 - whatever Spark makes of it
        shards.write(df.coalesce(2), str(tmp_path / "s"), maxcount=3)
    assert not list((tmp_path / "s").glob("**/*.tar"))
    shards.write(df.filter("id < 39"), str(tmp_path / "s"), maxcount=3)
    assert shards.read(spark, str(tmp_path / "s")).count() == 39


def test_nested_items_stream():
    doc = {"z": {"audios": [{"no": 1}]}, "pre": [1, {"x": "}]"}], "audios": [{"n": i, "s": 'a"\\{[' * i} for i in range(9)], "post": {}}
    for size in (1, 3, 50, 10_000):
        text = json.dumps(doc, indent=1)
        assert [json.loads(x) for x in nested.items(iter([text[i : i + size] for i in range(0, len(text), size)]), "audios")] == doc["audios"]
    assert list(nested.items(iter(["{}"]), "audios")) == list(nested.items(iter([]), "audios")) == []
    with pytest.raises(ValueError):
        list(nested.items(iter(['{"audios": [{"a": 1}, {']), "audios"))


def _empty(tmp_path):
    (tmp_path / "none").mkdir(exist_ok=True)
    return str(tmp_path / "none")


def test_sinks_and_configs(spark, tmp_path):
    df = spark.range(10).select(F.concat(F.lit("k"), "id").alias("k"), F.when(F.col("id") < 3, "asr").otherwise("tts").alias("task"))
    assert [r["shard_name"] for r in sinks.sharded(df, "k", maxcount=4).orderBy("k").collect()] == ["shard-000000"] * 4 + ["shard-000001"] * 4 + ["shard-000002"] * 2
    sinks.write_routed(df, str(tmp_path / "r"), "task", maxcount=2)
    assert {p.name for p in (tmp_path / "r").glob("task=*")} == {"task=asr", "task=tts"}
    path = sinks.write_config({"num_codebooks": 4}, str(tmp_path / "d"))
    assert configs.load(path) == {"num_codebooks": 4} and corpora.tokenizer_config(spark, str(tmp_path / "d")).first()["num_codebooks"] == 4
    sinks.write_predictions(spark.createDataFrame([("a", None)], "x string, y string"), str(tmp_path / "p"))
    assert spark.read.text(str(tmp_path / "p")).first()[0] == '{"x":"a","y":null}'
    s = spark.createDataFrame([("a", 1, None), ("b", 2, 0.5)], "dataset string, n int, v double")
    sinks.write_summary(s, str(tmp_path / "sum"))
    assert json.loads((tmp_path / "sum" / "summary.json").read_text()) == {"a": {"dataset": "a", "n": 1}, "b": {"dataset": "b", "n": 2, "v": 0.5}}
    assert json.loads((tmp_path / "sum" / "b" / "summary.json").read_text())["v"] == 0.5
    assert configs.filled(["a/{n}", "b"], n=4) == ["a/4", "b"] and configs.output_address("o/{n}", n=1) == "o/1"
    with pytest.raises(TypeError):
        configs.output_address(["x"])


def test_stream_equals_batch(spark, tmp_path):
    from voxloom.streaming import raw

    df = spark.createDataFrame([("a", "HI <PERIOD>", 1.0), ("b", "<SIL>", 1.0), ("c", "X", 500.0)], "k string, t string, s double")
    df.write.parquet(str(tmp_path / "in"))
    rows = raw.with_outcomes(raw.transcripts(spark, str(tmp_path / "in"), "k string, t string, s double"), "t", "s", "k")
    raw.write_written(rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a"]
    raw.count_outcomes(rows, "counted", str(tmp_path / "cp2")).awaitTermination()
    assert {r["disposition"]: r["rows"] for r in spark.table("counted").collect()} == {"written": 1, "garbage": 1, "bad_duration": 1}
