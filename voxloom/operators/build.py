"""Raw corpora to raw samples: ordered outcomes, task fan-out, unnesting, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions import ids
from voxloom.functions.text import filled, is_speechless, spoken_text

MIN_SECONDS, MAX_SECONDS = 0.2, 120.0


def bad_duration(seconds: Column, least: float = MIN_SECONDS, most: float = MAX_SECONDS) -> Column:
    """Outside [least, most]; a missing or not-a-number duration is bad too."""
    return ~F.coalesce(seconds.between(least, most) & ~F.isnan(seconds), F.lit(False))


def in_subset(subsets: Column, size: str) -> Column:
    """Whether a list of tags such as {XL} holds a size; a null list holds none."""
    return F.array_contains(F.coalesce(subsets, F.array().cast("array<string>")), F.lit("{" + size + "}"))


def transcript_disposition(
    raw: Column, seconds: Column, has_audio: Column, sid: Column, least: float = MIN_SECONDS, most: float = MAX_SECONDS, dry: bool = False
) -> Column:
    """The outcome of a transcribed segment, the first that holds: missing_audio, garbage, empty_text, bad_duration,
    failed, written. A dry run stops after the audio check and calls the rest available."""
    out = F.when(~F.coalesce(has_audio, F.lit(False)), "missing_audio")
    if dry:
        return out.otherwise("available")
    out = out.when(is_speechless(raw), "garbage").when(spoken_text(raw) == "", "empty_text")
    return out.when(bad_duration(seconds, least, most), "bad_duration").when(filled(sid).isNull(), "failed").otherwise("written")


def clip_disposition(path: Column, text: Column, seconds: Column, has_audio: Column, least: float = MIN_SECONDS, most: float = MAX_SECONDS, dry: bool = False) -> Column:
    """The outcome of a read clip: failed (no path), empty_text, missing_audio, bad_duration, written. A dry run goes as
    far as the duration and calls the rest available."""
    return (
        F.when(filled(path).isNull(), "failed")
        .when(filled(text).isNull(), "empty_text")
        .when(~F.coalesce(has_audio, F.lit(False)), "missing_audio")
        .when(bad_duration(seconds, least, most), "bad_duration")
        .otherwise("available" if dry else "written")
    )


def encoded_disposition(has_audio: Column, failed: Column, dry: bool = False) -> Column:
    """The outcome of a translation pair or a question on a passage: missing_audio, failed (its recording cannot be
    encoded), written. A dry run stops after the audio check and calls the rest available."""
    out = F.when(~F.coalesce(has_audio, F.lit(False)), "missing_audio")
    return out.otherwise("available") if dry else out.when(F.coalesce(failed, F.lit(True)), "failed").otherwise("written")


def counters(df: DataFrame, *by: str) -> DataFrame:
    """Rows by outcome (and `by`): one aggregation, combined before the shuffle."""
    return df.groupBy(*by, "disposition").agg(F.count("*").alias("rows"))


def fan_out(df: DataFrame, key: str, mode: str, text: str, speech: str, asr_ratio: float = 0.5) -> DataFrame:
    """One row for each task of a key; asr reads speech and writes text, tts the other way round."""
    rows = df.withColumn("task", F.explode(ids.tasks(F.col(key), mode, asr_ratio)))
    asr = F.col("task") == "asr"
    return rows.withColumns({"input_text": F.when(~asr, F.col(text)), "target_text": F.when(asr, F.col(text)), "input_speech": F.when(asr, F.col(speech)), "target_speech": F.when(~asr, F.col(speech))})


def _outer(docs: DataFrame, name: str) -> DataFrame:
    """Each item of a nested list with its place: that of its row in the document where a reader gives one, else that in
    the list."""
    rows = docs.select(F.posexplode(name).alias("at", "x"), *(["place"] if "place" in docs.columns else []))
    place = F.col("place") + F.col("at") if "place" in docs.columns else F.col("at")
    return rows.select(place.cast("int").alias("at"), "x")


def unnest_questions(docs: DataFrame) -> DataFrame:
    """data -> paragraphs -> qas with their places; rows without a question or a first answer are dropped."""
    topic = _outer(docs, "data").select(F.col("at").alias("topic_idx"), F.col("x").alias("t"))
    para = topic.select("topic_idx", F.col("t.title").alias("title"), F.posexplode("t.paragraphs").alias("para_idx", "p"))
    qa = para.select("topic_idx", "para_idx", "title", F.col("p.context").alias("context_text"), F.posexplode("p.qas").alias("qa_idx", "q"))
    first = filled(F.try_element_at("q.answers", F.lit(1))["text"])
    out = qa.select("topic_idx", "para_idx", "qa_idx", "title", "context_text", F.col("q.id").alias("qa_id"), F.col("q.question").alias("question"), first.alias("answer_text"))
    return out.filter(filled(F.col("question")).isNotNull() & F.col("answer_text").isNotNull())


def unnest_segments(docs: DataFrame, size: str) -> DataFrame:
    """audios -> segments of one subset, with the absolute place of the audio."""
    audio = _outer(docs, "audios").select(F.col("at").alias("audio_idx"), F.col("x").alias("a"))
    seg = audio.select("audio_idx", F.col("a.aid").alias("aid"), F.col("a.source").alias("source"), F.explode("a.segments").alias("s"))
    return seg.select("audio_idx", "aid", "source", "s.*").filter(in_subset(F.col("subsets"), size))


def with_audio(df: DataFrame, index: DataFrame, key: str, stem: str = "stem") -> DataFrame:
    """`df` with the path of its audio, null where there is none. The index has unique stems (see unique_stems).

    A plain left join: Spark broadcasts the index where its statistics prove it small, else both sides shuffle.
    """
    return df.join(index.select(F.col(stem).alias(key), F.col("path").alias("audio_path")), key, "left")


def without_audio(df: DataFrame, index: DataFrame, key: str, stem: str = "stem") -> DataFrame:
    """The rows of `df` whose audio is missing."""
    return df.join(index.select(F.col(stem).alias(key)), key, "left_anti")


def unique_stems(index: DataFrame, stem: str = "stem") -> DataFrame:
    """The index; running it fails if a stem occurs twice."""
    counted = index.groupBy(stem).agg(F.count("*").alias("__n"), F.min("path").alias("path"))
    bad = F.raise_error(F.concat(F.lit("two files have the stem "), F.col(stem))).cast("string")
    return counted.select(stem, F.when(F.col("__n") == 1, F.col("path")).otherwise(bad).alias("path"))


def path_candidates(path: Column) -> Column:
    """The names an audio file may have, best first: with .wav, as given, then the same for the bare name."""
    bare = F.element_at(F.split(path, "/"), -1)
    wav = lambda c: F.concat(F.regexp_replace(c, r"\.[^./]*$", ""), F.lit(".wav"))
    return F.array(wav(path), path, wav(bare), bare)


def resolve_paths(df: DataFrame, files: DataFrame, path: str, key: str) -> DataFrame:
    """key, path and resolved: the first candidate that exists among `files` (path), else the first of all.

    One join on the exploded candidates and the best place for each key, in place of a join for each candidate.
    """
    each = df.select(key, path, F.posexplode(path_candidates(F.col(path))).alias("place", "candidate"))
    there = files.select(F.col("path").alias("candidate"), F.lit(True).alias("there")).distinct()
    got = each.join(there, "candidate", "left").groupBy(key, path)
    return got.agg(
        F.coalesce(F.min_by("candidate", F.when(F.col("there"), F.col("place"))), F.min_by("candidate", "place")).alias("resolved"),
        F.coalesce(F.bool_or("there"), F.lit(False)).alias("found"),
    )


def segment_frames(begin: Column, end: Column, rate: Column) -> Column:
    """(first, last) frame of a segment, rounded half to even, the first at least 0; an empty segment is an error."""
    a, b = F.greatest(F.bround(begin * rate).cast("bigint"), F.lit(0)), F.bround(end * rate).cast("bigint")
    empty = F.raise_error(F.lit("the segment is empty")).cast("bigint")
    return F.struct(a.alias("start"), F.when(b > a, b).otherwise(empty).alias("stop"))


def ordered_recordings(files: DataFrame) -> DataFrame:
    """topic, para, files: the recordings named topic_para_sentence in the order of their sentence numbers."""
    part = F.split("stem", "_")
    one = files.filter(F.col("stem").rlike(r"^\d+_\d+_\d+$"))
    one = one.select(part[0].cast("int").alias("topic"), part[1].cast("int").alias("para"), F.struct(part[2].cast("int").alias("n"), F.col("path").alias("path")).alias("f"))
    return one.groupBy("topic", "para").agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["path"]).alias("files"))
