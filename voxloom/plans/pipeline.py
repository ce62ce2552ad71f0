"""The stages put together: raw corpora to samples, samples to sequences, sequences to a mixture, predictions to a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions import ids
from voxloom.functions.text import spoken_text
from voxloom.operators import build, evaluate, load, mixture
from voxloom.operators.pack import Packer


def segment_samples(audios: DataFrame, index: DataFrame, codes: DataFrame, size: str, mode: str = "mixed", asr_ratio: float = 0.5, dry: bool = False, **share) -> DataFrame:
    """Segments of one subset to samples for their tasks, with every outcome kept in `disposition`.

    `index` (stem, path), `codes` (sid, codes, error). Workers share recordings by their absolute place. Cheap text
    rules come before the join with codes, so that only rows that may be written meet it.
    """
    rows = build.unnest_segments(audios, size).filter(ids.worker_share(F.col("audio_idx"), **share))
    rows = build.with_audio(rows, index, "aid").withColumn("seconds", F.col("end_time") - F.col("begin_time"))
    rows = rows.withColumn("disposition", build.transcript_disposition(F.col("text_tn"), F.col("seconds"), F.col("audio_path").isNotNull(), F.col("sid"), dry=dry))
    if dry:
        return rows
    got = rows.join(codes, "sid", "left")
    failed = (F.col("disposition") == "written") & F.col("codes").isNull()
    got = got.withColumn("disposition", F.when(failed, "failed").otherwise(F.col("disposition"))).withColumn("text", spoken_text(F.col("text_tn")))
    out = build.fan_out(got, "sid", mode, "text", "codes", asr_ratio)
    return out.withColumn("sample_id", F.concat(F.lit(f"segments-{size.lower()}-"), F.col("task"), F.lit("-"), F.col("sid")))


def packed(samples: DataFrame, packer: Packer, on_error: str = "raise") -> DataFrame:
    """Samples to sequences; one stage without a shuffle."""
    return packer.pack(samples, on_error)


def training_batches(sequences: DataFrame, weights: dict[str, float], draws: int, batch: int, pad_id: int, seed: int = 0, max_length: int = 32000) -> DataFrame:
    """Sequences (dataset, sample_id, input_ids, labels, attention_mask) to padded batches of a weighted mixture.

    Draws, batches and their lengths are settled by keys and sizes; sequences move once, to their draws."""
    rows = load.loadable(sequences, max_length)
    order = mixture.draws(sequences.sparkSession, draws, weights, seed)
    chosen = mixture.mixed(order, rows.select("dataset", "sample_id"), "sample_id", seed)
    key = ["dataset", "sample_id"]
    thin = chosen.join(rows.select(*key, F.size("input_ids").alias("__size")), key).withColumn("batch", F.floor(F.col("draw") / batch))
    thin = thin.join(load.longest(thin, "batch", F.col("__size")), "batch").drop("__size")
    return load.padded(thin.join(rows, key), "batch", pad_id)


def report(predictions: DataFrame) -> DataFrame:
    """Predictions to summaries per data set and overall."""
    return evaluate.summary(evaluate.measured(predictions))
