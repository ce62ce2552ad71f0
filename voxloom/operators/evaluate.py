"""Predictions to summaries: per data set and over all, in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.metrics import exact_match, route, sentence_bleu, word_error_rate
from voxloom.functions.text import squeeze

ALL = "ALL_DATASETS"
METRICS = ("wer", "bleu", "exact_match")


def measured(predictions: DataFrame) -> DataFrame:
    """Predictions with metric_name, metric_value and text_exact_match.

    Rows with a speech target have no metric. A blank reference has no metric value, but it does have an exact
    match: two blank texts match.
    """
    text = ~F.col("target_has_speech")
    p, r = F.col("pred_text"), F.col("target_text")
    name = route(F.col("task"), F.col("dataset"))
    # a Python function sees every row whatever branch it stands in: rows of other metrics reach it as null
    only = lambda f, m: f(F.when(text & (name == m), p), F.when(text & (name == m), r))
    value = F.when(name == "wer", only(word_error_rate, "wer")).when(name == "bleu", only(sentence_bleu, "bleu")).otherwise(exact_match(p, r))
    return predictions.withColumns(
        {"metric_name": F.when(text, name), "metric_value": F.when(text, value), "text_exact_match": F.when(text, (squeeze(p) == squeeze(r)).cast("double"))}
    )


def summary(measured_: DataFrame) -> DataFrame:
    """One row per data set and one for all: counts, tasks, means of each metric over its rows, rates.

    A mean over no rows is null. The grand total is computed from the rows, not from the means, by grouping sets.
    """
    text, speech = ~F.col("target_has_speech"), F.col("target_has_speech")
    said = F.length(squeeze(F.col("pred_text"))) > 0
    wanted = [
        F.count("*").alias("num_samples"),
        F.count_if(text).alias("num_text_target_samples"),
        F.count_if(speech).alias("num_speech_target_samples"),
        F.sort_array(F.collect_set(F.coalesce("task", F.lit("unknown")))).alias("tasks"),
    ]
    for m in METRICS:
        v = F.when(text & (F.col("metric_name") == m), F.col("metric_value"))
        wanted += [F.avg(v).alias(f"{m}_mean"), F.nullif(F.count(v), F.lit(0)).alias(f"{m}_num_samples")]
    em = F.when(text, F.col("text_exact_match"))
    wanted += [
        F.avg(em).alias("text_exact_match_mean"),
        F.when(F.count_if(text) > 0, F.count_if(text & said)).alias("nonempty_pred_text_count"),
        F.avg(F.when(text, said.cast("double"))).alias("nonempty_pred_text_rate"),
        F.when(F.count_if(speech) > 0, F.count_if(speech & F.col("pred_has_speech"))).alias("speech_pred_present_count"),
        F.avg(F.when(speech, F.col("pred_has_speech").cast("double"))).alias("speech_pred_present_rate"),
        F.when(F.count_if(speech) > 0, F.count_if(speech & said)).alias("nonempty_pred_text_on_speech_targets_count"),
    ]
    sets = measured_.groupingSets([["dataset"], []], "dataset").agg(F.grouping("dataset").alias("__g"), *wanted)
    return sets.withColumn("dataset", F.when(F.col("__g") == 1, ALL).otherwise(F.col("dataset"))).drop("__g")


def validation_loss(losses: DataFrame, names: DataFrame, max_batches: int | None = None) -> DataFrame:
    """dataset, loss, perplexity, batches for every name and overall: means of batch means, NaN without batches.

    `losses` (dataset, batch, loss); with `max_batches` only batches below it count. `names` (dataset) is the
    configured list.
    """
    rows = losses if max_batches is None else losses.filter(F.col("batch") < max_batches)
    got = rows.groupingSets([["dataset"], []], "dataset").agg(F.grouping("dataset").alias("g"), F.sum("loss").alias("s"), F.count("loss").alias("batches"))
    got = got.select(F.when(F.col("g") == 1, "overall").otherwise(F.col("dataset")).alias("dataset"), "s", "batches")
    wanted = names.select("dataset").unionByName(names.sparkSession.createDataFrame([("overall",)], "dataset string"))
    mean = F.when(F.col("batches") > 0, F.col("s") / F.col("batches")).otherwise(F.lit(float("nan")))
    return wanted.join(got, "dataset", "left").select("dataset", mean.alias("loss"), F.exp(mean).alias("perplexity"), F.coalesce("batches", F.lit(0)).alias("batches"))


def loss_per_step(micro: DataFrame, accumulation: int) -> DataFrame:
    """step, loss: the micro-batch losses of a step summed over the accumulation."""
    return micro.groupBy("step").agg((F.sum("loss") / accumulation).alias("loss"))
