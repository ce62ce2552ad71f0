"""Training schedules as columns: curriculum, learning rate, durations, and the arithmetic around them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAGES = 3


def stage(step: Column, every: int, enabled: bool = True) -> Column:
    """0 to 3, one more each `every` steps; always 0 when the curriculum is off."""
    if not enabled:
        return F.lit(0)
    if every <= 0:
        raise ValueError("a curriculum needs a positive interval")
    return F.least(F.floor(step / every), F.lit(STAGES)).cast("int")


def progress(stage_: Column) -> Column:
    """0, a third, two thirds, 1."""
    return F.greatest(F.least(stage_, F.lit(STAGES)), F.lit(0)) / F.lit(float(STAGES))


def weights_at(steps: DataFrame, specs: DataFrame, every: int, enabled: bool = True, step: str = "step") -> DataFrame:
    """step, stage, name, weight: the normalised weight of each data set at each step.

    `specs` (name, start_weight, end_weight) is a configuration of a few rows. Weights run linearly with the
    stage; a total that is not positive raises an error.
    """
    by_stage = stage_weights(specs)
    at = steps.select(step, stage(F.col(step), every, enabled).alias("stage"))
    bad = F.raise_error(F.lit("curriculum weights do not sum to more than zero")).cast("double")
    weight = F.when(F.col("total") > 0, F.col("raw") / F.col("total")).otherwise(bad)
    # the weights are four rows for each data set of the configuration
    return at.join(F.broadcast(by_stage), "stage").select(step, "stage", "name", weight.alias("weight"))


def stage_weights(specs: DataFrame) -> DataFrame:
    """stage, name, raw, total: the weight of each data set in each stage and their sum."""
    stages = specs.sparkSession.range(STAGES + 1).select(F.col("id").cast("int").alias("stage"))
    raw = F.col("start_weight") + progress(F.col("stage")) * (F.col("end_weight") - F.col("start_weight"))
    rows = stages.crossJoin(F.broadcast(specs)).select("stage", "name", raw.alias("raw"))
    return rows.withColumn("total", F.sum("raw").over(Window.partitionBy("stage")))


def learning_rate(step: Column, total: int, warmup: int = 0, minimum: float = 0.0, kind: str = "cosine") -> Column:
    """The factor on the base rate: linear warm-up, then cosine to `minimum` or constant."""
    if total <= 0:
        raise ValueError("total steps must be positive")
    if kind not in ("cosine", "constant"):
        raise ValueError(f"unknown schedule {kind}")
    rise = step / F.lit(float(max(1, warmup)))
    done = F.least(F.greatest((step - warmup) / F.lit(float(max(1, total - warmup))), F.lit(0.0)), F.lit(1.0))
    rest = F.lit(1.0) if kind == "constant" else minimum + (1.0 - minimum) * (0.5 * (1.0 + F.cos(F.lit(math.pi) * done)))
    return F.when(step < warmup, rise).otherwise(rest)


def perplexity(loss: Column) -> Column:
    return F.exp(loss)


def duration_text(seconds: Column) -> Column:
    """1d 02h 03m 04s and the like, without leading units of zero; parts of a second are cut off."""
    s = seconds.cast("bigint")
    d, h, m, r = F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60, s % 60
    return (
        F.when(d > 0, F.format_string("%dd %02dh %02dm %02ds", d, h, m, r))
        .when(h > 0, F.format_string("%02dh %02dm %02ds", h, m, r))
        .when(m > 0, F.format_string("%02dm %02ds", m, r))
        .otherwise(F.format_string("%ds", r))
    )


def round_up(n: Column, multiple: int | None) -> Column:
    """The next multiple; n itself without one."""
    return n if multiple is None else (F.floor((n + (multiple - 1)) / multiple) * multiple).cast("int")


def accumulation_steps(global_batch: int, devices: int, per_device: int) -> int:
    """Micro-batches per step; an uneven split is an error."""
    if devices < 1 or per_device < 1 or global_batch % (devices * per_device):
        raise ValueError(f"a batch of {global_batch} does not divide over {devices} devices of {per_device}")
    return global_batch // (devices * per_device)


#: The name under which the newest checkpoint is kept as well.
LATEST = "latest"


def checkpoint_names(step: int, tag: str | None = None) -> tuple[str, str]:
    """The names a checkpoint is saved under: its own and that of the newest."""
    return checkpoint_name(step, tag), LATEST


def checkpoint_name(step: int, tag: str | None = None) -> str:
    return f"step-{step:08d}" + (f"-{tag}" if tag else "")
