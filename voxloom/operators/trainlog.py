"""Training logs by step: rolling means, elapsed and remaining time, changes of stage, every n-th row.

A log is one short row per optimiser step, a series by nature: its windows run over a run id, so that many runs
spread over the cluster, and a single run is one ordered pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.schedule import stage


def timed(log: DataFrame, total_steps: int, run: str, step: str = "step", seconds: str = "step_sec", window: int = 50) -> DataFrame:
    """`log` with the rolling mean of the last steps, time elapsed and time left at that mean."""
    w = Window.partitionBy(run).orderBy(step)
    out = log.withColumns({"rolling_sec": F.avg(seconds).over(w.rowsBetween(1 - window, 0)), "elapsed_sec": F.sum(seconds).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return out.withColumn("eta_sec", F.greatest(F.lit(total_steps) - F.col(step) - 1, F.lit(0)) * F.col("rolling_sec"))


def stage_changes(log: DataFrame, every: int, run: str, step: str = "step") -> DataFrame:
    """The steps at which the curriculum moves on, with the stage before and after."""
    w = Window.partitionBy(run).orderBy(step)
    out = log.select(run, step, stage(F.col(step), every).alias("stage")).withColumn("before", F.lag("stage").over(w))
    return out.filter(F.col("before") != F.col("stage"))


def every_nth(log: DataFrame, n: int, step: str = "step") -> DataFrame:
    """The rows whose step is a multiple of n."""
    if n < 1:
        raise ValueError("n must be positive")
    return log.filter(F.col(step) % n == 0)
