"""Rows of an embedding table: their statistics by dimension, and new rows drawn from them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.ids import hash_fraction

#: The least spread that new rows are given.
LEAST_STD = 1e-6


def column_stats(rows: DataFrame, vector: str) -> DataFrame:
    """dim, mean, std (of a sample; null for a single row) over all rows; null vectors are left out. One row for each
    dimension, combined before the shuffle."""
    each = rows.select(F.posexplode(vector).alias("dim", "x"))
    return each.groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_samp(F.col("x").cast("double")).alias("std"))


def new_rows(spark: SparkSession, stats: DataFrame, first: int, n: int, scale: float = 1.0, seed: int = 0) -> DataFrame:
    """row, dim, value for n new rows from number `first`: mean plus noise in proportion to the spread.

    The noise is normal, made of two hashes of seed, row and dimension, so that every engine and every run draws the
    same. `stats` is column_stats, as long as a vector.
    """
    rows = spark.range(first, first + n).withColumnRenamed("id", "row").crossJoin(F.broadcast(stats))
    u = lambda k: hash_fraction(F.concat_ws("-", F.lit(str(seed)), F.lit(k), F.col("row").cast("string"), F.col("dim").cast("string")))
    noise = F.sqrt(-2 * F.log(F.greatest(u("a"), F.lit(1e-12)))) * F.cos(F.lit(2 * math.pi) * u("b"))
    spread = F.greatest(F.coalesce("std", F.lit(0.0)), F.lit(LEAST_STD))
    return rows.select("row", "dim", (F.col("mean") + noise * spread * scale).alias("value"))
