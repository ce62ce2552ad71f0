"""Training mixtures: weighted draws, shuffles by hash, resampled shards, repeated epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import schedule
from voxloom.functions.ids import hash_fraction, with_ordinal


def draws(spark: SparkSession, n: int, weights: dict[str, float], seed: int = 0, start: int = 0) -> DataFrame:
    """draw, dataset: for each of n draws the data set it falls to, by a seeded hash and the cumulative weights.

    The weights are a short list, so the choice is one expression and no join.
    """
    return spark.range(start, start + n).select(F.col("id").alias("draw"), _pick(_uniform(seed), weights).alias("dataset"))


def _uniform(seed: int) -> Column:
    return hash_fraction(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string")))


def _pick(u: Column, weights: dict[str, float]) -> Column:
    """The name whose stretch of the cumulative weights a number in [0, 1] falls into."""
    total = float(sum(weights.values()))
    if total <= 0 or any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative and must sum to more than zero")
    pick, run = None, 0.0
    names = list(weights)
    for name in names[:-1]:
        run += weights[name] / total
        pick = F.when(u < run, name) if pick is None else pick.when(u < run, name)
    last = F.lit(names[-1])
    return last if pick is None else pick.otherwise(last)


def curriculum_draws(spark: SparkSession, n: int, specs: dict[str, tuple[float, float]], batch: int, every: int, seed: int = 0, start: int = 0) -> DataFrame:
    """draw, step, stage, dataset: as draws, with the weights of the stage that a draw's step lies in.

    A step takes `batch` draws; each `every` steps the stage and with it the weights (start, end of each name) move on.
    The weights of the four stages are one expression, so there is no join and nothing is rebuilt.
    """
    step = F.floor(F.col("id") / batch)
    at = schedule.stage(step, every)
    pick = None
    for k in range(schedule.STAGES + 1):
        one = _pick(_uniform(seed), {name: a + k / schedule.STAGES * (b - a) for name, (a, b) in specs.items()})
        pick = F.when(at == k, one) if pick is None else pick.when(at == k, one)
    return spark.range(start, start + n).select(F.col("id").alias("draw"), step.alias("step"), at.alias("stage"), pick.alias("dataset"))


def mixed(draw: DataFrame, rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """draw, dataset, epoch, key: each draw gets the next row of its data set in that epoch's shuffled order.

    Rows run out and start again, so small data sets repeat. Draws and rows are numbered within their data set and
    met on (data set, place): salted by place, one data set never falls to a single task of the join. A draw of a data
    set without rows raises an error.
    """
    own = _places(rows.select("dataset", key, F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string"))).alias("__h")), "__h", key)
    nth = _places(draw.select("dataset", "draw"), "draw")
    sizes = own.groupBy("dataset").agg(F.count("*").alias("size"))
    lacking = nth.select("dataset").distinct().join(sizes, "dataset", "left_anti").first()
    if lacking is not None:
        raise ValueError(f"no rows to draw of {lacking['dataset']}")
    nth = nth.join(F.broadcast(sizes), "dataset").select("dataset", "draw", (F.col("place") % F.col("size")).alias("place"), F.floor(F.col("place") / F.col("size")).alias("epoch"))
    return nth.join(own.select("dataset", "place", key), ["dataset", "place"]).select("draw", "dataset", "epoch", key)


def _places(df: DataFrame, *order: str) -> DataFrame:
    """`df` with the place of each row in its data set: the ordinal over all less the first of the data set, so that
    a data set of any size is numbered by many tasks."""
    out = with_ordinal(df, "dataset", *order)
    # data sets are a short list of a configuration
    first = out.groupBy("dataset").agg(F.min("ordinal").alias("__f"))
    return out.join(F.broadcast(first), "dataset").withColumn("place", F.col("ordinal") - F.col("__f")).drop("ordinal", "__f")


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """All rows with their place (from 0) in an order set by a seeded hash of the key, the same in every engine.

    Only keys are ordered and numbered; rows meet their place by the key, which must be unique and not null.
    """
    order = F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))
    places = with_ordinal(df.select(key, order.alias("__h")), "__h", key, name="place").drop("__h")
    return df.join(places, key)


def resampled_shards(spark: SparkSession, shards: int, n: int, seed: int = 0) -> DataFrame:
    """draw, shard: shards drawn with replacement."""
    u = hash_fraction(F.concat(F.lit(f"{seed}-shard-"), F.col("id").cast("string")))
    return spark.range(n).select(F.col("id").alias("draw"), F.least(F.floor(u * shards), F.lit(shards - 1)).cast("int").alias("shard"))


def drawn_samples(draw: DataFrame, samples: DataFrame, number: str = "number") -> DataFrame:
    """The samples of drawn shards (draw, shard): each sample once for each time its shard is drawn.

    Shards are drawn far less often than they hold samples, so the draws of a shard are no hot key; which of them a node
    and worker read is chosen before (see ids.shard_share)."""
    return draw.join(samples.withColumnRenamed(number, "shard"), "shard")


def tagged_union(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """Data sets one after another, each row with its name and the place of its set."""
    out = None
    for n, (name, df) in enumerate(parts.items()):
        one = df.withColumns({tag: F.lit(name), f"{tag}_place": F.lit(n)})
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("a union needs at least one data set")
    return out
