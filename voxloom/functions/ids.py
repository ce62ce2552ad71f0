"""Ids, ordinals, worker shares and task choice by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.runtime import checkpointed


def sample_id(prefix: str, split: Column, ordinal: Column, suffix: str = "") -> Column:
    """prefix-split-000000042 and the like."""
    return F.concat(F.format_string(f"{prefix}-%s-%09d", split, ordinal), F.lit(suffix))


def hash_fraction(key: Column) -> Column:
    """A number in [0, 1] from the first 32 bits of the key's MD5; the same in every engine."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / F.lit(4294967295.0)


def task_by_hash(key: Column, asr_ratio: float = 0.5) -> Column:
    """asr for the given share of keys, tts for the rest."""
    if not 0 <= asr_ratio <= 1:
        raise ValueError("asr_ratio must lie in [0, 1]")
    return F.when(hash_fraction(key) < F.lit(float(asr_ratio)), "asr").otherwise("tts")


def tasks(key: Column, mode: str, asr_ratio: float = 0.5) -> Column:
    """The tasks of a key as an array: one for asr, tts and mixed, two for both."""
    if mode in ("asr", "tts"):
        return F.array(F.lit(mode))
    if mode == "both":
        return F.array(F.lit("asr"), F.lit("tts"))
    if mode == "mixed":
        return F.array(task_by_hash(key, asr_ratio))
    raise ValueError(f"unknown task mode {mode}")


def with_ordinal(df: DataFrame, *order: Column | str, name: str = "ordinal") -> DataFrame:
    """A row number from 0 in a total order, counted in parallel.

    Rows are range-partitioned and sorted by `order`, partition sizes are counted and their running sums added,
    so no single task sees all rows (an unpartitioned window would). `order` must be unique for a fixed result.
    The sorted rows are checkpointed: range borders are sampled, and sizes and rows must have the same ones.
    """
    out = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__ordinal_p", F.spark_partition_id())
    out = checkpointed(out.withColumn("__ordinal_r", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = out.groupBy("__ordinal_p").agg(F.count("*").alias("__ordinal_n"))
    # one row for each partition of the shuffle
    starts = sizes.select("__ordinal_p", (F.sum("__ordinal_n").over(Window.partitionBy(F.lit(1)).orderBy("__ordinal_p")) - F.col("__ordinal_n")).alias("__ordinal_s"))
    return out.join(F.broadcast(starts), "__ordinal_p").withColumn(name, F.col("__ordinal_s") + F.col("__ordinal_r")).drop("__ordinal_p", "__ordinal_r", "__ordinal_s", "__ordinal_n")


def worker_share(ordinal: Column, start: int = 0, end: int | None = None, workers: int = 1, worker: int = 0) -> Column:
    """Whether a row lies in [start, end) and falls to a worker by its absolute ordinal."""
    if not 0 <= worker < workers:
        raise ValueError("0 <= worker < workers must hold")
    if start < 0 or (end is not None and end <= start):
        raise ValueError("0 <= start < end must hold")
    keep = (ordinal >= start) & (ordinal % workers == worker)
    return keep if end is None else keep & (ordinal < end)


def shard_share(ordinal: Column, nodes: int = 1, node: int = 0, workers: int = 1, worker: int = 0) -> Column:
    """Whether a shard falls to a worker of a node: shards go round the nodes first, those of a node round its workers."""
    if not (0 <= node < nodes and 0 <= worker < workers):
        raise ValueError("0 <= node < nodes and 0 <= worker < workers must hold")
    return (ordinal % nodes == node) & (F.floor(ordinal / nodes) % workers == worker)


def shard(ordinal: Column, maxcount: int) -> Column:
    """The number of the contiguous shard of an ordinal counted from 0."""
    if maxcount < 1:
        raise ValueError("maxcount must be positive")
    return F.floor(ordinal / maxcount).cast("bigint")


def shard_name(prefix: str, number: Column) -> Column:
    return F.format_string(f"{prefix}-%06d", number)
