"""Where results go: numbered shards, routed folders, settings, predictions and summaries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.ids import shard, shard_name, with_ordinal
from voxloom.sources.files import write_bytes


def sharded(df: DataFrame, *order: str, maxcount: int = 10_000, prefix: str = "shard") -> DataFrame:
    """`df` with the number and name of its shard: contiguous runs of `maxcount` rows in a total order."""
    return with_ordinal(df, *order).withColumn("shard", shard(F.col("ordinal"), maxcount)).withColumn("shard_name", shard_name(prefix, F.col("shard")))


def write_shards(df: DataFrame, path: str, maxcount: int = 10_000) -> None:
    """Parquet files of at most `maxcount` rows each."""
    df.write.mode("overwrite").option("maxRecordsPerFile", maxcount).parquet(path)


def write_routed(df: DataFrame, path: str, *by: str, maxcount: int = 10_000) -> None:
    """A folder for each task (and worker), only for those that occur."""
    df.write.mode("overwrite").option("maxRecordsPerFile", maxcount).partitionBy(*by).parquet(path)


def write_config(config: dict, root: str) -> str:
    """tokenizer_config.json of a data set."""
    path = f"{root.rstrip('/')}/tokenizer_config.json"
    write_bytes(path, json.dumps(config, ensure_ascii=False, indent=2).encode())
    return path


def write_document(items: DataFrame, name: str, path: str) -> None:
    """One JSON document with a list under `name`: the texts in `item` in the order of `ordinal` (from 0), a file in a
    folder. A document is one file and so one task's work; the items come to it in order and are not held."""
    ends = items.sparkSession.createDataFrame([(-1, f'{{"{name}": ['), (2**62, "]}")], "ordinal long, value string")
    lines = items.select("ordinal", F.concat(F.when(F.col("ordinal") > 0, ",").otherwise(""), "item").alias("value")).unionByName(ends)
    lines.repartition(1).sortWithinPartitions("ordinal").select("value").write.mode("overwrite").text(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """One JSON record a line; nulls are written."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def summary_json(summary: DataFrame) -> dict[str, dict]:
    """Data set to its summary, without the keys it lacks; a summary has a row for each data set."""
    return {r["dataset"]: {k: v for k, v in r.asDict(recursive=True).items() if v is not None} for r in summary.collect()}


def write_summary(summary: DataFrame, root: str) -> None:
    """summary.json for each data set in its folder, and for all of them together in `root`."""
    all_ = summary_json(summary)
    write_bytes(f"{root}/summary.json", json.dumps(all_, ensure_ascii=False, indent=2).encode())
    for name, one in all_.items():
        write_bytes(f"{root}/{name}/summary.json", json.dumps(one, ensure_ascii=False, indent=2).encode())


def append_metrics(df: DataFrame, path: str) -> None:
    """Scalars by step, added to a log table."""
    df.write.mode("append").parquet(path)
