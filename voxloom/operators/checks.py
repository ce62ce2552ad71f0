"""Checks that stop a run: equal tokenizer settings, unique keys, one data set in a batch, a bounds-checked sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONFIG_KEYS = ("base_model", "text_vocab_size", "speech_offset", "speech_vocab_size_total", "full_vocab_size", "num_codebooks", "speech_codebook_size", "extra_special_ids")


def config_differences(configs: list[dict]) -> list[tuple[int, str]]:
    """(index, key) wherever a configuration differs from the first; an empty list of configurations is an error."""
    if not configs:
        raise ValueError("no configuration to compare")
    return [(n, k) for n, c in enumerate(configs[1:], 1) for k in CONFIG_KEYS if c.get(k) != configs[0].get(k)]


def assert_equal_configs(configs: list[dict]) -> None:
    for n, k in config_differences(configs):
        raise ValueError(f"configuration {n} differs from the first in {k}")


def differing_keys(configs: DataFrame, index: str, keys: list[str]) -> DataFrame:
    """index, key for every key in which a row of a small configuration table differs from the row of index 0."""
    kinds = {f.name: f.dataType.typeName() for f in configs.schema}
    # maps cannot be compared; their sorted entries can
    plain = lambda c, k: F.array_sort(F.map_entries(c)) if kinds[k] == "map" else F.col(c)
    first = configs.filter(F.col(index) == 0).select(*(F.col(k).alias(f"__{k}") for k in keys))
    both = configs.filter(F.col(index) > 0).crossJoin(F.broadcast(first))  # one row
    pairs = F.array(*(F.when(~plain(k, k).eqNullSafe(plain(f"__{k}", k)), F.lit(k)) for k in keys))
    return both.select(index, F.explode(F.array_compact(pairs)).alias("key"))


def repeated(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def assert_unique(df: DataFrame, key: str) -> None:
    bad = repeated(df, key).first()
    if bad is not None:
        raise ValueError(f"{key} {bad[key]!r} occurs {bad['n']} times")


def distinct_in_order(df: DataFrame, value: str, order: str) -> DataFrame:
    """value, first: each value once, with the least `order` it stands at; sorted by it. Values are combined before the
    shuffle, so repeated ones cost nothing."""
    return df.groupBy(value).agg(F.min(order).alias("first")).orderBy("first")


def unknown_names(df: DataFrame, names: list[str], dataset: str = "dataset") -> DataFrame:
    """Names of data sets that the configuration lacks, with their rows; null is one."""
    return df.filter(~F.coalesce(F.col(dataset).isin(*names), F.lit(False))).groupBy(dataset).agg(F.count("*").alias("rows"))


def assert_known(df: DataFrame, names: list[str], dataset: str = "dataset") -> None:
    bad = unknown_names(df, names, dataset).first()
    if bad is not None:
        raise ValueError(f"{bad['rows']} rows of an unknown data set {bad[dataset]!r}")


def mixed_batches(df: DataFrame, batch: str, dataset: str = "dataset") -> DataFrame:
    """Batches that hold more than one data set."""
    return df.groupBy(batch).agg(F.count_distinct(dataset).alias("datasets")).filter("datasets > 1")


def nth_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n-th sample (from 0) in the order of the keys; an error outside the table."""
    size = df.count()
    if not 0 <= n < size:
        raise IndexError(f"sample {n} of {size}")
    return df.orderBy(key).offset(n).limit(1)


def missing_keys(found: set[str], required: set[str]) -> list[str]:
    """Required keys that an exported model lacks."""
    return sorted(required - found)
