"""Packed sequences to batches: trimming, padding, prompt and target parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.ids import with_ordinal
from voxloom.functions.schedule import round_up
from voxloom.operators.pack import IGNORE


def loadable(df: DataFrame, max_length: int = 32000) -> DataFrame:
    """Sequences of two ids or more, cut to the first `max_length` (their end goes, unlike in packing)."""
    cut = {c: F.slice(c, 1, max_length) for c in ("input_ids", "labels", "attention_mask")}
    return df.filter(F.size("input_ids") >= 2).withColumns(cut)


def batches(df: DataFrame, *order: str, rows: int, multiple: int | None = 8) -> DataFrame:
    """`order`, batch, padded_length, batch_rows: runs of `rows` sequences in a total order, by their keys and lengths only.

    Sequences are neither sorted nor written; they meet this table once, by a join on `order`, whose columns must be
    unique together and not null.
    """
    keys = with_ordinal(df.select(*order, F.size("input_ids").alias("__size")), *order).withColumn("batch", F.floor(F.col("ordinal") / rows))
    return keys.drop("ordinal").join(longest(keys, "batch", F.col("__size"), multiple), "batch").drop("__size")


def longest(df: DataFrame, batch: str, size: Column, multiple: int | None = 8) -> DataFrame:
    """batch, padded_length, batch_rows: the longest of each batch, rounded up, and its rows."""
    return df.groupBy(batch).agg(round_up(F.max(size), multiple).alias("padded_length"), F.count("*").alias("batch_rows"))


def padded(df: DataFrame, batch: str, pad_id: int, multiple: int | None = 8) -> DataFrame:
    """Batches by number: every sequence of one filled up at the right to the longest, rounded up.

    The longest of each batch is an aggregate of lengths only, joined back; sequences are not gathered. Rows that
    bring padded_length and batch_rows (see batches) are filled where they are.
    """
    rows = df if "padded_length" in df.columns else df.join(longest(df, batch, F.size("input_ids"), multiple), batch)

    def fill(c: str, v: int, kind: str = "int") -> Column:
        have = F.coalesce(F.col(c), F.transform("input_ids", lambda _: F.lit(1).cast(kind))) if c == "attention_mask" else F.col(c)
        return F.concat(have, F.array_repeat(F.lit(v).cast(kind), F.col("padded_length") - F.size(have)))

    rows = rows.withColumns({"labels": fill("labels", IGNORE), "attention_mask": fill("attention_mask", 0, "tinyint"), "input_ids": fill("input_ids", pad_id)})
    return rows.withColumn("padded_tokens", F.col("batch_rows") * F.col("padded_length"))


def _real(list_: Column, mask: Column) -> Column:
    """The part of a list within the real length, which is the sum of the mask; all of it where the mask is null."""
    n = F.aggregate(mask, F.lit(0), lambda a, x: a + x.cast("int"))
    return F.when(mask.isNull(), list_).otherwise(F.slice(list_, 1, n))


def prompt_part(ids: Column, labels: Column, mask: Column) -> Column:
    """The ids without a label within the real length."""
    return F.filter(_real(ids, mask), lambda _, i: F.get(labels, i) == IGNORE)


def target_part(labels: Column, mask: Column) -> Column:
    """The labels within the real length."""
    return F.filter(_real(labels, mask), lambda x: x != IGNORE)


def up_to_end(ids: Column, eos: int) -> Column:
    """Ids through the first end token; all without one."""
    at = F.array_position(ids, eos).cast("int")
    return F.when(at > 0, F.slice(ids, 1, at)).otherwise(ids)


def generation_budget(target: Column, buffer: int, fixed: int | None = None) -> Column:
    """How many ids may be generated: eight at least, or the fixed number."""
    return F.lit(fixed) if fixed is not None else F.greatest(F.lit(8), F.size(target) + buffer)


def first_per(df: DataFrame, dataset: str, order: str, n: int) -> DataFrame:
    """The first n rows of each data set in order. Each task keeps its own first n before rows meet."""
    from pyspark.sql import Window

    w = Window.partitionBy(dataset).orderBy(order)
    # Spark turns a rank filter over a window into a group limit on both sides of the shuffle
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def first_overall(df: DataFrame, order: str, n: int | None) -> DataFrame:
    """The first n rows over all data sets, in order; all without a limit. Each task keeps its own first n only."""
    return df if n is None else df.orderBy(order).limit(n)


def generation_inputs(df: DataFrame, order: str, buffer: int, limit: int | None = None, fixed: int | None = None) -> DataFrame:
    """Rows to generate for, with prompt, target and budget. Rows without a prompt are skipped before any are counted
    towards the limit."""
    i, y, m = F.col("input_ids"), F.col("labels"), F.col("attention_mask")
    rows = df.withColumns({"prompt": prompt_part(i, y, m), "target": target_part(y, m)}).filter(F.size("prompt") > 0)
    return first_overall(rows, order, limit).withColumn("budget", generation_budget(F.col("target"), buffer, fixed))
