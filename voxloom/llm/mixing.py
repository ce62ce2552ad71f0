"""Sources mixed to target shares of all tokens, with capped repetition.

Tokens are summed per source, repetition rates follow from the targets, and every text goes out floor(rate) times
plus one copy more with the probability of the fraction, drawn from a seeded hash of its id. Where no total is
asked for, the mixture is the largest whose shares are exact: the first source to reach its cap sets it.

The unit is a text of a source: the same text under several ids counts once (under its least id), so that no text
is used more often than its source's cap however often it was delivered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.bpe import count_tokens
from voxloom.runtime import checkpointed


def source_key(source: Column) -> Column:
    """The plain name of a source: trimmed, lower case, hyphens and inner blanks as underscores."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[-\s]+", "_")


def measured_texts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """source, doc_id, n_tokens: every text of a source once. Null and empty texts, having no tokens, are left out."""
    rows = docs.filter(F.length("text") > 0).select("doc_id", source_key(F.col("source")).alias("source"), F.unhex(F.md5("text")).alias("digest"), "text")
    counted = count_tokens(rows, vocabulary=vocabulary)
    return counted.groupBy("source", "digest").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens")).drop("digest")


def rates(texts: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """source, target_share, max_repeats, texts, tokens, rate for every row of `targets`.

    A source without texts cannot be used: its rate is 0 and it does not bound the total. A share that is null
    or not positive gives rate 0. With `total_tokens` set, rates are cut at the caps and shares may fall short.
    """
    own = texts.groupBy("source").agg(F.count("*").alias("texts"), F.sum("n_tokens").alias("tokens"))
    t = targets.select(source_key(F.col("source")).alias("source"), "target_share", F.col("max_repeats").cast("double").alias("max_repeats"))
    t = t.join(own, "source", "left").fillna(0, ["texts", "tokens"])
    usable = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    reach = F.when(usable, F.col("max_repeats") * F.col("tokens") / F.col("target_share"))
    # `targets` is a short list of sources: one partition of it is no gathering of the corpus
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.min(reach).over(Window.partitionBy(F.lit(1)))
    rate = F.when(usable, F.least(total * F.col("target_share") / F.col("tokens"), F.col("max_repeats"))).otherwise(F.lit(0.0))
    return t.select("source", "target_share", "max_repeats", "texts", "tokens", rate.alias("rate"))


def copies(texts: DataFrame, rate: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, source, n_tokens, copies for every text that is used at all; sources without a target are not."""
    whole = F.floor("rate")
    uniform = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    used = whole + F.when(uniform < F.col("rate") - whole, 1).otherwise(0)
    # `rate` has one row for each target, a list fixed in size
    joined = texts.join(F.broadcast(rate.select("source", "rate")), "source")
    return joined.select("doc_id", "source", "n_tokens", used.cast("int").alias("copies")).filter("copies > 0")


def mixture(docs: DataFrame, targets: DataFrame, seed: int = 17, total_tokens: int | None = None, vocabulary: str | None = None) -> DataFrame:
    """doc_id, source, copy (from 1), n_tokens, text: the mixture itself. Empty tables give an empty mixture. A doc_id names one
    row: rows delivered again must be dropped before."""
    texts = checkpointed(measured_texts(docs, vocabulary))
    chosen = copies(texts, rates(texts, targets, total_tokens), seed)
    joined = chosen.join(docs.select("doc_id", "text"), "doc_id")
    return joined.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "n_tokens", "text")


def shares(docs: DataFrame, targets: DataFrame, seed: int = 17, total_tokens: int | None = None, vocabulary: str | None = None) -> DataFrame:
    """The shares reached: source, target_share, max_repeats, texts, tokens, rate, mixed_rows, mixed_tokens, share."""
    texts = checkpointed(measured_texts(docs, vocabulary))
    rate = rates(texts, targets, total_tokens)
    got = copies(texts, rate, seed).groupBy("source")
    got = got.agg(F.sum("copies").alias("mixed_rows"), F.sum(F.col("copies").cast("long") * F.col("n_tokens")).alias("mixed_tokens"))
    all_ = rate.join(got, "source", "left").fillna(0, ["mixed_rows", "mixed_tokens"])
    return all_.withColumn("share", F.col("mixed_tokens") / F.nullif(F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1))), F.lit(0)))
