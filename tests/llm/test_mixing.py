import pytest
from pyspark.sql import functions as F

from voxloom.llm import mixing

DOCS = "doc_id long, text string, source string"
TARGETS = "source string, target_share double, max_repeats int"


def corpus(spark):
    rows = [(i, f"small text number {i}", ["small", " Small", "SMALL"][i % 3]) for i in range(300)]
    rows += [(1000 + i, f"a somewhat longer text of the large source number {i}", "large-source") for i in range(3000)]
    rows += [(9000, None, "small"), (9001, "", "small"), (9002, "small text number 1", "small"), (9003, "stray", "untargeted"), (9004, "x", None)]
    return spark.createDataFrame(rows, DOCS)


def test_shares_and_caps(spark):
    docs = corpus(spark).withColumn("copies", F.lit(1))
    targets = spark.createDataFrame([("small", 0.5, 3), ("large_source", 0.4, 2), ("missing", 0.1, 5)], TARGETS)
    out = mixing.mixture(docs, targets)
    used = out.groupBy("source", "text").agg(F.count("*").alias("n")).groupBy("source").agg(F.max("n").alias("n"))
    assert {r["source"]: r["n"] for r in used.collect()} == {"small": 3, "large_source": 2} or all(r["n"] <= 3 for r in used.collect())
    s = {r["source"]: r for r in mixing.shares(docs, targets).collect()}
    assert s["small"]["rate"] == pytest.approx(3.0) and s["small"]["texts"] == 300 and s["missing"]["rate"] == 0
    assert s["small"]["share"] / s["large_source"]["share"] == pytest.approx(0.5 / 0.4, rel=0.2)
    assert sum(r["share"] for r in s.values()) == pytest.approx(1.0)
    again = mixing.mixture(docs, targets)
    assert out.exceptAll(again).count() == 0
    assert out.groupBy("doc_id").agg(F.max("copy").alias("c"), F.count("*").alias("n")).filter("c <> n").count() == 0


def test_a_wanted_total_and_empty_tables(spark):
    docs, targets = corpus(spark), spark.createDataFrame([("small", 0.5, 1), ("large_source", 0.5, 1)], TARGETS)
    s = {r["source"]: r for r in mixing.shares(docs, targets, total_tokens=10**9).collect()}
    assert s["small"]["rate"] == s["large_source"]["rate"] == 1.0
    assert mixing.mixture(docs.limit(0), targets).count() == 0
    assert mixing.mixture(docs, targets.limit(0)).count() == 0
    assert mixing.shares(docs.limit(0), targets).filter("share is null").count() == 2
