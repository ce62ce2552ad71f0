"""Readers of the raw corpora, each with its schema stated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.functions.ids import with_ordinal
from voxloom.functions.text import first_filled
from voxloom.runtime import checkpointed, spread
from voxloom.sources.nested import JsonItems

SEGMENTED = "audios array<struct<aid:string,source:string,subsets:array<string>,segments:array<struct<sid:string,begin_time:double,end_time:double,subsets:array<string>,text_tn:string>>>>"
QUESTIONS = "data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,answers:array<struct<text:string>>>>>>>>"
MESSAGES = "messages array<struct<role:string,content:string>>"
TRANSLATION_HEADER = ("path", "sentence", "translation", "client_id")


def translation_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Translation pairs: tab-separated without quoting, rows of another width dropped.

    Every file must open with the header; only that line is left out, a row that repeats it is data. `ordinal` numbers
    the kept rows in file order.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    first = checkpointed(lines.groupBy("file").agg(F.min_by("value", "line").alias("header"), F.min("line").alias("line")))  # a row for each file
    bad = first.filter(F.col("header") != "\t".join(TRANSLATION_HEADER)).first()
    if bad is not None or first.isEmpty():
        raise ValueError(f"{path if bad is None else bad['file']}: the header must be {TRANSLATION_HEADER}")
    fields = F.split("value", "\t", -1)
    rows = lines.join(first.select("file", "line"), ["file", "line"], "left_anti").filter(F.size(fields) == len(TRANSLATION_HEADER))
    return with_ordinal(rows, "file", "line").select("ordinal", *(fields[i].alias(n) for i, n in enumerate(TRANSLATION_HEADER)))


def clips_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Read clips: tab-separated with quotes, line breaks inside quotes; text is the first filled of its columns."""
    raw = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True)
    have = lambda *names: [F.col(n) for n in names if n in raw.columns]
    return raw.select(*(F.col(c) for c in raw.columns), first_filled(*have("sentence", "text", "transcript")).alias("text_used"))


def nested_items(spark: SparkSession, path: str, schema: str, ending: str = ".json") -> DataFrame:
    """The items of the list of a nested document, one in a row under the name of the list, with file and place.

    `schema` is `name array<struct<...>>`. A document is cut into its items as a stream (bounded memory, one task for
    each document) and the items are spread before they are parsed, so that neither parsing nor what follows is one
    task's work. Documents read again and again should be kept as Parquet: this is the conversion.
    """
    name, kind = schema.split(" ", 1)
    spark.dataSource.register(JsonItems)
    rows = spark.read.format("jsonitems").option("path", path).option("items", name).option("ending", ending).load()
    return spread(rows).select("file", "place", F.array(F.from_json("item", kind.removeprefix("array<")[:-1])).alias(name))


def segmented_json(spark: SparkSession, path: str, ending: str = ".json") -> DataFrame:
    """Long recordings with their segments, one recording in a row, with its place in its document."""
    return nested_items(spark, path, SEGMENTED, ending)


def questions_json(spark: SparkSession, path: str, ending: str = ".json") -> DataFrame:
    """Questions on passages, nested by article and paragraph, one article in a row, with its place in its document."""
    return nested_items(spark, path, QUESTIONS, ending)


def chats_parquet(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """Chats with the file they come from and their place over all files in name order.

    Rows know their place in their file, so only the files are counted and summed up; chats are neither sorted nor moved.
    """
    rows = spark.read.schema(MESSAGES).option("pathGlobFilter", pattern).parquet(path)
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    files = rows.select(file.alias("path"), row.alias("row")).groupBy("path").agg((F.max("row") + 1).alias("n"))
    # a row for each file: one partition of them is no gathering of the chats
    first = files.select("path", (F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("path")) - F.col("n")).alias("first"))
    every = rows.select("messages", F.col("_metadata.file_name").alias("source_file"), file.alias("path"), row.alias("row"))
    return every.join(first, "path").select("messages", "source_file", (F.col("first") + F.col("row")).alias("ordinal"))


def physical_rows(spark: SparkSession, path: str) -> int:
    """Lines without the header, 0 at least; more than records where fields hold line breaks."""
    return max(0, spark.read.text(path).count() - 1)


def tokenizer_config(spark: SparkSession, root: str) -> DataFrame:
    """The one-row configuration of a data set."""
    return spark.read.json(f"{root}/tokenizer_config.json", multiLine=True)
