"""Queries that write the tables in the forms corpora come in and results go out in, and read them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.catalog import _FRACTION, _SEGMENTS, SPACE, _outer_meta, _print, _strip
from voxloom.functions import ids, speech, text
from voxloom.operators import build, evaluate, mixture, pack
from voxloom.runtime import scratch, table
from voxloom.sources import audio, configs, corpora, files, shards, sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _line(c: str) -> Column:
    return F.coalesce(F.regexp_replace(c, r"[\t\r\n]", " "), F.lit(""))


def _line_sql(c: str) -> str:
    return f"coalesce(regexp_replace({c}, '[\\t\\r\\n]', ' ', 'g'), '')"


_TSV = {"path": "audio_relpath", "sentence": "source_text", "translation": "target_text", "client_id": "client_id"}


@_query(f"SELECT row_number() OVER (ORDER BY id, written_at) - 1 AS ordinal, {', '.join(f'{_line_sql(c)} AS {n}' for n, c in _TSV.items())} FROM covost2_sample WHERE length(id) % 7 <> 3 AND NOT ends_with(id, '7')")
def read_translation_tsv(spark: SparkSession, root: str) -> DataFrame:
    """Three files with headers; rows whose id ends in 7 lack a field, others have one too many, and are dropped."""
    rows, path = table(spark, root, "covost2_sample"), scratch(spark, "tsv")
    whole = F.concat_ws("\t", *(_line(c) for c in _TSV.values()))
    value = F.when(F.col("id").endswith("7"), F.concat_ws("\t", *(_line(c) for c in list(_TSV.values())[:3]))).when(F.length("id") % 7 == 3, F.concat(whole, F.lit("\tmore"))).otherwise(whole)
    lines = rows.repartitionByRange(3, "id", "written_at").sortWithinPartitions("id", "written_at").select(value.alias("\t".join(corpora.TRANSLATION_HEADER)))
    lines.write.options(header=True, sep="\u0001", quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return corpora.translation_tsv(spark, path)


@_query(
    f"""SELECT sample_id || '.mp3' AS path, CASE WHEN length({_strip('s')}) > 0 THEN s WHEN length({_strip('target_text')}) > 0 THEN target_text ELSE '' END AS text_used FROM
        (SELECT *, CASE length(target_text) % 3 WHEN 0 THEN target_text || chr(10) || '"quoted"' WHEN 1 THEN '  ' ELSE target_text END AS s FROM raw_sample WHERE dataset = 'commonvoice' AND NOT contains(coalesce(target_text, ''), chr(13)))"""
)
def read_clips_tsv(spark: SparkSession, root: str) -> DataFrame:
    """Quoted fields with line breaks and quotes in them; blank sentences fall back to the next column."""
    rows = table(spark, root, "raw_sample").filter((F.col("dataset") == "commonvoice") & ~F.coalesce(F.col("target_text"), F.lit("")).contains("\r"))
    t, path = F.col("target_text"), scratch(spark, "clips")
    sentence = F.when(F.length(t) % 3 == 0, F.concat(t, F.lit('\n"quoted"'))).when(F.length(t) % 3 == 1, "  ").otherwise(t)
    out = rows.select(F.concat("sample_id", F.lit(".mp3")).alias("path"), sentence.alias("sentence"), t.alias("text"))
    out.write.options(header=True, sep="\t", quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return corpora.clips_tsv(spark, path).select("path", "text_used")


@_query("SELECT count(*) AS rows FROM documents")
def count_rows(spark: SparkSession, root: str) -> DataFrame:
    """Lines of one file without its header."""
    path = scratch(spark, "lines")
    table(spark, root, "documents").select(F.col("doc_id").cast("string").alias("value")).unionByName(spark.createDataFrame([("header",)], "value string")).coalesce(1).write.text(path)
    return spark.createDataFrame([(corpora.physical_rows(spark, path),)], "rows long")


@_query(
    f"""SELECT audio_idx::INT AS audio_idx, aid, sid, begin_time, end_time FROM (SELECT *, dense_rank() OVER (ORDER BY aid, source) - 1 AS audio_idx FROM
        (SELECT s.*, json_extract_string(meta, '$.source') AS source FROM {_SEGMENTS} s JOIN (SELECT DISTINCT sample_id AS sid, meta FROM raw_sample WHERE dataset = 'gigaspeech') r USING (sid))) WHERE list_contains(tags, 'L')"""
)
def read_segments_json(spark: SparkSession, root: str) -> DataFrame:
    """One document of recordings with their segments, read as a stream; places of recordings are those in it."""
    path = scratch(spark, "segments")
    rows = _outer_meta(spark, root).groupBy("aid", "source").agg(F.array_sort(F.collect_list("s")).alias("segments"))
    rows = ids.with_ordinal(rows, "aid", "source")
    sinks.write_document(rows.select("ordinal", F.to_json(F.struct("aid", "source", "segments")).alias("item")), "audios", path)
    out = build.unnest_segments(corpora.segmented_json(spark, path, ".txt"), "L")
    return out.select("audio_idx", "aid", "sid", "begin_time", "end_time")


_ASKED = "(SELECT topic_idx AS t, para_idx AS p, id, min(title) OVER (PARTITION BY topic_idx) AS title, min(context_text) OVER (PARTITION BY topic_idx, para_idx) AS context_text, question, answer_text FROM (SELECT DISTINCT * EXCLUDE (written_at) FROM spoken_squad_sample))"


@_query(
    f"""SELECT topic_idx::INT AS topic_idx, para_idx::INT AS para_idx, qa_idx::INT AS qa_idx, title, context_text, id AS qa_id, question, answer_text FROM
        (SELECT *, dense_rank() OVER (ORDER BY t) - 1 AS topic_idx, dense_rank() OVER (PARTITION BY t ORDER BY p) - 1 AS para_idx, row_number() OVER (PARTITION BY t, p ORDER BY id) - 1 AS qa_idx FROM {_ASKED})
        WHERE length({_strip('question')}) > 0 AND length({_strip('answer_text')}) > 0"""
)
def read_questions_json(spark: SparkSession, root: str) -> DataFrame:
    """One document of articles, paragraphs, questions and two answers each, of which the first counts."""
    path = scratch(spark, "questions")
    rows = table(spark, root, "spoken_squad_sample").dropDuplicates(["id"])
    qa = F.struct("id", "question", F.array(F.struct(F.col("answer_text").alias("text")), F.struct(F.lit("a second answer").alias("text"))).alias("answers"))
    para = rows.groupBy("topic_idx", "para_idx").agg(F.min("title").alias("title"), F.min("context_text").alias("context"), F.array_sort(F.collect_list(qa)).alias("qas"))
    topic = para.groupBy("topic_idx").agg(F.min("title").alias("title"), F.array_sort(F.collect_list(F.struct("para_idx", "context", "qas"))).alias("paragraphs"))
    topic = ids.with_ordinal(topic, "topic_idx")
    sinks.write_document(topic.select("ordinal", F.to_json(F.struct("title", "paragraphs"), {"ignoreNullFields": "false"}).alias("item")), "data", path)
    return build.unnest_questions(corpora.questions_json(spark, path, ".txt"))


@_query("SELECT row_number() OVER (ORDER BY id, written_at) - 1 AS ordinal, len(messages)::INT AS n, messages[1].content AS first FROM ultrachat_sample")
def read_chats_parquet(spark: SparkSession, root: str) -> DataFrame:
    """Three files; chats are numbered over all of them in the order of names and places."""
    path = scratch(spark, "chats")
    table(spark, root, "ultrachat_sample").repartitionByRange(3, "id", "written_at").sortWithinPartitions("id", "written_at").select("messages").write.parquet(path)
    rows = corpora.chats_parquet(spark, path)
    return rows.select("ordinal", F.when(F.col("messages").isNotNull(), F.size("messages")).alias("n"), F.get("messages", F.lit(0))["content"].alias("first"))


def _shard_rows(spark: SparkSession, root: str) -> DataFrame:
    """Packed samples, each once, as shards carry them."""
    rows = table(spark, root, "packed_sample").dropDuplicates(["sample_id"])
    mask = F.coalesce("attention_mask", F.transform("input_ids", lambda _: F.lit(1).cast("tinyint")))
    arrays = F.create_map(F.lit("input_ids"), shards.vector(F.col("input_ids")), F.lit("labels"), shards.vector(F.col("labels")), F.lit("attention_mask"), shards.vector(mask, "int8"))
    return rows.select(F.col("sample_id").alias("key"), F.to_json(F.struct("dataset", "split", "task")).alias("json"), arrays.alias("arrays"))


_ONCE = "(SELECT DISTINCT ON (sample_id) * FROM packed_sample)"


@_query(
    f"""SELECT sample_id AS key, dataset, 'int32,int32,int8' AS types, len(input_ids)::INT AS n, md5(array_to_string(input_ids, ',')) AS ids, md5(array_to_string(labels, ',')) AS labels,
        coalesce(list_sum(attention_mask), len(input_ids))::BIGINT AS real FROM {_ONCE}"""
)
def shards_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    path = scratch(spark, "shards")
    shards.write(_shard_rows(spark, root), path, maxcount=100)
    a = F.col("arrays")
    types = F.concat_ws(",", *(a[k]["type"] for k in ("input_ids", "labels", "attention_mask")))
    real = F.aggregate(a["attention_mask"]["values"], F.lit(0).cast("long"), lambda s, x: s + x)
    return shards.read(spark, path).select(
        "key", F.get_json_object("json", "$.dataset").alias("dataset"), types.alias("types"), F.get(a["input_ids"]["shape"], F.lit(0)).alias("n"), _print(a["input_ids"]["values"]).alias("ids"),
        _print(a["labels"]["values"]).alias("labels"), real.alias("real"),
    )


def _numbered_shards(spark: SparkSession, root: str, path: str, per: int) -> int:
    rows = ids.with_ordinal(_shard_rows(spark, root).select("key", "json", F.col("arrays")), "key")
    n = -(-rows.count() // per)
    shards.write_numbered(rows.withColumn("number", F.floor(F.col("ordinal") / per)), path, max(1, n))
    return n


_PLACED = "(SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS i FROM (SELECT DISTINCT sample_id FROM packed_sample))"


@_query(f"SELECT i AS place, sample_id AS key, (i // 50)::INT AS number FROM {_PLACED}")
def shards_in_order(spark: SparkSession, root: str) -> DataFrame:
    """Shards read in the order of their names, as an evaluation does."""
    path = scratch(spark, "ordered")
    _numbered_shards(spark, root, path, 50)
    return shards.in_order(shards.numbered(shards.read(spark, path)).select("key", "shard", "ordinal", "number")).select("place", "key", "number")


@_query(
    f"""SELECT draw, shard, sample_id AS key FROM (SELECT range AS draw, least(floor({_FRACTION.format("'5-shard-' || range::VARCHAR")} * n), n - 1)::INT AS shard FROM range(60), (SELECT (max(i) // 50 + 1) AS n FROM {_PLACED}))
        JOIN {_PLACED} ON i // 50 = shard WHERE draw % 2 = 1 AND draw // 2 % 3 = 0"""
)
def shards_drawn(spark: SparkSession, root: str) -> DataFrame:
    """The samples one worker of one node sees: shards drawn with replacement and dealt round nodes and workers."""
    path = scratch(spark, "drawn")
    n = _numbered_shards(spark, root, path, 50)
    draw = mixture.resampled_shards(spark, n, 60, seed=5).filter(ids.shard_share(F.col("draw"), nodes=2, node=1, workers=3, worker=0))
    samples = shards.numbered(shards.read(spark, path)).select("key", "number")
    return mixture.drawn_samples(draw, samples).select("draw", "shard", "key")


@_query(f"SELECT sample_id AS key, len(input_ids)::INT AS n, dataset FROM (SELECT p.*, row_number() OVER (ORDER BY sample_id) AS r FROM {_ONCE} p) WHERE r = 4")
def shards_inspect(spark: SparkSession, root: str) -> DataFrame:
    """The fourth sample of the first shard, written out as files to look at and read from them."""
    path = scratch(spark, "inspected")
    _numbered_shards(spark, root, path, 50)
    one = shards.inspected(shards.resolve(path)[0], 3)
    shards.write_inspection(one, f"{path}/look", {"input_ids": " ".join(map(str, one["arrays"]["input_ids"]))})
    meta = spark.read.json(f"{path}/look/*.meta.json", multiLine=True)
    words = spark.read.text(f"{path}/look/*.txt", wholetext=True).select(F.size(F.split("value", " ")).alias("n"))
    return meta.crossJoin(words).select(F.lit(one["key"]).alias("key"), "n", "dataset")


@_query("SELECT sample_id, dataset, task, target_text, input_text FROM raw_sample")
def write_predictions(spark: SparkSession, root: str) -> DataFrame:
    """One JSON record a line, nulls written."""
    path, names = scratch(spark, "predictions"), ["sample_id", "dataset", "task", "target_text", "input_text"]
    sinks.write_predictions(table(spark, root, "raw_sample").select(*names), path)
    return spark.read.schema(", ".join(f"{n} string" for n in names)).json(path)


@_query("SELECT task, count(*) AS rows, true AS bounded FROM raw_sample GROUP BY 1")
def write_routed(spark: SparkSession, root: str) -> DataFrame:
    """A folder for each task, files of at most 100 rows."""
    path = scratch(spark, "routed")
    sinks.write_routed(table(spark, root, "raw_sample").select("sample_id", "task"), path, "task", maxcount=100)
    each = spark.read.parquet(path).groupBy("task", F.input_file_name().alias("file")).agg(F.count("*").alias("n"))
    return each.groupBy("task").agg(F.sum("n").alias("rows"), (F.max("n") <= 100).alias("bounded"))


@_query("SELECT count(*) AS rows, true AS bounded, count(*) >= 1 AS any FROM documents")
def write_shard_files(spark: SparkSession, root: str) -> DataFrame:
    path = scratch(spark, "files")
    sinks.write_shards(table(spark, root, "documents").select("doc_id"), path, maxcount=150)
    each = spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.count("*").alias("n"))
    return each.agg(F.sum("n").alias("rows"), (F.max("n") <= 150).alias("bounded"), (F.count("*") >= 1).alias("any"))


@_query("SELECT event_id AS step, event_type AS name, value FROM events")
def write_metric_log(spark: SparkSession, root: str) -> DataFrame:
    """A log that two runs add to."""
    path = scratch(spark, "metrics")
    rows = table(spark, root, "events").select(F.col("event_id").alias("step"), F.col("event_type").alias("name"), "value")
    for k in (0, 1):
        sinks.append_metrics(rows.filter(F.col("step") % 2 == k), path)
    return spark.read.parquet(path)


@_query("SELECT base_model, text_vocab_size::BIGINT AS text_vocab_size, speech_offset::BIGINT AS speech_offset, num_codebooks::BIGINT AS num_codebooks, cardinality(extra_special_ids)::INT AS specials FROM tokenizer_config")
def write_tokenizer_config(spark: SparkSession, root: str) -> DataFrame:
    path = scratch(spark, "config")
    sinks.write_config(table(spark, root, "tokenizer_config").first().asDict(recursive=True), path)  # one row
    got = corpora.tokenizer_config(spark, path)
    return got.select("base_model", "text_vocab_size", "speech_offset", "num_codebooks", F.size(F.json_object_keys(F.to_json("extra_special_ids"))).alias("specials"))


@_query(
    f"""SELECT dataset, count(*) AS num_samples, round(avg((length({_strip('target_text')}) > 0)::INT) FILTER (task <> 'tts'), 9) AS rate FROM (SELECT dataset, task, coalesce(target_text, '') AS target_text FROM raw_sample) GROUP BY 1
        UNION ALL SELECT 'ALL_DATASETS', count(*), round(avg((length({_strip('target_text')}) > 0)::INT) FILTER (task <> 'tts'), 9) FROM (SELECT task, coalesce(target_text, '') AS target_text FROM raw_sample)"""
)
def write_summaries(spark: SparkSession, root: str) -> DataFrame:
    """A summary file for each data set and one for all, read from the files of the data sets."""
    path = scratch(spark, "summaries")
    rows = table(spark, root, "raw_sample").select("dataset", "task", "target_text", F.col("target_text").alias("pred_text"), (F.col("task") == "tts").alias("target_has_speech"), F.lit(False).alias("pred_has_speech"))
    none = {"metric_name": F.lit(None).cast("string"), "metric_value": F.lit(None).cast("double"), "text_exact_match": F.lit(None).cast("double")}
    sinks.write_summary(evaluate.summary(rows.withColumns(none)), path)
    got = spark.read.json(f"{path}/*/summary.json", multiLine=True)
    return got.select("dataset", "num_samples", F.round("nonempty_pred_text_rate", 9).alias("rate"))


@_query(f"SELECT i AS place, 'a' AS part, sample_id AS id FROM (SELECT DISTINCT sample_id, 0 AS i FROM packed_sample) UNION ALL SELECT 1, 'b', id FROM (SELECT DISTINCT id FROM covost2_sample)")
def tagged_union(spark: SparkSession, root: str) -> DataFrame:
    a = table(spark, root, "packed_sample").select(F.col("sample_id").alias("id")).distinct()
    b = table(spark, root, "covost2_sample").select("id").distinct()
    return mixture.tagged_union({"a": a, "b": b}, "part").select(F.col("part_place").alias("place"), "part", "id")


@_query("SELECT sample_id, dataset || '/' || lower(trim(split)) AS prefix, length(target_text)::INT AS n FROM raw_sample WHERE task = 'asr' AND target_text IS NOT NULL")
def complete_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Only samples with both halves."""
    rows = table(spark, root, "raw_sample").filter("task = 'asr'")
    both = rows.select("sample_id", "dataset", "split", F.col("target_text").alias("json"), F.col("sample_id").alias("npz"))
    return pack.complete(both).select("sample_id", F.concat_ws("/", "dataset", F.lower(F.trim("split"))).alias("prefix"), F.length(text.preview(F.col("json"), 2**30)).alias("n"))


@_query(
    """SELECT '1_' || (vec_id // 10)::VARCHAR || '_' || (vec_id % 10)::VARCHAR AS stem, 16::INT AS frames, 1.28::DOUBLE AS duration_sec, 6::INT AS part_frames, 0.48::DOUBLE AS part_sec FROM embeddings"""
)
def read_recordings(spark: SparkSession, root: str) -> DataFrame:
    """Recordings written as wav files, indexed by name, read whole and in part."""
    path = scratch(spark, "waves")
    rows = table(spark, root, "embeddings")
    name = F.concat(F.lit("1_"), F.floor(F.col("vec_id") / 10).cast("string"), F.lit("_"), (F.col("vec_id") % 10).cast("string"))
    waves = audio.decoded_codes(rows.select(name.alias("key"), speech.quantised(F.col("embedding"), SPACE, 16).alias("codes")))
    audio.write_waves(waves.filter("error IS NULL"), path).count()
    index = audio.file_index(spark, path)
    content = spark.read.format("binaryFile").load(f"{path}/*.wav").select("path", "content")
    files = content.join(index, "path").select(F.col("stem").alias("key"), "content")
    none = F.lit(None).cast("double")
    whole = audio.encoded(files.withColumns({"begin": none, "end": none}))
    part = audio.encoded(files.withColumns({"begin": F.lit(0.32), "end": F.lit(0.8)})).select("key", F.size(F.get("codes", F.lit(0))).alias("part_frames"), F.round("duration_sec", 9).alias("part_sec"))
    out = whole.select("key", F.size(F.get("codes", F.lit(0))).alias("frames"), F.round("duration_sec", 9).alias("duration_sec")).join(part, "key")
    return out.withColumnRenamed("key", "stem")


@_query(
    """SELECT split_part(stem, '_', 1) || '_' || split_part(stem, '_', 2) AS passage, string_agg(path, ',' ORDER BY split_part(stem, '_', 3)::INT) AS files, round(sum(coalesce(duration_sec, 0)), 6) AS duration_sec,
       string_agg((num_frames % 2048)::VARCHAR || ',7', ',' ORDER BY split_part(stem, '_', 3)::INT) AS codes FROM wav_index GROUP BY 1"""
)
def join_recordings(spark: SparkSession, root: str) -> DataFrame:
    """The codes of a passage's recordings put together in spoken order; each recording stands for two frames here."""
    w, part = table(spark, root, "wav_index"), F.split("stem", "_")
    code = (F.col("num_frames") % 2048).cast("int")
    book = F.array(code, F.lit(7))
    rows = w.select(F.concat_ws("_", part[0], part[1]).alias("passage"), part[2].cast("int").alias("place"), "path", F.array(book, book).alias("codes"), F.coalesce("duration_sec", F.lit(0.0)).alias("duration_sec"))
    out = audio.joined_passages(rows)
    return out.select("passage", F.array_join("files", ",").alias("files"), F.round("duration_sec", 6).alias("duration_sec"), F.array_join(F.transform(F.get("codes", F.lit(1)), lambda x: x.cast("string")), ",").alias("codes"))


@_query("SELECT sample_id, row_number() OVER (ORDER BY md5('3-' || sample_id), sample_id) - 1 AS place FROM (SELECT DISTINCT sample_id FROM packed_sample)")
def shuffle_order(spark: SparkSession, root: str) -> DataFrame:
    return mixture.shuffled(table(spark, root, "packed_sample").select("sample_id").distinct(), "sample_id", seed=3)


@_query("SELECT base_model, text_vocab_size, speech_offset, speech_vocab_size_total, full_vocab_size, num_codebooks, speech_codebook_size, cardinality(extra_special_ids)::INT AS specials FROM tokenizer_config")
def id_space_config(spark: SparkSession, root: str) -> DataFrame:
    """The id space made from a base model's figures, as the configuration of a data set."""
    c = table(spark, root, "tokenizer_config").first()  # one row
    space = speech.IdSpace(c["base_model"], c["text_vocab_size"], c["num_codebooks"], c["speech_codebook_size"], dict(c["extra_special_ids"]))
    got = space.config() | {"specials": len(space.special)}
    kinds = "base_model string, text_vocab_size int, speech_offset int, speech_vocab_size_total int, full_vocab_size int, num_codebooks int, speech_codebook_size int, specials int"
    return spark.createDataFrame([tuple(got[k.split(" ")[0]] for k in kinds.split(", "))], kinds)


@_query("SELECT n AS place, 'shards/' || num_codebooks || 'x' || speech_codebook_size || '/' || s AS url FROM tokenizer_config, (VALUES (0, 'train'), (1, 'dev')) v(n, s)")
def config_templating(spark: SparkSession, root: str) -> DataFrame:
    """Settings with placeholders, written, read and filled in from the configuration of a data set."""
    path, c = scratch(spark, "settings"), table(spark, root, "tokenizer_config").first()
    files.write_bytes(f"{path}/run.json", b'{"urls": ["shards/{num_codebooks}x{size}/train", "shards/{num_codebooks}x{size}/dev"]}')
    urls = configs.filled(configs.load(f"{path}/run.json")["urls"], num_codebooks=c["num_codebooks"], size=c["speech_codebook_size"])
    return spark.createDataFrame(list(enumerate(urls)), "place int, url string")


@_query(
    """SELECT id AS given, CASE k WHEN 0 THEN id WHEN 1 THEN id WHEN 2 THEN 'key-' || id ELSE 'unknown' END AS sample_id, 'unknown' AS dataset, CASE WHEN k = 1 THEN NULL WHEN k = 2 THEN t ELSE 'text of ' || id END AS target_text
       FROM (SELECT sample_id AS id, target_text AS t, coalesce(length(target_text), 0) % 4 AS k FROM raw_sample WHERE task = 'asr')"""
)
def key_fallback(spark: SparkSession, root: str) -> DataFrame:
    """Shard documents that name their sample in several ways or not at all; `text` counts where it is there, even null."""
    rows = table(spark, root, "raw_sample").filter("task = 'asr'")
    k, i = F.coalesce(F.length("target_text"), F.lit(0)) % 4, F.col("sample_id")
    own = F.map_from_arrays(
        F.when(k == 0, F.array(F.lit("id"), F.lit("text"))).when(k == 1, F.array(F.lit("sample_id"), F.lit("text"))).when(k == 2, F.array(F.lit("text_tn"), F.lit("other"))).otherwise(F.array(F.lit("text"), F.lit("other"))),
        F.when(k == 0, F.array(i, F.concat(F.lit("text of "), i))).when(k == 1, F.array(i, F.lit(None))).when(k == 2, F.array(F.col("target_text"), F.lit("x"))).otherwise(F.array(F.concat(F.lit("text of "), i), F.lit("x"))),
    )
    doc = F.to_json(F.map_concat(own, F.create_map(F.lit("task"), F.lit("asr"))), {"ignoreNullFields": "false"})
    key = F.when(k == 2, F.concat(F.lit("key-"), i)).when(k < 2, F.lit("another"))
    return pack.dispatch(rows.select(key.alias("key"), doc.alias("meta"), i.alias("given")), F.col("meta")).select("given", "sample_id", "dataset", "target_text")
