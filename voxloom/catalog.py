"""The queries over the engine's own operators, with the same results as SQL where SQL has them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import embeddings, ids, metrics, schedule, speech, text
from voxloom.operators import build, chat, checks, evaluate, load, mixture, pack, trainlog
from voxloom.plans import pipeline
from voxloom.runtime import scratch, table
from voxloom.sources import audio, sinks
from voxloom.streaming import raw as stream

#: White space for DuckDB's expressions, as functions.text.WS.
_WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

SPACE = speech.IdSpace("example/lm-small", 50304, 4, 2048, {"eos": 50256, "pad": 50256})

# The weights of a training mixture at its start and end.
MIX = (("gigaspeech_asr", 0.6, 0.56), ("commonvoice_asr", 0.30, 0.30), ("covost2", 0.03, 0.05), ("spoken_squad", 0.02, 0.04), ("ultrachat_200k", 0.05, 0.05))

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _squeeze(c: str) -> str:
    return f"coalesce(regexp_replace(regexp_replace({c}, '{_WS}+', ' ', 'g'), '^ +| +$', '', 'g'), '')"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def _joined(c: Column | str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def _print(c: Column | str) -> Column:
    """A short print of a list of ids, which any engine can take."""
    return F.md5(_joined(c))


# ---------------------------------------------------------------- text


@_query(f"SELECT doc_id, {_squeeze('text')} AS text FROM documents")
def text_normalize_ws(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", text.squeeze(F.col("text")).alias("text"))


def _spoken_sql(c: str) -> str:
    out = _strip(c)
    for tag, mark in text.PUNCTUATION_TAGS:
        out = f"replace({out}, '{tag}', '{mark.replace(chr(39), chr(39) * 2)}')"
    out = f"regexp_replace({out}, '{_WS}*<[^<>]+>{_WS}*', ' ', 'g')"
    return f"lower({_squeeze(f'regexp_replace({out}, {chr(39)}{_WS}+([,.:;?!]){chr(39)}, {chr(39)}{chr(92)}1{chr(39)}, {chr(39)}g{chr(39)})')})"


@_query(f"SELECT sample_id, {_spoken_sql('target_text')} AS text FROM raw_sample WHERE task = 'asr'")
def text_normalize_tagged(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "raw_sample").filter("task = 'asr'")
    return rows.select("sample_id", text.spoken_text(F.col("target_text")).alias("text"))


@_query(
    f"""SELECT dataset, coalesce({_strip('target_text')} IN ('<SIL>', '<MUSIC>', '<NOISE>', '<OTHER>'), false) AS garbage,
        {_spoken_sql('target_text')} = '' AS empty, count(*) AS n FROM raw_sample WHERE task = 'asr' GROUP BY ALL"""
)
def garbage_filter(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "raw_sample").filter("task = 'asr'")
    t = F.col("target_text")
    return rows.groupBy("dataset", text.is_speechless(t).alias("garbage"), (text.spoken_text(t) == "").alias("empty")).agg(F.count("*").alias("n"))


@_query("SELECT id, duration_sec FROM covost2_sample WHERE duration_sec BETWEEN 0.2 AND 120.0")
def duration_filter(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "covost2_sample").filter(~build.bad_duration(F.col("duration_sec"))).select("id", "duration_sec")


@_query(
    f"""SELECT id, CASE WHEN length({_strip('target_text')}) > 0 THEN target_text WHEN length({_strip('source_text')}) > 0 THEN source_text
        ELSE coalesce(audio_relpath, '') END AS text FROM covost2_sample"""
)
def first_nonblank_field(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "covost2_sample").select("id", text.first_filled(F.col("target_text"), F.col("source_text"), F.col("audio_relpath")).alias("text"))


@_query("SELECT doc_id, substr(text, 1, 40) AS preview FROM documents")
def text_preview(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", text.preview(F.col("text"), 40).alias("preview"))


# ---------------------------------------------------------------- ids and tasks


@_query("SELECT doc_id, i AS ordinal FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i >= 100 AND i % 4 = 1")
def scan_ordinal_partition(spark: SparkSession, root: str) -> DataFrame:
    rows = ids.with_ordinal(table(spark, root, "documents").select("doc_id"), "doc_id")
    return rows.filter(ids.worker_share(F.col("ordinal"), start=100, workers=4, worker=1)).select("doc_id", "ordinal")


_FRACTION = "(('0x' || substr(md5({0}), 1, 8))::BIGINT / 4294967295.0)"


@_query(f"SELECT sample_id, CASE WHEN {_FRACTION.format('sample_id')} < 0.5 THEN 'asr' ELSE 'tts' END AS task FROM raw_sample")
def task_hash_assign(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "raw_sample").select("sample_id", ids.task_by_hash(F.col("sample_id")).alias("task"))


def _fanned(spark: SparkSession, root: str, mode: str) -> DataFrame:
    rows = table(spark, root, "covost2_sample").select("id", "source_text", F.concat(F.lit("codes of "), "audio_relpath").alias("speech"))
    return build.fan_out(rows, "id", mode, "source_text", "speech").select("id", "task", "input_text", "target_text", "input_speech", "target_speech")


_FAN = """SELECT id, t AS task, CASE WHEN t = 'tts' THEN source_text END AS input_text, CASE WHEN t = 'asr' THEN source_text END AS target_text,
    CASE WHEN t = 'asr' THEN 'codes of ' || audio_relpath END AS input_speech, CASE WHEN t = 'tts' THEN 'codes of ' || audio_relpath END AS target_speech
    FROM (SELECT *, unnest({0}) AS t FROM covost2_sample)"""


@_query(_FAN.format("['asr', 'tts']"))
def task_fanout_both(spark: SparkSession, root: str) -> DataFrame:
    return _fanned(spark, root, "both")


@_query(_FAN.format(f"[CASE WHEN {_FRACTION.format('id')} < 0.5 THEN 'asr' ELSE 'tts' END]"))
def task_fanout_mixed(spark: SparkSession, root: str) -> DataFrame:
    return _fanned(spark, root, "mixed")


@_query("SELECT doc_id, 'corpus-' || split || '-' || lpad((row_number() OVER (ORDER BY doc_id) - 1)::VARCHAR, 9, '0') || '-asr' AS sample_id FROM documents")
def sample_id(spark: SparkSession, root: str) -> DataFrame:
    rows = ids.with_ordinal(table(spark, root, "documents").select("doc_id", "split"), "doc_id")
    return rows.select("doc_id", ids.sample_id("corpus", F.col("split"), F.col("ordinal"), "-asr").alias("sample_id"))


@_query("SELECT doc_id, (i // 100)::BIGINT AS shard, 'shard-' || lpad((i // 100)::VARCHAR, 6, '0') AS shard_name FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)")
def shard_assign(spark: SparkSession, root: str) -> DataFrame:
    return sinks.sharded(table(spark, root, "documents").select("doc_id"), "doc_id", maxcount=100).select("doc_id", "shard", "shard_name")


@_query("SELECT sample_id, count(*) AS n FROM raw_sample GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, root: str) -> DataFrame:
    return checks.repeated(table(spark, root, "raw_sample"), "sample_id")


# ---------------------------------------------------------------- raw build


def _outer_meta(spark: SparkSession, root: str) -> DataFrame:
    """Segments, each with its recording."""
    rows = table(spark, root, "raw_sample").filter("dataset = 'gigaspeech'")
    meta = F.from_json("meta", "aid string, source string, segment_subsets array<string>, begin_time double, end_time double")
    rows = rows.select(meta.alias("m"), "sample_id", "target_text")
    tags = F.transform("m.segment_subsets", lambda x: F.concat(F.lit("{"), x, F.lit("}")))
    seg = F.struct(F.col("sample_id").alias("sid"), F.col("m.begin_time").alias("begin_time"), F.col("m.end_time").alias("end_time"), tags.alias("subsets"), F.col("target_text").alias("text_tn"))
    return rows.select("m.aid", "m.source", seg.alias("s"))


def _segments(spark: SparkSession, root: str) -> DataFrame:
    """Recordings with their segments, nested as their corpus delivers them."""
    one = _outer_meta(spark, root).groupBy("aid", "source").agg(F.collect_list("s").alias("segments"))
    return one.select(F.array(F.struct("aid", "source", F.lit(None).cast("array<string>").alias("subsets"), "segments")).alias("audios"))


_SEGMENTS = """(SELECT json_extract_string(meta, '$.aid') AS aid, sample_id AS sid, target_text AS text_tn, json_extract(meta, '$.begin_time')::DOUBLE AS begin_time,
    json_extract(meta, '$.end_time')::DOUBLE AS end_time, json_extract_string(meta, '$.segment_subsets[*]') AS tags FROM raw_sample WHERE dataset = 'gigaspeech')"""


@_query(f"SELECT aid, sid, begin_time, end_time FROM {_SEGMENTS} WHERE list_contains(tags, 'L')")
def segments_unnest(spark: SparkSession, root: str) -> DataFrame:
    return build.unnest_segments(_segments(spark, root), "L").select("aid", "sid", "begin_time", "end_time")


@_query(f"SELECT sid, list_contains(tags, 'M') AS member FROM {_SEGMENTS} WHERE list_contains(tags, 'XL')")
def subset_membership(spark: SparkSession, root: str) -> DataFrame:
    rows = build.unnest_segments(_segments(spark, root), "XL").select("sid", build.in_subset(F.col("subsets"), "M").alias("member"))
    return rows


@_query(
    f"""SELECT disposition, count(*) AS rows FROM (SELECT CASE WHEN {_strip('text_tn')} IN ('<SIL>', '<MUSIC>', '<NOISE>', '<OTHER>') THEN 'garbage'
        WHEN {_spoken_sql('text_tn')} = '' THEN 'empty_text' WHEN NOT coalesce(end_time - begin_time BETWEEN 0.2 AND 120.0, false) THEN 'bad_duration' ELSE 'written' END AS disposition
        FROM {_SEGMENTS} WHERE list_contains(tags, 'XL')) GROUP BY 1"""
)
def disposition_counts(spark: SparkSession, root: str) -> DataFrame:
    rows = build.unnest_segments(_segments(spark, root), "XL")
    out = build.transcript_disposition(F.col("text_tn"), F.col("end_time") - F.col("begin_time"), F.lit(True), F.col("sid"))
    return build.counters(rows.withColumn("disposition", out))


@_query(f"SELECT sid, greatest(round_even(begin_time * 24000, 0)::BIGINT, 0) AS start, round_even(end_time * 24000, 0)::BIGINT AS stop FROM {_SEGMENTS} WHERE list_contains(tags, 'XL')")
def segment_frames(spark: SparkSession, root: str) -> DataFrame:
    rows = build.unnest_segments(_segments(spark, root), "XL")
    return rows.select("sid", build.segment_frames(F.col("begin_time"), F.col("end_time"), F.lit(24000)).alias("f")).select("sid", "f.start", "f.stop")


@_query(
    f"""SELECT CASE WHEN length({_strip('audio_relpath')}) IS NULL OR length({_strip('audio_relpath')}) = 0 THEN 'failed' WHEN source_text IS NULL OR length({_strip('source_text')}) = 0 THEN 'empty_text'
        WHEN NOT coalesce(duration_sec BETWEEN 0.2 AND 120.0, false) THEN 'bad_duration' ELSE 'written' END AS disposition, count(*) AS rows FROM covost2_sample GROUP BY 1"""
)
def clip_dispositions(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "covost2_sample")
    out = build.clip_disposition(F.col("audio_relpath"), F.col("source_text"), F.col("duration_sec"), F.lit(True))
    return build.counters(rows.withColumn("disposition", out))


_DRY = "SELECT CASE {0} END AS disposition, count(*) AS rows FROM {1} GROUP BY 1"


@_query(_DRY.format("WHEN NOT list_contains(tags, 'M') THEN 'missing_audio' ELSE 'available'", f"{_SEGMENTS} WHERE list_contains(tags, 'XL')"))
def dry_run_segments(spark: SparkSession, root: str) -> DataFrame:
    rows = build.unnest_segments(_segments(spark, root), "XL")
    out = build.transcript_disposition(F.col("text_tn"), F.col("end_time") - F.col("begin_time"), build.in_subset(F.col("subsets"), "M"), F.col("sid"), dry=True)
    return build.counters(rows.withColumn("disposition", out))


@_query(
    _DRY.format(
        f"WHEN length({_strip('audio_relpath')}) IS NULL OR length({_strip('audio_relpath')}) = 0 THEN 'failed' WHEN source_text IS NULL OR length({_strip('source_text')}) = 0 THEN 'empty_text' WHEN client_id IS NULL THEN 'missing_audio' "
        "WHEN NOT coalesce(duration_sec BETWEEN 0.2 AND 120.0, false) THEN 'bad_duration' ELSE 'available'",
        "covost2_sample",
    )
)
def dry_run_clips(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "covost2_sample")
    out = build.clip_disposition(F.col("audio_relpath"), F.col("source_text"), F.col("duration_sec"), F.col("client_id").isNotNull(), dry=True)
    return build.counters(rows.withColumn("disposition", out))


@_query(_DRY.format("WHEN client_id IS NULL THEN 'missing_audio' WHEN duration_sec IS NULL THEN 'failed' ELSE 'written'", "covost2_sample"))
def translation_dispositions(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "covost2_sample")
    return build.counters(rows.withColumn("disposition", build.encoded_disposition(F.col("client_id").isNotNull(), F.col("duration_sec").isNull())))


@_query(
    _DRY.format(
        "WHEN NOT there THEN 'missing_audio' ELSE 'written'",
        f"""(SELECT bool_and(w.stem IS NOT NULL) AS there FROM (SELECT id, written_at, regexp_replace(unnest(audio_files), '\\.wav$', '') AS stem FROM spoken_squad_sample WHERE length({_strip('question')}) > 0 AND length({_strip('answer_text')}) > 0) n
            LEFT JOIN (SELECT * FROM wav_index WHERE duration_sec IS NOT NULL) w USING (stem) GROUP BY id, written_at)""",
    )
)
def question_dispositions(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "spoken_squad_sample").filter(text.filled(F.col("question")).isNotNull() & text.filled(F.col("answer_text")).isNotNull())
    named = rows.select("id", "written_at", F.explode("audio_files").alias("file")).select("id", "written_at", F.regexp_replace("file", r"\.wav$", "").alias("stem"))
    got = build.with_audio(named, _recordings(spark, root)[1], "stem").groupBy("id", "written_at").agg(F.bool_and(F.col("audio_path").isNotNull()).alias("there"))
    return build.counters(got.withColumn("disposition", build.encoded_disposition(F.col("there"), F.lit(False))))


def _recordings(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The recordings that passages name, and an index of those whose duration is known."""
    named = table(spark, root, "spoken_squad_sample").select("id", F.explode("audio_files").alias("file"))
    named = named.select("id", F.regexp_replace("file", r"\.wav$", "").alias("stem"))
    return named, table(spark, root, "wav_index").filter("duration_sec IS NOT NULL")


_NAMED = "(SELECT id, regexp_replace(f, '\\.wav$', '') AS stem FROM (SELECT id, unnest(audio_files) AS f FROM spoken_squad_sample))"


@_query(f"SELECT n.id, n.stem, w.path AS audio_path FROM {_NAMED} n LEFT JOIN (SELECT * FROM wav_index WHERE duration_sec IS NOT NULL) w USING (stem)")
def audio_index_lookup(spark: SparkSession, root: str) -> DataFrame:
    named, index = _recordings(spark, root)
    return build.with_audio(named, build.unique_stems(index), "stem").select("id", "stem", "audio_path")


@_query(f"SELECT n.id, n.stem FROM {_NAMED} n ANTI JOIN (SELECT * FROM wav_index WHERE duration_sec IS NOT NULL) w USING (stem)")
def audio_missing(spark: SparkSession, root: str) -> DataFrame:
    return build.without_audio(*_recordings(spark, root), "stem").select("id", "stem")


_BY = "num_frames % 6"


@_query(
    f"""SELECT stem, m AS path, CASE {_BY} WHEN 0 THEN d || '.wav' WHEN 1 THEN m WHEN 2 THEN stem || '.wav' WHEN 3 THEN stem || '.mp3' WHEN 4 THEN m ELSE d || '.wav' END AS resolved, {_BY} < 5 AS found
        FROM (SELECT *, regexp_replace(path, '\\.wav$', '') AS d, regexp_replace(path, '\\.wav$', '.mp3') AS m FROM wav_index)"""
)
def path_resolve(spark: SparkSession, root: str) -> DataFrame:
    index = table(spark, root, "wav_index")
    at, d = F.col("num_frames") % 6, F.regexp_replace("path", r"\.wav$", "")
    mp3, wav, bare, bare_mp3 = F.concat(d, F.lit(".mp3")), F.concat(d, F.lit(".wav")), F.concat("stem", F.lit(".wav")), F.concat("stem", F.lit(".mp3"))
    # the files there: each candidate for some, two of them for others, none for the rest
    there = F.when(at == 0, F.array(wav, bare)).when(at == 1, F.array(mp3)).when(at == 2, F.array(bare)).when(at == 3, F.array(bare_mp3)).when(at == 4, F.array(bare_mp3, mp3))
    files = index.select(F.explode(there).alias("path"))
    return build.resolve_paths(index.select("stem", mp3.alias("path")), files, "path", "stem").select("stem", "path", "resolved", "found")


@_query(
    """SELECT split_part(stem, '_', 1)::INT AS topic, split_part(stem, '_', 2)::INT AS para, string_agg(path, ',' ORDER BY split_part(stem, '_', 3)::INT) AS files
       FROM wav_index WHERE regexp_full_match(stem, '[0-9]+_[0-9]+_[0-9]+') GROUP BY 1, 2"""
)
def passage_recordings(spark: SparkSession, root: str) -> DataFrame:
    return build.ordered_recordings(table(spark, root, "wav_index")).select("topic", "para", F.array_join("files", ",").alias("files"))


@_query(
    f"""SELECT qa_id, title, question, answer_text FROM spoken_squad_sample WHERE length({_strip('question')}) > 0 AND length({_strip('answer_text')}) > 0"""
)
def qa_unnest(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "spoken_squad_sample")
    qa = F.array(F.struct(F.col("qa_id").alias("id"), "question", F.array(F.struct(F.col("answer_text").alias("text"))).alias("answers")))
    docs = rows.select(F.array(F.struct("title", F.array(F.struct(F.col("context_text").alias("context"), qa.alias("qas"))).alias("paragraphs"))).alias("data"))
    return build.unnest_questions(docs).select("qa_id", "title", "question", "answer_text")


# ---------------------------------------------------------------- chats

_ROLE = f"CASE WHEN lower(coalesce({_strip('m.role')}, '')) IN ('human', 'user') THEN 'user' WHEN lower(coalesce({_strip('m.role')}, '')) IN ('assistant', 'gpt', 'bot') THEN 'assistant' ELSE lower(coalesce({_strip('m.role')}, '')) END"
_TURNS = f"""(SELECT id, written_at, i, {_ROLE} AS role, m.content AS raw, '<text> ' || {_strip('m.content')} AS content FROM (SELECT id, written_at, unnest(messages) AS m, generate_subscripts(messages, 1) AS i FROM ultrachat_sample)
    WHERE length({_strip('m.content')}) > 0)"""
_KNOWN = f"(SELECT *, row_number() OVER (PARTITION BY id, written_at ORDER BY i) AS k FROM {_TURNS} WHERE role IN ('user', 'assistant', 'system'))"


@_query(f"SELECT id, k - 1 AS turn, role, content FROM {_KNOWN}")
def chat_normalize(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "ultrachat_sample").select("id", F.posexplode(chat.usable(F.col("messages"))).alias("turn", "m"))
    return rows.select("id", F.col("turn").cast("bigint").alias("turn"), "m.role", "m.content")


_LAST = f"(SELECT id, written_at, max(k) AS a FROM {_KNOWN} WHERE role = 'assistant' GROUP BY 1, 2)"
_PAIRS = f"""(SELECT t.id, t.written_at, string_agg('<|im_start|>' || t.role || chr(10) || t.content || '<|im_end|>' || chr(10), '' ORDER BY t.k) FILTER (t.k < l.a) AS p,
    any_value(t.content) FILTER (t.k = l.a) AS c FROM {_KNOWN} t JOIN {_LAST} l ON t.id = l.id AND t.written_at = l.written_at WHERE l.a > 1 GROUP BY 1, 2)"""
_TARGET = _strip("CASE WHEN c LIKE '<text> %' THEN substr(c, 8) ELSE c END")


@_query(f"SELECT id, p || '<|im_start|>assistant <text> ' AS prompt, {_TARGET} AS target FROM {_PAIRS}")
def sft_pairs(spark: SparkSession, root: str) -> DataFrame:
    rows = chat.prompt_and_target(table(spark, root, "ultrachat_sample").select("id", "messages"))
    return rows.filter(F.col("target").isNotNull()).select("id", chat.prompt_text(F.col("prompt_messages")).alias("prompt"), "target")


@_query(
    f"""SELECT disposition, count(*) AS rows FROM (SELECT CASE WHEN u.messages IS NULL OR len(u.messages) = 0 THEN 'missing_messages' WHEN t IS NULL OR length(t) = 0 THEN 'bad_pair'
        WHEN length(prompt) < 200 OR length(t) < 40 THEN 'too_short' ELSE 'written' END AS disposition
        FROM ultrachat_sample u LEFT JOIN (SELECT id, written_at, p || '<|im_start|>assistant <text> ' AS prompt, {_TARGET} AS t FROM {_PAIRS}) x ON u.id = x.id AND u.written_at = x.written_at) GROUP BY 1"""
)
def sft_dispositions(spark: SparkSession, root: str) -> DataFrame:
    rows = chat.prompt_and_target(table(spark, root, "ultrachat_sample").select("id", "messages"))
    return build.counters(chat.sft_disposition(rows, min_prompt=200, min_target=40))


@_query(
    f"""SELECT disposition, count(*) AS rows FROM (SELECT CASE WHEN u.messages IS NULL OR len(u.messages) = 0 THEN 'missing_messages' WHEN t IS NULL OR length(t) = 0 THEN 'bad_pair'
        WHEN strlen(prompt) > 600 OR strlen(t) > 200 THEN 'too_long' ELSE 'written' END AS disposition
        FROM ultrachat_sample u LEFT JOIN (SELECT id, written_at, p || '<|im_start|>assistant <text> ' AS prompt, {_TARGET} AS t FROM {_PAIRS}) x ON u.id = x.id AND u.written_at = x.written_at) GROUP BY 1"""
)
def sft_token_limits(spark: SparkSession, root: str) -> DataFrame:
    """Limits in tokens, a byte of the text being one."""
    rows = chat.prompt_and_target(table(spark, root, "ultrachat_sample").select("id", "messages"))
    n = lambda c: F.size(pack.utf8_bytes(c))
    out = chat.sft_disposition(rows, max_prompt_tokens=600, max_target_tokens=200, n_prompt=n(chat.prompt_text(F.col("prompt_messages"))), n_target=n(F.col("target")))
    return build.counters(out)


@_query(
    f"""SELECT count(*) FILTER (NOT coalesce(length({_strip('m.content')}) > 0, false)) AS no_content, count(*) FILTER (length({_strip('m.content')}) > 0 AND {_ROLE} NOT IN ('user', 'assistant', 'system')) AS no_role
        FROM (SELECT unnest(messages) AS m FROM ultrachat_sample)"""
)
def message_counters(spark: SparkSession, root: str) -> DataFrame:
    m = F.col("messages")
    rows = table(spark, root, "ultrachat_sample").filter(m.isNotNull())
    return rows.agg(F.sum(chat.without_content(m)).alias("no_content"), F.sum(chat.without_role(m)).alias("no_role"))


# ---------------------------------------------------------------- speech ids

_V, _K, _C = SPACE.offset, SPACE.num_codebooks, SPACE.codebook_size
_INTERLEAVED = f"flatten([[{', '.join(f'{{0}}[{k + 1}][t] + {_V + k * _C}' for k in range(_K))}] for t in range(1, len({{0}}[1]) + 1)])"
_CODES = f"[[floor((greatest(least(embedding[k * 16 + t]::DOUBLE, 1.0), -1.0) + 1) / 2 * {_C - 1})::INT for t in range(1, 17)] for k in range(0, {_K})]"


@_query(f"SELECT sample_id, array_to_string({_INTERLEAVED.format('input_speech')}, ',') AS ids FROM raw_sample WHERE input_speech IS NOT NULL")
def speech_encode_ids(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "raw_sample").filter("input_speech IS NOT NULL")
    return rows.select("sample_id", _joined(speech.speech_ids(F.col("input_speech"), SPACE)).alias("ids"))


@_query(f"SELECT vec_id, array_to_string(flatten({_CODES}), ',') AS codes, true AS same FROM embeddings")
def speech_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    codes = speech.quantised(F.col("embedding"), SPACE, 16)
    rows = table(spark, root, "embeddings").select("vec_id", codes.alias("c"))
    back = speech.speech_codes(speech.speech_ids(F.col("c"), SPACE), SPACE)
    return rows.select("vec_id", _joined(F.flatten("c")).alias("codes"), (back == F.col("c")).alias("same"))


@_query(f"SELECT vec_id, 30720::BIGINT AS samples, array_to_string(flatten({_CODES}), ',') AS codes FROM embeddings")
def codec_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    """Codes to a recording and back to codes."""
    rows = table(spark, root, "embeddings").select(F.col("vec_id").alias("key"), speech.quantised(F.col("embedding"), SPACE, 16).alias("codes"))
    waves = audio.decoded_codes(rows).select("key", F.col("wav").alias("content"), "samples")
    times = {"begin": F.lit(None).cast("double"), "end": F.lit(None).cast("double")}
    back = audio.encoded(waves.withColumns(times)).select(F.col("key").cast("long").alias("vec_id"), _joined(F.flatten("codes")).alias("codes"))
    return back.join(waves.select(F.col("key").cast("long").alias("vec_id"), "samples"), "vec_id").select("vec_id", "samples", "codes")


_UNIQUE_PACKED = "(SELECT DISTINCT sample_id, input_ids FROM packed_sample)"
_RUNS = f"""(SELECT sample_id, run, min(i) - 1 AS start, max(i) AS stop, any_value(s) AS s, list(x ORDER BY i) AS ids FROM (SELECT *, sum(c) OVER (PARTITION BY sample_id ORDER BY i) AS run FROM
    (SELECT *, CASE WHEN lag(s) OVER (PARTITION BY sample_id ORDER BY i) = s THEN 0 ELSE 1 END AS c FROM
    (SELECT sample_id, i, x, x >= {_V} AND x < {SPACE.full_size} AS s FROM (SELECT sample_id, unnest(input_ids) AS x, generate_subscripts(input_ids, 1) AS i FROM {_UNIQUE_PACKED})))) GROUP BY 1, 2)"""


def _unique_packed(spark: SparkSession, root: str, *more: str) -> DataFrame:
    return table(spark, root, "packed_sample").select("sample_id", "input_ids", *more).dropDuplicates(["sample_id"])


@_query(f"SELECT sample_id, CASE WHEN s THEN 'speech' ELSE 'text' END AS type, start::INT AS start, stop::INT AS stop FROM {_RUNS}")
def modality_segments(spark: SparkSession, root: str) -> DataFrame:
    rows = _unique_packed(spark, root).select("sample_id", F.explode(speech.modality_runs(F.col("input_ids"), SPACE)).alias("r"))
    return rows.select("sample_id", "r.type", "r.start", "r.stop")


@_query(
    f"""SELECT sample_id, (row_number() OVER (PARTITION BY sample_id ORDER BY start) - 1)::INT AS segment_index, len(ids)::INT AS raw_num_tokens, (len(ids) // {_K} * {_K})::INT AS usable_num_tokens,
        len(ids) % {_K} <> 0 AS trimmed_incomplete_tail, len(ids) >= {_K} AND len([1 for i in range(1, len(ids) // {_K} * {_K} + 1) if (ids[i] - {_V}) // {_C} <> (i - 1) % {_K}]) = 0 AS decodable
        FROM {_RUNS} WHERE s"""
)
def speech_segment_debug(spark: SparkSession, root: str) -> DataFrame:
    return speech.speech_run_state(_unique_packed(spark, root), "sample_id", "input_ids", SPACE).drop("num_codebooks")


@_query(
    f"""SELECT sample_id, len([x for x in input_ids if x >= {_V} AND x < {SPACE.full_size}])::INT AS n_speech, md5(array_to_string([x for x in input_ids if NOT (x >= {_V} AND x < {SPACE.full_size})], ',')) AS text_ids FROM packed_sample"""
)
def modality_filter(spark: SparkSession, root: str) -> DataFrame:
    x = F.col("input_ids")
    return table(spark, root, "packed_sample").select("sample_id", F.size(speech.only(x, SPACE, True)).alias("n_speech"), _print(speech.only(x, SPACE, False)).alias("text_ids"))


# ---------------------------------------------------------------- packing

PACKER = pack.Packer(SPACE, lambda c: pack.hashed_words(c, SPACE.text_vocab_size), SPACE.special["eos"])


def _ids_sql(c: str) -> str:
    return f"[(('0x' || substr(md5(w), 1, 6))::INT % {_V})::INT for w in string_split_regex({c}, '{_WS}+') if w <> '']"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _parts_sql(task: str) -> tuple[str, str, str]:
    t = PACKER.template
    eos, opening = f"[{PACKER.eos}]", _ids_sql(_lit(t.opening()))
    if task == "text_dialog_sft":
        return "[]::INT[]", "input_text_token", f"target_text_token || {eos}"
    before, after = t.wrapper(pack.SYSTEM[task])
    if task == "tts":
        prefix = _ids_sql(f"{_lit(before)} || '<text> ' || input_text || {_lit(after)}")
        return prefix, opening, f"{_ids_sql(_lit('<speech> '))} || {_INTERLEAVED.format('target_speech')} || {eos}"
    question = f" || {_ids_sql(chr(39) + '<text> ' + chr(39) + ' || question_text')}" if task == "spoken_extract_qa" else ""
    suffix = f"{_INTERLEAVED.format('input_speech')}{question} || {_ids_sql(_lit(after))} || {opening}"
    return f"{_ids_sql(_lit(before))} || {_ids_sql(_lit('<speech> '))}", suffix, f"{_ids_sql(_lit('<text> '))} || {_ids_sql('target_text')} || {eos}"


_NEEDS = {"asr": "input_speech IS NOT NULL AND target_text IS NOT NULL", "tts": "input_text IS NOT NULL AND target_speech IS NOT NULL", "speech_to_text_translation": "input_speech IS NOT NULL AND target_text IS NOT NULL", "spoken_extract_qa": "input_speech IS NOT NULL AND question_text IS NOT NULL AND target_text IS NOT NULL", "text_dialog_sft": "input_text_token IS NOT NULL AND target_text_token IS NOT NULL"}


def _pack_sql(task: str, most: int) -> str:
    p, s, t = _parts_sql(task)
    return f"""SELECT sample_id, len(i)::INT AS n_tokens, len(t)::INT AS n_target_tokens, md5(array_to_string(i, ',')) AS ids, md5(array_to_string([-100 for x in range(len(i) - len(t))] || t, ',')) AS labels FROM
        (SELECT sample_id, t, CASE WHEN len(p) + len(s) + len(t) <= {most} THEN p || s || t ELSE p || s[greatest(len(s) - greatest({most} - len(p) - len(t), 0), 0) + 1 : ] || t END AS i,
         len(p) + len(s) + len(t) > {most} AND (len(p) >= {most} OR len(p) + len(t) > {most}) AS bad
         FROM (SELECT sample_id, {p} AS p, {s} AS s, {t} AS t FROM raw_sample WHERE task = '{task}' AND {_NEEDS[task]})) WHERE NOT bad"""


def _packed(spark: SparkSession, root: str, task: str, most: int = 32000) -> DataFrame:
    packer = pack.Packer(SPACE, PACKER.tokenize, PACKER.eos, most)
    out = packer.pack(table(spark, root, "raw_sample").filter(F.col("task") == task), on_error="quarantine")
    return out.filter(F.col("error").isNull()).select("sample_id", "n_tokens", "n_target_tokens", _print("input_ids").alias("ids"), _print("labels").alias("labels"))


def _register_packing() -> None:
    short = {"asr": "asr", "tts": "tts", "speech_to_text_translation": "s2tt", "spoken_extract_qa": "sqa", "text_dialog_sft": "dialog"}
    for task, name in short.items():
        QUERIES[f"pack_{name}"] = lambda spark, root, t=task: _packed(spark, root, t)
        ORACLES[f"pack_{name}"] = _pack_sql(task, 32000)
    QUERIES["pack_truncate"] = lambda spark, root: _packed(spark, root, "spoken_extract_qa", 56)
    ORACLES["pack_truncate"] = _pack_sql("spoken_extract_qa", 56)


_register_packing()


@_query(
    """SELECT sample_id, error, count(*) AS n FROM (SELECT sample_id, CASE WHEN task = 'asr' AND input_speech IS NULL THEN 'asr needs input_speech' WHEN task = 'asr' AND target_text IS NULL THEN 'asr needs target_text'
       WHEN task = 'tts' AND input_text IS NULL THEN 'tts needs input_text' WHEN task = 'tts' AND target_speech IS NULL THEN 'tts needs target_speech'
       WHEN task = 'speech_to_text_translation' AND input_speech IS NULL THEN 'speech_to_text_translation needs input_speech' WHEN task = 'speech_to_text_translation' AND target_text IS NULL THEN 'speech_to_text_translation needs target_text'
       WHEN task = 'spoken_extract_qa' AND input_speech IS NULL THEN 'spoken_extract_qa needs input_speech' WHEN task = 'spoken_extract_qa' AND question_text IS NULL THEN 'spoken_extract_qa needs question_text'
       WHEN task = 'spoken_extract_qa' AND target_text IS NULL THEN 'spoken_extract_qa needs target_text' WHEN task = 'text_dialog_sft' AND input_text_token IS NULL THEN 'text_dialog_sft needs input_text_token'
       WHEN task = 'text_dialog_sft' AND target_text_token IS NULL THEN 'text_dialog_sft needs target_text_token' END AS error FROM raw_sample) WHERE error IS NOT NULL GROUP BY 1, 2"""
)
def pack_quarantine(spark: SparkSession, root: str) -> DataFrame:
    out = PACKER.pack(table(spark, root, "raw_sample"), on_error="quarantine")
    return out.filter(F.col("error").isNotNull()).groupBy("sample_id", "error").agg(F.count("*").alias("n"))


@_query("SELECT sample_id, task, CASE WHEN task = 'tts' THEN input_text END AS input_text, CASE WHEN task IN ('asr', 'speech_to_text_translation', 'spoken_extract_qa') THEN target_text END AS target_text FROM raw_sample")
def task_dispatch(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "raw_sample")
    # as shards carry it: what a task needs stands in the meta document, under the names of its corpus
    t = F.col("task")
    doc = F.struct(
        F.col("sample_id").alias("id"), "task", F.when(t == "tts", F.col("input_text")).when(t == "asr", F.col("target_text")).alias("text"),
        F.when(t == "speech_to_text_translation", F.col("target_text")).alias("target_text"), F.when(t == "spoken_extract_qa", F.col("target_text")).alias("answer_text"),
    )
    packed_ = rows.select(F.lit("k").alias("key"), F.to_json(doc, {"ignoreNullFields": "false"}).alias("meta"))
    return pack.dispatch(packed_, F.col("meta")).select("sample_id", "task", "input_text", "target_text")


@_query("SELECT doc_id, text, true AS same FROM documents WHERE text IS NOT NULL")
def tokenize_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents").filter("text IS NOT NULL")
    back = pack.utf8_text(pack.utf8_bytes(F.col("text")))
    return rows.select("doc_id", back.alias("text"), (back == F.col("text")).alias("same"))


@_query("SELECT doc_id, true AS some, true AS same FROM documents WHERE length(text) > 0")
def tokenize_public(spark: SparkSession, root: str) -> DataFrame:
    """Whether the ids of a public vocabulary, which is a file and so unknown to SQL, give the text back."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = table(spark, root, "documents").filter(F.length("text") > 0).select("doc_id", "text", pack.public_tokenizer(path)(F.col("text")).alias("ids"))
    return rows.select("doc_id", (F.size("ids") > 0).alias("some"), (pack.public_texts(path)(F.col("ids")) == F.col("text")).alias("same"))


# ---------------------------------------------------------------- loading

_N = "coalesce(list_sum(attention_mask), 0)::INT"


@_query(
    f"""SELECT sample_id, md5(array_to_string([input_ids[i] for i in range(1, least(n, len(input_ids)) + 1) if labels[i] = -100], ',')) AS prompt,
        md5(array_to_string([x for x in labels[1:n] if x <> -100], ',')) AS target FROM (SELECT *, CASE WHEN attention_mask IS NULL THEN len(input_ids)::INT ELSE {_N} END AS n FROM packed_sample)"""
)
def prompt_target_split(spark: SparkSession, root: str) -> DataFrame:
    i, y, m = F.col("input_ids"), F.col("labels"), F.col("attention_mask")
    return table(spark, root, "packed_sample").select("sample_id", _print(load.prompt_part(i, y, m)).alias("prompt"), _print(load.target_part(y, m)).alias("target"))


@_query(
    f"""SELECT sample_id, n_prompt, n_target, greatest(8, n_target + 16)::INT AS budget FROM (SELECT sample_id, written_at, len([1 for i in range(1, least(n, len(input_ids)) + 1) if labels[i] = -100])::INT AS n_prompt,
        len([x for x in labels[1:n] if x <> -100])::INT AS n_target FROM (SELECT *, CASE WHEN attention_mask IS NULL THEN len(input_ids)::INT ELSE {_N} END AS n FROM packed_sample))
        WHERE n_prompt > 0 ORDER BY sample_id, written_at LIMIT 150"""
)
def generation_select(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "packed_sample").withColumn("at", F.struct("sample_id", "written_at"))
    return load.generation_inputs(rows, "at", 16, 150).select("sample_id", F.size("prompt").alias("n_prompt"), F.size("target").alias("n_target"), "budget")


@_query("SELECT dataset, count(*) AS rows, count(*) FILTER (len([x for x in labels if x <> -100]) > 0) AS with_target FROM packed_sample GROUP BY 1")
def target_guard(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "packed_sample").groupBy("dataset").agg(F.count("*").alias("rows"), F.count_if(pack.has_target(F.col("labels"))).alias("with_target"))


@_query("SELECT sample_id, array_to_string(CASE WHEN list_position(input_ids, 198) > 0 THEN input_ids[1:list_position(input_ids, 198)] ELSE input_ids END, ',') AS ids FROM packed_sample")
def strip_eos(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "packed_sample").select("sample_id", _joined(load.up_to_end(F.col("input_ids"), 198)).alias("ids"))


@_query("SELECT sample_id, least(len(input_ids), 512)::INT AS n, md5(array_to_string(input_ids[1:512], ',')) AS ids FROM packed_sample WHERE len(input_ids) >= 2")
def load_trim(spark: SparkSession, root: str) -> DataFrame:
    rows = load.loadable(table(spark, root, "packed_sample"), 512)
    return rows.select("sample_id", F.size("input_ids").alias("n"), _print("input_ids").alias("ids"))


_FILLED = "[{1} for i in range(padded // n - len({0}))]"


@_query(
    f"""SELECT sample_id, batch::BIGINT AS batch, (padded // n)::INT AS padded_length, padded::BIGINT AS padded_tokens, md5(array_to_string(input_ids || {_FILLED.format("input_ids", 50256)}, ',')) AS ids,
        md5(array_to_string(labels || {_FILLED.format("labels", -100)}, ',')) AS labels, md5(array_to_string(m || {_FILLED.format("m", "0::TINYINT")}, ',')) AS mask FROM
       (SELECT *, coalesce(attention_mask, [1::TINYINT for x in input_ids]) AS m, count(*) OVER (PARTITION BY batch) AS n, count(*) OVER (PARTITION BY batch) * ((max(len(input_ids)) OVER (PARTITION BY batch) + 7) // 8 * 8) AS padded FROM
        (SELECT *, (row_number() OVER (ORDER BY sample_id, written_at) - 1) // 4 AS batch FROM packed_sample))"""
)
def collate_pad(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "packed_sample").select("sample_id", "written_at", "input_ids", "labels", "attention_mask")
    out = load.padded(rows.join(load.batches(rows, "sample_id", "written_at", rows=4), ["sample_id", "written_at"]), "batch", SPACE.pad_id())
    return out.select(
        "sample_id", "batch", "padded_length", F.col("padded_tokens").cast("bigint").alias("padded_tokens"), _print("input_ids").alias("ids"), _print("labels").alias("labels"), _print("attention_mask").alias("mask")
    )


@_query("SELECT sample_id, greatest(8, len([x for x in labels if x <> -100]) + 16)::INT AS budget FROM packed_sample")
def generation_budget(spark: SparkSession, root: str) -> DataFrame:
    target = F.filter("labels", lambda x: x != pack.IGNORE)
    return table(spark, root, "packed_sample").select("sample_id", load.generation_budget(target, 16).alias("budget"))


@_query("SELECT dataset, sample_id FROM (SELECT DISTINCT dataset, sample_id FROM packed_sample) QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY sample_id) <= 100")
def eval_concat_limit(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "packed_sample").select("dataset", "sample_id").distinct()
    return load.first_per(rows, "dataset", "sample_id", 100)


# ---------------------------------------------------------------- mixtures and schedules

_SPECS = "(VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE)" for n, a, b in MIX) + ") s(name, a, b)"


@_query(
    f"""SELECT event_id AS step, least(event_id // 2000, 3)::INT AS stage, name, round(raw / sum(raw) OVER (PARTITION BY event_id), 9) AS weight FROM
        (SELECT event_id, name, a + least(event_id // 2000, 3) / 3.0::DOUBLE * (b - a) AS raw FROM events, {_SPECS})"""
)
def curriculum_weights(spark: SparkSession, root: str) -> DataFrame:
    specs = spark.createDataFrame(list(MIX), "name string, start_weight double, end_weight double")
    out = schedule.weights_at(table(spark, root, "events").select(F.col("event_id").alias("step")), specs, 2000)
    return out.select("step", "stage", "name", F.round("weight", 9).alias("weight"))


def _bounds() -> list[float]:
    total, run, out = float(sum(a for _, a, _ in MIX)), 0.0, []
    for _, a, _ in MIX[:-1]:
        run += a / total
        out.append(run)
    return out


@_query(
    f"SELECT draw, CASE {' '.join(f'WHEN u < {b!r}::DOUBLE THEN {chr(39)}{MIX[i][0]}{chr(39)}' for i, b in enumerate(_bounds()))} ELSE '{MIX[-1][0]}' END AS dataset "
    f"FROM (SELECT range AS draw, {_FRACTION.format(chr(39) + '7-' + chr(39) + ' || range::VARCHAR')} AS u FROM range(20000))"
)
def mixture_draw(spark: SparkSession, root: str) -> DataFrame:
    return mixture.draws(spark, 20_000, {n: a for n, a, _ in MIX}, seed=7)


_PACKED_WEIGHTS = {"gigaspeech": 0.6, "commonvoice": 0.3, "covost2": 0.03, "spoken_squad": 0.02, "ultrachat_200k": 0.05}


def _pick_sql(weights: dict[str, float]) -> str:
    total, run, names, out = float(sum(weights.values())), 0.0, list(weights), ""
    for name in names[:-1]:
        run += weights[name] / total
        out += f"WHEN u < {run!r}::DOUBLE THEN '{name}' "
    return f"CASE {out}ELSE '{names[-1]}' END"


_DRAWN = f"(SELECT range AS draw, {_FRACTION.format(chr(39) + '7-' + chr(39) + ' || range::VARCHAR')} AS u FROM range(20000))"


@_query(
    f"""WITH own AS (SELECT dataset, sample_id, row_number() OVER (PARTITION BY dataset ORDER BY md5('7-' || sample_id), sample_id) - 1 AS place, count(*) OVER (PARTITION BY dataset) AS size FROM (SELECT DISTINCT dataset, sample_id FROM packed_sample)),
        nth AS (SELECT draw, dataset, row_number() OVER (PARTITION BY dataset ORDER BY draw) - 1 AS n FROM (SELECT draw, {_pick_sql(_PACKED_WEIGHTS)} AS dataset FROM {_DRAWN}))
        SELECT draw, nth.dataset AS dataset, n // size AS epoch, sample_id FROM nth JOIN own ON nth.dataset = own.dataset AND own.place = n % size"""
)
def mixture_rows(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "packed_sample").select("dataset", "sample_id").distinct()
    return mixture.mixed(mixture.draws(spark, 20_000, _PACKED_WEIGHTS, seed=7), rows, "sample_id", seed=7)


@_query(
    f"""WITH seqs AS (SELECT DISTINCT ON (sample_id) dataset, sample_id, input_ids[1:512] AS x, labels[1:512] AS y FROM packed_sample WHERE len(input_ids) >= 2),
        own AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5('7-' || sample_id), sample_id) - 1 AS place, count(*) OVER (PARTITION BY dataset) AS size FROM seqs),
        nth AS (SELECT draw, dataset, row_number() OVER (PARTITION BY dataset ORDER BY draw) - 1 AS n FROM (SELECT draw, {_pick_sql(_PACKED_WEIGHTS)} AS dataset FROM {_DRAWN} WHERE draw < 4000)),
        met AS (SELECT draw, draw // 4 AS batch, nth.dataset AS dataset, sample_id, x, y FROM nth JOIN own ON nth.dataset = own.dataset AND own.place = n % size),
        wide AS (SELECT *, ((max(len(x)) OVER (PARTITION BY batch) + 7) // 8 * 8)::INT AS padded_length FROM met)
        SELECT draw, batch, dataset, sample_id, padded_length, md5(array_to_string(x || [50256 for i in range(padded_length - len(x))], ',')) AS ids, md5(array_to_string(y || [-100 for i in range(padded_length - len(y))], ',')) AS labels FROM wide"""
)
def training_batches(spark: SparkSession, root: str) -> DataFrame:
    """Four thousand draws of a weighted mixture as padded batches of four."""
    seqs = table(spark, root, "packed_sample").select("dataset", "sample_id", "input_ids", "labels", "attention_mask").dropDuplicates(["sample_id"])
    out = pipeline.training_batches(seqs, _PACKED_WEIGHTS, 4000, 4, SPACE.pad_id(), seed=7, max_length=512)
    return out.select("draw", "batch", "dataset", "sample_id", "padded_length", _print("input_ids").alias("ids"), _print("labels").alias("labels"))


_MOVING = {n: (a, b) for n, a, b in MIX}
_STAGED = " ".join(f"WHEN {k} THEN {_pick_sql({n: a + k / 3 * (b - a) for n, (a, b) in _MOVING.items()})}" for k in range(4))


@_query(f"SELECT draw, draw // 4 AS step, stage, CASE stage {_STAGED} END AS dataset FROM (SELECT *, least(draw // 4 // 1000, 3)::INT AS stage FROM {_DRAWN})")
def mixture_curriculum(spark: SparkSession, root: str) -> DataFrame:
    return mixture.curriculum_draws(spark, 20_000, _MOVING, batch=4, every=1000, seed=7)


@_query("SELECT range::BIGINT AS shard FROM range(1000) WHERE range % 3 = 1 AND range // 3 % 4 = 2")
def shard_split(spark: SparkSession, root: str) -> DataFrame:
    return spark.range(1000).select(F.col("id").alias("shard")).filter(ids.shard_share(F.col("shard"), nodes=3, node=1, workers=4, worker=2))


@_query(f"SELECT range AS draw, least(floor({_FRACTION.format(chr(39) + '7-shard-' + chr(39) + ' || range::VARCHAR')} * 64), 63)::INT AS shard FROM range(5000)")
def shard_resampling(spark: SparkSession, root: str) -> DataFrame:
    return mixture.resampled_shards(spark, 64, 5000, seed=7)


@_query(
    """SELECT event_id AS step, round(CASE WHEN event_id < 3000 THEN event_id / 3000.0::DOUBLE ELSE 0.1 + 0.9 * (0.5 * (1 + cos(pi() * least(greatest((event_id - 3000) / 97000.0::DOUBLE, 0), 1)))) END, 9) AS factor FROM events"""
)
def lr_schedule(spark: SparkSession, root: str) -> DataFrame:
    s = F.col("event_id")
    return table(spark, root, "events").select(s.alias("step"), F.round(schedule.learning_rate(s, 100_000, 3000, 0.1), 9).alias("factor"))


@_query(
    """SELECT event_id, CASE WHEN s >= 86400 THEN printf('%dd %02dh %02dm %02ds', s // 86400, s // 3600 % 24, s // 60 % 60, s % 60) WHEN s >= 3600 THEN printf('%02dh %02dm %02ds', s // 3600, s // 60 % 60, s % 60)
       WHEN s >= 60 THEN printf('%02dm %02ds', s // 60, s % 60) ELSE printf('%ds', s) END AS duration FROM (SELECT event_id, trunc(value * 3600)::BIGINT AS s FROM events)"""
)
def format_duration(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select("event_id", schedule.duration_text(F.col("value") * 3600).alias("duration"))


# ---------------------------------------------------------------- evaluation


@_query(
    """SELECT sample_id, CASE WHEN t LIKE '%asr%' OR t LIKE '%transcribe%' THEN 'wer' WHEN (d LIKE '%commonvoice%' OR d LIKE '%gigaspeech%') AND d NOT LIKE '%tts%' THEN 'wer'
       WHEN t LIKE '%translate%' OR t LIKE '%translation%' OR t LIKE '%speech#_to#_text%' ESCAPE '#' THEN 'bleu' WHEN d LIKE '%covost%' THEN 'bleu' ELSE 'exact_match' END AS metric
       FROM (SELECT sample_id, lower(task) AS t, lower(dataset) AS d FROM raw_sample)"""
)
def metric_route(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "raw_sample").select("sample_id", metrics.route(F.col("task"), F.col("dataset")).alias("metric"))


@_query(f"SELECT id, CASE WHEN length({_squeeze('question')}) > 0 THEN ({_squeeze('answer_text')} = {_squeeze('question')})::INT::DOUBLE END AS value FROM spoken_squad_sample")
def metric_exact_match(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "spoken_squad_sample").select("id", metrics.exact_match(F.col("answer_text"), F.col("question")).alias("value"))


_WORDS = f"string_split({_squeeze('target_text')}, ' ')"
_SAID = f"[x for x in string_split({_spoken_sql('target_text')}, ' ') if x <> '']"
_CODE = "array_to_string([chr(40 + list_position(v, w)::INT) for w in {0}], '')"


@_query(
    f"""SELECT sample_id, round(CASE WHEN r[1] <> '' THEN levenshtein({_CODE.format('r')}, {_CODE.format('p')}) / len(r) END, 9) AS value FROM
        (SELECT sample_id, r, p, list_distinct(r || p) AS v FROM (SELECT sample_id, {_WORDS} AS r, {_SAID} AS p FROM raw_sample WHERE task = 'asr'))"""
)
def metric_wer(spark: SparkSession, root: str) -> DataFrame:
    t = F.col("target_text")
    rows = table(spark, root, "raw_sample").filter("task = 'asr'")
    return rows.select("sample_id", F.round(metrics.word_error_rate(text.spoken_text(t), t), 9).alias("value"))


def _tokens_sql(c: str) -> str:
    """The tokens BLEU counts in a text."""
    for tag, mark in (("<skipped>", ""), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = f"replace({c}, '{tag}', '{mark}')"
    c = f"regexp_replace(' ' || {c} || ' ', '([\\{{-~\\[-` -&\\(-\\+:-@/])', ' \\1 ', 'g')"
    c = f"regexp_replace(regexp_replace({c}, '([^0-9])([\\.,])', '\\1 \\2 ', 'g'), '([\\.,])([^0-9])', ' \\1 \\2', 'g')"
    return f"[x for x in string_split_regex(regexp_replace({c}, '([0-9])(-)', '\\1 \\2 ', 'g'), '\\s+') if x <> '']"


def _grams_sql(c: str, n: int) -> str:
    return f"[array_to_string({c}[i:i + {n - 1}], chr(1)) for i in range(1, len({c}) - {n - 2})]"


def _hits_sql(n: int) -> str:
    """How many n-grams of the prediction the reference holds, none more often than it does."""
    return f"coalesce(list_sum([least(len([1 for y in p{n} if y = g]), len([1 for y in r{n} if y = g])) for g in list_distinct(p{n})]), 0)::INT AS h{n}"


_MISSED = [" + ".join(f"(h{k} = 0)::INT" for k in range(1, n + 1)) for n in range(1, 5)]
_LOGS = " + ".join(f"ln(CASE WHEN h{n} > 0 THEN h{n}::DOUBLE / len(p{n}) ELSE 1.0::DOUBLE / (2 ** ({_MISSED[n - 1]}) * len(p{n})) END)" for n in range(1, 5))


@_query(
    f"""SELECT sample_id, round(CASE WHEN r <> '' THEN CASE WHEN len(pt) < 4 OR h1 + h2 + h3 + h4 = 0 THEN 0.0::DOUBLE ELSE 100 * CASE WHEN len(pt) >= len(rt) THEN 1.0::DOUBLE ELSE exp(1 - len(rt)::DOUBLE / len(pt)) END * exp(({_LOGS}) / 4) END END, 6) AS value FROM
        (SELECT *, {", ".join(_hits_sql(n) for n in range(1, 5))} FROM (SELECT *, {", ".join(f"{_grams_sql(c + 't', n)} AS {c}{n}" for c in "pr" for n in range(1, 5))} FROM
        (SELECT sample_id, r, {_tokens_sql("p")} AS pt, {_tokens_sql("r")} AS rt FROM
        (SELECT sample_id, {_squeeze('target_text')} AS r, {_squeeze(_spoken_sql('target_text'))} AS p FROM raw_sample WHERE task = 'speech_to_text_translation'))))"""
)
def metric_bleu(spark: SparkSession, root: str) -> DataFrame:
    t = F.col("target_text")
    rows = table(spark, root, "raw_sample").filter("task = 'speech_to_text_translation'")
    return rows.select("sample_id", F.round(metrics.sentence_bleu(text.spoken_text(t), t), 6).alias("value"))


def _predictions(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "raw_sample")
    said = F.when(F.col("task") == "asr", text.spoken_text(F.col("target_text"))).otherwise(F.coalesce("target_text", F.lit("")))
    return rows.select("dataset", "task", "target_text", said.alias("pred_text"), (F.col("task") == "tts").alias("target_has_speech"), F.col("client_id").isNotNull().alias("pred_has_speech"))


# predictions of other tasks than asr repeat the reference, so that their BLEU is 100, or 0 below four tokens
@_query(
    f"""SELECT CASE WHEN grouping(dataset) = 1 THEN 'ALL_DATASETS' ELSE dataset END AS dataset, count(*) AS num_samples, array_to_string(list_sort(list(DISTINCT task)), ',') AS tasks,
        round(avg(wer), 9) AS wer_mean, round(avg(bleu), 6) AS bleu_mean, round(avg(em), 9) AS exact_match_mean, round(avg(same), 9) AS text_exact_match_mean,
        nullif(count(wer), 0)::DOUBLE AS wer_num_samples, nullif(count(bleu), 0)::DOUBLE AS bleu_num_samples, nullif(count(em), 0)::DOUBLE AS exact_match_num_samples,
        round(avg(CASE WHEN task <> 'tts' THEN (length(p) > 0)::INT END), 9) AS nonempty_pred_text_rate, round(avg(CASE WHEN task = 'tts' THEN (client_id IS NOT NULL)::INT END), 9) AS speech_pred_present_rate
        FROM (SELECT *, CASE WHEN task = 'asr' AND r <> '' THEN levenshtein({_CODE.format("rw")}, {_CODE.format("pw")}) / len(rw) END AS wer, CASE WHEN task = 'speech_to_text_translation' AND r <> '' THEN CASE WHEN len({_tokens_sql("r")}) >= 4 THEN 100.0::DOUBLE ELSE 0 END END AS bleu,
              CASE WHEN task IN ('spoken_extract_qa', 'text_dialog_sft') AND r <> '' THEN 1.0::DOUBLE END AS em, CASE WHEN task <> 'tts' THEN (p = r)::INT END AS same
              FROM (SELECT *, list_distinct(rw || pw) AS v FROM (SELECT *, string_split(r, ' ') AS rw, [x for x in string_split(p, ' ') if x <> ''] AS pw FROM
                    (SELECT dataset, task, client_id, {_squeeze('target_text')} AS r, CASE WHEN task = 'asr' THEN {_spoken_sql('target_text')} ELSE {_squeeze('target_text')} END AS p FROM raw_sample))))
        GROUP BY GROUPING SETS ((dataset), ())"""
)
def eval_report(spark: SparkSession, root: str) -> DataFrame:
    s = evaluate.summary(evaluate.measured(_predictions(spark, root)))
    real = lambda c: F.col(c).cast("double").alias(c)
    r = lambda c, n=9: F.round(c, n).alias(c)
    return s.select(
        "dataset", "num_samples", F.array_join("tasks", ",").alias("tasks"), r("wer_mean"), r("bleu_mean", 6), r("exact_match_mean"), r("text_exact_match_mean"), real("wer_num_samples"), real("bleu_num_samples"),
        real("exact_match_num_samples"), r("nonempty_pred_text_rate"), r("speech_pred_present_rate"),
    )


@_query(
    f"""SELECT CASE WHEN grouping(dataset) = 1 THEN 'ALL_DATASETS' ELSE dataset END AS dataset, count(*) AS num_samples, count(*) FILTER (NOT speech) AS num_text_target_samples, count(*) FILTER (speech) AS num_speech_target_samples,
        array_to_string(list_sort(list(DISTINCT task)), ',') AS tasks, round(avg(v) FILTER (NOT speech AND m = 'wer'), 9) AS wer_mean, nullif(count(v) FILTER (NOT speech AND m = 'wer'), 0)::DOUBLE AS wer_num_samples,
        round(avg(v) FILTER (NOT speech AND m = 'bleu'), 9) AS bleu_mean, round(avg(v) FILTER (NOT speech AND m = 'exact_match'), 9) AS exact_match_mean,
        CASE WHEN count(*) FILTER (NOT speech) > 0 THEN count(*) FILTER (NOT speech AND length({_squeeze('target_text')}) > 0) END::DOUBLE AS nonempty_pred_text_count,
        CASE WHEN count(*) FILTER (speech) > 0 THEN count(*) FILTER (speech AND client_id IS NOT NULL) END::DOUBLE AS speech_pred_present_count
        FROM (SELECT *, task = 'tts' AS speech, length(coalesce(target_text, '')) / 100.0::DOUBLE AS v, CASE WHEN task = 'asr' THEN 'wer' WHEN task = 'speech_to_text_translation' THEN 'bleu' ELSE 'exact_match' END AS m FROM raw_sample)
        GROUP BY GROUPING SETS ((dataset), ())"""
)
def eval_summary(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "raw_sample")
    t = F.col("task")
    m = rows.select(
        "dataset", "task", "target_text", F.col("target_text").alias("pred_text"), (t == "tts").alias("target_has_speech"), F.col("client_id").isNotNull().alias("pred_has_speech"),
        F.when(t == "asr", "wer").when(t == "speech_to_text_translation", "bleu").otherwise("exact_match").alias("metric_name"),
        (F.length(F.coalesce("target_text", F.lit(""))) / 100.0).alias("metric_value"), F.lit(None).cast("double").alias("text_exact_match"),
    )
    s = evaluate.summary(m)
    r9 = lambda c: F.round(c, 9).alias(c)
    real = lambda c: F.col(c).cast("double").alias(c)
    return s.select(
        "dataset", "num_samples", "num_text_target_samples", "num_speech_target_samples", F.array_join("tasks", ",").alias("tasks"), r9("wer_mean"), real("wer_num_samples"), r9("bleu_mean"), r9("exact_match_mean"),
        real("nonempty_pred_text_count"), real("speech_pred_present_count"),
    )


@_query(
    """SELECT CASE WHEN grouping(event_type) = 1 THEN 'overall' ELSE event_type END AS dataset, round(avg(value / 100), 9) AS loss, round(exp(avg(value / 100)), 6) AS perplexity, count(value) AS batches FROM events
       WHERE event_id < 5000 GROUP BY GROUPING SETS ((event_type), ())"""
)
def val_loss_summary(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events")
    out = evaluate.validation_loss(e.select(F.col("event_type").alias("dataset"), F.col("event_id").alias("batch"), (F.col("value") / 100).alias("loss")), e.select(F.col("event_type").alias("dataset")).distinct(), 5000)
    return out.select("dataset", F.round("loss", 9).alias("loss"), F.round("perplexity", 6).alias("perplexity"), "batches")


@_query(
    """SELECT event_id AS step, event_type AS run, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS 49 PRECEDING), 9) AS rolling_sec,
       round(sum(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS elapsed_sec,
       round(greatest(20000 - event_id - 1, 0) * avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS 49 PRECEDING), 7) AS eta_sec FROM events"""
)
def train_log_windows(spark: SparkSession, root: str) -> DataFrame:
    log = table(spark, root, "events").select(F.col("event_id").alias("step"), F.col("event_type").alias("run"), F.col("value").alias("step_sec"))
    out = trainlog.timed(log, 20_000, "run")
    return out.select("step", "run", F.round("rolling_sec", 9).alias("rolling_sec"), F.round("elapsed_sec", 6).alias("elapsed_sec"), F.round("eta_sec", 7).alias("eta_sec"))


@_query(
    """SELECT run, step, stage::INT AS stage, b::INT AS before FROM (SELECT *, lag(stage) OVER (PARTITION BY run ORDER BY step) AS b FROM (SELECT event_type AS run, event_id AS step, least(event_id // 1000, 3) AS stage FROM events)) WHERE b <> stage"""
)
def curriculum_changes(spark: SparkSession, root: str) -> DataFrame:
    log = table(spark, root, "events").select(F.col("event_id").alias("step"), F.col("event_type").alias("run"))
    return trainlog.stage_changes(log, 1000, "run")


@_query("SELECT event_id AS step, round(value, 6) AS loss, round(exp(value / 100), 6) AS perplexity FROM events WHERE event_id % 100 = 0")
def log_every_n(spark: SparkSession, root: str) -> DataFrame:
    log = table(spark, root, "events").select(F.col("event_id").alias("step"), F.col("value").alias("loss"))
    return trainlog.every_nth(log, 100).select("step", F.round("loss", 6).alias("loss"), F.round(schedule.perplexity(F.col("loss") / 100), 6).alias("perplexity"))


@_query("SELECT step, round(sum(value) / 4, 6) AS loss FROM (SELECT event_id // 4 AS step, value FROM events) GROUP BY 1")
def loss_accumulation(spark: SparkSession, root: str) -> DataFrame:
    micro = table(spark, root, "events").select(F.floor(F.col("event_id") / 4).alias("step"), F.col("value").alias("loss"))
    return evaluate.loss_per_step(micro, 4).select("step", F.round("loss", 6).alias("loss"))


@_query(
    """SELECT d::INT AS dim, round(avg(x), 9) AS mean, round(stddev_samp(x), 9) AS std FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings) GROUP BY 1"""
)
def embedding_init_stats(spark: SparkSession, root: str) -> DataFrame:
    return embeddings.column_stats(table(spark, root, "embeddings"), "embedding").select("dim", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@_query(
    f"""SELECT row::BIGINT AS row, d::INT AS dim, round(mean + sqrt(-2 * ln(greatest(u, 1e-12::DOUBLE))) * cos(2 * pi() * w) * greatest(std, 1e-6::DOUBLE) * 0.5, 6) AS value FROM
        (SELECT range + 500 AS row, d, mean, std, {_FRACTION.format("'3-a-' || (range + 500)::VARCHAR || '-' || d::VARCHAR")} AS u, {_FRACTION.format("'3-b-' || (range + 500)::VARCHAR || '-' || d::VARCHAR")} AS w FROM range(40),
         (SELECT d, avg(x) AS mean, stddev_samp(x) AS std FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings) GROUP BY 1))"""
)
def embedding_new_rows(spark: SparkSession, root: str) -> DataFrame:
    stats = embeddings.column_stats(table(spark, root, "embeddings"), "embedding")
    return embeddings.new_rows(spark, stats, 500, 40, 0.5, 3).select("row", "dim", F.round("value", 6).alias("value"))


# ---------------------------------------------------------------- checks


@_query("SELECT 2 AS config, 'num_codebooks' AS key FROM tokenizer_config UNION ALL SELECT 3, 'extra_special_ids' FROM tokenizer_config UNION ALL SELECT 3, 'base_model' FROM tokenizer_config")
def config_equality(spark: SparkSession, root: str) -> DataFrame:
    one = table(spark, root, "tokenizer_config")
    more = F.map_concat("extra_special_ids", F.create_map(F.lit("<new>"), F.lit(1)))
    rows = one.withColumn("config", F.lit(0)).unionByName(one.withColumn("config", F.lit(1))).unionByName(one.withColumns({"config": F.lit(2), "num_codebooks": F.lit(8)}))
    rows = rows.unionByName(one.withColumns({"config": F.lit(3), "extra_special_ids": more, "base_model": F.lit(None).cast("string")}))
    return checks.differing_keys(rows, "config", list(checks.CONFIG_KEYS))


@_query("SELECT source, min(doc_id) AS first FROM documents GROUP BY 1")
def distinct_sources(spark: SparkSession, root: str) -> DataFrame:
    return checks.distinct_in_order(table(spark, root, "documents"), "source", "doc_id")


@_query("SELECT source, count(*) AS rows FROM documents WHERE source IS NULL OR source NOT IN (SELECT source FROM mix_target) GROUP BY 1")
def unknown_sources(spark: SparkSession, root: str) -> DataFrame:
    names = [r["source"] for r in table(spark, root, "mix_target").select("source").collect()]  # thirteen rows
    return checks.unknown_names(table(spark, root, "documents"), names, "source")


@_query("SELECT batch, count(DISTINCT dataset) AS datasets FROM (SELECT dataset, (row_number() OVER (ORDER BY sample_id, written_at) - 1) // 4 AS batch FROM packed_sample) GROUP BY 1 HAVING count(DISTINCT dataset) > 1")
def batch_homogeneity(spark: SparkSession, root: str) -> DataFrame:
    rows = ids.with_ordinal(table(spark, root, "packed_sample").select("dataset", "sample_id", "written_at"), "sample_id", "written_at")
    return checks.mixed_batches(rows.withColumn("batch", F.floor(F.col("ordinal") / 4)), "batch")


@_query("SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 1 OFFSET 42")
def inspect_nth(spark: SparkSession, root: str) -> DataFrame:
    return checks.nth_sample(table(spark, root, "documents").select("doc_id", "text"), "doc_id", 42)


_OUTCOME = f"""CASE WHEN {_strip('text')} IN ('<SIL>', '<MUSIC>', '<NOISE>', '<OTHER>') THEN 'garbage' WHEN {_spoken_sql('text')} = '' THEN 'empty_text'
    WHEN NOT coalesce(duration_sec BETWEEN 0.2 AND 120.0, false) THEN 'bad_duration' ELSE 'written' END"""


def _outcomes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    docs = stream.transcripts(spark, path, schema)
    return stream.with_outcomes(docs.withColumn("key", F.col("doc_id").cast("string")), "text", "duration_sec", "key")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in df.schema)


@_query(f"SELECT {_OUTCOME} AS disposition, count(*) AS rows FROM documents GROUP BY 1")
def stream_dispositions(spark: SparkSession, root: str) -> DataFrame:
    rows = _outcomes(spark, f"{root}/documents.parquet", _schema(table(spark, root, "documents")))
    name, base = f"outcomes_{uuid.uuid4().hex}", scratch(spark, "stream")
    stream.count_outcomes(rows, name, base).awaitTermination()
    return spark.table(name)


@_query(f"SELECT doc_id FROM documents WHERE {_OUTCOME} = 'written'")
def stream_resumed(spark: SparkSession, root: str) -> DataFrame:
    """A stream that ends, is started again from its checkpoint when more files have come, and writes each row once."""
    docs, base = table(spark, root, "documents").select("doc_id", "text", "duration_sec"), scratch(spark, "resumed")
    for k in (0, 1):
        docs.filter(F.col("doc_id") % 2 == k).write.mode("append").parquet(f"{base}/in")
        stream.write_written(_outcomes(spark, f"{base}/in", _schema(docs)), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("doc_id")
