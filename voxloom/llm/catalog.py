"""The queries of this subpackage, by problem, over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import abuse, bpe, mixing, overlap, packing, pairs, splitting
from voxloom.runtime import table


def _limit(spark: SparkSession, root: str, item: str) -> tuple[int, int]:
    """The row of an item table in size_limit, a list of three rows."""
    row = table(spark, root, "size_limit").filter(F.col("item_table") == item).first()
    if row is None:
        raise ValueError(f"size_limit has no row for {item}")
    return row["max_size"], row["overlap"]


def _split_packed(spark: SparkSession, root: str, with_ids: bool) -> DataFrame:
    limit, overlap = _limit(spark, root, "packed_sample")
    cfg = table(spark, root, "tokenizer_config").first()
    ends: dict[str, list[int]] = {}
    for r in table(spark, root, "boundary_token").collect():  # eight rows, fixed
        ends.setdefault(r["boundary"], []).append(r["token_id"])
    return splitting.split_packed(
        table(spark, root, "packed_sample"), limit, overlap, ends,
        cfg["speech_offset"], cfg["speech_codebook_size"], cfg["num_codebooks"], with_ids=with_ids,
    )


def _split_passages(spark: SparkSession, root: str) -> DataFrame:
    limit, overlap = _limit(spark, root, "spoken_squad_sample")
    return splitting.split_passages(table(spark, root, "spoken_squad_sample"), table(spark, root, "wav_index"), limit, overlap)


def p1_defects(spark: SparkSession, root: str) -> DataFrame:
    """Defective pairs with every defect, in the order in which they count."""
    spoken, chats = table(spark, root, "spoken_squad_sample"), table(spark, root, "ultrachat_sample")
    both = pairs.question_pairs(spoken).unionByName(pairs.chat_pairs(chats))
    return pairs.defects(both, pairs.phrase_ends(spoken, "context_text"))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Defective pairs with the defect that counts."""
    return p1_defects(spark, root).select("dataset", "id", "turn", F.col("defects")[0].alias("defect"))


def _split_texts(spark: SparkSession, root: str) -> DataFrame:
    raw = table(spark, root, "raw_sample").filter(F.col("task").isin("asr", "speech_to_text_translation"))
    raw = raw.select(F.lit("target_text").alias("field"), overlap.side(F.col("split")).alias("side"), F.col("sample_id").alias("id"), F.col("target_text").alias("text"))
    co = table(spark, root, "covost2_sample")
    co = co.select(F.lit("source_text").alias("field"), overlap.side(F.col("split")).alias("side"), "id", F.col("source_text").alias("text"))
    return raw.unionByName(co).filter(F.col("side").isNotNull() & F.col("text").isNotNull())


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of a training and an evaluation row with the same or nearly the same text."""
    pairs = overlap.cross_split_copies(_split_texts(spark, root))
    return pairs.select("field", F.least("id_eval", "id_train").alias("id_a"), F.greatest("id_eval", "id_train").alias("id_b"))


def _eval_rows(spark: SparkSession, root: str) -> DataFrame:
    """field, id_eval, dataset and plain split of the evaluation rows that p2_found compares, each once."""
    raw = table(spark, root, "raw_sample").filter(F.col("task").isin("asr", "speech_to_text_translation"))
    raw = raw.select(F.lit("target_text").alias("field"), F.col("sample_id").alias("id_eval"), "dataset", "split", F.col("target_text").alias("text"))
    co = table(spark, root, "covost2_sample").select(F.lit("source_text").alias("field"), F.col("id").alias("id_eval"), "dataset", "split", F.col("source_text").alias("text"))
    rows = raw.unionByName(co).filter((overlap.side(F.col("split")) == "e") & (F.size(F.split(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), " ")) >= 8))
    return rows.withColumn("split", F.lower(F.trim("split"))).drop("text").distinct()


def p2_records(spark: SparkSession, root: str) -> DataFrame:
    """Every evaluation row with a copy in training: its split and dataset, how many copies, the highest coverage."""
    return _eval_rows(spark, root).join(overlap.Copies(_split_texts(spark, root)).records(), ["field", "id_eval"])


def p2_report(spark: SparkSession, root: str) -> DataFrame:
    """Compared evaluation rows, rows with a copy in training, copies and mean coverage, by field, split and dataset."""
    both = _eval_rows(spark, root).join(overlap.Copies(_split_texts(spark, root)).records(), ["field", "id_eval"], "left")
    return both.groupBy("field", "split", "dataset").agg(
        F.count("*").alias("rows"), F.count("copies").alias("rows_with_copy"), F.coalesce(F.sum("copies"), F.lit(0)).alias("pairs"), F.avg("coverage").alias("mean_coverage")
    )


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Items above their limit and how they are cut."""
    a = _split_packed(spark, root, False).select(F.lit("packed_sample").alias("item_table"), "item_id", "cut").distinct()
    return a.unionByName(_split_passages(spark, root).select(F.lit("spoken_squad_sample").alias("item_table"), "item_id", "cut"))


def p3_packed_pieces(spark: SparkSession, root: str) -> DataFrame:
    """The pieces of oversized packed samples, with their ids."""
    rows = _split_packed(spark, root, True).select("item_id", "size", "cut", F.posexplode("pieces").alias("piece", "p"), "ids")
    rows = rows.select("item_id", "size", "cut", "piece", "p.*", F.slice("ids", F.col("p.start") + 1, F.col("p.stop") - F.col("p.start")).alias("input_ids"))
    return rows.dropDuplicates(["item_id", "piece"])


def p3_passage_pieces(spark: SparkSession, root: str) -> DataFrame:
    """The pieces of oversized passages, in frames of the passage."""
    rows = _split_passages(spark, root).select("item_id", "size", "cut", F.posexplode("pieces").alias("piece", "p"))
    return rows.select("item_id", "size", "cut", "piece", "p.*")


def p4_containers(spark: SparkSession, root: str) -> DataFrame:
    """Containers of packed samples with their ids."""
    return packing.containers(table(spark, root, "packed_sample"), _limit(spark, root, "container")[0])


def p4_fill(spark: SparkSession, root: str) -> DataFrame:
    """How full the containers are."""
    capacity, _ = _limit(spark, root, "container")
    return packing.fill_report(packing.assign(table(spark, root, "packed_sample"), capacity), capacity)


#: Data sets of recordings, which p4_apart keeps apart from written chats.
SPOKEN = ("gigaspeech", "commonvoice", "covost2", "spoken_squad")


def p4_apart(spark: SparkSession, root: str) -> DataFrame:
    """How full the containers are where none holds both a written chat and a recording."""
    capacity, _ = _limit(spark, root, "container")
    apart = {"ultrachat_200k": list(SPOKEN)} | {s: ["ultrachat_200k"] for s in SPOKEN}
    where = packing.assign(table(spark, root, "packed_sample"), capacity, apart=apart)
    mixed = where.groupBy("container").agg(F.bool_or(F.col("source") == "ultrachat_200k").alias("w"), F.bool_or(F.col("source").isin(*SPOKEN)).alias("s"))
    return packing.fill_report(where, capacity).crossJoin(mixed.agg(F.count_if(F.col("w") & F.col("s")).alias("conflicts")))


def p5_ids(spark: SparkSession, root: str) -> DataFrame:
    """The ids of every document."""
    return bpe.encode_corpus(table(spark, root, "documents"))


def p6_mixture(spark: SparkSession, root: str) -> DataFrame:
    """The mixture to the shares of mix_target."""
    return mixing.mixture(table(spark, root, "documents"), table(spark, root, "mix_target"))


def p6_shares(spark: SparkSession, root: str) -> DataFrame:
    """The shares the mixture reaches."""
    return mixing.shares(table(spark, root, "documents"), table(spark, root, "mix_target"))


def _abuse_scores(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return abuse.scored(docs, abuse.train(docs, table(spark, root, "labels")))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents with an abusive, hateful or sexual passage."""
    return _abuse_scores(spark, root).filter(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p7_scores(spark: SparkSession, root: str) -> DataFrame:
    """The score of every document."""
    return _abuse_scores(spark, root)


def p7_rates(spark: SparkSession, root: str) -> DataFrame:
    """Rates of such documents by source."""
    return abuse.rates(_abuse_scores(spark, root))


QUERIES = {
    "p1_found": p1_found,
    "p1_defects": p1_defects,
    "p2_found": p2_found,
    "p2_records": p2_records,
    "p2_report": p2_report,
    "p3_found": p3_found,
    "p3_packed_pieces": p3_packed_pieces,
    "p3_passage_pieces": p3_passage_pieces,
    "p4_containers": p4_containers,
    "p4_fill": p4_fill,
    "p4_apart": p4_apart,
    "p5_ids": p5_ids,
    "p6_mixture": p6_mixture,
    "p6_shares": p6_shares,
    "p7_found": p7_found,
    "p7_scores": p7_scores,
    "p7_rates": p7_rates,
}

ORACLES: dict[str, str] = {
    "p3_found": """
WITH real AS (SELECT DISTINCT sample_id, CASE WHEN attention_mask IS NULL THEN input_ids ELSE [input_ids[i] for i in range(1, len(input_ids) + 1) if attention_mask[i] = 1] END AS ids FROM packed_sample),
big AS (SELECT sample_id, ids, max_size FROM real, size_limit WHERE item_table = 'packed_sample' AND len(ids) > max_size),
each AS (SELECT sample_id, max_size, unnest(ids) AS x, generate_subscripts(ids, 1) AS i, len(ids) AS n FROM big),
two AS (SELECT *, lead(x) OVER (PARTITION BY sample_id ORDER BY i) AS y FROM each),
kinds AS (SELECT two.*, x >= speech_offset AND x < full_vocab_size AS sx, y >= speech_offset AND y < full_vocab_size AS sy, y - speech_offset < speech_codebook_size AS first FROM two, tokenizer_config WHERE y IS NOT NULL),
cuts AS (SELECT sample_id, max_size, i AS c FROM kinds WHERE x IN (SELECT token_id FROM boundary_token) OR sx <> sy OR (sx AND sy AND first)
    UNION ALL SELECT DISTINCT sample_id, max_size, 0 FROM each UNION ALL SELECT DISTINCT sample_id, max_size, n FROM each),
gaps AS (SELECT sample_id, lead(c) OVER (PARTITION BY sample_id ORDER BY c) - c > max_size AS wide FROM cuts),
files AS (SELECT id, unnest(audio_files) AS f FROM (SELECT DISTINCT id, audio_files FROM spoken_squad_sample)),
frames AS (SELECT id, sum(num_frames) AS size, max(num_frames) AS longest FROM files JOIN wav_index ON stem || '.wav' = f GROUP BY 1)
SELECT 'packed_sample' AS item_table, sample_id AS item_id, CASE WHEN bool_or(wide) THEN 'forced' ELSE 'natural' END AS cut FROM gaps GROUP BY sample_id
UNION ALL SELECT 'spoken_squad_sample', id, CASE WHEN longest > max_size THEN 'forced' ELSE 'natural' END FROM frames, size_limit WHERE item_table = 'spoken_squad_sample' AND size > max_size""",
}
