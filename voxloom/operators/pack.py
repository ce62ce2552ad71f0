"""Raw samples to token sequences: templates, ids, truncation, labels and masks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.speech import IdSpace, speech_ids
from voxloom.operators.chat import ChatTemplate

IGNORE = -100

# What the system says for each task.
SYSTEM = {
    "asr": "<text> Transcribe the speech into text.",
    "tts": "<text> Synthesize speech for the given text.",
    "speech_to_text_translation": "<text> Translate the speech from English to German in text.",
    "spoken_extract_qa": "<text> Answer the question using the spoken passage.",
}
_EMPTY = "array<int>"


def public_texts(path: str) -> Callable[[Column], Column]:
    """Ids back to a text by a `tokenizers` file, in Arrow batches; special ids are left out, null stays null."""
    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        got = iter(_tokenizer(path).decode_batch([[int(i) for i in x] for x in ids if x is not None], skip_special_tokens=True))
        return pd.Series([None if x is None else next(got) for x in ids])

    return decode


def hashed_words(c: Column, size: int) -> Column:
    """A stand-in tokenizer: each word between white space by its MD5, below `size`. The same in every engine."""
    words = F.filter(F.split(c, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")
    return F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("bigint") % size).cast("int"))


def utf8_bytes(c: Column) -> Column:
    """A stand-in tokenizer without loss: the bytes of a text."""
    pairs = F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit("[0-9A-F]{2}"), F.lit(0))
    return F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("int"))


def utf8_text(ids: Column) -> Column:
    """The text of bytes; empty for none."""
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i), 2, "0")), "")), "UTF-8")


@lru_cache(maxsize=4)
def _tokenizer(path: str):  # noqa: ANN202
    """A public tokenizer from its file, once for each Python worker."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def public_tokenizer(path: str) -> Callable[[Column], Column]:
    """A text to ids by a `tokenizers` file, in Arrow batches; null stays null. Special strings are ordinary text."""
    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        got = iter(_tokenizer(path).encode_batch([x for x in texts if x is not None], add_special_tokens=False))
        return pd.Series([None if x is None else next(got).ids for x in texts])

    return encode


@dataclass(frozen=True)
class Packer:
    """Builds sequences of at most `max_length` ids in one id space."""

    space: IdSpace
    tokenize: Callable[[Column], Column]
    eos: int
    max_length: int = 32000
    template: ChatTemplate = ChatTemplate()

    def _text(self, s: str | Column) -> Column:
        return self.tokenize(F.lit(s) if isinstance(s, str) else s)

    def _need(self, c: Column, name: str, task: str) -> Column:
        return F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"{task} needs {name}")))

    def parts(self, task: str) -> tuple[Column, Column, Column]:
        """(prefix kept whole, suffix whose end is kept, target) for rows of a task.

        Each piece is tokenised on its own: tokens do not run over the borders.
        """
        end = F.array(F.lit(self.eos))
        if task == "text_dialog_sft":
            suffix = self._need(F.col("input_text_token"), "input_text_token", task)
            return F.array().cast(_EMPTY), suffix, F.concat(self._need(F.col("target_text_token"), "target_text_token", task), end)
        opening = self._text(self.template.opening())
        if task == "tts":
            text = self._need(F.col("input_text"), "input_text", task)
            prefix = self._text(self.template.prefix(SYSTEM[task], F.concat(F.lit("<text> "), text)))
            speech = speech_ids(self._need(F.col("target_speech"), "target_speech", task), self.space)
            return prefix, opening, F.concat(self._text("<speech> "), speech, end)
        before, after = self.template.wrapper(SYSTEM[task])
        suffix = [speech_ids(self._need(F.col("input_speech"), "input_speech", task), self.space)]
        if task == "spoken_extract_qa":
            suffix.append(self._text(F.concat(F.lit("<text> "), self._need(F.col("question_text"), "question_text", task))))
        target = F.concat(self._text("<text> "), self._text(self._need(F.col("target_text"), "target_text", task)), end)
        return F.concat(self._text(before), self._text("<speech> ")), F.concat(*suffix, self._text(after), opening), target

    def pack(self, samples: DataFrame, on_error: str = "raise") -> DataFrame:
        """sample_id, dataset, split, task, input_ids, labels, attention_mask, n_tokens, n_target_tokens.

        Too long sequences lose the beginning of their suffix. A null field the task needs, an unknown task, a prefix
        and target that do not fit together, and a target without any id to learn raise an error, or with on_error='quarantine' put the reason
        in `error` and leave the sequence null. One narrow stage.
        """
        known = [*SYSTEM, "text_dialog_sft"]
        needs = {
            "asr": ("input_speech", "target_text"), "tts": ("input_text", "target_speech"), "speech_to_text_translation": ("input_speech", "target_text"),
            "spoken_extract_qa": ("input_speech", "question_text", "target_text"), "text_dialog_sft": ("input_text_token", "target_text_token"),
        }
        lacks = F.when(~F.coalesce(F.col("task").isin(*known), F.lit(False)), F.concat(F.lit("unknown task "), F.coalesce("task", F.lit("null"))))
        for t, fields in needs.items():
            for f in fields:
                lacks = lacks.when((F.col("task") == t) & F.col(f).isNull(), f"{t} needs {f}")
        rows = samples.withColumn("__e", lacks)
        ok = F.col("__e").isNull()
        pieces = {t: self.parts(t) for t in known}

        def by_task(i: int) -> Column:
            c = None
            for t in known:
                here = ok & (F.col("task") == t)
                c = F.when(here, pieces[t][i]) if c is None else c.when(here, pieces[t][i])
            return c

        rows = rows.withColumns({"__p": by_task(0), "__s": by_task(1), "__t": by_task(2)})
        n = lambda c: F.size(c)
        long = n("__p") + n("__s") + n("__t") > self.max_length
        full = long & ((n("__p") >= self.max_length) | (n("__p") + n("__t") > self.max_length))
        error = F.coalesce(F.col("__e"), F.when(full, "prefix and target exceed the length"), F.when(~has_target(F.col("__t")), "no target id remains"))
        left = F.greatest(F.lit(self.max_length) - n("__p") - n("__t"), F.lit(0))
        suffix = F.when(long, F.slice("__s", F.greatest(n("__s") - left, F.lit(0)) + 1, left)).otherwise(F.col("__s"))
        rows = rows.withColumn("error", error).withColumn("__s", suffix)
        if on_error == "raise":
            rows = rows.withColumn("__p", F.when(F.col("error").isNull(), F.col("__p")).otherwise(F.raise_error("error")))
        good = F.col("error").isNull()
        prompt = F.concat("__p", "__s")
        out = rows.select(
            "sample_id", "dataset", "split", "task",
            F.when(good, F.concat(prompt, "__t")).alias("input_ids"),
            F.when(good, F.concat(F.array_repeat(F.lit(IGNORE), n(prompt)), "__t")).alias("labels"),
            "error",
        )
        out = out.withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1).cast("tinyint")))
        out = out.withColumns({"n_tokens": F.size("input_ids"), "n_target_tokens": F.size(F.filter("labels", lambda x: x != IGNORE))})
        return out if on_error != "raise" else out.drop("error")


def dispatch(df: DataFrame, meta: Column) -> DataFrame:
    """Raw shard rows (key, meta JSON, input_tokens, target_tokens) to the fields of their task.

    The transcript is `text` if the key is there, even with null, else `text_tn`. The id falls back from id to
    sample_id to the key to 'unknown', the split to 'unknown'.
    """
    m = F.try_parse_json(meta)
    get = lambda k, t="string": F.try_variant_get(m, f"$.{k}", t)
    keys = F.json_object_keys(meta)
    text = F.when(F.array_contains(keys, "text"), get("text")).otherwise(get("text_tn"))
    task = get("task")
    return df.select(
        F.coalesce(get("id"), get("sample_id"), F.col("key"), F.lit("unknown")).alias("sample_id"),
        F.coalesce(get("dataset"), F.lit("unknown")).alias("dataset"), F.coalesce(get("split"), F.lit("unknown")).alias("split"), task.alias("task"),
        F.when(task == "tts", text).alias("input_text"),
        F.when(task == "asr", text).when(task == "speech_to_text_translation", get("target_text")).when(task == "spoken_extract_qa", get("answer_text")).alias("target_text"),
        F.when(task == "spoken_extract_qa", get("question")).alias("question_text"),
        *[c for c in df.columns if c not in ("key", "sample_id", "dataset", "split", "task", "input_text", "target_text", "question_text")],
    )


def complete(df: DataFrame) -> DataFrame:
    """The rows that have both halves of a shard sample."""
    return df.filter(F.col("json").isNotNull() & F.col("npz").isNotNull())


def has_target(labels: Column) -> Column:
    """Whether any label is there to be learnt; none in a null or empty list."""
    return F.coalesce(F.exists(labels, lambda x: x != IGNORE), F.lit(False))
