"""Text metrics as columns: routing, exact match, word error rate, BLEU of a sentence."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from voxloom.functions.text import squeeze


def route(task: Column, dataset: Column) -> Column:
    """The metric of a task and data set; the first rule that fits."""
    t, d = F.lower(F.coalesce(task, F.lit(""))), F.lower(F.coalesce(dataset, F.lit("")))
    has = lambda c, *xs: F.lit(False) if not xs else c.contains(xs[0]) | has(c, *xs[1:])
    return (
        F.when(has(t, "asr", "transcribe"), "wer")
        .when(has(d, "commonvoice", "gigaspeech") & ~has(d, "tts"), "wer")
        .when(has(t, "translate", "translation", "speech_to_text"), "bleu")
        .when(has(d, "covost"), "bleu")
        .otherwise("exact_match")
    )


def exact_match(prediction: Column, reference: Column) -> Column:
    """1 or 0 after white space is squeezed; null for a blank reference."""
    p, r = squeeze(prediction), squeeze(reference)
    return F.when(F.length(r) > 0, (p == r).cast("double"))


def _letter(n: int) -> str:
    """A character for a number, none twice and no half of a pair."""
    return chr(0x100 + n if n < 0xD700 else 0x10000 + n - 0xD700)


def word_error_rate(prediction: Column, reference: Column) -> Column:
    """Word edits by reference words; null for a blank reference. Blank predictions count every word as missing.

    Each row's words become single characters in Arrow batches, linear in the words; the edit distance itself is the
    engine's own, over those characters.
    """

    @F.pandas_udf("p string, r string, n int")
    def coded(p: pd.Series, r: pd.Series) -> pd.DataFrame:
        out: list[tuple] = []
        for x, y in zip(p, r, strict=True):
            if not y:
                out.append((None, None, None))
                continue
            known: dict[str, str] = {}
            a, b = ("".join(known.setdefault(w, _letter(len(known))) for w in t.split(" ")) if t else "" for t in (x, y))
            out.append((a, b, len(b)))
        return pd.DataFrame(out, columns=["p", "r", "n"]).astype({"n": "Int32"})

    c = coded(squeeze(prediction), squeeze(reference))
    return F.levenshtein(c["p"], c["r"]) / c["n"]


# How the usual tokens of machine translation scores are made, in order.
_TOKENS_13A = [
    (re.compile(r"<skipped>"), ""),
    (re.compile(r"&quot;"), '"'),
    (re.compile(r"&amp;"), "&"),
    (re.compile(r"&lt;"), "<"),
    (re.compile(r"&gt;"), ">"),
    (re.compile(r"^|$"), " "),
    (re.compile(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])"), r" \1 "),
    (re.compile(r"([^0-9])([\.,])"), r"\1 \2 "),
    (re.compile(r"([\.,])([^0-9])"), r" \1 \2"),
    (re.compile(r"([0-9])(-)"), r"\1 \2 "),
]


def bleu(prediction: str, reference: str, order: int = 4) -> float:
    """BLEU (0 to 100) of one sentence as a corpus of one: clipped n-gram matches, exponential smoothing, brevity."""
    p, r = prediction, reference
    for pattern, to in _TOKENS_13A:
        p, r = pattern.sub(to, p), pattern.sub(to, r)
    a, b = p.split(), r.split()
    log, some, smooth = 0.0, False, 1.0
    for n in range(1, order + 1):
        ga, gb = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (a, b))
        total, hit = sum(ga.values()), sum((ga & gb).values())
        if not total:
            return 0.0
        if not hit:
            smooth *= 2
        some = some or hit > 0
        log += math.log(hit / total if hit else 1 / (smooth * total))
    short = 1.0 if len(a) >= len(b) else math.exp(1 - len(b) / len(a))
    return 100.0 * short * math.exp(log / order) if some else 0.0


def sentence_bleu(prediction: Column, reference: Column) -> Column:
    """BLEU of each row; null for a blank reference."""

    @F.pandas_udf("double")
    def score(p: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([bleu(x, y) if y else None for x, y in zip(p, r, strict=True)], dtype="float64")

    return score(squeeze(prediction), squeeze(reference))
