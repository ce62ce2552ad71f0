"""Recordings: an index of files, whole files and segments as samples, their joining and encoding."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.sources.files import write_bytes

RATE = 24_000

#: Zero crossings to either side of the interpolation kernel.
WIDTH = 16


def file_index(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    """stem, path of every recording under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem"), "path")


def decoded(content: bytes, begin: float | None = None, end: float | None = None) -> tuple[np.ndarray, int]:
    """(mono samples in [-1, 1], rate) of a PCM wav file or of [begin, end) seconds of it.

    Frames are rounded half to even, the first is at least 0; a segment without frames is an error.
    """
    with wave.open(io.BytesIO(content)) as f:
        rate, width, channels = f.getframerate(), f.getsampwidth(), f.getnchannels()
        first = 0 if begin is None else max(0, round(begin * rate))
        last = f.getnframes() if end is None else round(end * rate)
        if last <= first:
            raise ValueError("the segment is empty")
        f.setpos(min(first, f.getnframes()))
        raw = f.readframes(last - first)
    kind = {1: np.uint8, 2: "<i2", 4: "<i4"}.get(width)
    if kind is None:
        raise ValueError(f"samples of {width} bytes are not supported")
    x = np.frombuffer(raw, kind).astype(np.float64)
    x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(axis=1), rate


def resampled(x: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Another rate by band-limited interpolation: what the lower rate cannot carry is filtered out.

    A sinc kernel under a Hann window, `WIDTH` zero crossings to either side, evaluated for each sample wanted.
    """
    if rate == to or not len(x):
        return x
    n, low = round(len(x) * to / rate), min(1.0, to / rate) * 0.95
    reach = int(np.ceil(WIDTH / low))
    padded = np.pad(x, reach + 1)
    out = np.empty(n)
    for k in range(0, n, 1 << 14):
        at = np.arange(k, min(n, k + (1 << 14))) * rate / to
        near = np.floor(at).astype(np.int64)[:, None] + np.arange(-reach, reach + 2)
        d = (at[:, None] - near) * low
        kernel = np.sinc(d) * (0.5 + 0.5 * np.cos(np.pi * np.clip(d / WIDTH, -1, 1)))
        kernel /= kernel.sum(axis=1, keepdims=True)
        out[k : k + len(at)] = (padded[np.clip(near + reach + 1, 0, len(padded) - 1)] * kernel).sum(axis=1)
    return out


def stand_in_codec(x: np.ndarray, codebooks: int = 4, size: int = 2048, hop: int = 1920) -> np.ndarray:
    """Codes (codebooks x frames) by plain quantisation of block means: a deterministic stand-in for a speech codec."""
    frames = len(x) // hop
    parts = x[: frames * hop].reshape(frames, codebooks, -1).mean(axis=2).T if frames else np.zeros((codebooks, 0))
    return np.floor((np.clip(parts, -1, 1) + 1) / 2 * (size - 1)).astype(np.int32)


def stand_in_decode(codes: np.ndarray, size: int = 2048, hop: int = 1920) -> np.ndarray:
    """Samples in [-1, 1] from codes of stand_in_codec: each code fills its part of the frame with the middle of its step.

    The last code stands for 1 alone, which 16-bit files cannot hold; read back from one it is the code before."""
    codebooks, frames = codes.shape
    values = np.clip((codes.astype(np.float64) + 0.5) / (size - 1) * 2 - 1, -1, 1)
    return np.repeat(values.T.reshape(-1), hop // codebooks) if frames else np.zeros(0)


def wav_bytes(x: np.ndarray, rate: int = RATE) -> bytes:
    """A mono wav file of 16-bit samples."""
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(rate)
        f.writeframes(np.round(np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return buffer.getvalue()


def write_waves(rows: DataFrame, root: str) -> DataFrame:
    """Each recording (key, wav) as a file of its key below a folder; path, key of the files once it is run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            paths = [f"{root}/{k}.wav" for k in b["key"]]
            for p, w in zip(paths, b["wav"], strict=True):
                write_bytes(p, bytes(w))
            yield pd.DataFrame({"key": b["key"], "path": paths})

    return rows.select(F.col("key").cast("string").alias("key"), "wav").mapInPandas(run, "key string, path string")


def decoded_codes(rows: DataFrame, codec: Callable[[np.ndarray], np.ndarray] = stand_in_decode) -> DataFrame:
    """key, wav, samples, error for rows of key and codes (codebooks x frames), in Arrow batches. Codes that cannot be
    decoded give their error and no recording; null ones are such."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, codes in zip(b["key"], b["codes"], strict=True):
                try:
                    x = codec(np.array([np.asarray(c) for c in codes], np.int64))
                    out.append((key, wav_bytes(x), len(x), None))
                except Exception as e:  # noqa: BLE001 - the outcome of the row
                    out.append((key, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["key", "wav", "samples", "error"]).astype({"samples": "Int64"})

    return rows.select(F.col("key").cast("string").alias("key"), "codes").mapInPandas(run, "key string, wav binary, samples long, error string")


def encoded(files: DataFrame, codec: Callable[[np.ndarray], np.ndarray] = stand_in_codec) -> DataFrame:
    """key, codes, duration_sec, error for rows of key, content, begin, end (null: from the start, to the end).

    A recording that cannot be read gives its error and no codes. Small Arrow batches keep few recordings in memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, content, begin, end in zip(b["key"], b["content"], b["begin"], b["end"], strict=True):
                try:
                    x, rate = decoded(bytes(content), None if pd.isna(begin) else begin, None if pd.isna(end) else end)
                    y = resampled(x, rate)
                    out.append((key, [r.tolist() for r in codec(y)], len(y) / RATE, None))
                except Exception as e:  # noqa: BLE001 - the outcome of the row
                    out.append((key, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["key", "codes", "duration_sec", "error"])

    return files.select(F.col("key").cast("string").alias("key"), "content", "begin", "end").mapInPandas(run, "key string, codes array<array<int>>, duration_sec double, error string")


def joined_passages(recordings: DataFrame) -> DataFrame:
    """passage, codes, duration_sec, files: the codes of a passage's recordings put together in order.

    `recordings` (passage, place, path, codes, duration_sec). A passage is a handful of sentences.
    """
    rows = F.array_sort(F.collect_list(F.struct("place", "path", "codes", "duration_sec")))
    got = recordings.groupBy("passage").agg(rows.alias("r"))
    books = F.transform(F.sequence(F.lit(0), F.size(F.col("r")[0]["codes"]) - 1), lambda k: F.flatten(F.transform("r", lambda x: x["codes"][k])))
    return got.select("passage", books.alias("codes"), F.aggregate("r", F.lit(0.0), lambda a, x: a + x["duration_sec"]).alias("duration_sec"), F.transform("r", lambda x: x["path"]).alias("files"))
