"""The one id space of text and speech: codes to ids and back, modality runs and their state."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class IdSpace:
    """Text ids lie in [0, text_vocab_size), speech ids behind them, codebook by codebook."""

    base_model: str
    text_vocab_size: int
    num_codebooks: int = 4
    codebook_size: int = 2048
    special: dict[str, int] = field(default_factory=dict)

    @property
    def offset(self) -> int:
        return self.text_vocab_size

    @property
    def speech_size(self) -> int:
        return self.num_codebooks * self.codebook_size

    @property
    def full_size(self) -> int:
        return self.offset + self.speech_size

    def special_id(self, name: str) -> int:
        if name not in self.special:
            raise KeyError(f"no special token {name}")
        return self.special[name]

    def pad_id(self) -> int:
        """The pad token, else the end token."""
        for name in ("pad", "eos"):
            if self.special.get(name) is not None:
                return self.special[name]
        raise ValueError("the vocabulary has neither a pad nor an end token")

    def config(self) -> dict:
        """The eight keys that decide whether data sets fit together."""
        return {
            "base_model": self.base_model,
            "text_vocab_size": self.text_vocab_size,
            "speech_offset": self.offset,
            "speech_vocab_size_total": self.speech_size,
            "full_vocab_size": self.full_size,
            "num_codebooks": self.num_codebooks,
            "speech_codebook_size": self.codebook_size,
            "extra_special_ids": dict(self.special),
        }

    def as_dict(self) -> dict:
        return asdict(self)


def is_speech(i: Column, space: IdSpace) -> Column:
    return (i >= space.offset) & (i < space.full_size)


def speech_ids(codes: Column, space: IdSpace) -> Column:
    """Codes (codebooks x frames) interleaved by frame into ids; empty for no frames.

    A wrong number of codebooks, codebooks of unequal length and codes outside the codebook raise an error.
    """
    k = space.num_codebooks
    frames = F.size(codes[0])
    wrong = F.when(F.size(codes) != k, F.raise_error(F.lit(f"expected {k} codebooks")))
    wrong = wrong.when(F.exists(codes, lambda c: F.size(c) != frames), F.raise_error(F.lit("codebooks differ in length")))
    wrong = wrong.when(
        F.exists(codes, lambda c: F.exists(c, lambda x: (x < 0) | (x >= space.codebook_size))), F.raise_error(F.lit("code outside its codebook"))
    )
    # zipped by frame; arrays_zip runs over frames, so no sequence has to be guarded against zero frames
    zipped = F.arrays_zip(*(codes[j].alias(f"c{j}") for j in range(k)))
    by_frame = F.transform(zipped, lambda z: F.array(*(z[f"c{j}"] + (space.offset + j * space.codebook_size) for j in range(k))))
    return F.when(codes.isNull(), F.lit(None)).otherwise(F.coalesce(wrong.cast("array<int>"), F.flatten(by_frame)))


def aligned(ids: Column, space: IdSpace) -> Column:
    """Whether ids are whole frames of speech in codebook order."""
    k, c = space.num_codebooks, space.codebook_size
    right = F.transform(ids, lambda x, i: is_speech(x, space) & (F.floor((x - space.offset) / c) == i % k))
    return (F.size(ids) % k == 0) & F.forall(right, lambda b: b)


def speech_codes(ids: Column, space: IdSpace) -> Column:
    """Ids back to codes (codebooks x frames); raises an error unless they are whole frames in order."""
    k, c = space.num_codebooks, space.codebook_size

    def book(j: int) -> Column:
        return F.transform(F.filter(ids, lambda _, i: i % k == j), lambda x: ((x - space.offset) % c).cast("int"))

    codes = F.array(*(book(j) for j in range(k)))
    bad = F.raise_error(F.lit("ids are not whole speech frames in codebook order")).cast("array<array<int>>")
    return F.when(aligned(ids, space), codes).when(ids.isNull(), F.lit(None)).otherwise(bad)


def only(ids: Column, space: IdSpace, speech: bool) -> Column:
    """The speech ids, or all others."""
    return F.filter(ids, lambda x: is_speech(x, space) if speech else ~is_speech(x, space))


def modality_runs(ids: Column, space: IdSpace) -> Column:
    """Maximal runs of one modality: array of (type, start, stop, ids), empty for no ids.

    `ids` is a column of the table: its elements are then looked up in place, so the work is linear in the length.
    """
    first = lambda x, i: F.when((i == 0) | (is_speech(x, space) != is_speech(F.get(ids, i - 1), space)), i)
    starts = F.filter(F.transform(ids, first), lambda i: i.isNotNull())
    stops = F.concat(F.slice(starts, F.lit(2), F.size(ids)), F.array(F.size(ids)))
    kind = lambda r: F.when(is_speech(F.get(ids, r["a"]), space), "speech").otherwise("text")
    run = lambda r: F.struct(kind(r).alias("type"), r["a"].alias("start"), r["b"].alias("stop"), F.slice(ids, r["a"] + 1, r["b"] - r["a"]).alias("ids"))
    return F.when(F.size(ids) > 0, F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), run)).when(ids.isNotNull(), F.array().cast("array<struct<type:string,start:int,stop:int,ids:array<int>>>"))


def speech_run_state(df: DataFrame, key: str, ids: str, space: IdSpace) -> DataFrame:
    """For each speech run of each row: its number, ids, whole-frame ids, and whether a tail was dropped or it can be decoded."""
    k = space.num_codebooks
    runs = df.select(key, F.posexplode(F.filter(modality_runs(F.col(ids), space), lambda r: r["type"] == "speech")).alias("segment_index", "r"))
    n = F.size("r.ids")
    usable = F.floor(n / k).cast("int") * k
    head = F.slice("r.ids", 1, usable)
    return runs.select(
        key, "segment_index", n.alias("raw_num_tokens"), usable.alias("usable_num_tokens"), F.lit(k).alias("num_codebooks"),
        (n != usable).alias("trimmed_incomplete_tail"), ((usable > 0) & aligned(head, space)).alias("decodable"),
    )


def quantised(values: Column, space: IdSpace, frames: int) -> Column:
    """A stand-in codec: `num_codebooks * frames` samples in [-1, 1] to codes, codebook by codebook."""
    top = space.codebook_size - 1
    code = lambda v: F.floor((F.greatest(F.least(v.cast("double"), F.lit(1.0)), F.lit(-1.0)) + 1) / 2 * top).cast("int")
    flat = F.transform(values, code)
    return F.array(*(F.slice(flat, j * frames + 1, frames) for j in range(space.num_codebooks)))
