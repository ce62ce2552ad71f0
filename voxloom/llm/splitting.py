"""Oversized items cut into pieces under a limit, at natural boundaries, with overlap.

An item is a run of `n` units (ids of a packed sample, frames of a spoken passage) and a hierarchy of natural
cut positions, strongest level first. A stretch that would not fit beside the overlap is split at its strongest level;
what is still too long at the next, and so on; only a stretch above the limit without any natural boundary inside is
cut by count. Neighbouring stretches are then packed greedily, each piece opening with the last units of the one before.

The overlap is exactly the wanted one, unless a stretch without any natural boundary inside is within the limit but
would not fit beside it: then the overlap gives way, for a cut inside the stretch is not called for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strength of the named boundaries, strongest first; a change of modality and a frame border come after them.
LEVELS = ("turn", "paragraph", "line", "sentence", "modality", "frame")

PIECES = "array<struct<start:int,stop:int,overlap:int,boundary:string>>"
_PIECE = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("overlap", pa.int32()), ("boundary", pa.string())]))


def stretches(lo: int, hi: int, levels: list[np.ndarray], limit: int, step: int, at: int = 0):
    """(start, stop, forced) of the parts of [lo, hi) that remain when it is split to at most `step` units where it has
    natural boundaries, and to at most `limit` where it has none."""
    if hi - lo <= step or at == len(levels) and hi - lo <= limit:
        yield lo, hi, False
    elif at == len(levels):
        for a in range(lo, hi, step):
            yield a, min(a + step, hi), True
    else:
        cuts = levels[at]
        inner = cuts[np.searchsorted(cuts, lo, "right") : np.searchsorted(cuts, hi, "left")].tolist()
        for a, b in zip([lo, *inner], [*inner, hi], strict=True):
            yield from stretches(a, b, levels, limit, step, at + 1)


def cut_item(n: int, levels: list[np.ndarray], limit: int, overlap: int) -> tuple[bool, list[tuple[int, int, int]]]:
    """Whether a cut had to be forced, and (start, stop, overlap) of each piece of an item of n units."""
    parts = list(stretches(0, n, levels, limit, limit - overlap))
    pieces, i = [], 0
    while i < len(parts):
        lo, hi, _ = parts[i]
        shared = min(overlap, lo, limit - (hi - lo))
        start = lo - shared
        while i + 1 < len(parts) and parts[i + 1][1] - start <= limit:
            i += 1
            hi = parts[i][1]
        pieces.append((start, hi, shared))
        i += 1
    return any(f for *_, f in parts), pieces


def real_ids(ids: Column, mask: Column) -> Column:
    """The ids whose mask is 1; all of them where the mask is null, none where the ids are."""
    kept = F.filter(ids, lambda _, i: F.get(mask, i) == 1)
    return F.when(mask.isNull(), F.coalesce(ids, F.array().cast("array<int>"))).otherwise(F.coalesce(kept, F.array().cast("array<int>")))


def packed_levels(ids: np.ndarray, ends: dict[str, np.ndarray], offset: int, codebook: int, codebooks: int) -> list[np.ndarray]:
    """Cut positions (before position p) of a packed sample for each of LEVELS."""
    speech = (ids >= offset) & (ids < offset + codebook * codebooks)
    levels = [np.flatnonzero(np.isin(ids, ends[k])) + 1 for k in LEVELS[:-1]]
    change = np.flatnonzero(speech[1:] != speech[:-1]) + 1
    levels[-1] = np.union1d(levels[-1], change)
    first = speech & (ids - offset < codebook)
    levels.append(np.flatnonzero(speech[:-1] & first[1:]) + 1)
    return levels


def _row(n: int, levels: list[np.ndarray], limit: int, overlap: int) -> tuple[str, list[dict]]:
    forced, pieces = cut_item(n, levels, limit, overlap)
    kind: dict[int, str] = {n: "end"}
    for name, cuts in zip(reversed(LEVELS[-len(levels) :]), reversed(levels), strict=True):
        kind.update(dict.fromkeys(cuts.tolist(), name))
    kind[n] = "end"
    rows = [{"start": a, "stop": b, "overlap": o, "boundary": kind.get(b, "forced")} for a, b, o in pieces]
    return "forced" if forced else "natural", rows


def _check(limit: int, overlap: int) -> None:
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError(f"a limit of {limit} with an overlap of {overlap} leaves no room")


def split_packed(
    packed: DataFrame,
    limit: int,
    overlap: int,
    ends: dict[str, list[int]],
    offset: int,
    codebook: int,
    codebooks: int,
    key: str = "sample_id",
    with_ids: bool = False,
) -> DataFrame:
    """One row per packed sample above `limit` real ids: item_id, size, cut, pieces (and ids).

    `ends` gives the ids after which a text may be cut, by kind of boundary. Rows with null ids are empty and so
    never above the limit; with a null mask every id is real. Rows delivered again give their row again (drop
    them after the call, where they are few and thin). Extra columns are ignored. Only rows whose list is long
    enough leave the JVM; no shuffle.
    """
    _check(limit, overlap)
    known = {k: np.array(sorted(ends.get(k, [])), np.int64) for k in LEVELS[:-1]}
    strange = set(ends) - set(LEVELS[:-1])
    if strange:
        raise ValueError(f"unknown boundaries {sorted(strange)}")
    kind = packed.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            keys, sizes, cuts, pieces = [], [], [], []
            for k, ids in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = ids.values.to_numpy(zero_copy_only=False)
                c, rows = _row(len(v), packed_levels(v, known, offset, codebook, codebooks), limit, overlap)
                keys.append(k), sizes.append(len(v)), cuts.append(c), pieces.append(rows)
            out = [pa.array(keys, b.column(0).type), pa.array(sizes, pa.int32()), pa.array(cuts, pa.string()), pa.array(pieces, _PIECE)]
            yield pa.RecordBatch.from_arrays(out + [b.column(1)] * with_ids, names=["item_id", "size", "cut", "pieces"] + ["ids"] * with_ids)

    long = packed.filter(F.size("input_ids") > limit)
    real = long.select(F.col(key), F.filter(real_ids(F.col("input_ids"), F.col("attention_mask")), lambda x: x.isNotNull()).alias("ids"))
    schema = f"item_id {kind}, size int, cut string, pieces {PIECES}" + ", ids array<int>" * with_ids
    return real.filter(F.size("ids") > limit).mapInArrow(run, schema)


def passages(spoken: DataFrame, wav_index: DataFrame, key: str = "id", fps: float = 12.5) -> DataFrame:
    """`key`, size in frames and the recordings (stem, frames) in spoken order of every passage, each key once.

    The order is the number at the end of `topic_para_sentence`; names without one keep their listed place after
    those with one. A recording without an index row or frame count takes its duration times `fps`, else 0.
    Null and empty lists give no row.
    """
    rows = spoken.select(key, "audio_files").dropDuplicates([key])
    each = rows.select(key, F.posexplode("audio_files").alias("place", "file"))
    each = each.select(key, "place", F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "").alias("stem"))
    frames = F.coalesce(F.col("num_frames"), F.round(F.col("duration_sec") * fps).cast("int"))
    index = wav_index.select("stem", frames.alias("frames"))
    number = F.regexp_extract("stem", r"_(\d{1,9})$", 1).try_cast("int")
    item = F.struct(F.coalesce(number, F.lit(2**31 - 1)).alias("sentence"), "place", "stem", F.coalesce("frames", F.lit(0)).alias("frames"))
    grouped = each.join(index, "stem", "left").groupBy(key).agg(F.sum(F.coalesce("frames", F.lit(0))).alias("size"), F.collect_list(item).alias("r"))
    return grouped.select(key, "size", F.transform(F.array_sort("r"), lambda x: F.struct(x["stem"].alias("stem"), x["frames"].alias("frames"))).alias("recordings"))


def split_passages(spoken: DataFrame, wav_index: DataFrame, limit: int, overlap: int, key: str = "id") -> DataFrame:
    """One row per spoken passage above `limit` frames: item_id, size, cut, pieces, recordings.

    Natural boundaries lie between two recordings; a recording above the limit is cut by count. Start, stop and
    overlap count frames of the passage in spoken order, so a piece's overlap may open inside a recording.
    """
    _check(limit, overlap)
    kind = spoken.schema[key].dataType.simpleString()
    rec = "array<struct<stem:string,frames:int>>"

    def run(batches):
        for b in batches:
            cuts, pieces = [], []
            for n, ids in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                c, rows = _row(n, [np.unique(np.cumsum([x["frames"] for x in ids]))], limit, overlap)
                for r in rows:
                    r["boundary"] = {"frame": "recording"}.get(r["boundary"], r["boundary"])
                cuts.append(c), pieces.append(rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(cuts, pa.string()), pa.array(pieces, _PIECE), b.column(2)],
                names=["item_id", "size", "cut", "pieces", "recordings"],
            )

    above = passages(spoken, wav_index, key).filter(F.col("size") > limit).withColumn("size", F.col("size").cast("int"))
    return above.mapInArrow(run, f"item_id {kind}, size int, cut string, pieces {PIECES}, recordings {rec}")
