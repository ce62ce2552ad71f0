"""Items of varying length put into containers of fixed capacity: conflict-constrained best fit.

Items are spread over blocks of bounded size by a hash of their key. Within a block they are taken by falling
length; open containers are ordered by what is left in them, and each carries a bitmap of the sources and one of
the clusters of copies it holds. An item goes to the container with the least room that takes it and has no
conflict; the search goes on to the next larger remainder until one is found, else a container is opened. What a
block leaves badly filled is emptied and packed again together with the rests of other blocks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.splitting import real_ids
from voxloom.runtime import checkpointed


def best_fit(
    lengths: list[int], sources: list[int], clusters: list[int], capacity: int, apart: list[int] | None = None
) -> tuple[list[int], list[int]]:
    """The container number of each item, and what is left in each container.

    `clusters`: number of the item's cluster of copies, -1 for none; no container holds two of a cluster.
    `apart`: for each source the bitmap of sources it may not meet.
    """
    place = [0] * len(lengths)
    rest: list[int] = []
    held: list[int] = []  # bitmap of clusters by container
    met: list[int] = []  # bitmap of sources by container
    open_: dict[int, list[int]] = {}  # remainder -> containers
    some = 0  # bit r is set while a container with remainder r is open
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n, source = lengths[i], sources[i]
        mine = 1 << clusters[i] if clusters[i] >= 0 else 0
        shy = apart[source] if apart else 0
        found, above = -1, some >> n
        r = n
        while above:
            low = (above & -above).bit_length() - 1
            r += low
            for k in reversed(open_[r]):
                if not held[k] & mine and not met[k] & shy:
                    found = k
                    break
            if found >= 0:
                break
            above >>= low + 1
            r += 1
        if found < 0:
            found = len(rest)
            rest.append(capacity), held.append(0), met.append(0)
        else:
            open_[r].remove(found)
            if not open_[r]:
                some ^= 1 << r
        held[found] |= mine
        met[found] |= 1 << source
        rest[found] -= n
        place[i] = found
        open_.setdefault(rest[found], []).append(found)
        some |= 1 << rest[found]
    return place, rest


def _pack_round(items: DataFrame, capacity: int, blocks: int, name: str, apart: dict[str, list[str]]) -> DataFrame:
    """One pass of best fit over `blocks` blocks; adds container and used."""
    cols = "sample_id string, row string, source string, cluster long, start int, length int, container string, used int"

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "sample_id", "row", "start"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        at = int(pdf["block"].iloc[0])
        codes, names = pd.factorize(pdf["source"].fillna(""))
        number = {s: n for n, s in enumerate(names)}
        shy = [sum(1 << number[x] for x in apart.get(s, ()) if x in number) for s in names]
        # a cluster with one member here meets nobody
        multi = pdf["cluster"].duplicated(keep=False)
        cluster = pd.Series(-1, pdf.index)
        cluster[multi] = pd.factorize(pdf.loc[multi, "cluster"])[0]
        place, rest = best_fit(pdf["length"].tolist(), codes.tolist(), cluster.tolist(), capacity, shy if any(shy) else None)
        pdf["container"] = [f"{name}-{at:06d}-{k:06d}" for k in place]
        pdf["used"] = [capacity - rest[k] for k in place]
        return pdf[["sample_id", "row", "source", "cluster", "start", "length", "container", "used"]]

    keyed = items.select("sample_id", "row", "source", "cluster", "start", "length", F.pmod(F.xxhash64("sample_id", "row", "start"), F.lit(blocks)).alias("block"))
    return keyed.groupBy("block").applyInPandas(block, cols)


def _samples(packed: DataFrame) -> DataFrame:
    """sample_id, row, source, ids: the real ids of each sample, and what tells it from others with a null id."""
    rows = packed.select("sample_id", F.col("dataset").alias("source"), real_ids(F.col("input_ids"), F.col("attention_mask")).alias("ids"))
    content = F.sha2(F.to_json(F.struct("source", "ids")), 256)
    return rows.select("sample_id", F.when(F.col("sample_id").isNull(), F.concat(F.lit("null:"), content)).alias("row"), "source", "ids")


def assign(
    packed: DataFrame, capacity: int, block_items: int = 20_000, slack: float = 0.01, apart: dict[str, list[str]] | None = None
) -> DataFrame:
    """sample_id, row, source, cluster, start, length, container, used: where each sample (or part of one) goes.

    A sample above the capacity is divided into full parts and a rest; nothing else is. Each sample_id counts
    once; samples with a null one are told apart by `row`, a hash of source and real ids (else null), and count
    once for each content. Samples without real ids are items of length 0. Copies (equal real ids) never share a container;
    `apart` names sources that may not meet either. Containers with more than `slack` of their room unused are
    packed again over all blocks. Blocks are of bounded size whatever the keys, so no group grows with the data.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    items = _samples(packed).select("sample_id", "row", "source", F.size("ids").alias("n"), F.xxhash64("ids").alias("cluster")).dropDuplicates(["sample_id", "row"])
    starts = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1, F.lit(capacity))).otherwise(F.array(F.lit(0)))
    parts = items.select("*", F.explode(starts).alias("start"))
    parts = checkpointed(parts.select("sample_id", "row", "source", "cluster", "start", F.least(F.lit(capacity), F.col("n") - F.col("start")).alias("length")))
    full = parts.filter(F.col("length") == capacity)
    full = full.select("*", F.concat_ws("-", F.lit("full"), "sample_id", "row", "start").alias("container"), F.col("length").alias("used"))
    todo = parts.filter(F.col("length") < capacity)
    blocks = lambda n: max(1, -(-n // block_items))
    first = checkpointed(_pack_round(todo, capacity, blocks(todo.count()), "a", apart or {}))
    good = F.col("used") >= (1 - slack) * capacity
    tail = first.filter(~good)
    again = _pack_round(tail, capacity, blocks(tail.count()), "b", apart or {})
    return full.unionByName(first.filter(good)).unionByName(again)


def containers(packed: DataFrame, capacity: int, **options) -> DataFrame:
    """One row per container: container, used, unused, members (sample_id, start, length in order), input_ids."""
    where = assign(packed, capacity, **options)
    ids = _samples(packed).drop("source")
    both = where.join(ids, where["sample_id"].eqNullSafe(ids["sample_id"]) & where["row"].eqNullSafe(ids["row"])).select(
        "container", where["sample_id"].alias("sample_id"), where["row"].alias("row"), "start", "length", F.slice("ids", F.col("start") + 1, F.col("length")).alias("ids")
    )
    # rows delivered again have equal content and fall together here
    rows = F.array_sort(F.collect_set(F.struct("sample_id", "row", "start", "length", "ids")))
    grouped = both.groupBy("container").agg(rows.alias("rows"))
    members = F.transform("rows", lambda x: F.struct(x["sample_id"].alias("sample_id"), x["start"].alias("start"), x["length"].alias("length")))
    used = F.aggregate("rows", F.lit(0), lambda a, x: a + x["length"])
    return grouped.select(
        "container", used.alias("used"), (F.lit(capacity) - used).alias("unused"), members.alias("members"),
        F.flatten(F.transform("rows", lambda x: x["ids"])).alias("input_ids"),
    )


def fill_report(where: DataFrame, capacity: int) -> DataFrame:
    """Containers, items, ids, unused ids and fill rate of an assignment, beside the least number of containers."""
    one = where.groupBy("container").agg(F.count("*").alias("items"), F.sum("length").alias("used"))
    total = one.agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("ids"))
    return total.select(
        "containers", "items", "ids",
        (F.col("containers") * capacity - F.col("ids")).alias("unused"),
        F.ceil(F.col("ids") / capacity).alias("least_containers"),
        (F.col("ids") / (F.col("containers") * capacity)).alias("fill"),
    )
