"""Tar shards of {key.json, key.npz} samples as a Spark data source, both ways, on any file system Arrow knows."""

from __future__ import annotations

import io
import json
import os
import tarfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from voxloom.functions.ids import with_ordinal
from voxloom.sources.files import below, kind, located, write_bytes

#: An array with its type and shape; values in row order.
ARRAY = "struct<type:string,shape:array<int>,values:array<int>>"
SCHEMA = f"key string, json string, arrays map<string,{ARRAY}>, shard string, ordinal int"
_ARRAYS = pa.map_(pa.string(), pa.struct([("type", pa.string()), ("shape", pa.list_(pa.int32())), ("values", pa.list_(pa.int32()))]))
_ARROW = pa.schema([("key", pa.string()), ("json", pa.string()), ("arrays", _ARRAYS), ("shard", pa.string()), ("ordinal", pa.int32())])

#: Samples handed to Spark at once.
BATCH = 64


def vector(values: Column, type_: str = "int32") -> Column:
    """A column of lists as one-dimensional arrays."""
    return F.struct(F.lit(type_).alias("type"), F.array(F.size(values)).alias("shape"), F.transform(values, lambda x: x.cast("int")).alias("values")).cast(ARRAY)


def matrix(values: Column, type_: str = "int32") -> Column:
    """A column of lists of equally long lists as two-dimensional arrays."""
    flat = F.flatten(values)
    width = F.when(F.size(values) > 0, F.size(F.get(values, F.lit(0)))).otherwise(F.lit(0))
    return F.struct(F.lit(type_).alias("type"), F.array(F.size(values), width).alias("shape"), flat.alias("values")).cast(ARRAY)


def rows_of(array: Column) -> Column:
    """A two-dimensional array as a list of lists."""
    width = F.get(array["shape"], F.lit(1))
    return F.transform(F.sequence(F.lit(1), F.get(array["shape"], F.lit(0))), lambda i: F.slice(array["values"], (i - 1) * width + 1, width))


def resolve(paths: str | list[str]) -> list[str]:
    """Shards of folders (all tar files below, sorted; none is an error), tar files, and names of files not there yet
    as they are."""
    out: list[str] = []
    for p in [paths] if isinstance(paths, str) else paths:
        what = kind(p)
        if what == "folder":
            found = below(p, ".tar")
            if not found:
                raise FileNotFoundError(f"no tar file below {p}")
            out += found
        elif what == "file" and not p.endswith(".tar"):
            raise ValueError(f"{p} is not a tar file")
        else:
            out.append(p)
    return out


def _samples(path: str) -> Iterator[tuple]:
    """(key, json, arrays, shard, ordinal) of each sample, members of a key standing together as written; keys that
    lack a half have null in its place. The shard is read as a stream."""
    halves: dict[str, dict[str, bytes]] = {}
    system, at = located(path)
    with system.open_input_stream(at) as f, tarfile.open(fileobj=f, mode="r|") as tar:
        n = 0
        for m in tar:
            if not m.isfile():
                continue
            key, _, half = m.name.rpartition(".")
            if halves and key not in halves:
                for k in list(halves):
                    yield _row(k, halves.pop(k), path, n)
                    n += 1
            halves.setdefault(key, {})[half] = tar.extractfile(m).read()
        for k in list(halves):
            yield _row(k, halves[k], path, n)
            n += 1


def _row(key: str, parts: dict[str, bytes], path: str, n: int) -> tuple:
    arrays = None
    if "npz" in parts:
        with np.load(io.BytesIO(parts["npz"]), allow_pickle=False) as z:
            arrays = {k: _described(z[k]) for k in z.files}
    return key, parts["json"].decode() if "json" in parts else None, arrays, os.path.basename(path), n


def _described(a: np.ndarray) -> dict:
    if a.size and not (-(1 << 31) <= a.min() and a.max() < 1 << 31):
        raise ValueError("arrays of shards hold whole numbers of 32 bits")
    return {"type": str(a.dtype), "shape": list(a.shape), "values": a.astype(np.int32).ravel().tolist()}


class _Shard(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = resolve(json.loads(options["paths"]) if "paths" in options else options["path"])

    def partitions(self) -> list[InputPartition]:
        return [_Shard(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*held, strict=True)]
            columns[2] = [None if a is None else list(a.items()) for a in columns[2]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

        for r in _samples(partition.value):
            held.append(r)
            if len(held) == BATCH:
                yield batch()
                held = []
        if held:
            yield batch()


class _Written(WriterCommitMessage):
    def __init__(self, parts: list[tuple[str, str]]):
        self.parts = parts


class _Writer(DataSourceWriter):
    """Shards are written under names of their attempt; they get their own names only when the whole write is
    committed, so a task that fails or runs twice leaves no shard behind."""

    def __init__(self, options: dict):
        self.root, self.most, self.prefix = options["path"].rstrip("/"), int(options.get("maxcount", 10_000)), options.get("prefix", "shard")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, root = located(self.root)
        system.create_dir(f"{root}/_parts", recursive=True)
        task, parts, tar, out, n = TaskContext.get(), [], None, None, 0
        try:
            for r in rows:
                if tar is None or n == self.most:
                    if tar is not None:
                        tar.close(), out.close()
                    name = f"{self.prefix}-{task.partitionId():06d}-{len(parts):06d}.tar"
                    parts.append((f"_parts/{task.taskAttemptId()}-{name}", name))
                    out, n = system.open_output_stream(f"{root}/{parts[-1][0]}"), 0
                    tar = tarfile.open(fileobj=out, mode="w|")
                self._add(tar, f"{r['key']}.json", r["json"].encode())
                buffer = io.BytesIO()
                np.savez(buffer, **{k: np.array(v["values"], np.dtype(v["type"])).reshape(v["shape"]) for k, v in (r["arrays"] or {}).items()})
                self._add(tar, f"{r['key']}.npz", buffer.getvalue())
                n += 1
            if tar is not None:
                tar.close(), out.close()
        except BaseException:
            if out is not None:
                out.close()
            self._drop(parts)
            raise
        return _Written(parts)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = located(self.root)
        for part, name in (x for m in messages if m is not None for x in m.parts):
            system.move(f"{root}/{part}", f"{root}/{name}")
        system.delete_dir(f"{root}/_parts")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m is not None:
                self._drop(m.parts)

    def _drop(self, parts: list[tuple[str, str]]) -> None:
        system, root = located(self.root)
        for part, _ in parts:
            try:
                system.delete_file(f"{root}/{part}")
            except OSError:
                pass  # it is not there

    @staticmethod
    def _add(tar: tarfile.TarFile, name: str, data: bytes) -> None:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))


class TarShards(DataSource):
    """format("tarshards"): one partition for each shard; options path or paths (a JSON list), maxcount, prefix."""

    @classmethod
    def name(cls) -> str:
        return "tarshards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        return _Writer(self.options)


def read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """key, json, arrays, shard, ordinal of every sample of the shards."""
    spark.dataSource.register(TarShards)
    return spark.read.format("tarshards").option("paths", json.dumps(resolve(paths))).load()


def in_order(samples: DataFrame) -> DataFrame:
    """Samples numbered from 0 over all shards in the order of names and places, as an evaluation reads them."""
    return with_ordinal(samples, "shard", "ordinal", name="place")


def write(df: DataFrame, root: str, maxcount: int = 10_000, prefix: str = "shard") -> None:
    """`df` (key, json, arrays) as shards of at most `maxcount` samples, named by task and number."""
    df.sparkSession.dataSource.register(TarShards)
    rows = df.select("key", "json", F.col("arrays").cast(f"map<string,{ARRAY}>").alias("arrays"), F.lit(None).cast("string").alias("shard"), F.lit(None).cast("int").alias("ordinal"))
    rows.write.format("tarshards").option("path", root).option("maxcount", maxcount).option("prefix", prefix).mode("append").save()


def write_numbered(df: DataFrame, root: str, shards: int, number: str = "number", prefix: str = "shard") -> None:
    """`df` (key, json, arrays and the number of the shard, below `shards`) as one shard for each number, keys in order."""
    write(df.repartitionById(shards, F.col(number).cast("int")).sortWithinPartitions("key"), root, maxcount=2**31 - 1, prefix=prefix)


def numbered(samples: DataFrame) -> DataFrame:
    """Samples of numbered shards with that number."""
    return samples.withColumn("number", F.regexp_extract("shard", r"-(\d+)-\d+\.tar$", 1).cast("int"))


def inspected(path: str, n: int) -> dict:
    """The n-th complete sample of one shard in the order of its keys: key, meta and arrays."""
    rows = sorted((r for r in _samples(path) if r[1] is not None and r[2] is not None), key=lambda r: r[0])
    if not 0 <= n < len(rows):
        raise IndexError(f"sample {n} of {len(rows)}")
    key, meta, arrays, *_ = rows[n]
    return {"key": key, "meta": json.loads(meta), "arrays": {k: np.array(a["values"], np.dtype(a["type"])).reshape(a["shape"]) for k, a in arrays.items()}}


def write_inspection(sample: dict, root: str, texts: dict[str, str], waves: dict[str, bytes] | None = None, preview: int = 4000) -> dict[str, str]:
    """One inspected sample as files to look at: its meta, its arrays, a text file for each of `texts` and a wav file for
    each of `waves`. Returns the first `preview` characters of each text."""
    key = sample["key"].replace("/", "_")
    buffer = io.BytesIO()
    np.savez_compressed(buffer, **sample["arrays"])
    write_bytes(f"{root}/{key}.meta.json", json.dumps(sample["meta"], ensure_ascii=False, indent=2).encode())
    write_bytes(f"{root}/{key}.arrays.npz", buffer.getvalue())
    for name, t in texts.items():
        write_bytes(f"{root}/{key}.{name}.txt", t.encode())
    for name, w in (waves or {}).items():
        write_bytes(f"{root}/{key}.{name}.wav", w)
    return {name: t[:preview] for name, t in texts.items()}
