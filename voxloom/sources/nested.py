"""Items of a list inside one large JSON document, read as a stream: the document is never held as a whole."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from voxloom.sources.files import below, kind, located

_SPECIAL = re.compile(r'["{}\[\]]')
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*"', re.S)


def items(chunks: Iterator[str], name: str) -> Iterator[str]:
    """The text of each object in the list that stands under `name` in the outermost object of a document.

    Holds one item and one chunk at a time. A document without the list has no items; one that ends within the
    list is an error.
    """
    text, at, depth, start, inside, done = "", 0, 0, -1, False, False
    key_at = re.compile(r'\s*:\s*\[')
    chunks = iter(chunks)
    more = True

    def grow() -> bool:
        nonlocal text, at, start, more
        piece = next(chunks, None)
        if piece is None:
            more = False
            return False
        cut = start if start >= 0 else at
        text, at, start = text[cut:] + piece, at - cut, 0 if start >= 0 else -1
        return True

    while not done:
        m = _SPECIAL.search(text, at)
        if m is None:
            at = len(text)
            if not grow():
                break
            continue
        c = m[0]
        if c == '"':
            end = _STRING_END.match(text, m.end())
            # the key of a list needs what follows it, too
            key = depth == 1 and not inside
            if end is None or (key and more and len(text) - end.end() < 64):
                at = m.start()
                if grow():
                    continue
                if end is None:
                    break
            at = end.end()
            if key and text[m.end() : end.end() - 1] == name and (opened := key_at.match(text, at)):
                inside, at = True, opened.end()
                depth += 1
            continue
        at = m.end()
        if c in "{[":
            if inside and depth == 2 and c == "{":
                start = m.start()
            depth += 1
        else:
            depth -= 1
            if inside and depth == 2 and start >= 0:
                yield text[start:at]
                start = -1
            elif inside and depth == 1:
                done = True
    if not done and (inside or depth):
        raise ValueError(f"the document ends within {name if inside else 'an object'}")


def chunks_of(path: str, size: int = 1 << 20) -> Iterator[str]:
    """The text of a file, piece by piece."""
    system, at = located(path)
    decoder = codecs.getincrementaldecoder("utf-8-sig")()
    with system.open_input_stream(at) as f:
        while data := f.read(size):
            yield decoder.decode(data)
    yield decoder.decode(b"", final=True)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.name, self.ending = options["path"], options["items"], options.get("ending", ".json")

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in (below(self.path, self.ending) if kind(self.path) == "folder" else [self.path])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        held, size, first = [], 0, 0

        def batch() -> pa.RecordBatch:
            n = len(held)
            return pa.RecordBatch.from_arrays([pa.array([partition.value] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), pa.array(held, pa.string())], names=["file", "place", "item"])

        for x in items(chunks_of(partition.value), self.name):
            held.append(x)
            size += len(x)
            if size > 1 << 22:
                yield batch()
                first += len(held)
                held, size = [], 0
        if held:
            yield batch()


class JsonItems(DataSource):
    """format("jsonitems"): options path (a file, or a folder of files that end in `ending`, .json by default) and items (the name of the list)."""

    @classmethod
    def name(cls) -> str:
        return "jsonitems"

    def schema(self) -> str:
        return "file string, place long, item string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)
