"""Exact byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece of text there is exactly one token that can end its encoding: a vocabulary
token that ends there (all of them are reported by an automaton over the vocabulary) and that is compatible
with the token ending the prefix before it. Two tokens are compatible when encoding their concatenation
gives the two of them back, which is decided from the merge table alone. The back-pointers then spell the
ids. The work is linear in the length of the piece (times the number of tokens that end at a position),
so an unbroken run of a million characters costs no more per byte than prose.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-tokenisation pattern published with the vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Pieces above so many characters are not remembered.
LONG_PIECE = 64


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public tokenizer package keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _alphabet() -> dict[str, str]:
    """The printable stand-ins byte-level vocabularies use, each with the byte (as a latin-1 character) meant."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): chr(b) for b in plain} | {chr(256 + i): chr(b) for i, b in enumerate(rest)}


class PrefixEncoder:
    """Encoder for one vocabulary file (a `tokenizers` JSON file of kind byte-level BPE)."""

    def __init__(self, path: str, cache_pieces: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, back = spec["model"], _alphabet()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        raw = lambda t: "".join(back[c] for c in t)
        self.ids = {raw(t): i for t, i in model["vocab"].items() if t not in special}
        #: token -> the two tokens its last merge joins, and the other way round
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for m in model["merges"]:
            a, b = (raw(x) for x in (m if isinstance(m, list) else m.split(" ")))
            pair, whole = (self.ids[a], self.ids[b]), self.ids[a + b]
            self.joined.setdefault(pair, whole)
            self.halves.setdefault(whole, pair)
        #: position in the merge order; single bytes come first
        self.order = {self.joined[p]: n for n, p in enumerate(self.joined)}
        self.ends = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.ends.add_word(t, (len(t), i))
        self.ends.make_automaton()
        self.split = regex.compile(PIECES).findall
        self.cache_pieces = cache_pieces
        self.known: dict[str, tuple[int, ...]] = {}
        self.compatible = lru_cache(maxsize=1 << 18)(self._compatible)

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the concatenation of two tokens is encoded as just these two.

        Undo merges from the later one backwards. At each moment the right end of the left token and the
        left end of the right token face each other; had a merge of these two come before the merges that
        are still in force, it would have eaten across the border.
        """
        joined, halves, order = self.joined, self.halves, self.order
        bound = float("inf")
        while True:
            whole = joined.get((left, right))
            if whole is not None and order[whole] < bound:
                return False
            a, b = order.get(left, -1), order.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:  # the left token was finished last: before that its right half stood here
                bound, left = a, halves[left][1]
            else:  # of two equal merges the left one is done first, so an equal one across the border wins here
                bound, right = b + 1, halves[right][0]

    def piece(self, text: str) -> tuple[int, ...]:
        """The ids of one piece of the pre-tokenisation."""
        raw = text.encode("utf-8", "surrogatepass").decode("latin-1")
        whole = self.ids.get(raw)
        if whole is not None:
            return (whole,)
        last = [-1] * (len(raw) + 1)
        size = [0] * (len(raw) + 1)
        ok = self.compatible
        for end, (n, token) in self.ends.iter(raw):
            at = end + 1
            if last[at] < 0 and (n == at or (last[at - n] >= 0 and ok(last[at - n], token))):
                last[at], size[at] = token, n
        out, at = [], len(raw)
        while at:
            if last[at] < 0:
                raise ValueError("the vocabulary lacks single bytes of this text")
            out.append(last[at])
            at -= size[at]
        return tuple(reversed(out))

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text without special tokens; none for an empty or null one."""
        if not text:
            return []
        known, pieces, own = self.known, self.split(text), {}
        if len(known) >= self.cache_pieces:
            known.clear()
        for p in set(pieces):
            if p not in known:
                (known if len(p) <= LONG_PIECE else own)[p] = self.piece(p)
        return list(chain.from_iterable(map({**own, **{p: known[p] for p in pieces if p in known}}.__getitem__ if own else known.__getitem__, pieces)))


@lru_cache(maxsize=4)
def encoder(path: str) -> PrefixEncoder:
    """One encoder per file and Python worker."""
    return PrefixEncoder(path)


def encode_corpus(
    docs: DataFrame, key: str = "doc_id", text: str = "text", ids: str = "ids", vocabulary: str | None = None
) -> DataFrame:
    """`key` and the list of ids of `text` for every row.

    Null and empty texts give an empty list, blank ones are text like any other; keys may repeat or be null,
    each row gives one row; other columns of `docs` are neither read nor returned. An empty table gives an
    empty table. One narrow stage, no shuffle.
    """
    path = vocabulary or vocabulary_path()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        enc = encoder(path)
        for b in batches:
            lists = [enc.encode(t) for t in b.column(1).to_pylist()]
            ends, total = [0], 0
            for x in lists:
                total += len(x)
                ends.append(total)
            flat = pa.array(list(chain.from_iterable(lists)), pa.int32())
            out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), out], names=[key, ids])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, `{ids}` array<int>")


def count_tokens(
    docs: DataFrame, text: str = "text", out: str = "n_tokens", vocabulary: str | None = None
) -> DataFrame:
    """`docs` without `text` and with its number of ids in `out` (0 for null and empty texts)."""
    path = vocabulary or vocabulary_path()
    keep = [c for c in docs.columns if c != text]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + f", `{out}` int"

    def run(batches):
        enc = encoder(path)
        for b in batches:
            n = [len(enc.encode(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int32())], names=[*keep, out])

    return docs.select(F.col(text), *keep).mapInArrow(run, schema)
