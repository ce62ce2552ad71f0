"""Evaluation records whose text also occurs, exactly or nearly, in the training split.

Texts are brought to a plain form and equal ones folded into one class. The passages of the evaluation classes are
laid out in shards, and each shard meets every training class of its field. Training texts are found by the hashes of
their passages: rare passages as lists of texts, frequent ones as bit sets, so that a pair costs time only where its
passages may cover enough. Pairs that lengths, letter pairs or words prove to be no copies go first, then an edit
distance on bit vectors. For the pairs left, an Aho-Corasick automaton over the passages scans the training texts, the
intervals matched are merged into the coverage, and the exact comparison ends it.

Why every shard scans every training text: copies may differ in any letters, so no fixed number of keys of a text,
however rare, is sure to be left in its copy. The work grows with training texts times shards; evaluation splits of a
fixed size are a fixed number of shards, and then it grows with the training texts alone.
"""

from __future__ import annotations

from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.normal import words
from voxloom.runtime import checkpointed

#: Texts, and letters of texts, of a side in a cell of the grid of shards and training slices, the slices that a field is
#: cut into if each keeps FEW_TRAIN texts, and the most tasks that work on cells. Results do not depend on them.
EVAL_CELL, TRAIN_CELL = 1 << 17, 1 << 17
EVAL_LETTERS, TRAIN_LETTERS = 1 << 24, 1 << 24
LEAST_SLICES, FEW_TRAIN = 3, 1 << 14
MOST_TASKS = 4096

#: Bins of a text's letter pairs and how often one counts, passages shared by two texts held at once, the longest text (in words
#: of 64 letters) compared by bit vectors, and the letters of texts whose passages an automaton holds at once (one over
#: 2^22 letters of texts without repetitions takes some 570 MB).
PAIR_BINS, PAIR_TIMES, AT_ONCE, BIT_WORDS = 256, 4, 1 << 21, 4
AUTOMATON_LETTERS = 1 << 21

#: A passage is frequent if it is in one of so many training texts and in so many at least; how many frequent ones have a
#: bit set, how many of them in a text are counted, and evaluation texts looked up at once. Results do not depend on them.
FREQUENT, LEAST_FREQUENT, BIT_SETS, LEVELS, BLOCK = 512, 64, 1 << 11, 3, 64

PASSAGE, STRIDE = 10, 5

_TRAIN = ("train", "training")
_EVAL = ("dev", "test", "validation", "valid", "val", "eval", "evaluation", "development")


def side(split: Column) -> Column:
    """'t' for training, 'e' for evaluation splits by their plain meaning, else null."""
    s = F.regexp_replace(F.lower(split), r"(?U)\s+", "")
    return F.when(s.isin(*_TRAIN), "t").when(s.isin(*_EVAL), "e")


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(text, seed)


def plain_texts(rows: DataFrame, min_words: int = 8) -> DataFrame:
    """field, side, id, plain, a, b of every row (field, side, id, text) with at least `min_words` words, split
    at white space as they stand; a and b are two hashes of field and plain text. Null texts are left out."""

    def run(batches):
        for b in batches:
            keep, plain, h1, h2 = [], [], [], []
            for i, (f, t) in enumerate(zip(b.column("field").to_pylist(), b.column("text").to_pylist(), strict=True)):
                if t is not None and len(t.split()) >= min_words and (p := " ".join(words(t))):
                    own = f"{f}\n{p}"
                    keep.append(i), plain.append(p), h1.append(_hash(own, 1) - (1 << 63)), h2.append(_hash(own, 2) - (1 << 63))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(c).take(at) for c in ("field", "side", "id")] + [pa.array(plain, pa.string()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())],
                names=["field", "side", "id", "plain", "a", "b"],
            )

    rows = rows.select("field", "side", F.col("id").cast("string").alias("id"), "text").filter(F.col("id").isNotNull() & F.col("side").isNotNull())
    return rows.mapInArrow(run, "field string, side string, id string, plain string, a long, b long")


def _spots(length: int) -> list[int]:
    """Where the passages of an evaluation text of so many letters begin."""
    last = max(0, length - PASSAGE)
    return sorted({*range(0, last, STRIDE), last})


class _Side:
    """The texts of one side of a cell without spaces, as one array of letters, and what bounds their likeness."""

    def __init__(self, plain: list[str]):
        self.letters = [p.replace(" ", "") for p in plain]
        self.size = np.array([len(x) for x in self.letters], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.codes = np.frombuffer("".join(self.letters).encode("utf-32-le"), np.uint32)
        split = [p.split(" ") for p in plain]
        self.words = np.array([len(w) for w in split], np.int64)
        bit: dict[str, int] = {}
        self.bits = np.zeros(len(plain), np.uint64)
        for i, w in enumerate(split):
            m = 0
            for x in w:
                if x not in bit:
                    bit[x] = 1 << _hash(x) % 64
                m |= bit[x]
            self.bits[i] = m

    def letter_pairs(self, lo: int, hi: int) -> np.ndarray:
        """For each of the texts lo to hi, how often letter pairs of each bin stand in it, up to PAIR_TIMES: so many bits
        of a bin are set. The bits in which two texts differ are the letter pairs in which they differ, or fewer."""
        codes, owner = self.codes[self.start[lo] : self.start[hi]].astype(np.uint64), np.repeat(np.arange(hi - lo), self.size[lo:hi])
        at = np.flatnonzero(owner[:-1] == owner[1:])
        h = (codes[at] * np.uint64(0x9E3779B97F4A7C15) + codes[at + 1]) * np.uint64(0xBF58476D1CE4E5B9)
        n = np.bincount(owner[at] * PAIR_BINS + (h >> np.uint64(56)).astype(np.int64), minlength=(hi - lo) * PAIR_BINS)
        return np.packbits(n[:, None] > np.arange(PAIR_TIMES)).view(np.uint64).reshape(hi - lo, PAIR_BINS * PAIR_TIMES // 64)


class Shard:
    """One automaton over the passages of evaluation texts, and the texts that hold each passage."""

    def __init__(self, plain: list[str]):
        self.side = _Side(plain)
        number: dict[str, int] = {}
        automaton, passage, spot, first = ahocorasick.Automaton(), [], [], [0]
        for x in self.side.letters:
            for s in _spots(len(x)):
                p = x[s : s + PASSAGE]
                if p not in number:
                    number[p] = len(number)
                    automaton.add_word(p, number[p])
                passage.append(number[p]), spot.append(s)
            first.append(len(passage))
        automaton.make_automaton()
        self.automaton, self.known = automaton, len(number)
        #: by text: number and place of its passages
        self.passage, self.spot, self.first = np.array(passage, np.int64), np.array(spot, np.int64), np.array(first, np.int64)

    def scan(self, texts: list[str]) -> np.ndarray:
        """Row x known + passage of every passage found in each text (without spaces), once, in order."""
        rows = [{n for _, n in self.automaton.iter(t)} for t in texts]
        n = np.fromiter(map(len, rows), np.int64, len(rows))
        out = np.repeat(np.arange(len(rows)), n) * self.known + np.fromiter(chain.from_iterable(rows), np.int64, n.sum())
        out.sort()
        return out

    def coverage(self, found: np.ndarray, row: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The share of each evaluation text that the passages found in the row of `found` cover, their intervals merged."""
        n = self.first[text + 1] - self.first[text]
        pair = np.repeat(np.arange(len(text)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.first[text], n)
        want = row[pair] * self.known + self.passage[at]
        place = np.minimum(np.searchsorted(found, want), len(found) - 1)
        hit = found[place] == want if len(found) else np.zeros(len(want), bool)
        pair, spot = pair[hit], self.spot[at[hit]]
        length = np.minimum(self.side.size[text], PASSAGE)[pair]
        same = np.append(False, pair[1:] == pair[:-1])
        new = np.where(same, np.minimum(length, np.diff(spot, prepend=0)), length)
        return np.bincount(pair, new, len(text)) / self.side.size[text]


def _distinct(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in order, and how often each stands there. Sorts `numbers`."""
    numbers.sort()
    at = np.flatnonzero(np.diff(numbers, prepend=-1))
    return numbers[at], np.diff(at, append=len(numbers))


def edits(e: _Side, t: _Side, ie: np.ndarray, it: np.ndarray) -> np.ndarray:
    """The edit distance of pairs of texts of up to 64 x BIT_WORDS letters, by bit vectors over all pairs at once."""
    out = np.zeros(len(ie), np.int64)
    blocks = (e.size[ie] + 63) // 64
    place = np.zeros(int(max(e.codes.max(initial=0), t.codes.max(initial=0))) + 1, np.int32)
    for some in (x for w in np.unique(blocks) for x in _pieces(np.flatnonzero(blocks == w), 4096)):
        some = some[np.argsort(-t.size[it[some]], kind="stable")]
        own, back = np.unique(ie[some], return_inverse=True)
        m, n, width = e.size[ie[some]], t.size[it[some]], int(blocks[some[0]])
        where = np.repeat(np.arange(len(own)), e.size[own])
        inner = np.arange(len(where)) - np.repeat(np.cumsum(e.size[own]) - e.size[own], e.size[own])
        letters = e.codes[e.start[own][where] + inner]
        known = np.unique(letters)
        place[:] = len(known)
        place[known] = np.arange(len(known))
        # eq[w, text, letter]: where in the w-th word of the text the letter stands; the last letter is any other
        eq = np.zeros((width, len(own), len(known) + 1), np.uint64)
        np.bitwise_or.at(eq, (inner // 64, where, place[letters]), np.uint64(1) << (inner % 64).astype(np.uint64))
        up, down = np.full((width, len(some)), ~np.uint64(0)), np.zeros((width, len(some)), np.uint64)
        begin = t.start[it[some]]
        last, score, one = ((m - 1) % 64).astype(np.uint64), m.copy(), np.uint64(1)
        for j in range(int(n[0])):
            k = int(np.searchsorted(-n, -j, "left"))  # pairs whose training text goes on
            s = place[t.codes[begin[:k] + j]]
            more, less = np.ones(k, np.uint64), np.zeros(k, np.uint64)
            for w in range(width):
                q, u, d = eq[w, back[:k], s], up[w, :k], down[w, :k]
                v = q | d
                q |= less
                h = (((q & u) + u) ^ u) | q
                plus, minus = d | ~(h | u), u & h
                if w == width - 1:
                    score[:k] += ((plus >> last[:k]) & one).astype(np.int64) - ((minus >> last[:k]) & one).astype(np.int64)
                plus, more = (plus << one) | more, plus >> np.uint64(63)
                minus, less = (minus << one) | less, minus >> np.uint64(63)
                up[w, :k], down[w, :k] = minus | ~(v | plus), plus & v
        out[some] = score
    return out


def _pieces(numbers: np.ndarray, most: int) -> list[np.ndarray]:
    return np.array_split(numbers, -(-len(numbers) // most)) if len(numbers) else []


def _hashes(side: _Side, lo: int, hi: int) -> np.ndarray:
    """A hash of the PASSAGE letters that begin at each letter of the texts lo to hi; at the end of a text, of letters of
    the next one, too. Equal passages have equal hashes."""
    codes = side.codes[side.start[lo] : side.start[hi]].astype(np.uint64)
    out = np.zeros(max(0, len(codes) - PASSAGE + 1), np.uint64)
    for j in range(PASSAGE):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += codes[j : j + len(out)]
    return (out ^ (out >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)


class _Table:
    """Distinct hashes, and the number of each."""

    def __init__(self, hashes: np.ndarray):
        self.known = np.unique(hashes)
        self.shift = np.uint64(64 - min(24, max(8, int(len(self.known)).bit_length() + 3)))
        slot = (self.known >> self.shift).astype(np.int64)
        n = np.bincount(slot, minlength=1 << (64 - int(self.shift)))
        self.slots = np.full(len(n), -1, np.int32)
        self.slots[slot] = np.arange(len(slot))
        self.slots[n > 1] = -2

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where it is not known."""
        out = self.slots[(hashes >> self.shift).astype(np.int64)]
        many = np.flatnonzero(out == -2)
        out[many] = np.minimum(np.searchsorted(self.known, hashes[many]), len(self.known) - 1)
        at = np.flatnonzero(out >= 0)
        out[at[self.known[out[at]] != hashes[at]]] = -1
        return out


class _Index:
    """The passages of evaluation texts of PASSAGE letters at least, and the training texts that (by hash) hold each."""

    def __init__(self, e: _Side, texts: np.ndarray, t: _Side):
        size = e.size[texts]
        n = -(-(size - PASSAGE) // STRIDE) + 1  # as many as _spots gives, which gives one at least
        self.texts, self.size, self.first = texts, len(t.size), np.concatenate([[0], np.cumsum(n)])
        hashes = np.zeros(self.first[-1], np.uint64)
        for some in _pieces(np.arange(len(texts)), 8192):
            lo, hi = texts[some[0]], texts[some[-1]] + 1
            own = slice(self.first[some[0]], self.first[some[-1] + 1])
            inner = np.arange(own.start, own.stop) - np.repeat(self.first[some], n[some])
            spot = np.minimum(inner * STRIDE, np.repeat(size[some] - PASSAGE, n[some]))
            hashes[own] = _hashes(e, lo, hi)[np.repeat(e.start[texts[some]] - e.start[lo], n[some]) + spot]
        table = _Table(hashes)
        self.passage, keys = table.numbers(hashes), []
        for some in _pieces(np.arange(self.size), 8192):
            lo, hi = some[0], some[-1] + 1
            k = table.numbers(_hashes(t, lo, hi))
            at = np.flatnonzero(k >= 0)
            owner = np.searchsorted(t.start, at + t.start[lo], "right") - 1
            within = at + t.start[lo] + PASSAGE <= t.start[owner + 1]
            own = np.sort(k[at[within]].astype(np.int64) * self.size + owner[within])
            keys.append(own[np.diff(own, prepend=-1) != 0])
        known = len(table.known)
        del table, hashes
        keys = np.concatenate([np.zeros(0, np.int64), *keys])
        keys.sort()
        #: by passage: the training texts that hold it, once each
        self.open = np.searchsorted(keys, np.arange(known + 1) * self.size)
        self.count = np.diff(self.open)
        keys %= max(1, self.size)
        self.holder = keys.astype(np.int32)
        often = np.flatnonzero(self.count * FREQUENT >= max(self.size, LEAST_FREQUENT * FREQUENT))
        often = often[np.argsort(-self.count[often], kind="stable")][:BIT_SETS]
        #: by passage: the row of `bits` (a bit for each training text) of the frequent ones, else -1
        self.row = np.full(known, -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.bits, one = np.zeros((len(often), -(-self.size // 64)), np.uint64), np.zeros(-(-self.size // 64) * 64, bool)
        for i, p in enumerate(often):
            own = self.holder[self.open[p] : self.open[p + 1]]
            one[own] = True
            self.bits[i] = np.packbits(one, bitorder="little").view(np.uint64)
            one[own] = False
        self.octets = self.bits.view(np.uint8)

    def _holders(self, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The training texts that hold each passage, one after the other, and how many."""
        n = self.count[passages]
        return self.holder[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.open[passages], n)], n

    def meetings(self, size: np.ndarray, least: float):
        """Evaluation texts and training texts of all pairs whose passages may cover the share `least`, in blocks.

        Passages begin STRIDE letters apart (the last one at the end) and cover two strides each, so a bit for each
        passage found bounds the coverage. Of texts of more than 63 passages the number found does."""
        wanted, n = least * size[self.texts] - 1e-6, np.diff(self.first)
        for i in np.flatnonzero(n > 63):
            at, shared = _distinct(self._holders(self.passage[self.first[i] : self.first[i + 1]])[0])
            at = at[PASSAGE * shared >= wanted[i]]
            yield np.full(len(at), self.texts[i]), at.astype(np.int64)
        step = max(1, min(BLOCK, AT_ONCE * 4 // (1 + self.bits.shape[1] * LEVELS)))
        for some in _pieces(np.flatnonzero(n <= 63), step):
            c, r = self._block(some, n[some], wanted[some])
            yield self.texts[some[c]], r

    def _block(self, some: np.ndarray, n: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """meetings of the texts `some` (of n passages each), numbered from 0."""
        mine = np.repeat(np.arange(len(some)), n)
        spot = np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n)
        passage = self.passage[self.first[some][mine] + spot]
        row = self.row[passage]
        # the frequent passages of each text, and the training texts that hold one of them, two, ... at least
        often = np.flatnonzero(row >= 0)
        many = np.bincount(mine[often], minlength=len(some))
        place = np.arange(len(often)) - np.repeat(np.cumsum(many) - many, many)
        rows, spots = np.full((many.max(initial=0), len(some)), -1), np.zeros((many.max(initial=0), len(some)), np.uint64)
        rows[place, mine[often]], spots[place, mine[often]] = row[often], spot[often]
        level = np.zeros((len(some), LEVELS, self.bits.shape[1]), np.uint64)
        extra = np.empty(self.bits.shape[1], np.uint64)
        for i, own in enumerate(np.split(row[often], np.cumsum(many)[:-1])):
            up = list(level[i])
            for j, b in enumerate(self.bits[k] for k in own.tolist()):
                for k in range(min(j, LEVELS - 1), 0, -1):
                    if k == j:
                        np.bitwise_and(up[k - 1], b, out=up[k])
                    else:
                        np.bitwise_and(up[k - 1], b, out=extra)
                        np.bitwise_or(up[k], extra, out=up[k])
                np.bitwise_or(up[0], b, out=up[0])
        # training texts that hold rare passages, if the frequent ones they hold may do for the rest
        rare = np.flatnonzero(row < 0)
        at, m = self._holders(passage[rare])
        key = (np.repeat(mine[rare], m) * self.size + at) * 64 + np.repeat(spot[rare], m)
        key.sort()
        pair, bit = key >> 6, np.uint64(1) << (key & 63).astype(np.uint64)
        new = np.flatnonzero(np.diff(pair, prepend=-1))
        pair, mask = pair[new], np.bitwise_or.reduceat(bit, new) if len(new) else bit
        c, r = np.divmod(pair, self.size)
        lack = np.clip(-(-(wanted[c] - _strides(mask)) // PASSAGE), 0, LEVELS).astype(np.int64)  # frequent passages
        may = np.flatnonzero((lack == 0) | ((level.view(np.uint8).reshape(len(some), LEVELS, -1)[c, lack - 1, r >> 3] >> (r & 7).astype(np.uint8)) & 1).astype(bool))
        c, r, mask = c[may], r[may], mask[may]
        # and those that hold frequent passages enough
        lack = np.clip(-(-wanted // PASSAGE), 1, LEVELS).astype(np.int64)
        top = level[np.arange(len(some)), lack - 1].ravel()
        w = np.flatnonzero(top)
        bit = np.flatnonzero(np.unpackbits(top[w].view(np.uint8), bitorder="little"))
        x, y = np.divmod(w[bit >> 6], self.bits.shape[1])
        c, r, mask = np.append(c, x), np.append(r, y * 64 + (bit & 63)), np.append(mask, np.zeros(len(x), np.uint64))
        octet, inner = r >> 3, (r & 7).astype(np.uint8)
        for own, s in zip(rows, spots, strict=True):
            has = np.flatnonzero(own[c] >= 0)
            mask[has] |= ((self.octets[own[c[has]], octet[has]] >> inner[has]) & 1).astype(np.uint64) << s[c[has]]
        enough = np.flatnonzero(_strides(mask) >= wanted[c])
        return np.divmod(_distinct(c[enough] * self.size + r[enough])[0], self.size)


def _strides(mask: np.ndarray) -> np.ndarray:
    """The letters of the strides that passages cover, whose places are the bits of `mask` but the last one."""
    return np.bitwise_count(mask | (mask << np.uint64(1))) * np.int64(STRIDE)


def covered(e_plain: list[str], t_plain: list[str], least: float, similarity: float, spare_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Evaluation text, training text (by number) and coverage of the pairs of plain texts whose coverage reaches `least`
    (above 0) and that may be near.

    Only pairs that cannot be are left out, whatever the texts and however many. Passages are met by hash, which may
    find too many pairs, never too few. An edit changes two letter pairs into two others at most, so copies by
    letters differ in 4 x edits of them; copies by words differ in 2 x spare words of the words.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not e_plain or not t_plain:
        return none
    e, t = _Side(e_plain), _Side(t_plain)
    e_pairs, t_pairs = (np.concatenate([x.letter_pairs(lo, min(lo + 4096, len(x.size))) for lo in range(0, len(x.size), 4096)]) for x in (e, t))
    out = []

    def may_be(c: np.ndarray, r: np.ndarray) -> None:
        x, y = e.size[c], t.size[r]
        most = np.floor(np.maximum(x, y) * (1 - similarity) + 1e-9).astype(np.int64)
        few = (np.abs(e.words[c] - t.words[r]) <= spare_words) & (np.bitwise_count(e.bits[c] ^ t.bits[r]) <= 2 * spare_words)
        close = np.abs(x - y) <= most
        for some in _pieces(np.flatnonzero(close & ~few), 8192):
            close[some] = np.bitwise_count(e_pairs[c[some]] ^ t_pairs[r[some]]).sum(axis=1, dtype=np.uint32) <= 4 * most[some]
        keep = np.flatnonzero(few | close)
        c, r, few, most = c[keep], r[keep], few[keep], most[keep]
        ask = np.flatnonzero(~few & (np.maximum(e.size[c], t.size[r]) <= 64 * BIT_WORDS))
        keep = np.ones(len(c), bool)
        keep[ask] = edits(e, t, c[ask], r[ask]) <= most[ask]
        out.append((c[keep], r[keep]))

    held, n = [], 0
    for some in chain(_short(e, t), _Index(e, np.flatnonzero(e.size >= PASSAGE), t).meetings(e.size, least)):
        held.append(some)
        n += len(some[0])
        if n >= AT_ONCE:
            may_be(*map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if held:
        may_be(*map(np.concatenate, zip(*held, strict=True)))
    if not out:
        return none
    c, r = map(np.concatenate, zip(*out, strict=True))
    return _exactly(e_plain, t.letters, e.size, c.astype(np.int64), r.astype(np.int64), least)


def _short(e: _Side, t: _Side):
    """Evaluation texts of fewer than PASSAGE letters, and the training texts they stand in."""
    texts = np.flatnonzero(e.size < PASSAGE)
    if not len(texts):
        return
    automaton = ahocorasick.Automaton()
    number: dict[str, int] = {}
    for x in texts:
        if e.letters[x]:
            automaton.add_word(e.letters[x], number.setdefault(e.letters[x], len(number)))
    if not number:
        return
    automaton.make_automaton()
    where: list[list[int]] = [[] for _ in number]
    for r, x in enumerate(t.letters):
        for k in {k for _, k in automaton.iter(x)}:
            where[k].append(r)
    for x in texts:
        if e.letters[x] and (at := where[number[e.letters[x]]]):
            yield np.full(len(at), x), np.array(at)


def _exactly(e_plain: list[str], t_letters: list[str], size: np.ndarray, c: np.ndarray, r: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (c, r) whose coverage reaches `least`, and the coverage: an automaton over the passages of the evaluation
    texts scans the training texts."""
    order = np.argsort(c, kind="stable")
    c, r, share = c[order], r[order], np.zeros(len(c))
    own, at, n = np.unique(c, return_index=True, return_counts=True)
    end = at + n
    lo = 0
    while lo < len(own):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(size[own[lo:]]), AUTOMATON_LETTERS, "right")))
        shard, some = Shard([e_plain[i] for i in own[lo:hi].tolist()]), slice(at[lo], end[hi - 1])
        rows, row = np.unique(r[some], return_inverse=True)
        text = np.searchsorted(own[lo:hi], c[some])
        by = np.argsort(row, kind="stable")
        for k in range(0, len(rows), 4096):
            mine = by[np.searchsorted(row[by], k) : np.searchsorted(row[by], k + 4096)]
            found = shard.scan([t_letters[i] for i in rows[k : k + 4096].tolist()])
            for few in _pieces(mine, 1 << 16):
                share[some][few] = shard.coverage(found, row[few] - k, text[few])
        lo = hi
    keep = share >= least
    return c[keep], r[keep], share[keep]


def _cells(texts: DataFrame) -> tuple[DataFrame, int]:
    """`texts` (field, side, a, b, plain) with the cell, each evaluation text once for each slice of the training texts of
    its field and each training text once for each shard of the evaluation texts; and how many cells there are.

    The counts collected are two rows for each field. Texts of a field without the other side have no cell."""
    n = {(r["field"], r["side"]): (r["n"], r["letters"]) for r in texts.groupBy("field", "side").agg(F.count("*").alias("n"), F.sum(F.length(F.replace("plain", F.lit(" "), F.lit("")))).alias("letters")).collect()}
    cells, shape = 0, []
    for f in sorted({f for f, _ in n if f is not None}):
        (ne, le), (nt, lt) = n.get((f, "e"), (0, 0)), n.get((f, "t"), (0, 0))
        if ne and nt:
            shards, slices = max(-(-ne // EVAL_CELL), -(-le // EVAL_LETTERS)), max(-(-nt // TRAIN_CELL), -(-lt // TRAIN_LETTERS), min(LEAST_SLICES, -(-nt // FEW_TRAIN)))
            shape.append((f, shards, slices, cells))
            cells += shards * slices
    grid = texts.sparkSession.createDataFrame(shape, "field string, shards int, slices int, base int")
    at = texts.join(F.broadcast(grid), "field")  # a row for each field
    hashed = F.xxhash64("a", "b")
    own = F.when(F.col("side") == "e", F.pmod(hashed, "shards") * F.col("slices")).otherwise(F.pmod(hashed, "slices"))
    other = F.when(F.col("side") == "e", F.sequence(F.lit(0), F.col("slices") - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.col("shards") - 1), lambda x: x * F.col("slices")))
    return at.select("side", "a", "b", "plain", (F.col("base") + own).cast("int").alias("own"), F.explode(other).alias("other")).select(
        (F.col("own") + F.col("other")).alias("cell"), "side", "a", "b", "plain"
    ), cells


_FOUND = "a_e long, b_e long, a_t long, b_t long, coverage double, e string, t string"


def _grid(texts: DataFrame, least: float, similarity: float, spare_words: int) -> DataFrame:
    """The pairs of `covered` over every evaluation and every training text of a field. A task takes its cells one by one,
    so it holds the bounded number of texts of one cell."""
    at, cells = _cells(texts)
    tasks = max(1, min(cells, MOST_TASKS))

    def one(got: pa.Table) -> list[pa.RecordBatch]:
        left, right = (got.filter(pc.equal(got["side"], s)) for s in "et")
        ie, it, share = covered(left["plain"].to_pylist(), right["plain"].to_pylist(), least, similarity, spare_words)
        x, y = left.take(pa.array(ie)), right.take(pa.array(it))
        out = pa.table([x["a"], x["b"], y["a"], y["b"], pa.array(share, pa.float64()), x["plain"], y["plain"]], names=["a_e", "b_e", "a_t", "b_t", "coverage", "e", "t"])
        return out.combine_chunks().to_batches()

    def run(batches):
        held, cell = [], None
        for b in batches:
            numbers = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if held and numbers[lo] != cell:
                    yield from one(pa.Table.from_batches(held))
                    held = []
                cell = numbers[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from one(pa.Table.from_batches(held))

    placed = at.repartitionById(tasks, F.col("cell") % tasks).sortWithinPartitions("cell")
    return placed.mapInArrow(run, _FOUND)


def near(e: Column, t: Column, similarity: float, spare_words: int) -> Column:
    """Whether plain texts are copies: edit similarity of their letters, or all but a few words in common."""
    x, y = F.replace(e, F.lit(" "), F.lit("")), F.replace(t, F.lit(" "), F.lit(""))
    longest = F.greatest(F.length(x), F.length(y))
    most = F.floor(longest * (1 - similarity)).cast("int")
    close = (F.abs(F.length(x) - F.length(y)) <= most) & (F.levenshtein(x, y) <= most)
    wx, wy = F.split(e, " "), F.split(t, " ")
    few = (F.abs(F.size(wx) - F.size(wy)) <= spare_words) & (F.size(F.array_except(wx, wy)) <= spare_words) & (F.size(F.array_except(wy, wx)) <= spare_words)
    # an edit distance takes time by the product of the lengths, so the words are asked first
    return F.when(few, F.lit(True)).otherwise(close)


class Copies:
    """Evaluation and training rows with (nearly) the same text, as classes of equal texts and pairs of classes.

    `rows`: field, side ('t' or 'e', others are ignored), id, text. Only rows of the same field are compared;
    rows delivered again count once; null ids and texts and texts of fewer than `min_words` words are left out.
    A text that fills a third of the corpus is one class and costs one comparison. No pair is lost: every one whose
    coverage reaches `least_coverage` (above 0) and that `near` accepts is found, at any size of the corpus.
    """

    def __init__(self, rows: DataFrame, min_words: int = 8, least_coverage: float = 0.2, similarity: float = 0.82, spare_words: int = 2):
        if not least_coverage > 0:
            raise ValueError("the least coverage must be above 0")
        plain = checkpointed(plain_texts(rows, min_words))
        #: field, side, a, b, id of every row; a and b name its class
        self.members = plain.select("field", "side", "a", "b", "id").distinct()
        texts = plain.select("field", "side", "a", "b", "plain").distinct()
        found = _grid(texts, least_coverage, similarity, spare_words)
        #: a_e, b_e, a_t, b_t, coverage of every pair of classes
        self.classes = found.filter(near(F.col("e"), F.col("t"), similarity, spare_words)).drop("e", "t")

    def _side(self, s: str) -> DataFrame:
        return self.members.filter(F.col("side") == s).select("field", F.col("a").alias(f"a_{s}"), F.col("b").alias(f"b_{s}"), F.col("id").alias(f"id_{s}"))

    def pairs(self) -> DataFrame:
        """field, id_eval, id_train, coverage of every pair of rows, those of one id with itself too."""
        out = self.classes.join(self._side("e"), ["a_e", "b_e"]).join(self._side("t"), ["field", "a_t", "b_t"])
        return out.select("field", F.col("id_e").alias("id_eval"), F.col("id_t").alias("id_train"), "coverage")

    def records(self) -> DataFrame:
        """field, id_eval, copies, coverage: for each evaluation row with a copy, how many training rows (with its own id
        or another) hold it and the highest coverage. Copies are counted by class, not expanded."""
        size = self.members.filter(F.col("side") == "t").groupBy(F.col("a").alias("a_t"), F.col("b").alias("b_t")).agg(F.count("*").alias("n"))
        per = self.classes.join(size, ["a_t", "b_t"]).groupBy("a_e", "b_e").agg(F.sum("n").alias("copies"), F.max("coverage").alias("coverage"))
        return per.join(self._side("e"), ["a_e", "b_e"]).select("field", F.col("id_e").alias("id_eval"), "copies", "coverage")


def cross_split_copies(rows: DataFrame, **options) -> DataFrame:
    """field, id_eval, id_train, coverage of every pair of an evaluation and a training row of different ids; see Copies."""
    return Copies(rows, **options).pairs().filter(F.col("id_eval") != F.col("id_train"))
