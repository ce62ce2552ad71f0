"""Abusive, hateful or sexual passages: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Texts are brought to a plain form that undoes disguises (accents, look-alike and invisible characters, digits for
letters, spaced-out letters), cut into passages (sentences, long ones in overlapping windows) and described by
hashed word n-grams and skip-grams, once over the words and once with words of a short list replaced by their
class. The reviewers' marks are on whole documents, so a marked document lends its
mark to its passages first and, once models that have not seen the document have scored them, to the worst of them;
marks that those scores contradict clearly are set aside as slips. Per-coordinate learning rates and the L1 term leave a small set of weights, which goes out by broadcast.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.mixing import source_key
from voxloom.llm.normal import latin
from voxloom.runtime import checkpointed, spread

BITS = 20
WINDOW, STEP = 12, 4
#: The most labelled documents a fit uses, picked by a hash of their ids; beyond some ten thousand the weights hardly move.
MAX_LABELLED = 60_000
FOLDS = 4

#: The log-odds of a passage of which nothing is known; it is not learnt, so that few marks cannot raise it.
BIAS = -3.0

#: Below this score by models that did not see it, a marked document counts as a reviewer's slip.
KEEP = 0.06
THRESHOLD = 0.3

# Short lists of words by class. They only give the model a shared name for words of a kind; what a
# class means in its surroundings is learnt.
CLASSES = {
    "insult": "idiot moron imbecile cretin dickhead asshole arsehole bastard bitch bitches scumbag loser pig pigs swine parasite trash scum vermin filth whore slut cunt prick wanker jerk dumbass twat douchebag retard freak subhuman cockroach cockroaches rats animals disease idioten vollidiot trottel arsch arschloch arschlocher schwein schweine fresse hurensohn schlampe hure abschaum ungeziefer missgeburt wichser connard salope pute encule vermine gueule abruti mierda puta idiota cabron gilipollas imbecil escoria basura alimanas",
    "demean": "stupid dumb filthy disgusting pathetic worthless useless brainless hideous ugly fat dirty lazy lying rotten sick dumm dumme dummer widerlich wertlos nutzlos erbarmlich dreckig degoutant stupide sale inutile estupido asqueroso inutil",
    "sexual": "sex sexy fuck fucked fucking cock tits boobs nipples naked nude horny orgasm porn porno pornography stripper breasts pussy cum came blowjob dick thighs undressed moaned moaning bed erotic lick licked titten nackt nackte nacktbilder ficken gefickt fotze schwanz geil baise baiser nus nue nues bite seins desnuda desnudo follar tetas polla cono",
    "threat": "kill killed beat choke hang hanged rope coffin die dies dead shoot shot stab gas sink cage burn break rape murder breathing vanish toten umbringen erschiessen sterben verbrennen verprugeln tuer crever mourir matar morir",
    "group": "refugee immigrant foreigner migrants women cripples muslims jews gays blacks gypsies auslander fluchtlinge frauen juden etrangers refugies femmes extranjeros inmigrantes mujeres",
    "oath": "damn hell shit crap bloody verdammt scheisse putain joder",
}
_CLASS = {w: n for n, ws in enumerate(CLASSES.values(), 1) for w in ws.split()}


def word_class(word: str) -> int:
    """The number of a word's class (from 1), also that of a plural in s; 7 for a word partly hidden by asterisks, else 0."""
    if word == "<cens>":
        return 7
    return _CLASS.get(word) or (_CLASS.get(word[:-1], 0) if len(word) > 4 and word.endswith("s") else 0)


# What is written for letters.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "€": "e"})

_BREAK = re.compile(r"<(?:period|questionmark|exclamationpoint)>|\[\d{1,2}:\d\d(?::\d\d)?\]|[.!?。！？\n]+(?=\s|$|[\"'”’)\]])|\n")
_TAG = re.compile(r"<[^<>]{1,40}>")
_TOKEN = re.compile(r"[\w$@€*]+(?:['’][\w]+)*")
_SPACED = re.compile(r"(?<![\w$@])(?:[\w$@][ .\-_]){3,}[\w$@](?![\w$@])")
_LONG = re.compile(r"(\w)\1{2,}")


def _token(t: str) -> str:
    t = t.replace("’", "'")
    if t.isalpha():
        return _LONG.sub(r"\1", t) if _LONG.search(t) else t
    if "*" in t:
        return "<cens>" if re.search(r"\w", t) else ""
    if t.isdigit():
        return "0"
    if re.search(r"[^\W\d_]", t) or "$" in t:
        u = t.translate(_LEET)
        return u if u != t and re.fullmatch(r"[^\W\d_]+", u) else t
    return t


class Words:
    """The words of a run of texts as numbers, part by part, and the passages laid over them."""

    def __init__(self, number: np.ndarray, size: np.ndarray, doc: np.ndarray):
        """`number`: every word, its class in the lowest three bits; `size`: words of each part; `doc`: text of each part."""
        self.number = number.astype(np.int64) & 0xFFFFFFFF
        first = np.cumsum(size) - size
        # parts above WINDOW words give overlapping windows, each opening STEP words after the one before
        n = np.where(size <= WINDOW, 1, -(-(size - WINDOW) // STEP) + 1)
        part = np.repeat(np.arange(len(size)), n)
        step = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STEP
        self.start, self.doc = first[part] + step, doc[part]
        self.size = np.minimum(size[part] - step, WINDOW)

    def features(self, ids: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """(feature, place in `ids`) for every feature of the passages `ids`, by passage."""
        n = self.size[ids]
        if not n.sum():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        v = self.number[np.repeat(self.start[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        cls = v & 7
        word = (v >> 3).astype(np.uint64)
        mixed = np.where(cls > 0, cls.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), word)
        where = np.repeat(np.arange(len(n)), n)
        out, at = [], []

        def add(kind: int, v: np.ndarray, gaps: tuple[int, ...], need: np.ndarray | None) -> None:
            far = gaps[-1] if gaps else 0
            m = len(v) - far
            if m <= 0:
                return
            ok = where[:m] == where[far:]
            if need is not None:
                use = need[:m].copy()
                for g in gaps:
                    use |= need[g : g + m]
                ok &= use
            k = np.flatnonzero(ok)
            h = v[k] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kind)
            for g in gaps:
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + v[k + g]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
            out.append((h >> np.uint64(64 - BITS)).astype(np.int64)), at.append(where[k])

        with np.errstate(over="ignore"):
            for kind, gaps in enumerate(((), (1,), (2,), (3,), (1, 2))):
                add(kind, word, gaps, None)
                add(kind + 16, mixed, gaps, cls > 0)
        return np.concatenate(out), np.concatenate(at)


class Reader:
    """Texts to words as numbers."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def _number(self, token: str) -> int:
        """29 bits of a hash of the word a token stands for and 3 of its class; -1 for none."""
        if len(self.seen) > 500_000:
            self.seen.clear()
        w = _token(token)
        n = self.seen[token] = (zlib.crc32(w.encode()) >> 3 << 3) | word_class(w) if w else -1
        return n

    def parts(self, text: str | None) -> list[list[int]]:
        """The words of each part (sentence) of a text; none for null, empty and blank ones."""
        if not text:
            return []
        seen, out, plain = self.seen, [], latin(text)
        tagged, spaced = "<" in plain, bool(_SPACED.search(plain)) or "<" in plain
        for part in _BREAK.split(plain):
            if tagged:
                part = _TAG.sub(" ", part)
            if spaced:
                part = _SPACED.sub(lambda m: re.sub(r"[ .\-_]", "", m[0]), part)
            w = [n for t in _TOKEN.findall(part) if (n := seen[t] if t in seen else self._number(t)) >= 0]
            if w:
                out.append(w)
        return out

    def words(self, texts: list[str | None]) -> Words:
        parts, doc = [], []
        for k, t in enumerate(texts):
            p = self.parts(t)
            parts.extend(p), doc.extend([k] * len(p))
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        return Words(np.fromiter(chain.from_iterable(parts), np.int64, size.sum()), size, np.array(doc, np.int64))


@dataclass
class Ftrl:
    """FTRL-proximal logistic regression, updated by small batches of passages."""

    alpha: float = 0.15
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 0.5

    def __post_init__(self) -> None:
        self.z = np.zeros(1 << BITS)
        self.n = np.zeros(1 << BITS)
        self.at = np.zeros(1 << BITS, np.int32)

    def weights(self) -> np.ndarray:
        return self._weights(self.z, np.sqrt(self.n))

    def _weights(self, z: np.ndarray, root: np.ndarray) -> np.ndarray:
        shrunk = np.copysign(np.maximum(np.abs(z) - self.l1, 0.0), z)
        return -shrunk / ((self.beta + root) / self.alpha + self.l2)

    def batch(self, feature: np.ndarray, passage: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """One step; passages are numbered from 0."""
        i = np.sort(feature)
        i = i[np.flatnonzero(np.diff(i, prepend=-1))]
        self.at[i] = np.arange(len(i), dtype=np.int32)
        back = self.at[feature]
        z, n = self.z[i], self.n[i]
        root = np.sqrt(n)
        w = self._weights(z, root)
        p = 1 / (1 + np.exp(-np.clip(np.bincount(passage, w[back], len(y)) + BIAS, -30, 30)))
        g = np.bincount(back, ((p - y) * weight)[passage], len(i))
        n += g * g
        self.z[i] = z + g - (np.sqrt(n) - root) / self.alpha * w
        self.n[i] = n


def _scores(w: np.ndarray, feature: np.ndarray, passage: np.ndarray, n: int) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.bincount(passage, w[feature], n) + BIAS, -30, 30)))


class Marked:
    """The passages of marked documents as words, and their features, held compactly."""

    def __init__(self, words: Words, marks: np.ndarray, chunk: int = 20_000):
        pieces, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for k in range(0, len(words.doc), chunk):
            ids = np.arange(k, min(k + chunk, len(words.doc)))
            feature, passage = words.features(ids)
            pieces.append(feature[np.argsort(passage, kind="stable")].astype(np.int32))
            counts.append(np.bincount(passage, minlength=len(ids)))
        self.mark, self.doc = marks, words.doc
        self.feature = np.concatenate(pieces)
        self.first = np.append(0, np.cumsum(np.concatenate(counts))).astype(np.int64)

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(feature, place in `ids`) of the passages `ids`."""
        n = self.first[ids + 1] - self.first[ids]
        at = np.repeat(self.first[ids] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        return self.feature[at], np.repeat(np.arange(len(ids)), n)

    def scores(self, w: np.ndarray) -> np.ndarray:
        out = [np.zeros(0)]
        for k in range(0, len(self.doc), 20_000):
            ids = np.arange(k, min(k + 20_000, len(self.doc)))
            out.append(_scores(w, *self.of(ids), len(ids)))
        return np.concatenate(out)

    def targets(self, p: np.ndarray | None, lift: float) -> tuple[np.ndarray, np.ndarray]:
        """What each passage should score, and its weight, given the scores of a round before (or none)."""
        bad = self.mark[self.doc] > 0
        if p is None:
            share = np.maximum(1, np.bincount(self.doc, minlength=len(self.mark)))[self.doc] ** 0.75
            return bad.astype(float), np.where(bad, lift / share, 1.0)
        worst = np.zeros(len(self.mark))
        np.maximum.at(worst, self.doc, p)
        worst = worst[self.doc]
        top = p >= 0.6 * worst
        # marks that the scores contradict and the undecided passages of marked documents are set aside
        lent = np.where(top, np.where(worst > KEEP, lift, 0.0), np.where(p < 0.2, 1.0, 0.0))
        return (bad & top).astype(float), np.where(bad, lent, np.where(worst > 0.8, 0.0, 1.0))

    def learn(self, y: np.ndarray, weight: np.ndarray, epochs: int, size: int = 512, seed: int = 5) -> np.ndarray:
        model, rng, use = Ftrl(), np.random.default_rng(seed), np.flatnonzero(weight > 0)
        for _ in range(epochs):
            rng.shuffle(use)
            for k in range(0, len(use), size):
                ids = use[k : k + size]
                model.batch(*self.of(ids), y[ids], weight[ids])
        return model.weights()


def fit(m: Marked, out: np.ndarray | None = None, prior: np.ndarray | None = None, epochs: int = 3, lift: float = 6.0) -> np.ndarray:
    """The weights (one for each hash) learnt from marked documents; without both marks, zeros, which find nothing. `out` marks documents left out; `prior` are passage scores by models that did not see them."""
    seen = np.ones(len(m.mark), bool) if out is None else ~out
    if not len(m.doc) or not 0 < m.mark[seen].sum() < seen.sum():
        return np.zeros(1 << BITS)
    for p in ((None, "own") if prior is None else (prior,)):
        y, weight = m.targets(m.scores(w) if isinstance(p, str) else p, lift)  # noqa: F821
        w = m.learn(y, weight * seen[m.doc], epochs)
    return w


def fold(ids: np.ndarray, folds: int) -> np.ndarray:
    """The fold of each document, from its id."""
    return np.array([zlib.crc32(str(i).encode()) % folds for i in ids], np.int64)


def score_texts(w: np.ndarray, texts: list[str | None], reader: Reader) -> list[float]:
    """The score of each text: that of its worst passage, 0 without one."""
    words = reader.words(texts)
    worst = np.zeros(len(texts))
    for k in range(0, len(words.doc), 20_000):
        feature, passage = words.features(slice(k, k + 20_000))
        doc = words.doc[k : k + 20_000]
        np.maximum.at(worst, doc, _scores(w, feature, passage, len(doc)))
    return worst.tolist()


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists in one run, and the length of each list; null lists are empty."""
    size = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False), np.where(column.is_valid().to_numpy(zero_copy_only=False), size, 0)


def marked_words(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """doc_id, toxic, number and size (see Words) of at most `max_labelled` marked documents, chosen by a hash of their ids.

    Documents of one id count as one, that of the least text; marks of one id as their highest. Null marks, null ids and
    marks of unknown documents are left out. The marks sent to all are bounded by `max_labelled`.
    """
    chosen = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = spread(docs.select("doc_id", "text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), "text")

    def run(batches):
        reader = Reader()
        for b in batches:
            parts = [reader.parts(t) for t in b.column("text").to_pylist()]
            number = [np.fromiter(chain.from_iterable(p), np.uint32).view(np.int32) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("toxic"), pa.array(number, pa.list_(pa.int32())), pa.array([list(map(len, p)) for p in parts], pa.list_(pa.int32()))],
                names=["doc_id", "toxic", "number", "size"],
            )

    words = rows.mapInArrow(run, "doc_id long, toxic int, number array<int>, size array<int>")
    return words.groupBy("doc_id", "toxic").agg(F.min(F.struct("number", "size")).alias("w")).select("doc_id", "toxic", "w.*")


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> np.ndarray:
    """Weights from the marks in `labels` (doc_id, toxic); see marked_words.

    FOLDS tasks fit a model each, with one fold left out and scored; then one task fits the final model. What these
    tasks hold is bounded by `max_labelled`. Texts are read once, where they lie; the tasks get numbers for words.
    """
    rows = checkpointed(marked_words(docs, labels, max_labelled))

    def gathered(batches):
        """The rows of a task in the order of their ids."""
        held = [b for b in batches if b.num_rows]
        return pa.Table.from_batches(held).sort_by("doc_id").combine_chunks().to_batches()[0] if held else None

    def marked(got: pa.RecordBatch) -> Marked:
        (number, _), (size, parts) = _lists(got.column("number")), _lists(got.column("size"))
        return Marked(Words(number, size.astype(np.int64), np.repeat(np.arange(got.num_rows), parts)), got.column("toxic").to_numpy().astype(np.int64))

    def judge(batches):
        """Passage scores of one fold by a model of the others."""
        got = gathered(batches)
        if got is None:
            return
        m, ids = marked(got), got.column("doc_id").to_numpy()
        own = fold(ids, FOLDS) == got.column("fold")[0].as_py()
        p, first = m.scores(fit(m, own)), np.searchsorted(m.doc, np.arange(len(ids) + 1))
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array([p[first[k] : first[k + 1]] for k in at], pa.list_(pa.float64()))], names=["doc_id", "p"])

    each = rows.select("*", F.explode(F.array(*(F.lit(k) for k in range(FOLDS)))).alias("fold")).repartitionById(FOLDS, F.col("fold"))
    apart = each.mapInArrow(judge, "doc_id long, p array<double>")

    def final(batches):
        got = gathered(batches)
        if got is not None:
            w = fit(marked(got), prior=_lists(got.column("p"))[0])
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at])], names=["i", "w"])

    both = rows.join(apart, "doc_id", "left")
    out = both.repartition(1).mapInArrow(final, "i long, w double").toPandas()
    w = np.zeros(1 << BITS)
    w[out["i"].to_numpy(np.int64)] = out["w"].to_numpy()
    return w


def scored(docs: DataFrame, w: np.ndarray, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """`keep` and the score (0 to 1) of every row; null and empty texts score 0. One narrow stage, no shuffle."""
    at = np.flatnonzero(w)
    shared = docs.sparkSession.sparkContext.broadcast((at, w[at].astype(np.float32)))

    def run(batches):
        full = np.zeros(1 << BITS)
        full[shared.value[0]] = shared.value[1]
        reader = Reader()
        for b in batches:
            s = score_texts(full, b.column(0).to_pylist(), reader)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(s, pa.float64())], names=[*keep, "score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", score double"
    return spread(docs.select("text", *keep)).mapInArrow(run, schema)


def rates(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """source, documents, found, rate and mean score per plain source name."""
    found = F.col("score") >= threshold
    one = scores.groupBy(F.coalesce(source_key(F.col("source")), F.lit("unknown")).alias("source"))
    return one.agg(F.count("*").alias("documents"), F.count_if(found).alias("found"), F.avg(found.cast("double")).alias("rate"), F.avg("score").alias("mean_score"))
