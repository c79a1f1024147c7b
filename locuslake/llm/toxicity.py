"""Toxicity by noisy-channel deobfuscation and a score of the restored text.

A character model of the corpus decodes what looks disguised: words with digits or signs
among letters, letters repeated three or more times, separators inside words, and runs of
single characters. Each position of such a word is a lattice column of the letters it may
stand for, or none; the Viterbi path of the best product of channel and character model is
the restored word. In long words and runs, which may hold several words, the path also sets
word boundaries. Evidence of words and word beginnings is then pooled by document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, in_fold, table, text_bytes
from .labelled import training_rows

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

# Letters that a sign may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "tl", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "[": "c", "€": "e", "£": "l", "¡": "i", "%": "o", "&": "a", "*": "aeiou", "#": "aeiouh",
}
SEPARATORS = frozenset(".-_*~'`^,:;/\\|+=#​­·")
ORDER = 4
_RUN = re.compile(rb"(?:(?<=[\x20\x09-\x0D])|\A)(?:[^\x20\x09-\x0D\x80-\xff]|[\xc2-\xdf][\x80-\xbf])(?:[\x20\x09-\x0D]+(?:[^\x20\x09-\x0D\x80-\xff]|[\xc2-\xdf][\x80-\xbf])){2,}(?=[\x20\x09-\x0D]|\Z)")
_REPEATED = re.compile(r"(.)\1\1")
_RUNS = re.compile(r"(.)\1\1+")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_GAP = re.compile(r"[\x20\x09-\x0D]{2,}")
_OUTER = ".,;:?\"'()[]{}!*#%&~`-_|<>=/\\"
_BETWEEN = re.compile(r"(?:[^\w@$!|+]|_)+")


@dataclass
class CharacterModel:
    """Log probabilities of a character after the three before it, by interpolated counts; "^" begins and "$" ends a word."""

    counts: list[dict[str, int]] = field(default_factory=lambda: [{} for _ in range(ORDER)])
    size: int = 64

    @staticmethod
    def of(grams: Iterable[tuple[str, int]]) -> CharacterModel:
        """From the runs of ``ORDER`` characters, each with its count; shorter runs are their ends."""
        model = CharacterModel()
        for gram, n in grams:
            for k in range(ORDER):
                own, before = gram[ORDER - 1 - k :], gram[ORDER - 1 - k : -1]
                model.counts[k][own] = model.counts[k].get(own, 0) + n
                model.totals[k][before] = model.totals[k].get(before, 0) + n
        model.size = len(model.counts[0]) + 1
        return model

    def __post_init__(self):
        self.totals = [{} for _ in range(ORDER)]
        self._seen: dict[str, float] = {}

    def logp(self, history: str, char: str) -> float:
        key = history + char
        if (p := self._seen.get(key)) is None:
            q = 1 / self.size
            for k in range(ORDER):
                h = history[len(history) - k :]
                n = self.totals[k].get(h, 0)
                q = (self.counts[k].get(h + char, 0) + 2 * q) / (n + 2)
            if len(self._seen) > 500_000:
                self._seen.clear()
            p = self._seen[key] = math.log(q)
        return p


#: Channel: log probabilities of a sign written for a letter, a letter repeated, a separator put in.
SUBSTITUTED, REPEATED, INSERTED, KEPT = math.log(0.3), math.log(0.3), math.log(0.3), math.log(0.9)


def decode(word: str, model: CharacterModel, beam: int = 24) -> str:
    """Viterbi path through the lattice of a disguised lower-case word. States are the last three characters."""
    states: dict[str, tuple[float, str]] = {"^" * (ORDER - 1): (0.0, "")}
    extra = {i for m in _RUNS.finditer(word) for i in range(m.start() + 1, m.end())}  # of a run of three or more
    for i, c in enumerate(word):
        following: dict[str, tuple[float, str]] = {}

        def reach(state: str, p: float, text: str) -> None:
            if state not in following or p > following[state][0]:
                following[state] = (p, text)

        letters = [(c, KEPT)] if c.isalpha() else [(x, SUBSTITUTED) for x in STANDS_FOR.get(c, "")]
        for state, (p, text) in states.items():
            if not c.isalpha() and (c in SEPARATORS or not letters):
                reach(state, p + INSERTED, text)
            if i in extra and text and (text[-1] == c or not c.isalpha()):
                reach(state, p + REPEATED, text)
            for x, cost in letters:
                reach(state[1:] + x, p + cost + model.logp(state, x), text + x)
        states = dict(sorted(following.items(), key=lambda s: -s[1][0])[:beam]) if len(following) > beam else following
        if not states:
            return ""
    return max(((p + model.logp(s, "\n"), t) for s, (p, t) in states.items()))[1]


def plain(word: str) -> str:
    """Lower case, without what isn't a letter at both ends."""
    word = word.lower()
    a, b = 0, len(word)
    while a < b and not word[a].isalpha():
        a += 1
    while b > a and not word[b - 1].isalpha():
        b -= 1
    return word[a:b]


def segmented(text: str, model: CharacterModel, beam: int = 24) -> list[str]:
    """Words of the Viterbi path through the lattice of a lower-case text in which a word may end before any position."""
    start = "^" * (ORDER - 1)
    states: dict[str, tuple[float, tuple | None]] = {start: (0.0, None)}
    extra = {i for m in _RUNS.finditer(text) for i in range(m.start() + 1, m.end())}
    for i, c in enumerate(text):
        if ended := [(p + model.logp(s, "\n"), path) for s, (p, path) in states.items() if s != start]:
            p, path = max(ended, key=lambda e: e[0])
            if start not in states or p > states[start][0]:
                states[start] = (p, (" ", path))
        following: dict[str, tuple[float, tuple | None]] = {}
        alpha = c.isalpha()
        letters = [(c, KEPT)] if alpha else [(x, SUBSTITUTED) for x in STANDS_FOR.get(c, "")]
        inserted = not alpha and (c in SEPARATORS or not letters)
        for state, (p, path) in states.items():
            last = state[-1]
            stay = p + INSERTED if inserted else p + REPEATED if i in extra and last != "^" and (last == c or not alpha) else None
            if stay is not None and (state not in following or stay > following[state][0]):
                following[state] = (stay, path)
            for x, cost in letters:
                q, to = p + cost + model.logp(state, x), state[1:] + x
                if to not in following or q > following[to][0]:
                    following[to] = (q, (x, path))
        states = dict(sorted(following.items(), key=lambda s: -s[1][0])[:beam]) if len(following) > beam else following
    path, found = max(((p + (model.logp(s, "\n") if s != start else 0.0), path) for s, (p, path) in states.items()), key=lambda e: e[0])[1], []
    while path:
        found.append(path[0])
        path = path[1]
    return "".join(reversed(found)).split()


def _word_forms(raw: str, model: CharacterModel) -> list[str]:
    bare = plain(raw)
    out = [bare] if bare else []
    if (bare and not bare.isalpha()) or _REPEATED.search(bare):
        out.append(decode(bare, model))
    outer = raw.strip(_OUTER) if not raw.isalpha() else bare
    if outer != bare and len(outer) > 2 and any(c.isalpha() for c in outer) and outer[0] + outer[-1] != bare[:1] + bare[-1:]:
        out.append(decode(outer, model))
    return out


def forms(word: bytes, model: CharacterModel, limit: int = 40) -> list[tuple[str, ...]]:
    """For each word that a word or run may hold, its forms: without outer signs, and decoded where it looks disguised.

    A word of up to ``limit`` characters is one word, and its parts between signs are forms of
    it. A longer one (addresses, tokens, texts without spaces) and a run of single characters
    hold many: those between signs or wide gaps, and those of the path with word boundaries,
    each as often as the reading that has it most often.
    """
    raw = word.decode("utf-8", "replace").lower()
    outer = raw.strip(_OUTER)
    if outer.isalpha() and len(raw) <= limit and not _REPEATED.search(outer):
        return [(outer,)]  # most words: the steps below would give the same
    run = _SPACE.search(raw)
    if not run and len(raw) <= limit:
        out = _word_forms(raw, model)
        if out and not out[0].isalpha() and len(parts := [x for x in _BETWEEN.split(out[0]) if len(x) > 1]) > 1:
            out += [x if x.isalpha() else decode(x, model) for x in parts]
        return [tuple(dict.fromkeys(x for x in out if x))]
    joined = _SPACE.sub("", raw)
    parts = [_SPACE.sub("", x) for x in _GAP.split(raw)] if run else _BETWEEN.split(plain(raw))
    read = Counter(x for part in parts if len(part) <= limit for x in _word_forms(part, model)[-1:] if x)
    return [(x,) for x in (read | Counter(segmented(joined, model))).elements()]


def joined_runs(text: bytes) -> list[bytes]:
    """Runs of three or more single characters, with the spaces between."""
    return [m.group() for m in _RUN.finditer(text)]


def evidence(form: str) -> list[str]:
    """Features of a restored word: itself, and its beginnings of four letters and more."""
    return ["=" + form] + ["^" + form[:k] for k in range(4, min(len(form), 9) + 1)]


def stems(features: Iterable[str]) -> frozenset[str]:
    """First four letters of the features; a word that begins otherwise has none of them."""
    return frozenset(f[1:5] for f in features)


POOLED = 8


def pooled(scores: np.ndarray) -> np.ndarray:
    """Best scores and their density in a document."""
    top = np.zeros(4)
    if len(scores):
        best = np.sort(scores)[::-1][:4]
        top[: len(best)] = best
    strong = int((scores > 2.5).sum())
    return np.array([top[0], top[1], top[2], top[3], math.log1p(strong), strong / math.sqrt(len(scores) + 1), float(top[0] > 2.5), float(top[1] > 2.5)])


@dataclass
class ToxicityModel:
    characters: CharacterModel
    weights: dict[str, float]
    bias: float
    pool: np.ndarray

    def __post_init__(self):
        self.stems = stems(self.weights)

    def word_score(self, form: str) -> float:
        if form[:4] not in self.stems:
            return 0.0
        return max((self.weights.get(f, 0.0) for f in evidence(form)), default=0.0)


_NONE = (0.0,)


class Scorer:
    """Scores texts; results by word are kept while there are at most ``limit`` of them."""

    def __init__(self, model: ToxicityModel, limit: int = 1_000_000):
        self.model, self.limit = model, limit
        outer = self

        class Cache(dict):
            def __missing__(self, word: bytes) -> tuple[float, ...]:
                if len(self) >= outer.limit:
                    self.clear()
                s = tuple(max(map(model.word_score, found), default=0.0) for found in forms(word, model.characters))
                self[word] = s = _NONE if s == _NONE else s
                return s

        self.by_word = Cache()

    def logit(self, text: bytes) -> float:
        words = text.split()
        words += joined_runs(text)
        scores = np.fromiter(chain.from_iterable(map(self.by_word.__getitem__, words)), np.float64)
        return self.model.bias + float(self.model.pool @ pooled(scores))


def _weight(a: int, b: int, positives: int, negatives: int) -> float:
    """Shrunk log odds of a feature by the documents that have it, a of them positive; 0 unless two or more speak for it."""
    if a < 2:
        return 0.0
    return max(0.0, math.log((a + 0.1) / (positives + 1)) - math.log((b + 0.5) / (negatives + 1)))


def _grams(words: Counter) -> Counter:
    """Runs of ``ORDER`` characters, each ending in the word or at its end, of words that are letters alone."""
    spelled, out = Counter(), Counter()
    for w, n in words.items():
        bare = plain(w.decode("utf-8", "replace"))
        if bare.isalpha() and not _REPEATED.search(bare):
            spelled[bare] += n
    for word, n in spelled.items():
        padded = "^" * (ORDER - 1) + word + "\n"
        for i in range(len(word) + 1):
            out[padded[i : i + ORDER]] += n
    return out


def _characters(rows: DataFrame, limit: int = 400_000) -> CharacterModel:
    """Character model of all texts: each task counts its own, and counts are added up."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams = Counter(), Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], names=["gram", "n"])
            grams.clear()
            return batch

        for batch in batches:
            for text in text_bytes(batch.column("text")):
                words.update(text.split())
                if len(words) > limit:
                    grams.update(_grams(words))
                    words.clear()
            if len(grams) > limit:
                yield out()
        grams.update(_grams(words))
        yield out()

    found = rows.select("text").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    return CharacterModel.of(zip(found.column("gram").to_pylist(), found.column("n").to_pylist()))


def _read(rows: DataFrame, characters: CharacterModel, limit: int = 400_000) -> DataFrame:
    """(label, n, forms, counts): of each text the number of words that its words and runs may hold, and the forms of these, one to a line, each with its count; a word may come more than once."""
    shared = rows.sparkSession.sparkContext.broadcast(characters)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = [""]
        several: dict[int, list[int]] = {}

        class Places(dict):
            """By word the place of its forms; below 0 where a word holds none or several."""

            def __missing__(self, word: bytes) -> int:
                found = ["\n".join(g) for g in forms(word, shared.value)]
                at = list(range(len(held), len(held) + len(found)))
                held.extend(found)
                if len(at) != 1 or not found[0]:
                    several[-len(self) - 1] = [k if x else 0 for k, x in zip(at, found)]
                    at = [-len(self) - 1]
                self[word] = at[0]
                return at[0]

        places = Places()
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch, n, ends, at, times = whole.slice(first, 500), [], [0], [], []
                if len(held) > limit:
                    held[:] = [""]
                    several.clear()
                    places.clear()
                for text in text_bytes(batch.column("text")):
                    words = text.split() + joined_runs(text)
                    used, k = np.unique(np.fromiter(map(places.__getitem__, words), np.int64, len(words)), return_counts=True)
                    odd = int(np.searchsorted(used, 0))
                    more = [(x, c) for w, c in zip(used[:odd].tolist(), k[:odd].tolist()) for x in several[w]]
                    n.append(int(k[odd:].sum()) + sum(c for _, c in more))
                    more = [m for m in more if m[0]]
                    at += [used[odd:], np.array([x for x, _ in more], np.int64)]
                    times += [k[odd:], np.array([c for _, c in more], np.int64)]
                    ends.append(ends[-1] + len(used) - odd + len(more))
                ends, found = pa.array(ends, pa.int32()), pa.array(held, pa.string()).take(pa.array(np.concatenate(at)))
                lists = [pa.ListArray.from_arrays(ends, found), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(times), pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column("label").cast(pa.int32()), pa.array(n, pa.int32()), *lists], names=["label", "n", "forms", "counts"])

    return rows.mapInArrow(run, "label int, n int, forms array<string>, counts array<int>")


def _slices(batches: Iterable[pa.RecordBatch], rows: int = 2500) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so that what is made of one stays small."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def _numbered(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Ends of the lists from 0 on, their values as numbers, and the values by number."""
    coded = lists.flatten().dictionary_encode()
    sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _features(groups: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """As ``_numbered``: the evidence of all forms of each group."""
    split = pc.split_pattern(groups, "\n")
    form, group = split.flatten(), pc.list_parent_indices(split).to_numpy(zero_copy_only=False).astype(np.int64)
    size = pc.utf8_length(form)
    text, owner = [pc.binary_join_element_wise("=", form, "")], [group]
    for k in range(4, 10):
        long = pc.greater_equal(size, k)
        text.append(pc.binary_join_element_wise("^", pc.utf8_slice_codeunits(form.filter(long), 0, k), ""))
        owner.append(group[long.to_numpy(zero_copy_only=False)])
    coded, owner = pa.concat_arrays(text).dictionary_encode(), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(groups)))])
    return ends, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[order], coded.dictionary


def _frequencies(read: DataFrame) -> DataFrame:
    """(feature, n1, n0): the number of texts of either label that have a feature."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ends, at, groups = _numbered(batch.column("forms"))
            if not len(groups):
                continue
            starts, features, names = _features(groups)
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            n = np.zeros((2, len(names)), np.int64)
            for first in range(0, batch.num_rows, 500):
                last = min(first + 500, batch.num_rows)
                own = at[ends[first] : ends[last]]
                doc = np.repeat(np.arange(first, last), np.diff(ends[first : last + 1]))
                many = starts[own + 1] - starts[own]
                place = np.repeat(starts[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                pairs = np.unique(np.repeat(doc, many) * len(names) + features[place])
                doc, have = np.divmod(pairs, len(names))
                for y in (0, 1):
                    n[y] += np.bincount(have[labels[doc] == y], minlength=len(names))
            yield pa.RecordBatch.from_arrays([names, pa.array(n[1]), pa.array(n[0])], names=["feature", "n1", "n0"])

    return read.select("label", "forms").mapInArrow(run, "feature string, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def _left_out(read: DataFrame, counts: dict[str, tuple[int, int]], positives: int, negatives: int) -> DataFrame:
    """(label, x): what each text pools when its own part in the counts is left out."""
    shared = read.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        begun = stems(known)

        def value(group: str, y: int) -> float:
            best = max((_weight(known[f][0] - y, known[f][1] - (1 - y), positives, negatives) for x in group.split("\n") if x[:4] in begun for f in evidence(x) if f in known), default=0.0)
            return best if best > 1 else 0.0

        for batch in _slices(batches):
            ends, at, groups = _numbered(batch.column("forms"))
            groups, times = groups.to_pylist(), batch.column("counts").flatten().to_numpy(zero_copy_only=False)
            labels, sizes = batch.column("label").to_numpy(zero_copy_only=False), batch.column("n").to_pylist()
            values = np.zeros((2, len(groups)))
            for y in (0, 1):
                for g in np.unique(at[np.repeat(labels == y, np.diff(ends))]).tolist():
                    values[y, g] = value(groups[g], y)
            rows = []
            for k, (y, n) in enumerate(zip(labels, sizes)):
                own = slice(ends[k], ends[k + 1])
                some = np.repeat(values[y, at[own]], times[own])
                some, s = some[some > 0], np.zeros(n)
                s[: len(some)] = some
                rows.append(pooled(s))
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["label", "x"])

    return read.mapInArrow(run, "label int, x array<double>")


def _logistic(rows: DataFrame, ridge: np.ndarray) -> np.ndarray:
    """Weights of x and, last, of a constant by Newton's method; the sums over all rows of each step are made on the executors."""
    w = np.zeros(len(ridge))
    for _ in range(50):

        def run(batches: Iterable[pa.RecordBatch], w: np.ndarray = w) -> Iterator[pa.RecordBatch]:
            grad, curve = np.zeros(len(w)), np.zeros((len(w), len(w)))
            for batch in batches:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                x1 = np.concatenate([x, np.ones((len(x), 1))], 1)
                p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
                grad += x1.T @ (p - batch.column("label").to_numpy(zero_copy_only=False))
                curve += (x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([grad, curve.ravel()])], pa.list_(pa.float64()))], names=["sums"])

        sums = np.sum(rows.mapInArrow(run, "sums array<double>").toArrow().column("sums").to_pylist(), 0)
        step = np.linalg.solve(sums[len(w) :].reshape(len(w), -1) + np.diag(ridge), sums[: len(w)] + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", modulus: int = 4, held_out: int | None = None) -> ToxicityModel:
    """Fits on all labelled rows outside the held-out fold, or on all if that is None: character model, evidence by document frequency, and logistic pooling of left-one-out evidence.

    Texts stay on the executors. The driver gets counts of runs of characters, the features that
    speak for the label and, for each step of the last fit, sums.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(training_rows(docs, labels, label=label, modulus=modulus, held_out=held_out), "rows")
    characters = _characters(rows)
    read = scratch.save(_read(rows, characters), "read")
    scratch.drop("rows")
    by_label = {r["label"]: r["count"] for r in read.groupBy("label").count().collect()}
    positives, negatives = by_label.get(1, 0), by_label.get(0, 0)
    if not positives or not negatives:
        scratch.drop("read")
        mean = (positives + 0.05) / (positives + negatives + 1)  # without labels nothing is taken for toxic
        return ToxicityModel(characters, {}, math.log(mean / (1 - mean)), np.zeros(POOLED))
    most = F.log((F.col("n1") + 0.1) / (positives + 1)) - F.log((F.greatest("n0", F.lit(1)) - 0.5) / (negatives + 1))  # of a text that is left out
    found = _frequencies(read).where((F.col("n1") > 1) & (most > 0.99)).toArrow()
    counts = dict(zip(found.column("feature").to_pylist(), zip(found.column("n1").to_pylist(), found.column("n0").to_pylist())))
    weights = {f: w for f, (a, b) in counts.items() if (w := _weight(a, b, positives, negatives)) > 1}
    left = scratch.save(_left_out(read, counts, positives, negatives), "left")
    scratch.drop("read")
    w = _logistic(left, np.array([1.0] * POOLED + [1e-6]))
    scratch.drop("left")
    return ToxicityModel(characters, weights, float(w[-1]), w[:-1])


def score(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The rows with all their columns and ``score_col`` added, which must not be among them.

    A null text counts as empty and gets the score of an empty one. Repeated rows repeat.
    """
    if score_col in docs.columns:
        raise ValueError(f"the table already has a column {score_col}")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            logits = np.array([scorer.logit(t or b"") for t in text_bytes(batch.column(at))])
            p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, score_col])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))


def classify(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 4, held_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """One row per document (schema ``SCHEMA``); null ids stay null, other columns are not read."""
    ids = docs[id_col].cast("long")
    rows = docs.select(ids.alias("doc_id"), in_fold(ids, modulus, held_out).alias("held_out"), docs[text_col].cast("string").alias("text"))
    return score(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels"), held_out=2))
