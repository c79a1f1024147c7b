"""Quality classifier: a factorisation machine over hashed words, structure and length.

Every document is a sparse vector: hashed words, and binned statistics of its structure and
size. The machine scores it with a linear term and all pairwise interactions of low rank,
in time linear in the vector by the identity
``sum_{i<j} <v_i, v_j> x_i x_j = (|sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2) / 2``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, in_fold, table, text_bytes
from .labelled import training_rows

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

WORD_BITS = 14
WORDS = 1 << WORD_BITS
BINS = 10

_CLASS = np.zeros(256, np.uint8)
for _chars, _k in ((range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 3), ((32, 9, 11, 12, 13), 4), ((10,), 5), ((46, 44, 59, 58, 39, 34, 45, 40, 41), 6), (range(128, 256), 7)):
    _CLASS[list(_chars)] = _k

STATISTICS = ("log_words", "log_bytes", "mean_word", "lower", "upper", "digits", "spaces", "stops", "symbols", "distinct", "same_as_last", "lines", "distinct_lines", "top_word", "one_byte_words")


def statistics(text: bytes, words: list, hashes: np.ndarray) -> np.ndarray:
    """Structure of a text; all zero for an empty one."""
    n, size = len(words), len(text)
    if not n:
        return np.zeros(len(STATISTICS))
    counts = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=8) / size
    _, each = np.unique(hashes, return_counts=True)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return np.array([
        np.log1p(n), np.log1p(size), size / n, counts[1], counts[2], counts[3], counts[4], counts[6], counts[0], len(each) / n, (hashes[1:] == hashes[:-1]).mean() if n > 1 else 0.0,
        len(lines) / n, len(set(lines)) / max(1, len(lines)), each.max() / n, sum(map((1).__eq__, map(len, words))) / n,
    ])


class Vectors:
    """Texts as sparse vectors: (indices, values). Word buckets come first, then one bin of each statistic."""

    def __init__(self, edges: np.ndarray | None = None):
        self.words, self.edges = WordHashes(seed=6), edges

    def raw(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = text.split()
        hashes = self.words.of(words)
        buckets, tf = np.unique((hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64), return_counts=True)
        values = 1 + np.log(tf)
        return buckets, values / max(1e-9, np.sqrt((values**2).sum())), statistics(text, words, hashes)

    def binned(self, stats: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(e, x, side="right") for e, x in zip(self.edges, stats)]
        return WORDS + np.arange(len(stats)) * BINS + np.array(bins)

    def vector(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        buckets, values, stats = self.raw(text)
        return np.concatenate([buckets, self.binned(stats)]), np.concatenate([values, np.full(len(stats), STATISTIC_VALUE)])


STATISTIC_VALUE = 0.5


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    edges: np.ndarray

    def logit(self, index: np.ndarray, value: np.ndarray) -> float:
        v = self.factors[index] * value[:, None]
        total = v.sum(0)
        return self.bias + float(self.linear[index] @ value) + 0.5 * float((total**2).sum() - (v**2).sum())


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, *, rank: int = 8, epochs: int = 12, rate: float = 0.02, decay: float = 1e-4, batch: int = 128, seed: int = 1) -> FactorisationMachine:
    """Logistic loss by Adam over minibatches. Without both labels the score is the labels' mean."""
    stats = np.array([r[2] for r in rows]) if rows else np.zeros((1, len(STATISTICS)))
    edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
    rng = np.random.default_rng(seed)
    d = WORDS + len(STATISTICS) * BINS
    mean = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    model = FactorisationMachine(np.log(mean / (1 - mean)), np.zeros(d), rng.normal(0, 0.01, (d, rank)), edges)
    if len(set(labels.tolist())) < 2:
        return FactorisationMachine(model.bias, model.linear, np.zeros((d, rank)), edges)
    vectors = Vectors(edges)
    data = [(np.concatenate([b.astype(np.int32), vectors.binned(s).astype(np.int32)]), np.concatenate([x, np.full(len(s), STATISTIC_VALUE, np.float32)])) for b, x, s in rows]
    params = np.concatenate([model.linear[:, None], model.factors], 1)
    first, second, step = np.zeros_like(params), np.zeros_like(params), 0
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), batch):
            part = [data[i] for i in order[at : at + batch]]
            y = labels[order[at : at + batch]]
            index, value = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
            starts = np.cumsum([0] + [len(p[0]) for p in part[:-1]])
            doc = np.repeat(np.arange(len(part)), [len(p[0]) for p in part])
            rows_ = params[index] * value[:, None]
            sums = np.add.reduceat(rows_, starts, 0)
            squares = np.add.reduceat(rows_[:, 1:] ** 2, starts, 0)
            logit = model.bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - squares.sum(1))
            error = (1 / (1 + np.exp(-logit)) - y) / len(part)
            grad = np.empty_like(rows_)
            grad[:, 0] = error[doc] * value
            grad[:, 1:] = (error[doc] * value)[:, None] * (sums[doc, 1:] - rows_[:, 1:])
            sorter = np.argsort(index, kind="stable")
            used, begin = np.unique(index[sorter], return_index=True)
            g = np.add.reduceat(grad[sorter], begin, 0) + decay * params[used]
            step += 1
            first[used] = 0.9 * first[used] + 0.1 * g
            second[used] = 0.99 * second[used] + 0.01 * g * g
            params[used] -= rate * (first[used] / (1 - 0.9**step)) / (np.sqrt(second[used] / (1 - 0.99**step)) + 1e-8)
            model.bias -= rate * float(error.sum())
    model.linear, model.factors = params[:, 0].copy(), params[:, 1:].copy()
    return model


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vectors = Vectors()
    for batch in batches:
        found = [vectors.raw(t or b"") for t in text_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([f[k].astype(kind).tobytes() for f in found], pa.binary()) for k, kind in enumerate(("<u2", "<f4", "<f8"))), batch.column(2)],
            names=["doc_id", "buckets", "tf", "stats", "label"],
        )


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", modulus: int = 5, held_out: int = 0, max_labelled: int = 5_000) -> FactorisationMachine:
    """Fits on at most ``max_labelled`` labelled rows outside the held-out fold; vectors are made on the executors."""
    rows = training_rows(docs, labels, label=label, modulus=modulus, held_out=held_out, limit=max_labelled)
    got = sorted(rows.mapInArrow(_features, "doc_id long, buckets binary, tf binary, stats binary, label int").collect())
    return fit([(np.frombuffer(r.buckets, "<u2"), np.frombuffer(r.tf, "<f4"), np.frombuffer(r.stats, "<f8")) for r in got], np.array([float(r.label) for r in got]))


def score(docs: DataFrame, model: FactorisationMachine, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, held_out: int = 0, threshold: float = 0.3) -> DataFrame:
    """One row per document (schema ``SCHEMA``).

    A null text counts as empty and gets the score of an empty one; null ids stay null and are
    held out as the empty id's fold has it; repeated rows repeat; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = shared.value
        vectors = Vectors(fm.edges)
        for batch in batches:
            logits = np.array([fm.logit(*vectors.vector(t or b"")) for t in text_bytes(batch.column(2))])
            p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    ids = docs[id_col].cast("long")
    return docs.select(ids, in_fold(ids, modulus, held_out).alias("held_out"), docs[text_col].cast("string")).mapInArrow(run, SCHEMA)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
