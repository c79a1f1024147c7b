"""Language-model scoring with a causal self-attention model trained in numpy on subword ids.

Words are lower-cased (A-Z) and cut into subword ids of a public vocabulary. One attention
layer with relative positions predicts the class of each id from the ids before it, group by
group: attention over the context gives the group, the class before it the class within the
group. Frequent ids are classes of their own, others share classes by frequency, with corpus
shares inside a class; groups are clusters of classes that follow the same classes. Texts are scored in overlapping context windows, each id once, in masked batches.
Since ids that begin a word have classes of their own, the model also gives the probability
that a word ends, so whole words have probabilities; these are mixed at a fixed rate with
the word's smoothed share of the corpus. The share that is left for unknown words is dealt to
their spellings by the network, so that the probabilities of all words after a context sum to
one at most. (The base score gives that whole share to each unknown word.) A text's score is
the sum over its words and its end.

Counts cover the whole corpus. Documents are dealt to chunks of bounded size and become lists
of word numbers; only the distinct words of each chunk travel, in buckets by hash, to meet
their counts and subword ids, and come back once. All later passes read the written chunks
without a shuffle: class pairs are counted in all training documents, and the network learns
from each of them once, in rounds after which the partitions' weights are averaged.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, in_fold, mix, table

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

END = 50256
STRIDE, CONTEXT = 16, 32
#: Bound of the entries of the attention's tables; 16 products of two of them stay below the logarithm of the largest single-precision number.
LIMIT = np.float32(2.2)


class Subwords:
    """Subword ids of lower-case words; each word is read as if a space stood before it."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.begins = np.zeros(END + 1, bool)
        for token, i in ranks.items():
            self.begins[i] = token.startswith(b" ")
        self.begins[END] = True

    def of(self, word: bytes) -> list[int]:
        return self.encode(" " + word.decode("utf-8", "replace"))


_subwords: dict = {}


def subwords(path: str) -> Subwords:
    if path not in _subwords:
        _subwords[path] = Subwords(path)
    return _subwords[path]


@dataclass
class Classes:
    """Class of each id, log share of the id inside its class, number of classes that begin words; those come first."""

    of: np.ndarray
    inside: np.ndarray
    beginning: int
    n: int

    @staticmethod
    def by_frequency(counts: np.ndarray, begins: np.ndarray, n: int = 512, shared: int = 96) -> Classes:
        counts = counts + 0.01
        order = np.argsort(-counts, kind="stable")
        own = order[: n - shared]
        own = np.unique(np.append(own[own != END][: n - shared - 1], END))
        groups = [[i] for i in own[begins[own]]]
        rest = np.ones(len(counts), bool)
        rest[own] = False

        def split(ids: np.ndarray, k: int) -> list:
            ids = ids[np.argsort(-counts[ids], kind="stable")]
            mass = np.cumsum(counts[ids]) / counts[ids].sum()
            at = np.minimum(k - 1, ((mass - counts[ids] / counts[ids].sum()) * k).astype(int))
            return [ids[at == g] for g in range(k) if (at == g).any()]

        groups += split(np.flatnonzero(rest & begins), shared // 2)
        beginning = len(groups)
        groups += [[i] for i in own[~begins[own]]]
        groups += split(np.flatnonzero(rest & ~begins), shared - shared // 2)
        of, inside = np.zeros(len(counts), np.int32), np.zeros(len(counts))
        for k, ids in enumerate(groups):
            of[ids] = k
            inside[ids] = np.log(counts[ids] / counts[ids].sum())
        return Classes(of, inside, beginning, len(groups))


@dataclass
class Groups:
    """Group of each class and log probability of a class in its group after a class (row n: before the first)."""

    of: np.ndarray
    member: np.ndarray
    beginning: int
    n: int

    @staticmethod
    def by_context(pairs: np.ndarray, beginning: int, each: int = 28, seed: int = 3) -> Groups:
        """Clusters of the classes' predecessors, apart for classes that begin words."""
        n = pairs.shape[1]
        rng = np.random.default_rng(seed)
        expected = (pairs.sum(1, keepdims=True) + 1) * (pairs.sum(0) + 1) / (pairs.sum() + n)
        ppmi = np.log(np.maximum(1.0, (pairs + 0.1) / (expected + 0.1))).T
        u, s, _ = np.linalg.svd(ppmi, full_matrices=False)
        points = u[:, :16] * s[:16]
        weight = pairs.sum(0) + 1
        of, first = np.zeros(n, np.int32), 0
        for a, b in ((0, beginning), (beginning, n)):
            x, w = points[a:b], weight[a:b]
            centres = x[np.argsort(-w, kind="stable")[:each]]
            for _ in range(12):
                at = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
                centres = np.stack([np.average(x[at == k], axis=0, weights=w[at == k]) if (at == k).any() else x[rng.integers(len(x))] for k in range(len(centres))])
            at = np.unique(at, return_inverse=True)[1]
            of[a:b] = at + first
            first += int(at.max()) + 1
            if not a:
                begins = first
        share = (pairs.sum(0) + 0.1) / np.bincount(of, weights=pairs.sum(0) + 0.1, minlength=first)[of]
        by_group = np.stack([np.bincount(of, weights=r, minlength=first) for r in pairs])
        member = np.log((pairs + 4 * share) / (by_group[:, of] + 4))
        return Groups(of, member.astype(np.float32), begins, first)


@dataclass
class Attention:
    """Tables by class of the current id (row n: before the first): direct logits of groups, query, key, value; relative bias; output."""

    direct: np.ndarray
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    bias: np.ndarray
    out: np.ndarray

    @staticmethod
    def initial(pairs: np.ndarray, groups: Groups, width: int = 16, seed: int = 1) -> Attention:
        """Direct logits from counts of a class and the group after it, the rest small and random."""
        n = pairs.shape[1]
        after = np.stack([np.bincount(groups.of, weights=r, minlength=groups.n) for r in pairs])
        share = (after.sum(0) + 1) / (after.sum() + groups.n)
        direct = np.log((after + 10 * share) / (after.sum(1, keepdims=True) + 10))
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        return Attention(direct.astype(np.float32), draw(n + 1, width), draw(n + 1, width), draw(n + 1, width), np.zeros(CONTEXT, np.float32), draw(width, groups.n))

    def arrays(self) -> list[np.ndarray]:
        return [self.direct, self.query, self.key, self.value, self.bias, self.out]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def like(self, flat: np.ndarray) -> Attention:
        parts, at = [], 0
        for a in self.arrays():
            parts.append(flat[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Attention(*parts)


_REL = np.arange(STRIDE)[:, None] + (CONTEXT - STRIDE) - np.arange(CONTEXT)[None, :]
_CAUSAL = _REL >= 0
_REL = np.where(_CAUSAL, _REL, 0)


def windows(classes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows of a text's classes: inputs (-1 where none), targets (-1 where none); a target occurs once.

    The input of a target is the class before it; ``n`` stands before the first.
    """
    size = len(classes)
    blocks = -(-size // STRIDE)
    before = CONTEXT - STRIDE
    inputs = np.full(before + blocks * STRIDE, -1, np.int32)
    inputs[before] = n
    inputs[before + 1 : before + size] = classes[:-1]
    targets = np.full(blocks * STRIDE, -1, np.int32)
    targets[:size] = classes
    at = np.arange(blocks)[:, None] * STRIDE
    return inputs[at + np.arange(CONTEXT)], targets.reshape(blocks, STRIDE)


def windows_of(classes: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of several texts, one after the other, as ``windows`` gives them for each."""
    before = CONTEXT - STRIDE
    blocks = -(-lengths // STRIDE)
    room = before + blocks * STRIDE
    start, first = np.cumsum(room) - room, np.cumsum(lengths) - lengths
    place = np.arange(len(classes)) + np.repeat(start - first, lengths)
    targets = np.full(int(room.sum()), -1, np.int32)
    targets[place + before] = classes
    inputs = np.full(int(room.sum()) + 1, -1, np.int32)
    inputs[place + before + 1] = classes
    inputs[start + before] = n
    last = start + before + lengths  # the input after a text's last class belongs to none of its windows' targets
    inputs[last] = -1
    inputs[start + before] = n
    at = np.repeat(start, blocks) + (np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * STRIDE
    return inputs[at[:, None] + np.arange(CONTEXT)], targets[at[:, None] + before + np.arange(STRIDE)]


def _by_row(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by row of a table. Rows are 16-bit numbers, which sort by radix."""
    order = np.argsort(rows, kind="stable")
    in_order = rows.take(order)
    start = np.flatnonzero(np.concatenate([[True], in_order[1:] != in_order[:-1]]))
    out = np.zeros((n, values.shape[1]), np.float32)
    out[in_order[start]] = np.add.reduceat(values.take(order, 0), start, 0)
    return out


class Trainer:
    """Adam on the cross entropy of groups. Direct logits are counts of all training documents and stay; attention learns what they miss."""

    def __init__(self, model: Attention, groups: Groups, rate: float = 0.004):
        self.model, self.groups, self.rate, self.step = model, groups, rate, 0
        self.first = [np.zeros_like(a) for a in model.arrays()[1:]]
        self.second = [np.zeros_like(a) for a in model.arrays()[1:]]

    def batch(self, inputs: np.ndarray, targets: np.ndarray) -> float:
        """One step on a batch of windows, those of a text in order; its mean loss a token. Tables are held within bounds (``LIMIT``) where no exponential overflows, so no maximum is taken."""
        m = self.model
        n, width, b = len(m.direct) - 1, m.key.shape[1], len(inputs)
        keys = np.where(inputs >= 0, inputs, n).astype(np.uint16)
        cur, all_keys = keys[:, CONTEXT - STRIDE :].ravel(), keys.ravel()
        q, k, v = (x.take(at, 0).reshape(b, -1, width) for x, at in ((m.query, cur), (m.key, all_keys), (m.value, all_keys)))
        a = q @ k.transpose(0, 2, 1)
        np.exp(a, out=a)
        a *= np.where(_CAUSAL, np.exp(m.bias[_REL]), np.float32(0))
        if (inputs < 0).any():
            a *= (inputs >= 0).astype(np.float32)[:, None, :]
        a /= (a.reshape(-1, CONTEXT) @ np.ones(CONTEXT, np.float32) + np.float32(1e-30)).reshape(b, STRIDE, 1)
        o = a @ v
        flat_o = o.reshape(-1, width)
        p = flat_o @ m.out
        p += m.direct.take(cur, 0)
        np.exp(p, out=p)
        p /= (p @ np.ones(p.shape[1], np.float32))[:, None]
        at_target = np.arange(targets.size) * p.shape[1] + self.groups.of.take(np.maximum(targets, 0)).ravel()
        live = targets.ravel() >= 0
        flat_p = p.reshape(-1)
        hit = flat_p.take(at_target)
        loss = -float(np.log(hit[live] + 1e-30).mean()) if live.any() else 0.0
        flat_p[at_target] = hit - 1
        if not live.all():
            p[~live] = 0
        scale = np.float32(1 / max(1, live.sum()))
        g_out = (flat_o * scale).T @ p
        g_o = (p @ (m.out.T * scale)).reshape(o.shape)
        g_s = g_o @ v.transpose(0, 2, 1)
        g_s -= np.einsum("ijk,ijk->ij", g_s, a)[:, :, None]
        g_s *= a
        # What stands before a window's targets are the inputs of the window before it, or nothing:
        # gradients of one place are summed before they are sorted by row of the tables.
        by_place = np.empty((len(cur) + CONTEXT - STRIDE, 3 * width), np.float32)
        here = by_place[: len(cur)].reshape(b, STRIDE, -1)
        here[:, :, :width] = g_s @ k
        by_place[len(cur) :, :width] = 0
        for part, g in ((slice(width, 2 * width), g_s.transpose(0, 2, 1) @ q), (slice(2 * width, None), a.transpose(0, 2, 1) @ g_o)):
            here[:, :, part] = g[:, CONTEXT - STRIDE :]
            here[:-1, :, part] += g[1:, : CONTEXT - STRIDE]
            by_place[len(cur) :, part] = g[0, : CONTEXT - STRIDE]
        g_bias = np.bincount(_REL.ravel(), weights=(g_s.sum(0) * _CAUSAL).ravel(), minlength=CONTEXT).astype(np.float32)
        rows = _by_row(np.concatenate([cur, keys[0, : CONTEXT - STRIDE]]), by_place, n + 1)
        self._adam([rows[:, :width], rows[:, width : 2 * width], rows[:, 2 * width :], g_bias, g_out])
        return loss

    def _adam(self, grads: list[np.ndarray]) -> None:
        self.step += 1
        scale = np.float32(self.rate / (1 - 0.9**self.step))
        spread = np.float32(1 / (1 - 0.98**self.step))
        for x, g, f1, f2 in zip(self.model.arrays()[1:], grads, self.first, self.second):
            f1 *= np.float32(0.9)
            f1 += np.float32(0.1) * g
            f2 *= np.float32(0.98)
            f2 += np.float32(0.02) * (g * g)
            d = f2 * spread
            np.sqrt(d, out=d)
            d += np.float32(1e-8)
            np.divide(f1, d, out=d)
            d *= scale
            x -= d
            np.clip(x, -LIMIT, LIMIT, out=x)


class LanguageModel:
    """A trained model ready to score: exponentials of direct logits and relative biases are taken once."""

    def __init__(self, classes: Classes, groups: Groups, model: Attention):
        n = len(model.direct) - 1
        self.classes, self.groups, self.n = classes, groups, n
        self.member = np.ascontiguousarray(groups.member).ravel()
        self.direct = np.exp(model.direct - model.direct.max(1, keepdims=True))
        self.near = np.where(_CAUSAL, np.exp(model.bias[_REL]), 0).astype(np.float32)
        self.query, self.key, self.value, self.out = model.query, model.key, model.value, model.out
        self.sums = np.ones((groups.n, 2), np.float32)
        self.sums[groups.beginning :, 0] = 0

    def token_logs(self, ids: np.ndarray, lengths: np.ndarray, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Of the ids of several texts: log probability, and log probability that a word begins there."""
        c = self.classes.of[ids]
        inputs, targets = windows_of(c, lengths, self.n)
        hits, totals, starts = (np.empty(targets.size, np.float32) for _ in range(3))
        n, groups, width = self.n, self.groups.n, self.key.shape[1]
        keys = np.where(inputs >= 0, inputs, n).astype(np.uint16)
        current = np.ascontiguousarray(keys[:, CONTEXT - STRIDE :])
        at_classes = np.maximum(targets, 0).ravel()
        at_targets = self.groups.of.take(at_classes)
        ones, rows = np.ones(CONTEXT, np.float32), np.arange(step * STRIDE) * groups
        whole = (inputs >= 0).all(1)
        # A work array is kept, small enough to stay in a core's cache.
        direct = np.empty((step * STRIDE, groups), np.float32)
        for at in range(0, len(inputs), step):
            k, cur = keys[at : at + step].ravel(), current[at : at + step].ravel()
            b, m = len(k) // CONTEXT, len(cur)
            a = self.query.take(cur, 0).reshape(b, STRIDE, width) @ self.key.take(k, 0).reshape(b, CONTEXT, width).transpose(0, 2, 1)
            np.exp(a, out=a)
            a *= self.near
            if not whole[at : at + step].all():
                a *= (inputs[at : at + step] >= 0).astype(np.float32)[:, None, :]
            o = (a @ self.value.take(k, 0).reshape(b, CONTEXT, width)).reshape(m, width)
            o /= (a.reshape(m, CONTEXT) @ ones + np.float32(1e-30))[:, None]
            q = o @ self.out
            np.exp(q, out=q)
            q *= self.direct.take(cur, 0, out=direct[:m], mode="clip")
            sums = q @ self.sums
            flat = slice(at * STRIDE, at * STRIDE + m)
            q.reshape(-1).take(rows[:m] + at_targets[flat], out=hits[flat], mode="clip")
            starts[flat], totals[flat] = sums[:, 0], sums[:, 1]
        live = targets.ravel() >= 0
        totals = np.log(totals[live])
        logs = np.log(hits[live] + 1e-30) - totals + self.member.take(current.ravel()[live] * np.int32(n) + at_classes[live])
        return logs + self.classes.inside[ids], (np.log(starts[live] + 1e-30) - totals).astype(np.float64)


def _flatten(index: np.ndarray, begin: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Subword ids of words given by index into a ragged table."""
    n = size[index]
    total = int(n.sum())
    offset = np.repeat(begin[index] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    return ids[offset + np.arange(total)]


_LEVEL = 1


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=_LEVEL).compress(np.ascontiguousarray(x).tobytes())


def _unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


_DEALT = "chunk long, bucket int, docs binary, known_id binary, train binary, length binary, at binary, buckets binary, words binary, sizes binary, n binary"


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Number of words of each text, the words as numbers, and the distinct words; A-Z become lower case, a null text has no words."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = words.flatten()
    some = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # space at an end leaves an empty word
    before = np.concatenate([[0], np.cumsum(some)])
    ends = np.cumsum(np.concatenate([[0], pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)]))
    coded = pc.dictionary_encode(flat.filter(pa.array(some)))
    return np.diff(before[ends]), coded.indices.to_numpy().astype(np.int32), coded.dictionary


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words, one after the other, and where each ends after the first 0."""
    words = words.cast(pa.large_string())
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[ends[0] : ends[-1]], ends - ends[0]


def _bucket(words: pa.Array, buckets: int) -> np.ndarray:
    """A number under ``buckets`` that depends on a word's bytes alone: their sum, weighted by place, mixed."""
    data, ends = _letters(words)
    size = np.diff(ends)
    place = np.arange(len(data)) - np.repeat(ends[:-1], size)
    with np.errstate(over="ignore"):
        weighted = data.astype(np.uint64) * mix(place.astype(np.uint64) + np.uint64(1))
        total = np.add.reduceat(weighted, ends[:-1]) if len(data) else np.zeros(0, np.uint64)
    return (mix(total) % np.uint64(buckets)).astype(np.uint32)


def _deal(chunk_bytes: int, buckets: int):
    """Documents of a partition in chunks: one row with the documents as word numbers, and one for each bucket of the chunk's distinct words."""
    from pyspark import TaskContext

    names = [x.split()[0] for x in _DEALT.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def full() -> pa.RecordBatch:
            ids, train = (pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1))
            length, at, words = _split(pa.concat_arrays([b.column(2).cast(pa.large_string()) for b in held]))
            train = train.to_numpy(zero_copy_only=False).astype(bool)
            counts = np.bincount(at[np.repeat(train, length)], minlength=len(words))
            bucket = _bucket(words, buckets)
            order = np.argsort(bucket, kind="stable")
            used, first = np.unique(bucket[order], return_index=True)
            known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
            parts = [[chunk, -1, _pack(pc.fill_null(ids, 0).to_numpy()), _pack(known), _pack(train), _pack(length.astype(np.int64)), _pack(at), _pack(bucket), None, None, None]]
            for k, own in zip(used, np.split(order, first[1:])):
                letters, ends = _letters(words.take(pa.array(own)))
                parts.append([chunk, int(k), *[None] * 6, _pack(letters), _pack(np.diff(ends).astype(np.int32)), _pack(counts[own].astype(np.int64))])
            types = [pa.int64(), pa.int32()] + [pa.binary()] * 9
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts), types)], names=names)

        size = 0
        for batch in batches:
            # Rows are cut where a chunk is full; a longer text is a chunk of its own.
            bytes_ = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
            start = 0
            while start < batch.num_rows:
                room = np.searchsorted(np.cumsum(bytes_[start:]), max(0, chunk_bytes - size), side="left") + 1
                piece = batch.slice(start, int(room))
                held.append(piece)
                size += int(bytes_[start : start + piece.num_rows].sum())
                start += piece.num_rows
                if size >= chunk_bytes:
                    yield full()
                    chunk, size = chunk + 1, 0
                    held.clear()
        if held:
            yield full()

    return run


_CODED = "chunk long, bucket int, c binary, size binary, ids binary"


def _code(path: str):
    """For each chunk its words of a bucket with their counts in all training documents and subword ids; a last row (chunk -1) with sums."""

    def run(group: pa.Table) -> pa.Table:
        encode = subwords(path).of
        sizes = [_unpack(x, np.int32) for x in group.column("sizes").to_pylist()]
        letters = b"".join(zstandard.ZstdDecompressor().decompress(x) for x in group.column("words").to_pylist())
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
        coded = pc.dictionary_encode(words)
        at = coded.indices.to_numpy().astype(np.int64)
        n = np.concatenate([_unpack(x, np.int64) for x in group.column("n").to_pylist()])
        c = np.bincount(at, weights=n, minlength=len(coded.dictionary))
        each = [encode(w) for w in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, each), np.int64, len(each))
        ids = np.fromiter(chain.from_iterable(each), np.int64, int(size.sum()))
        begin = np.cumsum(size) - size
        rows, start = [], 0
        bucket = group.column("bucket")[0].as_py()
        for chunk, own_sizes in zip(group.column("chunk").to_pylist(), sizes):
            own = at[start : start + len(own_sizes)]
            start += len(own_sizes)
            rows.append((chunk, bucket, _pack(c[own].astype(np.float32)), _pack(size[own].astype(np.int32)), _pack(_flatten(own, begin, size, ids).astype(np.uint16))))
        sums = np.bincount(ids, weights=np.repeat(c, size), minlength=END + 3)
        sums[END + 1 :] = c.sum(), (c > 0).sum()
        rows.append((-1, bucket, _pack(sums), None, None))
        types = [pa.int64(), pa.int32()] + [pa.binary()] * 3
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=[x.split()[0] for x in _CODED.split(", ")])

    return run


_CHUNK = "docs binary, known_id binary, train binary, length binary, at binary, c binary, size binary, ids binary, pairs binary"


def _joined(classes, ends: int):
    """A chunk's documents with the counts and ids of its words, by word number, and the class pairs of its training documents."""
    names = [x.split()[0] for x in _CHUNK.split(", ")]

    def run(docs: pa.Table, coded: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table([pa.array([], pa.binary())] * len(names), names=names)
        coded = coded.sort_by("bucket")
        join = lambda name, kind: np.concatenate([_unpack(x, kind) for x in coded.column(name).to_pylist()] or [np.zeros(0, kind)])
        order = np.argsort(_unpack(docs.column("buckets")[0].as_py(), np.uint32), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        c, size, ids = join("c", np.float32), join("size", np.int32).astype(np.int64), join("ids", np.uint16)
        moved = _flatten(place, np.cumsum(size) - size, size, ids)
        row = {k: docs.column(k)[0].as_py() for k in names[:5]} | {"c": _pack(c[place]), "size": _pack(size[place].astype(np.int32)), "ids": _pack(moved)}
        row["pairs"] = _pack(_class_pairs(Chunk(row, ends), classes.value))
        return pa.table([pa.array([row[k]], pa.binary()) for k in names], names=names)

    return run


def _class_pairs(chunk: Chunk, classes: Classes, tokens: int = 1_000_000) -> np.ndarray:
    """Number of times that a class follows a class (or begins a document) in a chunk's training documents."""
    n = classes.n
    found = np.zeros((n + 1) * n)
    for documents in chunk.batches(np.flatnonzero(chunk.train), tokens):
        _, ids, length = chunk.tokens(documents)
        c = classes.of[ids]
        before = np.concatenate([[n], c[:-1]])
        before[np.cumsum(length) - length] = n
        found += np.bincount(before.astype(np.int64) * n + c, minlength=len(found))
    return found


class Chunk:
    """A chunk read back: documents as word numbers, and per word its count, subword ids and their number; the last word is the end."""

    def __init__(self, row: dict, ends: int):
        get = lambda k, kind: _unpack(row[k], kind)
        self.doc_ids, self.known_id, self.train, length = get("docs", np.int64), get("known_id", bool), get("train", bool), get("length", np.int64)
        at = get("at", np.int32)
        self.c = np.append(get("c", np.float32).astype(np.float64), ends)
        self.size = np.append(get("size", np.int32).astype(np.int64), 1)
        self.ids = np.append(get("ids", np.uint16).astype(np.int64), END)
        self.begin = np.cumsum(self.size) - self.size
        self.end = len(self.c) - 1
        self.at = np.insert(at, np.cumsum(length), self.end)  # each document with its end
        self.length = length + 1
        self.first = np.cumsum(self.length) - self.length

    def words(self, documents: np.ndarray) -> np.ndarray:
        """Word numbers of documents, one after the other."""
        return _flatten(documents, self.first, self.length, self.at)

    def tokens(self, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers, subword ids, and number of ids by document."""
        at = self.words(documents)
        n = np.add.reduceat(self.size[at], np.cumsum(self.length[documents]) - self.length[documents])
        return at, _flatten(at, self.begin, self.size, self.ids), n

    def batches(self, documents: np.ndarray, tokens: int) -> Iterator[np.ndarray]:
        """Documents in runs of about so many tokens."""
        each = np.add.reduceat(self.size[self.at], self.first)[documents]
        cut = np.flatnonzero(np.diff(np.cumsum(each) // tokens)) + 1
        yield from (x for x in np.split(documents, cut) if len(x))


def _chunks(batches: Iterable[pa.RecordBatch], ends: int) -> Iterator[Chunk]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Chunk({k: batch.column(k)[i].as_py() for k in batch.schema.names}, ends)


def _tree_sum(rows: DataFrame) -> np.ndarray:
    """Sum of packed arrays: first of groups of rows on executors, then of the groups."""
    groups = max(1, math.isqrt(rows.rdd.getNumPartitions()))

    def add(group: pa.Table) -> pa.Table:
        total = sum(_unpack(x, np.float64) for x in group.column("data").to_pylist())
        return pa.table({"data": pa.array([_pack(total)], pa.binary())})

    parts = rows.withColumn("group", F.pmod("part", F.lit(groups))).groupBy("group").applyInArrow(add, "data binary").collect()
    return sum(_unpack(r.data, np.float64) for r in parts)


def train(chunks: DataFrame, classes: Classes, ends: int, *, rounds: int = 3, batch: int = 256, tokens: int = 60_000) -> LanguageModel:
    """Starts from the class pairs of all training documents, then learns from each of them once.

    Each partition trains on its own documents, a ``rounds``-th of them in every round, and the
    weights that partitions reach are averaged, by tokens, after each round.
    """
    from pyspark import TaskContext

    spark = chunks.sparkSession
    n = classes.n
    shared = spark.sparkContext.broadcast(classes)

    def row(data: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([_pack(data)], pa.binary())], names=["part", "data"])

    counted = chunks.select(F.spark_partition_id().alias("part"), F.col("pairs").alias("data"))
    counts = _tree_sum(counted).reshape(n + 1, n)
    chunks = chunks.drop("pairs")
    groups = Groups.by_context(counts, classes.beginning)
    model = Attention.initial(counts, groups)
    for k in range(rounds):
        start = spark.sparkContext.broadcast((model, groups))

        def learn(batches: Iterable[pa.RecordBatch], start=start, k=k) -> Iterator[pa.RecordBatch]:
            base, own = start.value
            trainer, seen = Trainer(base.like(base.flat()), own), 0
            x, t = np.zeros((0, CONTEXT), np.int32), np.zeros((0, STRIDE), np.int32)
            for chunk in _chunks(batches, ends):
                mine = np.flatnonzero(chunk.train)
                for documents in chunk.batches(mine[mine % rounds == k], tokens):
                    _, ids, length = chunk.tokens(documents)
                    more = windows_of(shared.value.of[ids], length, n)
                    x, t = np.concatenate([x, more[0]]), np.concatenate([t, more[1]])
                    whole = len(x) // batch * batch
                    for at in range(0, whole, batch):
                        trainer.batch(x[at : at + batch], t[at : at + batch])
                    seen += int((t[:whole] >= 0).sum())
                    x, t = x[whole:], t[whole:]
            if len(x):
                trainer.batch(x, t)
                seen += int((t >= 0).sum())
            yield row(np.append(trainer.model.flat().astype(np.float64) * seen, seen))

        total = _tree_sum(chunks.mapInArrow(learn, "part int, data binary"))
        if total[-1]:
            model = model.like(total[:-1] / total[-1])
    return LanguageModel(classes, groups, model)


def _score(lm, ends: int, total: int, distinct: int, mix: float, tokens: int = 30_000):
    log_total = math.log10(total + 1 * (distinct + 1))
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lm.value
        for chunk in _chunks(batches, ends):
            base = np.log10(chunk.c + 1) - log_total
            known = chunk.c > 0
            # The share of all unknown words together is dealt to spellings by their probability under the network.
            fixed, spelled = np.where(known, (1 - mix) * 10**base, 0.0), np.where(known, mix, mix + (1 - mix) * 10.0**-log_total)
            for documents in chunk.batches(np.arange(len(chunk.doc_ids)), tokens):
                at, ids, n = chunk.tokens(documents)
                logs, starts = model.token_logs(ids, n)
                size = chunk.size[at]
                first = np.cumsum(size) - size
                # A word ends where the next one may begin; after a document's end nothing follows.
                doc_first = np.cumsum(chunk.length[documents]) - chunk.length[documents]
                ended = np.append(starts[first[1:]], 0.0)
                ended[np.append(doc_first[1:], len(first)) - 1] = 0.0
                log_q = np.add.reduceat(logs.astype(np.float64), first) - starts[first] + ended
                p = spelled[at] * np.exp(np.minimum(log_q, 0)) + fixed[at]
                sums = lambda v: np.add.reduceat(v, doc_first)
                ids_ = pa.array(chunk.doc_ids[documents], pa.int64(), mask=~chunk.known_id[documents])
                columns = [ids_, ~chunk.train[documents], chunk.length[documents], sums(known[at].astype(np.int64)), np.full(len(documents), total, np.int64), sums(base[at]), sums(np.log10(p + 1e-300))]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    return run


def score(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held_out: int = 2, vocabulary: str | None = None,
    chunk_bytes: int = 16 << 20, rounds: int = 3, mix: float = 0.7,
) -> DataFrame:
    """One row per document (schema ``SCHEMA``).

    A null or empty text is its end token alone. Null ids stay null and belong to the fold of
    the empty id. Repeated rows are counted and scored as often as they come. With no training
    documents all counts are 0. An empty table gives no rows; other columns are not read.
    Words, class pairs and the network come from all training documents.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    ids = docs[id_col].cast("long")
    source = docs.select(ids.alias("doc_id"), (~in_fold(ids, modulus, held_out)).alias("train"), docs[text_col].cast("string").alias("text"))
    size = source.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows"), F.count_if("train").alias("train")).first()
    if not size.rows:
        return spark.createDataFrame([], SCHEMA)
    buckets = max(1, -(-((size.bytes or 0) + 16 * size.rows) // chunk_bytes))
    dealt = scratch.save(source.mapInArrow(_deal(chunk_bytes, buckets), _DEALT), "dealt")
    words = dealt.where("bucket >= 0").select("chunk", "bucket", "words", "sizes", "n")
    coded = scratch.save(words.groupBy("bucket").applyInArrow(_code(path), _CODED), "coded")
    found = coded.where("chunk < 0")
    sums = _tree_sum(found.select(F.col("bucket").alias("part"), F.col("c").alias("data"))) if not found.isEmpty() else np.zeros(END + 3)
    total, distinct = int(sums[END + 1]) + size.train, int(sums[END + 2]) + (size.train > 0)
    id_counts = sums[: END + 1].copy()
    id_counts[END] = size.train
    classes = Classes.by_frequency(id_counts, subwords(path).begins)
    of_chunk = dealt.where("bucket < 0").drop("bucket", "words", "sizes", "n").groupBy("chunk").cogroup(coded.where("chunk >= 0").groupBy("chunk"))
    chunks = scratch.save(of_chunk.applyInArrow(_joined(spark.sparkContext.broadcast(classes), size.train), _CHUNK), "chunks")
    scratch.drop("dealt", "coded")
    lm = spark.sparkContext.broadcast(train(chunks, classes, size.train, rounds=rounds))
    return chunks.drop("pairs").mapInArrow(_score(lm, size.train, total, distinct, mix), SCHEMA)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
