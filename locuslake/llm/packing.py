"""Packing of tokenised documents into training windows by multiway differencing.

Each map task tokenises its documents and packs them in blocks, so nothing is shuffled:
pieces of a full window stand alone, and what is left of the documents is cut into short
pieces which Karmarkar-Karp differencing spreads over windows of near-equal load.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import table

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: items by window.

    Every item begins as a partial partition with one loaded window. The two partial
    partitions of widest spread are merged, the heaviest window of one with the lightest
    of the other, until one is left.
    """
    if windows == 1:
        return [list(range(len(sizes)))]
    heap = []
    for i, size in enumerate(sizes):
        loads = np.zeros(windows, np.int64)
        loads[-1] = size
        heap.append((-size, i, loads, [()] * (windows - 1) + [(i, ())]))
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a, inside_a = heapq.heappop(heap)
        _, _, b, inside_b = heap[0]
        loads = a + b[::-1]
        order = np.argsort(loads, kind="stable")
        inside_b = inside_b[::-1]
        inside = [(inside_a[k], inside_b[k]) if inside_b[k] else inside_a[k] for k in order]
        loads = loads[order]
        heapq.heapreplace(heap, (int(loads[0] - loads[-1]), tick, loads, inside))
        tick += 1
    return [_leaves(x) for x in heap[0][3]] if heap else [[] for _ in range(windows)]


def _leaves(node: tuple) -> list[int]:
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if not x:
            continue
        if isinstance(x[0], int):
            out.append(x[0])
        else:
            stack.extend(x)
    return out


def near_equal_windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Fewest windows, from the least that could do, whose loads all fit; one more whenever one does not."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = difference(sizes, windows)
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return [p for p in parts if p]
        windows += 1


def cut(length: int, capacity: int, piece: int) -> tuple[list[int], list[int]]:
    """Full windows of a document, and for the rest pieces of ``piece`` and one shorter tail.

    Tails of all lengths let differencing even out what equal pieces leave.
    """
    full, rest = divmod(length, capacity)
    pieces, tail = divmod(rest, piece)
    return [capacity] * full, [piece] * pieces + [tail] * (tail > 0)


_encoders: dict = {}


def encoder(path: str):
    """Function from a text to its ids by the JSON file, from its vocabulary as a byte-pair encoder; texts are cut at its added tokens first."""
    if path not in _encoders:
        import tiktoken

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path} has added tokens that aren't matched literally")
        special = {t["content"]: t["id"] for t in added}
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

        def encode(text: str) -> list[int]:
            return encoding.encode(text, allowed_special="all") if any(t in text for t in special) else encoding.encode_ordinary(text)

        _encoders[path] = encode
    return _encoders[path]


class _Blocks:
    def __init__(self, first_id: int, capacity: int, piece: int, block: int):
        self.next, self.capacity, self.piece, self.block = first_id, capacity, piece, block
        self.rows: list[tuple] = []
        self.pool: list[tuple] = []
        self.pooled = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        full, rest = cut(n, self.capacity, self.piece)
        for size in full:
            self.rows.append((doc_id, at, size, zlib.crc32(ids[at : at + size]), n, self.next, 0))
            self.next += 1
            at += size
        for size in rest:
            self.pool.append((doc_id, at, size, zlib.crc32(ids[at : at + size]), n))
            self.pooled += size
            at += size
        if self.pooled >= self.block * self.capacity:
            self.flush()

    def flush(self) -> None:
        if self.pool:
            for part in near_equal_windows([p[2] for p in self.pool], self.capacity):
                at = 0
                for i in sorted(part):
                    self.rows.append((*self.pool[i], self.next, at))
                    at += self.pool[i][2]
                self.next += 1
        self.pool, self.pooled = [], 0

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [()] * 7
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 1,
    capacity: int = 2048,
    piece: int = 512,
    block: int = 128,
) -> DataFrame:
    """One row per piece of a document in a window (schema ``SCHEMA``).

    A null text is an empty one, which still has its end id. Repeated rows and ids are packed
    as often as they come; a null id stays null. An empty table gives no rows. Other columns
    are not read. ``block`` windows are differenced at a time, which bounds memory and time.
    Window ids are the map partition's number, shifted, plus a count: a task that runs again
    gives the same ones.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        blocks = _Blocks(TaskContext.get().partitionId() << 32, capacity, piece, block)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "")
                ids.append(end_id)
                blocks.add(doc_id, np.array(ids, "<u4"))
                if len(blocks.rows) > 50_000:
                    yield blocks.take()
        blocks.flush()
        yield blocks.take()

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(run, SCHEMA)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
