"""Removal of repeated word passages across documents by level-wise doubling.

The target length is ``half * 2 ** levels`` words. At the first level the hashes of runs of
``half`` words compete: of all such runs in a target window the smallest hash is the window's
anchor, so equal windows have equal anchors and one row per anchor, not per word, is shuffled.
Only anchors that repeat in two documents are candidates. The windows of an anchor are
consecutive, and documents that share the whole span of such a group are settled by one
comparison. What is left, one span per distinct text, is extended to windows of twice the
length, level by level, until no candidate survives or the target length is reached.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, Scratch, WordHashes, mix, signed, table, text_bytes

SPANS = "anchor long, span long, span2 long, doc_id long, row long, first int, windows int, at int"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
#: Stands for a null id: larger than any id, so such a row is never the earlier copy of one with an id.
NO_ID = (1 << 63) - 1


def anchors(hashes: np.ndarray, rolling: Rolling, target: int, half: int) -> tuple[np.ndarray, ...]:
    """Groups of consecutive windows with one anchor: anchor hash, two span hashes, first window, windows, anchor's place."""
    n = len(hashes) - target + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 3 + (np.zeros(0, np.int64),) * 3
    prefix = rolling.prefix(hashes)
    runs = rolling.runs(prefix, slice(None), half)
    bits = np.uint64(max(24, int(len(runs)).bit_length()))
    key = ((runs >> bits) << bits) | np.arange(len(runs), dtype=np.uint64)
    width, least = target - half + 1, key
    done = 1
    while done < width:  # minimum over ``width`` runs by doubling
        step = min(done, width - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    windows = np.diff(np.append(first, n))
    at = place[first]
    form = windows.astype(np.uint64) * np.uint64(1 << 20) + (at - first).astype(np.uint64)
    span = mix(rolling.runs(prefix, first, windows + target - 1) + form)
    span2 = mix(rolling.runs(rolling.prefix(second(hashes)), first, windows + target - 1) + form)
    return runs[at], span, span2, first, windows, at


def second(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of words: with the first ones, runs of words are told apart by 128 bits."""
    return mix(hashes ^ np.uint64(0x6A09E667F3BCC909))


def _span_rows(target: int, half: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rolling = WordHashes(), Rolling()
        names = [x.split()[0] for x in SPANS.split(", ")]
        for batch in batches:
            found, size = [], 0
            for doc_id, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2))):
                if not text:
                    continue
                a, s, s2, first, windows, at = anchors(words.of(text.split()), rolling, target, half)
                if len(a):
                    k = len(a)
                    found.append((a, s, s2, np.full(k, doc_id), np.full(k, row), first, windows, at))
                    size += k
                if size > 200_000:
                    yield _batch(found, names)
                    found, size = [], 0
            if found:
                yield _batch(found, names)

    return run


def _batch(found: list, names: list[str]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*found)]
    return pa.RecordBatch.from_arrays([pa.array(signed(c), pa.int64()) for c in columns[:3]] + [pa.array(c, pa.int64()) for c in columns[3:5]] + [pa.array(c.astype(np.int32)) for c in columns[5:]], names=names)


def _extended(target: int, rows: DataFrame) -> DataFrame:
    """Windows of the target length within candidate spans: (window, window2, doc_id, row, first)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rolling = WordHashes(), Rolling()
        for batch in batches:
            for doc_id, row, text, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), batch.column(3).to_pylist()):
                hashes = words.of(text.split())
                prefix, prefix2 = rolling.prefix(hashes), rolling.prefix(second(hashes))
                at = np.unique(np.concatenate([np.arange(s["first"], s["first"] + s["windows"]) for s in starts]))
                h, h2 = rolling.runs(prefix, at, target), rolling.runs(prefix2, at, target)
                for k in range(0, len(at), 200_000):
                    part = slice(k, k + 200_000)
                    m = len(at[part])
                    yield pa.RecordBatch.from_arrays([pa.array(signed(h[part])), pa.array(signed(h2[part])), pa.array(np.full(m, doc_id)), pa.array(np.full(m, row)), pa.array(at[part].astype(np.int32))], names=["window", "window2", "doc_id", "row", "first"])

    return rows.mapInArrow(run, "window long, window2 long, doc_id long, row long, first int")


def repeated_windows(docs: DataFrame, scratch: Scratch, *, id_col: str, text_col: str, target: int, half: int) -> DataFrame:
    """Runs of windows that also start in a document with a smaller id: (doc_id, row, first, windows)."""
    source = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(docs[text_col]).alias("row"), docs[text_col].cast("string").alias("text")).where("text IS NOT NULL")
    spans = scratch.save(source.mapInArrow(_span_rows(target, half), SPANS), "spans")
    # First level: anchors that repeat in two documents. Aggregates are written before they are
    # joined, so that rows of a hot anchor or window can be split among tasks.
    shared = spans.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
    candidates = scratch.save(spans.join(scratch.save(shared, "shared"), "anchor", "left_semi"), "candidates")
    scratch.drop("spans")
    # Equal spans: all windows of the later ones are repeated; the document that has it first stands for the rest.
    least = scratch.save(candidates.groupBy("anchor", "span", "span2").agg(F.min("doc_id").alias("low")), "least")
    several = scratch.save(least.groupBy("anchor").agg(F.count("*").alias("texts")).where("texts > 1").select("anchor"), "several")
    settled = scratch.save(candidates.join(least, ["anchor", "span", "span2"]).select("anchor", "doc_id", "row", "first", "windows", "low"), "settled")
    scratch.drop("candidates")
    later = settled.where("doc_id > low").select("doc_id", "row", "first", "windows")
    chosen = settled.where("doc_id = low").join(several, "anchor", "left_semi").select("doc_id", "row", "first", "windows")
    # Second level: windows of the target length inside the spans that are left.
    by_doc = chosen.groupBy("doc_id", "row").agg(F.collect_set(F.struct("first", "windows")).alias("starts"))
    rows = source.join(by_doc, ["doc_id", "row"]).select("doc_id", "row", "text", "starts").dropDuplicates(["doc_id", "row"])
    windows = scratch.save(_extended(target, rows), "windows")
    low = windows.groupBy("window", "window2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("window", "window2", "low")
    alone = windows.join(scratch.save(low, "repeated"), ["window", "window2"]).where("doc_id > low").select("doc_id", "row", "first", F.lit(1).alias("windows"))
    return later.unionByName(alone)


def _digests(target: int, out_text: bool):
    def of(doc_id, text, starts) -> tuple:
        words = text.split() if text else []
        covered = np.zeros(len(words) + 1, np.int64)
        for s in starts or ():
            covered[s["first"]] += 1
            covered[s["first"] + s["windows"] + target - 1] -= 1
        keep = np.cumsum(covered[:-1]) == 0
        kept = b" ".join(words) if keep.all() else b" ".join(w for w, k in zip(words, keep.tolist()) if k)
        row = (None if doc_id == NO_ID else doc_id, len(words), int(len(words) - keep.sum()), hashlib.sha256(kept).hexdigest())
        return (*row, kept.decode()) if out_text else row

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * out_text
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * out_text
        for batch in batches:
            rows = [of(*x) for x in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)], names=names)

    return run


def remove_repeated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target: int = 50, with_text: bool = False) -> DataFrame:
    """One row per document: words, words removed, SHA-256 of the kept words (and their text on request).

    A word goes if a window of ``target`` words that covers it also starts in a document with
    a smaller id, in the input as it is. A null text has no words. A null id counts as larger
    than all ids. Rows with equal ids are one document: they don't remove each other's words.
    Texts under ``target`` words stay whole. An empty table gives no rows; other columns are
    not read. Hot passages are aggregated before they are shuffled.
    """
    if target < 2:
        raise ValueError("target must be 2 or more words")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    runs = repeated_windows(docs, scratch, id_col=id_col, text_col=text_col, target=target, half=target // 2)
    by_doc = scratch.save(runs.groupBy("doc_id", "row").agg(F.collect_set(F.struct("first", "windows")).alias("starts")), "removed")
    scratch.drop("shared", "least", "several", "settled", "windows", "repeated")
    source = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(docs[text_col]).alias("row"), docs[text_col].cast("string").alias("text"))
    return source.join(by_doc, ["doc_id", "row"], "left").select("doc_id", "text", "starts").mapInArrow(_digests(target, with_text), RESULT + ", kept_text string" * with_text)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated(table(spark, sf_dir, "documents"))
