"""Near-duplicate classes of documents by weighted minwise signatures made of darts.

A document is the multiset of its runs of five words. Every run has weight regions, and in
each region darts arrive at hashed times, ranks and coordinates, the same in every document
that covers the region. A signature keeps the earliest dart of each coordinate, so two
documents agree in a coordinate with the probability of their weighted Jaccard similarity.
Signatures are joined by bands. In a bucket, all members are compared with the least one, and
where they are of several classes then, those of other classes with a few more. Where the rest
of a bucket isn't of one class yet, links between classes are looked for by their rarest runs,
of which similar documents share one: all members of different classes that share such a run
are compared, except where lengths and the place of the run rule the similarity out.
Comparisons are exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MASK64, Rolling, Scratch, WordHashes, fresh, mix, signed, table, text_bytes
from .components import components

SHINGLE = 5
BANDS, ROWS = 24, 5
SIZE = BANDS * ROWS
CELL = 2


def shingles(hashes: np.ndarray, rolling: Rolling, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of n words, with their counts; a shorter text is one run."""
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    width = min(n, len(hashes))
    return np.unique(rolling.runs(rolling.prefix(hashes), slice(None), width), return_counts=True)


def dart_signature(elements: np.ndarray, weights: np.ndarray, size: int = SIZE, seed: int = 0) -> np.ndarray:
    """Ids of the earliest dart of each coordinate. Weights are positive numbers.

    The regions of a weight w are [0, 1), [1, 2), [2, 4), ... up to the one that holds w. A
    region of width d receives darts as a Poisson process of rate ``size * d``; a dart counts
    where its position lies below w. Time runs until every coordinate has a dart.
    """
    weights = np.asarray(weights, float)
    parts, low, width = [], 0.0, 1.0
    live = np.arange(len(elements))
    region = 0
    while len(live):
        parts.append((live, np.full(len(live), low), np.full(len(live), width), np.full(len(live), region)))
        low += width
        width = low
        region += 1
        live = live[weights[live] > low]
    element, low, width, region = (np.concatenate(x) for x in zip(*parts))
    base = mix(elements[element] + np.uint64((0xD1B54A32D192ED03 * (seed + 1)) & MASK64) * (region.astype(np.uint64) + np.uint64(1)))
    above, rate = weights[element], size * width
    limit = (np.log(size) + 2) / weights.sum()
    while True:
        # Time is cut into cells of CELL expected darts, so that heavy regions need no more steps than light ones.
        cells = np.maximum(1, np.ceil(limit * rate / CELL).astype(np.int64))
        at = np.repeat(np.arange(len(base)), cells)
        cell = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
        state = mix(base[at] ^ (cell.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
        start, time, j = cell * float(CELL), np.zeros(len(at)), 0
        times, coordinates, darts = [], [], []
        while len(at):
            j += 1
            dart = mix(state + np.uint64((0x9E3779B97F4A7C15 * j) & MASK64))
            time = time - np.log(((dart >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53)
            inside = (time < CELL) & (start + time < limit * rate[at])
            at, time, dart, state, start = at[inside], time[inside], dart[inside], state[inside], start[inside]
            where = mix(dart ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            arrival, coordinate, kept = (start + time) / rate[at], ((where >> np.uint64(32)) % np.uint64(size)).astype(np.int64), dart
            if (low[at] + width[at] > above[at]).any():
                hit = low[at] + width[at] * ((where & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32) < above[at]
                arrival, coordinate, kept = arrival[hit], coordinate[hit], dart[hit]
            times.append(arrival)
            coordinates.append(coordinate)
            darts.append(kept)
        times, coordinates, darts = (np.concatenate(x) for x in (times, coordinates, darts))
        order = np.lexsort((darts, times))[::-1]
        ids, hit = np.zeros(size, np.uint64), np.zeros(size, bool)
        ids[coordinates[order]] = darts[order]
        hit[coordinates] = True
        if hit.all():
            return ids
        limit *= 2


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    parts = signature.reshape(bands, -1)
    key = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for k in range(parts.shape[1]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
    return key


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    return float(common / (a[1].sum() + b[1].sum() - common))


_SIGNED = "doc_id long, hash long, key binary, bands array<long>, bits binary"


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures of texts with words; the same text is signed once while it is among the last few thousand."""
    words, rolling, recent = WordHashes(), Rolling(), {}
    names = [x.split()[0] for x in _SIGNED.split(", ")]
    for batch in batches:
        rows = []
        for doc_id, text, row in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist()):
            w = (text or b"").split()
            if not w or doc_id is None:
                continue
            key = xxhash.xxh128_digest(b" ".join(w))
            if key not in recent:
                if len(recent) > 4000:
                    recent.clear()
                signature = dart_signature(*shingles(words.of(w), rolling))
                recent[key] = (signed(band_keys(signature)), (signature >> np.uint64(56)).astype(np.uint8).tobytes())
            rows.append((doc_id, row, key, *recent[key]))
        columns = list(zip(*rows)) if rows else [()] * 5
        types = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _estimated(least: float):
    """Pairs whose signatures, a byte of each coordinate, agree often enough that the similarity may be reached."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
                keep = pa.array((a == b).mean(1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _verified(threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rolling, recent = WordHashes(), Rolling(), {}

        def of(doc: int, text: bytes) -> tuple[np.ndarray, np.ndarray]:
            if doc not in recent:
                if len(recent) > 3000:
                    recent.clear()
                recent[doc] = shingles(words.of(text.split()), rolling)
            return recent[doc]

        for batch in batches:
            keep = [similarity(of(a, x), of(b, y)) >= threshold for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), text_bytes(batch.column(3)))]
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _links(pairs: DataFrame, bits: DataFrame, content: DataFrame, scratch: Scratch, threshold: float, name: str) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold; what signatures rule out isn't compared."""
    pairs = scratch.save(pairs, f"{name}-pairs")
    with_bits = pairs.join(bits.select(F.col("doc").alias("a"), F.col("bits").alias("bits_a")), "a").join(bits.select(F.col("doc").alias("b"), F.col("bits").alias("bits_b")), "b")
    # Four standard deviations of the estimate below the threshold.
    least = threshold - 4 * (threshold * (1 - threshold) / SIZE) ** 0.5
    likely = scratch.save(with_bits.select("a", "b", "bits_a", "bits_b").mapInArrow(_estimated(least), "a long, b long"), f"{name}-likely")
    return _exact_links(likely, content, scratch, threshold, name)


def _exact_links(pairs: DataFrame, content: DataFrame, scratch: Scratch, threshold: float, name: str) -> DataFrame:
    with_texts = pairs.join(content.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b").join(content.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")
    return scratch.save(with_texts.select("a", "b", "text_a", "text_b").mapInArrow(_verified(threshold), "a long, b long"), f"{name}-links")


def _units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, rolling = WordHashes(), Rolling()
    for batch in batches:
        for doc, name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2))):
            h, n = shingles(words.of(text.split()), rolling)
            total = int(n.sum())
            nth = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
            unit = mix(np.repeat(h, n) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(total, doc)), pa.array(np.full(total, name)), pa.array(signed(unit)), pa.array(np.full(total, total))], names=["doc", "class", "unit", "size"])


def _prefixes(rest: DataFrame, content: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(doc, unit, at, size): the rarest runs of documents, of which all pairs above the threshold share one.

    Of n runs, repeats counted apart, two documents of similarity t share one of the
    ``n - ceil(t n) + 1`` that come first in any common order. Rare runs come first, so edits
    that copies don't share keep them apart.
    """
    units = scratch.save(content.join(rest, "doc").select("doc", "class", "text").mapInArrow(_units, "doc long, class long, unit long, size long"), "units")
    rarity = units.groupBy("unit").agg(F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high"))
    ordered = units.join(rarity, "unit").withColumn("at", F.row_number().over(Window.partitionBy("doc").orderBy("n", "unit")))
    first = ordered.where((F.col("at") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1) & F.expr("low < high"))
    return scratch.save(first.select("doc", "unit", "at", "size"), "prefixes")


def _reachable(threshold: float):
    """Whether documents a and b can reach the threshold if this is the first run of the order that they share.

    Their lengths bound the similarity, and only runs that come later in both can be shared
    besides. Similar documents pass at the first run they share, so none is lost.
    """
    shared = 1 + F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
    return shared >= threshold / (1 + threshold) * (F.col("size_a") + F.col("size_b")) - 1e-6


def _all_pairs(prefixes: DataFrame, labels: DataFrame, threshold: float, block: int = 256) -> DataFrame:
    """All pairs of different classes that share a run and can reach the threshold. Documents of a run are dealt to blocks, each of which meets all of them."""
    named = prefixes.join(labels, "doc", "left").withColumn("class", F.coalesce("class", "doc"))
    mixed = named.groupBy("unit").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("low < high").select("unit", "blocks")
    rows = named.join(mixed, "unit")
    a, b = (rows.select("unit", "blocks", F.col("doc").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("class", "at", "size"))) for s in "ab")
    a = a.withColumn("block", F.expr("pmod(xxhash64(a), blocks)").cast("int")).drop("blocks")
    b = b.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks")
    return a.join(b, ["unit", "block"]).where(F.expr("a < b AND class_a <> class_b") & _reachable(threshold)).select("a", "b").distinct()


def _named(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of documents with their class; one without links is a class of its own."""
    return rows.join(labels, "doc", "left").withColumn("class", F.coalesce("class", "doc"))


def _mixed(rows: DataFrame, centres: DataFrame, labels: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(band, doc, class) of members, other than centres, of buckets that still hold several classes besides their centres."""
    left = scratch.save(_named(rows.join(centres.withColumnRenamed("centre", "doc"), ["band", "doc"], "left_anti"), labels), f"{name}-all")
    still = left.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("band")
    return scratch.save(left.join(still, "band", "left_semi"), name)


def _met(rows: DataFrame, centres: DataFrame, labels: DataFrame | None, bits: DataFrame, content: DataFrame, scratch: Scratch, threshold: float, name: str) -> tuple[DataFrame, DataFrame | None]:
    """Links of members with centres of their buckets; the components, where no labels were known that spare pairs of one class."""
    if labels is None:
        met = rows.join(centres, "band").where("doc <> centre")
    else:
        named = _named(centres.withColumnRenamed("centre", "doc"), labels).select(F.col("band").alias("of"), F.col("doc").alias("centre"), F.col("class").alias("centre_class"))
        met = rows.join(scratch.save(named, f"{name}-named"), F.expr("band = of AND class <> centre_class"))
    pairs = met.select(F.least("doc", "centre").alias("a"), F.greatest("doc", "centre").alias("b")).distinct()
    links = _links(pairs, bits, content, scratch, threshold, name)
    return links, components(links, scratch, name) if labels is None else None


def _of_texts(docs: DataFrame, id_col: str, text_col: str, threshold: float, centres: int) -> tuple[DataFrame, DataFrame, Scratch]:
    """Rows with words and ids, (doc_id, hash of the text, key of its words), and the class of each key: the least id that its links reach."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    signed_rows = scratch.save(source.withColumn("hash", F.xxhash64("text")).mapInArrow(_sign, _SIGNED), "signed")
    texts = scratch.save(signed_rows.groupBy("key").agg(F.min("doc_id").alias("doc"), F.first("bands").alias("bands"), F.first("bits").alias("bits")).withColumn("id", F.col("doc")), "texts")
    # Where an id has several texts, all but one of them are named by a hash, so that each is one member.
    repeated = texts.groupBy("doc").agg(F.count("*").alias("n"), F.min("key").alias("least")).where("n > 1").select("doc", "least")
    if not repeated.isEmpty():
        told = texts.join(repeated, "doc", "left").withColumn("doc", F.when(F.col("key") != F.col("least"), F.xxhash64("doc", "key")).otherwise(F.col("doc")))
        texts = scratch.save(told.select("key", "doc", "bands", "bits", "id"), "told")
    # Buckets with two texts or more.
    banded = texts.select("doc", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("band")
    open_rows = scratch.save(banded.join(shared, "band", "left_semi"), "open")
    near = scratch.save(open_rows.select("doc").distinct(), "near")
    bits = scratch.save(texts.join(near, "doc", "left_semi").select("doc", "bits"), "bits")
    ids = scratch.save(texts.join(near, "doc", "left_semi").select("doc", "key", "id"), "held")
    keyed = source.join(ids.select("id"), F.col("doc_id") == F.col("id"), "left_semi").select("doc_id", "text")
    content = scratch.save(keyed.mapInArrow(_keyed, "id long, key binary, text string").join(ids, ["id", "key"]).dropDuplicates(["doc"]).select("doc", "text"), "content")
    # All members of a bucket meet its least one. Where they are of several classes then, those of
    # other classes meet the least of each part of it. Either step takes rows in proportion to members.
    centre = open_rows.groupBy("band").agg(F.min("doc").alias("centre"))
    links, labels = _met(open_rows, scratch.save(centre, "centre"), None, bits, content, scratch, threshold, "first")
    left = _mixed(open_rows, centre, labels, scratch, "left")
    part = F.pmod(F.xxhash64("doc"), F.lit(centres))
    chosen = scratch.save(left.groupBy("band", part.alias("part")).agg(F.min("doc").alias("centre")).select("band", "centre"), "centres")
    more, _ = _met(left, chosen, labels, bits, content, scratch, threshold, "second")
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links, scratch, "second")
    # A centre has met all of its bucket. Where the others are of more than one class, links between them are still to be found.
    left = _mixed(left.select("band", "doc"), chosen, labels, scratch, "rest-left")
    rest = scratch.save(left.select("doc", "class").distinct(), "rest")
    last = scratch.save(_all_pairs(_prefixes(rest, content, threshold, scratch), labels, threshold), "last-pairs")
    more = _exact_links(last, content, scratch, threshold, "last")
    if not more.isEmpty():
        labels = components(links.unionByName(more), scratch, "last")
    steps = [f"{step}-{kind}" for step in ("first", "second", "last") for kind in ("pairs", "likely", "links", "edges", "named")]
    scratch.drop("open", "near", "bits", "held", "content", "centre", "centres", "left-all", "left", "rest-left-all", "rest-left", "rest", "units", "prefixes", *steps)
    return signed_rows.select("doc_id", "hash", "key"), texts.select("key", "doc").join(labels, "doc", "left").select("key", F.coalesce("class", "doc").alias("class")), scratch


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, centres: int = 8) -> DataFrame:
    """(doc_id, class_id, representative) for every row; the class is named by its least document id.

    Documents are linked where the weighted Jaccard similarity of their runs of five words is
    ``threshold`` or more; classes are the components of links. Texts of the same words are one
    text. Texts without words, null ones too, are linked to nothing. A row without id has no
    class and is its own representative. Rows that share an id are one document, of the least
    class of its texts. An empty table gives no rows; other columns are not read.
    """
    rows, of_text, _ = _of_texts(docs, id_col, text_col, threshold, centres)
    named = rows.join(of_text, "key").select("doc_id", "class")
    least = named.groupBy("class").agg(F.min("doc_id").alias("least"))
    by_doc = named.join(least, "class").groupBy("doc_id").agg(F.min("least").alias("class"))
    out = docs.select(docs[id_col].cast("long").alias("doc_id")).join(by_doc, "doc_id", "left").select("doc_id", F.coalesce("class", "doc_id").alias("class_id"))
    return out.withColumn("representative", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def _keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [xxhash.xxh128_digest(b" ".join((t or b"").split())) for t in text_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), batch.column(1)], names=["doc", "key", "text"])


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, centres: int = 8) -> DataFrame:
    """The rows, with all columns, of one document of each class: the one with the least id.

    Rows without id or without words stay. Rows are told apart by id and text: where an id is
    repeated with other texts, each text belongs to its own class, and of the texts of one id
    in one class that with the least hash stays. Of rows with the same id and text one stays.
    """
    rows, of_text, scratch = _of_texts(docs, id_col, text_col, threshold, centres)
    named = scratch.save(rows.join(of_text, "key").select("class", "doc_id", "hash"), "members")
    stays = named.groupBy("class").agg(F.min(F.struct("doc_id", "hash")).alias("first"))
    key, text = fresh(docs, "id", "hash")
    gone = named.join(stays, "class").where("doc_id <> first.doc_id OR hash <> first.hash").select(F.col("doc_id").alias(f"{key}_"), F.col("hash").alias(f"{text}_")).distinct()
    keyed = docs.withColumn(key, docs[id_col].cast("long")).withColumn(text, F.xxhash64(docs[text_col].cast("string")))
    kept = keyed.join(gone, (F.col(key) == F.col(f"{key}_")) & (F.col(text) == F.col(f"{text}_")), "left_anti")
    again = named.groupBy("doc_id", "hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(f"{key}_"), F.col("hash").alias(f"{text}_"))
    if not again.isEmpty():
        same = (F.col(key) == F.col(f"{key}_")) & (F.col(text) == F.col(f"{text}_"))
        once = kept.join(again, same, "left_semi").dropDuplicates([key, text])
        kept = kept.join(again, same, "left_anti").unionByName(once)
    return kept.drop(key, text)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
