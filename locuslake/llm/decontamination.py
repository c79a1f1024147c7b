"""Benchmark decontamination by template windows, in DataFrame functions only.

Texts become templates: numbers, units after numbers and capitalised words are typed
placeholders, other words are lower-cased. Windows of template tokens are hashed and joined
with those of the benchmark. A document that covers enough of an item's windows at one
alignment is contaminated, verbatim or re-parameterised, if its slots are consistent: equal
values of the item stand for equal values in the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, let, table

WINDOW = 8
TOKEN = r"\d+(?:[.,]\d+)*|\p{L}+"
# Units that may follow a number.
UNITS = "mm cm dm m km in ft yd mi mg g kg t lb lbs oz ml cl l hl s sec min h hr hrs day days week weeks month months year years usd eur gbp dollars euros pounds cents percent mph kmh kph hz khz mhz ghz w kw kwh v a c f k j kj cal kcal pa kpa bar".split()
#: A benchmark is broadcast up to this number of windows (64-bit hashes with two integers) and bytes of text; a larger one is joined by shuffle.
BROADCAST_WINDOWS, BROADCAST_BYTES = 500_000, 16 << 20
#: Items shorter than a window are looked for word by word, down to this number of tokens; still shorter ones name no passage.
SHORTEST = 4


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def template(words: Column) -> Column:
    """Typed placeholders for numbers, units and names. A token that sorts before ":" is a number."""
    units = F.array(*map(F.lit, UNITS))

    def one(word: Column, last: Column) -> Column:
        low = F.lower(word)
        unit = (last < ":") & (last > "") & (F.length(word) <= 7) & F.array_contains(units, low)
        return F.when(word < ":", F.lit("<num>")).when(unit, F.lit("<unit>")).when((low == word) | (F.upper(word) == word), low).otherwise(F.lit("<name>"))

    return let(words, lambda w: F.zip_with(w, F.slice(F.concat(F.array(F.lit("")), w), F.lit(1), F.size(w)), one))


def windows(form: Column, n: int) -> Column:
    """Hashes of the template windows, in order; none in a shorter text."""

    def of(f: Column) -> Column:
        count = F.size(f) - (n - 1)
        hashes = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.xxhash64(F.slice(f, i, F.lit(n))))
        return F.when(count > 0, hashes).otherwise(F.array().cast("array<bigint>"))

    return let(form, of)


def _found(docs: DataFrame, benchmark: DataFrame, *, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int, coverage: float) -> DataFrame:
    """(doc_id, row, item_id, matched, item_windows, slots, verbatim) by document, hash of its text, and item."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("row"), docs[text_col].cast("string").alias("text"))
    items = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), benchmark[item_text_col].cast("string").alias("item_text")).distinct()
    items = items.withColumn("item", F.md5(F.concat_ws("\x1f", F.coalesce(F.col("item_id").cast("string"), F.lit("")), "item_text"))).withColumn("item_words", tokens(F.col("item_text")))
    items = scratch.save(items.where(F.size("item_words") >= SHORTEST).withColumn("item_form", template(F.col("item_words"))).withColumn("n", F.least(F.size("item_words"), F.lit(window))), "items")
    # A window that an item repeats counts once, at its first place, so that a row of numbers meets one place of it.
    at_first = F.when(F.col("n") == window, windows(F.col("item_form"), window)).otherwise(F.array(F.xxhash64(F.transform("item_words", F.lower))))
    item_windows = items.select("item", "n", F.posexplode(at_first).alias("at", "hash")).groupBy("item", "n", "hash").agg(F.min("at").alias("item_at"))
    item_windows = scratch.save(item_windows.withColumn("item_windows", F.count("*").over(Window.partitionBy("item"))), "item-windows")
    size = items.agg(F.sum(F.octet_length("item_text")).alias("bytes"), F.array_sort(F.collect_set(F.when(F.col("n") < window, F.col("n")))).alias("short")).first()  # at most ``window`` lengths
    small = (size.bytes or 0) <= BROADCAST_BYTES and item_windows.count() <= BROADCAST_WINDOWS
    probe = F.broadcast(item_windows) if small else item_windows
    words = tokens(F.col("text"))
    seen = source.select("doc_id", "row", F.posexplode(windows(template(words), window)).alias("at", "hash")).withColumn("n", F.lit(window))
    for n in size.short:
        seen = seen.unionByName(source.select("doc_id", "row", F.posexplode(windows(F.transform(words, F.lower), n)).alias("at", "hash")).withColumn("n", F.lit(n)))
    hits = seen.join(probe, ["hash", "n"]).select("doc_id", "row", "item", "item_windows", (F.col("at") - F.col("item_at")).alias("shift"), "item_at")
    aligned = hits.groupBy("doc_id", "row", "item", "item_windows", "shift").agg(F.count_distinct("item_at").alias("matched"), F.collect_set("item_at").alias("places"))
    likely = aligned.where(F.col("matched") >= F.col("item_windows") * coverage).join(F.broadcast(items) if small else items, "item")
    likely = scratch.save(likely.drop("item_text"), "likely")
    # Slots: places of the item that hold a placeholder and lie in a window that was found.
    rows = likely.select("doc_id", "row").distinct()
    texts = source.withColumnRenamed("doc_id", "_id").withColumnRenamed("row", "_row").join(rows, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_row") == F.col("row"))).select("doc_id", "row", "text").dropDuplicates(["doc_id", "row"]).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), tokens(F.col("text")).alias("words"))
    both = likely.join(texts, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_row") == F.col("row")))
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("n") - 1))))
    slot_places = F.filter(covered, lambda p: F.get(F.col("item_form"), p).startswith("<"))
    slots = F.transform(slot_places, lambda p: F.struct(F.get(F.col("item_form"), p).alias("kind"), F.get(F.col("item_words"), p).alias("item_value"), F.get(F.col("words"), p + F.col("shift")).alias("value")))
    both = both.withColumn("slots_", F.array_distinct(slots))
    asked = F.size(F.array_distinct(F.transform("slots_", lambda s: F.struct(s["kind"], s["item_value"]))))
    both = both.withColumn("verbatim", F.forall("slots_", lambda s: s["item_value"] == s["value"]))
    # Placeholders alone, such as a row of numbers, are no template: such a match needs the item's own values.
    literal = F.size(slot_places) < F.size(covered)
    both = both.where(((F.size("slots_") == asked) | (F.col("n") < window)) & (literal | F.col("verbatim")))
    both = both.select("doc_id", "row", "item_id", "matched", "item_windows", F.size("slots_").alias("slots"), "verbatim")
    best = both.groupBy("doc_id", "row", "item_id").agg(F.max(F.struct("matched", "verbatim", "slots", "item_windows")).alias("best"))
    found = scratch.save(best.select("doc_id", "row", "item_id", "best.*"), "found")
    scratch.drop("items", "item-windows", "likely")
    return found


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, coverage: float = 0.3,
) -> DataFrame:
    """(doc_id, item_id, matched, item_windows, slots, verbatim) for each document and item it contains.

    ``matched`` counts the item's windows found at the best alignment, which are ``coverage``
    of them or more; a window that the item repeats counts once. ``verbatim`` tells whether all
    slots have the item's own values. Items of ``SHORTEST`` tokens or more but under ``window``
    match where all their words stand together; shorter, empty and null ones match nothing, nor
    do null and empty texts. Items are told apart by id and text, so all texts of a repeated id
    count, under that id; null ids are kept null on both sides. Documents are told apart by id
    too: rows that share one give the best match of any. Empty tables give no rows; other
    columns are not read.
    """
    found = _found(docs, benchmark, id_col=id_col, text_col=text_col, item_col=item_col, item_text_col=item_text_col, window=window, coverage=coverage)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", "verbatim", "slots", "item_windows")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.matched").cast("long").alias("matched"), F.col("best.item_windows").cast("long").alias("item_windows"), F.col("best.slots").cast("long").alias("slots"), "best.verbatim")


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, coverage: float = 0.3,
) -> DataFrame:
    """The rows, with all columns, whose text contains no benchmark item; rows are told apart by id (null ids too) and text."""
    found = _found(docs, benchmark, id_col=id_col, text_col=text_col, item_col=item_col, item_text_col=item_text_col, window=window, coverage=coverage)
    key, text = fresh(docs, "id", "hash")
    gone = found.select(F.col("doc_id").alias(f"{key}_"), F.col("row").alias(f"{text}_")).distinct()
    keyed = docs.withColumn(key, docs[id_col].cast("long")).withColumn(text, F.xxhash64(docs[text_col]))
    return keyed.join(gone, F.col(key).eqNullSafe(F.col(f"{key}_")) & (F.col(text) == F.col(f"{text}_")), "left_anti").drop(key, text)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
