"""Labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold

#: So many ids, of 16 bytes each, are broadcast at most.
BROADCAST = 4_000_000


def training_rows(docs: DataFrame, labels: DataFrame, *, label: str, modulus: int, held_out: int | None, limit: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of all labelled documents outside the held-out fold, or of at most ``limit``.

    ``held_out`` None holds no fold out. A sample is the rows of least hash of the id, so it
    doesn't depend on order. Where ids are few enough they are broadcast and texts of other
    documents aren't shuffled. Null and contradicting labels are left out; of texts that share an
    id the least counts.
    """
    outside = F.lit(True) if held_out is None else ~in_fold(F.col("doc_id"), modulus, held_out)
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & outside)
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("_high"))
        .where("label = _high AND label IN (0, 1)")
    )
    if limit is not None:
        ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(limit)
    ids = ids.select("_id", "label")
    few = limit is not None or labels.count() <= BROADCAST
    source = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].cast("string").alias("text"))
    own = source.join(F.broadcast(ids) if few else ids, "_id").groupBy("_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    return own.select(F.col("_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "label")
