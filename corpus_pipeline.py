"""From documents to packed training windows: five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuslake.llm import decontamination, near_duplicates, packing, pii, toxicity
from locuslake.llm.common import Scratch, fresh, table

#: No SQL form: the stages hold trained models, hashed signatures and keyed surrogates. tests/llm/test_pipeline.py holds the rows that leave each stage against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on all labelled ones of this input, doesn't reject.

    A null text is scored as an empty one; rows without id are scored like others. Of an empty
    table or one without labels nothing is learnt and all rows stay; where all labels are of one
    kind, all rows are taken for that kind. Repeated rows share a fate. Columns may have any names.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), held_out=None)
    (score,) = fresh(docs, "toxicity")
    return toxicity.score(docs, model, score_col=score).where(F.col(score) < 0.3).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of the least id, and of its texts that of the least hash.

    Rows without id or words stay; of rows with the same id and text one stays.
    """
    return near_duplicates.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, verbatim or re-parameterised.

    Rows are judged by id and text, those without id by their text. Null and empty texts stay;
    an empty benchmark removes nothing.
    """
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; ``n_chars`` follows the new text. Null and empty texts stay as they are."""
    return pii.replace_pii(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens; a null or empty text is its end id alone. No rows give no pieces."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    last = None
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return docs
