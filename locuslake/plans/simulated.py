"""Regions made of the embedding table: its components are the predictors, with near copies of the first sixteen.

Outcome 0 is a simulated response, outcomes 1 to 3 say whether the label is 0, 1 or 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import moments, ser
from ..sources.scratch import written

PREDICTORS, COPIES = 64, 16


def samples(spark: SparkSession, sf_dir: str, regions: int = 1, copies: bool = True) -> DataFrame:
    """(region_id, vec_id, x, y): one row a vector, so that no predictor takes a row of its own."""
    e = F.col("e")
    near = F.transform(F.sequence(F.lit(0), F.lit(COPIES - 1)), lambda i: F.get(e, i) + 0.1 * F.get(e, i + 1))
    y = (0.0 + F.get(e, F.lit(7)) - 0.8 * F.get(e, F.lit(23))) + 0.5 * (((F.col("vec_id") * 7919) % 1009).cast("double") / 1009 - 0.5)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    label = lambda k: (F.col("label") == k).cast("double")
    return rows.select((F.col("vec_id") % regions).cast("string").alias("region_id"), "vec_id", (F.concat(e, near) if copies else e).alias("x"), F.array(y, *map(label, range(3))).alias("y"))


def region_moments(spark: SparkSession, sf_dir: str, regions: int = 1, copies: bool = True) -> DataFrame:
    return written(moments.region_moments(samples(spark, sf_dir, regions, copies)))


def marginal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments.marginal_regressions(region_moments(spark, sf_dir))


def single(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Single-effect fits of the four outcomes, one component each."""
    return ser.single_effects(marginal(spark, sf_dir).where("shat > 0"), **options)


def single_with_moments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The fits, written, and the moments, whose ``r`` are rows of the correlation matrix."""
    table = region_moments(spark, sf_dir)
    return written(ser.single_effects(moments.marginal_regressions(table).where("shat > 0"))), table


def two_settings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two single-effect fits to compare, of a wide and a narrow prior; the narrow one lacks variables 60 and up."""
    table = region_moments(spark, sf_dir)
    assoc = moments.marginal_regressions(table).where("shat > 0")
    wide = ser.single_effects(assoc).withColumn("setting", F.lit("wide"))
    narrow = ser.single_effects(assoc.where("idx < 60"), 0.01).withColumn("setting", F.lit("narrow"))
    return written(wide.unionByName(narrow)), table
