"""Checks and repairs of association summaries and correlations, before anything is fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INF = float("inf")


def coerced(column: Column) -> Column:
    """Null and NaN as 0; an infinite value raises."""
    value = column.cast("double")
    return F.when(value.isNull() | F.isnan(value), 0.0).when(F.abs(value) == INF, F.raise_error(F.lit("infinite summary statistic")).cast("double")).otherwise(value)


def from_estimates(assoc: DataFrame) -> DataFrame:
    """z of estimates and their errors. A missing estimate, or an error that is missing or not over 0, raises; an infinite error is an estimate without information."""
    bad = F.col("bhat").isNull() | F.isnan("bhat") | F.col("shat").isNull() | F.isnan("shat") | (F.col("shat") <= 0)
    return assoc.withColumn("z", F.when(bad, F.raise_error(F.lit("estimates can't be missing, and their errors must be over 0")).cast("double")).otherwise(F.col("bhat") / F.col("shat")))


def quality(assoc: DataFrame, ld_rows: DataFrame) -> DataFrame:
    """One row per region: variables, missing and infinite z, whether the matrix is square, complete and finite, its least diagonal entry and its greatest asymmetry."""
    z = F.col("z").cast("double")
    a = assoc.groupBy("region_id").agg(F.count("*").alias("variables"), F.count_if(z.isNull() | F.isnan(z)).alias("missing_z"), F.count_if(F.abs(z) == INF).alias("infinite_z"), F.max("idx").alias("last"), F.count_distinct("idx").alias("distinct"))
    shape = ld_rows.groupBy("region_id").agg(F.count("*").alias("rows"), F.min(F.size("r")).alias("shortest"), F.max(F.size("r")).alias("longest"), F.count_if(F.exists("r", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == INF))).alias("bad_rows"), F.min(F.get("r", F.col("i"))).alias("least_diagonal"))
    out = a.join(shape, "region_id", "full").join(asymmetry(ld_rows), "region_id", "left")
    good = (F.col("rows") == F.col("variables")) & (F.col("shortest") == F.col("variables")) & (F.col("longest") == F.col("variables")) & (F.col("bad_rows") == 0) & (F.col("least_diagonal") >= 0) & (F.col("infinite_z") == 0) & (F.col("distinct") == F.col("variables")) & (F.col("last") == F.col("variables") - 1)
    return out.withColumn("usable", F.coalesce(good, F.lit(False))).drop("last", "distinct", "shortest", "longest")


def asymmetry(ld_rows: DataFrame) -> DataFrame:
    """(region_id, unequal, max_asymmetry): pairs i < j whose two entries differ. Each row meets the columns of the same index, as arrays."""
    columns = ld_rows.select("region_id", F.posexplode("r").alias("i", "v"), F.col("i").alias("j")).groupBy("region_id", "i").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("column"))
    rows = ld_rows.join(columns, ["region_id", "i"])
    gaps = F.transform(F.filter(F.transform("r", lambda v, j: F.struct(j.alias("j"), v.alias("v"))), lambda s: s["j"] > F.col("i")), lambda s: F.abs(s["v"] - F.element_at(F.col("column"), s["j"])))
    each = rows.select("region_id", gaps.alias("gaps"))
    return each.groupBy("region_id").agg(F.sum(F.size(F.filter("gaps", lambda g: g > 0))).alias("unequal"), F.coalesce(F.max(F.array_max("gaps")), F.lit(0.0)).alias("max_asymmetry"))


def symmetrised(ld_rows: DataFrame) -> DataFrame:
    """The rows of (A + A') / 2."""
    entries = ld_rows.select("region_id", "i", F.posexplode("r").alias("j", "r"))
    both = entries.unionByName(entries.select("region_id", F.col("j").alias("i"), F.col("i").alias("j"), "r"))
    mean = both.groupBy("region_id", "i", "j").agg(F.avg("r").alias("r"))
    return mean.groupBy("region_id", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "r"))), lambda s: s["r"]).alias("r"))


def maf_filtered(assoc: DataFrame, ld_rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Associations and correlations of the variables whose frequency exceeds the threshold (strictly), numbered anew; the old number is ``old_idx``.

    Regions without any such variable have no rows left.
    """
    place = F.row_number().over(Window.partitionBy("region_id").orderBy("idx")) - 1
    kept = assoc.where(F.col("maf") > threshold).withColumn("old_idx", F.col("idx")).withColumn("idx", place.cast("int"))
    order = kept.groupBy("region_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "old_idx"))), lambda s: s["old_idx"]).alias("order"))
    rows = ld_rows.join(kept.select("region_id", F.col("old_idx").alias("i"), "idx"), ["region_id", "i"]).join(order, "region_id")
    return kept, rows.select("region_id", F.col("idx").alias("i"), F.transform("order", lambda j: F.get(F.col("r"), j)).alias("r"))


def prior_weights(assoc: DataFrame, null_weight: float = 0.0) -> DataFrame:
    """The associations with weights that sum to 1 in each region, less the null column's share."""
    total = F.sum("weight").over(Window.partitionBy("region_id"))
    return assoc.withColumn("weight", F.col("weight") * (1 - null_weight) / (total * (1 - null_weight) + null_weight))


def complete_samples(samples: DataFrame) -> DataFrame:
    """Samples with a response."""
    return samples.where(F.col("y").isNotNull() & ~F.isnan("y"))


def densified(samples: DataFrame, variables: int) -> DataFrame:
    """Samples of a sparse design, whose ``x`` is (indices, values), with ``x`` as an array of all variables; what isn't named is 0."""
    entries = F.map_from_arrays(F.col("x.indices"), F.col("x.values"))
    return samples.withColumn("x", F.transform(F.sequence(F.lit(0), F.lit(variables - 1)), lambda j: F.coalesce(F.try_element_at(entries, j), F.lit(0.0))))


def absolute_order(rows: DataFrame, value: str) -> DataFrame:
    """(…, place): variables of a region by falling absolute value, ties to the smaller index."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("region_id").orderBy(F.abs(value).desc(), "idx")))


def path_order(path: DataFrame) -> DataFrame:
    """(region_id, idx, place): variables by the first step of a path at which their coefficient isn't 0, then those that stay 0. ``path``: region_id, step, idx, coef."""
    first = path.groupBy("region_id", "idx").agg(F.min(F.when(F.col("coef") != 0, F.col("step"))).alias("entered"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("region_id").orderBy(F.col("entered").asc_nulls_last(), "idx")))
