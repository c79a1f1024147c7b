"""Single-effect regressions of many regions and outcomes at once, from marginal z scores alone, in DataFrame operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keeps the prior of a variable of weight 0 above 0.
ROOT_EPS = 2.0**-26


def log_bayes_factor(z: Column, n: Column, V: float) -> Column:
    """Of a standardised effect of prior variance V, from an adjusted z score of n samples; 0 where z is missing."""
    s2 = 1 / (n - 1)
    value = -0.5 * F.log(1 + V / s2) + 0.5 * z * z * V / (V + s2)
    return F.when(z.isNotNull() & ~F.isnan(z), value).otherwise(0.0)


def single_effects(assoc: DataFrame, V: float = 0.2, *, mixture: list[tuple[float, float]] | None = None, null_weight: float = 0.0, weight: str | None = None) -> DataFrame:
    """A fit table of one component for each region and outcome, which becomes ``component_id``.

    ``assoc``: region_id, outcome, idx, n, z_adjusted, and a column of prior weights if
    ``weight`` names it. A mixture is a list of (variance, weight). With a null weight there is
    one more row, of index ``null_index``, without evidence.
    """
    k = ["region_id", "outcome"]
    w = Window.partitionBy(*k)
    z, n = F.col("z_adjusted"), F.col("n")
    rows = assoc.select(*k, "idx", "n", F.col("z_adjusted"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    if weight is None:
        rows = rows.withColumn("w", 1 / F.count("*").over(w))
    if mixture:
        total = sum(x for _, x in mixture)
        each = [F.log(F.lit(x / total)) + log_bayes_factor(z, n, v) for v, x in mixture]
        top = reduce(lambda a, b: F.greatest(a, b), each)
        lbf = top + F.log(reduce(lambda a, b: a + b, [F.exp(e - top) for e in each]))
        effective = sum(v * x for v, x in mixture) / total
        share = [F.exp(e - F.col("lbf_variable")) for e in each]
        moment = lambda v: (v / (v + 1 / (n - 1)) * z / F.sqrt(n - 1), v / (v * (n - 1) + 1))
        mu = reduce(lambda a, b: a + b, [s * moment(v)[0] for s, (v, _) in zip(share, mixture)])
        mu2 = reduce(lambda a, b: a + b, [s * (moment(v)[0] * moment(v)[0] + moment(v)[1]) for s, (v, _) in zip(share, mixture)])
    else:
        lbf, effective = log_bayes_factor(z, n, V), V
        mu = V / (V + 1 / (n - 1)) * z / F.sqrt(n - 1)
        mu2 = mu * mu + V / (V * (n - 1) + 1)
    rows = rows.withColumn("lbf_variable", lbf).withColumn("mu", F.coalesce(mu, F.lit(0.0))).withColumn("mu2", F.coalesce(mu2, F.lit(0.0)))
    rows = rows.select(*k, "idx", "w", "lbf_variable", "mu", "mu2")
    if null_weight:
        p = rows.groupBy(*k).agg((F.max("idx") + 1).alias("idx"))
        null = p.select(*k, "idx", F.lit(null_weight).alias("w"), *[F.lit(0.0).alias(c) for c in ("lbf_variable", "mu", "mu2")], F.lit(True).alias("null"))
        rows = rows.withColumn("w", F.col("w") * (1 - null_weight)).withColumn("null", F.lit(False)).unionByName(null)
    else:
        rows = rows.withColumn("null", F.lit(False))
    rows = rows.withColumn("v", F.log(F.col("w") / F.sum("w").over(w) + ROOT_EPS) + F.col("lbf_variable")).withColumn("top", F.max("v").over(w))
    rows = rows.withColumn("e", F.exp(F.col("v") - F.col("top"))).withColumn("total", F.sum("e").over(w))
    null_index = F.max(F.when(F.col("null"), F.col("idx"))).over(w)
    return rows.select("region_id", F.col("outcome").alias("component_id"), "idx", (F.col("e") / F.col("total")).alias("alpha"), "mu", "mu2", "lbf_variable", F.lit(float(effective)).alias("V"), (F.col("top") + F.log("total")).alias("lbf"), null_index.alias("null_index"))


def em_variance(fit: DataFrame) -> DataFrame:
    """(region_id, component_id, V) after one step of expectation and maximisation."""
    return fit.groupBy("region_id", "component_id").agg(F.sum(F.col("alpha") * F.col("mu2")).alias("V"))
