"""Posterior queries over fit tables (region_id, component_id, idx, alpha, mu, mu2, V, ...), in DataFrame operations.

Correlations come as rows of a matrix, (region_id, i, r), so that only the rows of set members
are read and no pair of variables becomes a row. Keys of a fit are the region and, if the table
has that column, the setting.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.special import normal_cdf

PRIOR_TOL = 1e-9
#: An effect has a credible set if its variance exceeds this, whatever the tolerance of inclusion probabilities.
SET_TOL = 1e-9


def keys(fit: DataFrame) -> list[str]:
    return ["region_id", "setting"] if "setting" in fit.columns else ["region_id"]


def _without_null(fit: DataFrame) -> DataFrame:
    return fit.where(F.col("null_index").isNull() | (F.col("idx") != F.col("null_index"))) if "null_index" in fit.columns else fit


def _slot(fit: DataFrame) -> Column:
    return F.coalesce(F.col("slot_weight"), F.lit(1.0)) if "slot_weight" in fit.columns else F.lit(1.0)


def pip(fit: DataFrame, prior_tol: float = PRIOR_TOL, sets: DataFrame | None = None) -> DataFrame:
    """Inclusion probability of each variable over the active effects (of ``sets`` only, if given); 0 without any."""
    kept = F.col("V") > prior_tol
    rows = _without_null(fit)
    if sets is not None:
        rows = rows.join(sets.select(*keys(fit), "component_id", F.lit(True).alias("in_set")), [*keys(fit), "component_id"], "left")
        kept = kept & F.coalesce("in_set", F.lit(False))
    return rows.groupBy(*keys(fit), "idx").agg((1 - F.product(F.when(kept, 1 - F.col("alpha") * _slot(rows)).otherwise(1.0))).alias("pip"))


def posterior_moments(fit: DataFrame, prior_tol: float = PRIOR_TOL, scales: DataFrame | None = None) -> DataFrame:
    """Mean and standard deviation of each variable's effect over the active components; ``scales`` (region_id, idx, scale) brings them to the data's."""
    on = F.col("V") > prior_tol
    rows = _without_null(fit).withColumn("m", F.when(on, F.col("alpha") * F.col("mu")).otherwise(0.0)).withColumn("s", F.when(on, F.col("alpha") * F.col("mu2")).otherwise(0.0))
    out = rows.groupBy(*keys(fit), "idx").agg(F.sum("m").alias("mean"), F.sqrt(F.greatest(F.sum(F.col("s") - F.col("m") * F.col("m")), F.lit(0.0))).alias("sd"))
    if scales is None:
        return out
    return out.join(scales, ["region_id", "idx"]).select(*keys(fit), "idx", (F.col("mean") / F.col("scale")).alias("mean"), (F.col("sd") / F.col("scale")).alias("sd"))


def coefficients(fit: DataFrame, scales: DataFrame | None = None) -> DataFrame:
    """All effects count, active or not, by their slot weights."""
    out = _without_null(fit).groupBy(*keys(fit), "idx").agg(F.sum(F.col("alpha") * F.col("mu") * _slot(fit)).alias("coef"))
    return out if scales is None else out.join(scales, ["region_id", "idx"]).select(*keys(fit), "idx", (F.col("coef") / F.col("scale")).alias("coef"))


def intercepts(coef: DataFrame, means: DataFrame) -> DataFrame:
    """(region_id, intercept) from coefficients on the data's scale and ``means``: region_id, idx, mean, y_mean."""
    return coef.join(means, ["region_id", "idx"]).groupBy(*keys(coef)).agg((F.max("y_mean") - F.sum(F.col("coef") * F.col("mean"))).alias("intercept"))


def predict(samples: DataFrame, coef: DataFrame, intercept: DataFrame) -> DataFrame:
    """The samples with ``fitted``. ``samples``: region_id, x (array); one row of coefficients a region is joined, not one a variable."""
    packed = coef.groupBy(*keys(coef)).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "coef"))), lambda s: s["coef"]).alias("_coef")).join(intercept, keys(coef))
    dot = F.aggregate(F.zip_with("x", "_coef", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return samples.join(packed, "region_id").withColumn("fitted", dot + F.col("intercept")).drop("_coef", "intercept")


@F.pandas_udf(DoubleType())
def _cdf(x: pd.Series) -> pd.Series:
    return pd.Series(normal_cdf(x.to_numpy(float)))


def local_false_sign_rate(fit: DataFrame) -> DataFrame:
    """By component: the probability that the sign of its effect is wrong. Without spread the sign of the mean is certain."""
    sd = F.sqrt(F.greatest(F.col("mu2") - F.col("mu") * F.col("mu"), F.lit(0.0)))
    rows = _without_null(fit).withColumn("sd", sd)
    below = F.when(F.col("sd") > 0, _cdf(F.when(F.col("sd") > 0, -F.col("mu") / F.col("sd")).otherwise(0.0))).otherwise(F.when(F.col("mu") <= 0, 1.0).otherwise(0.0))
    return rows.withColumn("below", below).groupBy(*keys(fit), "component_id").agg(F.greatest(1 - F.sum(F.col("alpha") * F.greatest(F.col("below"), 1 - F.col("below"))), F.lit(0.0)).alias("lfsr"))


def entropy(fit: DataFrame) -> DataFrame:
    """By component: entropy of alpha and the effective number of candidates."""
    h = -F.sum(F.when(F.col("alpha") > 0, F.col("alpha") * F.log("alpha")).otherwise(0.0))
    return fit.groupBy(*keys(fit), "component_id").agg(h.alias("entropy"), F.exp(h).alias("effective"))


def ranked(fit: DataFrame) -> DataFrame:
    """The fit with ``rank`` in its component, by falling alpha and ties to the smaller index, and the mass ``before`` and up to it."""
    order = Window.partitionBy(*keys(fit), "component_id").orderBy(F.col("alpha").desc(), "idx")
    before = F.coalesce(F.sum("alpha").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return fit.withColumn("rank", F.row_number().over(order)).withColumn("before", before).withColumn("cumulative", F.col("before") + F.col("alpha"))


def set_candidates(fit: DataFrame, coverage: float = 0.95) -> DataFrame:
    """Every component's least set of variables whose alpha reaches the coverage, one variable at least."""
    rows = ranked(fit).where((F.col("rank") == 1) | (F.col("before") < coverage))
    extra = [F.first("null_index").alias("null_index")] if "null_index" in fit.columns else [F.lit(None).cast("int").alias("null_index")]
    return rows.groupBy(*keys(fit), "component_id").agg(F.array_sort(F.collect_list("idx")).alias("members"), F.sum("alpha").alias("mass"), F.first("V").alias("V"), *extra)


def credible_set_members(fit: DataFrame, coverage: float = 0.95) -> DataFrame:
    """The variables of each active effect's set, before any other test of the set."""
    return ranked(fit).where((F.col("V") > SET_TOL) & ((F.col("rank") == 1) | (F.col("before") < coverage))).select(*keys(fit), "component_id", "idx", "alpha", "rank")


def purity(sets: DataFrame, ld_rows: DataFrame) -> DataFrame:
    """Least, mean and median absolute correlation of the pairs in each set (columns region_id, component_id, members); 1 for a single member."""
    k = [*keys(sets), "component_id"]
    each = sets.select(*k, "members", F.explode("members").alias("i")).join(ld_rows.select("region_id", "i", "r"), ["region_id", "i"])
    pairs = each.select(*k, F.explode(F.transform(F.filter("members", lambda j: j > F.col("i")), lambda j: F.abs(F.get(F.col("r"), j)))).alias("r"))
    found = pairs.groupBy(*k).agg(F.min("r").alias("min_abs_corr"), F.avg("r").alias("mean_abs_corr"), F.median("r").alias("median_abs_corr"), F.count("*").alias("pairs"))
    single = F.when(F.size("members") == 1, F.lit(1.0))
    return sets.join(found, k, "left").withColumns({c: F.coalesce(single, F.col(c)) for c in ("min_abs_corr", "mean_abs_corr", "median_abs_corr")}).withColumn("pairs", F.coalesce("pairs", F.lit(0)))


def extended(sets: DataFrame, ld_rows: DataFrame, corr: float) -> DataFrame:
    """Sets with every variable whose absolute correlation with any member exceeds ``corr``; the null column never joins."""
    k = [*keys(sets), "component_id"]
    each = sets.select(*k, F.explode("members").alias("i")).join(ld_rows.select("region_id", "i", "r"), ["region_id", "i"])
    near = each.select(*k, F.explode(F.filter(F.transform("r", lambda v, j: F.when(F.abs(v) > corr, j)), lambda j: j.isNotNull())).alias("j"))
    joined = near.groupBy(*k).agg(F.collect_set("j").alias("near"))
    return sets.join(joined, k, "left").withColumn("members", F.array_sort(F.array_union("members", F.coalesce("near", F.array().cast("array<int>"))))).drop("near")


def credible_set_audit(fit: DataFrame, ld_rows: DataFrame | None = None, coverage: float | None = 0.95, *, min_abs_corr: float | None = 0.5, median_abs_corr: float | None = None, extension_corr: float | None = None) -> DataFrame:
    """What became of each component's set: members, mass, purity and ``reason`` (retained, duplicate, inactive, contains_null, low_purity, purity_unavailable, disabled).

    Equal sets count once, for the first component, even where that one is inactive. Sets are
    extended before their purity is measured. A set is pure enough if its least correlation
    reaches ``min_abs_corr`` or its median ``median_abs_corr``; without correlations, or without
    thresholds, no set is dropped for purity. Without coverage there are no sets.
    """
    sets = set_candidates(fit, 0.95 if coverage is None else coverage)
    same = Window.partitionBy(*keys(fit), "members").orderBy("component_id")
    sets = sets.withColumn("nth", F.row_number().over(same)).withColumn("candidate", F.col("members"))
    if ld_rows is not None and extension_corr is not None:
        sets = extended(sets, ld_rows, extension_corr)
        inside = fit.select(*keys(fit), "component_id", "idx", "alpha").join(sets.select(*keys(fit), "component_id", F.explode("members").alias("idx")), [*keys(fit), "component_id", "idx"])
        sets = sets.drop("mass").join(inside.groupBy(*keys(fit), "component_id").agg(F.sum("alpha").alias("mass")), [*keys(fit), "component_id"])
    none = F.lit(None).cast("double")
    sets = purity(sets, ld_rows) if ld_rows is not None else sets.withColumns({c: none for c in ("min_abs_corr", "mean_abs_corr", "median_abs_corr")}).withColumn("pairs", F.lit(0))
    pure = F.lit(ld_rows is None or min_abs_corr is None and median_abs_corr is None)
    if min_abs_corr is not None:
        pure = pure | (F.col("min_abs_corr") >= min_abs_corr)
    if median_abs_corr is not None:
        pure = pure | (F.col("median_abs_corr") >= median_abs_corr)
    reason = F.when(F.lit(coverage is None), "disabled").when(F.col("nth") > 1, "duplicate").when(F.col("V") <= SET_TOL, "inactive").when(F.array_contains("members", F.col("null_index")), "contains_null")
    if ld_rows is not None and (min_abs_corr is not None or median_abs_corr is not None):
        reason = reason.when(F.col("min_abs_corr").isNull(), "purity_unavailable")
    reason = reason.when(~pure, "low_purity").otherwise("retained")
    return sets.select(*keys(fit), "component_id", "candidate", "members", F.size("members").alias("size"), F.col("mass").alias("coverage"), F.lit(coverage).cast("double").alias("requested_coverage"), "min_abs_corr", "mean_abs_corr", "median_abs_corr", reason.alias("reason"))


def credible_sets(fit: DataFrame, ld_rows: DataFrame | None = None, coverage: float | None = 0.95, min_abs_corr: float | None = 0.5, **options) -> DataFrame:
    """The retained sets, purest first (``place`` from 1 in each fit)."""
    kept = credible_set_audit(fit, ld_rows, coverage, min_abs_corr=min_abs_corr, **options).where("reason = 'retained'").drop("reason", "candidate")
    order = Window.partitionBy(*keys(fit)).orderBy(F.coalesce(F.col("min_abs_corr"), F.lit(-1.0)).desc(), "component_id")
    return kept.withColumn("place", F.row_number().over(order))


def attainable_sets(fit: DataFrame, coverage: float = 0.95, effective: float | None = None) -> DataFrame:
    """Sets of the variables that a component holds more of than any other, where their mass exceeds the coverage and the component is concentrated enough.

    A component counts if the effective number of its candidates is under ``effective``, by
    default the larger of 100 and a tenth of the variables.
    """
    k = keys(fit)
    own = fit.withColumn("best", F.max("alpha").over(Window.partitionBy(*k, "idx"))).where("alpha = best AND alpha > 0")
    mass = own.groupBy(*k, "component_id").agg(F.sum("alpha").alias("mass"), F.count("*").alias("attainable"))
    limit = F.lit(float(effective)) if effective else F.greatest(F.lit(100.0), 0.1 * F.col("p"))
    p = fit.groupBy(*k).agg(F.count_distinct("idx").alias("p"))
    good = mass.join(entropy(fit), [*k, "component_id"]).join(p, k).where((F.col("mass") > coverage) & (F.col("entropy") < F.log(limit))).select(*k, "component_id", "mass", "attainable")
    order = Window.partitionBy(*k, "component_id").orderBy(F.col("alpha").desc(), "idx")
    before = F.coalesce(F.sum("alpha").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = own.join(good, [*k, "component_id"]).withColumn("before", before).where(F.col("before") < coverage)
    return rows.groupBy(*k, "component_id", "mass", "attainable").agg(F.array_sort(F.collect_list("idx")).alias("members"))


def set_correlations(fit: DataFrame, sets: DataFrame, ld_rows: DataFrame) -> DataFrame:
    """(component_a, component_b, r) between the variables of highest inclusion probability of each two sets; no rows where a fit has fewer than two."""
    k = keys(fit)
    each = sets.select(*k, "component_id", F.explode("members").alias("idx")).join(pip(fit), [*k, "idx"])
    top = each.groupBy(*k, "component_id").agg(F.min_by("idx", F.struct((-F.col("pip")).alias("p"), "idx")).alias("idx"))
    a, b = (top.select(*k, F.col("component_id").alias(f"component_{s}"), F.col("idx").alias(f"idx_{s}")) for s in "ab")
    rows = a.join(b, k).where("component_a < component_b").join(ld_rows.select("region_id", F.col("i").alias("idx_a"), "r"), ["region_id", "idx_a"])
    return rows.select(*k, "component_a", "component_b", "idx_a", "idx_b", F.get("r", F.col("idx_b")).alias("r"))


def coloc(a: DataFrame, b: DataFrame, p1: float = 1e-4, p2: float = 1e-4, p12: float = 5e-6) -> DataFrame:
    """Posterior of H0..H4 for each pair of components, from log Bayes factors of shared variables."""
    x = a.select("region_id", "idx", F.col("component_id").alias("hit1"), F.col("lbf_variable").alias("l1")).join(b.select("region_id", "idx", F.col("component_id").alias("hit2"), F.col("lbf_variable").alias("l2")), ["region_id", "idx"])
    k = ["region_id", "hit1", "hit2"]
    w = Window.partitionBy(*k)
    for c, e in (("l1", "l1"), ("l2", "l2"), ("l12", "l1 + l2")):
        x = x.withColumn("v_" + c, F.expr(e)).withColumn("m_" + c, F.max("v_" + c).over(w))
    lse = lambda c: (F.max("m_" + c) + F.log(F.sum(F.exp(F.col("v_" + c) - F.col("m_" + c))))).alias("s_" + c)
    s = x.groupBy(*k).agg(lse("l1"), lse("l2"), lse("l12"))
    distinct = F.col("s_l1") + F.col("s_l2") + F.log(F.greatest(1 - F.exp(F.col("s_l12") - F.col("s_l1") - F.col("s_l2")), F.lit(1e-300)))
    s = s.withColumn("h", F.array(F.lit(0.0), F.log(F.lit(p1)) + F.col("s_l1"), F.log(F.lit(p2)) + F.col("s_l2"), F.log(F.lit(p1)) + F.log(F.lit(p2)) + distinct, F.log(F.lit(p12)) + F.col("s_l12")))
    s = s.withColumn("top", F.array_max("h")).withColumn("e", F.transform("h", lambda v: F.exp(v - F.col("top")))).withColumn("t", F.aggregate("e", F.lit(0.0), lambda u, v: u + v))
    return s.select(*k, *[(F.col("e")[i] / F.col("t")).alias(f"pp_h{i}") for i in range(5)])


def outcome_configurations(fits: DataFrame, by: str = "outcome", threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Posterior of all 2^N on-off configurations of N outcomes, and each outcome's probability of taking part.

    ``fits``: region_id, outcome (int from 0, up to 20 of them), component_id, idx, lbf_variable.
    By "outcome", components of one id belong together across outcomes; by "fit", all
    combinations of components are looked at. A configuration's evidence is the mean, over all
    variables of the tuple, of the product of its active outcomes' Bayes factors; variables that
    an active outcome lacks have none.
    """
    if by not in ("outcome", "fit"):
        raise ValueError(f"by: {by}")
    top = fits.agg(F.max("outcome")).first()[0]
    n = 0 if top is None else top + 1
    if n > 20:
        raise ValueError("at most 20 outcomes")
    parts = fits.select("region_id", "outcome", "component_id").distinct()
    if by == "outcome":
        tuples = parts.groupBy("region_id", "component_id").agg(F.count("*").alias("n")).where(F.col("n") == n).select("region_id", F.array_repeat("component_id", n).alias("components"))
    else:  # a few components a region: their combinations are a small table
        tuples = parts.where("outcome = 0").select("region_id", F.array("component_id").alias("components"))
        for k in range(1, n):
            own = parts.where(F.col("outcome") == k).select("region_id", F.col("component_id").alias("next"))
            tuples = tuples.join(own, "region_id").select("region_id", F.concat("components", F.array("next")).alias("components"))
    member = tuples.select("region_id", "components", F.posexplode("components").alias("outcome", "component_id")).join(fits.select("region_id", "outcome", "component_id", "idx", "lbf_variable"), ["region_id", "outcome", "component_id"])
    by_variable = member.groupBy("region_id", "components", "idx").agg(F.map_from_entries(F.collect_list(F.struct("outcome", "lbf_variable"))).alias("lbf"))
    sizes = by_variable.groupBy("region_id", "components").agg(F.count("*").alias("variables"))
    bits = lambda c: F.filter(F.sequence(F.lit(0), F.lit(max(0, n - 1))), lambda b: F.getbit(c, b) == 1)
    total = lambda c: F.aggregate(bits(c), F.lit(0.0), lambda s, o: s + F.element_at(F.col("lbf"), o))  # noqa: E731  null where an active outcome lacks the variable
    rows = by_variable.select("region_id", "components", F.explode(F.sequence(F.lit(1), F.lit((1 << n) - 1))).alias("config"), "lbf").withColumn("v", total(F.col("config"))).where("v IS NOT NULL")
    best = rows.groupBy("region_id", "components", "config").agg(F.max("v").alias("m"), F.collect_list("v").alias("vs"))
    logs = best.join(sizes, ["region_id", "components"]).withColumn("log_bf", F.col("m") + F.log(F.aggregate("vs", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("m")))) - F.log(F.col("variables").cast("double"))).select("region_id", "components", "config", "log_bf")
    off = tuples.select("region_id", "components", F.lit(0).alias("config"), F.lit(0.0).alias("log_bf"))
    every = logs.unionByName(off)
    w = Window.partitionBy("region_id", "components")
    peak = F.max("log_bf").over(w)
    weighted = every.withColumn("weight", F.exp(F.col("log_bf") - peak))
    configs = weighted.withColumn("probability", F.col("weight") / F.sum("weight").over(w)).drop("weight").withColumn("active", bits(F.col("config")))
    marginal = configs.select("region_id", "components", F.explode("active").alias("outcome"), "probability").groupBy("region_id", "components", "outcome").agg(F.sum("probability").alias("probability")).withColumn("active", F.col("probability") >= threshold)
    return configs, marginal
