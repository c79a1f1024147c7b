"""Tables that summarise fits: variables, components, sets, proxies, relations, influence of the prior, quality of the input."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.special import log10_p_value
from . import posterior
from .posterior import keys

ROOT_EPS = 2.0**-26


@F.pandas_udf(DoubleType())
def neg_log10_p(z: pd.Series) -> pd.Series:
    """-log10 of the two-sided p value, also where it is too small for a double."""
    return pd.Series(log10_p_value(z.to_numpy(float))).where(z.notna())


def variants(fit: DataFrame, sets: DataFrame | None = None, assoc: DataFrame | None = None) -> DataFrame:
    """One row per variable: inclusion probability, place by it (ties to the smaller index), posterior mean and sd, the sets that hold it, z and its p value."""
    k = keys(fit)
    out = posterior.pip(fit).join(posterior.posterior_moments(fit), [*k, "idx"])
    out = out.withColumn("place", F.row_number().over(Window.partitionBy(*k).orderBy(F.col("pip").desc(), "idx")))
    if sets is not None:
        held = sets.select(*k, "component_id", F.explode("members").alias("idx")).groupBy(*k, "idx").agg(F.array_sort(F.collect_list("component_id")).alias("sets"))
        out = out.join(held, [*k, "idx"], "left")
    if assoc is not None:
        out = out.join(assoc.select("region_id", "idx", "z").withColumn("neg_log10_p", neg_log10_p("z")), ["region_id", "idx"], "left")
    return out


def components(fit: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """One row per component: variance, evidence, entropy, leading variable, and whether it is active and has a set."""
    k = keys(fit)
    out = fit.groupBy(*k, "component_id").agg(F.first("V").alias("V"), F.first("lbf").alias("lbf"), (F.first("lbf") / F.log(F.lit(10.0))).alias("log10_bf"), F.min_by("idx", F.struct((-F.col("alpha")).alias("a"), "idx")).alias("top_idx"), F.max("alpha").alias("top_alpha"))
    out = out.join(posterior.entropy(fit), [*k, "component_id"]).withColumn("active", F.col("V") > posterior.SET_TOL)
    if sets is not None:
        out = out.join(sets.select(*k, "component_id", F.lit(True).alias("retained")), [*k, "component_id"], "left").withColumn("retained", F.coalesce("retained", F.lit(False)))
    return out


def set_relations(sets: DataFrame) -> DataFrame:
    """Pairs of sets of a fit that share variables: shared, Jaccard index, and whether one holds the other."""
    k = keys(sets)
    a, b = (sets.select(*k, F.col("component_id").alias(s), F.col("members").alias(f"m_{s}")) for s in "ab")
    rows = a.join(b, k).where("a < b").withColumn("shared", F.size(F.array_intersect("m_a", "m_b"))).where("shared > 0")
    union = F.size(F.array_union("m_a", "m_b"))
    return rows.select(*k, "a", "b", "shared", (F.col("shared") / union).alias("jaccard"), F.when((F.col("shared") == F.size("m_a")) & (F.col("shared") == F.size("m_b")), "equal").when(F.col("shared") == F.size("m_a"), "a_in_b").when(F.col("shared") == F.size("m_b"), "b_in_a").otherwise("overlap").alias("relation"))


def proxies(sets: DataFrame, ld_rows: DataFrame, r: float = 0.99) -> DataFrame:
    """Variables outside a set whose absolute correlation with a member is ``r`` or more."""
    k = keys(sets)
    each = sets.select(*k, "component_id", "members", F.explode("members").alias("i")).join(ld_rows.select("region_id", "i", "r"), ["region_id", "i"])
    near = F.filter(F.transform("r", lambda v, j: F.struct(j.alias("proxy"), v.alias("r"))), lambda s: F.abs(s["r"]) >= r)
    rows = each.select(*k, "component_id", F.col("i").alias("member"), "members", F.explode(near).alias("s"))
    return rows.where(~F.array_contains("members", F.col("s.proxy"))).select(*k, "component_id", "member", "s.proxy", "s.r")


def representatives(fit: DataFrame, sets: DataFrame) -> DataFrame:
    """The member of greatest alpha of each set, ties to the smaller index."""
    k = [*keys(fit), "component_id"]
    inside = sets.select(*k, F.explode("members").alias("idx")).join(fit.select(*k, "idx", "alpha"), [*k, "idx"])
    return inside.groupBy(*k).agg(F.min_by("idx", F.struct((-F.col("alpha")).alias("a"), "idx")).alias("idx"), F.max("alpha").alias("alpha"))


def prior_influence(fit: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """Log posterior odds of each variable against its component's leading one, as the sum of what the prior and what the data say.

    ``priors``: region_id, idx, weight (normalised); equal ones otherwise. ``error`` is what the
    two parts miss of the odds; over 1e-8 the status says so.
    """
    k = keys(fit)
    rows = fit if priors is None else fit.join(priors.select("region_id", "idx", "weight"), ["region_id", "idx"])
    rows = rows.withColumn("log_prior", F.log(F.col("weight") + ROOT_EPS) if priors is not None else F.lit(0.0))
    order = Window.partitionBy(*k, "component_id").orderBy(F.col("alpha").desc(), "idx")
    top = lambda c: F.first_value(c).over(order)
    rows = rows.withColumns({"delta_log_prior": F.col("log_prior") - top(F.col("log_prior")), "delta_lbf": F.col("lbf_variable") - top(F.col("lbf_variable")), "log_odds": F.when(F.col("alpha") > 0, F.log("alpha")) - F.log(top(F.col("alpha"))), "top_idx": top(F.col("idx"))})
    rows = rows.withColumn("error", F.abs(F.col("log_odds") - F.col("delta_log_prior") - F.col("delta_lbf")))
    status = F.when(F.col("V") <= posterior.SET_TOL, "inactive").when(F.col("error").isNull(), "no_mass").when(F.col("error") < 1e-8, "exact").otherwise("inexact")
    return rows.select(*k, "component_id", "idx", "top_idx", "delta_log_prior", "delta_lbf", "log_odds", "error", status.alias("status"))


def column_summary(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Least, middle and greatest value, and how many are missing (null or NaN)."""
    value = F.when(~F.isnan(F.col(column).cast("double")), F.col(column))
    return rows.groupBy(*by).agg(F.min(value).alias("low"), F.median(value).alias("middle"), F.max(value).alias("high"), F.count_if(value.isNull()).alias("missing"))


def model_summary(fit: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Variables with inclusion probability and set (-1 in none; of several the last by place), by falling probability where there is a set; and the sets with log10 Bayes factor and r²."""
    k = keys(fit)
    held = sets.select(*k, "component_id", "place", F.explode("members").alias("idx")).groupBy(*k, "idx").agg(F.max_by("component_id", "place").alias("cs"))
    any_set = sets.select(*k).distinct().withColumn("some", F.lit(True))
    rows = posterior.pip(fit).join(held, [*k, "idx"], "left").join(any_set, k, "left")
    order = Window.partitionBy(*k).orderBy(F.when(F.col("some"), -F.col("pip")).otherwise(0.0), "idx")
    variables = rows.withColumn("place", F.row_number().over(order)).select(*k, "idx", "pip", F.coalesce("cs", F.lit(-1)).alias("cs"), "place")
    bf = fit.groupBy(*k, "component_id").agg((F.first("lbf") / F.log(F.lit(10.0))).alias("log10_bf"))
    found = sets.join(bf, [*k, "component_id"]).select(*k, "component_id", "log10_bf", (F.col("mean_abs_corr") ** 2).alias("mean_r2"), (F.col("min_abs_corr") ** 2).alias("min_r2"), "members")
    return variables, found


def top_candidates(fit: DataFrame, sets: DataFrame, k_top: int = 3) -> DataFrame:
    """The first ``k_top`` variables by alpha of each set, and by inclusion probability of each region."""
    k = keys(fit)
    inside = sets.select(*k, "component_id", F.explode("members").alias("idx")).join(fit.select(*k, "component_id", "idx", "alpha"), [*k, "component_id", "idx"])
    by_set = inside.withColumn("place", F.row_number().over(Window.partitionBy(*k, "component_id").orderBy(F.col("alpha").desc(), "idx"))).where(F.col("place") <= k_top)
    by_pip = posterior.pip(fit).withColumn("place", F.row_number().over(Window.partitionBy(*k).orderBy(F.col("pip").desc(), "idx"))).where(F.col("place") <= k_top)
    return by_set.select(*k, F.lit("set").alias("source"), "component_id", "idx", "place", F.col("alpha").alias("value")).unionByName(by_pip.select(*k, F.lit("region").alias("source"), F.lit(None).cast("int").alias("component_id"), "idx", "place", F.col("pip").alias("value")))


def candidate_sources(fit: DataFrame, members: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Variables that a set or their inclusion probability names, with which of both."""
    k = keys(fit)
    named = members.select(*k, "idx", F.lit(1).alias("in_set"), F.lit(0).alias("by_pip")).unionByName(posterior.pip(fit).where(F.col("pip") >= threshold).select(*k, "idx", F.lit(0).alias("in_set"), F.lit(1).alias("by_pip")))
    return named.groupBy(*k, "idx").agg(F.max("in_set").alias("in_set"), F.max("by_pip").alias("by_pip"))


def summarize(fit: DataFrame, ld_rows: DataFrame | None = None, *, coverage: float = 0.95, min_abs_corr: float = 0.5, proxy_r: float = 0.99, assoc: DataFrame | None = None, priors: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of a fit by name; nothing is fitted again."""
    audit = posterior.credible_set_audit(fit, ld_rows, coverage, min_abs_corr=min_abs_corr)
    sets = posterior.credible_sets(fit, ld_rows, coverage, min_abs_corr)
    out = {"variants": variants(fit, sets, assoc), "components": components(fit, sets), "credible_sets": sets, "cs_audit": audit, "cs_relations": set_relations(sets), "prior_influence": prior_influence(fit, priors), "representatives": representatives(fit, sets)}
    if ld_rows is not None:
        out["proxies"] = proxies(sets, ld_rows, proxy_r)
    return out
