"""The tables behind figures: what a plot of a region, a signal, a comparison or a fit's sweeps would show. Nothing is drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import analysis, posterior
from .posterior import keys


def locus(fit: DataFrame, sets: DataFrame, ld_rows: DataFrame, assoc: DataFrame | None = None) -> DataFrame:
    """One row per variable and set: inclusion probability, membership, and r² with the set's variable of greatest alpha."""
    k = keys(fit)
    top = analysis.representatives(fit, sets).select(*k, "component_id", F.col("idx").alias("top"))
    rows = top.join(ld_rows.select("region_id", F.col("i").alias("top"), "r"), ["region_id", "top"]).select(*k, "component_id", "top", F.posexplode("r").alias("idx", "r"))
    rows = rows.join(sets.select(*k, "component_id", "members"), [*k, "component_id"]).withColumn("member", F.array_contains("members", F.col("idx"))).withColumn("r2", F.col("r") * F.col("r")).drop("members", "r")
    out = rows.join(posterior.pip(fit), [*k, "idx"])
    if assoc is None:
        return out
    return out.join(assoc.select("region_id", "idx", "z").withColumn("neg_log10_p", analysis.neg_log10_p("z")), ["region_id", "idx"], "left")


def signal(fit: DataFrame, component_id: int, limit_mass: float = 0.999) -> DataFrame:
    """A component's variables by falling alpha, with the mass up to each, until ``limit_mass`` is reached."""
    return posterior.ranked(fit.where(F.col("component_id") == component_id)).where((F.col("rank") == 1) | (F.col("before") < limit_mass)).select(*keys(fit), "component_id", "idx", "rank", "alpha", "cumulative")


def convergence(traces: DataFrame) -> DataFrame:
    """Objective, its gap to the last one, and largest moves, by sweep."""
    last = F.max_by("elbo", "sweep").over(Window.partitionBy("region_id", "setting"))
    return traces.withColumn("gap", last - F.col("elbo")).select("region_id", "setting", "sweep", "elbo", "gap", "delta_alpha", "delta_pip", "sigma2")


def sensitivity(fits: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Variables that any setting gives ``threshold`` or more, with the inclusion probability in each setting (null where it lacks the variable)."""
    own = posterior.pip(fits)
    chosen = own.groupBy("region_id", "idx").agg(F.max("pip").alias("best")).where(F.col("best") >= threshold)
    return own.join(chosen.select("region_id", "idx"), ["region_id", "idx"]).groupBy("region_id", "idx").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("setting", "pip")))).alias("pip"))


def refinement(fits: DataFrame) -> DataFrame:
    """Rounds of the searches for a better objective: the objective before, those of the candidates, and whether one was taken."""
    schema = "struct<reason:string,fits:int,inner_converged:boolean,history:array<struct<before:double,candidates:array<double>,accepted:boolean>>>"
    rows = fits.where("refinement IS NOT NULL").select("region_id", "setting", F.from_json("refinement", schema).alias("s"))
    return rows.select("region_id", "setting", "s.reason", "s.fits", F.posexplode_outer("s.history").alias("round", "h")).select("region_id", "setting", "reason", "fits", "round", "h.*")


def ld_agreement(diagnostics: DataFrame) -> DataFrame:
    """Observed against expected z, with the status."""
    return diagnostics.where("expected IS NOT NULL").select("region_id", "idx", F.col("z").alias("observed"), "expected", "residual", "status")


def prior_influence(fit: DataFrame, priors: DataFrame | None = None, top: int = 10) -> DataFrame:
    """What prior and data say of each component's first ``top`` variables."""
    k = [*keys(fit), "component_id"]
    rank = F.row_number().over(Window.partitionBy(*k).orderBy(F.col("log_odds").desc_nulls_last(), "idx"))
    return analysis.prior_influence(fit, priors).withColumn("rank", rank).where(F.col("rank") <= top)
