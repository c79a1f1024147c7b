"""Queries that fit regions: the iterative solver in grouped tasks, its posterior in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.solver import FitSpec, SlotPrior
from ..operators import analysis, comparison, convergence, diagnostics, fitting, moments, posterior
from ..sources.scratch import written
from .simulated import region_moments, samples

REGIONS = 2


def summaries(spark: SparkSession, sf_dir: str, outcome: int = 0) -> tuple[DataFrame, DataFrame]:
    """Marginal z scores and correlation rows of the regions, both from one table of moments."""
    table = region_moments(spark, sf_dir, REGIONS)
    return moments.marginal_regressions(table).where(F.col("outcome") == outcome).select("region_id", "idx", "n", "z"), table.select("region_id", "i", "r")


def _fits(spark: SparkSession, sf_dir: str, settings, outcome: int = 0, **options) -> tuple[DataFrame, DataFrame]:
    assoc, ld = summaries(spark, sf_dir, outcome)
    return written(fitting.fit_regions(assoc, ld, settings, **options)), ld


def flagship_finemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits, ld = _fits(spark, sf_dir, FitSpec(L=5))
    fit = fitting.effects(fits)
    sets = posterior.credible_sets(fit, ld).select("region_id", "component_id", F.explode("members").alias("idx"))
    return posterior.pip(fit).join(sets, ["region_id", "idx"], "left").select("region_id", "idx", F.round("pip", 6).alias("pip"), "component_id")


def susie_rss_optim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitting.effects(_fits(spark, sf_dir, FitSpec(L=5))[0])


def susie_rss_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posterior.pip(fitting.effects(_fits(spark, sf_dir, FitSpec(L=3, mixture=((0.01, 0.4), (0.1, 0.3), (0.5, 0.3))))[0]))


def susie_rss_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posterior.pip(fitting.effects(_fits(spark, sf_dir, FitSpec(L=5, prior_variance=50.0), ridge=0.05)[0]))


def susie_inverse_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posterior.pip(fitting.effects(_fits(spark, sf_dir, FitSpec(L=4, residual_model="nig"))[0]))


def susie_slot_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posterior.pip(fitting.effects(_fits(spark, sf_dir, FitSpec(L=5, slot=SlotPrior()))[0]))


def susie_suff_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = moments.sufficient_statistics(region_moments(spark, sf_dir, REGIONS))
    return posterior.posterior_moments(fitting.effects(fitting.fit_regions_suff_stat(stats, FitSpec(L=5, estimate_residual_variance=True))))


def susie_individual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir, REGIONS).select("region_id", F.col("vec_id").alias("sample_id"), "x", F.get("y", F.lit(0)).alias("y"))
    return posterior.pip(fitting.effects(fitting.fit_regions_individual(rows, FitSpec(L=5, estimate_residual_variance=True))))


def susie_automatic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir, REGIONS).select("region_id", F.col("vec_id").alias("sample_id"), "x", F.get("y", F.lit(0)).alias("y"))
    return posterior.pip(fitting.effects(fitting.fit_regions_individual(rows, FitSpec(tol=1e-2), auto=True)))


def trend_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change points of the values of the events' types, each in the order of its first thousand ids' time."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "user_id", "ts", "event_id", F.col("value").cast("double").alias("y")).where("y IS NOT NULL AND user_id % 16 = 0")
    series = events.select(F.concat_ws(":", "event_type", "user_id").alias("region_id"), F.struct("ts", "event_id").alias("order"), "y")
    from pyspark.sql import Window

    numbered = series.withColumn("at", F.row_number().over(Window.partitionBy("region_id").orderBy("order"))).withColumn("n", F.count("*").over(Window.partitionBy("region_id"))).where("n > 2")
    return posterior.pip(fitting.effects(fitting.fit_trends(numbered.select("region_id", "at", "y"), FitSpec(L=3, estimate_residual_variance=True))))


def credible_sets_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits, ld = _fits(spark, sf_dir, FitSpec(L=5))
    return posterior.credible_sets(fitting.effects(fits), ld)


def credible_set_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits, ld = _fits(spark, sf_dir, FitSpec(L=5))
    return posterior.credible_set_audit(fitting.effects(fits), ld, extension_corr=0.99)


def local_false_sign_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posterior.local_false_sign_rate(fitting.effects(_fits(spark, sf_dir, FitSpec(L=5))[0]))


def refined_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fits(spark, sf_dir, FitSpec(L=5, refine=True))[0].select("region_id", "converged", "stop_reason", "refinement")


def sensitivity_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    assoc, ld = summaries(spark, sf_dir)
    fits = written(fitting.sensitivity(assoc, ld, FitSpec(L=4), {"half_L": {"L": 2}, "double_L": {"L": 8}, "em": {"estimate_prior": "EM"}}))
    rows = fitting.effects(fits, None)
    return rows.groupBy("setting", "region_id").agg(F.max("elbo").alias("elbo"), F.max("niter").alias("niter"), F.count_if(F.col("alpha") > 0.5).alias("leading"))


def sensitivity_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    assoc, ld = summaries(spark, sf_dir)
    fits = written(fitting.effects(fitting.sensitivity(assoc, ld, FitSpec(L=4), fitting.standard_plan(4)), None))
    sets = posterior.credible_sets(fits, ld)
    return comparison.set_stability(sets, comparison.signal_edges(fits, sets, ld, baseline="baseline"), "baseline")


def model_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits, ld = _fits(spark, sf_dir, FitSpec(L=5))
    fit = fitting.effects(fits)
    return analysis.model_summary(fit, posterior.credible_sets(fit, ld))[0]


def convergence_assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    assoc, ld = summaries(spark, sf_dir)
    return convergence.assess(written(fitting.fit_regions(assoc, ld, {"baseline": FitSpec(L=5), "short": FitSpec(L=5, max_iter=2), "joint": FitSpec(L=5, criterion="joint")})))


def ld_diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z scores of which every seventh has the wrong sign."""
    assoc, ld = summaries(spark, sf_dir)
    return diagnostics.ld_diagnostics(assoc.withColumn("z", F.when(F.col("idx") % 7 == 0, -F.col("z")).otherwise(F.col("z"))), ld)


def posterior_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.posterior_samples(_fits(spark, sf_dir, FitSpec(L=5))[0], 100)


def coloc_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simulated response beside the first label."""
    a, b = (fitting.effects(_fits(spark, sf_dir, FitSpec(L=2), k)[0]) for k in (0, 1))
    return posterior.coloc(a, b)


def many_region_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit for each supplier, of its line items' prices on quantity, discount and tax: many small regions in one pass."""
    from .relational import _supplier_moments

    table = written(_supplier_moments(spark, sf_dir))
    fits = fitting.fit_regions(moments.marginal_regressions(table).select("region_id", "idx", "n", "z"), table.select("region_id", "i", "r"), FitSpec(L=2))
    return fits.select("region_id", "status", "niter", "converged", F.size("components").alias("effects"))


QUERIES = {
    f.__name__: f
    for f in (
        flagship_finemap, susie_rss_optim, susie_rss_mixture, susie_rss_ridge, susie_inverse_gamma, susie_slot_prior, susie_suff_stat, susie_individual, susie_automatic, trend_filter, credible_sets_fitted, credible_set_audit, local_false_sign_rates, refined_fits, sensitivity_runs, sensitivity_comparison,
        model_summaries, convergence_assessed, ld_diagnosed, posterior_draws, coloc_fitted, many_region_fits,
    )
}
