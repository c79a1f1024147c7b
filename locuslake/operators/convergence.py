"""What the sweeps of fits say about their convergence. ``traces``: region_id, setting, sweep, elbo, delta_elbo, delta_pip, V, top, entropy, events, cycle_lag."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["region_id", "setting"]


def trace_steps(traces: DataFrame) -> DataFrame:
    """The sweeps with the objective's step, whether its sign changed, and the ratio to the step before."""
    w = Window.partitionBy(*KEYS).orderBy("sweep")
    rows = traces.withColumn("step", F.col("elbo") - F.lag("elbo").over(w))
    before = F.lag("step").over(w)
    return rows.withColumn("sign_change", F.coalesce(F.signum("step") * F.signum(before) < 0, F.lit(False))).withColumn("ratio", F.when(before != 0, F.col("step") / before))


def component_stability(traces: DataFrame, tail: int = 5, pip_stability: float = 1e-3) -> DataFrame:
    """By component, over the last ``tail`` sweeps: whether its leading variable changed and by how much its entropy moved."""
    last = Window.partitionBy(*KEYS)
    rows = traces.withColumn("final", F.max("sweep").over(last)).where(F.col("sweep") > F.col("final") - tail)
    each = rows.select(*KEYS, "sweep", "delta_pip", F.posexplode(F.arrays_zip("top", "entropy")).alias("component_id", "c"))
    w = Window.partitionBy(*KEYS, "component_id").orderBy("sweep")
    each = each.withColumn("moved", F.coalesce(F.col("c.top") != F.lag("c.top").over(w), F.lit(False))).withColumn("drift", F.abs(F.col("c.entropy") - F.lag("c.entropy").over(w)))
    out = each.groupBy(*KEYS, "component_id").agg(F.count_if("moved").alias("top_changes"), F.coalesce(F.max("drift"), F.lit(0.0)).alias("max_entropy_change"), F.max("delta_pip").alias("max_delta_pip"))
    return out.withColumn("stable", (F.col("top_changes") == 0) & (F.col("max_entropy_change") <= 1e-6) & (F.coalesce("max_delta_pip", F.lit(0.0)) < pip_stability))


def assess(fits: DataFrame, tail: int = 5, tol: float = 1e-4, pip_stability: float = 1e-3) -> DataFrame:
    """One row per fit: converged, not_assessable, numerical_failure, elbo_decreasing, oscillating, slow_monotone or unclassified.

    For slow ones ``extra_sweeps`` says how many more a geometric fall of the last steps needs
    to come under ``tol``.
    """
    kept = fits.where("status = 'fitted'")
    steps = trace_steps(kept.select(*KEYS, F.explode("trace").alias("t")).select(*KEYS, "t.*"))
    rows = steps.withColumn("final", F.max("sweep").over(Window.partitionBy(*KEYS)))
    ended = rows.where(F.col("sweep") > F.col("final") - tail)
    shape = ended.groupBy(*KEYS).agg(
        F.max("final").alias("sweeps"), F.count("step").alias("steps"), F.min("step").alias("least_step"), F.max_by("step", "sweep").alias("last_step"), F.count_if("sign_change").alias("sign_changes"),
        F.median("ratio").alias("ratio"), F.max("cycle_lag").alias("cycle_lag"), F.max_by("delta_pip", "sweep").alias("last_delta_pip"), F.count_if(F.isnan("elbo") | F.col("elbo").isNull() | (F.abs("elbo") == float("inf"))).alias("undefined"),
    )
    out = kept.select(*KEYS, "converged", "stop_reason", "criterion").join(shape, KEYS, "left")
    falling = F.col("least_step") < -tol
    label = (
        F.when(F.col("converged"), "converged").when((F.col("stop_reason") == "numerical_failure") | (F.col("undefined") > 0), "numerical_failure").when(F.coalesce(F.col("steps"), F.lit(0)) < 2, "not_assessable")
        .when((F.coalesce(F.col("cycle_lag"), F.lit(0)) > 1) | (F.col("sign_changes") >= 2), "oscillating").when(falling, "elbo_decreasing").when((F.col("least_step") >= 0) & (F.col("ratio") < 1), "slow_monotone").otherwise("unclassified")
    )
    extra = F.when((F.col("ratio") > 0) & (F.col("ratio") < 1) & (F.col("last_step") > tol), F.ceil((F.log(F.lit(tol)) - F.log("last_step")) / F.log("ratio")))
    return out.withColumn("assessment", label).withColumn("extra_sweeps", F.when(F.col("assessment") == "slow_monotone", extra)).withColumn("pip_stable", F.coalesce("last_delta_pip", F.lit(0.0)) < pip_stability)


def objectives(fits: DataFrame, warning_tol: float = 1e-6) -> DataFrame:
    """(region_id, setting, sweep, elbo, fell): the objective after each sweep, and where it fell by more than ``warning_tol``."""
    w = Window.partitionBy(*KEYS).orderBy("sweep")
    rows = fits.where("status = 'fitted'").select(*KEYS, F.posexplode("elbo").alias("sweep", "elbo"))
    return rows.withColumn("fell", F.coalesce(F.col("elbo") - F.lag("elbo").over(w) < -warning_tol, F.lit(False))).withColumn("sweep", F.col("sweep") + 1)
