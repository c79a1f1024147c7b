"""Small regions to try things on, made from a seed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

SCHEMA_ASSOC, SCHEMA_LD = "region_id string, idx int, variant_id string, z double, n double", "region_id string, i int, r array<double>"


def example(spark: SparkSession, *, variants: int = 500, samples: int = 1000, decay: float = 0.85, effects: dict[int, float] | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Associations and correlations of one region: neighbours correlate as powers of ``decay``, and a few variables have effects on a standardised response."""
    effects = {99: 0.35, 349: -0.30} if effects is None else effects
    at = np.arange(variants)
    R = decay ** np.abs(at[:, None] - at[None, :])
    rng = np.random.default_rng(seed)
    noise = np.empty(variants)  # of the same correlations
    draws = rng.normal(size=variants)
    noise[0] = draws[0]
    for j in range(1, variants):
        noise[j] = decay * noise[j - 1] + np.sqrt(1 - decay * decay) * draws[j]
    z = np.sqrt(samples) * sum((b * R[:, j] for j, b in effects.items()), np.zeros(variants)) + noise
    assoc = [("example", j, f"syn{j + 1:04d}", float(z[j]), float(samples)) for j in range(variants)]
    return spark.createDataFrame(assoc, SCHEMA_ASSOC), spark.createDataFrame([("example", j, R[j].tolist()) for j in range(variants)], SCHEMA_LD)
