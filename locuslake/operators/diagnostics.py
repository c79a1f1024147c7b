"""Agreement of z scores with correlations, by region; each region is one grouped task with its matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ld
from .fitting import _columns, _matrix, _optional

VARIANTS = "region_id string, idx int, z double, expected double, variance double, residual double, log_lr double, status string, s double"


def ld_diagnostics(assoc: DataFrame, ld_rows: DataFrame, *, method: str = "null-mle", s: float | None = None, r_tol: float = 1e-8, flip_log_lr: float = 2.0, flip_abs_z: float = 2.0) -> DataFrame:
    """Each z score beside what the others say of it (schema ``VARIANTS``): flagged where a flipped allele explains it better.

    ``s`` is the region's inconsistency, estimated by ``method`` unless given. Missing scores
    aren't assessed. Regions that can't be assessed have one row, whose status says why.
    """

    def solve(a: pa.Table, r: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in VARIANTS.split(", ")]
        types = [pa.string(), pa.int32()] + [pa.float64()] * 5 + [pa.string(), pa.float64()]
        region = (a if a.num_rows else r).column("region_id")[0].as_py()
        try:
            if not a.num_rows or not r.num_rows:
                raise ValueError("no associations" if not a.num_rows else "no correlations")
            a = a.sort_by("idx")
            n = _optional(a, "n")
            out = ld.kriging(a.column("z").to_numpy(zero_copy_only=False).astype(float), _matrix(r, "i", "r"), None if n is None else float(n[0]), s=s, method=method, r_tol=r_tol, flip_log_lr=flip_log_lr, flip_abs_z=flip_abs_z)
        except (ValueError, np.linalg.LinAlgError) as e:
            return pa.table([pa.array([x], t) for x, t in zip((region, None, *[None] * 5, f"failed: {e}", None), types)], names=names)
        blank = lambda v: pa.array(v, pa.float64(), mask=np.isnan(v))
        p = a.num_rows
        return pa.table([pa.array([region] * p), a.column("idx").combine_chunks(), *[blank(np.asarray(out[k], float)) for k in ("z", "expected", "variance", "residual", "log_lr")], pa.array(out["status"].tolist(), pa.string()), pa.array(np.full(p, out["s"]))], names=names)

    left = _columns(assoc, ["idx", "z"], ["n"])
    right = ld_rows.select(F.col("region_id").cast("string").alias("region_id"), F.col("i").cast("int").alias("i"), F.col("r").cast("array<double>").alias("r"))
    return left.groupBy("region_id").cogroup(right.groupBy("region_id")).applyInArrow(solve, VARIANTS)


def status_counts(variants: DataFrame) -> DataFrame:
    """By region: variables in all, assessed, flagged, conditional only and not assessed."""
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    return variants.groupBy("region_id").agg(F.count("*").alias("total"), of("flagged", "not_flagged").alias("assessed"), of("flagged").alias("flagged"), of("not_flagged").alias("not_flagged"), of("conditional_only").alias("conditional_only"), of("not_assessed").alias("unassessed"))


SAMPLES = "region_id string, setting string, draw int, idx int, effect double"


def posterior_samples(fits: DataFrame, draws: int, seed: int = 1) -> DataFrame:
    """Draws from the posterior (non-zero effects, schema ``SAMPLES``): each active component picks a variable and a normal effect; they add up by variable. Rows depend on the seed and the region alone."""
    import zlib

    def run(batches):
        for batch in batches:
            for fit in batch.to_pylist():
                rng = np.random.default_rng([seed, zlib.crc32(f"{fit['region_id']}|{fit['setting']}".encode())])
                found: dict[tuple[int, int], float] = {}
                for c in fit["components"]:
                    if c["V"] <= 1e-9:
                        continue
                    alpha, mu, mu2 = (np.array(c[k]) for k in ("alpha", "mu", "mu2"))
                    at = rng.choice(len(alpha), draws, p=alpha / alpha.sum())
                    value = mu[at] + np.sqrt(np.maximum(mu2[at] - mu[at] ** 2, 0)) * rng.standard_normal(draws)
                    for k, (j, v) in enumerate(zip(at.tolist(), value.tolist())):
                        found[k, j] = found.get((k, j), 0.0) + v
                rows = [(fit["region_id"], fit["setting"], k, j, v) for (k, j), v in found.items()]
                types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)], names=[x.split()[0] for x in SAMPLES.split(", ")])

    return fits.where("status = 'fitted'").select("region_id", "setting", "components").mapInArrow(run, SAMPLES)
