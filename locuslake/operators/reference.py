"""Fits of many regions with reference correlations of limited size, of another population, or of several panels; and fits that go on from earlier ones."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.panels import fit_rss_panels, fit_rss_reference
from ..functions.solver import FitSpec, fit_rss
from .fitting import FITS, _columns, _matrix, _optional, _solved

_LD = "region_id string, i int, r array<double>"


def _ld(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(F.col("region_id").cast("string").alias("region_id"), *more, F.col("i").cast("int").alias("i"), F.col("r").cast("array<double>").alias("r"))


def _z(a: pa.Table) -> np.ndarray:
    return a.column("z").to_numpy(zero_copy_only=False).astype(float)


def fit_regions_reference(assoc: DataFrame, ld_rows: DataFrame, spec: FitSpec, *, size: float, mismatch: bool = False) -> DataFrame:
    """As ``fit_regions`` with z and n, for correlations from ``size`` samples; ``refinement`` holds, as JSON, what is known of the reference's share."""

    def solve(a: pa.Table, r: pa.Table) -> pa.Table:
        region = (a if a.num_rows else r).column("region_id")[0].as_py()
        missing = "no associations" if not a.num_rows else "no correlations" if not r.num_rows else None
        if missing:
            return _solved(region, {"baseline": spec}, lambda s: None, missing)
        a = a.sort_by("idx")

        def run(s: FitSpec):
            out, quality = fit_rss_reference(_z(a), _matrix(r, "i", "r"), float(_optional(a, "n")[0]), s, size=size, mismatch=mismatch)
            out.refinement = quality
            return out

        return _solved(region, {"baseline": spec}, run)

    return _columns(assoc, ["idx", "z", "n"], []).groupBy("region_id").cogroup(_ld(ld_rows).groupBy("region_id")).applyInArrow(solve, FITS)


def fit_regions_panels(assoc: DataFrame, ld_rows: DataFrame, spec: FitSpec, sizes: dict[str, float] | None = None) -> DataFrame:
    """As ``fit_regions`` with z and n, for several panels: ``ld_rows`` has a column panel_id, ``sizes`` their numbers of samples. ``refinement`` holds the panels' weights as JSON."""

    def solve(a: pa.Table, r: pa.Table) -> pa.Table:
        region = (a if a.num_rows else r).column("region_id")[0].as_py()
        missing = "no associations" if not a.num_rows else "no correlations" if not r.num_rows else None
        if missing:
            return _solved(region, {"baseline": spec}, lambda s: None, missing)
        a = a.sort_by("idx")
        ids = np.array(r.column("panel_id").to_pylist(), dtype=object).astype(str)
        names = sorted(set(ids))

        def run(s: FitSpec):
            out, weights = fit_rss_panels(_z(a), [_matrix(r.filter(pa.array(ids == p)), "i", "r") for p in names], float(_optional(a, "n")[0]), s, sizes=None if sizes is None else [sizes[p] for p in names])
            out.refinement = {"panels": dict(zip(names, weights.tolist()))}
            return out

        return _solved(region, {"baseline": spec}, run)

    panels = _ld(ld_rows, "panel_id")
    return _columns(assoc, ["idx", "z", "n"], []).groupBy("region_id").cogroup(panels.groupBy("region_id")).applyInArrow(solve, FITS)


def continue_fits(fits: DataFrame, assoc: DataFrame, ld_rows: DataFrame, spec: FitSpec, setting: str = "baseline") -> DataFrame:
    """Fits with z and n that begin at the posterior of earlier ones, setting by name; regions without an earlier fit begin cold."""
    state = fits.where("status = 'fitted'").where(F.col("setting") == setting).select("region_id", F.to_json(F.transform("components", lambda c: F.struct(c["alpha"].alias("alpha"), c["mu"].alias("mu"), c["mu2"].alias("mu2"), c["V"].alias("V")))).alias("state"))
    left = _columns(assoc, ["idx", "z", "n"], []).join(state, "region_id", "left")

    def solve(a: pa.Table, r: pa.Table) -> pa.Table:
        region = (a if a.num_rows else r).column("region_id")[0].as_py()
        missing = "no associations" if not a.num_rows else "no correlations" if not r.num_rows else None
        if missing:
            return _solved(region, {"continued": spec}, lambda s: None, missing)
        a = a.sort_by("idx")
        text = a.column("state")[0].as_py()
        start = None
        if text:
            parts = json.loads(text)
            start = {k: np.array([c[k] for c in parts], float) for k in ("alpha", "mu", "mu2", "V")}
        return _solved(region, {"continued": spec}, lambda s: fit_rss(_z(a), _matrix(r, "i", "r"), float(_optional(a, "n")[0]), s, start=start))

    return left.groupBy("region_id").cogroup(_ld(ld_rows).groupBy("region_id")).applyInArrow(solve, FITS)
