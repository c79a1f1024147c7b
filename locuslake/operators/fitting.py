"""Fits of many regions at once: DataFrames in, one nested row per region and setting out.

Each region is solved in one task, which reads its matrix once for all settings, so memory
follows the largest region. Fits to summary statistics solve narrow regions many at once.
Regions that can't be fitted get a row that says why; they don't stop the others. Write the
fits once (``sources.store``) before several queries read them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ld import fit_rss_ridge
from ..functions.many import Fits, alike, fit_rss_many
from ..functions.solver import Fit, FitSpec, fit_auto, fit_individual, fit_rss, fit_suff_stat, fit_trend
from .moments import NARROW

_EFFECT = "component_id int, V double, lbf double, kl double, slot_weight double, rv double, alpha array<double>, mu array<double>, mu2 array<double>, lbf_variable array<double>"
_SWEEP = "sweep int, elbo double, delta_elbo double, delta_alpha double, delta_pip double, sigma2 double, cycle_lag int, V array<double>, top array<int>, top_alpha array<double>, entropy array<double>, events array<string>"
FITS = (
    "region_id string, setting string, status string, error string, n_variants int, sigma2 double, niter int, converged boolean, stop_reason string, criterion string, elbo array<double>, "
    f"null_index int, intercept double, scales array<double>, prior array<double>, warnings array<string>, refinement string, components array<struct<{_EFFECT.replace(' ', ':').replace(',:', ', ')}>>, trace array<struct<{_SWEEP.replace(' ', ':').replace(',:', ', ')}>>"
)
Settings = dict[str, FitSpec]


def _effect_type() -> pa.DataType:
    doubles = pa.list_(pa.float64())
    return pa.struct([("component_id", pa.int32()), ("V", pa.float64()), ("lbf", pa.float64()), ("kl", pa.float64()), ("slot_weight", pa.float64()), ("rv", pa.float64()), ("alpha", doubles), ("mu", doubles), ("mu2", doubles), ("lbf_variable", doubles)])


def _sweep_type() -> pa.DataType:
    doubles = pa.list_(pa.float64())
    return pa.struct([("sweep", pa.int32()), ("elbo", pa.float64()), ("delta_elbo", pa.float64()), ("delta_alpha", pa.float64()), ("delta_pip", pa.float64()), ("sigma2", pa.float64()), ("cycle_lag", pa.int32()), ("V", doubles), ("top", pa.list_(pa.int32())), ("top_alpha", doubles), ("entropy", doubles), ("events", pa.list_(pa.string()))])


_ARROW = pa.schema([
    ("region_id", pa.string()), ("setting", pa.string()), ("status", pa.string()), ("error", pa.string()), ("n_variants", pa.int32()), ("sigma2", pa.float64()), ("niter", pa.int32()), ("converged", pa.bool_()), ("stop_reason", pa.string()), ("criterion", pa.string()), ("elbo", pa.list_(pa.float64())),
    ("null_index", pa.int32()), ("intercept", pa.float64()), ("scales", pa.list_(pa.float64())), ("prior", pa.list_(pa.float64())), ("warnings", pa.list_(pa.string())), ("refinement", pa.string()), ("components", pa.list_(_effect_type())), ("trace", pa.list_(_sweep_type())),
])


def _row(region: str, setting: str, fit: Fit) -> dict:
    import json

    L, q = fit.alpha.shape
    effects = [
        {
            "component_id": k, "V": float(fit.V[k]), "lbf": float(fit.lbf[k]), "kl": float(fit.kl[k]), "slot_weight": None if fit.slot_weights is None else float(fit.slot_weights[k]), "rv": None if fit.rv is None else float(fit.rv[k]),
            "alpha": fit.alpha[k], "mu": fit.mu[k], "mu2": fit.mu2[k], "lbf_variable": fit.lbf_variable[k],
        }
        for k in range(L)
    ]
    return {
        "region_id": region, "setting": setting, "status": "fitted", "error": None, "n_variants": q - (fit.null_index is not None), "sigma2": fit.sigma2, "niter": fit.niter, "converged": fit.converged, "stop_reason": fit.stop_reason, "criterion": fit.criterion, "elbo": fit.elbo,
        "null_index": fit.null_index, "intercept": fit.intercept, "scales": fit.scales, "prior": fit.prior, "warnings": fit.warnings, "refinement": None if fit.refinement is None else json.dumps(fit.refinement), "components": effects, "trace": [{k: t.get(k) for k in _sweep_type().names} for t in fit.trace],
    }


def _solved(region: str, settings: Settings, solve: Callable[[FitSpec], Fit], missing: str | None = None) -> pa.Table:
    """A row for each setting; errors of the data become a status."""
    rows = []
    for name, spec in settings.items():
        failed = {"region_id": region, "setting": name, "status": missing or "failed", "error": missing}
        if missing:
            rows.append(failed)
            continue
        try:
            rows.append(_row(region, name, solve(spec)))
        except (ValueError, FloatingPointError, np.linalg.LinAlgError) as e:
            rows.append(failed | {"error": str(e)})
    return pa.Table.from_pylist([{k: r.get(k) for k in _ARROW.names} for r in rows], _ARROW)


def _rows_of_many(regions: pa.Array, setting: str, fits: Fits) -> pa.Table:
    """``_row`` of the regions that have a result."""
    own = np.flatnonzero(~fits.odd)
    size, (L, p) = len(own), fits.alpha.shape[1:]
    t = {k: v[~fits.odd[fits.trace["region"]]] for k, v in fits.trace.items()} if fits.trace else {}
    if not size:
        return _ARROW.empty_table()

    def lists(x: np.ndarray | pa.Array, ends: np.ndarray | None = None) -> pa.ListArray:
        """Arrays of the last axis, or of what lies between ``ends``."""
        if ends is None:
            ends = np.arange(x.size // x.shape[-1] + 1) * x.shape[-1]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x if isinstance(x, pa.Array) else pa.array(np.ascontiguousarray(x).ravel()))

    def structs(of: pa.DataType, columns: dict[str, pa.Array]) -> pa.StructArray:
        rows = len(next(iter(columns.values())))
        return pa.StructArray.from_arrays([columns.get(k.name, pa.nulls(rows, k.type)).cast(k.type) for k in of], fields=list(of))

    ends, first = np.concatenate([[0], np.cumsum(fits.niter[own])]), t["sweep"] == 1
    each = {k: lists(getattr(fits, k)[own]) for k in ("alpha", "mu", "mu2", "lbf_variable")} | {k: pa.array(getattr(fits, k)[own].ravel()) for k in ("V", "lbf", "kl")}
    effects = structs(_effect_type(), {"component_id": pa.array(np.tile(np.arange(L, dtype=np.int32), size)), **each})
    events = [(["elbo_decreased"] if f else []) + (["fixed_point" if k == 1 else "cycle_detected"] if k else []) for f, k in zip(t["fell"].tolist(), t["cycle_lag"].tolist())]
    sweeps = {k: pa.array(t[k]) for k in ("sweep", "elbo", "sigma2")} | {k: pa.array(t[k], mask=first) for k in ("delta_elbo", "delta_alpha", "delta_pip")} | {k: lists(t[k]) for k in ("V", "top", "top_alpha", "entropy")}
    trace = structs(_sweep_type(), {**sweeps, "cycle_lag": pa.array(t["cycle_lag"], mask=t["cycle_lag"] == 0), "events": pa.array(events, pa.list_(pa.string()))})
    warnings: list[list[str]] = [[] for _ in range(size)]
    for k in np.flatnonzero(t["fell"]).tolist():
        warnings[int(np.searchsorted(own, t["region"][k]))].append(f"the objective fell by {-t['delta_elbo'][k]:.3g} in sweep {t['sweep'][k]}")
    converged = pa.array(fits.converged[own])
    columns = {
        "region_id": regions.take(pa.array(own)), "setting": pa.array([setting] * size), "status": pa.array(["fitted"] * size), "n_variants": pa.array(np.full(size, p, np.int32)), "sigma2": pa.array(fits.sigma2[own]), "niter": pa.array(fits.niter[own]), "converged": converged,
        "stop_reason": pc.if_else(converged, "criterion_satisfied", "iteration_limit"), "criterion": pa.array(["elbo"] * size), "elbo": lists(sweeps["elbo"], ends), "scales": lists(fits.scales[own]), "prior": lists(fits.prior[own]), "warnings": pa.array(warnings, pa.list_(pa.string())),
        "components": lists(effects, np.arange(size + 1) * L), "trace": lists(trace, ends),
    }
    return pa.table([columns.get(k.name, pa.nulls(size, k.type)).cast(k.type) for k in _ARROW], schema=_ARROW)


def _whole_regions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole regions from batches sorted by region: of one that batches divide, and of all between two such ones."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        region = batch.column("region_id").dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        first, last = 0, int(np.argmax(region == region[-1]))
        if held and held[0].column("region_id")[0].as_py() == batch.column("region_id")[0].as_py():
            first = int(np.argmax(region != region[0])) if last else batch.num_rows
            held.append(batch.slice(0, first))
        if first < batch.num_rows:
            if held:
                yield pa.Table.from_batches(held)
            if first < last:
                yield pa.Table.from_batches([batch.slice(first, last - first)])
            held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def _named(settings: FitSpec | Settings) -> Settings:
    return {"baseline": settings} if isinstance(settings, FitSpec) else dict(settings)


def _matrix(table: pa.Table, order: str, row: str) -> np.ndarray:
    """The rows of a matrix, sorted; rows of different lengths raise."""
    table = table.sort_by(order)
    flat = table.column(row).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    if table.num_rows == 0 or len(flat) % table.num_rows:
        raise ValueError("matrix rows differ in length")
    return flat.reshape(table.num_rows, -1)


def _optional(table: pa.Table, name: str) -> np.ndarray | None:
    return None if name not in table.column_names or table.column(name).null_count == table.num_rows else table.column(name).to_numpy(zero_copy_only=False).astype(float)


def _columns(df: DataFrame, required: Iterable[str], optional: Iterable[str]) -> DataFrame:
    names = [*required, *[c for c in optional if c in df.columns]]
    return df.select(F.col("region_id").cast("string").alias("region_id"), *[F.col(c).cast("int" if c in ("idx", "i") else "double").alias(c) for c in names])


def fit_regions(assoc: DataFrame, ld_rows: DataFrame, settings: FitSpec | Settings, *, maf_threshold: float = 0.0, ridge: float | str | None = None) -> DataFrame:
    """Summary-statistic fits (schema ``FITS``).

    ``assoc``: region_id, idx, z or bhat and shat, and n, var_y, maf, prior_weight where known;
    ``ld_rows``: region_id, i, r (a row of the matrix). Missing z count as 0. ``ridge`` fits the
    likelihood with a ridge of that size, or of one estimated for each region ("estimate").
    Both sides are shuffled by region once. A region on one side alone gets a row that says so.
    Regions of up to 16 variables that have z and n are solved many at once by options that allow it
    (``functions.many``), all others one by one.
    """
    settings = _named(settings)
    left = _columns(assoc, ["idx"], ["z", "bhat", "shat", "n", "var_y", "maf", "prior_weight"]).withColumnRenamed("idx", "i")
    names = left.columns[2:]
    plain = {"z", "n"} <= set(names) <= {"z", "n", "maf"} and not maf_threshold and ridge is None
    together = {k: s for k, s in settings.items() if plain and alike(s)}

    def solve(a: pa.Table, r: pa.Table, settings: Settings) -> pa.Table:
        region = (a if a.num_rows else r).column("region_id")[0].as_py()
        missing = "no associations" if not a.num_rows else "no correlations" if not r.num_rows else None
        if missing:
            return _solved(region, settings, lambda s: None, missing)
        a = a.sort_by("i")
        one = lambda k: None if (v := _optional(a, k)) is None else float(v[0])
        n, var_y, z, bhat = one("n"), one("var_y"), _optional(a, "z"), _optional(a, "bhat")

        def run(spec: FitSpec) -> Fit:
            R = _matrix(r, "i", "r")
            if ridge is not None:
                return fit_rss_ridge(z if bhat is None else bhat / _optional(a, "shat"), R, n, spec, None if ridge == "estimate" else float(ridge), _optional(a, "prior_weight"))
            by_z = {"z": z if z is not None else np.zeros(a.num_rows)} if bhat is None else {"bhat": bhat, "shat": _optional(a, "shat")}
            return fit_rss(**by_z, R=R, n=n, spec=spec, prior=_optional(a, "prior_weight"), var_y=var_y, maf=_optional(a, "maf") if maf_threshold else None, maf_threshold=maf_threshold)

        return _solved(region, settings, run)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_regions(batches):
            coded = table.column("region_id").combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(coded)) + 1])
            is_row = table.column("is_row").to_numpy()
            sizes = np.add.reduceat(is_row, starts, dtype=np.int64)
            others = np.diff(np.append(starts, len(coded))) - sizes
            left_over = [dict(settings) for _ in starts]
            length = pc.fill_null(pc.list_value_length(table.column("r")), 0).to_numpy()
            narrow = (sizes == others) & (sizes * sizes <= NARROW) & ~np.logical_or.reduceat(is_row & (length != np.repeat(sizes, sizes + others)), starts)
            for p in np.unique(sizes[narrow]) if together else ():
                own = np.flatnonzero(narrow & (sizes == p))
                at = starts[own][:, None] + np.arange(p)
                z, n = table.column("z").to_numpy()[at], table.column("n").to_numpy()[at[:, 0]]
                R = table.column("r").combine_chunks().take(pa.array((at + p).ravel())).flatten().to_numpy(zero_copy_only=False).reshape(-1, p, p)
                for name, spec in together.items():
                    fits = fit_rss_many(z, R, n, spec)
                    yield from _rows_of_many(table.column("region_id").take(pa.array(starts[own])).combine_chunks(), name, fits).to_batches()
                    for k in own[~fits.odd]:
                        del left_over[k][name]
            for start, size, other, rest in zip(starts.tolist(), sizes.tolist(), others.tolist(), left_over):
                if rest:
                    yield from solve(table.slice(start, other), table.slice(start + other, size), rest).to_batches()

    right = ld_rows.select(F.col("region_id").cast("string").alias("region_id"), F.col("i").cast("int").alias("i"), F.col("r").cast("array<double>").alias("r"))
    both = left.withColumn("is_row", F.lit(False)).unionByName(right.withColumn("is_row", F.lit(True)), allowMissingColumns=True)
    return both.repartition("region_id").sortWithinPartitions("region_id", "is_row", "i").mapInArrow(each, FITS)


def fit_regions_suff_stat(gram_rows: DataFrame, settings: FitSpec | Settings) -> DataFrame:
    """Fits to cross products. ``gram_rows``: region_id, i, xtx (a row), xty, yty, n, and prior_weight where known; missing xty count as 0."""
    settings = _named(settings)
    rows = gram_rows.select(F.col("region_id").cast("string").alias("region_id"), F.col("i").cast("int").alias("i"), F.col("xtx").cast("array<double>").alias("xtx"), *[F.col(c).cast("double").alias(c) for c in ("xty", "yty", "n", "prior_weight") if c in gram_rows.columns])

    def solve(a: pa.Table) -> pa.Table:
        a = a.sort_by("i")
        run = lambda s: fit_suff_stat(_matrix(a, "i", "xtx"), a.column("xty").to_numpy(zero_copy_only=False).astype(float), float(a.column("yty")[0].as_py()), float(a.column("n")[0].as_py()), s, prior=_optional(a, "prior_weight"))
        return _solved(a.column("region_id")[0].as_py(), settings, run)

    return rows.groupBy("region_id").applyInArrow(solve, FITS)


def fit_regions_individual(samples: DataFrame, settings: FitSpec | Settings, *, intercept: bool = True, drop_missing: bool = False, auto: bool = False) -> DataFrame:
    """Fits to designs. ``samples``: region_id, sample_id, x (array of the predictors), y; ``auto`` searches the number of effects."""
    settings = _named(settings)
    rows = samples.select(F.col("region_id").cast("string").alias("region_id"), "sample_id", F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y"))

    def solve(a: pa.Table) -> pa.Table:
        a = a.sort_by("sample_id")
        y = a.column("y").to_numpy(zero_copy_only=False).astype(float)
        if auto:
            return _solved(a.column("region_id")[0].as_py(), settings, lambda s: fit_auto(_matrix(a, "sample_id", "x"), y, s, intercept=intercept, drop_missing=drop_missing))
        return _solved(a.column("region_id")[0].as_py(), settings, lambda s: fit_individual(_matrix(a, "sample_id", "x"), y, s, intercept=intercept, drop_missing=drop_missing))

    return rows.groupBy("region_id").applyInArrow(solve, FITS)


def fit_trends(series: DataFrame, settings: FitSpec | Settings, *, order: int = 0) -> DataFrame:
    """Change points of ordered series. ``series``: region_id, at (what orders a series), y; a component's variables are places in that order."""
    settings = _named(settings)
    rows = series.select(F.col("region_id").cast("string").alias("region_id"), "at", F.col("y").cast("double").alias("y"))

    def solve(a: pa.Table) -> pa.Table:
        y = a.sort_by("at").column("y").to_numpy(zero_copy_only=False).astype(float)
        return _solved(a.column("region_id")[0].as_py(), settings, lambda s: fit_trend(y, s, order=order))

    return rows.groupBy("region_id").applyInArrow(solve, FITS)


def effects(fits: DataFrame, setting: str | None = "baseline") -> DataFrame:
    """One row per region, component and variable of the fitted regions; the null column has idx ``null_index``. ``setting`` None keeps all, with their names."""
    kept = fits.where("status = 'fitted'")
    kept = kept if setting is None else kept.where(F.col("setting") == setting)
    each = kept.select("region_id", "setting", "sigma2", "niter", "converged", F.element_at("elbo", -1).alias("elbo"), "null_index", F.explode("components").alias("c"))
    rows = each.select("region_id", "setting", "sigma2", "niter", "converged", "elbo", "null_index", *[F.col("c")[k].alias(k) for k in ("component_id", "V", "lbf", "kl", "slot_weight")], F.posexplode(F.arrays_zip("c.alpha", "c.mu", "c.mu2", "c.lbf_variable")).alias("idx", "cell"))
    out = rows.select("region_id", "setting", "component_id", "idx", *[F.col("cell")[k].alias(k) for k in ("alpha", "mu", "mu2", "lbf_variable")], "V", "lbf", "kl", "slot_weight", "sigma2", "niter", "converged", "elbo", "null_index")
    return out if setting is None else out.drop("setting")


def traces(fits: DataFrame) -> DataFrame:
    """One row per region, setting and sweep."""
    return fits.where("status = 'fitted'").select("region_id", "setting", F.explode("trace").alias("t")).select("region_id", "setting", "t.*")


def sensitivity(assoc: DataFrame, ld_rows: DataFrame, base: FitSpec, changes: dict[str, dict]) -> DataFrame:
    """A fit for each setting and region, in one grouped call that reads each region once."""
    from dataclasses import replace

    return fit_regions(assoc, ld_rows, {name: replace(base, **c) for name, c in {"baseline": {}, **changes}.items()})


def alternative_inputs(inputs: dict[str, DataFrame], ld_rows: DataFrame, spec: FitSpec) -> DataFrame:
    """A fit for each table of associations, which names its setting; a table without z of its own for a region has no row for it."""
    out = None
    for name, assoc in inputs.items():
        regions = assoc.select(F.col("region_id").cast("string").alias("region_id")).distinct()
        own = ld_rows.withColumn("region_id", F.col("region_id").cast("string")).join(regions, "region_id", "left_semi")
        fits = fit_regions(assoc, own, {name: spec})
        out = fits if out is None else out.unionByName(fits)
    if out is None:
        raise ValueError("no inputs")
    return out


def standard_plan(L: int = 10, refine: bool = True) -> dict[str, dict]:
    """Settings that a fit is usually compared with: half and twice the effects, other coverages and purity, refinement."""
    plan = {"half_L": {"L": max(1, L // 2)}, "double_L": {"L": 2 * L}, "coverage_0.90": {"coverage": 0.90}, "coverage_0.99": {"coverage": 0.99}, "purity_0.8": {"min_abs_corr": 0.8}}
    return plan | ({"refine": {"refine": True}} if refine else {})
