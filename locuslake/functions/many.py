"""``solver.fit_rss`` of many regions with equally many variables at once: each step of the fit is one of stacked arrays.

Formulas and their order are the solver's; only how sums and logarithms round may differ. Regions
of which anything is out of the ordinary are marked and left to the solver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .solver import EPS, ROOT_EPS, FitSpec
from .special import minimise_many


@dataclass
class Fits:
    """What ``solver.Fit`` holds, with the regions as first axis; rows of the trace have their region's place, in its order. ``odd`` marks regions without a result."""

    alpha: np.ndarray
    mu: np.ndarray
    mu2: np.ndarray
    lbf_variable: np.ndarray
    V: np.ndarray
    lbf: np.ndarray
    kl: np.ndarray
    sigma2: np.ndarray
    niter: np.ndarray
    converged: np.ndarray
    prior: np.ndarray
    scales: np.ndarray
    trace: dict[str, np.ndarray]
    odd: np.ndarray


def alike(spec: FitSpec) -> bool:
    """Whether the steps of a fit are the same for all regions."""
    return not (spec.mixture or spec.slot or spec.refine or spec.greedy_step or spec.check_psd or spec.null_weight) and spec.residual_model == "gaussian" and spec.criterion == "elbo"


def _logsumexp(x: np.ndarray) -> np.ndarray:
    top = x.max(1)
    return top + np.log(np.exp(x - top[:, None]).sum(1))


def _single_effects(r: np.ndarray, d: np.ndarray, sigma2: np.ndarray, V: np.ndarray, log_prior: float, spec: FitSpec):
    """``solver.single_effect`` of each region."""
    b, s2 = r / d, sigma2[:, None] / d
    live, floor = np.isfinite(b) & np.isfinite(s2), np.maximum(s2, EPS)
    half = 0.5 * b * b

    def factors(v: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        v, f = v[:, None], floor[at]
        return np.where(live[at], -0.5 * np.log1p(v / f) + half[at] * v / (f * (v + f)), 0.0)

    loglik = lambda v: _logsumexp(factors(v) + log_prior)
    if spec.estimate_prior == "optim":
        new = np.exp(minimise_many(lambda t, at: -_logsumexp(factors(np.exp(t), at) + log_prior), len(r), -30.0, 15.0))
        V = np.where(loglik(new) >= loglik(V), new, V)
    if spec.estimate_prior in ("optim", "simple"):
        V = np.where(loglik(np.zeros(len(r))) + spec.check_null_threshold >= loglik(V), 0.0, V)
    lbf = factors(V)
    v = V[:, None]
    var = v * s2 / (v + s2)
    mean = var / s2 * b
    used = np.isfinite(mean) & np.isfinite(var) & (v > 0)
    mu, var = np.where(used, mean, 0.0), np.where(used, var, 0.0)
    mu2 = var + mu * mu
    total = _logsumexp(lbf + log_prior)
    alpha = np.exp(lbf + log_prior - total[:, None])
    alpha /= alpha.sum(1, keepdims=True)
    return alpha, mu, mu2, lbf, total, (alpha * mu2).sum(1) if spec.estimate_prior == "EM" else V


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(a - b).reshape(len(a), -1).max(1)


def fit_rss_many(z: np.ndarray, R: np.ndarray, n: np.ndarray, spec: FitSpec) -> Fits:
    """Fits to z scores (regions x variables; NaN counts as 0), correlations and sample sizes, by options that are ``alike``."""
    with np.errstate(all="ignore"):
        return _fit(np.where(np.isnan(z), 0.0, z), (R + R.transpose(0, 2, 1)) / 2, n, spec)


def _fit(z: np.ndarray, R: np.ndarray, n: np.ndarray, spec: FitSpec) -> Fits:
    size, p = z.shape
    L, prior = min(spec.L, p), np.full(p, 1 / p)
    prior = prior / math.fsum(prior)
    log_prior = float(np.log(prior[0] + ROOT_EPS))
    diagonal = np.diagonal(R, axis1=1, axis2=2)
    odd = ~(np.isfinite(z).all(1) & np.isfinite(R).all((1, 2)) & (diagonal >= 0).all(1) & np.isfinite(n) & (n > 1))
    a = (n[:, None] - 1) / (z * z + n[:, None] - 2) if spec.z_method == "wald" else np.ones_like(z)
    s = np.sqrt(n - 1)[:, None]
    Xty = s * (np.sqrt(a) * z)
    ss = s * s * diagonal
    scales = np.sqrt(ss / (n - 1)[:, None]) if spec.standardize else np.ones_like(z)
    scales = np.where(scales == 0, 1.0, scales)
    scale, yty, var_y = s / scales, n - 1, 1.0
    d, g = ss / scales**2, Xty / scales
    odd |= ~np.isfinite(g).all(1)
    V0 = np.asarray(spec.scaled_prior_variance, float) * var_y
    state = {k: np.zeros((size, L, p)) for k in ("alpha", "mu", "mu2", "lbf_variable")} | {k: np.zeros((size, L)) for k in ("V", "lbf", "kl")} | {"sigma2": np.full(size, float(spec.residual_variance or var_y))}
    state["alpha"][:] = 1 / p
    state["V"][:] = np.broadcast_to(V0, (spec.L,) if V0.ndim else (L,))[:L]
    niter, converged, trace = np.zeros(size, np.int32), np.zeros(size, bool), []
    max_score = np.where(d > 0, np.abs(g) / np.sqrt(d), -np.inf).max(1)
    check_prior = spec.check_prior is None or spec.check_prior

    at = np.flatnonzero(~odd)  # the regions whose fit goes on; what follows holds their values alone
    own = {k: v[at] for k, v in state.items()}
    R, d, g, n, scale, yty, max_score = (x[at] for x in (R, d, g, n, scale, yty, max_score))
    m, Qm, f = np.zeros((len(at), L, p)), np.zeros((len(at), L, p)), np.zeros((len(at), p))
    past: list[tuple[np.ndarray, np.ndarray]] = []
    elbo = np.zeros(len(at))
    for sweep in range(1, (spec.max_iter or 50) + 1):
        if not len(at):
            break
        alpha, mu, mu2, V, sigma2 = (own[k] for k in ("alpha", "mu", "mu2", "V", "sigma2"))
        for k in range(L):
            f = f - Qm[:, k]
            r = g - f
            alpha[:, k], mu[:, k], mu2[:, k], own["lbf_variable"][:, k], own["lbf"][:, k], V[:, k] = _single_effects(r, d, sigma2, V[:, k], log_prior, spec)
            m[:, k] = alpha[:, k] * mu[:, k]
            own["kl"][:, k] = -own["lbf"][:, k] + ((m[:, k] * r).sum(1) - 0.5 * (d * alpha[:, k] * mu2[:, k]).sum(1)) / sigma2
            Qm[:, k] = scale * (R @ (scale * m[:, k])[:, :, None])[:, :, 0]
            f = f + Qm[:, k]
        bad = (V > 100 * (max_score**2 / sigma2)[:, None]).any(1) if check_prior else np.zeros(len(at), bool)
        b = m.sum(1)
        er2 = yty - 2 * (b * g).sum(1) + (b * f).sum(1) - (m * Qm).sum((1, 2)) + (alpha * mu2 * d[:, None]).sum((1, 2))
        objective = -n / 2 * np.log(2 * math.pi * sigma2) - er2 / (2 * sigma2) - own["kl"].sum(1)
        bad |= ~np.isfinite(objective)
        pip = 1 - np.where((V > spec.prior_tol)[:, :, None], 1 - alpha, 1.0).prod(1)
        row = {"region": at, "sweep": np.full(len(at), sweep, np.int32), "elbo": objective, "sigma2": sigma2.copy(), "V": V.copy(), "top": alpha.argmax(2).astype(np.int32), "top_alpha": alpha.max(2), "entropy": -(alpha * np.log(np.where(alpha > 0, alpha, 1.0))).sum(2)}
        unknown, lag = np.full(len(at), np.nan), np.zeros(len(at), np.int32)
        row |= {"delta_elbo": objective - elbo, "delta_alpha": _far(alpha, past[-1][0]), "delta_pip": _far(pip, past[-1][1])} if past else {"delta_elbo": unknown, "delta_alpha": unknown, "delta_pip": unknown}
        for k, (was, pip_was) in enumerate(reversed(past), 1):
            lag = np.where((lag == 0) & (_far(alpha, was) < spec.alpha_tol) & (_far(pip, pip_was) < spec.pip_tol), k, lag)
        row |= {"cycle_lag": lag, "fell": row["delta_elbo"] < -spec.tol}
        trace.append(row)
        done = (row["delta_elbo"] >= 0) & (row["delta_elbo"] < spec.tol) & (sweep >= spec.min_iter)
        niter[at], converged[at] = sweep, done
        past, elbo = [*past, (alpha.copy(), pip)][-spec.cycle_lag :], objective
        if spec.estimate_residual_variance:
            new = er2 / n
            bad |= ~done & ~(np.isfinite(new) & (new > 0))
            own["sigma2"] = np.where(done, sigma2, np.clip(new, *spec.residual_bounds))
        odd[at[bad]] = True
        ends = done | bad
        for k, v in own.items():
            state[k][at[ends]] = v[ends]
        on = ~ends
        if ends.any():
            at, own, past = at[on], {k: v[on] for k, v in own.items()}, [(x[on], y[on]) for x, y in past]
            R, d, g, n, scale, yty, max_score, m, Qm, f, elbo = (x[on] for x in (R, d, g, n, scale, yty, max_score, m, Qm, f, elbo))
    for k, v in own.items():
        state[k][at] = v
    off = state["V"] < spec.prior_tol
    for k in ("V", "lbf", "kl", "mu", "mu2", "lbf_variable"):
        state[k][off] = 0
    state["alpha"][off] = prior
    rows = {k: np.concatenate([t[k] for t in trace]) for k in trace[0]} if trace else {}
    if rows:
        order = np.argsort(rows["region"], kind="stable")
        rows = {k: v[order] for k, v in rows.items()}
    return Fits(**state, niter=niter, converged=converged, prior=np.tile(prior, (size, 1)), scales=scales, trace=rows, odd=odd)
