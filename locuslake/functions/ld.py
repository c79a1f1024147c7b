"""Consistency of z scores with a correlation matrix, and fits with a ridge, for one region in NumPy."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np

from .solver import Fit, FitSpec, _symmetric, fit
from .special import minimise

METHODS = ("null-mle", "null-partialmle", "null-pseudomle")


def decompose(R: np.ndarray, r_tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, those under ``r_tol`` as 0, and eigenvectors."""
    R = np.asarray(R, float)
    d, U = np.linalg.eigh(_symmetric(R, len(R), "the correlations"))
    return np.where(d < r_tol, 0.0, d), U


def adjusted(z, n: float | None) -> np.ndarray:
    """z scores as correlations of n samples would give them; missing ones count as 0."""
    z = np.nan_to_num(np.asarray(z, float), nan=0.0, posinf=np.inf, neginf=-np.inf)
    if np.isinf(z).any():
        raise ValueError("infinite z")
    if n is None or math.isinf(n):
        return z
    if n <= 1 or (z * z + n - 2 <= 0).any():
        raise ValueError("too few samples to adjust z")
    return z * np.sqrt((n - 1) / (z * z + n - 2))


def inconsistency(z: np.ndarray, d: np.ndarray, U: np.ndarray, method: str = "null-mle") -> float:
    """s of the model z ~ N(0, (1 - s) R + s I): 0 where z scores agree with the correlations."""
    if method not in METHODS:
        raise ValueError(f"method: {method}")
    x = U.T @ z
    if method == "null-partialmle":
        null = d == 0
        return float(np.mean(x[null] ** 2)) if null.any() else 0.0

    def full(s: float) -> float:
        v = (1 - s) * d + s
        with np.errstate(all="ignore"):
            out = 0.5 * float((np.log(v) + x * x / v).sum())
        return out if math.isfinite(out) else math.inf

    def pseudo(s: float) -> float:
        P = (U / ((1 - s) * d + s)) @ U.T
        q = np.diag(P)
        return 0.5 * float((math.log(2 * math.pi) - np.log(q) + (P @ z) ** 2 / q).sum())

    return minimise(full if method == "null-mle" else pseudo, 1e-12, 1 - 1e-12, tol=1e-12)


def simplex_mixture(log_likelihood: np.ndarray, steps: int = 2000) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of a mixture by maximum likelihood: weights, log likelihoods, and by how much the optimality conditions fail.

    At the optimum the gradient of each component in use equals the number of rows, and that
    of no other exceeds it. Newton steps move the components in use; where a weight reaches 0
    it leaves, and the component that fails the condition most enters with a little weight.
    """
    top = log_likelihood.max(1)
    L = np.exp(log_likelihood - top[:, None])
    n, k = L.shape
    value = lambda w: float(np.log(np.maximum(L @ w, 1e-300)).sum())
    w = np.full(k, 1 / k)
    for _ in range(100):  # multiplicative steps find the region of the optimum
        w = w * (L / (L @ w)[:, None]).mean(0)
        w /= w.sum()
    w = np.where(w > 1e-4 / k, w, 0.0)
    w /= w.sum()
    for _ in range(steps):
        gradient = (L / (L @ w)[:, None]).sum(0)
        on = np.flatnonzero(w > 0)
        if np.abs(gradient[on] - n).max() < 1e-7 * n:
            worst = int(np.argmax(gradient))
            if gradient[worst] <= n * (1 + 1e-9):
                break
            unit = np.eye(k)[worst]
            share = minimise(lambda t, w=w, u=unit: -value((1 - t) * w + t * u), 0.0, 1.0, cells=16)
            w = (1 - share) * w + share * unit
            on = np.flatnonzero(w > 0)
            gradient = (L / (L @ w)[:, None]).sum(0)
        A = L[:, on] / (L @ w)[:, None]
        K = np.block([[A.T @ A + 1e-9 * np.eye(len(on)), np.ones((len(on), 1))], [np.ones((1, len(on))), np.zeros((1, 1))]])
        step = np.linalg.lstsq(K, np.append(gradient[on], 0.0), rcond=None)[0][:-1]
        falling = step < 0
        room = float(np.min(-w[on][falling] / step[falling])) if falling.any() else math.inf
        size, old = min(1.0, room), value(w)
        while size > 1e-10:
            new = w.copy()
            new[on] = w[on] + size * step
            new[new < 1e-15] = 0.0
            if value(new) >= old - 1e-13 * abs(old):
                break
            size /= 2
        w = new / new.sum()
    violation = max(0.0, float((L / (L @ w)[:, None]).sum(0).max() - n))
    return w, np.log(L @ (w + 1e-15)) + top, violation


def kriging(z, R, n: float | None = None, *, s: float | None = None, method: str = "null-mle", r_tol: float = 1e-8, flip_log_lr: float = 2.0, flip_abs_z: float = 2.0) -> dict:
    """Each z score beside its conditional distribution given the others, and the evidence that its allele is flipped.

    Arrays by variable (expected, variance, residual, log likelihood ratio, status) and s; over
    1 it counts as 0.8. A missing score isn't assessed.
    """
    missing = np.isnan(np.asarray(z, float))
    d, U = decompose(R, r_tol)
    z = adjusted(z, n)
    s = inconsistency(z, d, U, method) if s is None else float(s)
    if not math.isfinite(s) or s < 0:
        raise ValueError("s must be 0 or more")
    s = 0.8 if s > 1 else s
    v = (1 - s) * d + s
    P = (U * np.divide(1.0, v, out=np.zeros_like(v), where=v != 0)) @ U.T
    q = np.diag(P).copy()
    valid = np.isfinite(q) & (q > 0)
    variance = np.divide(1.0, q, out=np.full(len(q), np.nan), where=valid)
    np.fill_diagonal(P, 0.0)
    expected = -variance * (P @ z)
    residual = (z - expected) / np.sqrt(variance)
    ratio, status = np.full(len(z), np.nan), np.where(valid & ~missing, "conditional_only", "not_assessed").astype(object)
    violation = None
    if valid.all() and np.isfinite(residual).all():
        top = 2.0 if (residual**2).max() < 1 else 2 * float(np.abs(residual).max())
        grid = top * 1.05 ** np.arange(-math.ceil(math.log(top / 0.8) / math.log(1.05)), 1)
        sd = np.sqrt(variance)[:, None] * grid
        density = lambda x: -0.5 * (x[:, None] / sd) ** 2 - np.log(sd) - 0.5 * math.log(2 * math.pi)
        w, as_is, violation = simplex_mixture(density(z - expected))
        other = density(z + expected)
        peak = other.max(1)
        flipped = np.log(np.exp(other - peak[:, None]) @ (w + 1e-15)) + peak
        ratio = np.where(missing, np.nan, flipped - as_is)
        hit = (ratio > flip_log_lr) & (np.abs(z) > flip_abs_z)
        status = np.where(missing, "not_assessed", np.where(hit, "flagged", "not_flagged")).astype(object)
    return {"s": s, "z": z, "expected": expected, "variance": variance, "residual": residual, "log_lr": ratio, "status": status, "violation": violation}


def fit_rss_ridge(z, R, n: float | None, spec: FitSpec, ridge: float | None = None, prior=None) -> Fit:
    """Fit under z ~ N(R b, sigma2 R + ridge I); the ridge is estimated from the null space of R where it is None.

    With the residual variance fixed this is a fit to cross products in the eigenvectors of R;
    an estimated one is searched between warm fits.
    """
    d, U = decompose(R, spec.r_tol)
    z = adjusted(z, n) if spec.z_method == "wald" else np.nan_to_num(np.asarray(z, float))
    x = U.T @ z
    null = d == 0
    ridge = (float(np.mean(x[null] ** 2)) if null.any() else 0.0) if ridge is None else float(ridge)
    total = spec.residual_variance or 1.0
    if ridge < 0 or total - ridge <= 0:
        raise ValueError("the residual variance must exceed the ridge, which can't be negative")
    sigma2, state, out = total - ridge, None, None
    inner = replace(spec, estimate_residual_variance=False, refine=False, check_prior=False)
    for _ in range(20 if spec.estimate_residual_variance else 1):
        v = sigma2 * d + ridge
        inverse = np.divide(1.0, v, out=np.zeros_like(v), where=v > 0)
        Q, g = (U * (d * d * inverse)) @ U.T, U @ (d * inverse * x)
        m = int((v > 0).sum())
        out = fit((Q + Q.T) / 2, g, float((x * x * inverse).sum()), float(max(m, 2)), inner, V0=spec.prior_variance, sigma2=1.0, prior=prior, start=state)
        shift = 0.5 * float(np.log(v[v > 0]).sum())
        out.elbo = [e - shift for e in out.elbo]
        if not spec.estimate_residual_variance:
            break
        b = U.T @ (out.alpha * out.mu).sum(0)[: len(z)]
        spread = (out.alpha * out.mu2).sum(0)[: len(z)] - ((out.alpha * out.mu) ** 2).sum(0)[: len(z)]
        miss = (x - d * b) ** 2 + (d * d) * ((U * U).T @ np.maximum(spread, 0.0))
        loss = lambda t: 0.5 * float((np.log(np.exp(t) * d[d > 0] + ridge) + miss[d > 0] / (np.exp(t) * d[d > 0] + ridge)).sum())
        new = math.exp(minimise(loss, math.log(1e-4), math.log(max(total - ridge, 1e-3))))
        state = {"alpha": out.alpha, "mu": out.mu, "mu2": out.mu2, "V": out.V}
        if abs(new - sigma2) < spec.tol:
            break
        sigma2 = new
    out.sigma2 = sigma2
    return out
