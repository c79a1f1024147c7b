import math

import numpy as np
import pytest

from locuslake.functions import ld, panels
from locuslake.functions.solver import FitSpec, Gram, SlotPrior, block_coordinate_ascent, fit, fit_auto, fit_individual, fit_rss, fit_suff_stat, fit_trend, objective_of, set_members, start_from_coefficients
from locuslake.functions.special import digamma, log10_p_value, logsumexp, minimise, normal_cdf, normal_quantile

ONE = FitSpec(L=1, estimate_prior="none", residual_variance=1.0)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    X = rng.normal(size=(400, 40))
    X[:, 8] = X[:, 7] + 0.05 * rng.normal(size=400)
    y = X[:, 7] - 0.8 * X[:, 23] + rng.normal(size=400)
    return X, y


def test_closed_form_of_one_effect():
    z, n, V = np.array([3.0, 1.0, 0.0]), 100, 0.2
    out = fit_rss(z, np.eye(3), n, ONE)
    a = (n - 1) / (z * z + n - 2)
    b, s2 = z * np.sqrt(a) / math.sqrt(n - 1), 1 / (n - 1)
    lbf = -0.5 * np.log(1 + V / s2) + 0.5 * b * b * V / (s2 * (V + s2))
    expected = np.exp(lbf) / np.exp(lbf).sum()
    assert np.abs(out.alpha[0] - expected).max() < 1e-13 and out.niter == 2
    assert np.abs(out.mu[0] - V / (V + s2) * b).max() < 1e-13


def test_zero_diagonal_has_no_evidence():
    out = fit(np.array([[0.0, 0], [0, 99]]), np.array([0.0, 3]), 99, 100, ONE, V0=0.2, sigma2=1.0)
    assert np.isfinite(out.pip()).all() and out.mu[0, 0] == 0


def test_effects_are_found_and_elbo_rises(data):
    X, y = data
    X, y = X - X.mean(0), y - y.mean()
    for method in ("optim", "EM", "simple"):
        out = fit_suff_stat(X.T @ X, X.T @ y, y @ y, 400, FitSpec(L=5, estimate_prior=method, estimate_residual_variance=True, tol=1e-3))
        assert out.converged and out.pip()[23] > 0.99 and out.pip()[7] + out.pip()[8] > 0.95
        assert np.diff(out.elbo).min() > -1e-6
        assert np.abs(out.alpha.sum(1) - 1).max() < 1e-10


def test_designs_agree_with_their_cross_products(data):
    X, y = data
    spec = FitSpec(L=4, estimate_residual_variance=True)
    a = fit_individual(X, y, spec)
    Xc, yc = X - X.mean(0), y - y.mean()
    b = fit_suff_stat(Xc.T @ Xc, Xc.T @ yc, yc @ yc, len(y), spec)
    assert np.abs(a.alpha - b.alpha).max() < 1e-6 and abs(a.elbo[-1] - b.elbo[-1]) < 1e-5
    coef = (a.alpha * a.mu).sum(0) / a.scales
    assert np.abs(a.fitted - (X @ coef + a.intercept)).max() < 1e-9 and abs(a.fitted.mean() - y.mean()) < 1e-9
    gram, v = Gram.design(X, X.mean(0), np.full(40, 2.0)), np.random.default_rng(1).normal(size=40)
    assert np.abs(gram @ v - (Xc / 2).T @ ((Xc / 2) @ v)).max() < 1e-8


def test_order_of_variables_does_not_matter(data):
    X, y = data
    order = np.random.default_rng(3).permutation(40)
    spec = FitSpec(L=4, estimate_residual_variance=True)
    assert np.abs(fit_individual(X, y, spec).pip()[order] - fit_individual(X[:, order], y, spec).pip()).max() < 1e-6


@pytest.mark.parametrize("criterion", ["elbo", "alpha_pip", "joint", "pip"])
def test_stopping_rules(data, criterion):
    out = fit_individual(*data, FitSpec(L=4, estimate_residual_variance=True, criterion=criterion, max_iter=200))
    assert out.converged and out.criterion == criterion and out.niter >= 2
    last = out.trace[-1]
    assert criterion == "elbo" or last["delta_alpha"] < 1e-4 and last["delta_pip"] < 1e-4
    short = fit_individual(*data, FitSpec(L=4, criterion=criterion, max_iter=1))
    assert not short.converged and short.stop_reason == "iteration_limit"


@pytest.mark.parametrize("spec", [FitSpec(L=4, residual_model="nig"), FitSpec(L=4, slot=SlotPrior()), FitSpec(L=4, slot=SlotPrior("gamma_poisson", expected=2, batch=True)), FitSpec(L=12, greedy_step=3), FitSpec(L=4, refine=True), FitSpec(L=4, mixture=((0.1, 0.5), (0.5, 0.5))), FitSpec(L=4, mixture=((0.1, 0.5), (0.5, 0.5)), residual_model="nig")])
def test_models_find_the_effects(data, spec):
    out = fit_individual(*data, spec)
    assert out.pip()[23] > 0.99 and out.pip()[7] + out.pip()[8] > 0.95 and out.pip()[[0, 1, 2]].max() < 0.2
    if spec.slot:
        assert (np.sort(out.slot_weights)[-2:] > 0.99).all() and (out.slot_weights <= 1).all()
    if spec.greedy_step:
        assert len(out.V) < 12


def test_inverse_gamma_of_one_effect_against_quadrature(data):
    """The marginal likelihood of one variable, by integrating over the effect's scale-free form and the variance numerically."""
    rng = np.random.default_rng(5)
    x, n = rng.normal(size=30), 30
    y = 0.5 * x + rng.normal(size=30)
    x, y = x - x.mean(), y - y.mean()
    spec = FitSpec(L=1, residual_model="nig", estimate_prior="none", alpha0=2.0, beta0=2.0, standardize=False, scaled_prior_variance=0.2)
    out = fit_suff_stat(np.array([[x @ x]]), np.array([x @ y]), y @ y, n, spec)
    s = np.exp(np.linspace(-6, 6, 20001))
    quad = y @ y - 0.2 * (x @ y) ** 2 / (1 + 0.2 * x @ x)
    log = -n / 2 * np.log(2 * np.pi * s) - 0.5 * np.log(1 + 0.2 * x @ x) - quad / (2 * s) + np.log(1.0) - 2 * np.log(s) - 1 / s  # IG(1, 1)
    marginal = np.log(np.trapezoid(np.exp(log - log.max()) * s, np.log(s))) + log.max()
    assert abs(out.elbo[-1] - marginal) < 1e-3


def test_automatic_number_and_trend(data):
    out = fit_auto(*data)
    assert len(out.V) <= 8 and out.pip()[23] > 0.99
    rng = np.random.default_rng(2)
    truth = np.r_[np.zeros(40), np.full(40, 3.0), np.ones(20)]
    out = fit_trend(truth + 0.3 * rng.normal(size=100))
    assert set(np.flatnonzero(out.pip() > 0.5)) == {39, 79} and np.abs(out.fitted - truth).max() < 0.3
    kink = np.r_[np.arange(30.0), 30 - np.arange(30.0)]
    assert np.abs(fit_trend(kink + 0.1 * rng.normal(size=60), FitSpec(L=6, estimate_residual_variance=True), order=1).fitted - kink).max() < 3


def test_missing_z_counts_as_zero_and_bad_input_raises():
    a = fit_rss(np.array([3.0, np.nan]), np.eye(2), 100, ONE)
    assert np.allclose(a.pip(), fit_rss(np.array([3.0, 0.0]), np.eye(2), 100, ONE).pip())
    for bad in ({"z": [np.inf, 0.0]}, {"z": None, "bhat": [0.1, 0.2], "shat": [0.1, 0.0]}, {"z": [1.0, 0.0], "maf": [0.1, 0.1], "maf_threshold": 0.2}, {"z": [1.0, 0.0], "maf_threshold": 0.2}):
        with pytest.raises(ValueError):
            fit_rss(**{"R": np.eye(2), "n": 100, "spec": ONE} | bad)
    with pytest.raises(ValueError, match="unreasonably large"):
        fit_rss(np.array([0.001, 0.001]), np.eye(2), 100, FitSpec(L=1, estimate_prior="none", scaled_prior_variance=1.0, residual_variance=1.0))
    with pytest.raises(ValueError, match="semidefinite"):
        fit_rss(np.array([1.0, 0.0]), np.array([[1, 1.5], [1.5, 1]]), 100, FitSpec(check_psd=True))
    assert any("can't explain" in w for w in fit_suff_stat(np.array([[99.0, 0], [0, 0]]), np.array([9.0, 1.0]), 99, 100, FitSpec(L=1, check_psd=True)).warnings)
    kept = fit_rss(np.array([3.0, 9.0, 0.0]), np.eye(3), 100, ONE, maf=[0.3, 0.2, 0.4], maf_threshold=0.2)
    assert np.allclose(kept.pip(), fit_rss(np.array([3.0, 0.0]), np.eye(2), 100, ONE).pip())


def test_sets_of_equal_members_and_of_the_null_column():
    out = fit_rss(np.array([5.0, 5.0, 0.0]), np.array([[1, 0.2, 0], [0.2, 1, 0], [0, 0, 1]]), 200, FitSpec(L=2))
    R = np.eye(3)
    assert set_members(out, R, 0.0, None)[0].size == 1
    out.alpha[:], out.V[:] = np.array([[0.5, 0.5, 0.0]] * 2), np.array([0.0, 1.0])
    assert set_members(out, R, 0.95, None) == []  # the inactive effect came first
    out.alpha[1] = [0.0, 0.0, 1.0]
    out.null_index = 2
    assert set_members(out, R, 0.95, None) == []


def test_conditional_distributions_against_their_closed_form():
    rng = np.random.default_rng(4)
    A = rng.normal(size=(200, 6))
    R = np.corrcoef(A.T)
    z = rng.multivariate_normal(np.zeros(6), R)
    out = ld.kriging(z, R, s=0.1)
    S = 0.9 * R + 0.1 * np.eye(6)
    for j in range(6):
        o = np.arange(6) != j
        w = np.linalg.solve(S[np.ix_(o, o)], S[o, j])
        assert abs(out["expected"][j] - w @ z[o]) < 1e-9 and abs(out["variance"][j] - (S[j, j] - w @ S[o, j])) < 1e-9
    assert out["violation"] < 1e-5 and set(out["status"]) <= {"flagged", "not_flagged"}


def test_flipped_alleles_are_flagged():
    rng = np.random.default_rng(6)
    base = rng.normal(size=(500, 1))
    A = np.concatenate([base + 0.1 * rng.normal(size=(500, 8)), rng.normal(size=(500, 8))], 1)
    R = np.corrcoef(A.T)
    z = np.r_[np.full(8, 6.0) + 0.1 * rng.normal(size=8), 0.5 * rng.normal(size=8)]
    z[3] = -z[3]
    out = ld.kriging(z, R, 500, s=0.05)
    assert out["status"][3] == "flagged" and "flagged" not in set(out["status"][8:])


def test_inconsistency_is_small_where_scores_agree():
    rng = np.random.default_rng(7)
    A = rng.normal(size=(400, 30))
    R = np.corrcoef(A.T)
    d, U = ld.decompose(R)
    fine, wild = rng.multivariate_normal(np.zeros(30), R), 10 * rng.normal(size=30)
    assert all(0 <= ld.inconsistency(fine, d, U, m) <= 1 for m in ld.METHODS)
    R2 = np.full((30, 30), 0.95) + 0.05 * np.eye(30)
    d, U = ld.decompose(R2)
    assert ld.inconsistency(rng.multivariate_normal(np.zeros(30), R2), d, U) < 0.2 < ld.inconsistency(wild / 10, d, U)


def test_simplex_mixture_reaches_the_optimality_conditions():
    rng = np.random.default_rng(8)
    x = np.r_[rng.normal(size=80), 4 * rng.normal(size=20)]
    sd = np.array([0.1, 0.5, 1.0, 2.0, 4.0, 8.0])
    w, log, violation = ld.simplex_mixture(-0.5 * (x[:, None] / sd) ** 2 - np.log(sd))
    assert abs(w.sum() - 1) < 1e-12 and violation < 1e-5 and w[2] > 0.3
    for _ in range(200):
        other = rng.dirichlet(np.ones(6))
        assert np.log(np.exp(-0.5 * (x[:, None] / sd) ** 2 - np.log(sd)) @ other).sum() <= log.sum() + 1e-6


def test_ridge_fit_finds_the_effect():
    rng = np.random.default_rng(9)
    A = rng.normal(size=(500, 20))
    R = np.corrcoef(A.T)
    z = R[:, 4] * 8 + 0.3 * rng.normal(size=20)
    assert ld.fit_rss_ridge(z, R, 500, FitSpec(L=3), 0.05).pip()[4] > 0.9


def test_special_functions():
    assert abs(digamma(1.0) + 0.5772156649015329) < 1e-12
    assert abs(logsumexp(np.array([1000.0, 1000.0])) - 1000 - np.log(2)) < 1e-12
    assert abs(minimise(lambda x: (x - 3) ** 2, -30, 15) - 3) < 1e-6
    assert abs(normal_cdf(1.959963984540054) - 0.975) < 1e-12 and abs(normal_quantile(0.975) - 1.959963984540054) < 1e-9
    p = log10_p_value(np.array([0.0, 1.959963984540054, 36.0, 50.0]))
    assert abs(p[0]) < 1e-12 and abs(p[1] + math.log10(0.05)) < 1e-9 and abs(log10_p_value(34.9999) - log10_p_value(35.0001)) < 5e-3 and abs(p[3] - 544.6653) < 0.001


def test_objective_of_a_posterior_is_the_logged_one(data):
    X, y = data
    X, y = X - X.mean(0), y - y.mean()
    spec = FitSpec(L=4, standardize=False, tol=1e-9)
    out = fit_suff_stat(X.T @ X, X.T @ y, y @ y, 400, spec)
    out.V[:], active = out.V, out.V > 0
    assert abs(objective_of(out, X.T @ X, X.T @ y, y @ y, 400) - out.elbo[-1]) < 1e-4 and active.sum() == 2


def test_warm_starts_and_ascent():
    start = start_from_coefficients([1, 3], [0.5, -0.2], 5)
    assert start["alpha"].shape == (2, 5) and start["mu"][1, 3] == -0.2
    with pytest.raises(ValueError):
        start_from_coefficients([1, 1], [0.5, 0.2], 5)
    z, R = np.array([6.0, 0.0, -5.0]), np.eye(3)
    cold = fit_rss(z, R, 200, FitSpec(L=2))
    warm = fit_rss(z, R, 200, FitSpec(L=2), start={"alpha": cold.alpha, "mu": cold.mu, "mu2": cold.mu2, "V": cold.V})
    assert warm.niter == 2 and np.abs(warm.alpha - cold.alpha).max() < 1e-6
    value = lambda m, d: -((m - d) ** 2)
    model, values, reason = block_coordinate_ascent(0.0, 3.0, lambda m, d, k: m + (d - m) / 2, value, tol=1e-6)
    assert reason == "converged" and abs(model - 3) < 0.01 and values == sorted(values)
    assert block_coordinate_ascent(3.0, 3.0, lambda m, d, k: m + 1, value)[::2] == (3.0, "objective_fell")


def test_references_of_limited_size_weaken_secondary_evidence():
    rng = np.random.default_rng(10)
    A = rng.normal(size=(2000, 15))
    A[:, 1] = A[:, 0] + 0.3 * rng.normal(size=2000)
    R = np.corrcoef(A.T)
    z = R[:, 0] * 14 - R[:, 7] * 8 + 0.2 * rng.normal(size=15)
    exact, _ = panels.fit_rss_reference(z, R, 2000, FitSpec(L=3))
    small, quality = panels.fit_rss_reference(z, R, 2000, FitSpec(L=3), size=60)
    assert np.abs(exact.pip() - fit_rss(z, R, 2000, FitSpec(L=3, check_prior=False)).pip()).max() < 1e-6
    assert small.lbf.sum() < exact.lbf.sum() and max(quality["attenuation"]) > 0 and set(quality["attenuation_label"]) <= {"stable", "mildly_sensitive", "sensitive", "highly_sensitive"}
    S = R.copy()
    S[7], S[:, 7] = -S[7], -S[:, 7]
    S[0], S[:, 0] = 0.2 * S[0], 0.2 * S[:, 0]
    np.fill_diagonal(S, 1.0)
    _, wrong = panels.fit_rss_reference(z, S, 2000, FitSpec(L=3), mismatch=True)
    _, right = panels.fit_rss_reference(z, R, 2000, FitSpec(L=3), mismatch=True)
    assert wrong["bias"] >= right["bias"]
    gated, quality = panels.fit_rss_reference(z, S, 2000, FitSpec(L=3), mismatch=True, gate=5e-8)
    assert np.isfinite(gated.alpha).all() and quality["bias"] >= 0


def test_panels_are_weighted_by_what_they_explain():
    rng = np.random.default_rng(11)
    A, B = rng.normal(size=(800, 10)), rng.normal(size=(800, 10))
    A[:, 1] = A[:, 0] + 0.4 * rng.normal(size=800)
    B[:, 5] = B[:, 0] + 0.4 * rng.normal(size=800)
    R = [np.corrcoef(X.T) for X in (B, A)]
    z = R[1][:, 0] * 10 + 0.2 * rng.normal(size=10)
    out, weights = panels.fit_rss_panels(z, R, 800, FitSpec(L=1))  # either panel alone has the same objective
    assert abs(weights.sum() - 1) < 1e-9 and weights[1] > 0.8 and out.pip()[0] > 0.8
