"""Operators over fit tables against NumPy, on small regions with known effects."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from locuslake.functions.solver import FitSpec, fit_rss
from locuslake.operators import analysis, comparison, convergence, diagnostics, figures, fitting, inputs, moments, posterior, reference, report
from locuslake.sources import examples, gtf, store


@pytest.fixture(scope="module")
def region():
    rng = np.random.default_rng(0)
    out = {}
    for name in ("a", "b"):
        X = rng.normal(size=(300, 12))
        X[:, 5] = X[:, 4] + 0.05 * rng.normal(size=300)
        out[name] = X, X[:, 4] - 0.7 * X[:, 10] + rng.normal(size=300)
    return out


@pytest.fixture(scope="module")
def table(spark, region):
    rows = [(name, i, X[i].tolist(), [float(y[i])]) for name, (X, y) in region.items() for i in range(300)]
    samples = spark.createDataFrame(rows + [("a", 999, [1.0] * 12, [None])], "region_id string, sample_id int, x array<double>, y array<double>").repartition(3)
    return moments.region_moments(samples, block=5).cache()


@pytest.fixture(scope="module")
def fits(spark, table):
    assoc = moments.marginal_regressions(table).select("region_id", "idx", "z", "n")
    lonely = spark.createDataFrame([("alone", 0, 1.0, 100.0)], assoc.schema)
    return fitting.sensitivity(assoc.unionByName(lonely), table.select("region_id", "i", "r"), FitSpec(L=4), {"narrow": {"L": 1}, "short": {"max_iter": 2}}).cache()


@pytest.fixture(scope="module")
def fit(fits):
    return fitting.effects(fits).cache()


def test_moments(table, region):
    X, y = region["a"]
    rows = table.where("region_id = 'a'").orderBy("i").collect()
    assert len(rows) == 12 and rows[0].n == 300
    assert np.abs(np.array([r.r for r in rows]) - np.corrcoef(X.T)).max() < 1e-12
    Xc = X - X.mean(0)
    assert np.abs(np.array([r.xtx for r in rows]) - Xc.T @ Xc).max() < 1e-9 and np.abs(np.array([r.xty[0] for r in rows]) - Xc.T @ (y - y.mean())).max() < 1e-9


def test_spread_and_small_limits_change_nothing(spark):
    rng = np.random.default_rng(20)
    rows = [(f"r{i % 7}", rng.normal(size=4).tolist(), rng.normal(size=1).tolist()) for i in range(210)]
    samples = spark.createDataFrame(rows, "region_id string, x array<double>, y array<double>")
    plain, other = ({(r.region_id, r.i): np.r_[r.n, r.mean, r.xtx, r.xty] for r in moments.region_moments(samples, **k).collect()} for k in ({}, {"spread": 2, "limit": 1, "block": 3}))
    assert plain.keys() == other.keys() and len(plain) == 28 and max(np.abs(plain[k] - other[k]).max() for k in plain) < 1e-9


def test_constant_predictors_have_no_slope(spark):
    rows = [("a", [1.0, float(i)], [float(i % 3)]) for i in range(10)]
    got = moments.marginal_regressions(moments.region_moments(spark.createDataFrame(rows, "region_id string, x array<double>, y array<double>"))).orderBy("idx").collect()
    assert got[0].bhat == 0 and got[0].z is None and got[1].z is not None
    assert moments.region_moments(spark.createDataFrame([], "region_id string, x array<double>, y array<double>")).count() == 0


def test_fits_equal_the_solver_and_failures_are_rows(fits, table, region):
    status = {(r.region_id, r.setting): (r.status, r.niter, r.converged) for r in fits.select("region_id", "setting", "status", "niter", "converged").collect()}
    assert status["alone", "baseline"] == ("no correlations", None, None) and status["a", "short"][1] == 2 and len(status) == 9
    X, y = region["a"]
    z = [r.z for r in moments.marginal_regressions(table).where("region_id = 'a'").orderBy("idx").collect()]
    want = fit_rss(z, np.corrcoef(X.T), 300, FitSpec(L=4))
    got = np.array([c.alpha for c in fits.where("region_id = 'a' AND setting = 'baseline'").first().components])
    assert np.abs(got - want.alpha).max() < 1e-8
    assert len(fitting.traces(fits).where("region_id = 'a' AND setting = 'baseline'").collect()) == want.niter


def test_bad_regions_do_not_stop_others(spark):
    assoc = spark.createDataFrame([("x", 0, float("inf"), 50.0), ("y", 0, 2.0, 50.0), ("w", 0, 2.0, 50.0)], "region_id string, idx int, z double, n double")
    rows = spark.createDataFrame([("x", 0, [1.0]), ("y", 0, [1.0]), ("w", 0, [1.0, 0.0]), ("v", 0, [1.0])], "region_id string, i int, r array<double>")
    got = {r.region_id: r.status for r in fitting.fit_regions(assoc, rows, FitSpec(L=1)).collect()}
    assert got == {"x": "failed", "y": "fitted", "w": "failed", "v": "no associations"}
    assert fitting.fit_regions(assoc.limit(0), rows.limit(0), FitSpec(L=1)).count() == 0


def test_posterior(fit, region):
    rows = fit.where("region_id = 'a'").collect()
    alpha, mu, mu2 = (np.zeros((4, 12)) for _ in range(3))
    V = np.zeros(4)
    for r in rows:
        alpha[r.component_id, r.idx], mu[r.component_id, r.idx], mu2[r.component_id, r.idx], V[r.component_id] = r.alpha, r.mu, r.mu2, r.V
    on = V > 1e-9
    pip = {r.idx: r.pip for r in posterior.pip(fit).where("region_id = 'a'").collect()}
    assert max(abs(pip[j] - (1 - np.prod(1 - alpha[on, j]))) for j in range(12)) < 1e-12 and pip[10] > 0.99
    moments_ = {r.idx: r for r in posterior.posterior_moments(fit).where("region_id = 'a'").collect()}
    m = alpha[on] * mu[on]
    assert max(abs(moments_[j].mean - m[:, j].sum()) for j in range(12)) < 1e-12
    assert max(abs(moments_[j].sd - np.sqrt((alpha[on, j] * mu2[on, j] - m[:, j] ** 2).sum())) for j in range(12)) < 1e-9
    rate = {r.component_id: r.lfsr for r in posterior.local_false_sign_rate(fit).where("region_id = 'a'").collect()}
    assert rate[0] < 0.01 and all(0 <= x <= 1 for x in rate.values())


def test_credible_set_audit(spark, fit, table):
    sets = {(r.region_id, r.component_id): r for r in posterior.credible_sets(fit, table).collect()}
    assert {tuple(r.members) for r in sets.values() if r.region_id == "a"} == {(4, 5), (10,)} and all(r.min_abs_corr > 0.9 for r in sets.values())
    rows = [("r", 0, 0, 0.6, 0.0), ("r", 0, 1, 0.4, 0.0), ("r", 0, 2, 0.0, 0.0), ("r", 1, 0, 0.6, 1.0), ("r", 1, 1, 0.4, 1.0), ("r", 1, 2, 0.0, 1.0), ("r", 2, 0, 0.1, 1.0), ("r", 2, 1, 0.1, 1.0), ("r", 2, 2, 0.8, 1.0), ("r", 3, 0, 0.97, 1.0), ("r", 3, 1, 0.03, 1.0), ("r", 3, 2, 0.0, 1.0)]
    small = spark.createDataFrame(rows, "region_id string, component_id int, idx int, alpha double, V double").withColumn("null_index", F.lit(2))
    matrix = spark.createDataFrame([("r", 0, [1.0, 0.3, 0.0]), ("r", 1, [0.3, 1.0, 0.0]), ("r", 2, [0.0, 0.0, 1.0])], "region_id string, i int, r array<double>")
    why = {r.component_id: r.reason for r in posterior.credible_set_audit(small, matrix).collect()}
    assert why == {0: "inactive", 1: "duplicate", 2: "contains_null", 3: "retained"}
    wide = {r.component_id: (r.members, r.reason) for r in posterior.credible_set_audit(small, matrix, extension_corr=0.2).collect()}
    assert wide[3] == ([0, 1], "low_purity")
    assert {r.reason for r in posterior.credible_set_audit(small, None, None).collect()} == {"disabled"}
    assert all(len(r.members) == 1 for r in posterior.set_candidates(small, 0.0).collect())


def test_summaries(fit, table):
    tables = analysis.summarize(fit, table, assoc=moments.marginal_regressions(table).select("region_id", "idx", "z"))
    assert tables["variants"].count() == 24 and tables["components"].where("retained").count() == 4
    assert {r.status for r in tables["prior_influence"].collect()} == {"exact", "inactive"}
    variables, sets = analysis.model_summary(fit, tables["credible_sets"])
    first = variables.where("region_id = 'a'").orderBy("place").first()
    assert first.idx == 10 and first.cs >= 0 and variables.where("cs = -1").count() == 18 and sets.count() == 4


def test_comparison(fits, table):
    both = fitting.effects(fits, None).where("setting <> 'short'")
    sets = posterior.credible_sets(both, table)
    tables = comparison.compare_fits(both, sets, table, baseline="baseline")
    fate = {(r.region_id, r.component_id_a): r.fate for r in tables["stability"].collect()}
    assert sorted(fate.values()) == ["lost", "lost", "matched", "matched"]
    assert tables["metrics"].count() == 2 and tables["variants"].count() == 24 and tables["unmatched"].where("side = 'a'").count() == 2
    again = comparison.greedy_matches(tables["edges"])
    assert again.count() == 2


def test_labels_of_edges(spark):
    rows = [("r", "x", "y", a, b, 0.5) for a, b in ((0, 0), (1, 1), (1, 2), (3, 3), (4, 3))]
    edges = spark.createDataFrame(rows, "region_id string, setting_a string, setting_b string, component_id_a int, component_id_b int, overlap double")
    got = {(r.component_id_a, r.component_id_b): r.label for r in comparison.classified(edges).collect()}
    assert got == {(0, 0): "matched", (1, 1): "split", (1, 2): "split", (3, 3): "merge", (4, 3): "merge"}


def test_alleles(spark):
    schema = "variant_id string, effect string, other string"
    a = spark.createDataFrame([("1", "A", "c"), ("2", "A", "C"), ("3", None, "C")], schema)
    b = spark.createDataFrame([("1", "a", "C"), ("2", "C", "A"), ("3", "A", "C")], schema)
    assert {r.variant_id: r.sign for r in comparison.allele_orientation(a, b).collect()} == {"1": 1, "2": -1, "3": None}
    with pytest.raises(Exception, match="disagree"):
        comparison.allele_orientation(a, spark.createDataFrame([("1", "G", "T")], schema)).collect()


def test_configurations_against_enumeration(spark):
    rng = np.random.default_rng(3)
    lbf = rng.normal(size=(3, 7)) * 2
    lbf[2, 4] += 6
    lbf[0, 4] += 6
    rows = [("r", k, 0, j, float(lbf[k, j])) for k in range(3) for j in range(7)]
    configs, marginal = posterior.outcome_configurations(spark.createDataFrame(rows, "region_id string, outcome int, component_id int, idx int, lbf_variable double"))
    weight = {c: np.mean(np.exp(sum((lbf[k] for k in range(3) if c >> k & 1), np.zeros(7)))) if c else 1.0 for c in range(8)}
    total = sum(weight.values())
    assert all(abs(r.probability - weight[r.config] / total) < 1e-12 for r in configs.collect()) and configs.count() == 8
    assert all(abs(r.probability - sum(w for c, w in weight.items() if c >> r.outcome & 1) / total) < 1e-12 for r in marginal.collect())


def test_convergence(spark, fits):
    got = {(r.region_id, r.setting): r.assessment for r in convergence.assess(fits).collect()}
    assert got["a", "baseline"] == "converged" and got["a", "short"] in ("not_assessable", "slow_monotone", "converged") and len(got) == 6
    assert convergence.objectives(fits).where("fell").count() == 0


def test_inputs(spark):
    assoc = spark.createDataFrame([("a", 0, 1.0, 0.1), ("a", 1, None, 0.3), ("a", 2, float("nan"), 0.4)], "region_id string, idx int, z double, maf double")
    matrix = spark.createDataFrame([("a", 0, [1.0, 0.1, 0.2]), ("a", 1, [0.1, 1.0, 0.3]), ("a", 2, [0.2, 0.5, 1.0])], "region_id string, i int, r array<double>")
    q = inputs.quality(assoc, matrix).first()
    assert (q.variables, q.missing_z, q.unequal, round(q.max_asymmetry, 9), q.usable) == (3, 2, 1, 0.2, True)
    assert [r.r for r in inputs.symmetrised(matrix).orderBy("i").collect()][1] == [0.1, 1.0, 0.4]
    kept, rows = inputs.maf_filtered(assoc, matrix, 0.1)
    assert [(r.old_idx, r.idx) for r in kept.orderBy("idx").collect()] == [(1, 0), (2, 1)] and [r.r for r in rows.orderBy("i").collect()] == [[1.0, 0.3], [0.5, 1.0]]
    assert [r.v for r in assoc.select(inputs.coerced(F.col("z")).alias("v")).collect()] == [1.0, 0.0, 0.0]
    path = spark.createDataFrame([("a", s, j, c) for s, j, c in ((0, 0, 0.0), (1, 0, 0.5), (0, 1, 0.0), (1, 1, 0.0), (0, 2, 0.1), (1, 2, 0.2))], "region_id string, step int, idx int, coef double")
    assert [r.idx for r in inputs.path_order(path).orderBy("place").collect()] == [2, 0, 1]


def test_sparse_designs(spark):
    rows = [("a", 0, ([1, 3], [2.0, -1.0])), ("a", 1, ([], [])), ("a", 2, ([0], [4.0]))]
    df = spark.createDataFrame(rows, "region_id string, sample_id int, x struct<indices:array<int>,values:array<double>>")
    assert [r.x for r in inputs.densified(df, 4).orderBy("sample_id").collect()] == [[0.0, 2.0, 0.0, -1.0], [0.0] * 4, [4.0, 0.0, 0.0, 0.0]]


def test_diagnostics_and_draws(spark, fits, table):
    assoc = moments.marginal_regressions(table).select("region_id", "idx", "z", "n")
    counts = {r.region_id: r.total for r in diagnostics.status_counts(diagnostics.ld_diagnostics(assoc, table.select("region_id", "i", "r"))).collect()}
    assert counts == {"a": 12, "b": 12}
    base = fits.where("setting = 'baseline'")
    draws = diagnostics.posterior_samples(base, 400, seed=3)
    assert sorted(map(tuple, draws.collect())) == sorted(map(tuple, diagnostics.posterior_samples(base.repartition(5), 400, seed=3).collect()))
    mean = draws.where("region_id = 'a' AND idx = 10").agg(F.sum("effect") / 400).first()[0]
    want = posterior.posterior_moments(fitting.effects(fits)).where("region_id = 'a' AND idx = 10").first()
    assert abs(mean - want.mean) < 5 * want.sd / 20


def test_individual_and_trends(spark, region):
    rows = [(n, i, X[i].tolist(), float(y[i])) for n, (X, y) in region.items() for i in range(300)]
    samples = spark.createDataFrame(rows, "region_id string, sample_id int, x array<double>, y double")
    fits = fitting.fit_regions_individual(samples, FitSpec(L=4, estimate_residual_variance=True))
    assert posterior.pip(fitting.effects(fits)).where("idx = 10 AND pip > 0.99").count() == 2
    steps = spark.createDataFrame([("s", i, float(i >= 20) + 0.01 * (i % 3)) for i in range(40)], "region_id string, at int, y double")
    assert posterior.pip(fitting.effects(fitting.fit_trends(steps, FitSpec(L=2, estimate_residual_variance=True)))).orderBy(F.desc("pip")).first().idx == 19


def test_store(spark, tmp_path, fit):
    path = f"file://{tmp_path}/kept"
    store.save_analysis({"fit": fit, "few": fit.limit(0)}, path, {"by": "test"})
    tables, provenance = store.load_analysis(spark, path)
    assert provenance == {"by": "test"} and tables["fit"].count() == fit.count() and tables["few"].dtypes == fit.dtypes
    fit.limit(3).write.mode("overwrite").parquet(f"{path}/fit")
    with pytest.raises(ValueError, match="isn't what was saved"):
        store.load_analysis(spark, path)
    nested = fit.groupBy("region_id").agg(F.collect_set("component_id").alias("components"))
    (out,) = store.export_tables({"nested": nested}, f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).csv(out).where("components LIKE '[%'").count() == 2
    facts = store.evidence_facts({"nested": nested}, {"nested": ["region_id"]})
    assert facts.count() == 2 and facts.select("id").distinct().count() == 2


def test_kept_fits_are_not_built_again(spark, tmp_path, table):
    built = []

    def build():
        built.append(1)
        return fitting.fit_regions(moments.marginal_regressions(table).select("region_id", "idx", "z", "n"), table.select("region_id", "i", "r"), FitSpec(L=2))

    for spec in (FitSpec(L=2), FitSpec(L=2), FitSpec(L=3)):
        out = store.cached(build, [table.select("region_id", "i", "r")], spec, f"file://{tmp_path}")
    assert len(built) == 2 and out.count() == 2


def test_gene_track(spark, tmp_path):
    lines = ['#c', 'chr1\ts\tgene\t100\t200\t.\t+\t.\tgene_id "g1"; gene_name "A";', 'chr1\ts\ttranscript\t100\t150\t.\t+\t.\tgene_id "g1"; transcript_id "t1";', 'chr2\ts\tgene\t100\t200\t.\t+\t.\tgene_id "g2";', "broken line"]
    (tmp_path / "g.gtf").write_text("\n".join(lines) + "\n")
    read = lambda a, b, **k: [(r.feature, r.gene_id, r.transcript_id) for r in gtf.read_gene_track(spark, f"file://{tmp_path}/g.gtf", chromosome="chr1", start=a, end=b, **k).collect()]
    assert read(1, 300) == [("transcript", "g1", "t1")] and read(160, 300) == [("gene", "g1", None)] and read(300, 400) == []
    with pytest.raises(ValueError):
        read(5, 1)


def test_references_panels_and_continuation(spark, fits, table):
    assoc = moments.marginal_regressions(table).select("region_id", "idx", "z", "n")
    ld = table.select("region_id", "i", "r")
    small = reference.fit_regions_reference(assoc, ld, FitSpec(L=4), size=200).collect()
    assert {r.status for r in small} == {"fitted"} and all("effective_rank" in r.refinement for r in small)
    two = ld.withColumn("panel_id", F.lit("p")).unionByName(ld.withColumn("panel_id", F.lit("q")))
    assert reference.fit_regions_panels(assoc, two, FitSpec(L=4)).where("refinement LIKE '%panels%'").count() == 2
    assert reference.fit_regions_panels(assoc, two, FitSpec(L=4), {"p": 300.0, "q": 300.0}).where("status = 'fitted'").count() == 2
    more = reference.continue_fits(fits, assoc, ld, FitSpec(L=4), "short")
    assert all(r.converged for r in more.collect()) and more.where("setting = 'continued'").count() == 2
    full = {(r.region_id, r.idx): r.pip for r in posterior.pip(fitting.effects(fits)).collect()}
    assert all(abs(full[r.region_id, r.idx] - r.pip) < 1e-3 for r in posterior.pip(fitting.effects(more, "continued")).collect())


def test_figures_and_reports(spark, tmp_path, fits, fit, table):
    sets = posterior.credible_sets(fit, table)
    rows = figures.locus(fit, sets, table)
    assert rows.count() == 48 and rows.where("member AND r2 < 0.9").count() == 0
    assert figures.signal(fit, 0).where("rank = 1").count() == 2 and figures.convergence(fitting.traces(fits)).where("gap < -1e-6").count() == 0
    assert figures.sensitivity(fitting.effects(fits, None)).where("size(pip) = 3").count() >= 4
    found = report.flags(fits, sets)
    assert {r.region_id for r in found.where("flag = 'fit_failed' AND raised").collect()} == {"alone"}
    text = {r.region_id: r.text for r in report.summary_text(found).collect()}
    assert text["a"].startswith("nothing raised; not checked: flipped_alleles") and "fit_failed" in text["alone"]
    report.write_report(spark, {"sets": sets, "flags": found}, f"file://{tmp_path}/page", rows=3)
    assert "<h2>flags</h2><p>3 of" in spark.read.text(f"file://{tmp_path}/page").first().value


def test_example(spark):
    assoc, ld = examples.example(spark, variants=60, effects={10: 0.35, 40: -0.3})
    fit = fitting.effects(fitting.fit_regions(assoc, ld, FitSpec(L=5)))
    members = [set(r.members) for r in posterior.credible_sets(fit, ld).collect()]
    assert any(10 in m for m in members) and any(40 in m for m in members)


def test_covariates_and_known_variance(spark, region):
    X, y = region["a"]
    rng = np.random.default_rng(12)
    C = rng.normal(size=(300, 2))
    shifted = y + C @ [2.0, -1.0] + 5
    rows = [("a", i, X[i].tolist(), [float(shifted[i])], C[i].tolist()) for i in range(300)]
    out = moments.residualised(spark.createDataFrame(rows, "region_id string, sample_id long, x array<double>, y array<double>, c array<double>"))
    got = np.array([r.y[0] for r in out.orderBy("sample_id").collect()])
    D = np.c_[np.ones(300), C]
    assert np.abs(got - (shifted - D @ np.linalg.lstsq(D, shifted, rcond=None)[0])).max() < 1e-9
    found = moments.uncentred_effects(moments.region_moments(out.select("region_id", "x", "y")), sigma2=2.0).where("idx = 3").first()
    assert abs(found.shat - np.sqrt(2.0 / (X[:, 3] ** 2).sum())) < 1e-9 and abs(found.bhat - X[:, 3] @ got / (X[:, 3] ** 2).sum()) < 1e-9


def test_alternative_inputs_signals_and_views(spark, table):
    assoc = moments.marginal_regressions(table).select("region_id", "idx", "z", "n")
    fits = fitting.alternative_inputs({"as_is": assoc, "turned": assoc.withColumn("z", -F.col("z")).where("region_id = 'a'")}, table.select("region_id", "i", "r"), FitSpec(L=3))
    both = fitting.effects(fits, None).cache()
    assert {(r.region_id, r.setting) for r in fits.collect()} == {("a", "as_is"), ("b", "as_is"), ("a", "turned")}
    sets = posterior.credible_sets(both, table)
    found = comparison.signals(both, sets)
    assert found.where("members IS NOT NULL").count() == 6
    edges = comparison.signal_edges(both, sets, table)
    seen = comparison.seen_from(edges, "turned")
    assert seen.count() == edges.count() == 2 and {r.setting_a for r in seen.collect()} == {"turned"}


def test_many_narrow_regions_of_a_batch_take_no_loop():
    import time

    import pyarrow as pa

    rng = np.random.default_rng(3)
    region, x, y = rng.integers(0, 5000, 10_000), rng.normal(size=(10_000, 3)), rng.normal(size=(10_000, 1))
    batch = pa.RecordBatch.from_arrays([pa.array(region.astype(str)), pa.array(list(x), pa.list_(pa.float64())), pa.array(list(y), pa.list_(pa.float64()))], names=["region_id", "x", "y"])
    began = time.process_time()
    rows = [r for part in moments._partial(1024, 16_000_000)(iter([batch])) for r in part.to_pylist()]
    took = time.process_time() - began
    assert len(rows) == len(np.unique(region)) and took < 0.5
    for r in rows[:50]:
        own = region == int(r["region_id"])
        a, b = x[own] - x[own].mean(0), y[own] - y[own].mean(0)
        assert r["n"] == own.sum() and np.allclose(np.frombuffer(r["block"]).reshape(3, 3), a.T @ a) and np.allclose(np.frombuffer(r["xty"]), (a.T @ b).ravel())


def test_one_call_merges_the_parts_of_many_regions():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    region, x, y = rng.integers(0, 40, 900), rng.normal(size=(900, 3)), rng.normal(size=(900, 2))
    batch = pa.RecordBatch.from_arrays([pa.array(region.astype(str)), pa.array(list(x), pa.list_(pa.float64())), pa.array(list(y), pa.list_(pa.float64()))], names=["region_id", "x", "y"])
    parts = [p for first in (0, 300, 600) for p in moments._partial(1024, 16_000_000)(iter([batch.slice(first, 300)]))]
    table = pa.Table.from_batches(parts)
    rows = moments._merged_many(table.append_column("wide", pa.array([False] * table.num_rows))).to_pylist()
    assert len(rows) == 3 * len(np.unique(region)) < 3 * table.num_rows
    for r in rows:
        own = region == int(r["region_id"])
        a, b = x[own] - x[own].mean(0), y[own] - y[own].mean(0)
        assert r["n"] == own.sum() and np.allclose(r["xtx"], (a.T @ a)[r["i"]]) and np.allclose(r["r"], np.corrcoef(a.T)[r["i"]]) and np.allclose(r["xty"], (a.T @ b)[r["i"]]) and np.allclose(r["yty"], (b * b).sum(0))
        assert np.isclose(r["mean"], x[own].mean(0)[r["i"]]) and np.allclose(r["y_mean"], y[own].mean(0))


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_many_narrow_regions_are_solved_at_once(spark, batch):
    import time

    from locuslake.functions.many import fit_rss_many

    rng = np.random.default_rng(5)
    own, left, right = {}, [("alone", 0, 1.0, 100.0)], [("bare", 0, [1.0])]
    for k in range(30):
        p = (1, 3, 5, 20)[k % 4]
        X = rng.normal(size=(200, p))
        y = X[:, 0] * (k % 3) + rng.normal(size=200)
        R, c = np.corrcoef(X.T).reshape(p, p), np.array([np.corrcoef(x, y)[0, 1] for x in X.T])
        z = c * np.sqrt(198 / (1 - c * c))
        name = None if k == 1 else f"r{k}"
        z[0] = np.inf if k == 5 else np.nan if k == 6 else z[0]
        own[name] = z, R
        left += [(name, i, float(z[i]), 200.0) for i in range(p)]
        right += [(name, i, R[i].tolist()) for i in range(p if k != 9 else p - 1)]
    settings = {"two": FitSpec(L=2), "short": FitSpec(L=3, max_iter=3, estimate_residual_variance=True), "pip": FitSpec(L=2, criterion="pip")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        fits = fitting.fit_regions(spark.createDataFrame(left, "region_id string, idx int, z double, n double"), spark.createDataFrame(right, "region_id string, i int, r array<double>"), settings)
        rows = fits.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == len({(r.region_id, r.setting) for r in rows}) == 3 * 32
    said = {r.region_id: (r.status, r.error) for r in rows}
    assert said["alone"] == ("no correlations",) * 2 and said["bare"] == ("no associations",) * 2 and said["r5"] == ("failed", "infinite z") and said["r9"][0] == "failed"
    for r in rows:
        if r.region_id in ("alone", "bare", "r5", "r9"):
            continue
        z, R = own[r.region_id]
        f = fit_rss(z=z, R=R, n=200.0, spec=settings[r.setting])
        assert (r.status, r.error, r.n_variants, r.niter, r.converged, r.stop_reason, r.criterion, r.warnings) == ("fitted", None, len(z), f.niter, f.converged, f.stop_reason, f.criterion, f.warnings)
        assert np.allclose(r.elbo, f.elbo) and np.isclose(r.sigma2, f.sigma2) and np.allclose(r.scales, f.scales) and np.allclose(r.prior, f.prior) and (r.null_index, r.intercept, r.refinement) == (None, None, None)
        for k, c in enumerate(r.components):
            assert c.component_id == k and c.slot_weight is c.rv is None and all(np.allclose(c[x], getattr(f, x)[k], atol=1e-5) for x in ("V", "lbf", "kl", "alpha", "mu", "mu2", "lbf_variable"))
        assert len(r.trace) == len(f.trace)
        for a, b in zip(r.trace, f.trace):
            assert (a.sweep, a.cycle_lag, a.events, a.top) == tuple(b[x] for x in ("sweep", "cycle_lag", "events", "top"))
            assert all((a[x] is None) == (b[x] is None) and (b[x] is None or np.allclose(a[x], b[x], atol=1e-5)) for x in ("elbo", "delta_elbo", "delta_alpha", "delta_pip", "sigma2", "V", "top_alpha", "entropy"))
    assert "CoGroups" not in fits._jdf.queryExecution().toString()
    z, R = own["r2"]
    began = time.process_time()
    many = fit_rss_many(np.tile(z, (2000, 1)), np.tile(R, (2000, 1, 1)), np.full(2000, 200.0), FitSpec(L=2))
    assert not many.odd.any() and time.process_time() - began < 2  # one by one over 5 seconds
