"""DuckDB SQL for the queries that SQL can express, written apart from the DataFrame operators that answer them in Spark.

Predictors are the embedding's components, with near copies of the first sixteen; component 0
answers a simulated response, components 1 to 3 the labels 0 to 2.
"""

from __future__ import annotations

import re

STEPS = {
    "x0": "SELECT vec_id, label, CAST(unnest(range(0, len(embedding))) AS BIGINT) AS idx, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings",
    "y": "SELECT vec_id, label, sum(CASE WHEN idx = 7 THEN x WHEN idx = 23 THEN -0.8e0 * x ELSE 0e0 END) + 0.5e0 * (CAST((vec_id * 7919) % 1009 AS DOUBLE) / 1009e0 - 0.5e0) AS y FROM x0 GROUP BY vec_id, label",
    "x": "SELECT vec_id, idx, x FROM x0 UNION ALL SELECT a.vec_id, a.idx + 64 AS idx, a.x + 0.1e0 * b.x AS x FROM x0 a JOIN x0 b ON a.vec_id = b.vec_id AND b.idx = a.idx + 1 WHERE a.idx < 16",
    "outcome": "SELECT vec_id, CAST(0 AS BIGINT) AS component_id, y FROM y UNION ALL SELECT vec_id, CAST(c.k + 1 AS BIGINT) AS component_id, CASE WHEN label = c.k THEN 1e0 ELSE 0e0 END AS y FROM y CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k UNION ALL SELECT 2 AS k) c",
    "moments": "SELECT component_id, idx, CAST(count(*) AS DOUBLE) AS n, avg(x) AS mx, avg(o.y) AS my, var_samp(x) AS vx, var_samp(o.y) AS vy, covar_samp(x, o.y) AS cxy, sum(x * o.y) AS sxy, sum(x * x) AS sxx, sum(o.y * o.y) AS syy FROM x JOIN outcome o USING (vec_id) GROUP BY component_id, idx",
    "marginal": "SELECT *, cxy / vx AS bhat, sqrt((vy - cxy * cxy / vx) * (n - 1) / (n - 2) / ((n - 1) * vx)) AS shat FROM moments WHERE vx > 0",
    "z": "SELECT *, bhat / shat AS z, bhat / shat * sqrt((n - 1) / (bhat / shat * (bhat / shat) + n - 2)) AS zt FROM marginal WHERE shat > 0",
    "bf": "SELECT component_id, idx, n, vx, vy, mx, my, zt, 0.2e0 AS v, -0.5e0 * ln(1 + (n - 1) * 0.2e0) + 0.5e0 * zt * zt * 0.2e0 / (0.2e0 + 1 / (n - 1)) AS lbf FROM z",
    "top": "SELECT component_id, max(lbf) AS top, count(*) AS p FROM bf GROUP BY component_id",
    "total": "SELECT component_id, max(t.top) AS top, max(p) AS p, sum(exp(lbf - t.top)) AS s FROM bf JOIN top t USING (component_id) GROUP BY component_id",
    "fit": "SELECT component_id, idx, n, vx, vy, mx, my, lbf, t.top + ln(s) + ln(1 / CAST(p AS DOUBLE) + 1.4901161193847656e-8) AS lbf_total, exp(lbf - t.top) / s AS alpha, 0.2e0 / (0.2e0 + 1 / (n - 1)) * zt / sqrt(n - 1) AS mu, 0.2e0 / (0.2e0 * (n - 1) + 1) AS post_var FROM bf JOIN total t USING (component_id)",
    "ranked": "SELECT *, sum(alpha) OVER (PARTITION BY component_id ORDER BY alpha DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, row_number() OVER (PARTITION BY component_id ORDER BY alpha DESC, idx) AS rank FROM fit",
    "member": "SELECT component_id, idx, alpha, rank FROM ranked WHERE cum - alpha < 0.95e0",
    "ld": "SELECT a.idx AS i, b.idx AS j, corr(a.x, b.x) AS r FROM x a JOIN x b ON a.vec_id = b.vec_id WHERE a.idx < b.idx GROUP BY a.idx, b.idx",
    "ld_both": "SELECT i, j, r FROM ld UNION ALL SELECT j AS i, i AS j, r FROM ld",
    "pips": "SELECT idx, 1 - exp(sum(ln(greatest(1 - alpha, 1e-300)))) AS pip FROM fit GROUP BY idx",
    "pair": "SELECT a.component_id AS a, b.component_id AS b, a.idx, a.lbf AS l1, b.lbf AS l2, a.alpha AS alpha_a, b.alpha AS alpha_b FROM fit a JOIN fit b ON a.idx = b.idx WHERE a.component_id < b.component_id",
    "pair_top": "SELECT a, b, max(l1) AS m1, max(l2) AS m2, max(l1 + l2) AS m12 FROM pair GROUP BY a, b",
    "pair_sum": "SELECT a, b, max(m1) + ln(sum(exp(l1 - m1))) AS s1, max(m2) + ln(sum(exp(l2 - m2))) AS s2, max(m12) + ln(sum(exp(l1 + l2 - m12))) AS s12 FROM pair JOIN pair_top USING (a, b) GROUP BY a, b",
    "kept": 'SELECT idx, maf, CAST(row_number() OVER (ORDER BY idx) - 1 AS BIGINT) AS new_idx FROM (SELECT idx, least(share, 1 - share) AS maf FROM (SELECT idx, avg(CASE WHEN x > 0.05e0 THEN 1e0 ELSE 0e0 END) AS share FROM x GROUP BY idx) s) m WHERE maf > 0.3e0',
    "bf2": 'SELECT component_id, idx, n, zt, -0.5e0 * ln(1 + (n - 1) * 0.01e0) + 0.5e0 * zt * zt * 0.01e0 / (0.01e0 + 1 / (n - 1)) AS lbf FROM z WHERE idx < 60',
    "fit2": 'SELECT component_id, idx, exp(lbf - max(lbf) OVER (PARTITION BY component_id)) / sum(exp(lbf - top)) OVER (PARTITION BY component_id) AS alpha, lbf FROM (SELECT *, max(lbf) OVER (PARTITION BY component_id) AS top FROM bf2) q',
    "pips2": 'SELECT idx, 1 - exp(sum(ln(greatest(1 - alpha, 1e-300)))) AS pip FROM fit2 GROUP BY idx',
    "member2": 'SELECT component_id, idx, alpha FROM (SELECT *, sum(alpha) OVER (PARTITION BY component_id ORDER BY alpha DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM fit2) q WHERE cum - alpha < 0.95e0',
    "over": 'SELECT a.component_id AS a, b.component_id AS b, sum(least(a.alpha, b.alpha)) AS overlap FROM fit2 a JOIN fit b ON a.idx = b.idx GROUP BY a.component_id, b.component_id',
    "edge": 'SELECT a, b, overlap FROM over WHERE overlap >= 0.3e0',
    "wide": 'SELECT idx, max(CASE WHEN component_id = 0 THEN lbf END) AS l0, max(CASE WHEN component_id = 1 THEN lbf END) AS l1, max(CASE WHEN component_id = 2 THEN lbf END) AS l2, max(CASE WHEN component_id = 3 THEN lbf END) AS l3 FROM fit GROUP BY idx',
    "config_rows": 'SELECT k.config, w.idx, (k.config % 2) * l0 + (k.config // 2 % 2) * l1 + (k.config // 4 % 2) * l2 + (k.config // 8 % 2) * l3 AS v FROM (SELECT unnest(range(1, 16)) AS config) k CROSS JOIN wide w',
    "config_log": 'SELECT config, max(v) + ln(sum(exp(v - top))) - ln(CAST(count(*) AS DOUBLE)) AS v FROM (SELECT *, max(v) OVER (PARTITION BY config) AS top FROM config_rows) q GROUP BY config UNION ALL SELECT 0 AS config, 0e0 AS v',
    "supplied": 'SELECT l_suppkey AS region_id, CAST(k.idx AS BIGINT) AS idx, CASE k.idx WHEN 0 THEN l_quantity WHEN 1 THEN l_discount ELSE l_tax END AS x, l_extendedprice AS y FROM lineitem CROSS JOIN (SELECT unnest([0, 1, 2]) AS idx) k',
    "sweeps": 'SELECT CAST(user_id AS VARCHAR) AS region_id, event_type AS setting, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS sweep, CAST(value AS DOUBLE) AS elbo FROM events',
    "steps1": 'SELECT *, elbo - lag(elbo) OVER (PARTITION BY region_id, setting ORDER BY sweep) AS step FROM sweeps',
    "steps2": 'SELECT *, lag(step) OVER (PARTITION BY region_id, setting ORDER BY sweep) AS before FROM steps1',
    "member3": 'SELECT component_id, idx FROM ranked WHERE rank = 1 OR cum - alpha < 0.3e0',
    "best3": 'SELECT component_id, idx FROM (SELECT m.component_id, m.idx, row_number() OVER (PARTITION BY m.component_id ORDER BY p.pip DESC, m.idx) AS place FROM member3 m JOIN pips p USING (idx)) q WHERE place = 1',
}

_H = "SELECT a, b, 0e0 AS h0, ln(1e-4) + s1 AS h1, ln(1e-4) + s2 AS h2, 2 * ln(1e-4) + s1 + s2 + ln(greatest(1 - exp(s12 - s1 - s2), 1e-300)) AS h3, ln(5e-6) + s12 AS h4 FROM pair_sum"
_HE = f"SELECT a, b, exp(h0 - m) AS e0, exp(h1 - m) AS e1, exp(h2 - m) AS e2, exp(h3 - m) AS e3, exp(h4 - m) AS e4 FROM (SELECT *, greatest(h0, h1, h2, h3, h4) AS m FROM ({_H}) h) g"

#: Query by name: the step names it needs come from the text itself.
SELECTS = {
    "suff_stat_gram": 'SELECT a.idx AS i, b.idx AS j, round(covar_samp(a.x, b.x) * (count(*) - 1), 6) AS xtx FROM x0 a JOIN x0 b ON a.vec_id = b.vec_id WHERE a.idx <= b.idx GROUP BY a.idx, b.idx',
    "suff_stat_xty": "SELECT component_id, idx, round(cxy * (n - 1), 6) AS xty, round(vy * (n - 1), 6) AS yty, CAST(n AS BIGINT) AS n FROM moments",
    "marginal_regression": "SELECT component_id, idx, round(bhat, 6) AS bhat, round(shat, 6) AS shat FROM marginal",
    "marginal_z_multi_outcome": "SELECT component_id, idx, round(z, 6) AS z FROM z",
    "uncentered_bhat_shat": "SELECT component_id, idx, round(sxy / sxx, 6) AS bhat, round(sqrt(greatest((syy - sxy * sxy / sxx) / (n - 1), 1e-64) / sxx), 6) AS shat FROM moments WHERE sxx > 0",
    "wald_adjust": "SELECT component_id, idx, round(zt, 6) AS z_adjusted, round(sqrt(n - 1) * zt, 5) AS xty FROM z",
    "ser_fixed_v": "SELECT component_id, idx, round(lbf, 6) AS lbf, round(alpha, 6) AS alpha, round(mu, 6) AS mu, round(lbf_total, 6) AS lbf_total FROM fit",
    "ser_null_weight": 'SELECT component_id, idx, round((0.8e0 / p + 1.4901161193847656e-8) * exp(lbf - top) / (sum((0.8e0 / p + 1.4901161193847656e-8) * exp(lbf - top)) OVER (PARTITION BY component_id) + (0.2e0 + 1.4901161193847656e-8) * exp(-top)), 6) AS alpha FROM bf JOIN total USING (component_id)',
    "ser_prior_weights": 'SELECT component_id, idx, round((w / ws + 1.4901161193847656e-8) * exp(lbf - top) / sum((w / ws + 1.4901161193847656e-8) * exp(lbf - top)) OVER (PARTITION BY component_id), 6) AS alpha FROM (SELECT b.*, t.top, CAST(1 + b.idx % 3 AS DOUBLE) AS w, sum(CAST(1 + b.idx % 3 AS DOUBLE)) OVER (PARTITION BY b.component_id) AS ws FROM bf b JOIN total t USING (component_id)) q',
    "ser_mixture_fixed": "SELECT component_id, idx, round(ln(0.5e0 * exp(-0.5e0 * ln(1 + (n - 1) * 0.05e0) + 0.5e0 * zt * zt * 0.05e0 / (0.05e0 + 1 / (n - 1)) - lbf) + 0.5e0) + lbf, 6) AS lbf FROM bf",
    "ser_em_one_step": "SELECT component_id, round(sum(alpha * (post_var + mu * mu)), 8) AS v_next FROM fit GROUP BY component_id",
    "pip_product": "SELECT idx, round(pip, 6) AS pip FROM pips",
    "posterior_mean_sd": "SELECT idx, round(sum(alpha * mu), 6) AS mean, round(sqrt(greatest(sum(alpha * (post_var + mu * mu) - alpha * mu * alpha * mu), 0e0)), 6) AS sd FROM fit GROUP BY idx",
    "coef_intercept": "SELECT component_id, round(max(my) - sum(alpha * mu * sqrt(vy) / sqrt(vx) * mx), 6) AS intercept, round(sum(alpha * mu * sqrt(vy) / sqrt(vx)), 6) AS sum_coef FROM fit GROUP BY component_id",
    "predict_response": "SELECT vec_id, round(sum(alpha * mu * sqrt(vy) / sqrt(vx) * (x - mx)) + max(my), 6) AS fitted FROM x JOIN fit USING (idx) WHERE component_id = 0 GROUP BY vec_id",
    "credible_sets": "SELECT component_id, idx, CAST(rank AS BIGINT) AS rank, round(alpha, 6) AS alpha FROM member",
    "cs_attainable": 'SELECT q.component_id, count(*) AS size, round(sum(alpha), 6) AS mass FROM (SELECT *, max(alpha) OVER (PARTITION BY idx) AS best FROM fit) q JOIN (SELECT component_id, -sum(CASE WHEN alpha > 0 THEN alpha * ln(alpha) ELSE 0e0 END) AS h FROM fit GROUP BY component_id) e ON e.component_id = q.component_id WHERE alpha = best AND h < ln(100e0) GROUP BY q.component_id HAVING sum(alpha) > 0.3e0',
    "cs_purity": "SELECT component_id, count(*) AS pairs, round(min(abs(r)), 6) AS min_abs_corr, round(avg(abs(r)), 6) AS mean_abs_corr, round(median(abs(r)), 6) AS median_abs_corr FROM member a JOIN member b USING (component_id) JOIN ld ON ld.i = a.idx AND ld.j = b.idx GROUP BY component_id",
    "cs_extension": "SELECT component_id, ld_both.j AS idx FROM member JOIN ld_both ON ld_both.i = member.idx WHERE abs(r) > 0.95e0 UNION SELECT component_id, idx FROM member",
    "cs_relations": "SELECT a.component_id AS a, b.component_id AS b, count(*) AS shared FROM member a JOIN member b ON a.idx = b.idx WHERE a.component_id < b.component_id GROUP BY a.component_id, b.component_id",
    "proxies": "SELECT m.component_id, m.idx AS member, l.j AS proxy, round(l.r, 6) AS r FROM member m JOIN ld_both l ON l.i = m.idx LEFT JOIN member own ON own.component_id = m.component_id AND own.idx = l.j WHERE abs(l.r) >= 0.99e0 AND own.idx IS NULL",
    "absolute_order": 'SELECT component_id, idx, CAST(row_number() OVER (PARTITION BY component_id ORDER BY abs(round(bhat, 9)) DESC, idx) AS BIGINT) AS place FROM marginal',
    "univar_order": 'SELECT component_id, idx, CAST(row_number() OVER (PARTITION BY component_id ORDER BY abs(round(sxy / sxx, 9)) DESC, idx) AS BIGINT) AS place FROM moments',
    "maf_filter": 'SELECT k.idx AS old_idx, k.new_idx, round(k.maf, 6) AS maf, CAST(count(l.j) AS BIGINT) + 1 AS row_size, round(coalesce(sum(l.r), 0e0), 4) AS row_sum FROM kept k LEFT JOIN ld_both l ON l.i = k.idx AND l.j IN (SELECT idx FROM kept) GROUP BY k.idx, k.new_idx, k.maf',
    "ld_correlation": "SELECT i, j, round(r, 6) AS r FROM ld",
    "ld_symmetry_check": 'SELECT CAST(count(*) FILTER (WHERE up <> down) AS BIGINT) AS unequal, round(max(abs(up - down)), 6) AS max_asymmetry FROM (SELECT r + CASE WHEN (i + j) % 7 = 0 THEN 0.001e0 * (i - j) ELSE 0e0 END AS up, r + CASE WHEN (i + j) % 7 = 0 THEN 0.001e0 * (j - i) ELSE 0e0 END AS down FROM ld) q',
    "ld_symmetrize": "SELECT i, j, round(avg(r), 6) AS r FROM (SELECT i, j, r + 0.001e0 * (i - j) AS r FROM ld_both UNION ALL SELECT j AS i, i AS j, r + 0.001e0 * (i - j) AS r FROM ld_both) q WHERE i < j GROUP BY i, j",
    "entropy_effective": "SELECT component_id, round(exp(-sum(CASE WHEN alpha > 0 THEN alpha * ln(alpha) ELSE 0e0 END)), 4) AS effective FROM fit GROUP BY component_id",
    "prior_influence": "SELECT component_id, idx, round(lbf - first_value(lbf) OVER (PARTITION BY component_id ORDER BY alpha DESC, idx), 6) AS delta_lbf FROM fit",
    "coloc_pairwise": f"SELECT a, b, round(e0 / (e0 + e1 + e2 + e3 + e4), 6) AS pp_h0, round(e1 / (e0 + e1 + e2 + e3 + e4), 6) AS pp_h1, round(e2 / (e0 + e1 + e2 + e3 + e4), 6) AS pp_h2, round(e3 / (e0 + e1 + e2 + e3 + e4), 6) AS pp_h3, round(e4 / (e0 + e1 + e2 + e3 + e4), 6) AS pp_h4 FROM ({_HE}) e",
    "susiex_configs": 'SELECT c.config, round(exp(c.v - m.top) / m.total, 6) AS probability FROM config_log c CROSS JOIN (SELECT max(v) AS top, sum(exp(v - (SELECT max(v) FROM config_log))) AS total FROM config_log) m',
    "compare_pips": 'SELECT CAST(count(*) AS BIGINT) AS variables, round(corr(a.pip, b.pip), 6) AS pearson, round(max(abs(a.pip - b.pip)), 6) AS max_abs_delta, round(max(CASE WHEN a.pip >= 0.1e0 OR b.pip >= 0.1e0 THEN abs(a.pip - b.pip) END), 6) AS candidate_max_abs_delta FROM pips2 a JOIN pips b USING (idx)',
    "posterior_overlap": 'SELECT a, b, round(overlap, 6) AS overlap FROM over',
    "relation_labels": "SELECT a, b, CASE WHEN da > 1 AND db > 1 THEN 'ambiguous' WHEN da > 1 THEN 'split' WHEN db > 1 THEN 'merge' ELSE 'matched' END AS label FROM (SELECT a, b, count(*) OVER (PARTITION BY a) AS da, count(*) OVER (PARTITION BY b) AS db FROM edge) d",
    "column_summary": "SELECT idx, round(min(x), 6) AS low, round(median(x), 6) AS middle, round(max(x), 6) AS high, count(*) - count(x) AS missing FROM x GROUP BY idx",
    "trend_design_products": 'SELECT label, vec_id, round(-sum(y) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS xty0 FROM y',
    "candidate_sources": "SELECT idx, max(from_cs) AS in_set, max(from_pip) AS by_pip FROM (SELECT idx, 1 AS from_cs, 0 AS from_pip FROM member UNION ALL SELECT idx, 0 AS from_cs, 1 AS from_pip FROM pips WHERE pip >= 0.1e0) c GROUP BY idx",
    "fit_alignment": 'SELECT CAST(count(*) FILTER (WHERE a.idx IS NOT NULL AND b.idx IS NOT NULL) AS BIGINT) AS shared, CAST(count(*) FILTER (WHERE a.idx IS NULL) AS BIGINT) AS omitted_narrow, CAST(count(*) FILTER (WHERE b.idx IS NULL) AS BIGINT) AS omitted_wide FROM pips2 a FULL JOIN pips b ON a.idx = b.idx',
    "unmatched_effects": "SELECT side, component_id, round(mass, 6) AS omitted_mass FROM (SELECT 'narrow' AS side, f.component_id, 0e0 AS mass FROM fit2 f WHERE f.component_id NOT IN (SELECT a FROM edge) GROUP BY f.component_id UNION ALL SELECT 'wide' AS side, f.component_id, sum(CASE WHEN f.idx >= 60 THEN f.alpha ELSE 0e0 END) AS mass FROM fit f WHERE f.component_id NOT IN (SELECT b FROM edge) GROUP BY f.component_id) q",
    "set_jaccard": 'SELECT a.component_id AS a, b.component_id AS b, CAST(count(*) AS BIGINT) AS shared, round(count(*) / ((SELECT count(*) FROM member m WHERE m.component_id = a.component_id) + (SELECT count(*) FROM member m WHERE m.component_id = b.component_id) - count(*)), 6) AS jaccard FROM member a JOIN member b ON a.idx = b.idx WHERE a.component_id < b.component_id GROUP BY a.component_id, b.component_id',
    "set_representatives": 'SELECT component_id, idx, round(alpha, 6) AS alpha FROM member WHERE rank = 1',
    "variant_rank": 'SELECT idx, round(pip, 6) AS pip, CAST(row_number() OVER (ORDER BY round(pip, 9) DESC, idx) AS BIGINT) AS place FROM pips',
    "top_candidates": 'SELECT component_id, idx, CAST(rank AS BIGINT) AS place, round(alpha, 6) AS value FROM member WHERE rank <= 3',
    "component_table": 'SELECT component_id, round(max(lbf_total), 6) AS lbf, round(max(lbf_total) / ln(10e0), 6) AS log10_bf, round(-sum(CASE WHEN alpha > 0 THEN alpha * ln(alpha) ELSE 0e0 END), 5) AS entropy, round(max(alpha), 6) AS top_alpha, arg_max(idx, alpha) AS top_idx FROM fit GROUP BY component_id',
    "stability_of_sets": 'SELECT CAST(m.component_id AS BIGINT) AS component_id, round(coalesce(max(j.jaccard), 0e0), 6) AS jaccard FROM (SELECT DISTINCT component_id FROM member2) m LEFT JOIN (SELECT a.component_id AS a, b.component_id AS b, count(*) / ((SELECT count(*) FROM member2 q WHERE q.component_id = a.component_id) + (SELECT count(*) FROM member q WHERE q.component_id = b.component_id) - count(*)) AS jaccard FROM member2 a JOIN member b ON a.idx = b.idx GROUP BY a.component_id, b.component_id) j ON j.a = m.component_id GROUP BY m.component_id',
    "evidence_ids": "SELECT 'ev_' || substr(sha256('/variants/' || CAST(idx AS VARCHAR) || '/place'), 1, 20) AS id, '/variants/' || CAST(idx AS VARCHAR) || '/place' AS pointer, CAST(row_number() OVER (ORDER BY round(pip, 9) DESC, idx) AS VARCHAR) AS value FROM pips",
    "many_region_marginals": 'SELECT region_id, idx, n, round(b, 4) AS bhat, round(b / sqrt((vy - b * c) * (n - 1) / (n - 2) / ((n - 1) * vx)), 4) AS z FROM (SELECT region_id, idx, count(*) AS n, covar_samp(x, y) / var_samp(x) AS b, covar_samp(x, y) AS c, var_samp(x) AS vx, var_samp(y) AS vy FROM supplied GROUP BY region_id, idx) q',
    "trace_steps": 'SELECT region_id, setting, count(*) AS sweeps, CAST(count(*) FILTER (WHERE sign(step) * sign(before) < 0) AS BIGINT) AS sign_changes, round(min(step), 6) AS least_step, round(median(CASE WHEN before <> 0 THEN step / before END), 6) AS ratio FROM steps2 GROUP BY region_id, setting',
    "objectives_that_fell": 'SELECT region_id, setting, CAST(count(*) FILTER (WHERE step < -0.5e0) AS BIGINT) AS falls, max(CASE WHEN step < -0.5e0 THEN sweep END) AS last_fall FROM steps1 GROUP BY region_id, setting',
    "set_correlations": 'SELECT CAST(a.component_id AS BIGINT) AS component_a, CAST(b.component_id AS BIGINT) AS component_b, a.idx AS idx_a, b.idx AS idx_b, round(CASE WHEN a.idx = b.idx THEN 1e0 ELSE l.r END, 6) AS r FROM best3 a JOIN best3 b ON a.component_id < b.component_id LEFT JOIN ld_both l ON l.i = a.idx AND l.j = b.idx',
    "input_quality": 'SELECT count(*) AS variables, CAST(count(*) FILTER (WHERE idx % 9 = 0) AS BIGINT) AS missing_z, CAST(0 AS BIGINT) AS infinite_z, (SELECT count(*) FROM (SELECT DISTINCT i FROM ld_both) d) AS rows, CAST(0 AS BIGINT) AS bad_rows, CAST(0 AS BIGINT) AS unequal, true AS usable FROM z WHERE component_id = 0',
    "proxies_of_variables": 'SELECT i, j, round(r, 6) AS r FROM ld WHERE abs(r) >= 0.9e0',
}


def _steps(text: str) -> list[str]:
    """Steps that a text names, each after those it needs itself."""
    out: list[str] = []

    def need(t: str) -> None:
        for name in re.findall(r"(?:FROM|JOIN)\s+(\w+)", t):
            if name in STEPS and name not in out:
                need(STEPS[name])
                if name not in out:
                    out.append(name)

    need(text)
    return out


def sql(name: str) -> str:
    steps = ", ".join(f"{s} AS ({STEPS[s]})" for s in _steps(SELECTS[name]))
    return f"WITH {steps} {SELECTS[name]}"


ORACLE_SQL = {name: sql(name) for name in SELECTS}
