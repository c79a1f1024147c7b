import duckdb
import pytest

from locuslake.plans import catalogue

DIR = "/root/testdata/sf0.001"


#: One query or two of each operator module; the rest differ by a column or a threshold.
ORACLES = ["suff_stat_gram", "many_region_marginals", "ser_null_weight", "coef_intercept", "predict_response", "credible_sets", "cs_attainable", "cs_purity", "cs_extension", "proxies", "maf_filter", "ld_symmetry_check", "coloc_pairwise", "susiex_configs", "compare_pips", "relation_labels", "stability_of_sets", "trace_steps", "input_quality", "set_correlations", "evidence_ids"]
FITTED = ["susie_rss_ridge", "susie_inverse_gamma", "susie_automatic", "trend_filter", "sensitivity_runs", "convergence_assessed", "ld_diagnosed", "many_region_fits"]


@pytest.mark.parametrize("name", ORACLES)
def test_spark_equals_duckdb(spark, name):
    con = duckdb.connect()
    for table in ("embeddings", "lineitem", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    want = con.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = catalogue.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


def test_flagship_finds_the_simulated_effects(spark):
    rows = catalogue.QUERIES["flagship_finemap"](spark, DIR).collect()
    assert len(rows) == 160
    for region in ("0", "1"):
        top = {r.idx for r in rows if r.region_id == region and r.pip > 0.4}
        assert 23 in top and (7 in top or 71 in top)


@pytest.mark.parametrize("name", FITTED)
def test_fitted_queries_give_rows(spark, name):
    out = catalogue.QUERIES[name](spark, DIR)
    assert len(set(out.columns)) == len(out.columns) and out.count() > 0


def _both(spark, name, folder, *tables):
    con = duckdb.connect()
    for table in tables:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = catalogue.QUERIES[name](spark, str(folder)).select(*columns).collect()
    return sorted(map(str, map(tuple, got))), sorted(map(str, want.fetchall()))


def test_sets_of_one_variable_have_no_purity_row(spark, tmp_path):
    copies = f"SELECT vec_id + 500 * k AS vec_id, e.* EXCLUDE (vec_id) FROM range(30) r(k), '{DIR}/embeddings.parquet' e"
    duckdb.execute(f"COPY ({copies}) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    alone = {r.component_id for r in catalogue.QUERIES["credible_sets"](spark, str(tmp_path)).groupBy("component_id").count().where("count = 1").collect()}
    got, want = _both(spark, "cs_purity", tmp_path, "embeddings")
    assert alone and got == want
