"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from locuslake.plans import catalogue

HEADLINE = ["flagship_finemap", "susie_rss_optim", "susie_suff_stat", "credible_sets_fitted", "sensitivity_runs", "coloc_fitted", "suff_stat_gram", "marginal_z_multi_outcome", "ser_fixed_v", "credible_sets", "cs_purity", "ld_correlation", "coloc_pairwise", "posterior_overlap", "pip_product", "predict_response", "susie_individual", "sensitivity_comparison", "ld_diagnosed", "convergence_assessed", "many_region_marginals", "many_region_fits"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES["suff_stat_xty"](spark, sf_dir).count()  # starts the executors and their Python workers
    times = {}
    for name in HEADLINE:
        began = time.time()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
