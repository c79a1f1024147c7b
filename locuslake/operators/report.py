"""Flags and a page of what a fit's tables say. The page holds a few rows a region, so it is made on the driver from as many."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import written

FLAGS = "region_id string, flag string, raised boolean, detail string"


def flags(fits: DataFrame, sets: DataFrame, quality: DataFrame | None = None, diagnostics: DataFrame | None = None, stability: DataFrame | None = None) -> DataFrame:
    """(region_id, flag, raised, detail): failed or unconverged fits, no sets, impure sets, missing scores, flipped alleles, sets that other settings lose. A check without its table has raised null."""
    regions = fits.select("region_id").distinct()
    base = fits.where("setting = 'baseline'")
    rows = [base.select("region_id", F.lit("fit_failed").alias("flag"), (F.col("status") != "fitted").alias("raised"), F.col("error").alias("detail")), base.where("status = 'fitted'").select("region_id", F.lit("not_converged").alias("flag"), (~F.col("converged")).alias("raised"), F.col("stop_reason").alias("detail"))]
    found = sets.groupBy("region_id").agg(F.count("*").alias("n"), F.min("min_abs_corr").alias("least"))
    with_sets = regions.join(found, "region_id", "left")
    rows.append(with_sets.select("region_id", F.lit("no_credible_set").alias("flag"), F.col("n").isNull().alias("raised"), F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" sets")).alias("detail")))
    rows.append(with_sets.select("region_id", F.lit("impure_set").alias("flag"), (F.col("least") < 0.8).alias("raised"), F.col("least").cast("string").alias("detail")))

    def checked(name: str, table: DataFrame | None, raised, detail) -> None:
        if table is None:
            rows.append(regions.select("region_id", F.lit(name).alias("flag"), F.lit(None).cast("boolean").alias("raised"), F.lit("not checked").alias("detail")))
        else:
            rows.append(table.groupBy("region_id").agg(raised.alias("raised"), detail.cast("string").alias("detail")).select("region_id", F.lit(name).alias("flag"), "raised", "detail"))

    checked("missing_scores", quality, F.max("missing_z") > 0, F.max("missing_z"))
    checked("flipped_alleles", diagnostics, F.count_if(F.col("status") == "flagged") > 0, F.count_if(F.col("status") == "flagged"))
    checked("lost_signal", stability, F.count_if(F.col("fate") == "lost") > 0, F.count_if(F.col("fate") == "lost"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def summary_text(flagged: DataFrame) -> DataFrame:
    """(region_id, text): a line for each region's raised flags and skipped checks."""
    raised = F.array_sort(F.collect_list(F.when(F.col("raised"), F.concat_ws(" ", "flag", F.concat(F.lit("("), "detail", F.lit(")"))))))
    skipped = F.array_sort(F.collect_list(F.when(F.col("raised").isNull(), F.col("flag"))))
    rows = flagged.groupBy("region_id").agg(raised.alias("raised"), skipped.alias("skipped"))
    some = F.when(F.size("raised") > 0, F.concat(F.lit("raised: "), F.array_join("raised", "; "))).otherwise(F.lit("nothing raised"))
    return rows.select("region_id", F.concat(some, F.when(F.size("skipped") > 0, F.concat(F.lit("; not checked: "), F.array_join("skipped", ", "))).otherwise(F.lit(""))).alias("text"))


def write_report(spark: SparkSession, tables: dict[str, DataFrame], path: str, title: str = "Fine-mapping", rows: int = 200) -> None:
    """One HTML page, without scripts or outside files, with the first ``rows`` rows of each table; whole tables belong in ``export_tables``."""
    parts = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        kept = written(df)
        first = kept.limit(rows).collect()
        parts.append(f"<h2>{html.escape(name)}</h2><p>{len(first)} of {kept.count()} rows</p><table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in df.columns) + "</tr>")
        parts += ["<tr>" + "".join(f"<td>{'' if v is None else html.escape(str(v))}</td>" for v in r) + "</tr>" for r in first]
        parts.append("</table>")
    page = "".join(parts) + "</body></html>"
    spark.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").text(path)
