"""Gene tracks from GTF files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bare_chromosome(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\Achr", "")


def read_gene_track(spark: SparkSession, path: str, *, chromosome: str, start: int, end: int, transcript_ids: list[str] | None = None) -> DataFrame:
    """Transcripts that overlap a 1-based closed interval; genes only where no transcript does.

    Columns: feature, gene_id, gene_name, transcript_id, chromosome (without "chr"), left,
    right, strand. Comments and lines without nine fields are skipped; an interval that ends
    before it starts raises.
    """
    if start > end:
        raise ValueError("the interval ends before it starts")
    lines = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f")).where(F.size("f") == 9)
    field = lambda k: F.get("f", F.lit(k))
    rows = lines.select(field(2).alias("feature"), bare_chromosome(field(0)).alias("chromosome"), field(3).try_cast("long").alias("left"), field(4).try_cast("long").alias("right"), field(6).alias("strand"), field(8).alias("attributes"))
    rows = rows.where(F.col("feature").isin("gene", "transcript") & (F.col("chromosome") == bare_chromosome(F.lit(chromosome))) & (F.col("left") <= end) & (F.col("right") >= start))
    attribute = lambda k: F.nullif(F.regexp_extract("attributes", rf'(?:\A|;)\s*{k} "([^"]*)"', 1), F.lit(""))
    rows = rows.select("feature", *[attribute(k).alias(k) for k in ("gene_id", "gene_name", "transcript_id")], "chromosome", "left", "right", "strand")
    transcripts = rows.where("feature = 'transcript'")
    if transcript_ids is not None:
        transcripts = transcripts.where(F.col("transcript_id").isin(*transcript_ids))
    none = transcripts.agg((F.count("*") == 0).alias("none"))
    return transcripts.unionByName(rows.where("feature = 'gene'").join(F.broadcast(none), F.col("none")).drop("none"))
