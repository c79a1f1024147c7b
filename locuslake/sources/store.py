"""Analyses as folders of Parquet tables with a manifest of schemas, row counts and content hashes; CSV tables; evidence facts."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

VERSION = 1
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_]*")


def content_hash(df: DataFrame) -> str:
    """Hash of a table's rows, whatever their order: sums of halves of each row's SHA-256, repeats counted."""
    if not df.columns:
        return "0"
    cell = [F.coalesce(F.to_json(F.struct(F.col(c))), F.lit("")) for c in sorted(df.columns)]
    digest = F.sha2(F.concat_ws("\x1f", *cell), 256)
    row = df.select(digest.alias("_d")).agg(*[F.sum(F.conv(F.substring("_d", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{k}") for k in range(8)], F.count("*").alias("n")).first()
    return "-".join(str(row[f"p{k}"] or 0) for k in range(8)) + f"-{row.n}"


def save_analysis(tables: dict[str, DataFrame], path: str, provenance: dict | None = None) -> None:
    """Writes each table once and a manifest last, so a folder without one isn't an analysis."""
    if not tables or any(not _NAME.fullmatch(n) for n in tables):
        raise ValueError("tables need names of letters, digits and underscores")
    spark = next(iter(tables.values())).sparkSession
    entries = {}
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        back = spark.read.schema(df.schema).parquet(f"{path}/{name}")
        entries[name] = {"schema": json.loads(df.schema.json()), "rows": back.count(), "hash": content_hash(back)}
    manifest = json.dumps({"version": VERSION, "tables": entries, "provenance": provenance or {}}, sort_keys=True)
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/_manifest")


def load_analysis(spark: SparkSession, path: str, verify: bool = True) -> tuple[dict[str, DataFrame], dict]:
    """Tables and provenance; a table that differs from the manifest raises."""
    manifest = json.loads(spark.read.text(f"{path}/_manifest").first().value)
    if manifest.get("version") != VERSION:
        raise ValueError(f"version {manifest.get('version')} of the manifest isn't known")
    out = {}
    for name, entry in manifest["tables"].items():
        df = spark.read.schema(StructType.fromJson(entry["schema"])).parquet(f"{path}/{name}")
        if verify and (df.count() != entry["rows"] or content_hash(df) != entry["hash"]):
            raise ValueError(f"table {name} isn't what was saved")
        out[name] = df
    return out, manifest["provenance"]


def cached(build: Callable[[], DataFrame], inputs: list[DataFrame], options: object, root: str) -> DataFrame:
    """A table kept under the hash of its inputs' contents and its options' text, built only where it isn't there yet."""
    spark = inputs[0].sparkSession
    text = json.dumps([*[content_hash(df) for df in inputs], repr(options)])
    path = f"{root.rstrip('/')}/{hashlib.sha256(text.encode()).hexdigest()}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = (ArrayType, MapType, StructType)
    return df.select(*[F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields])


def export_tables(tables: dict[str, DataFrame], path: str) -> list[str]:
    """Each table as CSV with a header; the paths."""
    paths = []
    for name, df in tables.items():
        flat(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/{name}.csv")
        paths.append(f"{path}/{name}.csv")
    return paths


def evidence_facts(tables: dict[str, DataFrame], key_columns: dict[str, list[str]]) -> DataFrame:
    """(id, table, pointer, value) for each cell of the tables: the pointer names table, keys and column, the id is "ev_" and the start of its SHA-256.

    ``key_columns`` names each table's key. Rows come from the tables' own executors; nothing
    is collected. Null cells are no facts.
    """
    out = None
    for name, df in tables.items():
        keys = key_columns[name]
        text = flat(df)
        escaped = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "~", "~0"), "/", "~1")
        prefix = F.concat(F.lit(f"/{name}"), *[F.concat(F.lit("/"), escaped(F.col(k))) for k in keys])
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in text.columns if c not in keys])
        rows = text.select(F.lit(name).alias("table"), prefix.alias("prefix"), F.explode(cells).alias("c")).where("c.value IS NOT NULL").select("table", F.concat("prefix", F.lit("/"), "c.column").alias("pointer"), "c.value")
        out = rows if out is None else out.unionByName(rows)
    return out.select(F.concat(F.lit("ev_"), F.substring(F.sha2("pointer", 256), 1, 20)).alias("id"), "table", "pointer", "value")
