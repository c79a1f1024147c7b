"""Tables written once, in the folder that all executors share, for several queries to read."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may already be gone at exit
        pass


def written(df: DataFrame) -> DataFrame:
    """The table, read back from ``spark.checkpoint.dir``; a private folder only where that is unset on a local master."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="locuslake-")
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(_delete, spark, root)
    path = f"{root.rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)
