"""Helpers shared by the training-data operators: scratch tables, words, hashes.

Words are maximal runs of bytes other than space and \\t..\\r, which is what
``bytes.split`` yields on UTF-8 text; case and punctuation are left alone.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a private one only where none is set on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = "file://" + tempfile.mkdtemp(prefix="locuslake-")
    spark.conf.set("spark.checkpoint.dir", root)
    atexit.register(_delete, spark, root)
    return root


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may already be gone at exit
        pass


class Scratch:
    """Tables written to the shared folder to cut lineage; they survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/scratch-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_fold(column, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves ``remainder``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % modulus == remainder


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table doesn't have, whatever the case of its own."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        n = f"_{name}"
        while any(c.startswith(n) for c in taken):
            n = f"_{n}"
        out.append(n)
    return out


def let(value, body):
    """``body`` of a column expression that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_bytes(column: pa.Array) -> list:
    """A string column as UTF-8 bytes (None stays None), without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


class WordHashes(dict):
    """64-bit hash by word, filled as words are met and emptied when it holds ``limit`` of them."""

    def __init__(self, seed: int = 0, limit: int = 1_000_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Rolling:
    """Hashes of all runs of n words, modulo 2**64, from one cumulative sum."""

    def __init__(self):
        self.down = np.ones(1, np.uint64)
        self.up = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 4096)
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _INVERSE)]), dtype=np.uint64)

    def prefix(self, hashes: np.ndarray) -> np.ndarray:
        self._grow(len(hashes) + 1)
        out = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.down[: len(hashes)], out=out[1:])
        return out

    def runs(self, prefix: np.ndarray, start: np.ndarray | slice, length) -> np.ndarray:
        """Hash of words start .. start+length, the same wherever the run stands."""
        if isinstance(start, slice):
            n = len(prefix) - length
            return mix((prefix[length:] - prefix[:n]) * self.up[:n])
        return mix((prefix[start + length] - prefix[start]) * self.up[start])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)
