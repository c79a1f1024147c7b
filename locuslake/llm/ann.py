"""Approximate nearest neighbours by collision counting over sorted projections.

Largest inner product is nearest distance once every vector gets one more component that
brings it to the largest norm. Each block of vectors is indexed by the ranks in sorted arrays
of single random projections. A query opens a window around its own projection in every
array; a vector collides in an array if it lies in that array's window. Virtual rehashing
widens all windows of a query by steps of one factor until enough vectors collide in a fixed
share of the arrays; all that do are verified by exact inner products. A few vectors of the
block, whose collisions are counted exactly, say at which step the windows are likely to be
wide enough, so that narrower ones needn't be counted over the whole block. The stated
queries meet all blocks, in blocks of queries; every vector is indexed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SCHEMA = "query_id long, rank int, vec_id long, score double"


class SortedProjections:
    """Ranks of a block's vectors, of norms up to 1, in the sorted arrays of their projections."""

    def __init__(self, vectors: np.ndarray, projections: int, seed: int = 5, sample: int = 192):
        n, d = vectors.shape
        self.axes = np.random.default_rng([seed, d]).normal(size=(d + 1, projections))
        rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", vectors, vectors)))
        values = (np.concatenate([vectors, rest[:, None]], 1) @ self.axes).T
        self.sample = np.ascontiguousarray(values[:, :: max(1, n // sample)])
        order = np.argsort(values, axis=1, kind="stable")
        self.sorted = np.take_along_axis(values, order, 1)
        self.ranks = np.empty(values.shape, np.uint16 if n < 1 << 16 else np.uint32)
        np.put_along_axis(self.ranks, order, np.arange(n, dtype=self.ranks.dtype)[None, :], 1)

    def _windows(self, centres: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First rank and number of ranks in the windows of queries, by query and array."""
        low = np.stack([np.searchsorted(s, c - width) for s, c in zip(self.sorted, centres.T)], 1)
        high = np.stack([np.searchsorted(s, c + width, side="right") for s, c in zip(self.sorted, centres.T)], 1)
        return low, high - low

    def candidates(self, queries: np.ndarray, *, share: float, enough: int, start: float, factor: float):
        """For each query, of length 1, the places of the vectors to verify, which are at least ``enough``."""
        m, n = self.ranks.shape
        if n <= enough:
            yield from (np.arange(n) for _ in queries)
            return
        centres = queries @ self.axes[:-1]
        need = max(1, int(np.ceil(share * m)))
        steps = np.empty(len(queries))
        part = min(self.sample.shape[1] - 1, int(np.ceil(self.sample.shape[1] * enough / n)))
        for i, c in enumerate(centres):
            # The width at which a vector of the sample collides often enough, and the step by which enough of them do.
            critical = np.partition(np.abs(self.sample - c[:, None]), need - 1, axis=0)[need - 1]
            wide = max(float(np.partition(critical, part)[part]), start)
            steps[i] = np.ceil(np.log(wide / start) / np.log(factor))
        low, span = self._windows(centres, start * factor**steps)
        kind = self.ranks.dtype.type
        shifted, inside = np.empty_like(self.ranks), np.empty(self.ranks.shape, bool)
        for i, c in enumerate(centres):
            lo, size = low[i], span[i]
            while True:
                full = size > np.iinfo(kind).max  # such a window holds all ranks
                np.subtract(self.ranks, lo[:, None].astype(kind), out=shifted)
                np.less(shifted, np.minimum(size, np.iinfo(kind).max).astype(kind)[:, None], out=inside)
                if full.any():
                    inside[full] = True
                count = np.add.reduce(inside, axis=0, dtype=np.uint16)
                found = np.flatnonzero(count >= need)
                if len(found) >= enough or (size >= n).all():
                    break
                steps[i] += 1
                lo, size = (x[0] for x in self._windows(c[None], np.array([start * factor ** steps[i]])))
            yield found


def _nearest(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(ids))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1, also where squares of components would over- or underflow."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _block(k: int, projections: int, share: float, verified: float, start: float, factor: float):
    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if queries.num_rows and data.num_rows:
            unpack = lambda t, v="v": np.asarray(t.column(v).combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(t.num_rows, -1)
            ids, vectors = data.column("vec_id").to_numpy(), unpack(data)
            # The largest norm is known as a largest component and a norm in its units.
            index = SortedProjections(vectors / data.column("peak")[0].as_py() / data.column("norm")[0].as_py(), projections)
            asked = unpack(queries, "v_")
            places = index.candidates(_unit(asked), share=share, enough=min(len(ids), k + 1 + int(np.ceil(verified * len(ids)))), start=start, factor=factor)
            for q, v, found in zip(queries.column("vec_id_").to_pylist(), asked, places):
                found = found[ids[found] != q]
                with np.errstate(over="ignore", invalid="ignore"):
                    scores = np.einsum("ij,j->i", vectors[found], v)
                best = _nearest(ids[found], np.where(np.isnan(scores), -np.inf, scores), k)
                out[0].append(np.full(len(best), q))
                out[1].append(ids[found][best])
                out[2].append(scores[best])
        columns = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"query_id": pa.array(columns[0].astype(np.int64)), "vec_id": pa.array(columns[1].astype(np.int64)), "score": pa.array(columns[2].astype(float))})

    return run


def search(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", query_every: int = 20, k: int = 20,
    projections: int = 128, share: float = 0.8, verified: float = 0.25, start: float = 0.02, factor: float = 1.05, block: int = 6144, query_block: int = 8192,
) -> DataFrame:
    """The ``k`` nearest found of each query, nearest first, ties to the smaller id (schema ``SCHEMA``).

    Queries are the vectors whose id is divisible by ``query_every``; a query's own id is no
    candidate for it. Vectors that are null, zero, or hold null or non-finite components, or
    have no id, take no part; vectors of different lengths don't meet. Of rows that share an
    id, the one of the least vector counts. An empty table gives no rows; other columns are
    not read. Where a block holds fewer vectors than would be verified, all of them are.
    Components of any finite size take part; where an inner product overflows, its value is
    infinite, and one that isn't a number comes last.
    """
    x = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    x = x.where("vec_id IS NOT NULL AND v IS NOT NULL AND forall(v, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('Infinity')) AND exists(v, e -> e <> 0)")
    x = x.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    sizes = x.groupBy("dim").agg(F.max(F.array_max(F.transform("v", F.abs))).alias("peak"), F.count("*").alias("n"))  # a row for each length
    x = x.join(F.broadcast(sizes), "dim")
    norms = x.groupBy("dim").agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + (e / F.col("peak")) * (e / F.col("peak"))))).alias("norm"))
    x = x.join(F.broadcast(norms), "dim").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("query_blocks", F.ceil(F.col("n") / query_every / query_block).cast("int"))
    data = x.alias("data").select("dim", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("d"), F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("q"), "vec_id", "v", "peak", "norm")
    queries = x.where(F.col("vec_id") % query_every == 0).select("dim", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("d"), F.pmod(F.xxhash64("vec_id", F.lit(1)), "query_blocks").cast("int").alias("q"), "vec_id", "v")
    keys = ["dim", "d", "q"]
    queries = queries.select(*[F.col(c).alias(f"{c}_") for c in keys], F.col("vec_id").alias("vec_id_"), F.col("v").alias("v_"))
    found = queries.groupBy(*[f"{c}_" for c in keys]).cogroup(data.groupBy(*keys)).applyInArrow(_block(k, projections, share, verified, start, factor), "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
