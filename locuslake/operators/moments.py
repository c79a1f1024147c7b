"""Cross products of many regions from samples, as blocks that partitions sum; no row per pair of variables and sample."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOMENTS = "region_id string, i int, n double, mean double, xtx array<double>, r array<double>, xty array<double>, y_mean array<double>, yty array<double>"
_PART = "region_id string, first int, n double, mean binary, squares binary, block binary, y_mean binary, xty binary, yty binary"


class _Sums:
    """Count, means and centred cross products of a region's samples so far."""

    def __init__(self, p: int, outcomes: int):
        self.n, self.mean, self.y_mean = 0, np.zeros(p), np.zeros(outcomes)
        self.xx, self.xy, self.yy = np.zeros((p, p)), np.zeros((p, outcomes)), np.zeros(outcomes)

    def add(self, X: np.ndarray, Y: np.ndarray) -> None:
        n, mx, my = len(X), X.mean(0), Y.mean(0)
        a, b = X - mx, Y - my
        dx, dy = mx - self.mean, my - self.y_mean
        k = self.n * n / (self.n + n)
        self.xx += a.T @ a + k * np.outer(dx, dx)
        self.xy += a.T @ b + k * np.outer(dx, dy)
        self.yy += (b * b).sum(0) + k * dy * dy
        self.mean += dx * n / (self.n + n)
        self.y_mean += dy * n / (self.n + n)
        self.n += n


class _Many:
    """``_Sums`` of many regions of one shape at once, each at a place of stacked arrays; rows of many regions take no loop."""

    def __init__(self, p: int, outcomes: int):
        self.shape = p, outcomes
        self.place: dict[str, int] = {}
        self.n = np.zeros(0)
        self.mean, self.y_mean, self.xx, self.xy, self.yy = np.zeros((0, p)), np.zeros((0, outcomes)), np.zeros((0, p, p)), np.zeros((0, p, outcomes)), np.zeros((0, outcomes))

    def _places(self, regions: list[str]) -> np.ndarray:
        at = np.array([self.place.setdefault(r, len(self.place)) for r in regions], np.int64)
        if (more := len(self.place) - len(self.n)) > 0:
            more = max(more, len(self.n))
            for k in ("n", "mean", "y_mean", "xx", "xy", "yy"):
                x = getattr(self, k)
                setattr(self, k, np.concatenate([x, np.zeros((more, *x.shape[1:]))]))
        return at

    def merge(self, regions: list[str], n, mean, y_mean, xx, xy, yy) -> None:
        """Adds the sums of different regions."""
        at = self._places(regions)
        total = self.n[at] + n
        dx, dy, k, share = mean - self.mean[at], y_mean - self.y_mean[at], self.n[at] * n / total, (n / total)[:, None]
        self.xx[at] += xx + k[:, None, None] * dx[:, :, None] * dx[:, None, :]
        self.xy[at] += xy + k[:, None, None] * dx[:, :, None] * dy[:, None, :]
        self.yy[at] += yy + k[:, None] * dy * dy
        self.mean[at] += dx * share
        self.y_mean[at] += dy * share
        self.n[at] = total

    def add(self, regions: list[str], starts: np.ndarray, X: np.ndarray, Y: np.ndarray) -> None:
        """Adds samples sorted by region; those of a region begin at its start."""
        n = np.diff(np.append(starts, len(X)))
        owner = np.repeat(np.arange(len(n)), n)
        sums = lambda x: np.add.reduceat(x, starts)
        mean, y_mean = sums(X) / n[:, None], sums(Y) / n[:, None]
        a, b = X - mean[owner], Y - y_mean[owner]
        self.merge(regions, n.astype(float), mean, y_mean, sums(a[:, :, None] * a[:, None, :]), sums(a[:, :, None] * b[:, None, :]), sums(b * b))


#: Groups for each shuffle partition that narrow regions are merged in.
BUCKETS = 64

#: Regions of at most so many matrix entries are summed together.
NARROW = 256


def _partial(block: int, limit: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Sums] = {}
        many: dict[tuple[int, int], _Many] = {}
        names, types = [x.split()[0] for x in _PART.split(", ")], [pa.string(), pa.int32(), pa.float64()] + [pa.binary()] * 6

        def rows() -> pa.RecordBatch:
            out = []
            for region, s in held.items():
                for first in range(0, len(s.mean), block):
                    own = slice(first, first + block)
                    out.append((region, first, float(s.n), s.mean.tobytes(), np.diag(s.xx).tobytes(), s.xx[own].tobytes(), s.y_mean.tobytes(), s.xy[own].tobytes(), s.yy.tobytes()))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        def rows_of_many() -> Iterator[pa.RecordBatch]:
            for s in many.values():
                regions, p = list(s.place), s.shape[0]
                for low in range(0, len(regions), 10_000):
                    own = slice(low, min(low + 10_000, len(regions)))
                    for first in range(0, p, block):
                        cut = slice(first, first + block)
                        parts = (s.mean[own], np.diagonal(s.xx[own], axis1=1, axis2=2), s.xx[own, cut], s.y_mean[own], s.xy[own, cut], s.yy[own])
                        columns = [pa.array([x.tobytes() for x in np.ascontiguousarray(v)], pa.binary()) for v in parts]
                        yield pa.RecordBatch.from_arrays([pa.array(regions[own], pa.string()), pa.array(np.full(own.stop - low, first, np.int32)), pa.array(s.n[own]), *columns], names=names)
            many.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("region_id").dictionary_encode()
            number = coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(number, kind="stable")
            sizes = batch.column("x").value_lengths().to_numpy(zero_copy_only=False), batch.column("y").value_lengths().to_numpy(zero_copy_only=False)
            sorted_rows, number, regions = batch.take(pa.array(order)), number[order], coded.dictionary.to_pylist()
            starts = np.concatenate([[0], np.nonzero(np.diff(number))[0] + 1])
            names_of = [regions[k] for k in number[starts]]
            lengths = np.stack(sizes)[:, order]
            for p, q in {(int(p), int(q)) for p, q in lengths[:, starts].T}:
                mine = [k for k in range(len(starts)) if lengths[0, starts[k]] == p and lengths[1, starts[k]] == q]
                whole = len(mine) == len(starts)
                use = sorted_rows if whole else sorted_rows.take(pa.array(np.concatenate([np.arange(starts[k], starts[k + 1] if k + 1 < len(starts) else len(order)) for k in mine])))
                X, Y = (use.column(c).flatten().to_numpy(zero_copy_only=False).reshape(use.num_rows, -1) for c in ("x", "y"))
                own_names = names_of if whole else [names_of[k] for k in mine]
                own_sizes = np.diff(np.append(starts, len(order)))[mine]
                own_starts = np.cumsum(own_sizes) - own_sizes
                if p * p <= NARROW:
                    if sum(len(m.n) * m.shape[0] ** 2 for m in many.values()) > limit:
                        yield from rows_of_many()
                    many.setdefault((p, q), _Many(p, q)).add(own_names, own_starts, X, Y)
                    continue
                for region, start, size in zip(own_names, own_starts, own_sizes):
                    if region not in held:
                        if sum(h.xx.size for h in held.values()) > limit:
                            yield rows()
                        held[region] = _Sums(p, q)
                    held[region].add(X[start : start + size], Y[start : start + size])
        if held:
            yield rows()
        yield from rows_of_many()

    return run


def _merged(group: pa.Table) -> pa.Table:
    """Rows of one block of a region's matrix, from the parts of all partitions."""
    first = group.column("first")[0].as_py()
    n, mean = 0.0, 0.0
    parts = group.to_pylist()
    get = lambda x, k: np.frombuffer(x[k])
    p = len(get(parts[0], "mean"))
    mean, squares, y_mean, yty = np.zeros(p), np.zeros(p), 0.0, 0.0
    block, xty = 0.0, 0.0
    for x in parts:
        m, mx, my = x["n"], get(x, "mean"), get(x, "y_mean")
        dx, dy, k = mx - mean, my - y_mean, n * m / (n + m)
        rows = get(x, "block").reshape(-1, p)
        own = slice(first, first + len(rows))
        block = block + rows + k * np.outer(dx[own], dx)
        squares = squares + get(x, "squares") + k * dx * dx
        xty = xty + get(x, "xty").reshape(len(rows), -1) + k * np.outer(dx[own], dy)
        yty = yty + get(x, "yty") + k * dy * dy
        mean = mean + dx * m / (n + m)
        y_mean = y_mean + dy * m / (n + m)
        n += m
    sd = np.sqrt(np.maximum(squares, 0.0))
    inverse = np.divide(1.0, sd, out=np.zeros(p), where=sd > 0)
    r = np.clip(block * inverse[own, None] * inverse, -1, 1)
    size = len(block)
    return pa.table({
        "region_id": pa.array([group.column("region_id")[0].as_py()] * size), "i": pa.array(np.arange(first, first + size, dtype=np.int32)), "n": pa.array(np.full(size, n)), "mean": pa.array(mean[own]),
        "xtx": pa.array(list(block), pa.list_(pa.float64())), "r": pa.array(list(r), pa.list_(pa.float64())), "xty": pa.array(list(xty), pa.list_(pa.float64())),
        "y_mean": pa.array([y_mean] * size, pa.list_(pa.float64())), "yty": pa.array([yty] * size, pa.list_(pa.float64())),
    })


def _merged_many(group: pa.Table) -> pa.Table:
    """``_merged`` for the block of a wide region, or for all narrow regions of a group."""
    if group.column("wide")[0].as_py():
        return _merged(group)
    region, of = group.column("region_id").combine_chunks().dictionary_encode(), {}
    number, regions = region.indices.to_numpy(zero_copy_only=False), region.dictionary.to_pylist()
    n = group.column("n").to_numpy()
    column = {k: group.column(k).to_pylist() for k in ("mean", "block", "y_mean", "xty", "yty")}
    for k in range(len(n)):
        of.setdefault((len(column["mean"][k]) // 8, len(column["yty"][k]) // 8), []).append(k)
    if sum(len(np.unique(number[rows])) for rows in of.values()) > len(regions):
        raise ValueError("a region's samples differ in length")
    out = []
    for (p, q), rows in of.items():
        sums, left = _Many(p, q), np.array(rows)
        get = lambda k, at, *shape: np.frombuffer(b"".join([column[k][i] for i in at])).reshape(len(at), *shape)
        while len(left):
            _, first = np.unique(number[left], return_index=True)  # the next part of each region
            at = left[first]
            sums.merge([regions[k] for k in number[at]], n[at], get("mean", at, p), get("y_mean", at, q), get("block", at, p, p), get("xty", at, p, q), get("yty", at, q))
            left = np.delete(left, first)
        size = len(sums.place)
        xx, squares = sums.xx[:size], np.diagonal(sums.xx[:size], axis1=1, axis2=2)
        sd = np.sqrt(np.maximum(squares, 0.0))
        inverse = np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 0)
        r = np.clip(xx * inverse[:, :, None] * inverse[:, None, :], -1, 1)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(size * p + 1, dtype=np.int32) * x.shape[-1]), pa.array(np.ascontiguousarray(x).ravel()))
        out.append(pa.table({
            "region_id": pa.array(list(sums.place), pa.string()).take(pa.array(np.repeat(np.arange(size), p))), "i": pa.array(np.tile(np.arange(p, dtype=np.int32), size)), "n": pa.array(np.repeat(sums.n[:size], p)), "mean": pa.array(sums.mean[:size].ravel()),
            "xtx": lists(xx), "r": lists(r), "xty": lists(sums.xy[:size]), "y_mean": lists(np.repeat(sums.y_mean[:size], p, 0)), "yty": lists(np.repeat(sums.yy[:size], p, 0)),
        }))
    return pa.concat_tables(out)


def region_moments(samples: DataFrame, *, block: int = 1024, limit: int = 16_000_000, spread: int | None = None) -> DataFrame:
    """Means, centred cross products and correlations of each region (schema ``MOMENTS``), a row for each variable.

    ``samples``: region_id, x (array of the predictors, one length in a region), y (array of the
    outcomes). Samples with a null among them are left out. A partition holds at most about
    ``limit`` matrix entries, narrow regions are summed and merged many at once, and what is shuffled is a block of ``block`` rows of a matrix for
    each region and partition, whatever the number of samples. Where partitions hold samples of
    more regions than fit that limit, in any order, ``spread`` first brings each region's samples
    to so many tasks, in order; else samples aren't shuffled. The correlation with a variable
    without variance is 0.
    """
    rows = samples.select(F.col("region_id").cast("string").alias("region_id"), F.col("x").cast("array<double>").alias("x"), F.col("y").cast("array<double>").alias("y"))
    rows = rows.where("region_id IS NOT NULL AND forall(x, v -> v IS NOT NULL AND NOT isnan(v)) AND forall(y, v -> v IS NOT NULL AND NOT isnan(v))")
    if spread:
        rows = rows.withColumn("part", F.pmod(F.xxhash64("x", "y"), F.lit(spread))).repartition("region_id", "part").sortWithinPartitions("region_id").drop("part")
    parts = rows.mapInArrow(_partial(block, limit), _PART).withColumn("wide", F.length("mean") * F.length("mean") > 64 * (NARROW if block >= 16 else 0))
    buckets = BUCKETS * int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    alone = F.when(F.col("wide"), F.col("region_id"))  # narrow regions share a task's call, as one costs more than their sums
    return parts.groupBy(alone.alias("alone"), F.when(F.col("wide"), F.col("first")).alias("part"), F.when(~F.col("wide"), F.pmod(F.xxhash64("region_id"), F.lit(buckets))).alias("bucket")).applyInArrow(_merged_many, MOMENTS)


def sufficient_statistics(moments: DataFrame, outcome: int = 0) -> DataFrame:
    """(region_id, i, xtx, xty, yty, n, mean, y_mean) of one outcome."""
    return moments.select("region_id", "i", "xtx", F.get("xty", F.lit(outcome)).alias("xty"), F.get("yty", F.lit(outcome)).alias("yty"), "n", "mean", F.get("y_mean", F.lit(outcome)).alias("y_mean"))


def marginal_regressions(moments: DataFrame) -> DataFrame:
    """(region_id, outcome, idx, n, bhat, shat, z, z_adjusted) of each outcome on each variable alone, centred.

    A variable without variance has slope 0 and no error or z. ``z_adjusted`` is z as a
    correlation of n samples gives it.
    """
    ss = F.element_at("xtx", F.col("i") + 1)
    x = moments.select("region_id", F.col("i").alias("idx"), "n", ss.alias("ss"), F.posexplode(F.arrays_zip("xty", "yty")).alias("outcome", "o"))
    x = x.select("region_id", "outcome", "idx", "n", "ss", F.col("o.xty").alias("xty"), F.col("o.yty").alias("yty")).withColumn("bhat", F.when(F.col("ss") > 0, F.col("xty") / F.col("ss")).otherwise(0.0))
    left = F.greatest(F.col("yty") - F.col("bhat") * F.col("xty"), F.lit(0.0))
    x = x.withColumn("shat", F.when((F.col("ss") > 0) & (F.col("n") > 2), F.sqrt(left / (F.col("n") - 2) / F.col("ss"))))
    x = x.withColumn("z", F.when(F.col("shat") > 0, F.col("bhat") / F.col("shat")))
    return x.withColumn("z_adjusted", F.col("z") * F.sqrt((F.col("n") - 1) / (F.col("z") * F.col("z") + F.col("n") - 2))).select("region_id", "outcome", "idx", "n", "bhat", "shat", "z", "z_adjusted", "ss", "xty", "yty")


def residualised(samples: DataFrame) -> DataFrame:
    """The samples (region_id, sample_id, x, y) with their outcomes less what covariates ``c`` (an array) and a constant explain of them; predictors stay.

    A region's outcomes and covariates meet in one grouped task; predictors aren't read there.
    """

    def solve(group: pa.Table) -> pa.Table:
        C, Y = (group.column(k).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, -1) for k in ("c", "y"))
        C = np.concatenate([np.ones((len(C), 1)), C], 1)
        left = Y - C @ np.linalg.lstsq(C, Y, rcond=None)[0]
        return pa.table({"region_id": group.column("region_id"), "sample_id": group.column("sample_id"), "y": pa.array(list(left), pa.list_(pa.float64()))})

    rows = samples.select(F.col("region_id").cast("string").alias("region_id"), F.col("sample_id").cast("long").alias("sample_id"), F.col("y").cast("array<double>").alias("y"), F.col("c").cast("array<double>").alias("c"))
    found = rows.groupBy("region_id").applyInArrow(solve, "region_id string, sample_id long, y array<double>")
    return samples.select(F.col("region_id").cast("string").alias("region_id"), F.col("sample_id").cast("long").alias("sample_id"), "x").join(found, ["region_id", "sample_id"])


def uncentred_effects(moments: DataFrame, sigma2: float | None = None) -> DataFrame:
    """(region_id, outcome, idx, bhat, shat) of regressions through the origin; the error comes from ``sigma2`` or from the residuals' variance about their mean."""
    n, mean = F.col("n"), F.col("mean")
    x = moments.select("region_id", F.col("i").alias("idx"), "n", "mean", F.element_at("xtx", F.col("i") + 1).alias("ss"), F.posexplode(F.arrays_zip("xty", "yty", "y_mean")).alias("outcome", "o"))
    sxx, sxy, syy = F.col("ss") + n * mean * mean, F.col("o.xty") + n * mean * F.col("o.y_mean"), F.col("o.yty") + n * F.col("o.y_mean") * F.col("o.y_mean")
    x = x.select("region_id", "outcome", "idx", "n", sxx.alias("sxx"), sxy.alias("sxy"), syy.alias("syy")).where("sxx > 0")
    spread = F.lit(float(sigma2)) if sigma2 is not None else F.greatest((F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / (F.col("n") - 1), F.lit(1e-64))
    return x.select("region_id", "outcome", "idx", (F.col("sxy") / F.col("sxx")).alias("bhat"), F.sqrt(spread / F.col("sxx")).alias("shat"))


def ld_pairs(moments: DataFrame) -> DataFrame:
    """(region_id, i, j, r) of all ordered pairs, the diagonal too, from the rows of a matrix."""
    return moments.select("region_id", "i", F.posexplode("r").alias("j", "r"))
