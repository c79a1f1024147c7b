"""Comparison of fits of the same regions: variables, inclusion probabilities, matched effects, stability of credible sets.

``fits``: a fit table with a column ``setting``. A variable that a fit lacks is null there,
never 0, and no mass is renormalised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import posterior


def _sides(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    return tuple(df.select("region_id", F.col("setting").alias(f"setting_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in columns]) for s in "ab")


def _pairs(baseline: str | None) -> Column:
    """Ordered pairs of settings: all of them once, or the baseline with each other one."""
    return F.col("setting_a") < F.col("setting_b") if baseline is None else (F.col("setting_a") == baseline) & (F.col("setting_b") != baseline)


def universe(fits: DataFrame, mode: str = "union") -> DataFrame:
    """(region_id, idx) of the variables in any fit ("union") or in all of them ("common")."""
    own = fits.select("region_id", "setting", "idx").distinct()
    if mode == "union":
        return own.select("region_id", "idx").distinct()
    if mode != "common":
        raise ValueError(f"mode: {mode}")
    n = own.groupBy("region_id").agg(F.count_distinct("setting").alias("settings"))
    return own.groupBy("region_id", "idx").agg(F.count("*").alias("n")).join(n, "region_id").where("n = settings").select("region_id", "idx")


def alignment(fits: DataFrame, baseline: str | None = None) -> DataFrame:
    """By pair of settings: variables in both, and those that either side lacks."""
    own = posterior.pip(fits)
    pairs = own.select("region_id", "setting").distinct()
    a, b = _sides(pairs, [])
    pairs = a.join(b, "region_id").where(_pairs(baseline))
    left = pairs.join(own.select("region_id", F.col("setting").alias("setting_a"), "idx"), ["region_id", "setting_a"]).withColumn("in_a", F.lit(True))
    right = pairs.join(own.select("region_id", F.col("setting").alias("setting_b"), "idx"), ["region_id", "setting_b"]).withColumn("in_b", F.lit(True))
    both = left.join(right, ["region_id", "setting_a", "setting_b", "idx"], "full")
    omitted = lambda c: F.array_sort(F.collect_list(F.when(F.col(c).isNull(), F.col("idx"))))
    return both.groupBy("region_id", "setting_a", "setting_b").agg(F.count_if(F.col("in_a") & F.col("in_b")).alias("shared"), omitted("in_a").alias("omitted_a"), omitted("in_b").alias("omitted_b"))


def pip_metrics(fits: DataFrame, baseline: str | None = None, threshold: float = 0.1) -> DataFrame:
    """By pair of settings, over shared variables: correlation of inclusion probabilities and their greatest difference, also over candidates alone."""
    a, b = _sides(posterior.pip(fits), ["idx", "pip"])
    rows = a.join(b, (a.region_id == b.region_id) & (a.idx_a == b.idx_b)).drop(b.region_id).where(_pairs(baseline))
    delta = F.abs(F.col("pip_a") - F.col("pip_b"))
    candidate = (F.col("pip_a") >= threshold) | (F.col("pip_b") >= threshold)
    return rows.groupBy("region_id", "setting_a", "setting_b").agg(F.count("*").alias("variables"), F.corr("pip_a", "pip_b").alias("pearson"), F.max(delta).alias("max_abs_delta"), F.max(F.when(candidate, delta)).alias("candidate_max_abs_delta"))


def effect_overlaps(fits: DataFrame, baseline: str | None = None, prior_tol: float = posterior.PRIOR_TOL) -> DataFrame:
    """By pair of active components of two settings: the sum of the lesser alpha over shared variables."""
    a, b = _sides(fits.where(F.col("V") > prior_tol).select("region_id", "setting", "component_id", "idx", "alpha"), ["component_id", "idx", "alpha"])
    rows = a.join(b, (a.region_id == b.region_id) & (a.idx_a == b.idx_b)).drop(b.region_id).where(_pairs(baseline))
    return rows.groupBy("region_id", "setting_a", "setting_b", "component_id_a", "component_id_b").agg(F.sum(F.least("alpha_a", "alpha_b")).alias("overlap"))


def signal_edges(fits: DataFrame, sets: DataFrame, ld_rows: DataFrame | None = None, *, baseline: str | None = None, overlap: float = 0.5, corr: float = 0.9) -> DataFrame:
    """Pairs of effects that stand for one signal: enough overlap, a shared set member, or leading variables in strong correlation.

    ``sets``: credible sets of all settings. Labels come from the number of edges at either
    end: matched, split (one of a, several of b), merge, ambiguous.
    """
    k = ["region_id", "setting_a", "setting_b", "component_id_a", "component_id_b"]
    rows = effect_overlaps(fits, baseline)
    member = sets.select("region_id", "setting", "component_id", F.explode("members").alias("idx"))
    a, b = _sides(member, ["component_id", "idx"])
    shared = a.join(b, (a.region_id == b.region_id) & (a.idx_a == b.idx_b)).drop(b.region_id).where(_pairs(baseline)).groupBy(*k).agg(F.count("*").alias("shared_members"))
    rows = rows.join(shared, k, "left").withColumn("shared_members", F.coalesce("shared_members", F.lit(0)))
    if ld_rows is not None:
        top = fits.groupBy("region_id", "setting", "component_id").agg(F.min_by("idx", F.struct((-F.col("alpha")).alias("x"), "idx")).alias("top"))
        a, b = _sides(top, ["component_id", "top"])
        rows = rows.join(a, ["region_id", "setting_a", "component_id_a"]).join(b, ["region_id", "setting_b", "component_id_b"])
        rows = rows.join(ld_rows.select("region_id", F.col("i").alias("top_a"), "r"), ["region_id", "top_a"], "left").withColumn("corr", F.get("r", F.col("top_b"))).drop("r")
    else:
        rows = rows.withColumn("corr", F.lit(None).cast("double"))
    edges = rows.where((F.col("overlap") >= overlap) | (F.col("shared_members") > 0) | (F.coalesce(F.abs("corr"), F.lit(0.0)) >= corr))
    return classified(edges)


def signals(fits: DataFrame, sets: DataFrame, prior_tol: float = posterior.PRIOR_TOL) -> DataFrame:
    """Components that are active or have a set, with their leading variable, its alpha, and the set's members (null without one)."""
    own = fits.groupBy("region_id", "setting", "component_id").agg(F.first("V").alias("V"), F.min_by("idx", F.struct((-F.col("alpha")).alias("x"), "idx")).alias("top"), F.max("alpha").alias("top_alpha"))
    rows = own.join(sets.select("region_id", "setting", "component_id", "members"), ["region_id", "setting", "component_id"], "left")
    return rows.where((F.col("V") > prior_tol) | F.col("members").isNotNull())


def seen_from(edges: DataFrame, setting: str) -> DataFrame:
    """The edges that touch a setting, turned so that it is side a; splits seen from the other side are merges."""
    straight = edges.where(F.col("setting_a") == setting)
    turned = edges.where((F.col("setting_b") == setting) & (F.col("setting_a") != setting))
    other = lambda c: c[:-1] + ("b" if c.endswith("_a") else "a")
    label = F.when(F.col("label") == "split", "merge").when(F.col("label") == "merge", "split").otherwise(F.col("label"))
    swapped = turned.select(*[label.alias("label") if c == "label" else F.col(other(c)).alias(c) if c.endswith(("_a", "_b")) else F.col(c) for c in edges.columns])
    return straight.unionByName(swapped)


def classified(edges: DataFrame) -> DataFrame:
    """Edges (region_id, setting_a, setting_b, component_id_a, component_id_b, ...) with ``label``."""
    pair = ["region_id", "setting_a", "setting_b"]
    da, db = (F.count("*").over(Window.partitionBy(*pair, f"component_id_{s}")) for s in "ab")
    rows = edges.withColumn("da", da).withColumn("db", db)
    # An edge of degree one at both ends may still hang on a branching neighbour; ends see each other's worst.
    label = F.when((F.col("da") > 1) & (F.col("db") > 1), "ambiguous").when(F.col("da") > 1, "split").when(F.col("db") > 1, "merge").otherwise("matched")
    return rows.withColumn("label", label).drop("da", "db")


def unmatched(fits: DataFrame, edges: DataFrame, baseline: str | None = None, prior_tol: float = posterior.PRIOR_TOL) -> DataFrame:
    """Active effects without an edge, by pair of settings and side, and the mass on variables that the other side lacks."""
    own = fits.where(F.col("V") > prior_tol).select("region_id", "setting", "component_id").distinct()
    settings = fits.select("region_id", "setting").distinct()
    a, b = _sides(settings, [])
    pairs = a.join(b, "region_id").where(_pairs(baseline))
    out = None
    for side, other in (("a", "b"), ("b", "a")):
        each = pairs.join(own.select("region_id", F.col("setting").alias(f"setting_{side}"), "component_id"), ["region_id", f"setting_{side}"])
        free = each.join(edges.select("region_id", "setting_a", "setting_b", F.col(f"component_id_{side}").alias("component_id")).distinct(), ["region_id", "setting_a", "setting_b", "component_id"], "left_anti")
        mass = free.join(fits.select("region_id", F.col("setting").alias(f"setting_{side}"), "component_id", "idx", "alpha"), ["region_id", f"setting_{side}", "component_id"])
        there = fits.select("region_id", F.col("setting").alias(f"setting_{other}"), "idx").distinct().withColumn("there", F.lit(True))
        mass = mass.join(there, ["region_id", f"setting_{other}", "idx"], "left")
        rows = mass.groupBy("region_id", "setting_a", "setting_b", "component_id").agg(F.sum(F.when(F.col("there").isNull(), F.col("alpha")).otherwise(0.0)).alias("omitted_mass")).withColumn("side", F.lit(side))
        out = rows if out is None else out.unionByName(rows)
    return out


def set_stability(sets: DataFrame, edges: DataFrame, baseline: str) -> DataFrame:
    """For each baseline set and other setting: how its signal fared (ambiguous before split, merge, matched, lost) and the greatest Jaccard index with a set there."""
    base = sets.where(F.col("setting") == baseline).select("region_id", F.col("component_id").alias("component_id_a"), F.col("members").alias("members_a"))
    others = sets.where(F.col("setting") != baseline).select("region_id", F.col("setting").alias("setting_b"), F.col("component_id").alias("component_id_b"), F.col("members").alias("members_b"))
    settings = edges.where(F.col("setting_a") == baseline).select("region_id", "setting_b").distinct().unionByName(others.select("region_id", "setting_b")).distinct()
    grid = base.join(settings, "region_id")
    jaccard = F.size(F.array_intersect("members_a", "members_b")) / F.size(F.array_union("members_a", "members_b"))
    best = grid.join(others, ["region_id", "setting_b"], "left").groupBy("region_id", "setting_b", "component_id_a").agg(F.coalesce(F.max(jaccard), F.lit(0.0)).alias("jaccard"))
    rank = F.when(F.col("label") == "ambiguous", 0).when(F.col("label") == "split", 1).when(F.col("label") == "merge", 2).otherwise(3)
    fate = edges.where(F.col("setting_a") == baseline).groupBy("region_id", "setting_b", "component_id_a").agg(F.min_by("label", rank).alias("fate"))
    return best.join(fate, ["region_id", "setting_b", "component_id_a"], "left").withColumn("fate", F.coalesce("fate", F.lit("lost")))


def greedy_matches(edges: DataFrame) -> DataFrame:
    """One-to-one matches for display: edges by falling overlap, each taken if neither end is.

    A few effects a region, so the edges of a pair of settings are folded in one array.
    """
    pair = ["region_id", "setting_a", "setting_b"]
    packed = edges.groupBy(*pair).agg(F.array_sort(F.collect_list(F.struct((-F.col("overlap")).alias("order"), F.col("component_id_a").alias("a"), F.col("component_id_b").alias("b")))).alias("e"))
    free = lambda taken, x: ~F.exists(taken, lambda t: (t["a"] == x["a"]) | (t["b"] == x["b"]))
    empty = F.array().cast("array<struct<order:double,a:int,b:int>>")
    taken = F.aggregate("e", empty, lambda t, x: F.when(free(t, x), F.concat(t, F.array(x))).otherwise(t))
    return packed.select(*pair, F.explode(taken).alias("t")).select(*pair, F.col("t.a").alias("component_id_a"), F.col("t.b").alias("component_id_b"), (-F.col("t.order")).alias("overlap"))


def allele_orientation(a: DataFrame, b: DataFrame) -> DataFrame:
    """(variant_id, sign): 1 where both tables have the same (effect, other) alleles in any case, -1 where they are swapped, null where either lacks them; others raise."""
    up = lambda c: F.upper(F.col(c))
    x = a.select("variant_id", up("effect").alias("e1"), up("other").alias("o1")).join(b.select("variant_id", up("effect").alias("e2"), up("other").alias("o2")), "variant_id")
    missing = F.greatest(*[F.col(c).isNull() for c in ("e1", "o1", "e2", "o2")])
    sign = F.when(missing, F.lit(None).cast("int")).when((F.col("e1") == F.col("e2")) & (F.col("o1") == F.col("o2")), 1).when((F.col("e1") == F.col("o2")) & (F.col("o1") == F.col("e2")), -1)
    return x.select("variant_id", sign.otherwise(F.raise_error(F.concat(F.lit("alleles disagree at "), F.col("variant_id").cast("string"))).cast("int")).alias("sign"))


def compare_fits(fits: DataFrame, sets: DataFrame, ld_rows: DataFrame | None = None, *, baseline: str | None = None, threshold: float = 0.1, overlap: float = 0.5, corr: float = 0.9, mode: str = "union") -> dict[str, DataFrame]:
    """All comparison tables by name."""
    edges = signal_edges(fits, sets, ld_rows, baseline=baseline, overlap=overlap, corr=corr)
    wide = universe(fits, mode).join(posterior.pip(fits), ["region_id", "idx"], "left").groupBy("region_id", "idx").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("setting", "pip")))).alias("pip"))
    out = {"variants": wide, "alignment": alignment(fits, baseline), "metrics": pip_metrics(fits, baseline, threshold), "edges": edges, "unmatched": unmatched(fits, edges, baseline), "matches": greedy_matches(edges)}
    if baseline is not None:
        out["stability"] = set_stability(sets, edges, baseline)
    return out
