"""Distances between the graphs of windows, on sparse edges: an edge that isn't there has weight 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dimension(edges: DataFrame, lag: int | None = None) -> DataFrame:
    e = edges if lag is None else edges.where(F.col("lag") == lag)
    return e.agg((F.greatest(F.max("i"), F.max("j")) + 1).alias("d"))


def matrix_slice(edges: DataFrame, lag: int, d: int, order: str | None = None) -> DataFrame:
    """One lag's edges inside d; where a cell repeats within a window the last by ``order`` counts."""
    e = edges.where((F.col("lag") == lag) & (F.col("i") < d) & (F.col("j") < d))
    if order is None:
        return e.select("window_idx", "i", "j", "weight")
    return e.groupBy("window_idx", "i", "j").agg(F.max_by("weight", order).alias("weight"))


def pair_cells(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pairs (a, b) of windows -> (a, b, i, j, x, y): cells that either graph has, 0 where one lacks it."""
    x = pairs.join(left.select(F.col("window_idx").alias("a"), "i", "j", F.col("weight").alias("x"), F.lit(0.0).alias("y")), "a")
    y = pairs.join(right.select(F.col("window_idx").alias("b"), "i", "j", F.lit(0.0).alias("x"), F.col("weight").alias("y")), "b")
    # both sides summed by cell: one aggregation in place of a full outer join
    return x.unionByName(y).groupBy("a", "b", "i", "j").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))


def frobenius(cells: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Pairs without any cell are at distance 0 if ``pairs`` is given."""
    out = cells.groupBy("a", "b").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) ** 2)).alias("distance"))
    return out if pairs is None else pairs.join(out, ["a", "b"], "left").withColumn("distance", F.coalesce("distance", F.lit(0.0)))


def weighted_edges(cells: DataFrame, eps=1e-3, pairs: DataFrame | None = None) -> DataFrame:
    return frobenius(cells.where((F.abs("x") > eps) | (F.abs("y") > eps)), pairs)


def spectral(cells: DataFrame) -> DataFrame:
    """Greatest singular value of the difference, by a grouped kernel over the cells of each pair."""
    import numpy as np
    import pandas as pd

    def norm(key, rows: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((int(max(rows.i.max(), rows.j.max())) + 1,) * 2)
        m[rows.i, rows.j] = rows.x - rows.y
        return pd.DataFrame([(*key, float(np.linalg.norm(m, 2)))], columns=["a", "b", "distance"])

    return cells.groupBy("a", "b").applyInPandas(norm, "a int, b int, distance double")


METRICS = {"frobenius": frobenius, "weighted_edge": weighted_edges, "spectral": spectral}


def distance(cells: DataFrame, metric="frobenius") -> DataFrame:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}: {', '.join(METRICS)}")
    return METRICS[metric](cells)


def sampled_ids(golden: DataFrame, every=10) -> DataFrame:
    ids = golden.select("window_idx").distinct().withColumn("_k", F.row_number().over(Window.orderBy("window_idx")) - 1)
    return ids.where(F.col("_k") % every == 0).select("window_idx")


def nearest_golden(test: DataFrame, golden: DataFrame, every=10) -> DataFrame:
    """Per test window the least Frobenius distance to every ``every``-th golden window.

    |A - B|^2 = |A|^2 + |B|^2 - 2 <A, B>: only cells that both have are joined, the norms come from each side alone.
    """
    g = golden.join(sampled_ids(golden, every), "window_idx", "left_semi").select(F.col("window_idx").alias("b"), "i", "j", F.col("weight").alias("y"))
    t = test.select(F.col("window_idx").alias("a"), "i", "j", F.col("weight").alias("x"))
    dot = t.join(g, ["i", "j"]).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    na, nb = t.groupBy("a").agg(F.sum(F.col("x") ** 2).alias("na")), g.groupBy("b").agg(F.sum(F.col("y") ** 2).alias("nb"))
    pairs = na.crossJoin(nb).join(dot, ["a", "b"], "left")
    square = F.greatest(F.lit(0.0), F.col("na") + F.col("nb") - 2 * F.coalesce("dot", F.lit(0.0)))
    best = pairs.withColumn("_d", square).groupBy("a").agg(F.min_by("b", F.struct("_d", "b")).alias("b"))
    return frobenius(pair_cells(best, test, golden), best).select(F.col("a").alias("window_idx"), F.col("b").alias("nearest"), F.col("distance").alias("abs_score"))


def golden_sampled_mean(golden: DataFrame, most=200, zero_fill_ids: int | None = None) -> DataFrame:
    """Mean over at most ``most`` golden windows, evenly taken from their sorted ids (truncated); absent edges are 0.

    ``zero_fill_ids`` takes the ids from that many windows counted from 0 instead, and windows that golden lacks
    enter as zero matrices.
    """
    if zero_fill_ids is None:
        ids = golden.select("window_idx").distinct()
        ids = ids.withColumn("_k", F.row_number().over(Window.orderBy("window_idx")) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    else:
        ids = golden.sparkSession.range(zero_fill_ids).select(F.col("id").cast("int").alias("window_idx"), F.col("id").alias("_k"), F.lit(zero_fill_ids).alias("_n"))
    m = F.least(F.lit(most), F.col("_n"))
    # floor(s (n-1) / (m-1)) = k for some s < m
    s = F.ceil(F.col("_k") * (m - 1) / F.greatest(F.lit(1), F.col("_n") - 1))
    ids = ids.withColumn("_m", m).where((s < m) & (F.floor(s * (F.col("_n") - 1) / F.greatest(F.lit(1), m - 1)) == F.col("_k")))
    e = golden.join(ids.select("window_idx", "_m"), "window_idx")
    return e.groupBy("i", "j", "lag").agg((F.sum("weight") / F.max("_m")).alias("weight"))


def golden_mean(golden: DataFrame, lag=0) -> DataFrame:
    """Mean of the rows that are there."""
    return golden.where(F.col("lag") == lag).groupBy("i", "j").agg(F.avg("weight").alias("weight"))


def to_baseline(test: DataFrame, baseline: DataFrame, lag=0) -> DataFrame:
    """abs_score: distance of each window to one averaged graph.

    |A - B|^2 over the cells of A, plus the cells of B that A lacks: sum over A of (x-y)^2 - y^2, plus |B|^2. One join.
    """
    t = test.where(F.col("lag") == lag)
    b = baseline.where(F.col("lag") == lag) if "lag" in baseline.columns else baseline
    b = b.select("i", "j", F.col("weight").alias("y"))
    whole = b.agg(F.coalesce(F.sum(F.col("y") ** 2), F.lit(0.0)).alias("_b"))
    y = F.coalesce(F.col("y"), F.lit(0.0))
    own = t.join(b, ["i", "j"], "left").groupBy("window_idx").agg(F.sum((F.col("weight") - y) ** 2 - y * y).alias("_o"))
    return own.crossJoin(F.broadcast(whole)).select("window_idx", F.sqrt(F.greatest(F.lit(0.0), F.col("_o") + F.col("_b"))).alias("abs_score"))


def change_scores(test: DataFrame, observed=True) -> DataFrame:
    """Distance to the window before: the one observed before, or id - 1 (an absent one is a zero matrix); the first is 0."""
    ids = test.select("window_idx").distinct()
    before = F.lag("window_idx").over(Window.orderBy("window_idx"))
    ids = ids.withColumn("b", before if observed else F.when(F.col("window_idx") > 0, F.col("window_idx") - 1)).withColumnRenamed("window_idx", "a")
    pairs = ids.where("b is not null")
    out = frobenius(pair_cells(pairs, test, test), pairs)
    return ids.join(out.select("a", "distance"), "a", "left").select(F.col("a").alias("window_idx"), F.coalesce("distance", F.lit(0.0)).alias("change_score"))


def trend(scores: DataFrame, lookback=5) -> DataFrame:
    back = F.lag("abs_score", lookback).over(Window.orderBy("window_idx"))
    return scores.withColumn("abs_trend", F.coalesce(F.col("abs_score") - back, F.lit(0.0)))


def top_dims(cells: DataFrame, k=5) -> DataFrame:
    """Per pair the k variables whose rows and columns differ most; of equals the lowest first."""
    d = F.round(F.abs(F.col("x") - F.col("y")), 12)
    parts = cells.select("a", "b", F.explode(F.array("i", "j")).alias("dim"), d.alias("d"))
    ranked = parts.groupBy("a", "b", "dim").agg(F.round(F.sum("d"), 9).alias("s")).withColumn("_r", F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("s"), "dim")))
    top = F.array_sort(F.collect_list(F.when(F.col("_r") <= k, F.struct("_r", "dim"))))
    return ranked.where(F.col("_r") <= k).groupBy("a", "b").agg(F.array_join(F.transform(top, lambda x: x["dim"].cast("string")), ",").alias("top_dims"))


def edge_difference_stats(test: DataFrame, golden: DataFrame, keys=("window_idx", "lag", "i", "j")) -> DataFrame:
    """Inner join of the same edges of the same windows: mean, max, std and count of |difference|, and how many are above 0.1."""
    g = golden.select(*keys, F.col("weight").alias("_g"))
    d = F.abs(F.col("weight") - F.col("_g"))
    return test.join(g, list(keys)).groupBy("window_idx").agg(
        F.avg(d).alias("mean_diff"), F.max(d).alias("max_diff"), F.stddev_samp(d).alias("std_diff"), F.count(F.lit(1)).alias("n_edges"), F.count_if(d > 0.1).alias("n_large"),
    )


def top_windows(stats: DataFrame, n: int, by="mean_diff") -> DataFrame:
    return stats.orderBy(F.desc(by), "window_idx").limit(n)


def top_edges(test: DataFrame, golden: DataFrame, n=5) -> DataFrame:
    """Per window the n edges that differ most, with the ratio of the weight to the golden one."""
    g = golden.select("window_idx", "lag", "i", "j", F.col("weight").alias("golden"))
    e = test.join(g, ["window_idx", "lag", "i", "j"]).withColumn("diff", F.abs(F.col("weight") - F.col("golden")))
    w = Window.partitionBy("window_idx").orderBy(F.desc(F.round("diff", 9)), "lag", "i", "j")
    return e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).withColumn("ratio", F.col("weight") / (F.abs("golden") + 1e-10))


def spike_ratio(stats: DataFrame, spikes: DataFrame, by="mean_diff") -> DataFrame:
    """Mean of spike windows over that of the others, and its band."""
    s = stats.join(spikes.select("window_idx").distinct().withColumn("_s", F.lit(True)), "window_idx", "left")
    out = s.agg(F.avg(F.when(F.col("_s"), F.col(by))).alias("spike"), F.avg(F.when(F.col("_s").isNull(), F.col(by))).alias("other"))
    r = F.col("spike") / F.col("other")
    return out.withColumn("ratio", r).withColumn("band", F.when(r > 2, "strong").when(r > 1.5, "moderate").otherwise("weak"))


def structural_hamming(cells: DataFrame, eps=0.01) -> DataFrame:
    return cells.groupBy("a", "b").agg(F.count_if((F.abs("x") > eps) != (F.abs("y") > eps)).alias("shd"), F.max(F.abs(F.col("x") - F.col("y"))).alias("max_edge_change"))


def normalised_score(test: DataFrame, baseline: DataFrame, lag=0) -> DataFrame:
    """Distance to the baseline over the baseline's norm."""
    b = baseline.where(F.col("lag") == lag) if "lag" in baseline.columns else baseline
    norm = b.agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("_n"))
    return to_baseline(test, baseline, lag).crossJoin(F.broadcast(norm)).select("window_idx", (F.col("abs_score") / F.col("_n")).alias("score"))


def mad_threshold(scores: DataFrame, k=2.0, frame=50, column="score") -> DataFrame:
    """Median plus k median absolute deviations of the ``frame`` scores before."""
    w = Window.orderBy("window_idx").rowsBetween(-frame, -1)
    out = scores.withColumn("_m", F.percentile(column, F.lit(0.5)).over(w)).withColumn("_all", F.collect_list(column).over(w))
    dev = F.array_sort(F.transform("_all", lambda x: F.abs(x - F.col("_m"))))
    n = F.size("_all")
    mid = (F.get(dev, F.floor((n - 1) / 2).cast("int")) + F.get(dev, F.floor(n / 2).cast("int"))) / 2
    return out.withColumn("threshold", F.when(n > 0, F.col("_m") + k * mid)).drop("_m", "_all")
