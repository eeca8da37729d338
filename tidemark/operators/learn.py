"""From windows to edges: estimators, edge tables and their thresholds.

Numeric estimators are numpy kernels in ``tidemark.functions``, run once per window by a grouped map, so a cluster fits as
many windows at once as it has cores. What can be said in relational terms is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EDGE = ["window_idx", "i", "j", "lag"]


def lagged_pairs(windowed: DataFrame, max_lag: int, keys: Sequence[str] = ("window_idx",)) -> DataFrame:
    """windowed (keys, t, var_idx, value) -> (keys, t, i, j, lag, x, y): x of i at t - lag beside y of j at t, within a window.

    One equality join per lag step on (keys, t); a variable isn't paired with itself at lag 0.
    """
    y = windowed.select(*keys, "t", F.col("var_idx").alias("j"), F.col("value").alias("y"))
    x = windowed.select(*keys, F.col("t").alias("_s"), F.col("var_idx").alias("i"), F.col("value").alias("x"))
    x = x.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(max_lag)))).withColumn("t", F.col("_s") + F.col("lag")).drop("_s")
    return x.join(y, [*keys, "t"]).where("lag > 0 or i != j")


def correlation_edges(windowed: DataFrame, max_lag=2, keys: Sequence[str] = ("window_idx",)) -> DataFrame:
    """Pearson correlations as edge weights: a simple estimator with an exact SQL counterpart, not the model of the kernels."""
    pairs = lagged_pairs(windowed, max_lag, keys)
    out = pairs.groupBy(*keys, "i", "j", "lag").agg(F.corr("x", "y").alias("weight"))
    return out.where(F.col("weight").isNotNull() & ~F.isnan("weight"))


def threshold(edges: DataFrame, least=0.01) -> DataFrame:
    return edges.where(F.abs("weight") >= least)


def sparse(edges: DataFrame, eps=1e-8) -> DataFrame:
    return edges.where(F.abs("weight") > eps)


def without_diagonal(edges: DataFrame) -> DataFrame:
    """At lag 0 no variable acts on itself."""
    return edges.where("lag > 0 or i != j")


def without_tabu(edges: DataFrame, tabu_edges: DataFrame | None = None, tabu_parents: Sequence[int] = (), tabu_children: Sequence[int] = ()) -> DataFrame:
    """Forbidden edges (i, j, lag) go, and all edges from tabu parents or to tabu children."""
    out = edges.where(~F.col("i").isin(list(tabu_parents)) & ~F.col("j").isin(list(tabu_children)))
    return out if tabu_edges is None else out.join(tabu_edges.select("i", "j", "lag"), ["i", "j", "lag"], "left_anti").select(*edges.columns)


def matrix_to_edges(matrices: DataFrame) -> DataFrame:
    """(window_idx, lag, m array<array<double>>) -> edges of the cells that aren't 0: row i acts on column j."""
    rows = matrices.select("window_idx", "lag", F.posexplode("m").alias("i", "row"))
    return rows.select("window_idx", "i", F.posexplode("row").alias("j", "weight"), "lag").where("weight != 0").select(*EDGE, "weight")


def edges_to_matrix(edges: DataFrame, d: int) -> DataFrame:
    """(window_idx, lag, m): rows of d, 0 where there is no edge; edges outside are left aside."""
    rows = edges.where((F.col("i") < d) & (F.col("j") < d) & (F.col("i") >= 0) & (F.col("j") >= 0)).groupBy("window_idx", "lag")
    at = rows.agg(F.map_from_entries(F.collect_list(F.struct(F.col("i") * d + F.col("j"), F.col("weight")))).alias("cells"))
    cell = lambda r, c: F.coalesce(F.element_at("cells", r * d + c), F.lit(0.0))
    m = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda c: cell(r, c)))
    return at.select("window_idx", "lag", m.alias("m"))


def named(edges: DataFrame, names: DataFrame) -> DataFrame:
    """names (var_idx, var): adds parent_name and child_name as ``{var}_lag{k}``."""
    n = names.select("var_idx", "var")
    out = edges.join(F.broadcast(n.toDF("i", "_p")), "i").join(F.broadcast(n.toDF("j", "_c")), "j")
    return out.withColumn("parent_name", F.concat("_p", F.lit("_lag"), F.col("lag").cast("string"))).withColumn("child_name", F.concat("_c", F.lit("_lag0"))).drop("_p", "_c")


def from_names(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(window_idx, parent_name, child_name, weight) -> edges by index; names that aren't known or don't parse are left aside."""
    n = names.select("var_idx", "var")
    part = lambda c, k: F.regexp_extract(c, r"^(.*)_lag(\d+)$", k)
    e = edges.select("window_idx", part("parent_name", 1).alias("_p"), part("parent_name", 2).alias("_l"), part("child_name", 1).alias("_c"), "weight").where("_l != ''")
    e = e.join(F.broadcast(n.toDF("i", "_p")), "_p").join(F.broadcast(n.toDF("j", "_c")), "_c")
    return e.select("window_idx", "i", "j", F.col("_l").cast("int").alias("lag"), "weight")


def edge_counts(edges: DataFrame, eps=1e-4) -> DataFrame:
    on = F.abs("weight") > eps
    return edges.groupBy("window_idx").agg(F.count_if(on & (F.col("lag") == 0)).alias("n_instant"), F.count_if(on & (F.col("lag") > 0)).alias("n_lagged"))


def two_means_threshold(edges: DataFrame, least=100) -> DataFrame:
    """Per window the edges of the upper of two clusters of log1p|weight|.

    In one dimension the best two clusters are a cut of the sorted values, so the exact optimum is a matter of running sums.
    If fewer than ``least`` stay, and there are so many, the greatest ``least`` do.
    """
    by, ties = Window.partitionBy("window_idx"), ("i", "j", "lag")
    up = by.orderBy(F.round(F.abs("weight"), 12), *ties)
    rows = edges.withColumn("_x", F.log1p(F.abs("weight"))).withColumn("_k", F.row_number().over(up)).withColumn("_n", F.count(F.lit(1)).over(by))
    low = up.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_s", F.sum("_x").over(low)).withColumn("_all", F.sum("_x").over(by)).withColumn("_Q", F.sum(F.col("_x") ** 2).over(by))
    rest = F.col("_n") - F.col("_k")
    sse = F.col("_Q") - F.col("_s") ** 2 / F.col("_k") - (F.col("_all") - F.col("_s")) ** 2 / rest
    rows = rows.withColumn("_e", F.when(rest > 0, F.round(sse, 9)))
    cut = F.coalesce(F.min(F.when(F.col("_e").isNotNull(), F.struct("_e", "_k"))).over(by)["_k"], F.lit(0))
    kept = F.col("_n") - cut
    kept = F.when((kept < least) & (F.col("_n") >= least), F.lit(least)).otherwise(kept)
    return rows.withColumn("_kept", kept).where(F.col("_k") > F.col("_n") - F.col("_kept")).select(*edges.columns)


def merged(parts: Sequence[DataFrame], least=100) -> DataFrame:
    """Edge tables of several workers as one, thresholded window by window."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return two_means_threshold(out, least)


def histogram(edges: DataFrame, step=0.02) -> DataFrame:
    """Counts of weights that aren't 0, in bins of ``step`` from the least on; the greatest falls in the last."""
    w = edges.where("weight != 0").select("weight")
    span = w.agg(F.min("weight").alias("lo"), F.max("weight").alias("hi")).withColumn("bins", F.greatest(F.lit(1), F.ceil(F.round((F.col("hi") - F.col("lo")) / step, 9))).cast("int"))
    bin_ = F.least(F.floor(F.round((F.col("weight") - F.col("lo")) / step, 9)).cast("int"), F.col("bins") - 1)
    return w.crossJoin(F.broadcast(span)).groupBy(bin_.alias("bin"), "lo").count().select("bin", (F.col("lo") + F.col("bin") * step).alias("left"), F.col("count").alias("n"))


def kde(edges: DataFrame, points=2000) -> DataFrame:
    """Gaussian kernel density of the weights that aren't 0, at even places from the least to the greatest; Scott's bandwidth."""
    w = edges.where("weight != 0").select("weight")
    s = w.agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"), F.stddev_samp("weight").alias("sd"), F.count(F.lit(1)).alias("n"))
    s = s.withColumn("h", F.col("sd") * F.pow(F.col("n"), F.lit(-0.2)))
    grid = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / (points - 1))
    z = (F.col("x") - F.col("weight")) / F.col("h")
    return w.crossJoin(F.broadcast(grid)).groupBy("k", "x", "n", "h").agg(F.sum(F.exp(-z * z / 2)).alias("_s")).select("k", "x", (F.col("_s") / (F.col("n") * F.col("h") * float(np.sqrt(2 * np.pi)))).alias("density"))


def pick_lambdas(grid: DataFrame, d: int, per_variable=1.5) -> DataFrame:
    """grid (lambda_w, lambda_a, n_edges): the pair whose edges come nearest ``per_variable`` x d; the first of equals."""
    return grid.withColumn("cost", (F.col("n_edges") - per_variable * d) ** 2).orderBy("cost", "lambda_w", "lambda_a").limit(1)


def scaled_lambda(value: float, d: int) -> float:
    return value * (d / 100) ** 0.5 if d > 500 else value


def learning_rate(d: int) -> float:
    return next((r for most, r in ((20, 0.05), (100, 0.01), (500, 0.001)) if d < most), 1e-4)


def compression(d: int, p: int, knots: int, ranks: Sequence[int]) -> dict[str, float]:
    """Parameters of the full tensors and of their Tucker form: W is d x d x K, A is d x d x p x K."""
    k = knots + 2
    rw, ra, rk = ranks
    full = d * d * k * (p + 1)
    tucker = 2 * d * rw + k * rk + rw * rw * rk + 2 * d * ra + p * ra + k * rk + ra * ra * ra * rk
    return {"full": full, "tucker": tucker, "ratio": full / tucker}


def fit_windows(windowed: DataFrame, kernel: Callable[[np.ndarray], list[tuple[int, int, int, float]]], keys: Sequence[str] = ("window_idx",)) -> DataFrame:
    """Per window: the rows as a matrix (times x variables) to the kernel, its (i, j, lag, weight) as edges.

    A window that fails gives a row with the error and no edge.
    """
    import pandas as pd

    names = [*keys, "i", "j", "lag", "weight", "error"]
    kinds = {f.name: f.dataType.simpleString() for f in windowed.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", i int, j int, lag int, weight double, error string"

    def fit(key, rows: pd.DataFrame) -> pd.DataFrame:
        try:
            x = rows.pivot(index="t", columns="var_idx", values="value").sort_index().sort_index(axis=1).to_numpy()
            return pd.DataFrame([(*key, *e, None) for e in kernel(x)], columns=names)
        except Exception as e:  # noqa: BLE001  a window that can't be fitted must not end the others
            return pd.DataFrame([(*key, None, None, None, None, repr(e))], columns=names)

    return windowed.select(*keys, "t", "var_idx", "value").groupBy(*keys).applyInPandas(fit, schema)
