"""The whole way as composable steps: prepare, learn, detect, explain. Frames in, frames out; no files between."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions import kernels, stats
from tidemark.operators import bagging, detect, distance, learn, prep, rca, windows
from tidemark.session import durable


def prepare(series: DataFrame, config: Config | None = None, filter_stationary=True) -> tuple[DataFrame, DataFrame]:
    """(t, var, var_idx, value) -> the same cleaned, detrended and standardised, and the lag order of each variable."""
    import pandas as pd

    c = config or Config()
    full = prep.drop_incomplete(prep.forward_fill(series))
    full = prep.dedupe_renumber(full.withColumn("pos", F.col("t"))).drop("pos")
    flat = prep.detrend(prep.log_shift(full).drop("shift"), frame=c.get("prep.trend_frame"))
    most, alpha = c.get("prep.max_lag"), c.get("prep.alpha")

    def measure(key, rows: pd.DataFrame) -> pd.DataFrame:
        y = rows.sort_values("t").value.to_numpy()
        return pd.DataFrame([(key[0], *stats.stationarity(y), stats.optimal_lag(y, most, alpha))], columns=["var", "adf_p", "kpss_p", "optimal_lag"])

    tests = flat.select("t", "var", "value").groupBy("var").applyInPandas(measure, "var string, adf_p double, kpss_p double, optimal_lag int")
    kept = prep.stationary_vars(tests, alpha) if filter_stationary else tests
    # two-dimensional by variables: a few thousand rows at most
    lags = kept.select(F.col("var").alias("variable"), "optimal_lag")
    return prep.standardise(flat.join(F.broadcast(kept.select("var")), "var", "left_semi")), lags


def kernel(config: Config, p: int):
    least = config.get("learn.threshold")
    name = config.get("learn.estimator")
    if name == "ridge":
        return kernels.ridge_kernel(p, least=least)
    if name == "linear":
        return kernels.dynotears_kernel(p, least, lambda_w=config.get("learn.lambda_w"), lambda_a=config.get("learn.lambda_a"), steps=config.get("learn.steps"))
    if name == "tucker":
        return kernels.tucker_kernel(p, least, n_knots=config.get("learn.n_knots"), rank_w=config.get("learn.rank_w"), rank_a=config.get("learn.rank_a"), steps=config.get("learn.steps"))
    raise ValueError(f"unknown estimator {name!r}: ridge, linear, tucker")


def learn_with_status(prepared: DataFrame, p: int, config: Config | None = None, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges of every window, those of windows that are done left out, thresholded window by window; and (window_idx, error, n_edges) of each
    window that was tried, failed ones and those without edges too, which is what a later run goes on from."""
    c = config or Config()
    w = windows.sliding(prepared.select("t", "var_idx", "value"), c.get("windows.size"), c.get("windows.stride"))
    ids = w.select("window_idx").distinct()
    most = c.get("windows.max_windows")
    if done is not None or most:
        ids = windows.not_done(ids, done if done is not None else ids.limit(0), most or None)
        w = w.join(ids, "window_idx", "left_semi")
    fits = durable(learn.fit_windows(w, kernel(c, p)))
    edges = learn.two_means_threshold(fits.where("error is null").drop("error"))
    found = fits.groupBy("window_idx").agg(F.max("error").alias("error"), F.count_if(F.col("error").isNull()).alias("n_edges"))
    return edges, ids.join(found, "window_idx", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


def learn_windows(prepared: DataFrame, p: int, config: Config | None = None, done: DataFrame | None = None) -> DataFrame:
    return learn_with_status(prepared, p, config, done)[0]


def score(golden: DataFrame, test: DataFrame, config: Config | None = None, nearest=True, runs: DataFrame | None = None, n_runs: int = 0) -> DataFrame:
    """window_idx, abs_score, change_score, abs_trend. With runs, the mean of their edge tables stands for the test table."""
    c = config or Config()
    lag = c.get("detect.lag")
    test = bagging.mean_absent_zero(runs, n_runs) if runs is not None else test
    t, g = (e.where(F.col("lag") == lag).select("window_idx", "i", "j", "weight") for e in (test, golden))
    if nearest and c.get("detect.metric") == "frobenius":
        absolute = distance.nearest_golden(t, g, c.get("detect.golden_sample")).drop("nearest")
    elif nearest:
        ids = distance.sampled_ids(g, c.get("detect.golden_sample")).select(F.col("window_idx").alias("b"))
        pairs = t.select(F.col("window_idx").alias("a")).distinct().crossJoin(ids)
        far = distance.distance(distance.pair_cells(pairs, t, g), c.get("detect.metric"))
        absolute = far.groupBy(F.col("a").alias("window_idx")).agg(F.min("distance").alias("abs_score"))
    else:
        absolute = distance.to_baseline(test, distance.golden_mean(golden, lag).withColumn("lag", F.lit(lag)), lag)
    return distance.trend(absolute.join(distance.change_scores(t), "window_idx"), c.get("detect.lookback"))


def classify(scores: DataFrame, config: Config | None = None, golden_scores: DataFrame | None = None) -> DataFrame:
    c = config or Config()
    if golden_scores is not None:
        return detect.static_states(scores, detect.golden_thresholds(golden_scores, c.get("detect.sigmas")))
    return detect.adaptive_states(scores, sigmas=c.get("detect.sigmas")) if c.get("detect.adaptive") else detect.fixed_states(scores)


def explain(test: DataFrame, golden: DataFrame, states: DataFrame, n=5, lag=0) -> DataFrame:
    """The worst windows with their root cause, its effect and the edge that changed most."""
    worst = rca.top_anomalies(states, n)
    return rca.root_effect(test, distance.golden_mean(golden, lag), worst, lag).join(worst.select("window_idx", "abs_score", "status"), "window_idx")


def pairwise(golden: DataFrame, test: DataFrame, lag=0, eps=0.01) -> DataFrame:
    """Windows of two runs of the same series beside each other: three distances, the largest change of an edge, and their mean."""
    t, g = (e.where(F.col("lag") == lag).select("window_idx", "i", "j", "weight") for e in (test, golden))
    pairs = t.select(F.col("window_idx").alias("a")).distinct().withColumn("b", F.col("a"))
    cells = distance.pair_cells(pairs, t, g)
    out = distance.frobenius(cells).withColumnRenamed("distance", "frobenius").join(distance.structural_hamming(cells, eps), ["a", "b"])
    out = out.join(distance.spectral(cells).withColumnRenamed("distance", "spectral"), ["a", "b"])
    return out.select(F.col("a").alias("window_idx"), "frobenius", F.col("shd").alias("structural_hamming"), "spectral", "max_edge_change", ((F.col("frobenius") + F.col("spectral") + F.col("max_edge_change")) / 3).alias("ensemble_score"))


def learn_graph(rows, p: int, config: Config | None = None):
    """One graph of a frame of numeric columns (pandas): a list of (parent, child, weight), nodes called ``name_lag{k}``."""
    x = rows.to_numpy(dtype=float)
    names = [str(c) for c in rows.columns]
    return [(f"{names[i]}_lag{lag}", f"{names[j]}_lag0", w) for i, j, lag, w in kernel(config or Config(), p)(x)]
