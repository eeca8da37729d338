"""Cleaning, detrending, standardising and lagging of series in long form: (t, var, value), optionally by further keys.

Every operator partitions by the variable (and the keys in ``by``); only those that need all variables of a row
at once group by t.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def clean(value: Column) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(value), value)


def forward_fill(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(*by, "var").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn("value", F.last(clean(F.col("value")), ignorenulls=True).over(w))


def drop_incomplete(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Drops each t at which any variable has no value. A grouped count and a semi-join, no cross product."""
    gaps = series.where(clean(F.col("value")).isNull()).select(*by, "t").distinct()
    return series.join(gaps, [*by, "t"], "left_anti")


def positivity_shift(series: DataFrame, by: Sequence[str] = (), eps=1e-10) -> DataFrame:
    """Adds ``shift``: what makes a variable's least value positive."""
    low = F.min("value").over(Window.partitionBy(*by, "var"))
    return series.withColumn("shift", F.when(low <= 0, F.abs(low) + F.lit(eps)).otherwise(F.lit(eps)))


def log_shift(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return positivity_shift(series, by).withColumn("value", F.log1p(F.col("value") + F.col("shift")))


def median_trend(series: DataFrame, by: Sequence[str] = (), frame=60) -> DataFrame:
    """Adds ``trend``: the median of the ``frame`` rows before; the first row's own value where there are none."""
    w = Window.partitionBy(*by, "var").orderBy("t").rowsBetween(-frame, -1)
    return series.withColumn("trend", F.coalesce(F.percentile("value", F.lit(0.5)).over(w), F.col("value")))


def detrend(series: DataFrame, by: Sequence[str] = (), frame=60) -> DataFrame:
    return median_trend(series, by, frame).withColumn("value", F.col("value") - F.col("trend")).drop("trend")


def constant_guard(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per variable: n, std, and whether it can be tested at all."""
    out = series.groupBy(*by, "var").agg(F.count("value").alias("n"), F.stddev_pop("value").alias("std"))
    return out.withColumn("usable", (F.col("n") > 0) & (F.coalesce("std", F.lit(0.0)) > 0))


def standardise(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(*by, "var")
    std = F.stddev_pop("value").over(w)
    return series.withColumn("value", (F.col("value") - F.avg("value").over(w)) / F.when(std == 0, F.lit(1.0)).otherwise(std))


def stationary_vars(tests: DataFrame, alpha=0.05) -> DataFrame:
    """tests (var, adf_p, kpss_p) -> the variables that pass both tests, or all if none does."""
    passes = (F.coalesce(F.col("adf_p") < alpha, F.lit(False))) & (F.coalesce(F.col("kpss_p") > alpha, F.lit(False)))
    n = F.sum(passes.cast("int")).over(Window.orderBy(F.lit(1)).rowsBetween(*ALL))
    return tests.withColumn("_p", passes).withColumn("_n", n).where("_p or _n = 0").drop("_p", "_n")


def ljung_box(series: DataFrame, by: Sequence[str] = (), lags=10) -> DataFrame:
    """Per variable Q at ``lags`` and its p-value (even ``lags``: the chi-square tail is a finite sum)."""
    if lags % 2:
        raise ValueError("the closed form of the tail needs an even number of lags")
    w, order = Window.partitionBy(*by, "var"), Window.partitionBy(*by, "var").orderBy("t")
    e = F.col("value") - F.avg("value").over(w)
    rows = series.withColumn("_e", e)
    rows = rows.select(*by, "var", "_e", *[F.lag("_e", k).over(order).alias(f"_l{k}") for k in range(1, lags + 1)])
    sums = rows.groupBy(*by, "var").agg(F.count("_e").alias("n"), F.sum(F.col("_e") ** 2).alias("_s"), *[F.sum(F.col("_e") * F.col(f"_l{k}")).alias(f"_c{k}") for k in range(1, lags + 1)])
    n = F.col("n")
    q = n * (n + 2) * sum(((F.col(f"_c{k}") / F.col("_s")) ** 2 / (n - k) for k in range(2, lags + 1)), (F.col("_c1") / F.col("_s")) ** 2 / (n - 1))
    out = sums.withColumn("q", q)
    half, term, tail = F.col("q") / 2, F.lit(1.0), F.lit(1.0)
    for k in range(1, lags // 2):
        term = term * half / k
        tail = tail + term
    return out.select(*by, "var", "n", "q", (F.exp(-half) * tail).alias("p"))


def ar1_fit(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per variable the least-squares line of a value on the one before."""
    order = Window.partitionBy(*by, "var").orderBy("t")
    rows = series.withColumn("_x", F.lag("value").over(order)).where("_x is not null")
    return rows.groupBy(*by, "var").agg(F.regr_intercept("value", "_x").alias("const"), F.regr_slope("value", "_x").alias("phi"), F.count("_x").alias("n"))


def provided_lags(lags: DataFrame, variables: DataFrame, default=1) -> DataFrame:
    """Optimal lags given with the data, for every variable; ``default`` where none is."""
    return variables.select("variable").join(lags.select("variable", "optimal_lag"), "variable", "left").withColumn("optimal_lag", F.coalesce("optimal_lag", F.lit(default)).cast("int"))


def override_lags(variables: DataFrame, lag=5) -> DataFrame:
    return variables.select("variable", F.lit(lag).cast("int").alias("optimal_lag"))


def lag_order(lags: DataFrame) -> DataFrame:
    return lags.agg(F.max("optimal_lag").alias("p"))


def validate_series(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per variable: rows, nulls, times that don't increase, and whether all is well."""
    order = Window.partitionBy(*by, "var").orderBy("pos")
    rows = series.withColumn("_back", (F.col("t") <= F.lag("t").over(order)).cast("int"))
    out = rows.groupBy(*by, "var").agg(F.count(F.lit(1)).alias("n"), F.sum(clean(F.col("value")).isNull().cast("int")).alias("n_missing"), F.coalesce(F.sum("_back"), F.lit(0)).alias("n_unordered"))
    return out.withColumn("valid", (F.col("n") > 0) & (F.col("n_missing") == 0) & (F.col("n_unordered") == 0))


def dedupe_renumber(series: DataFrame, by: Sequence[str] = (), order: str = "pos") -> DataFrame:
    """Of rows that repeat a t the first by ``order`` stays; times are then numbered from 0."""
    first = Window.partitionBy(*by, "var", "t").orderBy(order)
    kept = series.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return kept.withColumn("t", (F.row_number().over(Window.partitionBy(*by, "var").orderBy("t")) - 1).cast("long")).drop("_r")


def cut_discontinuities(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``realisation_id``, which goes up by one where t jumps by more than one."""
    order = Window.partitionBy(*by, "var").orderBy("t")
    jump = F.when(F.col("t") - F.lag("t").over(order) > 1, 1).otherwise(0)
    return series.withColumn("_j", jump).withColumn("realisation_id", F.sum("_j").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_j")


def lag_embed(series: DataFrame, p: int, by: Sequence[str] = ("realisation_id",)) -> DataFrame:
    """Adds lag1 .. lagp; the first p rows of each realisation go."""
    order = Window.partitionBy(*by, "var").orderBy("t")
    out = series.select("*", F.row_number().over(order).alias("_n"), *[F.lag("value", k).over(order).alias(f"lag{k}") for k in range(1, p + 1)])
    return out.where(F.col("_n") > p).drop("_n")


def lag_embed_zero(series: DataFrame, p: int, by: Sequence[str] = ()) -> DataFrame:
    """Adds lag1 .. lagp, 0 before the beginning; all rows stay. The order p must be less than the rows."""
    order = Window.partitionBy(*by, "var").orderBy("t")
    return series.select("*", *[F.coalesce(F.lag("value", k).over(order), F.lit(0.0)).alias(f"lag{k}") for k in range(1, p + 1)])


def labelled_lags(series: DataFrame, variables: Sequence[str], p: int) -> DataFrame:
    """Wide: t and ``{var}_lag{k}``, k from 0 to p, for the given variables; rows without all of them go."""
    wide = series.groupBy("t").pivot("var", list(variables)).agg(F.first("value"))
    order = Window.orderBy("t")
    cols = [F.lag(v, k).over(order).alias(f"{v}_lag{k}") if k else F.col(v).alias(f"{v}_lag0") for k in range(p + 1) for v in variables]
    return wide.select("t", *cols).na.drop("any")


def finite(series: DataFrame) -> DataFrame:
    v, inf = F.col("value"), float("inf")
    return series.withColumn("value", F.when(v.isNull() | F.isnan(v) | (v == F.lit(inf)) | (v == F.lit(-inf)), F.lit(0.0)).otherwise(v))


def positional_split(times: DataFrame, parts: Sequence[tuple[str, float]], by: Sequence[str] = ()) -> DataFrame:
    """times (t) -> ``part``: by position, each part its share of the rows (floors), the last the rest."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    at, n = F.row_number().over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy("t")) - 1, F.count(F.lit(1)).over(w)
    rows, share, part = times.withColumn("_at", at).withColumn("_n", n), 0.0, F.lit(parts[-1][0])
    bounds = []
    for name, size in parts[:-1]:
        share += size
        bounds.append((name, F.floor(F.lit(round(share, 9)) * F.col("_n") + 1e-9)))
    for name, bound in reversed(bounds):
        part = F.when(F.col("_at") < bound, F.lit(name)).otherwise(part)
    return rows.withColumn("part", part).drop("_at", "_n")


def k_fold(times: DataFrame, k: int, seed=42) -> DataFrame:
    """Adds ``fold`` by a hash of t: each row's fold depends on nothing else."""
    return times.withColumn("fold", F.pmod(F.xxhash64("t", F.lit(seed)), F.lit(k)).cast("int"))


def subsample(times: DataFrame, n: int, seed=42) -> DataFrame:
    return times.orderBy(F.xxhash64("t", F.lit(seed)), "t").limit(n)


def contiguous_block(times: DataFrame, start: int, n: int) -> DataFrame:
    return times.where((F.col("t") >= start) & (F.col("t") < start + n))


def prepared(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Fill, drop, log, detrend and standardise: what the estimators take."""
    filled = drop_incomplete(forward_fill(series, by), by)
    return standardise(detrend(log_shift(filled, by).drop("shift"), by), by)
