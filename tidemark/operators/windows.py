"""Count-based sliding windows, their places in time, and lookups between the two."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, STRIDE = 100, 10


def n_windows(n_rows: Column, size=SIZE, stride=STRIDE) -> Column:
    return F.greatest(F.lit(0), F.floor((n_rows - size) / F.lit(stride)) + 1).cast("int")


def window_ids(t: Column, n_rows: Column, size=SIZE, stride=STRIDE) -> Column:
    """Ids of the windows that hold row t: arithmetic on the row alone, an explode in place of a range join."""
    first = F.greatest(F.lit(0), F.ceil((t - size + 1) / F.lit(stride))).cast("int")
    last = F.least(n_windows(n_rows, size, stride) - 1, F.floor(t / F.lit(stride))).cast("int")
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def sliding(series: DataFrame, size=SIZE, stride=STRIDE, by: Sequence[str] = ()) -> DataFrame:
    """Every row once per window that holds it; the tail that fills no window goes. t counts from 0 without gaps."""
    n = series.groupBy(*by).agg((F.max("t") + 1).alias("_n")) if by else series.agg((F.max("t") + 1).alias("_n"))
    rows = series.join(F.broadcast(n), list(by)) if by else series.crossJoin(F.broadcast(n))
    return rows.withColumn("window_idx", F.explode(window_ids(F.col("t"), F.col("_n"), size, stride))).drop("_n")


def window_meta(windows: DataFrame, size=SIZE, stride=STRIDE) -> DataFrame:
    start = F.col("window_idx").cast("long") * stride
    return windows.select("*", start.alias("t_start"), (start + size - 1).alias("t_end"), (start + size // 2).alias("t_center"))


def first_meta(rows: DataFrame, *columns: str) -> DataFrame:
    """Per window the metadata of its first row, the window's id where there is none."""
    return rows.groupBy("window_idx").agg(*[F.coalesce(F.min_by(c, "t"), F.col("window_idx")).alias(c) for c in columns])


def window_of(t: Column, start=0, stride=STRIDE) -> Column:
    """Last window that begins at t or before; an error for a point before the first."""
    return F.when(F.assert_true(t >= start, F.lit("a point before the first window")).isNull(), F.floor((t - start) / F.lit(stride)).cast("int"))


def common_span(windows: DataFrame, lag=0, size=SIZE) -> DataFrame:
    """windows (start): the overlap of all of them and their union, as half-open ranges moved on by the lag."""
    s = F.col("start") + lag
    return windows.agg(F.max(s).alias("overlap_start"), F.min(s + size).alias("overlap_end"), F.min(s).alias("union_start"), F.max(s + size).alias("union_end"))


def windows_with(points: DataFrame, windows: DataFrame, size=SIZE, stride=STRIDE) -> DataFrame:
    """points (t), windows (window_idx): pairs of a point and a window that holds it. Equality on ids, no range join."""
    ids = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("t") - size + 1) / F.lit(stride))).cast("int"), F.floor(F.col("t") / F.lit(stride)).cast("int"))
    return points.withColumn("window_idx", F.explode(ids)).join(windows, "window_idx", "left_semi")


def not_done(windows: DataFrame, done: DataFrame, most: int | None = None) -> DataFrame:
    """Windows still to be worked on, the lowest ``most`` of them."""
    rest = windows.join(done.select("window_idx").distinct(), "window_idx", "left_anti")
    return rest if most is None else rest.orderBy("window_idx").limit(most)


def tumbling(windows: DataFrame, size=20) -> DataFrame:
    return windows.withColumn("chunk", F.floor(F.col("window_idx") / size).cast("int"))
