"""Ensembles of edge tables: (run_id, window_idx, i, j, lag, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.learn import EDGE


def mean_absent_zero(runs: DataFrame, n_runs: int) -> DataFrame:
    """Edges that a run lacks count as 0 in it."""
    return runs.groupBy(*EDGE).agg((F.sum("weight") / n_runs).alias("weight"))


def mean_present(runs: DataFrame) -> DataFrame:
    return runs.groupBy(*EDGE).agg(F.avg("weight").alias("weight"))


def vote(runs: DataFrame, n_runs: int, share=0.5, eps: float | None = None) -> DataFrame:
    """Edges that ``share`` of the runs have, their mean over those; with eps, only weights above it are votes."""
    votes = F.count(F.lit(1)) if eps is None else F.count_if(F.abs("weight") > eps)
    out = runs.groupBy(*EDGE).agg(F.avg("weight").alias("weight"), votes.alias("_v"))
    return out.where(F.col("_v") >= n_runs * share).drop("_v")


def support(runs: DataFrame, n_runs: int, eps=1e-3) -> DataFrame:
    return runs.groupBy(*EDGE).agg((F.count_if(F.abs("weight") > eps) / n_runs).alias("support"))


def stability(runs: DataFrame, d: int, least_runs=5, most_runs=20) -> DataFrame:
    """exp(-mean population variance over runs) of the summed absolute weights of each of the d x d cells, absent ones 0.

    Cells that no run has vary by 0, so they only enter the count; no dense grid is made.
    """
    first = runs.select("run_id").distinct().orderBy("run_id").limit(most_runs)
    used = runs.join(first, "run_id", "left_semi")
    n = first.agg(F.count(F.lit(1)).alias("n"))
    cells = used.groupBy("run_id", "i", "j").agg(F.sum(F.abs("weight")).alias("w"))
    there = cells.groupBy("i", "j").agg(F.count(F.lit(1)).alias("m"), F.avg("w").alias("mean"), F.var_pop("w").alias("v")).crossJoin(F.broadcast(n))
    share = F.col("m") / F.col("n")
    var = share * F.col("v") + share * (1 - share) * F.col("mean") ** 2  # the runs without the cell are zeros
    return there.agg(F.exp(-F.sum(var) / (d * d)).alias("stability"), F.max("n").alias("n_runs")).where(F.col("n_runs") >= least_runs)


def runs_of(windows: DataFrame, n_runs: int) -> DataFrame:
    """Every window once per run: one job for all runs, each with its own seed."""
    return windows.withColumn("run_id", F.explode(F.sequence(F.lit(0), F.lit(n_runs - 1)))).withColumn("seed", F.xxhash64("run_id", "window_idx"))
