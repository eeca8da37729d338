"""Thresholds and the classification of windows into four states."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of the states, and the thresholds before there is a history.
NORMAL, ONSET, RECOVERY, CASCADE = "NORMAL", "NEW_ANOMALY_ONSET", "RECOVERY_FLUCTUATION", "CASCADE_OR_PERSISTENT"
FIXED = (0.05, 0.15, 0.1)
HISTORY, LEAST_HISTORY, SIGMAS, TREND_SHARE = 100, 5, 3.0, 0.2
KINDS = (pa.string(), pa.float64(), pa.float64(), pa.float64())


def state(score: Column, change: Column, trend: Column, t_normal: Column, t_change: Column, t_trend: Column, at_threshold=CASCADE) -> Column:
    """A score equal to the threshold isn't normal, unless something else is said."""
    return (
        F.when(score < t_normal, NORMAL).when((change > t_change) & (trend > t_trend), ONSET)
        .when((change > t_change) & (trend < -t_trend), RECOVERY).when(score > t_normal, CASCADE).otherwise(at_threshold)
    )


def fixed_states(scores: DataFrame, thresholds: Sequence[float] = FIXED) -> DataFrame:
    n, c, t = (F.lit(float(x)) for x in thresholds)
    return scores.select("*", state(F.col("abs_score"), F.col("change_score"), F.col("abs_trend"), n, c, t).alias("status"), n.alias("threshold_normal"), c.alias("threshold_change"), t.alias("threshold_trend"))


def golden_thresholds(self_scores: DataFrame, sigmas=SIGMAS, least=1e-3) -> DataFrame:
    """From golden windows' distances to their own baseline: one row of three thresholds."""
    n = F.greatest(F.avg("abs_score") + sigmas * F.stddev_pop("abs_score"), F.lit(least))
    return self_scores.agg(n.alias("threshold_normal")).withColumn("threshold_change", 1.5 * F.col("threshold_normal")).withColumn("threshold_trend", 0.5 * F.col("threshold_normal"))


def static_states(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Each window by itself, against thresholds that don't move; a score equal to the threshold is normal."""
    s = scores.crossJoin(F.broadcast(thresholds))
    return s.withColumn("status", state(F.col("abs_score"), F.col("change_score"), F.col("abs_trend"), F.col("threshold_normal"), F.col("threshold_change"), F.col("threshold_trend"), NORMAL))


class AdaptiveState:
    """The state machine of one entity, one window at a time, for tables and streams."""

    def __init__(self, a: Sequence[float] = (), c: Sequence[float] = (), sigmas=SIGMAS):
        self.a, self.c, self.sigmas = list(a), list(c), sigmas

    def step(self, score: float, change: float, trend: float) -> tuple[str, float, float, float]:
        n, c, t = FIXED
        if len(self.a) >= LEAST_HISTORY:
            n, c = (m + self.sigmas * (sum((v - m) ** 2 for v in h) / len(h)) ** 0.5 for h in (self.a, self.c) for m in [sum(h) / len(h)])
            t = n * TREND_SHARE
        if score < n:
            self.a, self.c = [*self.a, score][-HISTORY:], [*self.c, change][-HISTORY:]
            return NORMAL, n, c, t
        status = ONSET if change > c and trend > t else RECOVERY if change > c and trend < -t else CASCADE
        return status, n, c, t


SCORES = ("abs_score", "change_score", "abs_trend")
THRESHOLDS = ("threshold_normal", "threshold_change", "threshold_trend")


def adaptive_states(scores: DataFrame, by: Sequence[str] = (), sigmas=SIGMAS) -> DataFrame:
    """In the order of windows: thresholds are mean + sigmas x std of the last HISTORY windows that were classified normal,
    fixed ones before there are LEAST_HISTORY.

    A state depends on those before it, so an entity's windows stay together and are sorted; they are read in batches, and of
    an entity only its history is held. Entities are independent of one another; without ``by`` there is one.
    """
    n, by = len(by), list(by)

    def fold(batches):
        entity, machine = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(n)), strict=True)) if n else [()] * batch.num_rows
            out = []
            for key, *row in zip(keys, *(batch.column(n + 1 + k).fill_null(float("nan")).to_pylist() for k in range(len(SCORES))), strict=True):
                if machine is None or key != entity:
                    entity, machine = key, AdaptiveState(sigmas=sigmas)
                out.append(machine.step(*row))
            added = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), KINDS, strict=True)] if out else [pa.array([], kind) for kind in KINDS]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "status", *THRESHOLDS])

    rows = scores.select(*by, "window_idx", *[F.col(c).cast("double").alias(c) for c in SCORES])
    rows = rows.repartition(*by) if by else rows.repartition(1)
    schema = T.StructType([*rows.schema, T.StructField("status", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in THRESHOLDS]])
    return rows.sortWithinPartitions(*by, "window_idx").mapInArrow(fold, schema)


def status_histogram(states: DataFrame) -> DataFrame:
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return states.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(whole))


def anomaly_span(states: DataFrame) -> DataFrame:
    odd = states.where(F.col("status") != NORMAL)
    return odd.agg(F.count(F.lit(1)).alias("n"), F.min("window_idx").alias("first"), F.max("window_idx").alias("last"))


def vote_of_metrics(scores: DataFrame, metrics: Sequence[str], reference: DataFrame, k=2, sigmas=SIGMAS) -> DataFrame:
    """Anomalous if k metrics or more are above mean + sigmas x std of theirs in the reference."""
    limits = reference.agg(*[(F.avg(m) + sigmas * F.stddev_pop(m)).alias(f"_{m}") for m in metrics])
    votes = sum(((F.col(m) > F.col(f"_{m}")).cast("int") for m in metrics[1:]), (F.col(metrics[0]) > F.col(f"_{metrics[0]}")).cast("int"))
    return scores.crossJoin(F.broadcast(limits)).withColumn("votes", votes).withColumn("is_anomaly", F.col("votes") >= k).drop(*[f"_{m}" for m in metrics])


#: Classes of labelled anomalies and the types they may be.
TAXONOMY = {"point": ("spike",), "contextual": ("drift", "level_shift", "trend_change", "amplitude_change")}


def type_of_class(labels: DataFrame, column="class") -> DataFrame:
    types = F.create_map(*[x for k, v in TAXONOMY.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return labels.withColumn("types", F.coalesce(F.try_element_at(types, F.col(column)), F.array().cast("array<string>")))
