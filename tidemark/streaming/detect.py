"""Windows and the four-state classifier over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.detect import AdaptiveState


def sliding_time(events: DataFrame, size="100 hours", slide="10 hours", late="1 hour", ts="ts", value="value", by=("event_type",)) -> DataFrame:
    """Sliding time windows with a watermark. A timestamp without a zone is taken as UTC, which watermarks need."""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return e.groupBy(F.window("_ts", size, slide), *by).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def classify(scores: DataFrame, key="entity") -> DataFrame:
    """(key, window_idx, abs_score, change_score, abs_trend) as a stream -> states. An entity's history is its state; windows
    of a batch are taken in order, so a stream gives what the batch fold gives as long as they arrive in order."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(k, batches, state):
        a, c = state.get if state.exists else ([], [])
        machine = AdaptiveState(a, c)
        rows = pd.concat(list(batches)).sort_values("window_idx")
        out = [(k[0], int(r.window_idx), float(r.abs_score), *machine.step(float(r.abs_score), float(r.change_score), float(r.abs_trend))) for r in rows.itertuples()]
        state.update((machine.a, machine.c))
        yield pd.DataFrame(out, columns=[key, "window_idx", "abs_score", "status", "threshold_normal", "threshold_change", "threshold_trend"])

    kind = dict(scores.dtypes)[key]
    return scores.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, window_idx int, abs_score double, status string, threshold_normal double, threshold_change double, threshold_trend double",
        "a array<double>, c array<double>", "append", GroupStateTimeout.NoTimeout,
    )
