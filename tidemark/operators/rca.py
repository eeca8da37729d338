"""Root causes: which variables' edges changed, and whether labels agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.detect import NORMAL


def top_anomalies(states: DataFrame, n=5) -> DataFrame:
    return states.where(F.col("status") != NORMAL).orderBy(F.desc("abs_score"), "window_idx").limit(n)


def root_effect(test: DataFrame, baseline: DataFrame, windows: DataFrame, lag=0) -> DataFrame:
    """Per window: the source whose outgoing edges changed most, the target whose incoming did, and the edge that did, with its
    signed change. Of equals the lowest id."""
    t = test.where(F.col("lag") == lag).join(windows.select("window_idx").distinct(), "window_idx", "left_semi").select("window_idx", "i", "j", F.col("weight").alias("x"), F.lit(0.0).alias("y"))
    b = baseline.select("i", "j", F.lit(0.0).alias("x"), F.col("weight").alias("y")).crossJoin(windows.select("window_idx").distinct())
    d = t.unionByName(b.select("window_idx", "i", "j", "x", "y")).groupBy("window_idx", "i", "j").agg((F.sum("x") - F.sum("y")).alias("delta"))
    size = F.round(F.abs("delta"), 12)
    out = d.groupBy("window_idx", "i").agg(F.round(F.sum(size), 9).alias("s")).groupBy("window_idx").agg(F.min_by("i", F.struct(-F.col("s"), "i")).alias("root"))
    into = d.groupBy("window_idx", "j").agg(F.round(F.sum(size), 9).alias("s")).groupBy("window_idx").agg(F.min_by("j", F.struct(-F.col("s"), "j")).alias("effect"))
    edge = d.groupBy("window_idx").agg(F.min_by(F.struct("i", "j", "delta"), F.struct(-F.round(size, 9), "i", "j")).alias("e"))
    return out.join(into, "window_idx").join(edge, "window_idx").select("window_idx", "root", "effect", F.concat_ws("->", F.col("e.i").cast("string"), F.col("e.j").cast("string")).alias("edge"), F.col("e.delta").alias("edge_change"))


def strengths(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, node, s_in, s_out): sums of weights by target and by source."""
    both = edges.select(*keys, F.explode(F.array(F.struct(F.col("j").alias("node"), F.col("weight").alias("a"), F.lit(0.0).alias("b")), F.struct(F.col("i").alias("node"), F.lit(0.0).alias("a"), F.col("weight").alias("b")))).alias("e"))
    return both.groupBy(*keys, "e.node").agg(F.sum("e.a").alias("s_in"), F.sum("e.b").alias("s_out"))


def strength_ranking(edges: DataFrame, golden: DataFrame, windows: DataFrame, d: int, per_window=False) -> DataFrame:
    """Per window every node 0 .. d-1 by |in - golden in| + |out - golden out|, descending, lower ids first among equals.

    Golden strengths are sums over all golden windows, or their mean per window if asked; windows without edges are left out.
    """
    spark = edges.sparkSession
    own = strengths(edges.join(windows.select("window_idx").distinct(), "window_idx", "left_semi"), ["window_idx"])
    n = golden.select("window_idx").distinct().count() if per_window else 1
    base = strengths(golden).select("node", (F.col("s_in") / n).alias("g_in"), (F.col("s_out") / n).alias("g_out"))
    nodes = spark.range(d).select(F.col("id").cast("int").alias("node"))
    grid = own.select("window_idx").distinct().crossJoin(F.broadcast(nodes))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = F.abs(z("s_in") - z("g_in")) + F.abs(z("s_out") - z("g_out"))
    out = grid.join(own, ["window_idx", "node"], "left").join(F.broadcast(base), "node", "left").select("window_idx", "node", score.alias("score"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("window_idx").orderBy(F.desc(F.round("score", 9)), "node")))


def recall_at(ranking: DataFrame, events: DataFrame, ks: Sequence[int] = (1, 3, 5), dim_base=1, stride=10, missing=999) -> DataFrame:
    """events (start, dims): share of culprits ranked among the first k in the window that begins with the event, and their mean rank."""
    e = events.select(F.floor(F.col("start") / F.lit(stride)).cast("int").alias("window_idx"), F.explode("dims").alias("dim"))
    e = e.join(ranking.select("window_idx").distinct(), "window_idx", "left_semi").withColumn("node", F.col("dim") - dim_base)
    r = e.join(ranking.select("window_idx", "node", "rank"), ["window_idx", "node"], "left").withColumn("rank", F.coalesce("rank", F.lit(missing)))
    return r.agg(F.count(F.lit(1)).alias("n"), *[F.avg((F.col("rank") <= k).cast("double")).alias(f"recall_at_{k}") for k in ks], F.avg("rank").alias("mean_rank"))


def top1_accuracy(predictions: DataFrame, events: DataFrame, size=100, stride=10, dim_base=1) -> DataFrame:
    """predictions (window_idx, root): of those whose window overlaps an event, the share whose root is one of its dims.

    Events are spread over the windows that they touch and joined by id.
    """
    p = predictions.join(event_windows(events, size, stride), "window_idx")
    p = p.groupBy("window_idx", "root").agg(F.max(F.array_contains("dims", F.col("root") + dim_base)).alias("hit"))
    return p.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hit").cast("int")).alias("correct"), F.avg(F.col("hit").cast("double")).alias("accuracy"))


def event_windows(events: DataFrame, size=100, stride=10) -> DataFrame:
    """(event_id, start, end, dims, window_idx): each window [s, s + size) that overlaps the half-open event."""
    first = F.greatest(F.lit(0), F.floor((F.col("start") - size) / F.lit(stride)) + 1).cast("int")
    last = (F.ceil(F.col("end") / F.lit(stride)) - 1).cast("int")
    return events.where(F.col("start") < F.col("end")).withColumn("window_idx", F.explode(F.when(first <= last, F.sequence(first, last))))


def macro_accuracy(counts: DataFrame) -> DataFrame:
    """(entity, n, correct): accuracy over all, and the mean of the entities' own."""
    return counts.agg((F.sum("correct") / F.sum("n")).alias("global_accuracy"), F.avg(F.col("correct") / F.col("n")).alias("macro_accuracy"))


def counterfactual(series: DataFrame, edges: DataFrame, replaced: DataFrame, d: int) -> DataFrame:
    """Per window the series that the graph gives if its instantaneous edges are replaced by the baseline's.

    x_t = (sum over lags of A_k' x_(t-k)) (I - W)^-1, forward from the window's first rows.
    """
    import numpy as np
    import pandas as pd

    rows = series.select("window_idx", "t", F.col("var_idx").alias("i"), F.lit(-1).alias("j"), F.lit(-1).alias("lag"), "value")
    own = edges.where("lag > 0").select("window_idx", F.lit(-1).cast("long").alias("t"), "i", "j", "lag", F.col("weight").alias("value"))
    base = replaced.select("i", "j", F.col("weight").alias("value")).crossJoin(series.select("window_idx").distinct())
    base = base.select("window_idx", F.lit(-1).cast("long").alias("t"), "i", "j", F.lit(0).alias("lag"), "value")

    def simulate(key, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows[rows.lag < 0].pivot(index="t", columns="i", values="value").sort_index()
        w, a = np.zeros((d, d)), {}
        for e in rows[rows.lag >= 0].itertuples():
            (w if e.lag == 0 else a.setdefault(int(e.lag), np.zeros((d, d))))[int(e.i), int(e.j)] = e.value
        out, p, inverse = x.to_numpy().copy(), max(a, default=0), np.linalg.pinv(np.eye(d) - w)
        for t in range(p, len(out)):
            out[t] = sum((out[t - k] @ m for k, m in a.items()), np.zeros(d)) @ inverse
        return pd.DataFrame([(key[0], int(t), int(v), float(out[r, c])) for r, t in enumerate(x.index) for c, v in enumerate(x.columns)], columns=["window_idx", "t", "var_idx", "value"])

    return rows.unionByName(own).unionByName(base).groupBy("window_idx").applyInPandas(simulate, "window_idx int, t long, var_idx int, value double")
