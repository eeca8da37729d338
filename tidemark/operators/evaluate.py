"""Detections against labels: by point, by window and by event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.detect import CASCADE, NORMAL, ONSET
from tidemark.operators.graph import scored
from tidemark.operators.rca import event_windows
from tidemark.operators.windows import SIZE, STRIDE, sliding


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f1_of(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def window_labels(points: DataFrame, size=SIZE, stride=STRIDE) -> DataFrame:
    """points (t, label): 1 for a full window that holds any positive point."""
    return sliding(points, size, stride).groupBy("window_idx").agg(F.max("label").cast("int").alias("label"))


#: Places of t that are looked at together when runs are sought.
SPAN = 1 << 20


def segments(points: DataFrame, t="t", by: Sequence[str] = (), span=SPAN) -> DataFrame:
    """Runs of positive points, both ends included, per entity. Runs are found range by range; only those that touch the end of a
    range, at most two of each, are then put together."""
    c = F.floor(F.col(t) / span)
    inside = Window.partitionBy(*by, "_c").orderBy(t)
    on = points.where("label = 1").withColumn("_c", c).withColumn("_g", F.col(t) - F.row_number().over(inside))
    runs = on.groupBy(*by, "_c", "_g").agg(F.min(t).alias("start"), F.max(t).alias("end")).drop("_c", "_g")
    touches = (F.pmod("start", F.lit(span)) == 0) | (F.pmod(F.col("end") + 1, F.lit(span)) == 0)
    w = Window.partitionBy(*by).orderBy("start")
    new = F.coalesce((F.lag("end").over(w) + 1 != F.col("start")).cast("int"), F.lit(1))
    joined = runs.where(touches).withColumn("_n", new).withColumn("_s", F.sum("_n").over(w)).groupBy(*by, "_s").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.where(~touches).unionByName(joined.drop("_s"))


def segment_ids(points: DataFrame, by: Sequence[str] = (), span=SPAN) -> DataFrame:
    """Adds ``segment``: a number for each run of positive points of an entity, null outside. Runs are numbered range by range; a
    range adds the runs before it, less one if its first run began in the range before."""
    on = F.coalesce(F.col("label") == 1, F.lit(False)).cast("int")
    w = Window.partitionBy(*by, "_c").orderBy("t")
    rows = points.withColumn("_c", F.coalesce(F.floor(F.col("t") / span), F.lit(-(2**62)))).withColumn("_l", on)
    rows = rows.withColumn("_b", F.greatest(F.col("_l") - F.coalesce(F.lag("_l").over(w), F.lit(0)), F.lit(0)))
    rows = rows.withColumn("_s", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy(*by, "_c").agg(F.sum("_b").alias("_n"), F.min_by("_l", F.struct("t", "_s")).alias("_first"), F.max_by("_l", F.struct("t", "_s")).alias("_last"))
    order = Window.partitionBy(*by).orderBy("_c")
    ends = ends.withColumn("_j", F.col("_first") * F.coalesce(F.lag("_last").over(order), F.lit(0)))
    base = F.sum(F.col("_n") - F.col("_j")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    ends = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*by, "_c"])], base.alias("_base"))
    same = [F.col(f"_k{i}").eqNullSafe(F.col(k)) for i, k in enumerate([*by, "_c"])]
    segment = F.when(F.col("_l") == 1, F.col("_s") + F.col("_base")).alias("segment")
    return rows.join(ends, same).select(*points.columns, segment)


def dense_scores(scores: DataFrame, n: int) -> DataFrame:
    """Every window 0 .. n-1, 0 where there is no score."""
    ids = scores.sparkSession.range(n).select(F.col("id").cast("int").alias("window_idx"))
    return ids.join(scores.select("window_idx", "abs_score"), "window_idx", "left").withColumn("abs_score", F.coalesce("abs_score", F.lit(0.0)))


def confusion(pred: Column, truth: Column) -> list[Column]:
    return [F.count_if(pred & truth).alias("tp"), F.count_if(pred & ~truth).alias("fp"), F.count_if(~pred & truth).alias("fn"), F.count_if(~pred & ~truth).alias("tn")]


def window_prf(states: DataFrame, labels: DataFrame, positive: Sequence[str] = (ONSET, CASCADE)) -> DataFrame:
    """Precision, recall and F1 over windows; recoveries don't count as positive unless they are named."""
    j = labels.join(states.select("window_idx", "status"), "window_idx", "left")
    return scored(j.agg(*confusion(F.coalesce(F.col("status").isin(*positive), F.lit(False)), F.col("label") == 1)))


def window_confusion(states: DataFrame, labels: DataFrame) -> DataFrame:
    j = labels.join(states.select("window_idx", "status"), "window_idx")
    out = j.agg(*confusion(F.col("status") != NORMAL, F.col("label") == 1))
    return out.withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))


def pr_curve(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(score, label) -> per distinct score, downwards: tp, fp, precision, recall. Rows are summed by score before they are ranked,
    each entity's scores for themselves."""
    summed = rows.groupBy(*by, "score").agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = summed.withColumn("tp", F.sum("p").over(w)).withColumn("seen", F.sum("n").over(w)).withColumn("all", F.sum("p").over(whole))
    return out.select(*by, "score", "tp", (F.col("seen") - F.col("tp")).alias("fp"), (F.col("tp") / F.col("seen")).alias("precision"), ratio(F.col("tp"), F.col("all")).alias("recall"))


def auc_pr(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trapezoids under the precision-recall curve, from recall 0 at precision 1 on."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"))
    r0, p0 = F.coalesce(F.lag("recall").over(w), F.lit(0.0)), F.coalesce(F.lag("precision").over(w), F.lit(1.0))
    area = pr_curve(rows, by).select(*by, ((F.col("recall") - r0) * (F.col("precision") + p0) / 2).alias("_a"))
    return area.groupBy(*by).agg(F.sum("_a").alias("auc_pr"))


def average_precision(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    r0 = F.coalesce(F.lag("recall").over(Window.partitionBy(*by).orderBy(F.desc("score"))), F.lit(0.0))
    return pr_curve(rows, by).select(*by, ((F.col("recall") - r0) * F.col("precision")).alias("_a")).groupBy(*by).agg(F.sum("_a").alias("average_precision"))


def best_of(rows: DataFrame, by: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each entity, or of all."""
    if not by:
        return rows.orderBy(*order).limit(1)
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")


def max_f1(rows: DataFrame, eps=1e-8, by: Sequence[str] = ()) -> DataFrame:
    """Best F1 of the curve and its score; of equals the highest score."""
    p, r = F.col("precision"), F.col("recall")
    return best_of(pr_curve(rows, by).withColumn("f1", 2 * p * r / (p + r + eps)), by, F.desc(F.round("f1", 9)), F.desc("score"))


def linear_thresholds(scores: DataFrame, n=100, column="score", by: Sequence[str] = ()) -> DataFrame:
    span = scores.groupBy(*by).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    rows = span.withColumn("k", F.explode(F.when(F.col("lo") == F.col("hi"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(n - 1)))))
    return rows.select(*by, "k", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / (n - 1)).alias("threshold"))


def percentile_thresholds(scores: DataFrame, low: float, high: float, n: int, column="score") -> DataFrame:
    share = [(low + (high - low) * k / (n - 1)) / 100 for k in range(n)]
    return scores.agg(F.percentile(column, F.array(*map(F.lit, share))).alias("a")).select(F.explode("a").alias("threshold")).distinct()


def adjusted(points: DataFrame, thresholds: DataFrame, strict=False, by: Sequence[str] = ()) -> DataFrame:
    """points (t, score, label) x thresholds -> tp, fp, fn after point adjustment: a segment that is hit once is hit throughout.

    Points are first summed by segment: a threshold needs of one only its highest score and its length. With ``by``, an entity
    has its own thresholds, found by its keys (null keys have none).
    """
    hit = (lambda s: s > F.col("threshold")) if strict else (lambda s: s >= F.col("threshold"))
    ids = segment_ids(points, by)
    seg = ids.where("segment is not null").groupBy(*by, "segment").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n"))
    rest = ids.where("segment is null").groupBy(*by, "score").agg(F.count(F.lit(1)).alias("n"))
    rows = seg.select(*by, "score", "n", F.lit(1).alias("label")).unionByName(rest.select(*by, "score", "n", F.lit(0).alias("label")))
    c = (rows.join(thresholds, list(by)) if by else rows.crossJoin(thresholds)).groupBy(*thresholds.columns)
    on, yes = hit(F.col("score")), F.col("label") == 1
    n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return scored(c.agg(n(on & yes).alias("tp"), n(on & ~yes).alias("fp"), n(~on & yes).alias("fn")))


def best_adjusted(points: DataFrame, n=100, by: Sequence[str] = ()) -> DataFrame:
    """Best F1 over even thresholds, the first of equals; all 0 if none is above 0."""
    return best_of(adjusted(points, linear_thresholds(points, n, by=by), by=by), by, F.desc(F.round("f1", 9)), F.col("threshold"))


def adjusted_latency(points: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Adjustment from a segment's first hit on, backwards too but for the point at 0; the mean of points filled in backwards."""
    ids = segment_ids(points, by).withColumn("pred", F.col("score") > threshold)
    seg = Window.partitionBy(*by, "segment")
    first = F.min(F.when(F.col("pred") & F.col("segment").isNotNull(), F.col("t"))).over(seg)
    rows = ids.withColumn("_f", F.when(F.col("segment").isNotNull(), first)).withColumn("_s", F.min("t").over(seg))
    back = F.col("_f").isNotNull() & (F.col("t") < F.col("_f")) & (F.col("t") > 0)
    after = F.col("_f").isNotNull() & (F.col("t") >= F.col("_f"))
    rows = rows.withColumn("adjusted", F.col("pred") | after | back).withColumn("_late", (back & ~F.col("pred")).cast("int"))
    c = rows.groupBy(*by).agg(*confusion(F.col("adjusted"), F.col("label") == 1)[:3], F.sum("_late").alias("_l"), F.countDistinct(F.when(F.col("_f").isNotNull(), F.col("segment"))).alias("_n"))
    return scored(c).withColumn("latency", F.col("_l") / (F.col("_n") + 1e-4)).drop("_l", "_n")


def event_ranges(events: DataFrame, size=250, stride=STRIDE, extra=2) -> DataFrame:
    """(event_id, lo, hi): windows [max(0, int((start - size) / stride)), int(end / stride) + extra], truncated."""
    lo = F.greatest(F.lit(0), ((F.col("start") - size) / F.lit(stride)).cast("int"))
    return events.select("event_id", lo.alias("lo"), ((F.col("end") / F.lit(stride)).cast("int") + extra).alias("hi"))


def range_windows(events: DataFrame, size=250, stride=STRIDE, extra=2, inclusive=True) -> DataFrame:
    r = event_ranges(events, size, stride, extra)
    return r.withColumn("window_idx", F.explode(F.sequence("lo", F.col("hi") if inclusive else F.col("hi") - 1))).select("event_id", "window_idx")


def range_f1(scores: DataFrame, events: DataFrame, thresholds: DataFrame, size=250, stride=STRIDE) -> DataFrame:
    """Per threshold: recall of events, precision of windows above it. Scores are reduced to one per event before the sweep."""
    near = range_windows(events, size, stride)
    top = near.join(scores, "window_idx", "left").groupBy("event_id").agg(F.max("abs_score").alias("top"))
    rec = top.crossJoin(F.broadcast(thresholds)).groupBy("threshold").agg(F.avg(F.coalesce((F.col("top") > F.col("threshold")).cast("double"), F.lit(0.0))).alias("recall"))
    inside = scores.join(near.select("window_idx").distinct().withColumn("_in", F.lit(1)), "window_idx", "left")
    pre = inside.crossJoin(F.broadcast(thresholds)).where("abs_score > threshold").groupBy("threshold").agg(F.avg(F.coalesce("_in", F.lit(0)).cast("double")).alias("precision"))
    out = rec.join(pre, "threshold")
    return out.withColumn("f1", f1_of(F.col("precision"), F.col("recall")))


def event_f1(states: DataFrame, events: DataFrame, size=SIZE, stride=STRIDE) -> DataFrame:
    """Events hit by an anomalous window that overlaps them, and anomalous windows that overlap an event. Windows are marked once, with one
    join by id; events and windows then are one table that is summed."""
    odd = states.select("window_idx", (F.col("status") != NORMAL).alias("odd"))
    near = event_windows(events, size, stride).select("event_id", "window_idx")
    marked = near.join(odd.where("odd"), "window_idx", "full").select("event_id", "window_idx", F.coalesce("odd", F.lit(False)).alias("odd"))
    by_event = marked.where("event_id is not null").groupBy("event_id").agg(F.max("odd").alias("hit"))
    by_window = marked.where("odd").groupBy("window_idx").agg((F.count("event_id") > 0).alias("true"))
    rows = by_event.select(F.lit(0).alias("e"), F.lit(0).alias("w"), F.col("hit").cast("int").alias("h"), F.lit(0).alias("t"))
    rows = rows.unionByName(by_window.select(F.lit(0).alias("e"), F.lit(1).alias("w"), F.lit(0).alias("h"), F.col("true").cast("int").alias("t")))
    rows = rows.unionByName(events.select(F.lit(1).alias("e"), *[F.lit(0).alias(c) for c in "wht"]))
    n = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("e", "n_events"), ("w", "n_windows"), ("h", "hits"), ("t", "true"))])
    n = n.withColumn("recall", ratio(F.col("hits"), F.col("n_events"))).withColumn("precision", ratio(F.col("true"), F.col("n_windows")))
    return n.withColumn("f1", f1_of(F.col("precision"), F.col("recall")))


def truth_mask(events: DataFrame, n_windows: int, size=SIZE, stride=STRIDE) -> DataFrame:
    return event_windows(events, size, stride).where(F.col("window_idx") < n_windows).select("window_idx").distinct()


def detected_runs(states: DataFrame, truth: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Runs of consecutive anomalous windows, and whether any of them is true. A run is found as a segment of window ids."""
    odd = states.where(F.col("status") != NORMAL).select(*by, "window_idx", F.lit(1).alias("label"))
    runs = segments(odd, "window_idx", by).withColumnsRenamed({"start": "first", "end": "last"})
    marks = runs.select(*by, "first", F.explode(F.sequence("first", "last")).alias("window_idx"))
    true = marks.join(truth, [*by, "window_idx"], "left_semi").select(*by, "first").distinct().withColumn("is_true", F.lit(True))
    return runs.join(true, [*by, "first"], "left").select(*by, "first", "last", F.coalesce("is_true", F.lit(False)).alias("is_true"))


def missed_events(states: DataFrame, events: DataFrame, size=SIZE, stride=STRIDE) -> DataFrame:
    """Events that no anomalous window overlaps."""
    odd = states.where(F.col("status") != NORMAL).select("window_idx")
    hit = event_windows(events, size, stride).join(odd, "window_idx", "left_semi").select("event_id").distinct()
    return events.join(hit, "event_id", "left_anti")


def event_sweep(scores: DataFrame, events: DataFrame, thresholds: DataFrame, n_windows: int, size=SIZE, stride=STRIDE) -> DataFrame:
    """Per threshold (score > it): events hit, runs of windows that no event touches, and event precision, recall and F1.

    Whether a run is false needs the order of windows, so windows are ranked within each threshold.
    """
    truth = truth_mask(events, n_windows, size, stride)
    near = range_windows(events, size, stride, 1).where(F.col("window_idx") < n_windows)
    n = events.agg(F.count(F.lit(1)).alias("n_events"))
    top = near.join(scores, "window_idx").groupBy("event_id").agg(F.max("abs_score").alias("top"))
    hits = thresholds.join(top, F.col("top") > F.col("threshold"), "left").groupBy("threshold").agg(F.count("event_id").alias("hits"))
    on = scores.join(truth.withColumn("_t", F.lit(1)), "window_idx", "left").crossJoin(F.broadcast(thresholds)).where("abs_score > threshold")
    on = on.withColumn("_g", F.col("window_idx") - F.row_number().over(Window.partitionBy("threshold").orderBy("window_idx")))
    runs = on.groupBy("threshold", "_g").agg(F.max("_t").alias("_t")).groupBy("threshold").agg(F.count_if(F.col("_t").isNull()).alias("false_runs"))
    out = hits.join(runs, "threshold", "left").withColumn("false_runs", F.coalesce("false_runs", F.lit(0))).crossJoin(n)
    out = out.withColumn("precision", ratio(F.col("hits"), F.col("hits") + F.col("false_runs"))).withColumn("recall", ratio(F.col("hits"), F.col("n_events")))
    return out.withColumn("f1", f1_of(F.col("precision"), F.col("recall"))).drop("n_events")


def best_of_sweep(sweep: DataFrame, highest=True) -> DataFrame:
    return sweep.orderBy(F.desc(F.round("f1", 9)), F.desc("threshold") if highest else F.asc("threshold")).limit(1)


def area_of_sweep(sweep: DataFrame) -> DataFrame:
    """Trapezoids of precision over recall; points of equal recall in the order of their precision."""
    w = Window.orderBy("recall", "precision")
    a = (F.col("recall") - F.lag("recall").over(w)) * (F.col("precision") + F.lag("precision").over(w)) / 2
    return sweep.select(a.alias("a")).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("auc_pr"))


def strict_percentile_sweep(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(score, label) windows, predicted where score > threshold."""
    by = rows.groupBy("score", "label").agg(F.count(F.lit(1)).alias("n"))
    on, yes = F.col("score") > F.col("threshold"), F.col("label") == 1
    n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    c = by.crossJoin(F.broadcast(thresholds)).groupBy("threshold").agg(n(on & yes).alias("tp"), n(on & ~yes).alias("fp"), n(~on & yes).alias("fn"))
    return scored(c)


def hit_rate(windows: DataFrame, events: DataFrame, k=1, size=SIZE, stride=STRIDE, dim_base=1) -> DataFrame:
    """windows (window_idx, top_dims 'a,b,c'): share of events near which any window names one of their dims among its first k."""
    near = range_windows(events, size, stride, 2, inclusive=False).join(events.select("event_id", "dims"), "event_id")
    dims = F.transform(F.slice(F.split("top_dims", ","), 1, k), lambda x: x.cast("int") + dim_base)
    hit = near.join(windows.select("window_idx", "top_dims"), "window_idx").groupBy("event_id").agg(F.max(F.arrays_overlap(dims, "dims")).alias("hit"))
    return events.join(hit, "event_id", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("hit", F.lit(False))).alias("hits")).withColumn("hit_rate", ratio(F.col("hits"), F.col("n")))


def dimension_f1(windows: DataFrame, events: DataFrame, k=3, size=SIZE, stride=STRIDE, dim_base=1) -> DataFrame:
    """Per event: the dims named by windows near it against its own; an event without windows scores 0."""
    near = range_windows(events, size, stride, 2, inclusive=False)
    dims = F.transform(F.slice(F.split("top_dims", ","), 1, k), lambda x: x.cast("int") + dim_base)
    got = near.join(windows.select("window_idx", dims.alias("p")), "window_idx").groupBy("event_id").agg(F.array_distinct(F.flatten(F.collect_set("p"))).alias("p"))
    e = events.where(F.size("dims") > 0).join(got, "event_id", "left").withColumn("p", F.coalesce("p", F.array().cast("array<int>")))
    tp = F.size(F.array_intersect("p", F.array_distinct("dims")))
    e = e.withColumn("precision", ratio(tp, F.size("p"))).withColumn("recall", ratio(tp, F.size(F.array_distinct("dims"))))
    return e.withColumn("f1", f1_of(F.col("precision"), F.col("recall"))).select("event_id", "precision", "recall", "f1")


def macro(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns])


def described(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])


def with_missing(entities: DataFrame, results: DataFrame, *columns: str) -> DataFrame:
    """Every entity; those without a result have status missing and 0s."""
    out = entities.join(results.withColumn("_r", F.lit(True)), "entity", "left").withColumn("status", F.when(F.col("_r"), "ok").otherwise("missing")).drop("_r")
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in columns})


#: 97.5 % points of the t distribution, by degrees of freedom 1 to 30; beyond, the normal one.
T_975 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042)


def mean_ci(rows: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    n = F.count(column)
    t = F.coalesce(F.get(F.array(*map(F.lit, T_975)), F.col("n").cast("int") - 2), F.lit(1.96))
    out = rows.groupBy(*by).agg(n.alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"))
    half = t * F.col("std") / F.sqrt("n")
    return out.withColumn("ci_low", F.col("mean") - half).withColumn("ci_high", F.col("mean") + half)


def paired_t(pairs: DataFrame, a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    return pairs.agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), (F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count(d)))).alias("t"))


def converged(runs: DataFrame, column="loss", tolerance=1e-4) -> DataFrame:
    return runs.agg(F.count(column).alias("n"), F.stddev_samp(column).alias("std")).withColumn("converged", F.col("std") < tolerance)


def runtime_projection(per_iteration: Column, iterations=100) -> Column:
    """Hours."""
    return per_iteration * iterations / 3600


def sample_complexity(points: DataFrame) -> DataFrame:
    """(n, mean_f1): c of the least-squares curve f1 = 1 - c / sqrt(n)."""
    x = 1 / F.sqrt("n")
    return points.agg((F.sum((1 - F.col("mean_f1")) * x) / F.sum(x * x)).alias("c"))


def by_size(results: DataFrame) -> DataFrame:
    return results.groupBy("n").agg(F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("std_f1"), F.count(F.lit(1)).alias("seeds"))


def grid(spark, n_random: int | None = None, seed=42, **axes: Sequence) -> DataFrame:
    """Every combination of the axes, or ``n_random`` of them by a hash."""
    out = spark.range(1).select()
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out if n_random is None else out.orderBy(F.xxhash64(*axes, F.lit(seed))).limit(n_random)


#: The variants of an ablation, as what each switches off.
ABLATIONS = (
    {"variant": "full"}, {"variant": "no_tucker", "tucker": False}, {"variant": "linear", "splines": False}, {"variant": "single_metric", "multi_metric": False},
    {"variant": "l1_sparsity", "top_k": False}, {"variant": "fixed_threshold", "adaptive_threshold": False},
)
