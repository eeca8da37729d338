"""Hand-checked rows for boundary rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import detect, distance, evaluate, graph, learn, prep, rca, windows
from tidemark.plans import fixtures as fx
from tidemark.plans import registry


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_fill_and_drop(spark):
    d = spark.createDataFrame([(0, "a", None), (1, "a", 1.0), (2, "a", float("nan")), (0, "b", 5.0), (1, "b", 6.0), (2, "b", 7.0)], "t long, var string, value double")
    out = rows(prep.drop_incomplete(prep.forward_fill(d)).select("t", "var", "value"), "t", "var")
    assert out == [(1, "a", 1.0), (1, "b", 6.0), (2, "a", 1.0), (2, "b", 7.0)]


def test_detrend_begins_at_zero_and_discontinuities_cut(spark):
    d = spark.createDataFrame([(t, "a", float(v)) for t, v in enumerate([3, 9, 27])], "t long, var string, value double")
    assert [r[1] for r in rows(prep.detrend(d).select("t", "value"), "t")] == [0.0, 6.0, 21.0]
    c = spark.createDataFrame([(t, "a", float(t)) for t in (1, 2, 3, 4, 8, 9, 10)], "t long, var string, value double")
    cut = prep.cut_discontinuities(c)
    assert [r[1] for r in rows(cut.select("t", "realisation_id"), "t")] == [0, 0, 0, 0, 1, 1, 1]
    assert prep.lag_embed(cut, 2).count() == 3


@pytest.mark.parametrize(("n", "want"), [(99, 0), (100, 1), (109, 1), (110, 2)])
def test_window_counts(spark, n, want):
    d = spark.range(n).withColumnRenamed("id", "t")
    assert windows.sliding(d).select("window_idx").distinct().count() == want


def test_point_before_the_first_window_is_an_error(spark):
    with pytest.raises(Exception, match="before the first"):
        spark.createDataFrame([(1,)], "t int").select(windows.window_of(F.col("t"), 5)).collect()


def test_distances(spark):
    e = spark.createDataFrame([(0, 0, 1, 3.0), (1, 1, 0, 4.0)], "window_idx int, i int, j int, weight double")
    p = spark.createDataFrame([(0, 1)], "a int, b int")
    cells = distance.pair_cells(p, e, e)
    assert distance.frobenius(cells).first()["distance"] == 5.0
    assert distance.spectral(cells).first()["distance"] == pytest.approx(np.linalg.norm([[0, 3], [-4, 0]], 2))
    with pytest.raises(ValueError):
        distance.distance(cells, "other")
    none = spark.createDataFrame([(5, 6)], "a int, b int")
    assert distance.frobenius(distance.pair_cells(none, e, e), none).first()["distance"] == 0.0


def test_score_at_the_threshold(spark):
    s = spark.createDataFrame([(0, 0.5, 0.0, 0.0)], "window_idx int, abs_score double, change_score double, abs_trend double")
    assert detect.fixed_states(s, (0.5, 1, 1)).first()["status"] == detect.CASCADE
    limits = spark.createDataFrame([(0.5, 1.0, 1.0)], "threshold_normal double, threshold_change double, threshold_trend double")
    assert detect.static_states(s, limits).first()["status"] == detect.NORMAL


def test_fold_agrees_with_the_machine_beyond_its_history(spark):
    rng = np.random.default_rng(0)
    data = [(k, float(0.02 * rng.random() + (0.5 if k % 17 > 13 else 0)), float(rng.random() * 0.3 + (2 if k % 17 > 14 else 0)), float(rng.normal() * 0.2)) for k in range(260)]
    machine = detect.AdaptiveState()
    want = [(k, *machine.step(a, c, t)) for k, a, c, t in data]
    out = detect.adaptive_states(spark.createDataFrame(data, "window_idx int, abs_score double, change_score double, abs_trend double"))
    got = rows(out.select("window_idx", "status", "threshold_normal", "threshold_change", "threshold_trend"), "window_idx")
    assert {g[1] for g in got} == {detect.NORMAL, detect.ONSET, detect.RECOVERY, detect.CASCADE} and len(machine.a) == 100
    assert all(g[:2] == w[:2] and np.allclose(g[2:], w[2:]) for g, w in zip(got, want, strict=True))


def test_two_means(spark):
    schema = "window_idx int, i int, j int, lag int, weight double"
    d = spark.createDataFrame([(0, 0, k, 0, (k + 1) / 50 + (5 if k > 6 else 0)) for k in range(12)], schema)
    assert learn.two_means_threshold(d, 2).count() == 5 and learn.two_means_threshold(d, 8).count() == 8
    assert learn.two_means_threshold(d.where("weight > 9"), 2).count() == 0
    assert learn.two_means_threshold(d.withColumn("weight", F.lit(1.0)), 100).count() > 0


def test_failed_window_gives_an_error_row(spark):
    d = spark.createDataFrame([(w, t, v, float(t)) for w in (0, 1) for t in range(4) for v in (0, 1)], "window_idx int, t long, var_idx int, value double")

    def kernel(x):
        raise ValueError("no fit")

    out = learn.fit_windows(d, kernel).collect()
    assert len(out) == 2 and all("no fit" in r["error"] and r["weight"] is None for r in out)


def test_graph_rules(spark):
    e = spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.4), (2, 0, 0.3), (5, 6, 0.1)], "src int, dst int, weight double")
    assert graph.largest_subgraph(e).count() == 3
    with pytest.raises(KeyError):
        graph.target_subgraph(e, 9)
    d = graph.to_dag(e.select(F.lit(0).alias("window_idx"), F.col("src").alias("i"), F.col("dst").alias("j"), "weight"))
    assert sorted((r.i, r.j) for r in d.collect()) == [(0, 1), (1, 2)]
    with pytest.raises(Exception, match="unknown origin"):
        graph.upsert_edges(e.withColumns({"origin": F.lit("learned"), "seq": F.lit(0)}), e.withColumns({"origin": F.lit("x"), "seq": F.lit(1)})).collect()


def test_point_adjustment_at_the_edges(spark):
    p = spark.createDataFrame([(0, 1, 0.1), (1, 1, 0.9), (2, 0, 0.2), (3, 1, 0.3)], "t long, label int, score double")
    r = evaluate.adjusted(p, spark.createDataFrame([(0.5,)], "threshold double")).first()
    assert (r.tp, r.fp, r.fn) == (2, 0, 1)
    late = evaluate.adjusted_latency(p, 0.5).first()
    assert (late.tp, late.fn) == (1, 2) and late.latency == 0.0  # the point at 0 isn't filled in
    none = spark.createDataFrame([(0, 0, 0.1)], "t long, label int, score double")
    assert evaluate.best_adjusted(none).first()["f1"] == 0.0


def test_auc_step_and_trapezoid_differ_and_ties_are_one_point(spark):
    p = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.5, 1), (0.1, 0)], "score double, label int")
    assert evaluate.pr_curve(p).count() == 3
    assert evaluate.average_precision(p).first()[0] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    assert evaluate.auc_pr(p).first()[0] == pytest.approx(0.5 * 0.75 + 0.5 * (0.5 + 2 / 3) / 2)


def test_touching_intervals_do_not_overlap(spark):
    e = spark.createDataFrame([(0, 100, 120, [1])], "event_id int, start long, end long, dims array<int>")
    got = [r.window_idx for r in rca.event_windows(e).orderBy("window_idx").collect()]
    assert got == [w for w in range(20) if max(w * 10, 100) < min(w * 10 + 100, 120)]


def test_absent_culprits_rank_999(spark):
    ranking = spark.createDataFrame([(0, 0, 1)], "window_idx int, node int, rank int")
    e = spark.createDataFrame([(0, 3, 9, [1, 7])], "event_id int, start long, end long, dims array<int>")
    assert rca.recall_at(ranking, e).first()["mean_rank"] == 500.0


@pytest.mark.parametrize("name", ["dynotears_edges", "tucker_edges", "dag_edges", "counterfactual"])
def test_queries_cover_every_window(spark, name):
    sf = "/root/testdata/sf0.001"
    of = lambda df: {r[0] for r in df.select("window_idx").distinct().collect()}
    source = fx.edges(spark, sf).where("lag = 0 and abs(weight) > 0.05") if name == "dag_edges" else fx.windowed(spark, sf)
    assert of(registry.QUERIES[name](spark, sf)) == of(source)


def runs_in(rows):
    """Brute force: (entity, first, last) of runs of consecutive positive places."""
    out = []
    for e, t in sorted((r[0], r[1]) for r in rows if r[2] == 1):
        if out and out[-1][0] == e and out[-1][2] == t - 1:
            out[-1][2] = t
        else:
            out.append([e, t, t])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("span", [1, 3, 7, 1 << 20])
def test_runs_over_the_ends_of_ranges(spark, span):
    rng = np.random.default_rng(span)
    rows = [(e, t, int(rng.random() < 0.7), float(rng.integers(0, 9))) for e in ("a", "b", "c") for t in range(60)] + [("d", t, 1, 1.0) for t in range(30)]
    p = spark.createDataFrame(rows, "entity string, t long, label int, score double").repartition(5)
    want = runs_in(rows)
    assert sorted(map(tuple, evaluate.segments(p, by=["entity"], span=span).select("entity", "start", "end").collect())) == want
    ids = evaluate.segment_ids(p, ["entity"], span).collect()
    assert len(ids) == len(rows) and all((r.segment is None) == (r.label == 0) for r in ids)
    number = {(e, t): k for k, (e, a, b) in enumerate(want) for t in range(a, b + 1)}
    pairs = {(number[r.entity, r.t], r.entity, r.segment) for r in ids if r.label}
    assert len(pairs) == len(want) == len({x[1:] for x in pairs})
    one = evaluate.segment_ids(p.where("entity = 'a'").drop("entity"), span=span)
    assert one.where("label = 1").select("segment").distinct().count() == sum(x[0] == "a" for x in want)


def test_evaluators_by_entity_give_what_each_entity_gives_alone(spark):
    rng = np.random.default_rng(3)
    rows = [(e, t, int(rng.random() < 0.3), float(rng.integers(0, 12))) for e in ("a", "b", "c") for t in range(80)]
    p = spark.createDataFrame(rows, "entity string, t long, label int, score double")
    runs = (
        lambda d, by: evaluate.auc_pr(d.drop("t"), by), lambda d, by: evaluate.average_precision(d.drop("t"), by), lambda d, by: evaluate.max_f1(d.drop("t"), by=by),
        lambda d, by: evaluate.pr_curve(d.drop("t"), by), lambda d, by: evaluate.best_adjusted(d, 10, by), lambda d, by: evaluate.adjusted_latency(d, 6.0, by),
    )
    for run in runs:
        got = run(p, ["entity"]).collect()
        for e in ("a", "b", "c"):
            alone = run(p.where(f"entity = '{e}'").drop("entity"), ())
            mine = sorted(tuple(r[c] for c in alone.columns) for r in got if r["entity"] == e)
            assert len(mine) and all(x == pytest.approx(y) for x, y in zip(mine, sorted(map(tuple, alone.collect())), strict=True))


def test_detected_runs_and_null_scores(spark):
    s = spark.createDataFrame([(0, "x"), (1, "x"), (2, "NORMAL"), (3, "x"), (5, "x")], "window_idx int, status string")
    truth = spark.createDataFrame([(1,), (2,)], "window_idx int")
    assert sorted(map(tuple, evaluate.detected_runs(s, truth).collect())) == [(0, 1, True), (3, 3, False), (5, 5, False)]
    nulls = spark.createDataFrame([(0, None, 0.0, 0.0), (1, 0.01, 0.0, 0.0)], "window_idx int, abs_score double, change_score double, abs_trend double")
    assert [r.status for r in detect.adaptive_states(nulls).orderBy("window_idx").collect()] == [detect.CASCADE, detect.NORMAL]
    assert detect.adaptive_states(nulls.limit(0)).count() == 0
