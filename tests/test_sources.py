import numpy as np
from pyspark.sql import functions as F

from tidemark.sources import npy, readers


def test_wide_csv_long_and_back(spark, tmp_path):
    (tmp_path / "x.csv").write_text("index,a,b\n0,1.0,2.0\n1,3.0,\n")
    wide = readers.wide_csv(spark, str(tmp_path / "x.csv"))
    assert wide.columns == ["t", "a", "b"]
    long = readers.to_long(wide)
    assert sorted((r.t, r["var"], r.var_idx, r.value) for r in long.collect() if r.value is not None) == [(0, "a", 0, 1.0), (0, "b", 1, 2.0), (1, "a", 0, 3.0)]
    assert readers.to_wide(long, ["a", "b"]).count() == 2


def test_headerless(spark, tmp_path):
    (tmp_path / "machine.txt").write_text("0.5,1\n0.25,2\n")
    d = readers.headerless_csv(spark, str(tmp_path / "machine.txt"), 2)
    assert d.dtypes[0] == ("dim_0", "float") and [r.dim_1 for r in readers.with_time(d, "pos").orderBy("t").collect()] == [1.0, 2.0]


def test_npy_source(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.arange(12.0).reshape(4, 3))
    np.save(tmp_path / "m_columns.npy", np.array(["x", "y", "z"]))
    spark.dataSource.register(npy.NpyDataSource)
    d = spark.read.format("npy").option("rowsPerPartition", 2).load(str(tmp_path / "m.npy"))
    assert d.count() == 12 and d.where("var = 'y' and t = 3").first()["value"] == 10.0
    npy.save_npy(readers.to_wide(d, ["x", "y", "z"]), ["x", "y", "z"], str(tmp_path / "n.npy"))
    assert (np.load(tmp_path / "n.npy") == np.arange(12.0).reshape(4, 3)).all()


def test_lag_array(tmp_path):
    np.save(tmp_path / "l.npy", np.array([("Var_A", 5), ("Var_B", 10), ("Var_C", 1)], dtype=[("variable", "U100"), ("optimal_lag", "i4")]))
    assert max(k for _, k in npy.lag_array(str(tmp_path / "l.npy"))) == 10


def test_runs_and_ranges(spark, tmp_path):
    for k in (1, 8):
        d = tmp_path / f"run_{k:03d}" / "weights"
        d.mkdir(parents=True)
        (d / "weights_enhanced.csv").write_text("window_idx,i,j,lag,weight\n0,0,1,0,0.5\n3,1,0,1,0.25\n")
    runs = readers.edge_runs(spark, str(tmp_path / "*" / "weights" / "weights_enhanced.csv"))
    assert {r.run_id for r in runs.collect()} == {1}
    part = readers.edges_csv(spark, str(tmp_path / "run_001" / "weights" / "weights_enhanced.csv"), 1, 4)
    assert [r.window_idx for r in part.collect()] == [3] and readers.last_window(part).first()[0] == 3


def test_labels_and_reports(spark, tmp_path):
    (tmp_path / "m-1.txt").write_text("10-20:1,2\nbroken\n1:2:3\n")
    assert [(r.start, r.end, r.dims) for r in readers.interval_labels(spark, str(tmp_path / "m-1.txt")).collect()] == [(10, 20, [1, 2])]
    (tmp_path / "l.csv").write_text('chan_id,spacecraft,anomaly_sequences,class,num_values\nP-1,SMAP,"[[2149, 2349], [4536, 4844]]","[contextual, point]",8505\n')
    assert [(r.start, r["class"]) for r in readers.sequence_labels(spark, str(tmp_path / "l.csv")).orderBy("k").collect()] == [(2149, "contextual"), (4536, "point")]
    (tmp_path / "p.txt").write_text("0\n1\n1\n")
    assert [r.label for r in readers.point_labels(spark, str(tmp_path / "p.txt")).orderBy("t").collect()] == [0, 1, 1]
    (tmp_path / "j.json").write_text('{"lambda_w": 0.2}')
    assert tuple(readers.lambdas(spark, str(tmp_path / "j.json")).first()) == (0.2, 0.1)
    out = spark.createDataFrame([(7, 0.5, 3, 4, 0.1)], "window_idx int, abs_score double, root int, effect int, edge_change double").withColumn("edge", F.lit("3->4"))
    readers.write_report(out, str(tmp_path / "report"))
    assert tuple(readers.report(spark, str(tmp_path / "report")).first()) == (7, 0.5, 3, 4)


def test_append_goes_on_where_it_stopped(spark, tmp_path):
    path = str(tmp_path / "done")
    d = spark.range(6).select(F.col("id").cast("int").alias("window_idx"))
    readers.append_new(d.where("window_idx < 4"), path)
    readers.append_new(d, path)
    assert sorted(r.window_idx for r in spark.read.parquet(path).collect()) == list(range(6))
