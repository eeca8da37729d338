import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.config import Config
from tidemark.functions import kernels
from tidemark.plans import workflow


def test_config_precedence_and_types(tmp_path):
    (tmp_path / "c.toml").write_text("[windows]\nsize = 50\n[detect]\nmetric = 'spectral'\n")
    c = Config(str(tmp_path / "c.toml"), {"TIDEMARK__WINDOWS__SIZE": "60", "TIDEMARK__DETECT__ADAPTIVE": "no", "TIDEMARK__EVALUATE__KS": "[1, 2]", "OTHER": "x"})
    assert (c.get("windows.size"), c.get("windows.stride"), c.get("detect.metric"), c.get("detect.adaptive"), c.get("evaluate.ks"), c.get("no.such", 7)) == (60, 10, "spectral", False, [1, 2], 7)
    assert json.loads(c.export())["windows"]["size"] == 60 and not c.problems()
    c.set("windows.stride", "0")
    assert c.problems()
    with pytest.raises(ValueError):
        c.set("detect.adaptive", "perhaps")
    c.reload()
    assert c.get("windows.stride") == 10


def test_the_whole_way(spark, tmp_path):
    x, *_ = kernels.synthetic_dbn(400, 3, 1, seed=4)
    x[300:330, 1] += 6
    (tmp_path / "x.csv").write_text("index,a,b,c\n" + "\n".join(f"{t},{','.join(f'{v:.6f}' for v in r)}" for t, r in enumerate(x)))
    out, settings = str(tmp_path / "out"), str(tmp_path / "c.json")
    (tmp_path / "c.json").write_text(json.dumps({"learn": {"p": 1, "threshold": 0.0}}))
    cli.main(["prepare", "--data", str(tmp_path / "x.csv"), "--output", out, "--config", settings], spark)
    assert spark.read.parquet(f"{out}/lags").count() >= 1
    learn = ["learn", "--data", out, "--output", f"{out}/edges", "--config", settings]
    cli.main([*learn, "--max-windows", "12"], spark)
    assert spark.read.parquet(f"{out}/edges").select("window_idx").distinct().count() == 12
    cli.main(learn, spark)
    edges = spark.read.parquet(f"{out}/edges")
    assert edges.select("window_idx").distinct().count() == 31 and edges.groupBy("window_idx", "i", "j", "lag").count().where("count > 1").count() == 0
    edges.where("window_idx < 12").write.parquet(f"{out}/golden")
    for metric in ("frobenius", "weighted_edge"):
        cli.main(["detect", "--golden", f"{out}/golden", "--test", f"{out}/edges", "--output", f"{out}/states", "--metric", metric, "--lag", "1"], spark)
        assert spark.read.parquet(f"{out}/states").count() == 31
    cli.main(["explain", "--golden", f"{out}/golden", "--test", f"{out}/edges", "--states", f"{out}/states", "--output", f"{out}/report", "--lag", "1"], spark)
    assert 0 < spark.read.text(f"{out}/report").count() <= 5


def test_pairwise_and_graph_api(spark):
    import pandas as pd

    e = spark.createDataFrame([(0, 0, 1, 0, 0.5), (0, 1, 0, 0, 0.2), (1, 0, 1, 0, 0.1)], "window_idx int, i int, j int, lag int, weight double")
    r = workflow.pairwise(e.withColumn("weight", F.col("weight") * 2), e, eps=0.3).orderBy("window_idx").first()
    assert r.frobenius == pytest.approx(np.hypot(0.5, 0.2)) and r.structural_hamming == 1 and r.max_edge_change == pytest.approx(0.5)
    g = workflow.learn_graph(pd.DataFrame(np.random.default_rng(0).standard_normal((80, 2)), columns=["a", "b"]), 1)
    assert all(p.endswith("_lag1") and c.endswith("_lag0") for p, c, _ in g)
    with pytest.raises(ValueError):
        c = Config(environ={})
        c.set("learn.estimator", "other")
        workflow.kernel(c, 1)
