"""``python -m tidemark.cli prepare|learn|detect|explain``: each step reads and writes tables, so a run may go on anywhere."""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.plans import workflow
from tidemark.session import session
from tidemark.sources import npy, readers


def main(argv: list[str] | None = None, spark=None) -> None:
    parser = argparse.ArgumentParser(prog="tidemark")
    parser.add_argument("step", choices=["prepare", "learn", "detect", "explain"])
    for name in ("data", "output", "config", "golden", "test", "states", "lags"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--ensemble", nargs="+", help="edge tables of several runs, whose mean stands for --test")
    parser.add_argument("--metric")
    parser.add_argument("--lookback", type=int)
    parser.add_argument("--lag", type=int)
    parser.add_argument("--no-adaptive", action="store_true")
    parser.add_argument("--window-size", type=int)
    parser.add_argument("--stride", type=int)
    parser.add_argument("--max-windows", type=int)
    parser.add_argument("--resume", action=argparse.BooleanOptionalAction, default=True)
    args = parser.parse_args(argv)
    config = Config(args.config)
    for key, value in {"detect.metric": args.metric, "detect.lookback": args.lookback, "detect.lag": args.lag, "windows.size": args.window_size, "windows.stride": args.stride, "windows.max_windows": args.max_windows}.items():
        if value is not None:
            config.set(key, value)
    if args.no_adaptive:
        config.set("detect.adaptive", False)
    if problems := config.problems():
        parser.error("; ".join(problems))
    spark = spark or session()
    read = spark.read.parquet
    if args.step == "prepare":
        if args.data.endswith(".npy"):
            spark.dataSource.register(npy.NpyDataSource)
            series = spark.read.format("npy").load(args.data)
        else:
            series = readers.to_long(readers.wide_csv(spark, args.data))
        prepared, lags = workflow.prepare(series, config)
        prepared.select("t", "var", "var_idx", "value").write.mode("overwrite").parquet(f"{args.output}/series")
        lags.write.mode("overwrite").parquet(f"{args.output}/lags")
    elif args.step == "learn":
        p = config.get("learn.p") or read(args.lags or f"{args.data}/lags").agg(F.max("optimal_lag")).first()[0]
        if args.resume:
            try:
                done = read(f"{args.output}_status").where("error is null")
            except Exception as e:  # noqa: BLE001
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                done = None
        else:
            done = None
        edges, status = workflow.learn_with_status(read(f"{args.data}/series"), p, config, done)
        mode = "append" if done is not None else "overwrite"
        edges.write.mode(mode).parquet(args.output)
        status.write.mode(mode).parquet(f"{args.output}_status")  # last, so that a run that stops before is repeated
    elif args.step == "detect":
        runs = [read(path).withColumn("run_id", F.lit(k)) for k, path in enumerate(args.ensemble or [])]
        runs = reduce(DataFrame.unionByName, runs) if runs else None
        scores = workflow.score(read(args.golden), read(args.test) if runs is None else None, config, runs=runs, n_runs=len(args.ensemble or []))
        workflow.classify(scores, config).write.mode("overwrite").parquet(args.output)
    else:
        out = workflow.explain(read(args.test), read(args.golden), read(args.states), lag=config.get("detect.lag"))
        readers.write_report(out, args.output)


if __name__ == "__main__":
    main()
