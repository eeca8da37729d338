"""Readers and writers of the tables that operators exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.functions import text as X


def wide_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Header; a first column without a name, or named as an index, isn't a variable and is called t."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    first = df.columns[0]
    return df.withColumnRenamed(first, "t") if first in ("", "_c0") or "index" in first.lower() else df


def headerless_csv(spark: SparkSession, path: str, d: int) -> DataFrame:
    """Numbers between commas, called dim_0 .. dim_{d-1}, as 32-bit floats, with the file and the place of each row."""
    schema = T.StructType([T.StructField(f"dim_{k}", T.FloatType()) for k in range(d)])
    return spark.read.schema(schema).csv(path).select("*", F.col("_metadata.file_name").alias("entity"), F.monotonically_increasing_id().alias("pos"))


def to_long(wide: DataFrame, t: str = "t") -> DataFrame:
    """(t, var, var_idx, value); variables are numbered in the order of their columns."""
    names = [c for c in wide.columns if c != t]
    at = F.create_map(*[F.lit(x) for k, c in enumerate(names) for x in (c, k)])
    out = wide.select(F.col(t).cast("long").alias("t"), *[F.col(f"`{c}`").cast("double") for c in names]).unpivot(["t"], names, "var", "value")
    return out.select("t", "var", F.try_element_at(at, F.col("var")).alias("var_idx"), "value")


def to_wide(series: DataFrame, names: list[str]) -> DataFrame:
    return series.groupBy("t").pivot("var", names).agg(F.first("value"))


def with_time(df: DataFrame, order: str) -> DataFrame:
    """Numbers rows from 0 by ``order``."""
    return df.withColumn("t", (F.row_number().over(Window.orderBy(order)) - 1).cast("long"))


def edges_csv(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """An edge table with its schema given, and windows low <= window_idx < high only: the range goes down to the scan."""
    df = spark.read.option("header", True).schema(schemas.EDGES).csv(path)
    df = df if low is None else df.where(F.col("window_idx") >= low)
    return df if high is None else df.where(F.col("window_idx") < high)


def edge_runs(spark: SparkSession, pattern: str, exclude: tuple[str, ...] = ("run_008",)) -> DataFrame:
    """Edge tables of all runs under a glob, run_id from the path, without the runs named."""
    df = spark.read.option("header", True).schema(schemas.EDGES).csv(pattern).withColumn("_p", F.col("_metadata.file_path"))
    for name in exclude:
        df = df.where(~F.col("_p").contains(f"/{name}/"))
    return df.withColumn("run_id", X.window_of_path(F.col("_p"))).drop("_p")


def last_window(edges: DataFrame) -> DataFrame:
    return edges.agg(F.max("window_idx").alias("last_window"))


def interval_labels(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("entity"), X.interval_label(F.col("value")).alias("x"))
    return lines.where("x is not null").select("entity", "x.*")


def sequence_labels(spark: SparkSession, path: str) -> DataFrame:
    """CSV (chan_id, spacecraft, anomaly_sequences, class, num_values) -> a row per sequence."""
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    key = "chan_id" if "chan_id" in df.columns else "channel_id"
    seq = df.select(F.col(key).alias("chan_id"), F.posexplode(F.arrays_zip(X.nested_list(F.col("anomaly_sequences")).alias("seq"), X.bare_list(F.col("class")).alias("class"))).alias("k", "x"))
    return seq.select("chan_id", "k", "x.seq.start", "x.seq.end", "x.class")


def point_labels(spark: SparkSession, path: str) -> DataFrame:
    """One number a line, in the order of one file."""
    lines = spark.read.text(path).select(F.trim("value").try_cast("double").cast("int").alias("label"), F.monotonically_increasing_id().alias("pos"))
    return with_time(lines.where("label is not null"), "pos").select("t", "label")


def report(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).select(X.report_row(F.col("value")).alias("x"))
    return rows.where("x is not null").select("x.*")


def lambdas(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("wholetext", True).text(path)
    return text.select(X.json_lambda(F.col("value"), "lambda_w").alias("lambda_w"), X.json_lambda(F.col("value"), "lambda_a").alias("lambda_a"))


def optimal_lags(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(schemas.OPTIMAL_LAGS).csv(path)


# sinks


def write_report(rows: DataFrame, path: str) -> None:
    """(window_idx, abs_score, root, effect, edge, edge_change) as lines of a text report."""
    var = lambda c: F.concat(F.lit("Var_"), F.col(c).cast("string"))
    line = F.concat_ws(" | ", F.col("window_idx").cast("string"), F.format_string("%.4f", "abs_score"), var("root"), var("effect"), F.concat("edge", F.format_string(" (%+.4f)", "edge_change")))
    rows.select(line.alias("value")).write.mode("overwrite").text(path)


def append_new(rows: DataFrame, path: str, key: str = "window_idx") -> None:
    """Adds the rows whose key the table doesn't have yet: a run that was cut short goes on where it stopped."""
    spark = rows.sparkSession
    try:
        done = spark.read.parquet(path).select(key).distinct()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    (rows if done is None else rows.join(done, key, "left_anti")).write.mode("append").parquet(path)
