import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import detect
from tidemark.streaming import detect as streaming


def test_classifier_over_a_stream_agrees_with_the_batch_fold(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = [(e, k, float(0.02 * rng.random() + (0.4 if k % 11 > 8 else 0)), float(rng.random() * 0.3), float(rng.normal() * 0.2)) for e in ("a", "b") for k in range(60)]
    schema = "entity string, window_idx int, abs_score double, change_score double, abs_trend double"
    d = spark.createDataFrame(data, schema)
    for part in range(3):
        d.where(F.floor(F.col("window_idx") / 20) == part).coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = streaming.classify(stream).writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.entity, r.window_idx): r.status for r in spark.table("states").collect()}
    want = {(r.entity, r.window_idx): r.status for r in detect.adaptive_states(d, ["entity"]).collect()}
    assert got == want and len(got) == 120


def test_sliding_time_windows(spark, tmp_path):
    d = spark.createDataFrame([("2024-01-01 00:30:00", "a", 1.0), ("2024-01-02 00:00:00", "a", 3.0), ("2024-01-09 00:00:00", "a", 9.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    d.write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "e"))
    q = streaming.sliding_time(s).writeStream.format("memory").queryName("slid").outputMode("append").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("slid").where("n = 2").count() > 0
