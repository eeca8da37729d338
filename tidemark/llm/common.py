"""What the operators share: words, tables, durable cuts of lineage, sizes of plans."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the ASCII controls from tab to carriage return, as `bytes.split()`.
BLANK = r"[\x20\x09-\x0D]+"
MAX_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as make it differ from every column, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def input_partitions(df: DataFrame) -> int:
    """Tasks that the scan below has: a measure of the input that costs no job."""
    return max(1, df._jdf.queryExecution().toRdd().getNumPartitions())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared folder. Where none is set one is made, if driver and executors are one process (tests); a cluster must name
    one that all its machines see."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


def release(spark: SparkSession) -> None:
    """Shuffle files of plans that nothing refers to any more go when the driver collects its garbage, which may be long
    after; steps that end in a written table let go of much, so it is asked to before the next one fills the disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def durable(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared checkpoint folder, so that a lost executor costs no more
    than its own tasks."""
    checkpoint_dir(df.sparkSession)
    release(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As ``durable``, in Parquet: for wide rows of which later steps read a few columns each. The files go with the folder."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    release(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(table: DataFrame) -> None:
    """Deletes the files of a table made by ``written``, when nothing reads it any more."""
    spark = table.sparkSession
    for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
        if "/table-" in path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def sampled(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """The rows with the ``most`` smallest hashes of their key, all if there are no more.

    A share of the hashes that holds several times as many rows is looked at, so that what tasks send on
    doesn't grow with their number.
    """
    h = F.xxhash64(key, F.lit(17))
    share = min(1.0, 4.0 * most / max(1, rows.count()))
    near = rows if share == 1.0 else rows.where(h <= F.lit(int(-(2**63) + share * 2**64)).cast("long"))
    return near.withColumn("_h", h).orderBy("_h", key).limit(most).drop("_h")


def trim(most=128 << 20) -> None:
    """Gives memory that is free but still held back to the system, if this Python worker holds more than ``most``: workers
    live on between tasks, beside the executor's heap and one another."""
    import pyarrow as pa

    try:
        with open("/proc/self/statm") as f:
            if int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") < most:
                return
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no such system or library: nothing to give back
        return
