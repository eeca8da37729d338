"""A data source of .npy matrices with a side-car of column names: ``spark.read.format("npy").load(path)``.

Rows are (t, var, var_idx, value). The header is read on the driver; partitions are ranges of rows, each read by its own task
through a memory map.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.session import durable


class NpyDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "t long, var string, var_idx int, value double"

    def reader(self, schema):
        return NpyReader(self.options)


class Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class NpyReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.rows = options["path"].removeprefix("file:"), int(options.get("rowsPerPartition", 100_000))
        self.names = options.get("columns", self.path.removesuffix(".npy") + "_columns.npy")

    def partitions(self):
        n = len(np.load(self.path, mmap_mode="r"))
        return [Rows(a, min(n, a + self.rows)) for a in range(0, max(n, 1), self.rows)]

    def read(self, partition):
        data = np.load(self.path, mmap_mode="r")
        data = data if data.ndim == 2 else data[:, None]
        names = [str(x) for x in np.load(self.names)] if os.path.exists(self.names) else [f"var_{k}" for k in range(data.shape[1])]
        for t in range(partition.low, partition.high):
            for k, v in enumerate(data[t].tolist()):
                yield (t, names[k], k, float(v))


def save_npy(wide: DataFrame, names: list[str], path: str) -> None:
    """Writes a table of t and the named columns as a matrix in the order of t, with its side-car. One file for other tools, in a folder
    that driver and executors share: the driver makes it, tasks fill in their ranges of rows through a memory map. A task that
    is run again writes the same rows to the same place; t must not repeat."""
    path = path.removeprefix("file:")
    rows = durable(wide.select("t", *[F.col(f"`{c}`").cast("double").alias(f"_{k}") for k, c in enumerate(names)]).repartitionByRange("t").sortWithinPartitions("t").withColumn("_part", F.spark_partition_id()))
    counts = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}
    starts = dict(zip(sorted(counts), np.cumsum([0, *(counts[k] for k in sorted(counts))]).tolist(), strict=False))
    np.lib.format.open_memmap(path, "w+", np.float64, (sum(counts.values()), len(names))).flush()
    np.save(path.removesuffix(".npy") + "_columns.npy", np.array(names))

    def fill(batches):
        at: dict[int, int] = {}  # a task may get several parts, each in its order
        out = np.lib.format.open_memmap(path, "r+")
        for batch in batches:
            parts = batch["_part"].to_numpy()
            for part in np.unique(parts).tolist():
                values = batch.loc[parts == part, [f"_{k}" for k in range(len(names))]].to_numpy(float)
                low = at.get(part, starts[part])
                out[low : low + len(values)] = values
                at[part] = low + len(values)
        out.flush()
        yield from ()

    if counts:
        rows.mapInPandas(fill, "n long").count()


def lag_array(path: str) -> list[tuple[str, int]]:
    """Optimal lags of a side-car: a structured array (variable, optimal_lag), pairs, or bare numbers."""
    a = np.load(path, allow_pickle=False)
    if a.dtype.names:
        return [(str(v), int(k)) for v, k in zip(a["variable"], a["optimal_lag"], strict=True)]
    return [(str(r[0]), int(r[1])) for r in a] if a.ndim == 2 else [(f"var_{i}", int(k)) for i, k in enumerate(a)]
