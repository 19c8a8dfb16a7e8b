"""Integer vectors: cutting to a grid, exact squared distances and exact sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest size of an integer component; squared distances of up to 2**9 of them fit a long.
LARGEST = 1 << 26
#: Allowance for rounding, relative, by which bounds in floating point are widened.
ROUNDING = 1e-12


def usable(vector: Column, scale: int) -> Column:
    """Whether all components are there, finite, and at most ``LARGEST`` once multiplied with ``scale``."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double") * scale) < LARGEST, F.lit(False))), F.lit(False))


def on_grid(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an Arrow column of integer lists with ``width`` members each."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two integer matrices, as longs."""
    if not len(x) or not len(y):
        return np.zeros((len(x), len(y)), dtype=np.int64)
    top = float(max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)))
    if 4 * x.shape[1] * top * top < 2**53:  # every number on the way is an integer that a double holds
        x, y = x.astype(float), y.astype(float)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :]).astype(np.int64)


def summed(rows: DataFrame, add: Callable[[pa.RecordBatch, np.ndarray], None], size: int) -> list[int]:
    """``size`` exact totals: ``add`` adds a batch to the array of its task, and Spark adds up the tasks' arrays, cell by cell."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            add(batch, total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, type=pa.int64()), pa.array(total[at], type=pa.int64())], names=["cell", "value"])

    out = [0] * size
    for r in rows.mapInArrow(work, "cell long, value long").groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():  # ``size`` rows
        out[r["cell"]] = int(r["value"])
    return out
