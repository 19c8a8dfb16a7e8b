"""Ridge models from partition-summed normal equations, and isotonic calibration on a fixed grid."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partitions that labelled rows are summed in: the driver receives one sum per fold from each.
SUM_PARTITIONS = 8
#: Cells of the grid of scores that calibration counts in.
CELLS = 2000


def labelled_sample(labels: DataFrame, columns: list[str], most: int) -> DataFrame:
    """``doc_id`` and the mean of each label column, for a sample by hash of about ``most`` ids.

    Rows without an id or with a null among the labels are left out.
    """
    known = labels.dropna(subset=["doc_id", *columns]).groupBy("doc_id").agg(*[F.avg(c).alias(c) for c in columns])
    n = known.count()
    if n <= most:
        return known
    u = F.pmod(F.xxhash64(F.lit("labelled"), "doc_id"), F.lit(1 << 30))
    return known.where(u < int((1 << 30) * most / n))


def sums(rows: DataFrame, moments: Callable[[pa.RecordBatch], np.ndarray], size: int) -> dict[int, np.ndarray]:
    """Sum of ``moments`` (an array of ``size`` numbers) by the column ``fold``, over partitions and then on the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            folds = batch.column("fold").to_numpy()
            for fold in np.unique(folds):
                part = moments(batch.filter(pa.array(folds == fold)))
                total[int(fold)] = total[int(fold)] + part if int(fold) in total else part
        total = {k: np.ascontiguousarray(v, dtype=float) for k, v in total.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.int32()), pa.array([x.tobytes() for x in total.values()], type=pa.binary())], names=["fold", "sum"])

    out: dict[int, np.ndarray] = {}
    for r in rows.coalesce(SUM_PARTITIONS).mapInArrow(add, "fold int, sum binary").collect():
        part = np.frombuffer(r["sum"]).reshape(size)
        out[r["fold"]] = out[r["fold"]] + part if r["fold"] in out else part.copy()
    return out


def pack_moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """X'X and X'y of one group of rows as one array; the last column of X is the constant."""
    return np.concatenate([(x.T @ x).ravel(), (x.T @ y).ravel()])


def solve(moments: np.ndarray, width: int, strength: float) -> np.ndarray:
    """Ridge weights; the constant, the last column, is not shrunk."""
    gram, right = moments[: width * width].reshape(width, width), moments[width * width :].reshape(width, -1)
    penalty = np.full(width, strength)
    penalty[-1] = 1e-9
    return np.linalg.solve(gram + np.diag(penalty + 1e-9), right)


def leave_out(by_fold: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """For each fold the sum over the others (over itself if there is no other)."""
    total = sum(by_fold.values())
    return {k: total - v if len(by_fold) > 1 else total for k, v in by_fold.items()}


class Isotonic:
    """A rising map from scores to frequencies, from counts on a grid of scores in [-0.5, 1.5]."""

    def __init__(self, n: np.ndarray, positive: np.ndarray):
        grid = (np.arange(CELLS) + 0.5) / CELLS * 2 - 0.5
        blocks: list[list[float]] = []  # weight, sum of labels, sum of scores
        for x, w, p in zip(grid[n > 0], n[n > 0], positive[n > 0], strict=True):
            blocks.append([w, p, w * x])
            while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
        self.x = np.array([b[2] / b[0] for b in blocks] or [0.0])
        # half a pseudo-count keeps the ends off 0 and 1
        self.y = np.array([(b[1] + 0.25) / (b[0] + 0.5) for b in blocks] or [0.5])

    @classmethod
    def empty(cls) -> Isotonic:
        return cls(np.zeros(CELLS), np.zeros(CELLS))

    @staticmethod
    def cell(score: np.ndarray) -> np.ndarray:
        return np.clip(np.nan_to_num((score + 0.5) / 2 * CELLS), 0, CELLS - 1).astype(np.int64)

    @classmethod
    def counts(cls, score: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = cls.cell(score)
        return np.concatenate([np.bincount(at, minlength=CELLS), np.bincount(at, weights=y, minlength=CELLS)]).astype(float)

    def __call__(self, score: np.ndarray) -> np.ndarray:
        # a slight slope keeps the order of scores within a level
        return np.clip(0.999 * np.interp(score, self.x, self.y) + 0.001 * np.clip((score + 0.5) / 2, 0, 1), 0, 1)
