"""Document quality from random Fourier features of text statistics.

The features approximate a Gaussian kernel over standardised statistics of the
whole text.  Normal equations are summed by partition and fold and solved for
ridge weights; scores of left-out folds are counted on a grid and fitted by
isotonic regression, which turns the final model's scores into frequencies.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayside.llm.arrow import with_columns
from wayside.llm.language import held_out
from wayside.llm.ridge import Isotonic, labelled_sample, leave_out, pack_moments, solve, sums
from wayside.llm.words import chunked, word_hashes
from wayside.session import settle

FEATURES = 400
FOLDS = 4
STRENGTH = 0.3
#: Labelled documents that are learned from, about (a sample by hash beyond that).
MOST_LABELLED = 20_000

#: Bytes that are counted one by one; all others by kind.
_COUNTED = b"#%$&*!|.,;:?\"'()-_<>{}[]/\\@=+~^"
_CLASS = np.zeros(256, dtype=np.int64)
for _b in range(256):
    _c = bytes([_b])
    _CLASS[_b] = 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _b == 10 else 5 if _c.isspace() else 6 if _b >= 0x80 else 0
for _i, _b in enumerate(_COUNTED):
    _CLASS[_b] = 7 + _i
_CLASSES = 7 + len(_COUNTED)
_WORD_END = np.zeros(256, dtype=bool)
_WORD_END[list(b".,;:?\"')")] = True
#: Statistics of a text: shares of its characters, then what ``statistics`` adds.
WIDTH = _CLASSES + 14


def _distinct(values: np.ndarray) -> tuple[int, int]:
    """Number of distinct values and the largest count of one."""
    if not len(values):
        return 0, 0
    counts = np.unique(values, return_counts=True)[1]
    return len(counts), int(counts.max())


def statistics(run: list[bytes]) -> np.ndarray:
    """One row of ``WIDTH`` statistics per encoded text; an empty text has zeros."""
    out = np.zeros((len(run), WIDTH))
    data = np.frombuffer(b"".join(run), dtype=np.uint8)
    sizes = np.array([len(t) for t in run])
    owner = np.repeat(np.arange(len(run)), sizes)
    counts = np.bincount(owner * _CLASSES + _CLASS[data], minlength=len(run) * _CLASSES).reshape(len(run), _CLASSES)
    out[:, :_CLASSES] = np.sqrt(counts / np.maximum(sizes, 1)[:, None])
    words, bounds = word_hashes(run)
    lines, line_bounds = word_hashes(run, _NOT_NEWLINE)
    for i, text in enumerate(run):
        w, a = words[bounds[i] : bounds[i + 1]], _CLASSES
        if not len(w):
            continue
        n, (kinds, most) = len(w), _distinct(w)
        pairs = w[1:] * np.uint64(3) + w[:-1]
        pair_kinds, pair_most = _distinct(pairs)
        line = lines[line_bounds[i] : line_bounds[i + 1]]
        line_kinds, line_most = _distinct(line)
        parts = text.split()
        symbols = sum(not (p[-1:].isalnum() or p[-1] >= 0x80 or _WORD_END[p[-1]]) for p in parts)
        capitals = sum(p[:1].isupper() for p in parts)
        out[i, a:] = [
            np.log1p(n),
            np.log1p(sizes[i]),
            sizes[i] / n / 10,
            kinds / n,
            most / n,
            float(np.mean(w[1:] == w[:-1])) if n > 1 else 0,
            pair_kinds / max(n - 1, 1),
            pair_most / max(n - 1, 1),
            np.log(kinds) / np.log(n) if n > 1 else 1,
            np.log1p(len(line)),
            line_kinds / max(len(line), 1),
            line_most / max(len(line), 1),
            symbols / n,
            capitals / n,
        ]
    return out


_NOT_NEWLINE = np.ones(256, dtype=bool)
_NOT_NEWLINE[[10, 13]] = False


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    calibration: Isotonic

    @classmethod
    def start(cls, mean: np.ndarray, scale: np.ndarray, features: int, seed: int = 1) -> QualityModel:
        rng = np.random.default_rng(seed)
        width = len(mean)
        # half of the features see the kernel at a wide and half at a narrow bandwidth
        spread = np.where(np.arange(features) % 2 == 0, 0.35, 1.0) / np.sqrt(width)
        return cls(mean, scale, rng.standard_normal((width, features)) * spread, rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), Isotonic.empty())

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ self.projection + self.phase), np.ones((len(z), 1))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        return self.calibration(self.features(stats) @ self.weights)


def with_statistics(docs: DataFrame, drop: tuple[str, ...] = ("text",)) -> DataFrame:
    def work(batch: pa.RecordBatch) -> dict:
        return {"_stats": [row.tobytes() for _, run in chunked(batch.column("text").to_pylist()) for row in statistics(run)]}

    return with_columns(docs, lambda: work, "_stats binary", drop)


def _stats(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("_stats").to_pylist())).reshape(-1, WIDTH)


def learn(docs: DataFrame, labels: DataFrame, column: str = "quality", most: int = MOST_LABELLED, features: int = FEATURES, strength: float = STRENGTH) -> QualityModel:
    """A model of ``labels.column`` (0 or 1) from the texts of ``docs``.

    About ``most`` labelled documents are read.  Without any the model scores 0.5;
    where all have one label it scores close to that label.
    """
    sample = labelled_sample(labels, [column], most)
    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most about ``most`` ids
    rows = settle(with_statistics(picked).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int")))

    def first(batch: pa.RecordBatch) -> np.ndarray:
        x = _stats(batch)
        return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    totals = sum(sums(rows, first, 1 + 2 * WIDTH).values())
    if not np.any(totals):
        return QualityModel.start(np.zeros(WIDTH), np.ones(WIDTH), features)
    mean = totals[1 : 1 + WIDTH] / totals[0]
    variance = np.maximum(totals[1 + WIDTH :] / totals[0] - mean * mean, 0)
    model = QualityModel.start(mean, np.where(variance > 1e-12, np.sqrt(variance), 1.0), features)
    width = features + 1

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        return pack_moments(model.features(_stats(batch)), batch.column(column).to_numpy())

    by_fold = sums(rows, moments, width * width + width)
    others = {k: solve(v, width, strength)[:, 0] for k, v in leave_out(by_fold).items()}

    def counted(batch: pa.RecordBatch) -> np.ndarray:
        weights = others[batch.column("fold")[0].as_py()]
        return Isotonic.counts(model.features(_stats(batch)) @ weights, batch.column(column).to_numpy())

    counts = sum(sums(rows, counted, -1).values())
    model.weights = solve(sum(by_fold.values()), width, strength)[:, 0]
    model.calibration = Isotonic(*counts.reshape(2, -1))
    return model


def score(docs: DataFrame, model: QualityModel, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``score`` from 0 to 1, higher where the label 1 is likelier.

    Null and empty texts have the statistics of an empty text and are scored
    like others; a column ``score`` is replaced; equal texts have equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers per feature

    def work(batch: pa.RecordBatch) -> dict:
        out = [shared.value.score(statistics(run)) for _, run in chunked(batch.column("text").to_pylist())]
        return {"score": np.concatenate(out) if out else []}

    return with_columns(docs, lambda: work, "score double", drop)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels of those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn(docs, labels.where(~held_out(5, 0)))
    scored = score(docs.withColumn("held_out", held_out(5, 0)), model, drop=("text",))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))
