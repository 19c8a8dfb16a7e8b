"""Toxicity categories from a chain of linear models.

Features are the presence of words and word beginnings that tell the categories
apart best.  The models of the chain are ridge models with isotonic calibration;
each one also sees the probabilities of the categories before it.  In training
these come from models that did not see the row (out of fold), in use from the
final models.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayside.llm.arrow import with_columns
from wayside.llm.language import held_out
from wayside.llm.ridge import Isotonic, labelled_sample, leave_out, pack_moments, solve, sums
from wayside.llm.words import chunked, words_and_beginnings
from wayside.session import settle

BEGINNINGS = (4, 5, 6, 8)
FEATURES_PER_CATEGORY = 160
FOLDS = 4
STRENGTH = 1.0
#: Labelled documents that are learned from, about (a sample by hash beyond that).
MOST_LABELLED = 20_000
#: A document counts as toxic from this probability.
THRESHOLD = 0.5


def distinct_features(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature hashes of each text and the index of each one's text."""
    hashes, of = words_and_beginnings(run, BEGINNINGS)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[new], of[new]


def presence(run: list[bytes], features: np.ndarray) -> np.ndarray:
    """0/1 matrix of texts and sorted ``features``."""
    out = np.zeros((len(run), len(features)))
    hashes, of = words_and_beginnings(run, BEGINNINGS)
    if len(features) and len(hashes):
        at = np.minimum(np.searchsorted(features, hashes), len(features) - 1)
        known = features[at] == hashes
        out[of[known], at[known]] = 1
    return out


@dataclass
class ToxicityModel:
    """``links``: for each category the weights, whose last entries belong to the categories before it and the constant, and the calibration."""

    categories: list[str]
    features: np.ndarray
    links: list[tuple[np.ndarray, Isotonic]]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        for weights, calibration in self.links:
            x = np.hstack([x, calibration(_with_constant(x) @ weights)[:, None]])
        return x[:, len(self.features) :]


def _with_constant(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def choose_features(picked: DataFrame, categories: list[str], per_category: int) -> np.ndarray:
    """The features with the largest chi-square for each category, sorted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.column_stack([batch.column(c).to_numpy() for c in categories])
            hashes, rows = [], []
            for first, run in chunked(batch.column("text").to_pylist()):
                h, of = distinct_features(run)
                hashes.append(h)
                rows.append(of + first)
            if not hashes:
                continue
            found, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
            row = np.concatenate(rows)
            columns = [np.bincount(inverse, minlength=len(found)).astype(float), *(np.bincount(inverse, weights=labels[row, i], minlength=len(found)) for i in range(len(categories)))]
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), *(pa.array(c) for c in columns)], names=["feature", "n", *(f"y{i}" for i in range(len(categories)))])

    names = [f"y{i}" for i in range(len(categories))]
    counted = picked.select("text", *categories).mapInArrow(count, "feature long, n double, " + ", ".join(f"{c} double" for c in names))
    total = settle(counted.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ["n", *names]]).where("n >= 3"))
    whole = picked.agg(F.count("*").alias("n"), *[F.sum(c).alias(f"y{i}") for i, c in enumerate(categories)]).first()
    chosen: set[int] = set()
    for i in range(len(categories)):
        positive, n = whole[f"y{i}"] or 0.0, whole["n"]
        expected = F.col("n") * (positive / max(n, 1))
        chi = (F.col(f"y{i}") - expected) ** 2 / (expected * F.lit(max(1 - positive / max(n, 1), 1e-9)) + F.lit(1e-9))
        chosen |= {r["feature"] for r in total.orderBy(chi.desc(), "feature").limit(per_category).collect()}
    return np.sort(np.array(sorted(chosen), dtype=np.int64).view(np.uint64))


def learn(docs: DataFrame, labels: DataFrame, categories: list[str], most: int = MOST_LABELLED, per_category: int = FEATURES_PER_CATEGORY, strength: float = STRENGTH) -> ToxicityModel:
    """A chain over ``categories``, columns (0 or 1) of ``labels``, in this order.

    About ``most`` labelled documents are read; rows with a null label are not.
    Without any labelled text every probability is 0.5.
    """
    sample = labelled_sample(labels, categories, most)
    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most about ``most`` ids
    features = choose_features(picked, categories, per_category)

    def work(batch: pa.RecordBatch) -> dict:
        return {"_x": [np.packbits(row.astype(bool)).tobytes() for _, run in chunked(batch.column("text").to_pylist()) for row in presence(run, features)]}

    folded = picked.withColumn("fold", F.pmod(F.xxhash64(F.lit("chain"), "doc_id"), F.lit(FOLDS)).cast("int"))
    rows = settle(with_columns(folded, lambda: work, "_x binary", drop=("text",)))
    links: list[tuple[np.ndarray, Isotonic]] = []
    others: list[dict[int, np.ndarray]] = []  # weights that did not see a fold

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        """Features and out-of-fold probabilities of the categories so far; a batch holds one fold."""
        packed = np.frombuffer(b"".join(batch.column("_x").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
        x = np.unpackbits(packed, axis=1)[:, : len(features)].astype(float)
        fold = batch.column("fold")[0].as_py()
        for by_fold, (_, calibration) in zip(others, links, strict=True):
            x = np.hstack([x, calibration(_with_constant(x) @ by_fold[fold])[:, None]])
        return _with_constant(x)

    for i, category in enumerate(categories):
        width = len(features) + i + 1

        def moments(batch: pa.RecordBatch, category: str = category) -> np.ndarray:
            return pack_moments(matrix(batch), batch.column(category).to_numpy())

        by_fold = sums(rows, moments, width * width + width)
        if not by_fold:
            links.append((np.zeros(width), Isotonic.empty()))
            others.append({})
            continue
        left_out = {k: solve(v, width, strength)[:, 0] for k, v in leave_out(by_fold).items()}

        def counted(batch: pa.RecordBatch, category: str = category, left_out: dict = left_out) -> np.ndarray:
            return Isotonic.counts(matrix(batch) @ left_out[batch.column("fold")[0].as_py()], batch.column(category).to_numpy())

        counts = sum(sums(rows, counted, -1).values())
        others.append(left_out)
        links.append((solve(sum(by_fold.values()), width, strength)[:, 0], Isotonic(*counts.reshape(2, -1))))
    return ToxicityModel(categories, features, links)


def score(docs: DataFrame, model: ToxicityModel, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``p_<category>``, from 0 to 1, for each category of the chain.

    Null and empty texts are scored as texts without any feature; columns of
    these names are replaced; equal texts have equal scores.
    """
    names = [f"p_{c}" for c in model.categories]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred features

    def work(batch: pa.RecordBatch) -> dict:
        known = shared.value
        parts = [known.probabilities(presence(run, known.features)) for _, run in chunked(batch.column("text").to_pylist())]
        whole = np.concatenate(parts) if parts else np.empty((0, len(names)))
        return {c: whole[:, i] for i, c in enumerate(names)}

    return with_columns(docs, lambda: work, ", ".join(f"{c} double" for c in names), drop)


#: The chain of the query.  The table marks quality and toxicity; its categories are low quality, toxic, and both at once.
CHAIN = ["low_quality", "toxic", "toxic_low_quality"]


def chain_labels(labels: DataFrame) -> DataFrame:
    low = 1 - F.col("quality")
    return labels.select("doc_id", low.alias("low_quality"), "toxic", (low * F.col("toxic")).alias("toxic_low_quality"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of those with crc32(doc_id) mod 5 not 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn(docs, chain_labels(labels.where(~held_out(5, 0))), CHAIN)
    scored = score(docs.withColumn("held_out", held_out(5, 0)), model, drop=("text",))
    toxic = F.col("p_toxic") >= THRESHOLD
    return scored.select(
        "doc_id", "held_out", toxic.alias("toxic"), F.col("p_toxic").alias("score"), toxic.cast("int").alias("predicted"), "p_low_quality", "p_toxic_low_quality"
    )
