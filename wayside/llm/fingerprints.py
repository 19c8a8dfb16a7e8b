"""I-Match fingerprints over randomised lexicons.

The lexicon holds the terms whose inverse document frequency lies in a band.  It
is thinned out at random ``SUBSETS`` times, each time at ``LEVELS`` rates (half of
the terms, a quarter, ...).  A document's distinct terms that lie in a thinned
lexicon give one hash; the hashes of all lexicons, with the number of terms, are
its fingerprint.  Two documents agree in a hash if no term in which they differ
lies in that lexicon, so the shares of equal hashes at the different rates tell
how many terms differ, and with the numbers of terms their likeness.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayside.llm.words import ALPHANUMERIC, chunked, mix, word_hashes

SUBSETS = 16
LEVELS = 10
#: The band: terms in at least LEAST of the documents (two at least) and in at most MOST of them.
LEAST, MOST = 1e-4, 0.1
#: Most terms of the lexicon; beyond, the band begins at a higher document frequency.
LEXICON = 1 << 18
#: Steps per doubling when the band's lower end is raised.
_STEPS = 16

_SEEDS = mix(np.arange(1, SUBSETS + 1, dtype=np.uint64))
_VALUE_SEED = np.uint64(0x5851F42D4C957F2D)
_DIFFERENCES = np.unique(np.concatenate(([0], np.round(np.geomspace(1, 1e6, 160))))).astype(float)
_EQUAL = (1 - 0.5 ** np.arange(1, LEVELS + 1))[:, None] ** _DIFFERENCES  # chance of an equal hash by level and number of different terms
_LOG_EQUAL = np.log(np.clip(_EQUAL, 1e-12, 1 - 1e-6))
_LOG_OTHER = np.log(np.clip(1 - _EQUAL, 1e-6, 1 - 1e-12))


def distinct_terms(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term hashes of each text, sorted, one text after another; and the index of each one's text."""
    words, bounds = word_hashes(run, ALPHANUMERIC)
    each = [np.unique(words[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return np.concatenate(each) if each else words, np.repeat(np.arange(len(each)), [len(x) for x in each])


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``term, df`` over all whole texts; terms are hashes of runs of letters and digits in lower case."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [distinct_terms(run)[0] for _, run in chunked(batch.column(0).to_pylist())]
            terms, n = np.unique(np.concatenate(found) if found else np.empty(0, dtype=np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

    return docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


def lexicon(docs: DataFrame, least: float = LEAST, most: float = MOST, size: int = LEXICON) -> np.ndarray:
    """Sorted terms of the band, at most ``size``."""
    n = docs.count()
    low, high = max(2, math.ceil(least * n)), max(2, math.floor(most * n))
    step = F.floor(F.log2("df") * _STEPS)
    banded = document_frequencies(docs).where(F.col("df").between(low, high)).withColumn("step", step).persist()
    try:
        per_step = sorted(banded.groupBy("step").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"])  # a row per step, not per term
        kept, total = [], 0
        for r in per_step:
            total += r["n"]
            if total > size:
                break
            kept.append(r["step"])
        rows = banded.where(F.col("step") >= min(kept)).select("term").toPandas()["term"].to_numpy() if kept else np.empty(0, dtype=np.int64)
    finally:
        banded.unpersist()
    return np.sort(rows.astype(np.int64).view(np.uint64))


def fingerprints(run: list[bytes], terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of terms, 16-bit hashes by document, subset and level) of encoded texts.

    A document without any term of the lexicon is described by all its terms.
    """
    found, of = distinct_terms(run)
    if len(terms):
        known = terms[np.minimum(np.searchsorted(terms, found), len(terms) - 1)] == found
    else:
        known = np.zeros(len(found), dtype=bool)
    keep = known | (np.bincount(of[known], minlength=len(run)) == 0)[of]
    found, of = found[keep], of[keep]
    sums = np.empty((len(run), SUBSETS, LEVELS))
    for k, seed in enumerate(_SEEDS):
        h = mix(found ^ seed)
        # the number of leading zeros, at most LEVELS: the lexicons of a subset lie within one another
        level = np.minimum(64 - np.frexp(h.astype(np.float64))[1], LEVELS)
        value = (mix(h ^ _VALUE_SEED) >> np.uint64(32)).astype(np.float64)  # sums of these are exact below 2**21 terms
        by = np.bincount(of * (LEVELS + 1) + level, weights=value, minlength=len(run) * (LEVELS + 1)).reshape(len(run), LEVELS + 1)
        sums[:, k] = np.cumsum(by[:, :0:-1], axis=1)[:, ::-1]
    hashes = (mix(np.fmod(sums, 2.0**53).astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)
    return np.bincount(of, minlength=len(run)), hashes


def text_of(n: int, hashes: np.ndarray) -> str:
    return f"{n:x}-{hashes.astype('>u2').tobytes().hex()}"


def likeness(n: np.ndarray, hashes: np.ndarray, other_n: np.ndarray, other_hashes: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness of the term sets, row by row; two documents without terms are alike."""
    equal = (hashes == other_hashes).sum(axis=1).astype(float)  # by row and level
    different = _DIFFERENCES[(equal @ _LOG_EQUAL + (SUBSETS - equal) @ _LOG_OTHER).argmax(axis=1)]
    total = n + other_n
    apart = np.maximum(np.minimum(different, total), np.abs(n - other_n))
    apart = np.where((hashes == other_hashes).all(axis=(1, 2)), np.abs(n - other_n), apart)
    return np.where(total > 0, (total - apart) / np.maximum(total + apart, 1), 1.0)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the beginning of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _bucket(column: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are not above the column: first among groups, then within one."""
    if not bounds:
        return F.lit(0)
    width = math.ceil(math.sqrt(len(bounds)))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    firsts = F.array(*[F.lit(g[0]) for g in groups])
    group = F.size(F.filter(firsts, lambda x: x <= column))
    inner = F.element_at(F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups]), F.greatest(group, F.lit(1)))
    return F.when(group == 0, 0).otherwise((group - 1) * width + F.size(F.filter(inner, lambda x: x <= column)))


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows ``_bucket, _tail, doc_id, text``, in partitions sorted so that each row without ``_tail`` is followed by its next document.

    The order is ascending ``doc_id`` (null first, equal ids by text); after the
    last document comes the first.  Ids are cut into buckets at quantiles; the
    first document of a bucket is repeated, marked ``_tail``, behind the bucket
    before it, so a text moves once and no window spans the table.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    quantiles = docs.select("doc_id").approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.2 / buckets) if buckets > 1 else []
    bounds = sorted({int(q) for q in quantiles})
    cut = docs.withColumn("_bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(_bucket(F.col("doc_id"), bounds)))
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")
    firsts = sorted((r["_bucket"], r["first"]["doc_id"]) for r in cut.groupBy("_bucket").agg(F.min(key).alias("first")).collect())  # a row per bucket
    before = [(b, firsts[i - 1][0], first) for i, (b, first) in enumerate(firsts)]
    tails = spark.createDataFrame(before, "_bucket int, _before int, _first long")
    joined = cut.join(F.broadcast(tails), "_bucket")
    own = F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("tail"))
    tail = F.when(F.col("doc_id").eqNullSafe(F.col("_first")), F.struct(F.col("_before").alias("b"), F.lit(True).alias("tail")))
    placed = joined.select("doc_id", "text", F.explode(F.array_compact(F.array(own, tail))).alias("at"))
    placed = placed.select(F.col("at.b").alias("_bucket"), F.col("at.tail").alias("_tail"), "doc_id", "text")
    return placed.repartition(buckets, "_bucket").sortWithinPartitions("_bucket", "_tail", F.col("doc_id").asc_nulls_first(), "text")


def compare_with_next(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """Fingerprints of every document and of its edited text, and likeness to that and to the next document.

    Null texts count as empty; a single document is its own next; an empty
    table gives no rows; rows that repeat are documents of their own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # at most LEXICON numbers
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        last: list[tuple] = []
        for batch in batches:
            rows = [*last, *zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)]
            last = rows[-1:]
            for first, run in chunked([r[3] for r in rows]):
                # one more row than the run: the next one of its last
                here = rows[first : first + len(run) + 1]
                n, hashes = fingerprints([*run, *(r[3].encode() for r in here[len(run) :])], known)
                own = [i for i in range(min(len(run), len(here) - 1)) if not here[i][1]]
                texts = [edited(here[i][3], here[i + 1][3]).encode() for i in own]
                if not own:
                    continue
                at, following = np.array(own), np.array(own) + 1
                edited_n, edited_hashes = fingerprints(texts, known)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([here[i][2] for i in own], type=pa.int64()),
                        pa.array([len(here[i][3]) for i in own], type=pa.int64()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                        pa.array([text_of(n[i], hashes[i]) for i in own]),
                        pa.array([text_of(a, b) for a, b in zip(edited_n, edited_hashes, strict=True)]),
                        pa.array(likeness(n[at], hashes[at], edited_n, edited_hashes)),
                        pa.array(likeness(n[at], hashes[at], n[following], hashes[following])),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return with_next(docs).mapInArrow(work, schema)


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of all documents, of their edited texts, and how near these are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return compare_with_next(docs, lexicon(docs))
