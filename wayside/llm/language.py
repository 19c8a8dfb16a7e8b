"""Language identification with bit-sliced Bloom filters of letter n-grams.

For each language the most frequent n-grams that are typical of it go into a
Bloom filter.  All filters share their hash functions and lie side by side: a
position holds one bit per language, so the AND of an n-gram's positions is the
bit mask of all languages that contain it.  A text's hits are counted per
language, the expected false positives (from each filter's fill) are taken off,
and the language with the largest share of known n-grams wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayside.llm.arrow import with_columns
from wayside.llm.words import mix

UNDETERMINED = "und"
SIZES = (3, 4)
HASHES = 4
POSITIONS = 1 << 19
#: Bounds of what is learned: documents per language (expected number of a sample by hash) and n-grams per language.
DOCS_PER_LANGUAGE = 4000
GRAMS_PER_LANGUAGE = 20_000
#: An n-gram is kept for a language if its share there is at least this part of its largest share.
TYPICAL = 0.1
#: Code points that are worked on together.
CHUNK = 1 << 20

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def _runs(texts: list[str | None]) -> Iterator[list[str]]:
    run, size = [], 0
    for text in texts:
        low = (text or "").lower()
        if run and size + len(low) > CHUNK:
            yield run
            run, size = [], 0
        run.append(low)
        size += len(low) + 2
    if run:
        yield run


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts and the index of each one's text.

    Whatever is no letter is a blank, and blanks in a row are one; n-grams lie within a text and hold a letter.
    """
    table = _letter_table()
    points = np.frombuffer((" " + "  ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    letter = table[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a blank after a letter ends a word
    keep[:-1] |= letter[1:] & ~letter[:-1]  # and one before a letter begins it
    # two words with one blank between them keep one blank: the one that ends the first
    begins = np.zeros_like(keep)
    begins[:-1] = letter[1:] & ~letter[:-1]
    ends = np.zeros_like(keep)
    ends[1:] = letter[:-1] & ~letter[1:]
    last = np.maximum.accumulate(np.where(letter, np.arange(len(points)), -1))
    same = np.zeros_like(keep)
    inner = begins & ~ends
    same[inner] = (last[inner] >= 0) & (owner[np.maximum(last[inner], 0)] == owner[inner])
    keep &= ~same
    symbols = np.where(letter, points, 32)[keep].astype(np.uint64)
    of = owner[keep]
    hashes, owners = [], []
    for n in SIZES:
        if len(symbols) < n:
            continue
        code = np.full(len(symbols) - n + 1, n, dtype=np.uint64)
        for j in range(n):
            code = code * np.uint64(1_099_511_628_211) + symbols[j : len(symbols) - n + 1 + j]
        inside = of[: len(code)] == of[n - 1 :]
        hashes.append(mix(code[inside]))
        owners.append(of[: len(code)][inside])
    if not hashes:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


@dataclass
class LanguageFilter:
    """``masks[p, w]``: bits of the languages whose filter has position p set, 64 languages per word."""

    languages: list[str]
    masks: np.ndarray

    def positions(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        step = (codes >> np.uint64(32)) | np.uint64(1)
        for k in range(HASHES):
            yield ((codes + np.uint64(k) * step) & np.uint64(len(self.masks) - 1)).astype(np.int64)

    @classmethod
    def of(cls, grams_of: dict[str, np.ndarray], positions: int = POSITIONS) -> LanguageFilter:
        """``grams_of``: n-gram hashes by language, most common language first."""
        filled = cls(list(grams_of), np.zeros((positions, max(1, (len(grams_of) + 63) // 64)), dtype=np.uint64))
        for i, codes in enumerate(grams_of.values()):
            for at in filled.positions(codes):
                filled.masks[at, i // 64] |= np.uint64(1 << (i % 64))
        return filled

    def bit(self, masks: np.ndarray, i: int) -> np.ndarray:
        return ((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(bool)

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language the corrected share of known n-grams; per text the number of n-grams."""
        codes, of = grams(texts)
        total = np.bincount(of, minlength=len(texts)).astype(float)
        found = None
        for at in self.positions(codes):
            found = self.masks[at] if found is None else found & self.masks[at]
        out = np.zeros((len(texts), len(self.languages)))
        for i in range(len(self.languages)):
            false = self.bit(self.masks, i).mean() ** HASHES
            hits = np.bincount(of[self.bit(found, i)], minlength=len(texts))
            out[:, i] = np.clip((hits - total * false) / np.maximum(total, 1) / (1 - false), 0, 1)
        return out, total


def learn(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, grams_per_language: int = GRAMS_PER_LANGUAGE) -> LanguageFilter:
    """Filters from ``text`` and non-null ``lang`` of ``docs``.

    From each language a sample by hash of the id is read, about ``docs_per_language`` whole texts; the result holds
    at most ``grams_per_language`` n-grams of each.  An empty table gives a filter without languages.
    """
    spark = docs.sparkSession
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageFilter([], np.zeros((1, 1), dtype=np.uint64))
    rates = spark.createDataFrame([(lang, min(1.0, docs_per_language / n)) for lang, n in counts.items()], "lang string, _rate double")
    u = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.join(F.broadcast(rates), "lang").where(u < F.col("_rate")).select("lang", "text")  # one row per language

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                for run in _runs(list(texts)):
                    codes, n = np.unique(grams(run)[0], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": codes.view(np.int64), "n": n})

    counted = sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    per_language = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    share = counted.join(F.broadcast(per_language), "lang").withColumn("share", F.col("n") / F.col("total"))
    most = share.groupBy("gram").agg(F.max("share").alias("most"))
    typical = share.join(most, "gram").where(F.col("share") >= TYPICAL * F.col("most"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = typical.withColumn("rank", rank).where(F.col("rank") <= grams_per_language).groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect()
    by = {r["lang"]: np.array(r["grams"], dtype=np.int64).view(np.uint64) for r in rows}
    return LanguageFilter.of({lang: by.get(lang, np.empty(0, dtype=np.uint64)) for lang in sorted(counts, key=lambda x: (-counts[x], x))})


def identify(docs: DataFrame, model: LanguageFilter, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the corrected share of the text's n-grams that the language knows.

    A null text and one without letters get ``und`` and 0; a text whose n-grams
    no language knows gets the most common language and 0; ties go to the more
    common language.  Columns of these names are replaced, others except ``drop`` are kept.
    """
    if not model.languages:
        return docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)}).drop(*drop)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by POSITIONS and the number of languages

    def predict(batch: pa.RecordBatch) -> dict:
        filters = shared.value
        langs, scores = [], []
        for run in _runs(batch.column("text").to_pylist()):
            shares, total = filters.shares(run)
            langs += [filters.languages[i] if n else UNDETERMINED for i, n in zip(shares.argmax(axis=1), total, strict=True)]
            scores += shares.max(axis=1).tolist()
        return {"lang_pred": langs, "score": scores}

    return with_columns(docs, lambda: predict, "lang_pred string, score double", drop)


def held_out(divisor: int, rest: int):
    """Whether crc32 of the id as text leaves ``rest``; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == rest, F.lit(False))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.where(~held_out(4, 2)))
    return identify(docs.select("doc_id", held_out(4, 2).alias("held_out"), "text"), model, drop=("text",))
