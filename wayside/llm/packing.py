"""Best-fit packing of tokenised documents into sequences of fixed capacity.

A sequence has three capacities: tokens, documents and attention cost (the sum
of squared piece lengths).  Pieces go, longest first, to the open sequence that
fits under every capacity and scores best: the smallest weighted norm of what
stays free (``norm``), or the largest weighted cosine between the piece and what
is free (``dot``).

Only lengths matter to that choice, so it runs on the histogram of lengths: all
pieces of one length and all sequences with the same free capacity are placed
together, as ranges of ranks and sequence numbers.  The driver sees at most
``capacity`` counts, whatever the number of documents; pieces find their range
in a join on (length, block of ranks).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayside.llm.arrow import bounded
from wayside.session import settle

CAPACITY = 4096
END_ID = 1
#: Distinct words whose ids a task keeps; others are encoded again when they recur.
KEPT_WORDS = 500_000
#: Ranks of one length that share a join key.
BLOCK = 256

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACE_SCHEMA = "length long, rank_from long, rank_to long, first_sequence long, offset long"


#: Punctuation that the vocabulary's splitting never joins to a letter or digit before it.
_TAIL = ".,;:!?#%&*$|"
#: Lower-case words of these letters are one unit of the vocabulary and pass its normalisation unchanged.
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


def _byte_symbols() -> list[str]:
    """The symbol of each byte in byte-level vocabularies: itself if it is printable, else the next one from 256."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class _WordIds(dict):
    """Little-endian ids of a word.

    The vocabulary drops white space and never joins across it, so words can be
    encoded one by one.  Plain words go to its model at once, others through the
    whole tokenizer; both give the ids of the whole text's encoding.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        self.symbols = _byte_symbols()

    def _encode(self, word: str) -> bytes:
        core = word.rstrip(_TAIL)
        if len(core) < len(word) and core and core[-1].isalnum():
            return self[core] + self[word[len(core) :]]
        low = word.lower()
        if not _LETTERS.fullmatch(low):
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        elif low != word:
            return self[low]
        else:
            ids = [t.id for t in self.model.tokenize(low if low.isascii() else "".join(self.symbols[b] for b in low.encode()))]
        return np.array(ids, dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self._encode(word)
        if len(self) < KEPT_WORDS and len(word) < 64:
            self[word] = ids
        return ids


_known: dict[str, _WordIds] = {}


def _word_ids(tokenizer_path: str) -> _WordIds:
    """One cache for all tasks of a worker process."""
    if tokenizer_path not in _known:
        _known[tokenizer_path] = _WordIds(tokenizer_path)
    return _known[tokenizer_path]


def tokenize(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``.

    A document is its ids followed by ``end_id``; it is cut only where it is
    longer than ``capacity``.  Null and empty texts give the end id alone; rows
    that repeat give their pieces again; further columns are ignored.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        known = _word_ids(path)
        width = 4 * capacity
        for batch in batches:
            rows = []
            for row, text in enumerate(batch.column("text").to_pylist()):
                words = (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
                ids = b"".join(map(known.__getitem__, words)) + end
                for piece, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append((row, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            made = np.array(rows, dtype=np.int64).reshape(-1, 5).T
            doc_id = batch.column("doc_id").take(pa.array(made[0]))
            columns = [doc_id, pa.array(made[1].astype(np.int32)), *(pa.array(c) for c in made[2:])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bounded(texts).mapInArrow(cut, PIECE_SCHEMA)


def plan_places(
    counts: dict[int, int],
    capacity: int = CAPACITY,
    max_docs: int | None = None,
    max_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0),
    select: str = "norm",
) -> list[tuple[int, int, int, int, int]]:
    """Ranges ``(length, rank_from, rank_to, first_sequence, offset)``: rank r of a length goes to sequence first + r - from.

    The work depends on the number of different lengths only.
    """
    if select not in ("norm", "dot"):
        raise ValueError("select must be norm or dot")
    limits = np.array([capacity, max_docs or capacity, max_attention or capacity * capacity], dtype=float)
    weight = np.array(weights, dtype=float)
    open_: dict[tuple[int, int, int], list[list[int]]] = {}  # free (tokens, documents, attention) -> [first sequence, how many]
    places: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def free_after(free: tuple[int, int, int], length: int, times: int = 1) -> tuple[int, int, int]:
        tokens = free[0] - times * length
        # more than this can never be used by what still fits, so sequences that differ only there are alike
        return tokens, min(free[1] - times, tokens), min(free[2] - times * length * length, tokens * tokens)

    def put(free: tuple[int, int, int], first: int, n: int) -> None:
        if min(free) > 0:
            open_.setdefault(free, []).append([first, n])

    for length in sorted(counts, reverse=True):
        if length * length > limits[2]:
            raise ValueError(f"a piece of {length} tokens exceeds the attention capacity alone")
        item = np.array([length, 1, length * length], dtype=float)
        rank, left = 0, counts[length]
        while left and open_:
            keys = np.array(list(open_), dtype=float)
            fits = (keys >= item).all(axis=1)
            if not fits.any():
                break
            if select == "norm":
                score = (weight * ((keys - item) / limits) ** 2).sum(axis=1)
            else:
                a, r = item / limits, keys / limits
                score = -(weight * a * r).sum(axis=1) / np.sqrt((weight * r * r).sum(axis=1))
            key = tuple(int(x) for x in keys[np.where(fits, score, np.inf).argmin()])
            runs = open_[key]
            after = free_after(key, length)
            while runs and left:
                first, n = runs[-1]
                k = min(n, left)
                places.append((length, rank, rank + k, first, capacity - key[0]))
                put(after, first, k)
                rank, left = rank + k, left - k
                if k == n:
                    runs.pop()
                else:
                    runs[-1] = [first + k, n - k]
            if not runs:
                del open_[key]
        start = (capacity, min(int(limits[1]), capacity), min(int(limits[2]), capacity * capacity))
        each = max(1, min(capacity // length, start[1], start[2] // (length * length)))
        for n, per in ((left // each, each), (1, left % each)):  # full sequences of this length alone, then one with the rest
            if n == 0 or per == 0:
                continue
            for slot in range(per):
                places.append((length, rank, rank + n, opened, slot * length))
                rank += n
            put(free_after(start, length, per), opened, n)
            opened += n
    return places


def pack(pieces: DataFrame, capacity: int = CAPACITY, max_docs: int | None = None, max_attention: int | None = None, weights=(1.0, 1.0, 1.0), select: str = "norm") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: every capacity holds and offsets have no gaps.

    Without ``max_docs`` and ``max_attention`` those capacities are the largest
    that a sequence of ``capacity`` tokens can reach.  Equal pieces are placed
    in any order; an empty table gives an empty result.  ``length`` has to lie
    between 1 and ``capacity``.
    """
    spark = pieces.sparkSession
    # ranks are counted within stored partitions, so that no length, however common, meets in one task
    stored = settle(pieces).withColumn("_part", F.spark_partition_id())
    per_part = stored.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    counts = {int(r["length"]): int(r["n"]) for r in stored.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = spark.createDataFrame(plan_places(counts, capacity, max_docs, max_attention, weights, select), PLACE_SCHEMA)
    before = per_part.select(
        "length", "_part", (F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_before")
    ).fillna(0, ["_before"])
    ranked = (
        stored.withColumn("_row", F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece")))
        .join(before, ["length", "_part"])
        .withColumn("_rank", F.col("_before") + F.col("_row") - 1)
        .withColumn("_block", F.floor(F.col("_rank") / BLOCK))
    )
    spans = places.withColumn("_block", F.explode(F.sequence(F.floor(F.col("rank_from") / BLOCK), F.floor((F.col("rank_to") - 1) / BLOCK))))
    joined = ranked.join(spans, ["length", "_block"]).where("_rank >= rank_from AND _rank < rank_to")
    return joined.select(*pieces.columns, (F.col("first_sequence") + F.col("_rank") - F.col("rank_from")).alias("sequence_id"), "offset")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return pack(tokenize(spark.read.parquet(f"{sf_dir}/documents.parquet")))
