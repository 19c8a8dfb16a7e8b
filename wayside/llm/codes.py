"""Vectors as short codes: each part is replaced by its nearest codebook entry, found in a GNAT.

A node of the tree holds split points among the entries; every other entry is in
the child of its nearest split point.  For each split point and each child the
node stores the least and the largest distance between the two.  A query measures
the split points; a child whose range lies further from the measured distance
than the best entry so far is left out with all below it.  A child goes only if
it is strictly further, with bounds rounded the other way, so entries at equal
distance are all seen; distances are exact integers and ties go to the lower
index.  The trees are small (64 entries a part) and searched for a batch of
vectors at a time.

Codebooks are refined over all vectors: tasks sum the parts of each entry, Spark
adds up the tasks, and the driver divides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayside.llm.exact import ROUNDING, matrix, on_grid, squared_distances, summed, usable
from wayside.llm.storage import stored

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Split points of a node, and the most entries that are compared without a node.
DEGREE = 8
LEAF = 4
#: Rows of one label that meet in a join, about.
PER_SALT = 100_000
LEAST_SALTS = 16


@dataclass
class Gnat:
    """A tree over the rows ``of`` of ``entries``; without split points they are compared one by one."""

    entries: np.ndarray
    of: np.ndarray
    splits: np.ndarray = field(init=False)
    children: list[Gnat] = field(init=False, default_factory=list)
    low: np.ndarray = field(init=False)
    high: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.splits = np.empty(0, dtype=np.int64)
        if len(self.of) <= LEAF:
            return
        between = squared_distances(self.entries[self.of], self.entries[self.of])
        chosen = [0]  # each further split point lies as far from the others as can be
        while len(chosen) < min(DEGREE, len(self.of)):
            away = between[:, chosen].min(axis=1)
            away[chosen] = -1
            chosen.append(int(away.argmax()))
        rest = np.setdiff1d(np.arange(len(self.of)), chosen)
        nearest = between[np.ix_(rest, chosen)].argmin(axis=1)
        groups = [rest[nearest == j] for j in range(len(chosen))]
        groups = [g for g in groups if len(g)]
        self.splits = self.of[chosen]
        away = np.sqrt(between[chosen].astype(float))
        self.low = np.array([away[:, g].min(axis=1) for g in groups]).reshape(len(groups), len(chosen)) * (1 - ROUNDING)
        self.high = np.array([away[:, g].max(axis=1) for g in groups]).reshape(len(groups), len(chosen)) * (1 + ROUNDING)
        self.children = [Gnat(self.entries, self.of[g]) for g in groups]


class Search:
    """Nearest entries (``index``, ``distance`` squared) of the rows of ``queries``; ``measured`` counts distances."""

    def __init__(self, tree: Gnat, queries: np.ndarray):
        self.queries = queries
        self.index = np.full(len(queries), len(tree.entries), dtype=np.int64)
        self.distance = np.full(len(queries), np.iinfo(np.int64).max, dtype=np.int64)
        self.measured = 0
        self._visit(tree, np.arange(len(queries)))

    def _measure(self, tree: Gnat, at: np.ndarray, of: np.ndarray) -> np.ndarray:
        of = np.sort(of)
        d = squared_distances(self.queries[at], tree.entries[of])
        self.measured += d.size
        k = d.argmin(axis=1)  # the first, so the lowest index, of equal ones
        best, index = d[np.arange(len(at)), k], of[k]
        closer = (best < self.distance[at]) | ((best == self.distance[at]) & (index < self.index[at]))
        self.distance[at[closer]], self.index[at[closer]] = best[closer], index[closer]
        return d

    def _visit(self, tree: Gnat, at: np.ndarray) -> None:
        if not len(at) or not len(tree.of):
            return
        if not len(tree.splits):
            self._measure(tree, at, tree.of)
            return
        away = np.sqrt(self._measure(tree, at, tree.splits).astype(float))[:, np.argsort(np.argsort(tree.splits))]
        for child, low, high in zip(tree.children, tree.low, tree.high, strict=True):
            bound = np.maximum(away * (1 - ROUNDING) - high, low - away * (1 + ROUNDING)).max(axis=1)
            reach = np.sqrt(self.distance[at].astype(float)) * (1 + ROUNDING)
            self._visit(child, at[bound <= reach])


def search(codebooks: list[Gnat], q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code (rows x parts) and squared distance of every row."""
    width = q.shape[1] // len(codebooks)
    found = [Search(tree, q[:, p * width : (p + 1) * width]) for p, tree in enumerate(codebooks)]
    return np.stack([s.index for s in found], axis=1), np.sum([s.distance for s in found], axis=0, dtype=np.int64)


def trees(books: np.ndarray) -> list[Gnat]:
    return [Gnat(book, np.arange(len(book))) for book in books]


def train(rows: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """``books`` (parts x entries x width) after ``rounds`` rounds over ``rows (q)``; an entry that nothing uses stays."""
    parts, entries, width = books.shape
    for _ in range(rounds):
        codebooks = trees(books)

        def add(batch: pa.RecordBatch, total: np.ndarray, codebooks: list[Gnat] = codebooks) -> None:
            q = matrix(batch.column("q"), parts * width)
            code, _ = search(codebooks, q)
            cells = total.reshape(parts, entries, width + 1)
            for p in range(parts):
                cells[p, :, width] += np.bincount(code[:, p], minlength=entries)
                for d in range(width):
                    np.add.at(cells[p, :, d], code[:, p], q[:, p * width + d])

        totals = np.array(summed(rows.select("q"), add, parts * entries * (width + 1)), dtype=object).reshape(parts, entries, width + 1)
        used = np.array(totals[..., width] > 0, dtype=bool)
        books = books.copy()
        books[used] = np.array([[int(s) // int(t[-1]) for s in t[:-1]] for t in totals[used]], dtype=np.int64).reshape(-1, width)
    return books


def encode(
    vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, error`` of all kept vectors, in integers ``floor(scale * x)``, and the codebooks (parts x entries x width).

    Rows whose vector is null or holds a null or non-finite component, or one
    whose integer is beyond 2**26 (its squares would not fit a long), are
    dropped.  All vectors must have the length of the one with the smallest id
    whose length is a positive multiple of ``parts``; others have a null code
    and error.  Equal ids are ordered by their integers, rows without an id come
    last; repeated rows count each for itself.  With fewer vectors than
    ``entries`` the codebooks are as short.  An empty table gives no rows and
    empty codebooks.  Other columns are passed over.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(column).alias("vector"))
    kept = stored(rows.where(usable(F.col("vector"), scale)).select("vec_id", "label", on_grid(F.col("vector"), scale).alias("q")))
    order = [F.col("vec_id").asc_nulls_last(), "q"]
    whole = kept.where((F.size("q") > 0) & (F.size("q") % parts == 0))
    least = whole.orderBy(*order).select("q").first()
    size = len(least["q"]) if least else 0
    fitting = whole.where(F.size("q") == size)
    first = fitting.orderBy(*order).limit(entries).select("q").collect()
    books = np.array([r["q"] for r in first], dtype=np.int64).reshape(len(first), parts, size // parts).swapaxes(0, 1)
    books = train(fitting, books, rounds) if first else books
    codebooks = trees(books)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = search(codebooks, matrix(batch.column("q"), size))
            text = pa.array([bytes(c).hex() for c in code.astype(np.uint8)], type=pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), text, pa.array(error)], names=["vec_id", "label", "code", "error"])

    schema = f"vec_id long, label {kept.schema['label'].dataType.simpleString()}, code string, error long"
    coded = fitting.select("vec_id", "label", "q").mapInArrow(work, schema)
    others = kept.where((F.size("q") == 0) | (F.size("q") != size)).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return coded.unionByName(others), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the sum of ``error`` over equal labels, nulls together.

    A label may hold most rows: its rows are dealt to salts, as many as the
    table's size asks for, that are summed and joined one by one.
    """
    coded = stored(coded)
    salts = max(LEAST_SALTS, coded.count() // PER_SALT)
    dealt = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)))
    parts = dealt.groupBy("label", "salt").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("n"))
    totals = parts.groupBy("label").agg(F.sum("n").cast("long").alias("label_error"), F.collect_list("salt").alias("salts"))
    back = totals.select(F.col("label").alias("of"), F.explode("salts").alias("at"), "label_error")
    return dealt.join(back, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("at"))).select(*coded.columns, "label_error")


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every embedding, the error of its label, and the digest of the codebooks."""
    coded, books = encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql() -> str:
    """All rounds over all parts and entries in DuckDB, for vectors of one length."""
    parts = [
        f"""kept AS MATERIALIZED (
        SELECT row_number() OVER () AS r, vec_id, label, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS q, len(embedding) // {PARTS} AS w FROM embeddings
        WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
        "cell AS MATERIALIZED (SELECT r, (i - 1) // w AS p, (i - 1) % w AS i, x FROM (SELECT r, w, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM kept))",
        f"first AS (SELECT r, row_number() OVER (ORDER BY vec_id, q) - 1 AS e FROM kept QUALIFY e < {ENTRIES})",
        "entry0 AS MATERIALIZED (SELECT p, e, i, x AS y FROM first JOIN cell USING (r))",
    ]
    for n in range(ROUNDS + 1):
        parts.append(f"""near{n} AS MATERIALIZED (
        SELECT r, p, e, d FROM (SELECT r, p, e, sum((x - y) * (x - y)) AS d FROM cell JOIN entry{n} USING (p, i) GROUP BY r, p, e)
        QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY d, e) = 1)""")
        if n < ROUNDS:
            parts.append(f"""entry{n + 1} AS MATERIALIZED (
        SELECT p, e, i, coalesce(CAST(floor(s / n) AS BIGINT), y) AS y
        FROM entry{n} LEFT JOIN (SELECT p, e, i, sum(x) AS s, count(*) AS n FROM near{n} JOIN cell USING (r, p) GROUP BY p, e, i) USING (p, e, i))""")
    return f"""
    WITH {", ".join(parts)},
    coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY r)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, i)) FROM entry{ROUNDS}) AS codebooks_sha256
    FROM coded JOIN kept USING (r)"""
