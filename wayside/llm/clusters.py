"""Centroid clustering with heap-ordered bounds, in exact integers.

After a vector was scanned, it is known how far it lies from its centroid (u)
and from the second nearest (l).  It cannot change its cluster before the
centroids have moved by more than the gap l - u: its own by p_j and the others
by at most their largest step.  So each cluster accumulates its drift, p_j plus
the largest step of the others, and a vector is filed under its cluster with the
key "gap plus drift so far".  A cluster's heap yields its smallest keys; those
that the drift has reached are popped, scanned exactly and filed again.

The heaps are tables.  Each round's newly filed vectors are one stored run,
sorted by cluster and key, and popping reads the range of keys between the
former and the present drift of each cluster, which Parquet's statistics narrow
down to the row groups concerned.  A key is popped once, as drift only grows, so
runs are never rewritten, and what is left of all runs is the assignment.
Centroids follow from sums that are corrected by the vectors that moved.

Gaps and drifts are rounded towards popping; distances, ties and sums are exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayside.llm.exact import ROUNDING, matrix, on_grid, squared_distances, summed, usable
from wayside.llm.storage import stored

SCALE = 64
WIDTH = 64
CLUSTERS = 16
ROUNDS = 3

_RUN = "vec_id long, q array<int>, cluster int, before int, key double"


@dataclass
class Clustering:
    """``assigned (vec_id, cluster, distance)`` of all kept vectors, the final centroids, and the rows that each round scanned."""

    assigned: DataFrame
    centroids: np.ndarray
    scanned: list[int]


def scan(rows: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """A stored run: ``rows (vec_id, q, before)`` with the nearest centroid and the key, sorted as a heap's range is read."""
    k, width = centroids.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = squared_distances(matrix(batch.column("q"), width), centroids)
            cluster = d.argmin(axis=1)  # the first of equal ones
            at = np.arange(len(d))
            near = np.sqrt(d[at, cluster].astype(float))
            rest = d.astype(float)
            rest[at, cluster] = np.inf
            gap = np.sqrt(rest.min(axis=1, initial=np.inf)) * (1 - ROUNDING) - near * (1 + ROUNDING)
            key = (drift[cluster] + gap) - np.where(np.isfinite(gap), ROUNDING * (drift[cluster] + np.abs(gap)), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("q"), pa.array(cluster.astype(np.int32)), batch.column("before"), pa.array(key)],
                names=["vec_id", "q", "cluster", "before", "key"],
            )

    return stored(rows.select("vec_id", "q", "before").mapInArrow(work, _RUN).sortWithinPartitions("cluster", "key"))


def moved(run: DataFrame, k: int, width: int) -> np.ndarray:
    """Change of the sums (k x width) and, in a last column, the counts by the vectors of a run that changed their cluster; exact."""

    def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
        q = np.column_stack([matrix(batch.column("q"), width), np.ones(batch.num_rows, dtype=np.int64)])
        cells = total.reshape(k, width + 1)
        for name, sign in (("cluster", 1), ("before", -1)):
            of = batch.column(name).to_numpy()
            for j in np.unique(of[of >= 0]):
                cells[j] += sign * q[of == j].sum(axis=0)

    totals = summed(run.where("cluster <> before").select("q", "cluster", "before"), add, k * (width + 1))
    return np.array(totals, dtype=object).reshape(k, width + 1)


def _within(low: np.ndarray | None, high: np.ndarray) -> Column:
    """Keys above ``low`` (where given) and up to ``high`` of their cluster."""
    ranges = []
    for j, top in enumerate(high.tolist()):
        inside = (F.col("cluster") == j) & (F.col("key") <= top)
        ranges.append(inside if low is None else inside & (F.col("key") > float(low[j])))
    return reduce(Column.__or__, ranges)


def cluster(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE) -> Clustering | None:
    """Clusters of the vectors with ``width`` components, all there and finite, in integers ``floor(scale * x)``.

    Null vectors, other lengths, null or non-finite components, and components
    whose integer is beyond 2**26 (their squares would not fit a long) are not
    kept.  Equal vectors and repeated rows count each for itself; of equal
    hashes the one with the smaller components comes first, rows without an id
    come last.  With fewer vectors than ``clusters`` there are as many centroids
    as vectors, without any the result is None.  Other columns are passed over.
    """
    vector = F.col("vector")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("vector"))
    kept = rows.where(F.coalesce(F.size(vector) == width, F.lit(False)) & usable(vector, scale)).select("vec_id", on_grid(vector, scale).alias("q"), F.lit(-1).alias("before"))
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(order.asc_nulls_last(), "q").limit(clusters).select("q").collect()
    if not first:
        return None
    centroids = np.array([r["q"] for r in first], dtype=np.int64)
    k = len(centroids)
    drift = np.zeros(k)
    drifts, runs = [drift], [scan(kept, centroids, drift)]
    totals = np.zeros((k, width + 1), dtype=object)
    for _ in range(rounds):
        totals = totals + moved(runs[-1], k, width)
        new = np.array([[int(s) // int(t[-1]) for s in t[:-1]] if t[-1] else c for t, c in zip(totals, centroids.tolist(), strict=True)], dtype=np.int64)
        steps = np.array([math.sqrt(int(((a - b) ** 2).sum())) for a, b in zip(new, centroids, strict=True)]) * (1 + ROUNDING)
        others = np.array([max(np.delete(steps, j), default=0.0) for j in range(k)])
        drift, centroids = (drift + steps + others) * (1 + ROUNDING), new
        popped = [run.where(_within(drifts[-1] if at < len(runs) - 1 else None, drift)) for at, run in enumerate(runs)]
        due = reduce(DataFrame.unionByName, popped).select("vec_id", "q", F.col("cluster").alias("before"))
        drifts.append(drift)
        runs.append(scan(due, centroids, drift))
    left = [run.where(~_within(None, drift)) for run in runs[:-1]] + [runs[-1]]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column("cluster").to_numpy()
            off = matrix(batch.column("q"), width) - centroids[of]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array((off * off).sum(axis=1))], names=["vec_id", "cluster", "distance"])

    assigned = stored(reduce(DataFrame.unionByName, left).select("vec_id", "cluster", "q").mapInArrow(measure, "vec_id long, cluster int, distance long"))
    return Clustering(assigned, centroids, [run.count() for run in runs])


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every embedding, with its inertia and the digest of its centroid."""
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    found = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    if found is None:
        return spark.createDataFrame([], schema)
    by_cluster = found.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n"))
    inertia = {r["cluster"]: int(r["n"]) for r in by_cluster.collect()}  # a row per cluster
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    of_cluster = spark.createDataFrame([(j, inertia.get(j, 0), sum(inertia.values()), d) for j, d in enumerate(digests)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.assigned.join(F.broadcast(of_cluster), "cluster").select(*[c.split()[0] for c in schema.split(", ")])


def oracle_sql() -> str:
    """All rounds over all pairs of vectors and centroids in DuckDB."""
    parts = [
        f"""kept AS MATERIALIZED (
        SELECT row_number() OVER () AS r, vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS q FROM embeddings
        WHERE len(embedding) = {WIDTH} AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"cell AS MATERIALIZED (SELECT r, i, q[i] AS x FROM kept, range(1, {WIDTH + 1}) AS t(i))",
        f"""first AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS c FROM kept
        QUALIFY c < {CLUSTERS})""",
        "centroid0 AS MATERIALIZED (SELECT c, i, x AS y FROM first JOIN cell USING (r))",
    ]
    for n in range(ROUNDS + 1):
        parts.append(f"""near{n} AS MATERIALIZED (
        SELECT r, c, d FROM (SELECT r, c, sum((x - y) * (x - y)) AS d FROM cell JOIN centroid{n} USING (i) GROUP BY r, c)
        QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if n < ROUNDS:
            parts.append(f"""centroid{n + 1} AS MATERIALIZED (
        SELECT c, i, coalesce(CAST(floor(s / n) AS BIGINT), y) AS y
        FROM centroid{n} LEFT JOIN (SELECT c, i, sum(x) AS s, count(*) AS n FROM near{n} JOIN cell USING (r) GROUP BY c, i) USING (c, i))""")
    last = f"near{ROUNDS}"
    return f"""
    WITH {", ".join(parts)},
    digest AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM centroid{ROUNDS} GROUP BY c)
    SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
        CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
    FROM {last} JOIN kept USING (r) JOIN digest USING (c)"""
