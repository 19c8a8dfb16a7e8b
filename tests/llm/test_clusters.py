import hashlib
import math

import numpy as np
import pytest

from wayside.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, cluster string, q string, key string"


def brute(rows, k, rounds, width, scale):
    """Every round over all vectors in Python integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, near, strict=True) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted((str(i), c, d) for (i, _), (d, c) in zip(kept, assign(), strict=True)), centroids


def made(seed, n, width):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, width))
    x = centres[rng.integers(0, 6, n)] + rng.standard_normal((n, width)) * 0.3
    x[rng.random(n) < 0.3] = x[0]
    return [(int(i) % 90, [float(c) for c in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize(("seed", "k", "rounds", "width", "scale"), [(1, 7, 6, 5, 8), (2, 5, 4, 2, 2)])
def test_equals_all_pairs(spark, seed, k, rounds, width, scale):
    rows = made(seed, 300, width)
    rows += [(None, rows[3][1]), (None, [0.0] * width), (400, None), (401, []), (402, [1.0] * (width + 1)), (403, [None] * width), (404, [float("nan")] * width), (405, [float("-inf")] * width)]
    df = spark.createDataFrame([(*r, "clash", "clash", None) for r in rows], SCHEMA).repartition(3)
    got = clusters.cluster(df, clusters=k, rounds=rounds, width=width, scale=scale)
    want, centroids = brute(rows, k, rounds, width, scale)
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in got.assigned.collect()) == want
    assert got.centroids.tolist() == centroids
    assert got.scanned[0] == len(want) and len(got.scanned) == rounds + 1
    assert sum(got.scanned[1:]) < rounds * len(want)  # some gaps held


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-(2**25), 2**25, 4)]) for i in range(60)] + [(99, [2.0**40] * 4)]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    got = clusters.cluster(df, clusters=4, rounds=2, width=4, scale=1)
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in got.assigned.collect()) == brute(rows[:-1], 4, 2, 4, 1)[0]


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5], None, None, None), (1, [0.5, 0.5], None, None, None)], SCHEMA)
    got = clusters.cluster(df, width=2)
    assert len(got.centroids) == 2 and [tuple(r) for r in got.assigned.collect()] == [(1, 0, 0)] * 2
    assert clusters.cluster(df.limit(0)) is None


def test_popping_reads_key_ranges(spark):
    rows = made(4, 100, 3)
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    run = clusters.scan(df.selectExpr("vec_id", "transform(embedding, x -> cast(floor(64 * x) as int)) AS q", "-1 AS before"), np.zeros((1, 3), dtype=np.int64), np.zeros(1))
    plan = run.where(clusters._within(None, np.ones(1)))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(cluster), IsNotNull(key), EqualTo(cluster,0), LessThanOrEqual(key" in plan


def test_query_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, centroids = brute(rows, 16, 3, 64, 64)
    got = clusters.op12_clusters(spark, sf).collect()
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in got) == want
    assert {r["inertia"] for r in got} == {sum(d for *_, d in want)}
    for r in got:
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()
