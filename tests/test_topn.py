"""The first n rows per key at any n, and nearest places in dense and remote spots, against plain sorting."""

import random

import pytest
from pyspark.sql import functions as F

from wayside.operators import links
from wayside.operators.topn import THRESHOLD, first_per_key


@pytest.mark.parametrize("n", [1, 256, 1001, 10_000])
def test_first_rows_with_one_hot_key(spark, n):
    before = spark.conf.get(THRESHOLD)
    try:
        rng = random.Random(n)
        keys = ["hot"] * 12_000 + [f"k{i % 50}" for i in range(600)] + [None] * 30
        rows = [(k, rng.randint(0, 500) if rng.random() < 0.99 else None, i) for i, k in enumerate(keys)]
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "key string, value int, id int").repartition(6)
        cut = first_per_key(df, ["key"], ["value", "id"], n, salts=5)
        want = {}
        for k, v, i in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            want.setdefault(k, []).append(i)
        got = {}
        for r in cut.collect():
            got.setdefault(r.key, set()).add(r.id)
        assert got == {k: set(ids[:n]) for k, ids in want.items()}
        plan = cut._jdf.queryExecution().executedPlan().toString()
        assert plan.count("WindowGroupLimit") >= 4 and plan.count("Partial") >= 2  # cut before both shuffles, and after them
    finally:
        spark.conf.set(THRESHOLD, before)


def test_first_rows_without_rows(spark):
    df = spark.createDataFrame([], "key string, value int")
    assert first_per_key(df, ["key"], ["value"], 3, salts=2).count() == 0


@pytest.mark.parametrize(("k", "radius"), [(3, None), (40, None), (300, None), (3, 2500.0), (40, 400.0)])
def test_nearest_in_dense_and_remote_spots(spark, k, radius):
    """A dense town, villages, an island far away and a pole; 260 places in all, so k = 300 asks for more than there are."""
    rng = random.Random(k)
    town = [(35.68 + rng.gauss(0, 0.004), 139.76 + rng.gauss(0, 0.004)) for _ in range(180)]
    rest = [(35.0 + rng.uniform(0, 2), 138 + rng.uniform(0, 2)) for _ in range(60)] + [(24.3, 124.15), (89.9, 0.0), (-89.9, 179.9), (0.0, -179.99), (0.0, 179.99)]
    places = [*town, *rest, *[town[0]] * 15]
    spots = [town[0], town[5], (35.68, 139.77), (35.9, 139.2), (24.0, 124.0), (-33.0, 151.0), (90.0, 0.0), (0.0, 180.0), (43.0, 141.3)]
    right = spark.createDataFrame([(f"b{i:03d}", *p) for i, p in enumerate(places)], "b string, latitude double, longitude double")
    left = spark.createDataFrame([(float(a), float(o)) for a, o in spots], "latitude double, longitude double")
    pairs = left.withColumnsRenamed({"latitude": "from_latitude", "longitude": "from_longitude"}).crossJoin(right.withColumnsRenamed({"latitude": "to_latitude", "longitude": "to_longitude"}))
    want = {}
    for r in links.with_distance(pairs).collect():
        if radius is None or r.distance_m <= radius:
            want.setdefault((r.from_latitude, r.from_longitude), []).append((r.distance_m, r.b))
    got = {}
    for r in links.nearest(left, right, k, ("b",), radius).collect():
        got.setdefault((r.from_latitude, r.from_longitude), []).append((r["rank"], r.distance_m, r.b))
    assert {p: [x[1:] for x in sorted(v)] for p, v in got.items()} == {p: sorted(v)[:k] for p, v in want.items()}


def test_spots_are_listed_at_chosen_sizes_only(spark, monkeypatch):
    """Points in a dense spot choose small cubes; no place is read at larger ones."""
    asked, blocks = [], links._blocks
    monkeypatch.setattr(links, "_blocks", lambda points, spots, levels: asked.append(levels) or blocks(points, spots, levels))
    right = spark.range(400).select(F.format_string("b%03d", "id").alias("b"), (35 + F.col("id") % 20 * 0.0001).alias("latitude"), (139 + F.floor(F.col("id") / 20) * 0.0001).alias("longitude"))
    left = spark.createDataFrame([(35.001, 139.001), (35.0005, 139.0)], "latitude double, longitude double")
    assert links.nearest(left, right, 3, ("b",)).count() == 6
    assert asked == [[0], [0, 1]]


def test_nearest_without_places_or_points(spark):
    none = spark.createDataFrame([], "b string, latitude double, longitude double")
    some = spark.createDataFrame([("x", 1.0, 2.0)], "b string, latitude double, longitude double")
    assert links.nearest(some.drop("b"), none, 2, ("b",)).count() == 0
    assert links.nearest(none.drop("b"), some, 2, ("b",)).count() == 0
    assert [r.b for r in links.nearest(some.drop("b"), some, 2, ("b",)).collect()] == ["x"]
