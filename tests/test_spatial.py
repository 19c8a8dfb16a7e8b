"""Distance joins against brute force, at the poles and the date line, too."""

import math
import random

from pyspark.sql import functions as F

from wayside.operators import links


def sphere(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 6371000.0 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def points(rng, n):
    spots = [(35.0, 139.0), (89.99, 10.0), (-10.0, 179.995), (60.0, -0.01)]
    return [(lat + rng.uniform(-0.02, 0.02) if abs(lat) < 89 else 89.95 + rng.uniform(0, 0.05), ((lon + rng.uniform(-0.03, 0.03) if abs(lat) < 89 else rng.uniform(-180, 180)) + 180) % 360 - 180) for lat, lon in (rng.choice(spots) for _ in range(n))]


def frame(spark, rows, name):
    return spark.createDataFrame([(f"{name}{i:04d}", *p) for i, p in enumerate(rows)], f"{name} string, latitude double, longitude double")


def test_within_join_equals_brute_force(spark):
    rng = random.Random(3)
    a, b = points(rng, 60), points(rng, 150)
    got = {(r.a, r.b) for r in links.within_join(frame(spark, a, "a"), frame(spark, b, "b"), 1500.0, "sphere").collect()}
    want = {(f"a{i:04d}", f"b{j:04d}") for i, x in enumerate(a) for j, y in enumerate(b) if sphere(x, y) <= 1500.0}
    assert got == want and want


def test_nearest_equals_brute_force(spark):
    rng = random.Random(4)
    a, b = points(rng, 40), points(rng, 120)
    b += [b[0]] * 40  # a hot coordinate
    left, right = frame(spark, a, "a"), frame(spark, b, "b")
    found = links.nearest(left.select("latitude", "longitude").distinct(), right, 5, ("b",))
    rows = left.join(found, (F.col("latitude") == F.col("from_latitude")) & (F.col("longitude") == F.col("from_longitude"))).collect()
    pairs = left.withColumnsRenamed({"latitude": "from_latitude", "longitude": "from_longitude"}).crossJoin(right.withColumnsRenamed({"latitude": "to_latitude", "longitude": "to_longitude"}))
    every = {}
    for r in links.with_distance(pairs).collect():
        every.setdefault(r.a, []).append((r.distance_m, r.b))
    got = {}
    for r in rows:
        got.setdefault(r.a, []).append((r.distance_m, r.b))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:5] for k, v in every.items()}


def test_derived_links_and_unlinked(spark):
    geo = spark.createDataFrame([("a", 35.0, 139.0), ("z", 10.0, 10.0)], "school_id string, latitude double, longitude double")
    st = spark.createDataFrame([(f"s{i}", "L", 35.0 + i * 0.002, 139.0) for i in range(20)], "station_id string, line_name string, latitude double, longitude double")
    got = links.derive_links(geo, st)
    rows = sorted((r.station_id, r.walking_minutes, r.distance_meters) for r in got.collect())
    assert rows == [("s0", 1, 0), ("s1", 3, 222), ("s2", 6, 444)]
    assert [r.school_id for r in links.unlinked_schools(geo, got).collect()] == ["z"]


def test_ellipsoid_is_geodesic(spark):
    # one degree of latitude at the equator and of longitude on it, WGS84
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0), (35.0, 139.0, 35.0, 139.0)], "from_latitude double, from_longitude double, to_latitude double, to_longitude double")
    got = [r.distance_m for r in links.with_distance(df).collect()]
    assert abs(got[0] - 110574.389) < 0.1 and abs(got[1] - 111319.491) < 0.1 and got[2] == 0.0


def test_within_join_works_out_each_pair_of_spots_once(spark):
    """Rows at one coordinate are multiplied after the distances; rows without a coordinate are near nothing."""
    a, b = frame(spark, [(35.0, 139.0)] * 30 + [(35.001, 139.0)], "a"), frame(spark, [(35.0, 139.001)] * 40 + [(36.0, 139.0)], "b")
    none = spark.createDataFrame([("none", None, 139.0)], "a string, latitude double, longitude double")
    near = links.within_join(a.unionByName(none), b, 1500.0, "sphere")
    assert near.columns == ["a", "from_latitude", "from_longitude", "b", "to_latitude", "to_longitude", "distance_m"]
    rows = near.collect()
    assert len({(r.a, r.b) for r in rows}) == len(rows) == 31 * 40
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [latitude") + plan.count("Aggregate [from_latitude") + plan.count("Aggregate [to_latitude") == 2
