"""Candidate lists against a plain cross join, with lists that are cut."""

import random
from dataclasses import replace

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayside.config import DEFAULT_CONFIG
from wayside.functions.geo import add_direction, ellipsoid_m, sphere_m
from wayside.functions.text import truthy
from wayside.operators import retrieval

SIG = (
    "sig string, target_station_id string, target_name string, target_line_name string, target_line_id string, target_area_id string, target_latitude double,"
    "target_longitude double, explicit boolean, has_line boolean, has_area boolean, line_id string, ctx_line_name string, city_name string, prefecture_name string,"
    "conflict boolean, area_origin string, line_origin string, max_hops int, adjacent_lines array<string>, adjacent_areas array<string>"
)
LINK = (
    "school_id string, station_id string, walking_minutes short, distance_meters int, hop_distance short, line_name string, candidate_line_id string,"
    "candidate_area_id string, latitude double, longitude double, school_area string, school_area_id string, school_prefecture_name string"
)


def links(spark, n, seed=1):
    r, rows = random.Random(seed), []
    for i in range(n):
        s, line = i % 12, "ABC"[i % 3]
        rows.append((
            f"s{r.randrange(n)}", f"c{s}", r.randrange(1, 30), r.randrange(40), r.randrange(5), line, None if s % 4 == 0 else f"line_{line}", None if s == 5 else f"area_{s % 3}",
            35.0 + (s % 5) * 0.008, 139.0 + (s // 5) * 0.01, r.choice(["Aa", "Bb", "Cc", None]), None, r.choice(["Pp", "Qq", None]),
        ))
    rows += rows[:3]  # the same link twice
    rows += [(*x[:5], "B", "line_B", *x[7:]) for x in rows[:3]]  # and in two kinds
    return spark.createDataFrame(rows, LINK)


def signatures(spark, n, seed=2):
    r, rows = random.Random(seed), []
    for i in range(n):
        s, line = r.randrange(12), r.choice([None, "A", "B"])
        rows.append((
            f"g{i}", f"c{s}", "t", "A", None, None, 35.0 + (s % 5) * 0.008, 139.0 + (s // 5) * 0.01, r.random() < 0.7, False, False,
            r.choice([None, f"line_{line}"]) if line else None, line, r.choice([None, None, "aa", "bb"]), r.choice([None, None, "pp"]), False, None, None, r.choice([2, 3, None]),
            r.choice([[], ["line_B"], ["line_B", "line_C"]]), r.choice([[], ["area_0"], ["area_1", "area_2"]]),
        ))
    return spark.createDataFrame(rows, SIG)


def expected(sigs, enriched, cfg):
    """Every signature with every link."""
    pairs = add_direction(sigs, "target_latitude", "target_longitude", "_a").crossJoin(add_direction(enriched, "latitude", "longitude", "_b"))
    rows = retrieval._flags(pairs, cfg.neighbor_cap_meters).where("bucket < 6")
    order = W.partitionBy("sig").orderBy("bucket", *retrieval.CONTRACT)
    ranked = rows.withColumn("position", F.dense_rank().over(order)).where(F.col("position") <= cfg.candidate_limit)
    return {(x.sig, x.position, x.bucket, x.school_id, x.station_id) for x in ranked.collect()}


def test_lists_that_are_cut_give_what_a_cross_join_gives(spark):
    enriched, sigs = links(spark, 60).cache(), signatures(spark, 60).cache()
    for limit in (3, 256):
        cfg = replace(DEFAULT_CONFIG, retrieval_limit=limit)
        got = retrieval.context_candidates(sigs, enriched, cfg).where("bucket < 6").select("sig", "position", "bucket", "school_id", "station_id").collect()
        assert len(got) == len(set(got))
        assert {tuple(x) for x in got} == expected(sigs, enriched, cfg)


def test_requests_share_their_lists(spark, monkeypatch):
    """What goes into the lists follows from the links and the spots, not from the number of requests."""
    seen, own = [], retrieval._lists

    def counted(rows, *rest):
        seen.append(rows.count())
        return own(rows, *rest)

    monkeypatch.setattr(retrieval, "_lists", counted)
    enriched, one = links(spark, 60).cache(), signatures(spark, 1)
    one = one.withColumns({"explicit": F.lit(True), "line_id": F.lit(None).cast("string"), "ctx_line_name": F.lit(None).cast("string")}).cache()
    sums = []
    for times in (1, 50):
        seen.clear()
        many = one.drop("sig").crossJoin(spark.range(times).select(F.concat(F.lit("g"), "id").alias("sig")))
        assert retrieval.context_candidates(many, enriched).select("sig").distinct().count() == times
        sums.append(sum(seen))
    assert sums[0] == sums[1] > 0


def test_signatures_are_dealt_out_before_their_links(spark):
    """Links with the signature's columns are those of the candidates, and no shuffle follows their multiplication."""
    enriched, sigs = links(spark, 60).cache(), signatures(spark, 20).cache()
    found = retrieval.candidate_lists(sigs, enriched)
    got = retrieval.signature_links(found, sigs)
    key = ["sig", *retrieval.LINK]
    assert sorted(map(str, got.select(*key).collect())) == sorted(map(str, retrieval.candidate_rows(found).select(*key).collect()))
    assert set(got.columns) == {*sigs.columns, *retrieval.LINK}
    inside = retrieval.signature_links(found._replace(outside=found.outside.limit(0)), sigs)
    plan = inside._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan[: plan.index("Generate explode(links")]


def test_requests_of_a_signature_come_in_parts(spark):
    sigs = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "sig string, x int")
    rows = [("a", f"r{i}") for i in range(50)] + [("a", "r1"), ("b", None), ("b", "z"), ("d", "y")]
    got = retrieval.with_requests(sigs, spark.createDataFrame(rows, "sig string, request_id string"), most=10).collect()
    assert sorted(((g.sig, g.x, r.request_id) for g in got for r in g.requests), key=str) == sorted(((s, {"a": 1, "b": 2}[s], r) for s, r in rows if s != "d"), key=str)
    assert len([g for g in got if g.sig == "a"]) > 2


def test_retrieved_links_come_once(spark):
    """Each link once, however many lists name it, and those beyond every flag, too."""
    lists = spark.createDataFrame([(f"g{i}", [0, 1, 2 + i % 3]) for i in range(200)] + [("g", []), ("h", None)], "sig string, links array<long>")
    numbered = spark.createDataFrame([(i, f"s{i // 2}", f"t{i // 2}", i) for i in range(8)], "_n long, school_id string, station_id string, distance_meters int")
    outside = spark.createDataFrame([("g", "s0", "t0"), ("g", "s9", "t9"), ("h", "s9", "t9")], "sig string, school_id string, station_id string")
    got = sorted(map(tuple, retrieval.retrieved_links(retrieval.Candidates(lists, numbered, outside)).collect()))
    assert got == [("s0", "t0"), ("s1", "t1"), ("s2", "t2"), ("s9", "t9")]


def targets(spark, n, seed=3):
    r, rows = random.Random(seed), []
    for i in range(n):
        s = r.randrange(14)
        rows.append((f"r{i}", f"c{s}", r.choice(["A", "B", "none", None]), None if i % 9 == 8 else 35.0 + (s % 5) * 0.008, 139.0 + (s // 5) * 0.01, r.choice([2, 3, None])))
    return spark.createDataFrame(rows, "request_id string, target_station_id string, target_line_name string, target_latitude double, target_longitude double, max_hops int")


def ranked_pairs(pairs, limit, first, *columns):
    order = W.partitionBy("request_id").orderBy(*first, *retrieval.CONTRACT)
    rows = pairs.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
    return sorted(map(str, rows.select("request_id", *columns, "position").collect()))


def test_station_candidates_give_what_a_cross_join_gives(spark):
    enriched, asked = links(spark, 60).dropDuplicates(retrieval.CONTRACT).cache(), targets(spark, 40).cache()
    c = F.col
    pairs = add_direction(asked, "target_latitude", "target_longitude", "_a").crossJoin(add_direction(enriched, "latitude", "longitude", "_b"))
    direct = c("station_id") == c("target_station_id")
    near = (c("line_name") == c("target_line_name")) & (c("hop_distance") <= c("max_hops")) & (ellipsoid_m("_a", "_b") <= DEFAULT_CONFIG.neighbor_cap_meters)
    pairs = pairs.where(truthy(direct) | truthy(near))
    for limit in (3, 256):
        got = retrieval.station_candidates(asked, enriched, replace(DEFAULT_CONFIG, retrieval_limit=limit))
        want = ranked_pairs(pairs, limit, [(~direct).cast("int")], "school_id", "station_id")
        assert sorted(map(str, got.select("request_id", "school_id", "station_id", "position").collect())) == want and len(want) > 40


def test_projection_candidates_give_what_a_cross_join_gives(spark):
    projection, asked = links(spark, 60).dropDuplicates(retrieval.CONTRACT).cache(), targets(spark, 40).cache()
    c = F.col
    direct = c("station_id") == c("target_station_id")
    metres = sphere_m("target_latitude", "target_longitude", "latitude", "longitude")
    # nothing is off a line that is unknown
    nearby = (metres <= DEFAULT_CONFIG.neighbor_cap_meters) & c("target_line_name").isNotNull()
    boost = F.when(direct, 3.0).when(c("line_name") == c("target_line_name"), 1.0).when(nearby, 0.5)
    pairs = asked.crossJoin(projection).withColumn("boost", boost).where("boost IS NOT NULL")
    for limit in (3, 256):
        best = W.partitionBy("request_id").orderBy(c("boost").desc(), *retrieval.CONTRACT)
        hits = pairs.withColumn("_hit", F.row_number().over(best)).where(c("_hit") <= limit)
        got = retrieval.projection_candidates(asked, projection, replace(DEFAULT_CONFIG, retrieval_limit=limit))
        want = ranked_pairs(hits, limit, [(~direct).cast("int")], "school_id", "station_id", "boost")
        assert sorted(map(str, got.select("request_id", "school_id", "station_id", "boost", "position").collect())) == want
    assert all(f"boost={x}" in str(want) for x in (0.5, 1.0, 3.0))


def test_candidates_are_counted_and_named_from_their_lists(spark):
    """Counts are those of the candidate rows, named links those of all rows, with links in two kinds and links beyond every flag."""
    far = {n: F.lit(None).cast("string") for n in ("line_id", "ctx_line_name", "city_name", "prefecture_name")} | {"sig": F.lit("far"), "explicit": F.lit(False)}
    far |= {n: F.array().cast("array<string>") for n in ("adjacent_lines", "adjacent_areas")}
    enriched, sigs = links(spark, 60).cache(), signatures(spark, 40).unionByName(signatures(spark, 1).withColumns(far)).cache()
    found = retrieval.candidate_lists(sigs, enriched)
    rows = retrieval.candidate_rows(found).cache()
    assert rows.where("sig = 'far' AND bucket = 6").count() > 0
    assert {tuple(r) for r in retrieval.candidate_counts(found).collect()} == {tuple(r) for r in rows.groupBy("sig").count().collect()}
    keys = rows.select("sig", "school_id", "station_id").distinct().where("hash(school_id, sig) % 3 = 0")
    got = retrieval.named_links(found, sigs, keys)
    want = retrieval.signature_links(found, sigs).join(keys, ["sig", "school_id", "station_id"], "left_semi")
    assert set(got.columns) == set(want.columns) and want.count() > 100
    assert sorted(map(str, got.select(*sorted(got.columns)).collect())) == sorted(map(str, want.select(*sorted(got.columns)).collect()))


def test_blocks_are_sent_their_links(spark):
    """Rows are those of a plain join, and the multiplied ones are not shuffled, though no table is broadcast."""
    from wayside.session import ALL_KEYS, settle

    enriched, sigs = links(spark, 60).cache(), signatures(spark, 40).cache()
    found = retrieval.candidate_lists(sigs, enriched)
    places = settle(enriched.select("school_id", "station_id", "latitude").distinct().withColumn("latitude", F.hash("station_id", "latitude").cast("double")))
    setting = {"spark.sql.autoBroadcastJoinThreshold": "-1", ALL_KEYS: "false"}
    before = {n: spark.conf.get(n) for n in setting}
    try:
        for n, v in setting.items():
            spark.conf.set(n, v)
        got = retrieval.placed_links(found._replace(outside=found.outside.limit(0)), sigs, places)
        rows = sorted(map(str, got.select(*sorted(got.columns)).collect()))
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    want = retrieval.signature_links(found._replace(outside=found.outside.limit(0)), sigs).join(places, ["school_id", "station_id"])
    assert rows == sorted(map(str, want.select(*sorted(got.columns)).collect())) and len(rows) > 100
    whole = plan[plan.index("Generate explode(links") :]
    assert "ShuffledHashJoin" in plan[: plan.index("Generate explode(links")] and "Exchange" not in plan[plan.index("ShuffledHashJoin") : plan.index("Generate explode(links")] and whole
