"""Ranking on small fixtures, against plain Python and known answers."""

import random

from pyspark.sql import functions as F

from wayside.config import STAGES, RankingConfig
from wayside.operators import evaluation, explain, ranking
from wayside.operators.context import FIELDS

SCEN = (
    "scenario_id string, target_station_id string, limit int, user_id string, placement string, debug boolean, has_context boolean, has_area boolean,"
    "has_line boolean, city_name string, prefecture_name string, line_id string, line_name string, ctx_station_id string, warnings " + FIELDS["warnings"]
)
SCHOOL = "scenario_id string, id string, name string, area string, prefecture_name string, school_type string, group_id string"
STATION = "scenario_id string, id string, name string, line_name string, line_id string, area_id string, latitude double, longitude double"
LINK = "scenario_id string, school_id string, station_id string, walking_minutes short, distance_meters int, hop_distance short, line_name string"
EVENT = (
    "scenario_id string, id string, school_id string, title string, event_category string, is_open_day boolean, is_featured boolean,"
    "priority_weight double, placement_tags array<string>, is_active boolean"
)


def data(spark, schools, stations, links, events=(), popularity=(), area=(), user=()):
    return {
        "schools": spark.createDataFrame(schools, SCHOOL),
        "stations": spark.createDataFrame(stations, STATION),
        "links": spark.createDataFrame(links, LINK),
        "events": spark.createDataFrame(list(events), EVENT),
        "popularity": spark.createDataFrame(list(popularity), "scenario_id string, school_id string, popularity_score double, total_events long"),
        "area_affinity": spark.createDataFrame(list(area), "scenario_id string, area string, affinity_score double, event_count long"),
        "user_affinity": spark.createDataFrame(list(user), "scenario_id string, user_id string, school_id string, affinity_score double, event_count long"),
    }


def request(sid, placement="search", limit=None, user=None, debug=False, **ctx):
    base = {"has_context": bool(ctx), "has_area": False, "has_line": False, "city_name": None, "prefecture_name": None, "line_id": None, "line_name": None, "ctx_station_id": None, "warnings": []}
    base.update(ctx)
    return (sid, "t", limit, user, placement, debug, *[base[n] for n in ("has_context", "has_area", "has_line", "city_name", "prefecture_name", "line_id", "line_name", "ctx_station_id", "warnings")])


def small(sid):
    stations = [
        (sid, "t", "Alpha", "Blue", "line_blue", None, 35.000, 139.000), (sid, "n", "Beta", "Blue", "line_blue", None, 35.010, 139.000),
        (sid, "f", "Gamma", "Red", "line_red", None, 36.000, 139.000),
    ]
    schools = [(sid, x, f"School {x}", "City" if x != "c" else "Town", "Pref", "high", f"g{x}") for x in "abc"]
    links = [(sid, "a", "t", 5, 400, 0, "Blue"), (sid, "b", "n", 8, 600, 1, "Blue"), (sid, "c", "f", 3, 200, 2, "Red")]
    return schools, stations, links


def test_stages_and_errors(spark):
    schools, stations, links, rows = [], [], [], []
    for sid, kw in {
        "legacy": {}, "line": {"has_line": True, "line_id": "line_red", "line_name": "Red"}, "city": {"has_area": True, "city_name": "city", "prefecture_name": "PREF"},
        "town": {"has_area": True, "city_name": "Town"}, "safe": {"has_area": False},
        "conflict": {"has_area": True, "city_name": "City", "warnings": [("station_area_conflict", "m")]},
    }.items():
        a, b, c = small(sid)
        schools += a
        stations += b
        links += c
        rows.append(request(sid, **kw))
    a, b, _ = small("empty")
    items, heads = evaluation.run_scenarios(
        spark.createDataFrame([*rows, request("empty")], SCEN), data(spark, schools + a, stations + b, links)
    )
    stage = {r.scenario_id: (r.fallback_stage, r.stop_reason) for r in heads.collect()}
    assert stage["legacy"] == ("same_line", "sufficient_scoped_candidates")
    assert stage["line"] == ("safe_global_popular", "sufficient_safe_global_candidates")
    assert stage["city"] == ("same_city", "sufficient_scoped_candidates")
    assert stage["town"] == ("same_city", "underfilled_area_context")
    assert stage["safe"][0] == stage["conflict"][0] == "safe_global_popular"
    assert "empty" not in stage
    first = items.where("scenario_id = 'legacy' and position = 1").first()
    parts = {p.feature: p.value for p in first.score_breakdown}
    assert first.content_id == "a" and parts["direct_station_bonus"] == 3.0 and parts["line_match_bonus"] == 1.25
    assert abs(first.score - (3.0 + 1.25 + 0.75 + 0.75 + 1.0 + 0.35)) < 1e-12
    passed = evaluation.explanation_checks(items, heads, "scenario_id").agg(F.bool_and("passed").alias("p")).first().p
    assert passed


def test_debug_details_and_golden_checks(spark):
    schools, stations, links = small("s")
    rows = spark.createDataFrame([request("s", user="u", debug=True, limit=5)], SCEN)
    tables = data(
        spark, schools, stations, links, popularity=[("s", "b", 1.0, 4)], area=[("s", "City", 0.5, 4)], user=[("s", "u", "b", 1.0, 2)],
        events=[("s", "e1", "a", "Open", "general", True, False, 0.0, [], True), ("s", "e2", "b", "Hidden", "general", False, False, 0.0, ["home"], True), ("s", "e3", "b", "Off", "general", False, False, 9.0, [], False)],
    )
    items, heads = evaluation.run_scenarios(rows, tables)
    found = {f"{r.content_kind}:{r.content_id}": r for r in items.collect()}
    assert set(found) == {"event:e1", "school:b"}
    assert any(p.details for p in found["school:b"].score_breakdown)
    expect = (
        "struct<fallback_stage:string,ordered:array<string>,pairwise:array<struct<higher:string,lower:string>>,absent_from_result:array<string>,"
        "absent_content_kinds:array<string>,candidate_counts:map<string,int>,max_items_per_school:int,max_items_per_group:int,required_reason_codes:map<string,array<string>>>"
    )
    order = [k for k, _ in sorted(found.items(), key=lambda kv: kv[1].position)]
    good = ("same_line", order, [(order[0], order[1])], ["event:e2"], ["article"], {"same_line": 2, "safe_global_popular": 3}, 1, 2, {"school:b": ["behavior.user_affinity"]})
    bad = ("same_city", order[::-1], [(order[1], order[0])], [order[0]], ["event"], {"same_line": 1}, 0, 2, {"school:x": ["y"]})
    for value, ok in ((good, True), (bad, False)):
        case = rows.withColumn("expectations", F.lit(None).cast(expect)).select("scenario_id").crossJoin(spark.createDataFrame([(value,)], f"expectations {expect}"))
        checks = {r.check: r.passed for r in evaluation.evaluate_scenarios(case, items, heads).collect() if not r.check.startswith("explanation")}
        wrong = {k for k, v in checks.items() if v != ok}
        assert wrong == (set() if ok else {"max_items_per_group"}), checks
        status = evaluation.scenario_cases(evaluation.evaluate_scenarios(case, items, heads)).first().status
        assert status == ("passed" if ok else "blocked")


def greedy(items, limit, caps, school_cap, group_cap):
    """The selection spelled out over all items."""
    best = {}
    for it in items:
        k = (it["kind"], it["id"])
        if k not in best or (-it["score"], it["station"]) < (-best[k]["score"], best[k]["station"]):
            best[k] = it
    order = sorted(best.values(), key=lambda i: (-i["score"], i["kind"], i["id"], i["station"]))
    picked, skipped = [], {"same_school": 0, "same_group": 0, "kind_school": 0, "kind_event": 0}
    for it in order:
        if len(picked) >= limit:
            break
        if sum(p["school"] == it["school"] for p in picked) >= school_cap:
            skipped["same_school"] += 1
        elif sum(p["group"] == it["group"] for p in picked) >= group_cap:
            skipped["same_group"] += 1
        elif sum(p["kind"] == it["kind"] for p in picked) >= caps[it["kind"]]:
            skipped["kind_" + it["kind"]] += 1
        else:
            picked.append(it)
    return [(p["kind"], p["id"]) for p in picked], skipped


def test_diversity_equals_full_scan(spark):
    """The trimmed pick and the counts of skipped items equal a full scan, with one school holding most events."""
    rng, cfg = random.Random(7), RankingConfig()
    base, events, want = [], [], {}
    for s in range(12):
        for e in range(60 if s == 0 else 4):
            events.append((f"s{s}", "search", f"e{s}_{e:02d}", 0.6 if rng.random() < 0.3 else None, 0.2 if rng.random() < 0.3 else None, rng.choice([None, 0.1, 0.2, 0.3])))
    boost = {"school": 0.35, "event": 0.1}
    classes = [(f"c{i}", "search", limit) for i, limit in enumerate((1, 3, 5, 10, 20))]
    for cid, _, limit in classes:
        items = []
        for s in range(12):
            for st in ("x", "y")[: rng.randint(1, 2)]:
                score = round(rng.uniform(0, 3), 2)
                base.append((cid, f"s{s}", f"g{s % 3}", st, "search", score))
                items.append({"kind": "school", "id": f"s{s}", "school": f"s{s}", "group": f"g{s % 3}", "station": st, "score": score + boost["school"]})
                for school, _, eid, o, f, p in events:
                    if school == f"s{s}":
                        total = (((score + boost["event"]) + (o or 0.0)) + (f or 0.0)) + (p or 0.0)
                        items.append({"kind": "event", "id": eid, "school": school, "group": f"g{s % 3}", "station": st, "score": total})
        caps = {"school": min(max(-(-limit * 8 // 10), 1), limit), "event": min(max(-(-limit // 2), 1), limit)}
        want[cid] = greedy(items, limit, caps, 1, 2)
    b = spark.createDataFrame(base, "class_id string, school_id string, group_id string, station_id string, placement string, base_score double")
    v = spark.createDataFrame(events, "school_id string, placement string, event_id string, open_day_bonus double, featured_event_bonus double, event_priority_boost double")
    c = spark.createDataFrame(classes, "class_id string, placement string, limit int")
    picks = ranking.pick_items(b, c, v, cfg).cache()
    got = {r.class_id: [(p.content_kind, p.content_id) for p in r.picked] for r in picks.collect()}
    skips = {r.class_id: r.asDict() for r in ranking.diversity_summary(b, v, picks, cfg).collect()}
    for cid, (order, skipped) in want.items():
        assert got[cid] == order
        for name, n in skipped.items():
            assert skips.get(cid, {}).get(f"skipped_{name}", 0) == n, (cid, name)


def test_stage_choice_prefers_largest_then_earlier(spark):
    cfg = RankingConfig(min_results=3, strict_min_candidates=1)
    rows = [([1, 2, 0, 0, 2, 2], "same_line"), ([0, 0, 0, 0, 0, 0], "safe_global_popular"), ([0, 0, 1, 2, 0, 3], "safe_global_popular")]
    df = spark.createDataFrame([(i, c, False, None, None, True, True) for i, (c, _) in enumerate(rows)], "i int, counts array<int>, conflict boolean, city_name string, prefecture_name string, station_explicit boolean, line_explicit boolean")
    got = {r.i: r for r in ranking.plan_trace(ranking.select_stage(df, cfg), cfg).collect()}
    assert [got[i].fallback_stage for i in range(3)] == [s for _, s in rows]
    assert got[0].stop_reason == "best_available_non_empty_stage" and got[1].stop_reason == "no_candidates_available"
    assert [s.stage for s in got[0].stages] == list(STAGES) and got[0].stages[5].status == "insufficient"
    assert got[0].stages[0].reason_code == "candidate_count_below_minimum"


def test_catalog_merge_rules(spark):
    schema = "feature string, reason_code string, label string"
    rows = [("open_day_bonus", "event.open_day", "Open"), ("new", "n.1", "New"), ("walking_minutes", "moved", "W"), ("dup", "d.1", "D"), ("dup", "d.2", "D"), ("thief", "geo.line_match", "T"), ("x", " ", "X")]
    ok, bad = explain.merge_catalog(explain.core_catalog(spark), spark.createDataFrame(rows, schema))
    labels = {r.feature: r.label for r in ok.collect()}
    assert labels["open_day_bonus"] == "Open" and labels["new"] == "New" and len(labels) == 15
    why = {(r.feature, r.reason) for r in bad.collect()}
    assert why == {("walking_minutes", "stable reason_code changed"), ("dup", "duplicate feature"), ("thief", "duplicate reason_code"), ("x", "empty reason_code")}


def test_contenders_are_few_and_hold_every_pick(spark):
    """Rows are cut before events multiply them, with ties, schools without a group and one in two groups; the picks are those of all rows."""
    rng, cfg = random.Random(11), RankingConfig()
    events = [(f"s{s}", "search", f"e{s}_{e}", rng.choice([None, 0.6]), None, rng.choice([None, 0.1, 0.2])) for s in range(0, 120, 2) for e in range(3)]
    groups = {s: None if s % 13 == 0 else f"g{s % 7}" for s in range(120)}
    classes, base, want = [(f"c{i}", "search", limit) for i, limit in enumerate((1, 3, 5, 20))], [], {}
    boost = {"school": 0.35, "event": 0.1}
    for cid, _, limit in classes:
        items = []
        for s in range(120):
            for st in ("x", "y"):
                score = rng.choice([0.5, 1.0, 1.1, 1.1 + 1e-16, 1.3, 2.0])
                base.append((cid, f"s{s}", groups[s], st, "search", score))
                one = {"school": f"s{s}", "group": groups[s] or f"own{s}", "station": st}
                items.append({"kind": "school", "id": f"s{s}", "score": score + boost["school"], **one})
                items += [{"kind": "event", "id": e, "score": (((score + boost["event"]) + (o or 0.0)) + (f or 0.0)) + (p or 0.0), **one} for school, _, e, o, f, p in events if school == f"s{s}"]
        caps = {"school": min(max(-(-limit * 8 // 10), 1), limit), "event": min(max(-(-limit // 2), 1), limit)}
        want[cid] = greedy(items, limit, caps, 1, 2)[0]
    b = spark.createDataFrame(base, "class_id string, school_id string, group_id string, station_id string, placement string, base_score double")
    v = spark.createDataFrame(events, "school_id string, placement string, event_id string, open_day_bonus double, featured_event_bonus double, event_priority_boost double")
    c = spark.createDataFrame(classes, "class_id string, placement string, limit int")
    picks = ranking.pick_items(b, c, v, cfg)
    assert {r.class_id: [(p.content_kind, p.content_id) for p in r.picked] for r in picks.collect()} == want
    spread_out = b.withColumn("base_score", F.xxhash64("school_id", "class_id") / F.lit(2.0**63))
    two = spread_out.where("school_id = 's2'").withColumn("group_id", F.lit("other"))
    few = ranking.contenders(spread_out.unionByName(two), ranking.leading_events(v, cfg), c, cfg)
    kept = {r.class_id: r["count"] for r in few.groupBy("class_id").count().collect()}
    assert kept["c0"] <= 8 and kept["c1"] <= 2 * 2 * 7 + 4 and all(n < 240 for n in kept.values())
    assert few.where("school_id = 's2'").select("class_id", "group_id").distinct().count() == 8


def test_item_totals_add_up_all_items(spark):
    rng = random.Random(4)
    links = [(f"c{i % 7}", f"s{i % 5}", "g", f"t{i}", rng.choice(["home", "search", "detail", "mypage"]), rng.uniform(-2, 9)) for i in range(60)]
    links += [links[0], ("c1", None, None, "t0", "search", 1.0), ("c9", "none", "g", "t0", "search", 1.0), (None, "s1", "g", "t0", "search", 1.0)]
    base = spark.createDataFrame(links, "class_id string, school_id string, group_id string, station_id string, placement string, base_score double")
    events = [(f"e{i}", rng.choice(["s0", "s1", "s1", "s2", None]), i % 3 == 0, i % 4 == 0 or None, rng.choice([None, -1.0, 0.0, rng.random()]), rng.choice([[], None, ["search"], ["home", "detail"]]), i % 5 > 0) for i in range(80)]
    events += events[:9]
    schema = "id string, school_id string, is_open_day boolean, is_featured boolean, priority_weight double, placement_tags array<string>, is_active boolean"
    visible = ranking.visible_events(spark.createDataFrame(events, schema))
    every = ranking.expand_items(base, visible).groupBy("class_id", "content_kind")
    want = {(r[0], r[1]): r for r in every.agg(F.count(F.lit(1)).alias("items"), F.max("score").alias("best"), F.sum("score").alias("total")).collect()}
    totals = ranking.item_totals(base, visible)
    got = {(r.class_id, r.content_kind): r for r in totals.collect()}
    assert got.keys() == want.keys() and len(got) > 8
    for key, r in want.items():
        assert got[key].items == r["items"] and abs(got[key].best - r.best) < 1e-9 and abs(got[key].total - r.total) < 1e-6


def test_item_totals_do_not_multiply_events(spark):
    """100 links of a school with 3 000 events: 300 000 items, of which no plan has rows."""
    base = spark.range(100).select(
        F.concat(F.lit("c"), "id").alias("class_id"), F.lit("s").alias("school_id"), F.lit("g").alias("group_id"), F.lit("t").alias("station_id"), F.lit("search").alias("placement"), F.lit(1.0).alias("base_score")
    )
    visible = spark.range(3000).select(
        F.lit("s").alias("school_id"), F.lit("search").alias("placement"), F.col("id").cast("string").alias("event_id"),
        *[F.lit(None).cast("double").alias(n) for n in ("open_day_bonus", "featured_event_bonus", "event_priority_boost")],
    )
    totals = ranking.item_totals(base, visible)
    assert totals.where("content_kind = 'event'").agg(F.sum("items")).first()[0] == 300_000


def test_link_scores_add_up_to_base_scores(spark):
    """What ranking multiplies has keys and one score; the sums are, to the bit, those of all parts one by one."""
    rng, stages = random.Random(9), ["same_line", "neighbor_area", "safe_global_popular"]
    part = "sig string, school_id string, group_id string, station_id string, fallback_stage string, counts_as_same_line boolean, direct_station_bonus double, school_station_distance double, walking_minutes_score double, neighbor_station_proximity double, popularity_snapshot_bonus double, area_affinity_bonus double"
    some = lambda: rng.choice([None, rng.random(), rng.random() / 3])
    rows = [(f"g{i % 6}", f"s{i % 11}", "g", f"t{i}", stages[i % 3], None if i % 5 == 0 else i % 2 == 0 and i % 3 != 1, *[some() for _ in range(6)]) for i in range(90)]
    selected = spark.createDataFrame(rows, part)
    classes = spark.createDataFrame([(f"c{i}", f"g{i % 6}", ["home", "search"][i % 2], 3, False, rng.choice([None, "u1", "u2"])) for i in range(20)], "class_id string, sig string, placement string, limit int, debug boolean, user_id string")
    affinity = spark.createDataFrame([(f"u{u}", f"s{s}", rng.random(), 3) for u in range(4) for s in range(0, 11, 2)], "user_id string, school_id string, affinity_score double, event_count long")
    one = selected.withColumn("line_match_bonus", F.when(F.col("counts_as_same_line"), F.lit(RankingConfig().line_match_bonus)))
    narrow = one.select("sig", "school_id", "group_id", "station_id", "fallback_stage", ranking._sum(ranking.BASE_PARTS[: ranking.LINK_PARTS]).alias("link_score"))
    key = ["class_id", "school_id", "station_id", "base_score"]
    want = ranking.request_components(selected.join(classes, "sig"), affinity).select(*key)
    assert sorted(map(tuple, ranking.base_scores(narrow, classes, affinity).select(*key).collect())) == sorted(map(tuple, want.collect()))


def test_scored_links_are_narrow(spark, monkeypatch):
    """Of the links of a stage nothing is kept but their keys and score."""
    seen, own = [], ranking.base_scores

    def kept(selected, *rest):
        seen.extend(selected.columns)
        return own(selected, *rest)

    monkeypatch.setattr(ranking, "base_scores", kept)
    schools, stations, links = small("s")
    evaluation.run_scenarios(spark.createDataFrame([request("s")], SCEN), data(spark, schools, stations, links))
    assert {n for n in seen if not n.startswith("in_")} == {"sig", "school_id", "group_id", "station_id", "link_score", "fallback_stage"}


def test_traces_of_classes_are_those_of_requests(spark):
    """An answer is listed once per class and meets its requests last; the traces stay the same."""
    schools, stations, links = small("s")
    items, heads = evaluation.run_scenarios(spark.createDataFrame([request("s", limit=5)], SCEN), data(spark, schools, stations, links))
    other = [df.unionByName(df.withColumns({"scenario_id": F.lit("s2"), "explanation": F.lit("other")})) for df in (items, heads)]
    items, heads = (df.cache() for df in other)
    rows = [("r1", "s"), ("r2", "s"), ("r3", "none"), ("r4", "s2"), ("twice", "s"), ("twice", "s"), ("both", "s"), ("both", "s2"), (None, "s")]
    of = spark.createDataFrame(rows, "request_id string, scenario_id string").cache()
    none = F.lit(None).cast("string")
    asked = of.select("request_id", *[none.alias(n) for n in ("target_station_id", "user_id", "placement", "station_id", "line_id", "line_name", "country", "prefecture_code", "prefecture_name", "city_code", "city_name")], F.lit(3).alias("limit"), F.lit(False).alias("debug"))
    ctx = of.select("request_id", F.lit("default_safe_context").alias("context_source"), F.lit(0.5).alias("confidence"), F.array().cast(FIELDS["warnings"]).alias("warnings"), none.alias("ctx_station_id"))
    ctx = ctx.withColumns({n: F.lit(None).cast(t) for n, t in FIELDS.items() if n not in ctx.columns})
    retrieved = of.select("request_id", F.lit(3).alias("candidate_count"), F.lit("sql").alias("backend"))
    each = evaluation.build_traces(asked, ctx, of.join(items, "scenario_id").drop("scenario_id"), of.join(heads, "scenario_id").drop("scenario_id"), retrieved)
    classes = of.withColumnRenamed("scenario_id", "class_id")
    shared = evaluation.build_traces(asked, ctx, items.withColumnRenamed("scenario_id", "class_id"), heads.withColumnRenamed("scenario_id", "class_id"), retrieved, classes)
    got, want = (sorted(tuple(r) for r in df.select(*each.columns).collect()) for df in (shared, each))
    assert got == want and {r[0] for r in got} == {"r1", "r2", "r4", "twice", "both"}
