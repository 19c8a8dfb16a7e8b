"""Rank queries on bonus steps, and the skip counts made of them, against all events spelled out."""

import random

import pytest
from test_ranking import greedy

from wayside.config import RankingConfig
from wayside.operators import ranking, ranks

BASE = "class_id string, school_id string, group_id string, station_id string, placement string, base_score double"
VISIBLE = "school_id string, placement string, event_id string, open_day_bonus double, featured_event_bonus double, event_priority_boost double"


def made(seed, weights):
    """Links and events with many exact ties across schools; most events belong to one school."""
    rng = random.Random(seed)
    events = []
    for s in range(9):
        for e in range(90 if s == 0 else rng.randint(0, 9)):
            events.append((f"s{s}", "search", f"e{rng.randint(0, 10**6):07d}_{s}_{e}", rng.choice([None, 0.6]), rng.choice([None, 0.2]), rng.choice(weights)))
    classes = [(f"c{i}", "search", limit) for i, limit in enumerate((1, 2, 3, 5, 10, 20, 20))]
    base = [(cid, f"s{s}", f"g{s % 3}" if s else None, st, "search", rng.choice([0.5, 0.7, 0.9, 1.1])) for cid, *_ in classes for s in range(9) for st in ("x", "y")[: rng.randint(1, 2)]]
    return base, events, classes


@pytest.mark.parametrize(("seed", "weights", "page", "first", "school_cap"), [(1, [None, 0.2, 0.4], 256, 4, 1), (2, [None, 0.1, 0.2, 0.3, 0.6, 0.8], 3, 1, 1), (3, [round(i * 0.05, 2) for i in range(1, 60)], 2, 2, 2)])
def test_skips_equal_full_scan(spark, monkeypatch, seed, weights, page, first, school_cap):
    monkeypatch.setattr(ranks, "PAGE", page)
    monkeypatch.setattr(ranks, "FIRST_IDS", first)
    cfg = RankingConfig()
    if school_cap != 1:
        cfg = RankingConfig(placements=tuple(p.__class__(**{**p.__dict__, "same_school_cap": school_cap}) for p in cfg.placements))
    base, events, classes = made(seed, weights)
    want = {}
    for cid, _, limit in classes:
        items = []
        for k, school, group, station, _, score in base:
            if k == cid:
                items.append({"kind": "school", "id": school, "school": school, "group": group or object(), "station": station, "score": score + 0.35})
                items += [
                    {"kind": "event", "id": e, "school": school, "group": group or object(), "station": station, "score": (((score + 0.1) + (o or 0.0)) + (f or 0.0)) + (p or 0.0)}
                    for s, _, e, o, f, p in events if s == school
                ]
        caps = {"school": min(max(-(-limit * 8 // 10), 1), limit), "event": min(max(-(-limit // 2), 1), limit)}
        want[cid] = greedy(items, limit, caps, school_cap, 2)
    b, v = spark.createDataFrame(base, BASE), spark.createDataFrame(events, VISIBLE)
    picks = ranking.pick_items(b, spark.createDataFrame(classes, "class_id string, placement string, limit int"), v, cfg).cache()
    assert {r.class_id: [(p.content_kind, p.content_id) for p in r.picked] for r in picks.collect()} == {k: order for k, (order, _) in want.items()}
    got = {r.class_id: r.asDict() for r in ranking.diversity_summary(b, v, picks, cfg).collect()}
    for cid, (_, skipped) in want.items():
        assert {n: got.get(cid, {}).get(f"skipped_{n}", 0) for n in skipped} == skipped, cid


def test_ids_of_long_steps_are_counted(spark, monkeypatch):
    """A school's item with the score of another school's long step is placed among that step's ids."""
    monkeypatch.setattr(ranks, "FIRST_IDS", 2)
    events = [("a", "search", f"e{i:03d}", None, None, 0.25) for i in range(0, 200, 2)] + [("a", "search", "f", 0.6, None, None)]
    points = [(f"p{i}", "a", "search", 1.0, 1.25, kind, cid) for i, (kind, cid) in enumerate([("event", "e000"), ("event", "e003"), ("event", "e101"), ("event", "e999"), ("event", "e100"), ("school", "a")])]
    points += [("all", "a", "search", 1.0, None, None, None), ("none", "b", "search", 1.0, None, None, None), ("low", "a", "search", 1.0, 0.5, "event", "x"), ("high", "a", "search", 1.0, 9.0, "event", "x")]
    df = spark.createDataFrame(points, "point string, school_id string, placement string, base double, score double, content_kind string, content_id string")
    got = {r.point: r.n for r in ranks.events_before(df, ranks.bonus_steps(spark.createDataFrame(events, VISIBLE)), ["point"]).collect()}
    assert got == {"p0": 1, "p1": 3, "p2": 52, "p3": 101, "p4": 51, "p5": 101, "all": 101, "low": 101, "high": 0}


def test_no_rows(spark):
    steps = ranks.bonus_steps(spark.createDataFrame([], VISIBLE))
    df = spark.createDataFrame([], "point string, school_id string, placement string, base double, score double, content_kind string, content_id string")
    assert ranks.events_before(df, steps, ["point"]).count() == 0


def test_sums_are_those_of_the_points(spark, monkeypatch):
    """Weighed numbers of events, added up where they are counted, with pages, ties beyond the listed ids and points that look alike."""
    monkeypatch.setattr(ranks, "PAGE", 2)
    monkeypatch.setattr(ranks, "FIRST_IDS", 1)
    rng = random.Random(5)
    base, events, _ = made(5, [None, 0.1, 0.2, 0.3])
    rows = [(i, f"k{i % 4}", s, "search", x, rng.choice([None, 0.8, 1.0, 1.1]), rng.choice(["event", "school"]), rng.choice(events)[2], (rng.randint(-1, 1), rng.randint(0, 2))) for i, (_, s, _, _, _, x) in enumerate(base)]
    rows += [(1000 + r[0], *r[1:]) for r in rows[:30]] + [(2000, "k9", "none", "search", 1.0, None, None, None, (1, 5))]
    df = spark.createDataFrame(rows, "point long, by string, school_id string, placement string, base double, score double, content_kind string, content_id string, v struct<w:int,less:int>")
    steps = ranks.bonus_steps(spark.createDataFrame(events, VISIBLE))
    n = {r.point: r.n for r in ranks.events_before(df, steps, ["point"]).collect()}
    want = {}
    for r in rows:
        if r[0] in n:
            want[r[1]] = want.get(r[1], 0) + r[8][0] * n[r[0]] - r[8][1]
    assert {r.by: r.v for r in ranks.sums_before(df, steps, ["by"], ["v"]).collect()} == want and any(want.values())


def test_skips_are_summed_up_without_a_shuffle_of_points(spark):
    """Links are dealt out by class once; no row of a class and school goes over a shuffle behind that."""
    base, events, classes = made(1, [None, 0.2])
    b, v = spark.createDataFrame(base, BASE), spark.createDataFrame(events, VISIBLE)
    picks = ranking.pick_items(b, spark.createDataFrame(classes, "class_id string, placement string, limit int"), v).cache()
    plan = ranking.diversity_summary(b, v, picks)._jdf.queryExecution().executedPlan().toString()
    assert "school_id" not in "".join(line for line in plan.splitlines() if "Exchange hashpartitioning" in line) and "Exchange hashpartitioning(class_id" in plan
