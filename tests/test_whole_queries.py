"""Queries that return all of their operator's rows, where their SQL covers a part: against plain Python on the smallest tables."""

import json
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from wayside.plans import catalog  # noqa: F401
from wayside.plans.registry import QUERIES, model_for

SMALL = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


def test_requests_without_candidates(spark):
    stage = "struct<stage:string,candidate_count:int,status:string,reason_code:string>"
    plans = spark.createDataFrame(
        [("s", [0] * 6, "safe_global_popular", "none", [("strict_station", 0, "insufficient", "x")])],
        f"sig string, counts array<int>, fallback_stage string, selection string, stages array<{stage}>",
    )
    m = SimpleNamespace(batch=SimpleNamespace(rows=spark.createDataFrame([("r1", "s")], "request_id string, sig string"), planned=(plans, None)))
    assert [tuple(r) for r in QUERIES["stage_selection"](m).collect()] == [("r1", 0, 0, 0, 0, 0, 0, "safe_global_popular", "none")]
    assert [tuple(r) for r in QUERIES["plan_trace"](m).collect()] == [("r1", 0, "strict_station", 0, "insufficient", "x")]


@here
def test_context_shape_issues(spark):
    from wayside.operators import context

    m = model_for(spark, SMALL)
    as_area = m.batch.context.replace("request_station", "request_area", "context_source")
    want = sorted(map(tuple, context.context_shape_issues(as_area).collect()))
    assert any(shape.startswith("area") for *_, shape in want)
    assert sorted(map(tuple, QUERIES["context_shape_issues"](m).collect())) == want


@here
def test_candidate_slice(spark):
    m = model_for(spark, SMALL)
    got = {}
    for r in QUERIES["candidate_slice"](m).collect():
        got.setdefault(r["part"], []).append(json.loads(r["row"]))
    links = {(r["school_id"], r["station_id"]) for r in m.batch.candidates.collect()}
    schools = {s for s, _ in links}
    areas = {r["area"] for r in m.schools.collect() if r["id"] in schools}
    assert sorted((r["school_id"], r["station_id"]) for r in got["links"]) == sorted(links)
    assert sorted(r["id"] for r in got["schools"]) == sorted(schools)
    assert sorted(r["id"] for r in got["stations"]) == sorted({s for _, s in links})
    assert sorted(r["id"] for r in got["events"]) == sorted(r["id"] for r in m.events.collect() if r["is_active"] and r["school_id"] in schools)
    for name, key, kept in (("popularity", "school_id", schools), ("user_affinity", "school_id", schools), ("area_affinity", "area", areas)):
        want = sorted(r[key] for r in getattr(m, name).collect() if r[key] in kept)
        assert sorted(r[key] for r in got.get(name, [])) == want, name


@here
def test_score_components(spark):
    m = model_for(spark, SMALL)
    want = [(r["request_id"], r["content_kind"], r["content_id"], p["feature"], round(p["value"], 6)) for r in m.batch.items().collect() for p in r["score_breakdown"]]
    got = sorted(map(tuple, QUERIES["score_components"](m).collect()))
    assert [x[:4] for x in got] == [x[:4] for x in sorted(want)] and all(abs(a[4] - b[4]) < 2e-6 for a, b in zip(got, sorted(want), strict=True))
    assert any(x[4] < 0 for x in got)


@here
def test_traces_of_all_requests(spark):
    m = model_for(spark, SMALL)
    answered = {r["request_id"] for r in m.requests.collect()} - {r["request_id"] for r in m.batch.errors().collect()}
    recent = {r["request_id"] for r in m.batch.context.where("context_source = 'recent_search_context'").collect()}
    assert recent & answered
    for name, each in (("trace_evidence", 1), ("trace_stages", 6), ("stored_order", 1), ("explain_traces", 1)):
        got = [r["request_id"] for r in QUERIES[name](m).collect()]
        assert set(got) == answered and len(got) == each * len(answered), name


@here
def test_scenarios_with_all_checks(spark):
    m = model_for(spark, SMALL)
    failed, kinds = {}, set()
    for r in QUERIES["evaluate_scenarios"](m).collect():
        kinds.add(r["check"].split(".")[0])
        failed[r["scenario_id"]] = failed.get(r["scenario_id"], 0) + (not r["passed"])
    assert {"ordered_prefix", "absent_content_kind", "required_reason_codes"} <= kinds
    runs = QUERIES["evaluation_run"](m).collect()
    assert sum(r["scenarios"] for r in runs) == len(failed)
    assert sum(r["passed"] for r in runs) == sum(n == 0 for n in failed.values())
    assert sum(r["blocked"] for r in runs) == sum(n > 0 for n in failed.values()) and sum(r["blockers"] for r in runs) == sum(failed.values())


def test_customers_meet_nations_unbroadcast(spark, tmp_path):
    """The larger table streams past the nations, in many tasks, though its file may be smaller than the estimate for them."""
    from wayside.plans.testmap import Model

    nation = spark.range(2).select(F.col("id").alias("n_nationkey"), F.lit("N").alias("n_name"), F.lit(0).cast("long").alias("n_regionkey"))
    region = spark.range(1).select(F.col("id").alias("r_regionkey"), F.lit("R").alias("r_name"))
    customer = spark.range(100).select(F.col("id").alias("c_custkey"), (F.col("id") % 2).alias("c_nationkey"), F.lit("M").alias("c_mktsegment"))
    for name, rows in (("nation", nation), ("region", region), ("customer", customer)):
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    m = Model(spark, str(tmp_path))
    assert m.customers.count() == 100 and m.stations.count() == 100 and m.requests.count() == 100
    assert m.customers.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
