"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wayside.plans import catalog  # noqa: E402,F401
from wayside.plans.registry import QUERIES  # noqa: E402
from wayside.plans.testmap import Model  # noqa: E402
from wayside.session import build_session  # noqa: E402

# each step of the recommendation batch is timed on its own; what it needs is built before
HEADLINE = [
    "derive_links", "popularity_snapshot", "area_affinity_snapshot", "user_affinity_snapshot", "resolve_context", "station_for_context",
    "context_candidates", "stage_selection", "base_scores", "recommend_items", "result_explanations", "projection_candidates", "validate_track",
    "content_changes", "extract_heading", "dedupe_events", "extract_cards", "red_flags", "heavy_deactivation", "guardrail_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    model = Model(spark, sf_dir)
    times = {}
    for name in HEADLINE:
        started = time.time()
        QUERIES[name](model).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline queries, wall clock", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
