"""A sample of the registered queries against their SQL on the smallest tables."""

import os

import pytest
from compare import check, connect

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
SAMPLE = ["popularity_snapshot", "resolve_context", "context_candidates", "stage_selection", "recommend_items", "diversity_summary", "validate_events", "dedupe_events", "red_flags", "guardrail_summary"]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")
@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    ok, note = check(spark, connect(SMALL), name, SMALL)
    assert ok, note


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
