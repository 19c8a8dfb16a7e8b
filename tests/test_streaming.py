"""Streams on small files, against the batch operators."""

import json
from datetime import datetime

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from wayside.operators import pages, snapshots
from wayside.sources import sinks
from wayside.streaming import recent_search_stream, start_log_ingest, start_page_ingest, start_snapshot_refresh
from wayside.streaming.counts import CountStore

LOG = "id long, user_id string, school_id string, event_type string, event_id string, target_station_id string, occurred_at timestamp_ntz, payload string"


def dims(spark):
    return {
        "schools": lambda: spark.createDataFrame([("a", "A"), ("b", "B")], "id string, area string"),
        "events": lambda: spark.createDataFrame([("e1", "b")], "id string, school_id string"),
        "stations": lambda: spark.createDataFrame([("s1",)], "id string"),
        "links": lambda: spark.createDataFrame([("a", "s1"), ("b", "s1")], "school_id string, station_id string"),
    }


def write_lines(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_log_ingest_splits_rows(spark, tmp_path):
    at = "2024-01-01T00:00:00Z"
    write_lines(
        tmp_path / "in",
        "1.json",
        [
            {"id": 1, "user_id": "u", "school_id": "a", "event_kind": "school_view", "occurred_at": at},
            {"id": 2, "user_id": "u", "event_kind": "event_view", "event_id": "e1", "occurred_at": at},
            {"id": 3, "user_id": "u", "school_id": "a", "event_kind": "event_view", "event_id": "e1", "occurred_at": at},
            {"id": 4, "user_id": "u", "event_kind": "search_execute", "target_station_id": "gone", "occurred_at": at},
            {"id": 5, "user_id": " ", "event_kind": "share", "school_id": "a"},
        ],
    )
    paths = [str(tmp_path / n) for n in ("in", "ok", "bad", "cp")]
    start_log_ingest(spark, paths[0], dims(spark), *paths[1:]).awaitTermination()
    ok = {r.id: r.school_id for r in spark.read.parquet(paths[1]).collect()}
    bad = {r.id: r.reason for r in spark.read.parquet(paths[2]).collect()}
    assert ok == {1: "a", 2: "b"}
    assert bad[3] == "event belongs to another school" and bad[4] == "unknown target_station_id" and bad[5] == "user_id must not be empty"


class Died(Exception):
    """A writer that ends on the way."""


def refreshed(spark, tmp_path, publish, fold=2):
    d = dims(spark)
    affinity = str(tmp_path / "user_affinity_snapshots")
    stored = lambda: sinks.current(spark, affinity) if sinks.marked(spark, affinity) else None
    return start_snapshot_refresh(spark, str(tmp_path / "log"), LOG, str(tmp_path / "counts"), d, publish, stored, str(tmp_path / "cp"), max_batches=1, fold=fold)


def equals_batch(spark, tmp_path, rows):
    """The published snapshots are those of the whole log."""
    d, whole = dims(spark), snapshots.log_counts(spark.createDataFrame(rows, LOG))
    want = {
        "user_affinity_snapshots": snapshots.user_affinity(whole),
        "popularity_snapshots": snapshots.popularity(d["schools"](), d["links"](), whole),
        "area_affinity_snapshots": snapshots.area_affinity(d["schools"](), d["links"](), whole),
    }
    for name, df in want.items():
        assert sorted(map(tuple, sinks.current(spark, str(tmp_path / name)).select(*df.columns).collect())) == sorted(map(tuple, df.collect())), name


def test_snapshot_refresh_matches_batch_after_late_rows_and_retries(spark, tmp_path):
    kinds = ["school_view", "search_execute", "share", "event_view", "other"]
    rows = [(i, f"u{i % 3}" if i % 7 else None, ("a", "b", None)[i % 3], kinds[i % 5], None, "s1" if i % 2 else None, None, "{}") for i in range(40)]
    rows += [(99, "u0", "a", "apply_click", None, None, datetime(2020, 1, 1), "{}")]  # late by years
    log = str(tmp_path / "log")
    for n, at in enumerate(range(0, 41, 9)):
        assert sinks.append_once(spark.createDataFrame(rows[at : at + 9], LOG), log, n)
    assert not sinks.append_once(spark.createDataFrame(rows[:9], LOG), log, 0)  # a retried append adds nothing
    spark.createDataFrame(rows[:5], LOG).write.parquet(f"{log}/batch=77")  # files of a writer that died before its mark
    fails = {("popularity_snapshots", 1), ("user_affinity_snapshots", 3)}

    def publish(name, df, number):
        if (name, number) in fails:
            fails.remove((name, number))
            raise Died
        sinks.publish(df, str(tmp_path / name), number)

    for _ in range(2):
        with pytest.raises(StreamingQueryException):
            refreshed(spark, tmp_path, publish).awaitTermination()
    refreshed(spark, tmp_path, publish).awaitTermination()
    assert not fails
    equals_batch(spark, tmp_path, rows)
    assert sinks.marked(spark, f"{tmp_path}/counts/base") and len(sinks.marked(spark, f"{tmp_path}/counts/batches")) == 5
    # the writer comes back: its batch replaces the half done files and is counted once
    more = [(200 + i, "u1", "b", "school_save", None, None, None, "{}") for i in range(3)]
    assert sinks.append_once(spark.createDataFrame(more, LOG), log, 77)
    refreshed(spark, tmp_path, publish).awaitTermination()
    equals_batch(spark, tmp_path, rows + more)


def test_counts_are_stored_once(spark, tmp_path):
    store = CountStore(spark, str(tmp_path / "store"), fold=2)
    assert store.read().count() == 0
    part = lambda n: spark.createDataFrame([("u", "a", None, "share", n), (None, None, "s1", "search_execute", 1)], snapshots.COUNTS)
    assert store.add(part(3), 0) and not store.add(part(3), 0) and not store.compact(0)
    assert store.add(part(4), 1) and store.compact(1) and not store.compact(1)
    assert not store.add(part(4), 1) and store.add(part(5), 2)
    assert {r.event_type: r.n for r in store.read().collect()} == {"share": 12, "search_execute": 3}


def test_one_scan_of_the_log_for_all_snapshots(spark, tmp_path):
    spark.createDataFrame([(1, "u", "a", "share", None, None, None, "{}")], LOG).write.parquet(str(tmp_path / "log"))
    d = dims(spark)
    made = snapshots.refresh_snapshots(d["schools"](), d["links"](), spark.read.parquet(str(tmp_path / "log")))
    for df in made.values():  # what is left reads the counts only
        assert "/log" not in "".join(df.inputFiles()) and df.count()
    assert snapshots.log_counts(spark.read.parquet(str(tmp_path / "log")))._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_recent_search_keeps_newest_and_expires(spark, tmp_path):
    stamps = [(1, "u", "s1", "2024-01-01 10:00:00"), (2, "u", "s2", "2024-01-01 09:00:00"), (3, "v", "s3", "2024-01-06 00:00:00"), (4, "w", "s4", "2024-01-06 01:00:00"), (5, "v", "nowhere", "2024-01-06 02:00:00")]
    for i, batch in enumerate((stamps[:1], stamps[1:2], stamps[2:3], stamps[3:4], stamps[4:])):
        df = spark.createDataFrame([(r[0], r[1], None, "search_execute", None, r[2], None, "{}") for r in batch], LOG)
        df = df.withColumn("occurred_at", F.lit(batch[0][3]).cast("timestamp_ntz"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        del i
    log = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    stations = spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s4",)], "id string")
    q = recent_search_stream(log, stations).writeStream.outputMode("update").format("memory").queryName("recent").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    seen = {(r.user_id, r.station_id, r.event) for r in spark.sql("select * from recent").collect()}
    assert ("u", "s1", "newest") in seen and ("u", "s2", "newest") not in seen
    assert ("u", "s1", "expired") in seen and ("v", "s3", "newest") in seen
    assert not [s for s in seen if s[1] == "nowhere"]


def test_page_ingest_upserts(spark, tmp_path):
    cols = "source_id string, logical_name string, target_url string, html string, parser_key string"
    rows = [("w", "a", "u1", "<h1>One</h1>", "title"), ("w", "b", "u2", "<p>none</p>", "title"), ("w", "a", "u1", "<h1>ONE</h1>", "title")]
    for row in rows:
        spark.createDataFrame([row], cols).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    t = spark.createDataFrame(
        [("w", "a", "s1", "general", False, False, 0.0, ["home"]), ("w", "b", "s1", "general", False, False, 0.0, ["home"])],
        "source_id string, logical_name string, school_id string, event_category string, is_open_day boolean, is_featured boolean, priority_weight double, placement_tags array<string>",
    )
    state = {}

    def keep(name):
        def write(df, batch_id):
            path = str(tmp_path / f"{name}-{batch_id}")
            df.write.parquet(path)
            state.setdefault(name, []).append(path)

        return write

    def read():
        return spark.read.parquet(state["events"][-1]) if "events" in state else None

    start_page_ingest(
        spark, str(tmp_path / "in"), lambda: t, {"title": pages.extract_heading}, read, keep("events"), keep("reports"), str(tmp_path / "cp"), max_files=1
    ).awaitTermination()
    assert read().count() == 1
    codes = sorted(r.code for r in spark.read.parquet(*state["reports"]).collect())
    assert codes == ["events_extracted", "events_extracted", "parse_failed"]
