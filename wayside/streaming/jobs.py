"""Streams: log ingest, snapshot refresh, recent searches, page ingest.

Every stream takes a checkpoint location, which on a cluster must be in shared
storage.  Micro-batches are written under their number and then marked: a batch
that is retried after a failure replaces what has no mark and adds nothing to
what has one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wayside import schemas
from wayside.config import EVENT_WEIGHTS
from wayside.operators import normalize, pages, snapshots
from wayside.operators.context import SEARCH_WINDOW_HOURS
from wayside.session import settle
from wayside.sources.sinks import append_once, commits, committed, upsert
from wayside.streaming import counts

ARRIVALS = "id long, " + schemas.LOG


def _file_stream(spark: SparkSession, path: str, schema: str, max_files: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def accept_log(batch: DataFrame, schools: DataFrame, events: DataFrame, stations: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Validate arriving log rows, fill schools, check references."""
    ok, bad1 = normalize.validate_track(batch, as_of)
    ok, bad2 = normalize.resolve_event_school(ok, events)
    ok, bad3 = normalize.check_refs(ok, schools, events, stations)
    cols = ["id", "user_id", "event_kind", "reason"]
    rejected = bad1.select(*cols).unionByName(bad2.select(*cols)).unionByName(bad3.select(*cols))
    return ok.withColumnRenamed("event_kind", "event_type"), rejected


def start_log_ingest(
    spark: SparkSession, source: str, dims: dict[str, Callable[[], DataFrame]], sink: str, rejects: str, checkpoint: str, max_files: int | None = None
) -> StreamingQuery:
    """Append sound log rows to ``sink`` and the others to ``rejects``.

    ``dims`` holds readers for schools, events and stations; they are read
    anew for each micro-batch, so new reference rows are seen.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        now = F.current_timestamp()
        batch = batch.persist()
        ok, bad = accept_log(batch, dims["schools"](), dims["events"](), dims["stations"](), F.convert_timezone(F.current_timezone(), F.lit("UTC"), now.cast("timestamp_ntz")))
        append_once(ok, sink, batch_id)
        append_once(bad, rejects, batch_id)
        batch.unpersist()

    stream = _file_stream(spark, source, ARRIVALS, max_files)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_snapshot_refresh(
    spark: SparkSession,
    log_path: str,
    log_schema: str,
    counts_path: str,
    dims: dict[str, Callable[[], DataFrame]],
    publish: Callable[[str, DataFrame, int], None],
    read_affinity: Callable[[], DataFrame | None],
    checkpoint: str,
    max_batches: int | None = None,
    fold: int = counts.FOLD,
) -> StreamingQuery:
    """Refresh the snapshots once per micro-batch of newly complete log batches.

    The stream follows the log's commit log, so a batch that its writer left half
    done or wrote again is read once.  Its counts are added to the store at
    ``counts_path`` under the number of the micro-batch; a retried micro-batch
    adds nothing.  Popularity and area affinity come from the store's counts, in
    which late rows count as any other.  User affinity is worked out for the
    users of the micro-batch only and merged into the stored table.
    """
    store = counts.CountStore(spark, counts_path, fold)

    def refresh(numbers: DataFrame, batch_id: int) -> None:
        found = [r["number"] for r in numbers.select("number").distinct().collect()]  # a row per log batch
        rows = committed(spark, log_path, log_schema, batches=found)
        store.add(snapshots.log_counts(rows), batch_id)
        store.compact(batch_id)
        whole = settle(store.read())
        schools, links = dims["schools"](), dims["links"]()
        publish("popularity_snapshots", snapshots.popularity(schools, links, whole), batch_id)
        publish("area_affinity_snapshots", snapshots.area_affinity(schools, links, whole), batch_id)
        users = rows.where(F.col("event_type").isin(*EVENT_WEIGHTS)).select("user_id").distinct()
        fresh = snapshots.user_affinity(whole, users)
        stored = read_affinity()
        merged = fresh if stored is None else stored.join(users, "user_id", "left_anti").unionByName(fresh)
        publish("user_affinity_snapshots", merged, batch_id)

    return commits(spark, log_path, max_batches).writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


RECENT = "user_id string, station_id string, occurred_at timestamp, event string"


class RecentSearch(StatefulProcessor):
    """Keeps the newest search of a user and forgets it after 72 hours."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "station_id string, occurred_ms long, id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.newest.get() if self.newest.exists() else None
        best = (held[1], held[2], held[0]) if held else None
        for frame in rows:
            if frame.empty:
                continue
            at = frame["occurred_at"].astype("datetime64[ms]").astype("int64")
            last = frame.assign(at=at).sort_values(["at", "id"]).iloc[-1]
            found = (int(last["at"]), int(last["id"]), last["station_id"])
            if best is None or found[:2] > best[:2]:
                best = found
        if best is None or (held and (held[1], held[2]) == best[:2]):
            return
        watermark = timerValues.getCurrentWatermarkInMs()
        expires = best[0] + SEARCH_WINDOW_HOURS * 3_600_000
        if expires <= watermark:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.newest.update((best[2], best[0], best[1]))
        self.handle.registerTimer(expires)
        yield pd.DataFrame({"user_id": [key[0]], "station_id": [best[2]], "occurred_at": [pd.Timestamp(best[0], unit="ms")], "event": ["newest"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.newest.get() if self.newest.exists() else None
        self.newest.clear()
        if held:
            yield pd.DataFrame({"user_id": [key[0]], "station_id": [held[0]], "occurred_at": [pd.Timestamp(held[1], unit="ms")], "event": ["expired"]})

    def close(self) -> None:
        pass


def recent_search_stream(log: DataFrame, stations: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Updates of the newest search per user at a known station, and its expiry.

    A search at a station that is not in ``stations`` hides no older one.  A late, older search never replaces a newer one.  The state store must be
    RocksDB (``spark.sql.streaming.stateStore.providerClass``).
    """
    searches = log.where("event_type = 'search_execute' AND target_station_id IS NOT NULL").select(
        "user_id", F.col("target_station_id").alias("station_id"), F.col("occurred_at").cast("timestamp").alias("occurred_at"), "id"
    )
    searches = searches.join(stations.select(F.col("id").alias("station_id")).distinct(), "station_id", "left_semi")
    keyed = searches.withWatermark("occurred_at", delay).groupBy("user_id")
    return keyed.transformWithStateInPandas(RecentSearch(), outputStructType=RECENT, outputMode="Update", timeMode="EventTime")


def start_page_ingest(
    spark: SparkSession,
    source: str,
    targets: Callable[[], DataFrame],
    parsers: dict[str, pages.Extractor],
    read_events: Callable[[], DataFrame | None],
    write_events: Callable[[DataFrame, int], None],
    write_reports: Callable[[DataFrame, int], None],
    checkpoint: str,
    max_files: int | None = None,
) -> StreamingQuery:
    """Pages to events, per micro-batch: extract, finalise, dedupe, upsert."""
    schema = "source_id string, logical_name string, target_url string, html string, parser_key string"

    def parse(batch: DataFrame, batch_id: int) -> None:
        seeds, failures = pages.extract_events(batch, parsers)
        seeds = seeds.persist()
        known = targets()
        found, _ = pages.dedupe_events(pages.finalize_events(seeds, known))
        stored = read_events()
        write_events(found if stored is None else upsert(stored, found, ["event_id"]), batch_id)
        write_reports(pages.parse_reports(seeds, failures.unionByName(pages.rejected_seeds(seeds, known))), batch_id)
        seeds.unpersist()

    stream = spark.readStream.schema(schema)
    if max_files:
        stream = stream.option("maxFilesPerTrigger", max_files)
    return stream.parquet(source).writeStream.foreachBatch(parse).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
