"""Structured Streaming forms of the ingest and snapshot jobs."""

from wayside.streaming.jobs import (  # noqa: F401
    recent_search_stream,
    start_log_ingest,
    start_page_ingest,
    start_snapshot_refresh,
)
