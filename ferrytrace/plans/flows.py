"""Queries over whole deliveries: what a reader gets is what the filter kept."""

from __future__ import annotations

from ferrytrace.functions.measures import records_per_pack
from ferrytrace.plans import deliveries
from ferrytrace.plans.aggregates import CHUNK_BYTES
from ferrytrace.plans.registry import (
    EVENT_JSON_SQL,
    CSV_LINE_SQL,
    EVENT_COLUMNS,
    WANTED,
    WANTED_SQL,
    key_value_view,
    query,
)
from ferrytrace.plans.scans import packed_sql
from ferrytrace.sources import files

KEPT_SQL = f"SELECT user_id::VARCHAR AS key, {EVENT_JSON_SQL} AS value FROM events WHERE {WANTED_SQL}"


def _direct(t, rows):
    topics = t.topics()
    deliveries.deliver_direct(rows, "event_type", WANTED, "user_id", "event_id", topics, "kept")
    return topics


@query("pipe_remote_filter", KEPT_SQL)
def pipe_remote_filter(t):
    """The raw file is moved first; filtering and publishing happen at the destination."""
    moved = t.area("moved")
    files.write_csv(t.event_text(), moved)
    topics = _direct(t, files.read_csv_text(t.spark, moved))
    return key_value_view(topics.read(t.spark, "kept"))


@query("pipe_direct", KEPT_SQL)
def pipe_direct(t):
    return key_value_view(_direct(t, t.event_text()).read(t.spark, "kept"))


@query("pipe_filter_files", f"SELECT NULL::VARCHAR AS key, {CSV_LINE_SQL} AS value FROM events WHERE {WANTED_SQL}")
def pipe_filter_files(t):
    topics = t.topics()
    rows = t.event_text(EVENT_COLUMNS)
    deliveries.deliver_files(
        t.spark, rows, "event_type", WANTED, t.area("filtered"), topics, "kept"
    )
    return key_value_view(topics.read(t.spark, "kept"))


@query("pipe_replicated", KEPT_SQL)
def pipe_replicated(t):
    topics = _direct(t, t.event_text())
    copied = deliveries.deliver_replicated(
        t.spark, topics, "kept", t.topics(), t.area("checkpoint")
    )
    return key_value_view(copied)


@query("pipe_chunked", KEPT_SQL)
def pipe_chunked(t):
    topics = _direct(t, t.event_text())
    moved = deliveries.deliver_chunked(
        t.spark, topics, "kept", CHUNK_BYTES, t.area("chunks"), t.area("checkpoint")
    )
    return key_value_view(moved)


@query("pipe_packed", f"SELECT NULL::VARCHAR AS key, value FROM ({packed_sql(146, WANTED_SQL)})")
def pipe_packed(t):
    topics = t.topics()
    deliveries.deliver_packed(
        t.event_text(EVENT_COLUMNS), "event_type", WANTED, "event_id", records_per_pack(10), topics, "packed"
    )
    return key_value_view(topics.read(t.spark, "packed"))
