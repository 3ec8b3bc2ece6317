"""Streaming plan: first-day event statistics computed incrementally (A1 via
``streaming.events``), checked against the same SQL as the batch form."""

from __future__ import annotations

from ..sources.codes import VITAL_STATS
from ..streaming.events import event_stream, run_available, windowed_stats_stream
from . import extraction as X
from .common import rounded, sql_round, table
from .sources import scratch_path


def q_stream_event_stats(spark, sf):
    schema = table(spark, sf, "events").schema
    ev = event_stream(spark, f"{sf.rstrip('/')}/events*.parquet", schema)  # a folder or glob of event files
    s = windowed_stats_stream(ev, X.event_anchors(spark, sf), "user_id", "ts", "origin", "event_type", "value",
                              X.EVENT_TYPES, *X.EVENT_WINDOW_HOURS, stats=VITAL_STATS)
    out = run_available(s, scratch_path(spark, "stream_ckpt"), scratch_path(spark, "stream_out"))
    return rounded(out)


QUERIES = {"a1_stream_event_stats": q_stream_event_stats}

SQL = {
    "a1_stream_event_stats": f"""WITH {X.SQL_EVENT_LONG}
        SELECT user_id, event_type, {', '.join(f'{sql_round(s)} AS {s}' if s != 'count' else 'CAST(count AS BIGINT) AS count' for s in VITAL_STATS)}
        FROM ev_long""",
}
