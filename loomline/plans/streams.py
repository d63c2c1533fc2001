"""Queries on event windows, with their checking SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..streaming import windows as W
from .evaluation import rounded, t

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def streamed(s, d, mode="complete"):
    """The tumbling counts of the events file, read as a stream."""
    e = W.event_stream(s, d, "events.parquet")
    return W.drain(W.windowed(e, "ts", "1 day", by=["event_type"]), f"w_{uuid.uuid4().hex}", mode)


query("window_tumbling", "select event_type, date_trunc('day', ts) as start, date_trunc('day', ts) + interval 1 day as end, count(*) as n, round(sum(value), 4) as total from events group by 1, 2, 3")(lambda s, d: rounded(W.windowed(t(s, d, "events"), "ts", "1 day", by=["event_type"], value="value"), "total", digits=4))
query("window_sliding", "with x as (select time_bucket(interval 6 hour, ts) as b from events), y as (select unnest([b, b - interval 6 hour]) as start from x) select start, start + interval 12 hour as end, count(*) as n from y group by 1")(lambda s, d: W.windowed(t(s, d, "events"), "ts", "12 hours", "6 hours"))
query("window_session", "with x as (select user_id, ts, case when ts - lag(ts) over w < interval 4 hour then 0 else 1 end as new from events window w as (partition by user_id order by ts)), g as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from x) select user_id, min(ts) as start, max(ts) + interval 4 hour as end, count(*) as n from g group by user_id, k")(lambda s, d: W.sessions(t(s, d, "events"), "ts", "4 hours", "user_id"))
query("stream_tumbling", "select event_type, date_trunc('day', ts) as start, date_trunc('day', ts) + interval 1 day as end, count(*) as n from events group by 1, 2, 3")(streamed)
query("stream_dedup", "select count(distinct event_id) as n from events")(lambda s, d: W.drain(W.distinct_events(W.event_stream(s, d, "events.parquet").select("event_id", "ts"), ["event_id"], "ts"), f"d_{uuid.uuid4().hex}").agg(F.count("*").alias("n")))
