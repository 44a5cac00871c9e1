"""Windowed counts over events, by the same code that a stream uses."""

from __future__ import annotations

from .. import streaming
from ..registry import query, table


@query("event_windows", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY ALL")
def _(s, d):
    return streaming.windowed_counts(table(s, d, "events"))
