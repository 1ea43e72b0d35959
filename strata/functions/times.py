"""Time arithmetic that keeps timestamps without zone as they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros_between(start, end) -> Column:
    return F.timestamp_diff("MICROSECOND", F.col(start) if isinstance(start, str) else start,
                            F.col(end) if isinstance(end, str) else end)


def to_millis(ts) -> Column:
    """Timestamp cut to whole milliseconds; works on both timestamp types."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    micros = (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long") % 1000
    return F.timestamp_add("MICROSECOND", -micros, ts)
