"""Outages from disconnects and reconnects, and their statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.sticky import sliced_lag

DAY_S, WEEK_S = 86_400, 604_800
BUCKETS = (("<1m", 60), ("1-5m", 300), ("5-15m", 900), ("15-60m", 3_600), ("1-4h", 14_400))


def pairs(rows: DataFrame, keys: Sequence[str] = ("store_id",), at: str = "sec", tie: str = "event_id") -> DataFrame:
    """(keys, down, up, duration): a reconnect closes the latest open disconnect; durations of 0 and of a week or more are none's.

    Of disconnects and reconnects only, a reconnect right after a disconnect is the closing one.
    """
    kinds = rows.where("kind is not null").select(*keys, at, tie, "kind")
    seen = sliced_lag(kinds, list(keys), at, tie, {"_k": "kind", "down": at}, DAY_S)
    closed = seen.where("kind = 'reconnect' and _k = 'disconnect'").select(*keys, "down", F.col(at).alias("up"), (F.col(at) - F.col("down")).alias("duration"))
    return closed.where((F.col("duration") > 0) & (F.col("duration") < WEEK_S))


def duration_text(seconds: Column) -> Column:
    return F.when(seconds < 60, F.format_string("%.1fs", seconds)).when(
        seconds < 3600,
        F.format_string("%.1fm", seconds / 60),
    ).otherwise(F.format_string("%.1fh", seconds / 3600))


def bucket(seconds: Column) -> Column:
    out = F.when(seconds < BUCKETS[0][1], BUCKETS[0][0])
    for name, below in BUCKETS[1:]:
        out = out.when(seconds < below, name)
    return out.otherwise(">4h")
