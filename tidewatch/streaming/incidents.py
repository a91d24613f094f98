"""The same results over arriving lines and events."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.operators.outages import WEEK_S
from tidewatch.operators.parse import connection_kind, store, timestamp
from tidewatch.functions.classify import error_category, severity


def parsed_lines(lines: DataFrame, text: str = "value", late: str = "1 hour") -> DataFrame:
    """Events from a stream of lines: ts, store_id, category, severity, kind; lines without time, category and severity are none.
    Lines may be `late` by event time; what arrives later still is left out of the results below."""
    t = F.regexp_replace(text, "^[\\s﻿]+|\\s+$", "")
    found = lines.select(
        t.alias("line"),
        timestamp(t).cast("timestamp").alias("ts"),
        store(t).alias("store_id"),
        error_category(t).alias("category"),
        severity(t).alias("severity"),
        connection_kind(t).alias("kind"),
    )
    return found.where("ts is not null and coalesce(category, severity, kind) is not null").withWatermark("ts", late)


def once(events: DataFrame) -> DataFrame:
    """Each line once, as long as its repeats aren't late."""
    return events.dropDuplicatesWithinWatermark(["line"])


def hourly(events: DataFrame) -> DataFrame:
    """(hour, category, n), final once the watermark has passed the hour."""
    w = F.window("ts", "1 hour")
    return events.groupBy(
        w,
        F.coalesce("category", F.lit("none")).alias("category"),
    ).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("hour"), "category", "n")


def outages(events: DataFrame) -> DataFrame:
    """(store_id, down, up, duration) in seconds as they close: a store's state is its open disconnect and the rows not yet
    due, which wait until the watermark has passed them so that late ones are put in order. Lines have no order of their own in
    a stream: of those of one second the disconnect comes first."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        down, waiting = state.get if state.exists else (None, [])
        rows = [(int(t.timestamp()), k) for b in batches for t, k in zip(b["ts"], b["kind"], strict=True)]
        due, now = sorted([*map(tuple, waiting), *rows]), state.getCurrentWatermarkMs() // 1000
        out, waiting = [], []
        for at, kind in due:
            if at > now:
                waiting.append((at, kind))
            elif kind == "disconnect":
                down = at
            elif down is not None:
                if 0 < at - down < WEEK_S:
                    out.append((key[0], down, at, at - down))
                down = None
        state.update((down, waiting))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["store_id", "down", "up", "duration"])

    rows = events.where("kind is not null and store_id is not null").select("store_id", "ts", "kind")
    return rows.groupBy("store_id").applyInPandasWithState(
        step, "store_id string, down bigint, up bigint, duration bigint", "down bigint, waiting array<struct<at: bigint, kind: string>>", "append", GroupStateTimeout.EventTimeTimeout
    )


def bursts(events: DataFrame, width: int = 600, least: int = 5) -> DataFrame:
    """(store_id, start, end, count) in seconds: windows [t, t + width] of a store with at least `least` disconnects, the earliest first,
    without overlap, each once the watermark has passed its end. A store's state is the end of its last burst and the times not
    yet decided, of one window's width and the allowed lateness; rows that the watermark has passed already are left out."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free, waiting = state.get if state.exists else (None, [])
        now = state.getCurrentWatermarkMs() // 1000
        times = sorted([*waiting, *(at for b in batches for t in b["ts"] if (at := int(t.timestamp())) > now)])
        out, i = [], 0
        while i < len(times):
            if free is not None and times[i] <= free:
                i += 1
                continue
            if times[i] + width >= now:
                break
            j = bisect_right(times, times[i] + width)
            if j - i >= least:
                out.append((key[0], times[i], times[j - 1], j - i))
                free, i = times[i] + width, j
            else:
                i += 1
        waiting = times[i:]
        state.update((free, waiting))
        if waiting:
            state.setTimeoutTimestamp(max((waiting[0] + width + 1) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["store_id", "start", "end", "count"])

    rows = events.where("kind = 'disconnect' and store_id is not null").select("store_id", "ts")
    return rows.groupBy("store_id").applyInPandasWithState(
        step, "store_id string, start bigint, end bigint, count bigint", "free bigint, waiting array<bigint>", "append", GroupStateTimeout.EventTimeTimeout
    )
