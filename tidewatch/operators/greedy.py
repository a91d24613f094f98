"""Greedy windows: bursts per key and cascades over all keys.

Both take the first window that qualifies and go on behind it, which no built-in window does, and which seems to need all rows
in one order. It doesn't: rows are cut into time blocks of BLOCK widths, each with the rows of one width more, so that
every window beginning in a block lies in it. A block doesn't know where the search enters it, but a search from each
possible entry soon falls in with the others: the block keeps the windows that any of them takes, its candidates. The
first candidate behind a window's end is the window that the search takes next, so the result is again greedy, over the
few candidates: at most one a time of day and place, whatever the number of rows, sorted and streamed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 16  # widths of a time block


def _runs(batches: Iterator[pd.DataFrame], names: Sequence[str]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each run of rows with equal names, from batches in the order of these."""
    held: list[dict[str, np.ndarray]] = []
    last: tuple | None = None
    for batch in batches:
        if not len(batch):
            continue
        columns = {c: batch[c].to_numpy() for c in batch.columns}
        change = np.zeros(len(batch), dtype=bool)
        for c in names:
            change[1:] |= columns[c][1:] != columns[c][:-1]
        starts = [0, *np.flatnonzero(change).tolist(), len(batch)]
        for a, b in zip(starts, starts[1:]):
            if a == b:
                continue
            run = {c: v[a:b] for c, v in columns.items()}
            key = tuple(run[c][0] for c in names)
            if held and key != last:
                yield {c: np.concatenate([h[c] for h in held]) for c in held[0]}
                held = []
            held.append(run)
            last = key
    if held:
        yield {c: np.concatenate([h[c] for h in held]) for c in held[0]}


def _candidates(t: np.ndarray, own: int, begin: int, width: int, windows: Callable[[np.ndarray], np.ndarray]) -> tuple[list[int], np.ndarray]:
    """Of a block's sorted times (the first `own` are its own) the rows at which any search takes a window, and all windows' ends.

    windows(ends) tells for each own row whether its window qualifies. A search enters at the first row of a time, as all
    rows of one time are in the window before or behind it together; entries lie within a width of the block's begin.
    """
    ends = np.searchsorted(t, t[:own] + width, side="right")
    rows = np.flatnonzero(windows(ends))
    first = np.ones(own, dtype=bool)
    first[1:] = t[1:own] != t[: own - 1]
    entries = np.flatnonzero(first & (np.concatenate([[begin], t[: own - 1]]) < begin + width))
    found: set[int] = set()
    at = np.unique(np.searchsorted(rows, entries))
    for k in at.tolist():
        while k < len(rows) and int(rows[k]) not in found:
            found.add(int(rows[k]))
            k = int(np.searchsorted(rows, ends[rows[k]]))
    return sorted(found), ends


def _greedy(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    tie: str,
    width: int,
    windows: Callable[[dict[str, np.ndarray], int, np.ndarray], np.ndarray],
    facts: Callable[[dict[str, np.ndarray], int, int], tuple],
    schema: str,
) -> DataFrame:
    """Windows [t, t + width] by keys, or over all rows without: the first that qualifies, then the first behind it, and so on.

    windows(rows, own, ends) tells which of a block's first `own` rows begin a window that qualifies, facts(rows, i, j) what is
    to be known of the window of rows i to j - 1; its columns, described by schema, begin with `start`. Rows without a key or
    time are in no window.
    """
    span = BLOCK * width
    of = lambda c: F.expr(f"({c} - pmod({c}, {span})) div {span}")
    rows = df.where(F.col(at).isNotNull())
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    rows = rows.withColumn("_block", F.explode(F.array_distinct(F.array(of(f"`{at}`"), of(f"(`{at}` - {width})")))))
    rows = rows.repartition(*keys, "_block").sortWithinPartitions(*keys, "_block", at, tie)
    kinds = dict(df.dtypes)
    result = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), schema])
    names = [x.split()[0] for x in result.replace("`", "").split(", ")]

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for run in _runs(batches, [*keys, "_block"]):
            t, begin = run[at], int(run["_block"][0]) * span
            own = int(np.searchsorted(t, begin + span))
            if not own:
                continue
            found, ends = _candidates(t, own, begin, width, lambda ends, run=run, own=own: windows(run, own, ends))
            out.extend((*(run[k][0] for k in keys), *facts(run, i, int(ends[i]))) for i in found)
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, free = None, 0
        for batch in batches:
            taken = np.zeros(len(batch), dtype=bool)
            key_rows = list(zip(*(batch[k] for k in keys), strict=True)) if keys else [()] * len(batch)
            for i, (key, start) in enumerate(zip(key_rows, batch["start"].tolist(), strict=True)):
                if key != last or start > free:
                    taken[i], last, free = True, key, start + width
            yield batch[taken]

    every = rows.mapInPandas(blocks, result)
    ordered = every.repartition(*keys).sortWithinPartitions(*keys, "start") if keys else every.repartition(1).sortWithinPartitions("start")
    return ordered.mapInPandas(choose, result)


def bursts(df: DataFrame, key: str, at: str, width: int, least: int) -> DataFrame:
    """(key, start, end, count): windows [t, t + width] with at least `least` rows, the earliest first, without overlap."""

    def windows(rows: dict[str, np.ndarray], own: int, ends: np.ndarray) -> np.ndarray:
        return ends - np.arange(own) >= least

    def facts(rows: dict[str, np.ndarray], i: int, j: int) -> tuple:
        return int(rows[at][i]), int(rows[at][j - 1]), j - i

    return _greedy(df.select(key, at), [key], at, at, width, windows, facts, "start bigint, end bigint, count bigint")


def cascades(df: DataFrame, at: str, width: int, least: int, server_wide: int = 10) -> DataFrame:
    """(start, end, stores, events, machines, dominant, is_server_wide): windows [t, t + width] with at least `least` stores.

    df has store_id, machine, category, event_id and at. dominant is the most frequent category, the least of equal ones. A
    cascade is server-wide if one machine and more than server_wide stores took part. A missing store, machine or category
    counts as one of its own.
    """

    def windows(rows: dict[str, np.ndarray], own: int, ends: np.ndarray) -> np.ndarray:
        """A window moves over the rows, with the number of rows of each store in it."""
        _, store = np.unique(rows["store_id"], return_inverse=True)
        within = np.zeros(int(store.max(initial=-1)) + 1, dtype=np.int64)
        enough, stores, j = np.zeros(own, dtype=bool), 0, 0
        store = store.tolist()
        for i, end in enumerate(ends.tolist()):
            for k in range(j, end):
                within[store[k]] += 1
                stores += within[store[k]] == 1
            j = end
            enough[i] = stores >= least
            within[store[i]] -= 1
            stores -= within[store[i]] == 0
        return enough

    def facts(rows: dict[str, np.ndarray], i: int, j: int) -> tuple:
        names, counts = np.unique(rows["category"][i:j], return_counts=True)
        machines, stores = len(np.unique(rows["machine"][i:j])), len(np.unique(rows["store_id"][i:j]))
        start, end = int(rows[at][i]), int(rows[at][j - 1])
        return start, end, stores, j - i, machines, str(names[counts.argmax()]), machines == 1 and stores > server_wide

    texts = [F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) for c in ("store_id", "machine", "category")]
    schema = "start bigint, end bigint, stores bigint, events bigint, machines bigint, dominant string, is_server_wide boolean"
    return _greedy(df.select(*texts, "event_id", at), [], at, "event_id", width, windows, facts, schema)


def propagation(found: DataFrame) -> DataFrame:
    """One row: cascades, their mean and greatest number of stores, and how many were server-wide."""
    return found.agg(
        F.count(F.lit(1)).alias("cascades"),
        F.round(F.avg("stores"), 6).alias("avg_stores"),
        F.max("stores").alias("max_stores"),
        F.count_if("is_server_wide").alias("server_wide"),
    )
