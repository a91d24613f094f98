"""Keys that fail together: pairs whose minutes lie close to one another.

Time is cut into slices. In a slice the keys' minutes are two 0/1 matrices, keys by minutes: L as they are, R widened by `near`
to both sides. The product L Rᵀ has for every pair of keys how many of the one's minutes lie near the other's, so a minute in
which n keys fail costs n rows of input and no n² rows of pairs; a slice hands on one row a pair, and slices add up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 1_440  # minutes of a slice
CELLS = 4_000_000  # of a product, or pairs listed, that a task holds at once
DENSE = 100  # a listed pair costs about as much as so many multiplications


def _by_minute(key: np.ndarray, minute: np.ndarray, minutes: np.ndarray) -> list[np.ndarray]:
    """The keys at each of the sorted minutes."""
    order = np.argsort(minute, kind="stable")
    cuts = np.searchsorted(minute[order], minutes)
    return np.split(key[order], cuts[1:]) if len(minutes) else []


def near_counts(a: np.ndarray, a_minute: np.ndarray, b: np.ndarray, b_minute: np.ndarray, keys: int, near: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, counts): for the keys x < y, as x * keys + y, how many of x's minutes in a have one of y's in b within near.

    Keys are numbers below `keys`; no key has a minute twice. Where few keys meet in a minute the pairs are listed, else
    the matrices are multiplied; both give the same.
    """
    minutes = np.unique(a_minute)
    wide_key, wide_minute = np.repeat(b, 2 * near + 1), (b_minute[:, None] + np.arange(-near, near + 1)).ravel()
    wide = np.unique(np.stack([wide_minute, wide_key]), axis=1) if len(b) else np.empty((2, 0), dtype=np.int64)
    at = np.searchsorted(minutes, wide[0])
    known = (at < len(minutes)) & (minutes[np.minimum(at, len(minutes) - 1)] == wide[0]) if len(minutes) else np.zeros(0, dtype=bool)
    r_minute, r_key = at[known], wide[1][known]
    l_minute = np.searchsorted(minutes, a_minute)
    n = len(minutes)
    meetings = int((np.bincount(l_minute, minlength=n) * np.bincount(r_minute, minlength=n)).sum()) if n else 0
    found: dict[str, list[np.ndarray]] = {"pair": [], "count": []}

    def keep(pair: np.ndarray, count: np.ndarray) -> None:
        found["pair"].append(pair)
        found["count"].append(count)

    rows, row = np.unique(a, return_inverse=True)
    columns, column = np.unique(r_key, return_inverse=True)
    if meetings * DENSE < len(rows) * len(columns) * n:
        some: list[np.ndarray] = []
        size = 0
        for x, y in zip(_by_minute(a, l_minute, np.arange(n)), _by_minute(r_key, r_minute, np.arange(n)), strict=True):
            for part in np.array_split(x, max(1, len(x) * len(y) // CELLS + 1)):
                pairs = (part[:, None] * keys + y[None])[part[:, None] < y[None]]
                some.append(pairs)
                size += len(pairs)
                if size > CELLS:
                    keep(*np.unique(np.concatenate(some), return_counts=True))
                    some, size = [], 0
        if some:
            keep(*np.unique(np.concatenate(some), return_counts=True))
    elif n:
        right = np.zeros((len(columns), n), dtype=np.float32)
        right[column, r_minute] = 1
        step = max(1, CELLS // max(len(columns), n))
        order = np.argsort(row, kind="stable")
        starts = np.searchsorted(row[order], np.arange(0, len(rows) + step, step))
        for k in range(0, len(rows), step):
            some_rows = order[starts[k // step] : starts[k // step + 1]]
            left = np.zeros((min(step, len(rows) - k), n), dtype=np.float32)
            left[row[some_rows] - k, l_minute[some_rows]] = 1
            counts = left @ right.T
            i, j = np.nonzero(counts)
            less = rows[k + i] < columns[j]
            keep(rows[k + i][less] * keys + columns[j][less], counts[i[less], j[less]].astype(np.int64))
    if not found["pair"]:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(found["pair"]), np.concatenate(found["count"])


def co_failures(df: DataFrame, key: str, minute: str, near: int = 5, over: float = 0.3, width: int = SLICE) -> DataFrame:
    """(a, b, shared, overlap): pairs of keys a < b with minutes of a within `near` minutes of one of b's; shared is their number,
    overlap that over the lesser key's minutes, above `over`. Minutes count once; rows without key or minute are left out."""
    kind = dict(df.dtypes)[key]
    m = df.select(F.col(key).alias("k"), F.col(minute).cast("bigint").alias("m")).where("k is not null and m is not null").distinct()
    n = m.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    of = lambda c: F.expr(f"({c} - pmod({c}, {width})) div {width}")
    sliced = m.withColumn("slice", F.explode(F.array_distinct(F.array(of("m"), of(f"(m - {near})"), of(f"(m + {near})")))))

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        names, code = np.unique(pdf["k"].to_numpy(), return_inverse=True)
        at, begin = pdf["m"].to_numpy(), int(pdf["slice"].iloc[0]) * width
        own = (at >= begin) & (at < begin + width)
        pair, count = near_counts(code[own], at[own], code, at, len(names), near)
        return pd.DataFrame({"a": names[pair // len(names)], "b": names[pair % len(names)], "shared": count})

    met = sliced.groupBy("slice").applyInPandas(pairs, f"a {kind}, b {kind}, shared bigint").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    sized = met.join(n.select(F.col("k").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("k").alias("b"), F.col("n").alias("nb")), "b")
    return sized.select("a", "b", "shared", F.round(F.col("shared") / F.least("na", "nb"), 6).alias("overlap")).where(F.col("overlap") > over)
