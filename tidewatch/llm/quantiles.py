"""Percentiles of huge numeric columns per group, with a bounded error, from states that combine.

Deterministic collapsing of buffers. A state holds sorted buffers of up to k values, a buffer of level l standing for 2^l
rows a value. Two full buffers of one level collapse into one of the next: their sorted union, of which every second value
is kept, beginning with the first and with the second in turns. Each collapse of level l moves a rank by at most 2^l; the
levels form a tree, so n rows make at most n/2k collapses of weight 1, n/4k of weight 2, and so on, and a state carries the
sum of these moves as its exact error bound. Nothing is random: the same rows in the same buffers give the same state.

States are rows (group columns, state_k, state_n, state_error, state_least, state_most, state_levels, state_buffers). They are made where the rows lie, before any
shuffle, so a hot group leaves a task as one small state; states of days, servers or partitions merge in any order, also
states of another k.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUFFER = 512
#: What a task holds before it hands on its states and begins anew: values, a group counting as OVERHEAD of them.
FLUSH_AT, OVERHEAD = 2_000_000, 64
STATES_AT_ONCE = 64
COLUMNS = ["state_k", "state_n", "state_error", "state_least", "state_most", "state_levels", "state_buffers"]
KINDS = ["int", "bigint", "bigint", "double", "double", "array<int>", "array<array<double>>"]
_ARROW = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.float64()))]


def rank_bound(k: int, rows: int) -> float:
    """By how much of all rows a percentile's rank from buffers of k may be off: half a buffer's value for each doubling beyond
    the first buffer, and the weight of one value."""
    levels = max(0, math.ceil(math.log2(max(rows, 1) / k)))
    return (levels / 2 + 1) / k


def buffer_for(error: float, rows: int = 1 << 40) -> int:
    """The least power of two k, 64 at least, whose rank_bound keeps within error for so many rows."""
    k = 64
    while rank_bound(k, rows) > error:
        k *= 2
    return k


class Sketch:
    """The state of one group."""

    __slots__ = ("error", "full", "held", "k", "least", "most", "n", "open", "turn")

    def __init__(self, k: int = BUFFER):
        self.k, self.n, self.error, self.least, self.most = k, 0, 0, float("inf"), float("-inf")
        self.full: dict[int, np.ndarray] = {}  # level -> a full buffer
        self.open: dict[int, np.ndarray] = {}  # level -> values short of a buffer
        self.turn: dict[int, int] = {}
        self.held = 0

    def add(self, values: np.ndarray, level: int = 0) -> None:
        """Add values that stand for 2^level rows each; finite ones only."""
        if not len(values):
            return
        self.held += len(values)
        rest = np.concatenate([self.open[level], values]) if level in self.open else np.asarray(values, dtype=float)
        whole = len(rest) // self.k * self.k
        self.open[level] = rest[whole:].copy()
        for at in range(0, whole, self.k):
            self._push(np.sort(rest[at : at + self.k]), level)

    def update(self, values: np.ndarray) -> None:
        """Add rows of the column."""
        if len(values):
            self.n += len(values)
            self.least, self.most = min(self.least, float(values.min())), max(self.most, float(values.max()))
            self.add(values)

    def _push(self, buffer: np.ndarray, level: int) -> None:
        while level in self.full:
            other = self.full.pop(level)
            turn = self.turn[level] = 1 - self.turn.get(level, 1)
            buffer = np.sort(np.concatenate([other, buffer]), kind="stable")[turn::2]
            self.held -= self.k
            self.error += 1 << level
            level += 1
        self.full[level] = buffer

    def merge(self, k: int, n: int, error: int, least: float, most: float, levels: Sequence[int], buffers: Sequence[np.ndarray]) -> None:
        """Add another state."""
        self.n, self.error = self.n + n, self.error + error
        self.least, self.most = min(self.least, least), max(self.most, most)
        for level, values in zip(levels, buffers, strict=True):
            if len(values) == self.k:
                self.held += self.k
                self._push(np.asarray(values, dtype=float), level)
            else:
                self.add(np.asarray(values, dtype=float), level)

    def parts(self) -> tuple[list[int], list[np.ndarray]]:
        found = [*self.full.items(), *((x, np.sort(b)) for x, b in self.open.items() if len(b))]
        found.sort(key=lambda p: p[0])
        return [x for x, _ in found], [b for _, b in found]

    def row(self) -> tuple:
        levels, buffers = self.parts()
        return self.k, self.n, self.error, self.least, self.most, levels, buffers

    def slack(self) -> int:
        """By how many ranks a value found may be off."""
        levels, _ = self.parts()
        return self.error + (1 << max(levels)) if self.error else 1

    def quantiles(self, ps: Sequence[float]) -> list[float]:
        """For each p the value whose rank is nearest to p of the rows, off by at most slack ranks."""
        levels, buffers = self.parts()
        if not buffers:
            return [float("nan")] * len(ps)
        values = np.concatenate(buffers)
        weights = np.repeat([1 << x for x in levels], [len(b) for b in buffers])
        order = np.argsort(values, kind="stable")
        values, upto = values[order], np.cumsum(weights[order])
        return [float(values[min(np.searchsorted(upto, p * upto[-1], side="left"), len(values) - 1)]) for p in ps]


def _comparable(key: tuple) -> tuple:
    return tuple("NaN" if x != x else x for x in key)


def _batch(kinds: list[pa.DataType], groups: Sequence[str], keys: list[tuple], sketches: list[Sketch]) -> pa.RecordBatch:
    """Rows of states."""
    columns = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate(kinds)]
    rows = [s.row() for s in sketches]
    columns += [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_ARROW)]
    return pa.RecordBatch.from_arrays(columns, names=[*groups, *COLUMNS])


def _batches(kinds, groups, found: list[tuple[tuple, Sketch]]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(found), STATES_AT_ONCE):
        some = found[at : at + STATES_AT_ONCE]
        yield _batch(kinds, groups, [k for k, _ in some], [s for _, s in some])


def _rows(batch: pa.RecordBatch, width: int) -> Iterator[tuple[tuple, tuple]]:
    """(key, state) of each row of states, buffers as arrays."""
    keys = list(zip(*(batch.column(i).to_pylist() for i in range(width)), strict=True)) if width else [()] * batch.num_rows
    plain = [batch.column(width + i).to_pylist() for i in range(6)]
    buffers = batch.column(width + 6)
    outer, inner = buffers.offsets.to_numpy(), buffers.values.offsets.to_numpy()
    values = buffers.values.values.to_numpy(zero_copy_only=False)
    for i, key in enumerate(keys):
        some = [values[inner[j] : inner[j + 1]] for j in range(outer[i], outer[i + 1])]
        yield key, (*(c[i] for c in plain), some)


def _schema(df: DataFrame, groups: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"`{g}` {kinds[g]}" for g in groups), *(f"{c} {k}" for c, k in zip(COLUMNS, KINDS, strict=True))])


def _split(batch: pa.RecordBatch, width: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """The values of a batch (group columns, value) by group."""
    values = batch.column(width).to_numpy(zero_copy_only=False)
    encoded = [batch.column(i).dictionary_encode(null_encoding="encode") for i in range(width)]
    codes = np.zeros(batch.num_rows, dtype=np.int64)
    for e in encoded:
        _, codes = np.unique(codes * len(e.dictionary) + e.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    names = [(e.dictionary.to_pylist(), e.indices.to_numpy(zero_copy_only=False)) for e in encoded]
    for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
        yield tuple(d[at[order[a]]] for d, at in names), values[order[a:b]]


def states(df: DataFrame, groups: Sequence[str], value: str, k: int = BUFFER, error: float | None = None, flush_at: int = FLUSH_AT) -> DataFrame:
    """States of value by groups, made before any shuffle. Null, NaN and infinite values count as none.

    With error, a share of ranks, k is such that percentiles keep within it up to 2^40 rows a group. Groups with a null part are
    groups of their own kind, as in groupBy. A task holds at most flush_at values and then hands on its states: a group may
    have several states, which `merged` puts together, so many groups, even one a row, don't fill it. An empty table has none.
    """
    groups = list(groups)
    if {"_value", "_branch", *COLUMNS} & set(groups):
        raise ValueError("groups need names other than the states' columns")
    k = k if error is None else buffer_for(error)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple, tuple[tuple, Sketch]] = {}
        held, kinds = 0, []
        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(len(groups))]
            for key, some in _split(batch, len(groups)) if batch.num_rows else ():
                name = _comparable(key)
                if name not in made:
                    made[name] = key, Sketch(k)
                    held += OVERHEAD
                sketch = made[name][1]
                held -= sketch.held
                sketch.update(some)
                held += sketch.held
                if held > flush_at:
                    yield from _batches(kinds, groups, list(made.values()))
                    made, held = {}, 0
        yield from _batches(kinds, groups, list(made.values()))

    number = F.col(value).cast("double")
    rows = df.select(*groups, number.alias("_value")).where("_value > double('-Infinity') and _value < double('Infinity')")
    return rows.mapInArrow(run, _schema(df, groups))


def merged(found: DataFrame, groups: Sequence[str], fan_in: int = 64) -> DataFrame:
    """States by groups (a subset of the states' columns), one a group, merged as a tree: fan_in branches for each group first,
    then these. Tasks stream through their states in the order of the groups and hold the state of one; it has the greatest k
    of those merged into it."""
    groups = list(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sketch, done, kinds = None, None, [], []
        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(len(groups))]
            for name, state in _rows(batch, len(groups)):
                if sketch is None or _comparable(name) != _comparable(key):
                    if sketch is not None:
                        done.append((key, sketch))
                        if len(done) >= STATES_AT_ONCE:
                            yield from _batches(kinds, groups, done)
                            done = []
                    key, sketch = name, Sketch(state[0])
                elif state[0] > sketch.k:
                    sketch, before = Sketch(state[0]), sketch
                    sketch.merge(*before.row())
                sketch.merge(*state)
        if sketch is not None:
            yield from _batches(kinds, groups, [*done, (key, sketch)])

    schema, tasks = _schema(found, groups), int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    branch = F.pmod(F.xxhash64("state_n", "state_least", "state_most", "state_levels", "state_error"), F.lit(fan_in))
    several = found.select(*groups, *COLUMNS, branch.alias("_branch"))
    several = several.repartition(tasks, *groups, "_branch").sortWithinPartitions(*groups, "_branch") if groups else several.repartition(tasks, "_branch")
    several = several.select(*groups, *COLUMNS).mapInArrow(run, schema)
    last = several.repartition(tasks, *groups).sortWithinPartitions(*groups) if groups else several.coalesce(1)
    return last.mapInArrow(run, schema)


def quantiles(found: DataFrame, groups: Sequence[str], ps: dict[str, float]) -> DataFrame:
    """(groups, n, error, and for p of each name: name, name_low, name_high) of merged states, one a group.

    error is the number of ranks by which a value may be off at most; low and high are the values at the ranks by that much
    lower and higher, so the exact percentile lies between them. ValueError for groups of these names.
    """
    groups = list(groups)
    kinds = dict(found.dtypes)
    names = [x for name in ps for x in (name, f"{name}_low", f"{name}_high")]
    if {"n", "error", *names} & set(groups):
        raise ValueError("groups need names other than the result's columns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for _, state in _rows(batch, len(groups)):
                s = Sketch(state[0])
                s.merge(*state)
                slack = (s.slack() + 1) / max(s.n, 1)
                wanted = [min(1.0, max(0.0, p + d)) for p in ps.values() for d in (0.0, -slack, slack)]
                out.append((s.n, s.slack(), *s.quantiles(wanted)))
            columns = [pa.array([r[i] for r in out], pa.int64() if i < 2 else pa.float64()) for i in range(2 + len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(groups)], *columns], names=[*groups, "n", "error", *names])

    schema = ", ".join([*(f"`{g}` {kinds[g]}" for g in groups), "n bigint, error bigint", *(f"`{x}` double" for x in names)])
    return found.select(*groups, *COLUMNS).mapInArrow(run, schema)


def exceeds(rows: DataFrame, groups: Sequence[str], value: str, p: str, limit: str) -> DataFrame:
    """(groups) whose exact percentile p (linear between neighbours) exceeds limit, both columns that are constant in a group, by
    counts and neighbours of limit alone: a check whose state is four numbers a group, for groups whose bounds leave it open."""
    v, over = F.col(value), F.col(value) > F.col(limit)
    counts = rows.groupBy(*groups).agg(
        F.count(v).alias("n"),
        F.count_if(~over).alias("c"),
        F.max(F.when(~over, v)).alias("below"),
        F.min(F.when(over, v)).alias("above"),
        F.max(p).alias("p"),
        F.max(limit).alias("limit"),
    )
    at = (F.col("n") - 1) * F.col("p")
    low = F.floor(at)
    between = F.col("below") + (F.col("above") - F.col("below")) * (at - low)
    return counts.where((low >= F.col("c")) | ((low + 1 == F.col("c")) & (between > F.col("limit")))).select(*groups)
