"""Per-key results over a join in which a handful of keys holds most of the rows.

A join of n left and m right rows of one key makes n*m rows in one task. Here neither side's rows meet: each side is
first folded to one compact state per key (map-side combined, so a hot key leaves a map task as a single row), the
states are joined, and what the aggregates over all n*m pairs would have been follows by algebra: counts multiply, a sum
over the pairs is a side's sum times the other side's count, minima and maxima carry over. Coarser groups are rolled up
from the joined states.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Measure:
    """An aggregate of one side: kind is sum, min or max of value, named name in the result."""

    name: str
    kind: str
    value: Column


def once(df: DataFrame, id_column: str, *kept: str) -> DataFrame:
    """One row per id with the kept columns; rows without an id stay as they are. Among differing copies the least row wins."""
    cols = [c for c in kept if c != id_column]
    known = df.where(F.col(id_column).isNotNull())
    one = known.groupBy(id_column).agg(F.min(F.struct(*cols)).alias("_row")).select(id_column, "_row.*")
    return one.unionByName(df.where(F.col(id_column).isNull()).select(id_column, *cols))


def key_states(df: DataFrame, keys: Sequence[str], measures: Sequence[Measure], rows: str) -> DataFrame:
    """The compact state of each key: its number of rows and its measures. Rows with a null key part have no state."""
    kinds = {"sum": F.sum, "min": F.min, "max": F.max}
    known = df.dropna(subset=list(keys))
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias(rows), *[kinds[m.kind](m.value).alias(m.name) for m in measures])


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_measures: Sequence[Measure] = (),
    right_measures: Sequence[Measure] = (),
    how: str = "inner",
) -> DataFrame:
    """The aggregates per key of `left JOIN right USING (keys)` without making its rows.

    Columns: keys, left_rows, right_rows, joined_rows, each measure over its own side, and for sums also joined_<name>,
    the sum over the joined rows. how is inner, left, right or full; a side without the key counts 0 rows, and its
    measures are null. Null keys join nothing and are left out. Other columns, also of clashing names, aren't looked at.
    Empty inputs give an empty result of the same schema.
    """
    names = [m.name for m in (*left_measures, *right_measures)]
    taken = {*keys, "left_rows", "right_rows", "joined_rows"}
    if len(set(names)) < len(names) or taken & set(names):
        raise ValueError("measures need names of their own")
    a = key_states(left, keys, left_measures, "left_rows")
    b = key_states(right, keys, right_measures, "right_rows")
    both = a.join(b, list(keys), how)
    n, m = (F.coalesce(F.col(x), F.lit(0)) for x in ("left_rows", "right_rows"))
    sums = [(F.col(x.name) * other).alias(f"joined_{x.name}") for side, other in ((left_measures, m), (right_measures, n)) for x in side if x.kind == "sum"]
    return both.select(*keys, n.alias("left_rows"), m.alias("right_rows"), (n * m).alias("joined_rows"), *names, *sums)


def roll_up(states: DataFrame, to: Sequence[Column], sums: Sequence[str]) -> DataFrame:
    """Coarser groups from joined states: the sums of sums by the columns `to`, again over one row a key only."""
    return states.groupBy(*to).agg(*[F.sum(x).alias(x) for x in sums])


def hot_keys(states: DataFrame, key: str, sides: dict[str, str], share: float) -> DataFrame:
    """(field, hot_key) of the keys holding at least share of their field's rows.

    sides names for each field the column of states with the key's rows. The totals are one row a field, a proven bound,
    and hence broadcast.
    """
    long = states.select(
        F.col(key).alias("hot_key"),
        F.explode(F.create_map(*[x for field, c in sides.items() for x in (F.lit(field), F.col(c))])).alias("field", "n"),
    ).where("n > 0")
    totals = long.groupBy("field").agg(F.sum("n").alias("total"))
    return long.join(F.broadcast(totals), "field").where(F.col("n") >= F.col("total") * F.lit(share)).select("field", "hot_key")
