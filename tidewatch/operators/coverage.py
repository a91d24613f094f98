"""Continuous periods and gaps of intervals per entity, also for an entity with a third of all rows.

Two levels. An interval is clipped into time shards of fixed width, so that one entity's rows spread over many groups: its
piece in its first shard, its piece in its last, and, kept as one number on the first, the run of shards that it covers
wholly, so that an interval of centuries is two rows like any other. Each (entity, shard) is merged on its own. What then
has to meet is one or a few rows a shard: its first start, its last end and the runs (for gaps), or the pieces that touch a
shard's boundary and the runs (for periods). Times are bigint microseconds since 1970 UTC, intervals half open, and those
that touch are continuous.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEEK_US = 7 * 86_400_000_000
LAST_US = 253_402_300_799_999_999  # the end of the year 9999; later ends are cut there, and starts as far before 1970


def _clipped(df: DataFrame, keys: Sequence[str], start: Column, end: Column, shard_us: int) -> DataFrame:
    """(keys, shard, s, e, run): the pieces of each interval in its first and last shard; run on the first is the last of the
    shards between them, null if there are none. Rows with a null key, start or end, or an end not after the start, have none."""
    w = F.lit(shard_us)
    s, e = F.greatest(start.cast("bigint"), F.lit(-LAST_US)), F.least(end.cast("bigint"), F.lit(LAST_US))
    rows = df.select(*keys, F.when(start.isNotNull(), s).alias("_s"), F.when(end.isNotNull(), e).alias("_e")).where("_e > _s")
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    first, last = (F.expr(f"({x} - pmod({x}, {shard_us})) div {shard_us}") for x in ("_s", "(_e - 1)"))
    rows = rows.select("*", first.alias("_first"), last.alias("_last"))
    head = F.struct(
        F.col("_first").alias("shard"),
        F.col("_s").alias("s"),
        F.least("_e", (F.col("_first") + 1) * w).alias("e"),
        F.when(F.col("_last") > F.col("_first") + 1, F.col("_last") - 1).alias("run"),
    )
    tail = F.struct(F.col("_last").alias("shard"), (F.col("_last") * w).alias("s"), F.col("_e").alias("e"), F.lit(None).cast("bigint").alias("run"))
    pieces = F.when(F.col("_first") == F.col("_last"), F.array(head)).otherwise(F.array(head, tail))
    return rows.select(*keys, F.explode(pieces).alias("_p")).select(*keys, "_p.*").where("shard is not null")


def _local(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """parts with `before`, the latest end among the earlier parts of the same entity and shard (null for the first), and on the
    last part of each `edge`: the shard's first start, last end and farthest run.

    All that follows is taken from these rows, so that the parts are shuffled once and the table is read once. That needs all
    uses to ask for the same columns: the condition at the end always holds, but keeps run in those that don't use it.
    """
    order = Window.partitionBy(*keys, "shard").orderBy("s", "e")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    edge = F.struct(F.first("s").over(upto).alias("s"), F.max("e").over(upto).alias("e"), F.max("run").over(upto).alias("run"))
    return parts.select(
        *keys,
        "shard",
        "s",
        "e",
        F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.when(F.lead("s").over(order).isNull(), edge).alias("edge"),
        "run",
    ).where("run is null or run > shard")


def _edges(local: DataFrame, keys: Sequence[str], shard_us: int) -> DataFrame:
    """(keys, shard, s, e, run, reach, covered), a row an entity and shard: reach is the end of what earlier shards cover, runs
    included; covered tells whether a run of theirs covers this shard."""
    edges = local.where("edge is not null").select(*keys, "shard", "edge.*")
    earlier = Window.partitionBy(*keys).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    end = F.greatest("e", (F.col("run") + 1) * F.lit(shard_us))
    covered = F.coalesce(F.max("run").over(earlier) >= F.col("shard"), F.lit(False))
    return edges.select("*", F.max(end).over(earlier).alias("reach"), covered.alias("covered"))


def _outside_runs(rows: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows (keys, shard, ...) whose shard no run covers."""
    return rows.join(edges.where("covered").select(*keys, "shard"), [*keys, "shard"], "left_anti")


def _named(found: DataFrame, keys: Sequence[str], inner: Sequence[str], results: Sequence[str]) -> DataFrame:
    return found.select(*[F.col(i).alias(k) for i, k in zip(inner, keys, strict=True)], *results)


def _keyed(df: DataFrame, keys: Sequence[str], start: Column, end: Column, results: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """df's keys under names of our own, so that theirs may be any but the results', with start and end."""
    if set(keys) & set(results) or len(set(keys)) < len(keys):
        raise ValueError(f"keys need names of their own, other than {', '.join(results)}")
    inner = [f"_k{i}" for i in range(len(keys))]
    return df.select(*[F.col(k).alias(i) for i, k in zip(inner, keys, strict=True)], start.alias("_start"), end.alias("_end")), inner


def gaps(df: DataFrame, keys: Sequence[str], start: Column, end: Column, shard_us: int = WEEK_US) -> DataFrame:
    """(keys, gap_start, gap_end) in microseconds: each gap between one continuous period of an entity and the next.

    An entity of one period has none. Rows with a null key, start or end, or an end not after the start, are left out; repeated
    rows change nothing, other columns aren't looked at. Empty input gives no rows. ValueError for keys of the results' names.
    """
    results = ["gap_start", "gap_end"]
    rows, inner = _keyed(df, keys, start, end, results)
    local = _local(_clipped(rows, inner, F.col("_start"), F.col("_end"), shard_us), inner)
    edges = _edges(local, inner, shard_us)
    inside = local.where("s > before").select(*inner, "shard", F.col("before").alias("gap_start"), F.col("s").alias("gap_end"))
    inside = _outside_runs(inside, edges, inner)
    across = edges.where("s > reach").select(*inner, F.col("reach").alias("gap_start"), F.col("s").alias("gap_end"))
    return _named(inside.drop("shard").unionByName(across), keys, inner, results)


def periods(df: DataFrame, keys: Sequence[str], start: Column, end: Column, shard_us: int = WEEK_US) -> DataFrame:
    """(keys, period_start, period_end) in microseconds: the continuous periods of each entity. Rows are left out as by gaps."""
    results = ["period_start", "period_end"]
    rows, inner = _keyed(df, keys, start, end, results)
    w = F.lit(shard_us)
    local = _local(_clipped(rows, inner, F.col("_start"), F.col("_end"), shard_us), inner)
    edges = _edges(local, inner, shard_us)
    order = Window.partitionBy(*inner, "shard").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)
    islands = local.select(*inner, "shard", "s", "e", F.sum(F.when(F.col("s") <= F.col("before"), 0).otherwise(1)).over(order).alias("island"))
    merged = islands.groupBy(*inner, "shard", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    merged = merged.withColumn("touches", (F.col("s") == F.col("shard") * w) | (F.col("e") == (F.col("shard") + 1) * w))
    whole = merged.where("not touches").select(*inner, "shard", F.col("s").alias("period_start"), F.col("e").alias("period_end"))
    whole = _outside_runs(whole, edges, inner)
    runs = edges.where("run is not null").select(*inner, ((F.col("shard") + 1) * w).alias("s"), ((F.col("run") + 1) * w).alias("e"))
    chain = Window.partitionBy(*inner).orderBy("s", "e")
    touching = merged.where("touches").select(*inner, "s", "e").unionByName(runs)
    touching = touching.withColumn("before", F.max("e").over(chain.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.when(F.col("s") <= F.col("before"), 0).otherwise(1)
    touching = touching.withColumn("chain", F.sum(new).over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    stitched = touching.groupBy(*inner, "chain").agg(F.min("s").alias("period_start"), F.max("e").alias("period_end"))
    return _named(whole.drop("shard").unionByName(stitched.drop("chain")), keys, inner, results)
