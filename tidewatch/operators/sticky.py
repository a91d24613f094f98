"""The last value seen so far in an ordered file, without making a huge file one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 20_000


def carry_forward(df: DataFrame, file: str, order: str, columns: Sequence[str], block: int = BLOCK) -> DataFrame:
    """df with each of columns replaced by its last non-null value at or above the row in its file.

    order is a bigint, unique in the file. Two levels: a running maximum within blocks of the order, then over the blocks'
    last values, of which there is one a block.
    """
    kept = [c for c in df.columns if c not in columns]
    seen = df.select(
        *kept,
        F.expr(f"`{order}` div {block}").alias("_b"),
        *[F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).alias("v"))).alias(c) for c in columns],
    )
    within = Window.partitionBy(file, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(file).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = seen.groupBy(file, "_b").agg(*[F.max(c).alias(c) for c in columns]).select(file, "_b", *[F.max(c).over(earlier).alias(f"_{c}") for c in columns])
    running = seen.select(*kept, "_b", *[F.max(c).over(within).alias(c) for c in columns]).join(before, [file, "_b"])
    return running.select(*kept, *[F.coalesce(F.col(c)["v"], F.col(f"_{c}")["v"]).alias(c) for c in columns])


def sliced_lag(df: DataFrame, keys: Sequence[str], at: str, tie: str, columns: dict[str, str], width: int) -> DataFrame:
    """df with columns (new name -> old) of the row before, by keys in the order of (at, tie); null in a key's first row.

    A key's rows are compared within time slices of width; the last row of the slice before is carried over the edge. So
    neither a key with a third of all rows nor, without keys, the whole table is sorted by one task.
    """
    if tie == at or not columns:
        raise ValueError("an order needs a tie-break and columns")
    sliced = df.withColumn("_slice", F.floor(F.col(at) / width))
    row = F.struct(*[F.col(old).alias(new) for new, old in columns.items()])
    by_key = Window.partitionBy(*keys).orderBy("_slice")
    last = sliced.groupBy(*keys, "_slice").agg(F.max_by(row, F.struct(at, tie)).alias("_r")).select(*keys, "_slice", F.lag("_r").over(by_key).alias("_carried"))
    within = F.lag(row).over(Window.partitionBy(*keys, "_slice").orderBy(at, tie))
    joined = sliced.withColumn("_before", within).join(last, [*keys, "_slice"])
    joined = joined.withColumn("_before", F.coalesce("_before", "_carried"))
    return joined.select(*df.columns, *[F.col("_before")[new].alias(new) for new in columns])
