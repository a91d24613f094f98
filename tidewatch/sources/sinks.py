"""Results as files, JSON and text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_csv(df: DataFrame, path: str, by: str) -> None:
    """One header and all columns, greatest first. Rows are range-partitioned; files are in order."""
    df.orderBy(F.desc(by)).write.option("header", True).csv(path)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text a row."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def report(df: DataFrame, title: str, rows: int = 50) -> str:
    """A text table of the first rows, for people; the result itself stays a DataFrame."""
    found = df.limit(rows).collect()  # at most `rows`
    cells = [df.columns, *[["" if x is None else f"{x:.1f}" if isinstance(x, float) else str(x) for x in r] for r in found]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    lines = ["  ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)).rstrip() for r in cells]
    return "\n".join([title, "-" * len(title), *lines])


def bars(df: DataFrame, value: str, width: int = 40, mark: str = "█") -> DataFrame:
    """df with bar, in proportion to value over the greatest."""
    from pyspark.sql import Window

    most = F.max(value).over(Window.partitionBy())
    return df.withColumn("bar", F.when(most > 0, F.repeat(F.lit(mark), F.floor(F.col(value) * width / most).cast("int"))).otherwise(""))
