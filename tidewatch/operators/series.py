"""Operators on an hourly series (idx from 0, x): hours in order, as rows.

A series has a row an hour, a hundred thousand in eleven years, whatever the input's size: rows are counted to hours first,
and only then ordered without a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIOD = 24
Z95 = 1.959964


def _every() -> Window:
    return Window.partitionBy()


def hourly(rows: DataFrame, hour: Column, gaps_as_zero: bool = False) -> DataFrame:
    """(idx, hour, x): rows by hour; hours without rows are left out unless gaps_as_zero."""
    counts = rows.groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).cast("double").alias("x"))
    if gaps_as_zero:
        span = counts.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("hour"))
        counts = span.join(counts, "hour", "left").select("hour", F.coalesce("x", F.lit(0.0)).alias("x"))
    return counts.select((F.row_number().over(Window.partitionBy().orderBy("hour")) - 1).cast("bigint").alias("idx"), "hour", "x")


def moving_average(s: DataFrame, size: int = PERIOD) -> DataFrame:
    """s with trend: the mean of positions idx - size/2 to idx + size/2 - 1, the ends standing for what lies beyond them."""
    half = size // 2
    order = Window.partitionBy().orderBy("idx")
    around = order.rowsBetween(-half, size - half - 1)
    whole = s.withColumn("_n", F.count(F.lit(1)).over(_every())).withColumn(
        "_a",
        F.first("x").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    ).withColumn("_z", F.last("x").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    left = F.greatest(F.lit(half) - F.col("idx"), F.lit(0))
    right = F.greatest(F.col("idx") + (size - half - 1) - (F.col("_n") - 1), F.lit(0))
    trend = (F.sum("x").over(around) + left * F.col("_a") + right * F.col("_z")) / size
    return whole.withColumn("trend", trend).drop("_n", "_a", "_z")


def decompose(s: DataFrame, period: int = PERIOD) -> DataFrame:
    """s with trend, seasonal (the mean of what the trend leaves, by position in the period) and residual; a series of less
    than two periods is all trend."""
    t = moving_average(s, period).withColumn("_short", F.count(F.lit(1)).over(_every()) < 2 * period)
    t = t.withColumn("trend", F.when(F.col("_short"), F.col("x")).otherwise(F.col("trend")))
    seasonal = F.avg(F.col("x") - F.col("trend")).over(Window.partitionBy(F.col("idx") % period))
    t = t.withColumn("seasonal", F.when(F.col("_short"), 0.0).otherwise(seasonal))
    return t.withColumn("residual", F.col("x") - F.col("trend") - F.col("seasonal")).drop("_short")


def forecast(s: DataFrame, horizon: int = 24, period: int = PERIOD) -> DataFrame:
    """(h, value, low, high) for the next hours: the trend's line and the season, with bounds that widen as the root of h.

    A series of less than two periods gives its mean, half of it and one and a half. An empty one gives nothing.
    """
    d = decompose(s, period)
    facts = d.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("x").alias("mean"),
        F.min_by("trend", "idx").alias("first"),
        F.max_by("trend", "idx").alias("last"),
        F.stddev_pop("residual").alias("sd"),
    ).where("n > 0")
    season = d.groupBy((F.col("idx") % period).alias("at")).agg(F.first("seasonal").alias("seasonal"))
    steps = facts.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")).withColumn("at", (F.col("n") + F.col("h") - 1) % period)
    f = steps.join(F.broadcast(season), "at", "left")  # a period's rows
    short = F.col("n") < 2 * period
    value = F.greatest(F.lit(0.0), F.col("last") + (F.col("last") - F.col("first")) / F.col("n") * F.col("h") + F.coalesce("seasonal", F.lit(0.0)))
    wide = F.lit(Z95) * F.col("sd") * F.sqrt("h")
    return f.select(
        F.col("h").cast("bigint").alias("h"),
        F.when(short, F.col("mean")).otherwise(value).alias("value"),
        F.when(short, F.col("mean") * 0.5).otherwise(F.greatest(F.lit(0.0), value - wide)).alias("low"),
        F.when(short, F.col("mean") * 1.5).otherwise(value + wide).alias("high"),
    )


def cusum(s: DataFrame, drift: float = 0.5) -> DataFrame:
    """s with up and down, the sums of standardised steps beyond drift that fall back to 0: a running sum less its least value."""
    sd = F.stddev_pop("x").over(_every())
    z = (F.col("x") - F.avg("x").over(_every())) / F.when(sd == 0, 1.0).otherwise(sd)
    upto = Window.partitionBy().orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    t = s.withColumn("_z", z)
    # the first hour has no step before it
    t = t.withColumn("_u", F.sum(F.when(F.col("idx") == 0, 0.0).otherwise(F.col("_z") - drift)).over(upto)).withColumn(
        "_d",
        F.sum(F.when(F.col("idx") == 0, 0.0).otherwise(-F.col("_z") - drift)).over(upto),
    )
    least = lambda c: F.least(F.min(c).over(upto), F.lit(0.0))
    return t.withColumn("up", F.col("_u") - least("_u")).withColumn("down", F.col("_d") - least("_d")).drop("_z", "_u", "_d")


def change_points(s: DataFrame, threshold: float = 2.0, apart: int = 3, least: int = 10) -> DataFrame:
    """(idx) where a CUSUM exceeds the threshold, more than `apart` after the last one kept; none in a series shorter than least."""
    c = cusum(s).withColumn("_n", F.count(F.lit(1)).over(_every())).where((F.col("_n") >= least) & ((F.col("up") > threshold) | (F.col("down") > threshold)))
    kept = F.aggregate(
        F.sort_array(F.collect_list("idx")),
        F.array().cast("array<bigint>"),
        lambda a, i: F.when((F.size(a) == 0) | (i - F.element_at(a, -1) > apart), F.concat(a, F.array(i))).otherwise(a),
    )
    return c.agg(kept.alias("k")).select(F.explode("k").alias("idx"))


def half_trend(s: DataFrame) -> DataFrame:
    """(first, second, trend): means of the halves and increasing, decreasing or stable by a fifth."""
    half = F.floor(F.count(F.lit(1)).over(_every()) / 2)
    t = s.withColumn("_first", F.col("idx") < half)
    out = t.agg(F.avg(F.when(F.col("_first"), F.col("x"))).alias("first"), F.avg(F.when(~F.col("_first"), F.col("x"))).alias("second"))
    return out.withColumn(
        "trend",
        F.when(F.col("second") > F.col("first") * 1.2, "increasing").when(F.col("second") < F.col("first") * 0.8, "decreasing").otherwise("stable"),
    )


def trend_by(rows: DataFrame, keys: list[str], hour: Column) -> DataFrame:
    """(keys, trend) as half_trend, of the hours of each key: increasing, decreasing or stable; stable for a single hour.

    Rows are counted to hours before the hours of a key are put in order: a row an hour, whatever the key's rows.
    """
    counts = rows.groupBy(*keys, hour.alias("hour")).agg(F.count(F.lit(1)).alias("x"))
    order = Window.partitionBy(*keys)
    placed = counts.select(*keys, "x", (F.row_number().over(order.orderBy("hour")) - 1).alias("_i"), F.floor(F.count(F.lit(1)).over(order) / 2).alias("_half"))
    first, second = (F.avg(F.when(c, F.col("x"))) for c in (F.col("_i") < F.col("_half"), F.col("_i") >= F.col("_half")))
    both = placed.groupBy(*keys).agg(first.alias("_a"), second.alias("_b"))
    return both.select(
        *keys,
        F.when(F.col("_b") > F.col("_a") * 1.2, "increasing").when(F.col("_b") < F.col("_a") * 0.8, "decreasing").otherwise("stable").alias("trend"),
    )


def autocorrelation(s: DataFrame, most: int = 48) -> DataFrame:
    """(lag, r) for lags 1 to most, at most half the series less one; none for a constant series."""
    t = s.withColumn("_n", F.count(F.lit(1)).over(_every())).withColumn("_v", F.var_pop("x").over(_every())).withColumn("_c", F.col("x") - F.avg("x").over(_every()))
    a = t.select(
        "_c",
        "_n",
        "_v",
        F.explode(F.sequence(F.lit(1), F.lit(most))).alias("lag"),
        (F.col("idx") + F.col("lag")).alias("idx"),
    ).where("lag <= _n div 2 - 1 and _v > 0")
    b = t.select("idx", F.col("_c").alias("_d"))
    return a.join(b, "idx").groupBy("lag").agg((F.sum(F.col("_c") * F.col("_d")) / F.max(F.col("_n") * F.col("_v"))).alias("r"))


def periodicity(s: DataFrame, least: float = 0.3, usual: int = PERIOD) -> DataFrame:
    """(lag, r) of the first lag that exceeds both neighbours and least, else of the usual one if it exceeds least; or no row."""
    order = Window.partitionBy().orderBy("lag")
    a = autocorrelation(s).withColumn("_b", F.lag("r").over(order)).withColumn("_a", F.lead("r").over(order))
    peak = F.when(
        (F.col("r") > F.col("_b")) & (F.col("r") > F.col("_a")) & (F.col("r") >= least),
        F.col("lag"),
    ).when((F.col("lag") == usual) & (F.col("r") > least), F.col("lag") + 1000)
    return a.withColumn("_k", peak).where("_k is not null").orderBy("_k").limit(1).select("lag", "r")


def windows(s: DataFrame, width: int = 24) -> DataFrame:
    """(idx, seq): every run of width values that another value follows."""
    run = Window.partitionBy().orderBy("idx").rowsBetween(0, width - 1)
    t = s.withColumn("seq", F.collect_list("x").over(run)).withColumn("_n", F.count(F.lit(1)).over(_every()))
    return t.where(F.col("idx") < F.col("_n") - width).select("idx", "seq")


def analog_forecast(s: DataFrame, horizon: int = 24, width: int = 24) -> DataFrame:
    """(h, value): what followed earlier runs like the last one, weighted by the square of their positive correlations above
    a hundredth of the total. Hours beyond the series' end count 0."""
    t = s.withColumn("_n", F.count(F.lit(1)).over(_every()))
    n = t.agg(F.max("_n").alias("n"))
    last = t.where(F.col("idx") >= F.col("_n") - width).agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "x"))), lambda p: p["x"]).alias("last"))
    seqs = windows(s.where(F.col("idx") < n.scalar() - width), width)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / width
    c = seqs.withColumn("last", last.scalar()).select("idx", "seq", "last", mean(F.col("seq")).alias("ms"), mean(F.col("last")).alias("ml"))
    dev = lambda a, m: F.transform(a, lambda x: x - m)
    c = c.select("idx", dev(F.col("seq"), F.col("ms")).alias("a"), dev(F.col("last"), F.col("ml")).alias("b"))
    sq = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda x, y: x + y * y) / width)
    one = lambda v: F.when(v == 0, 1.0).otherwise(v)
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y) / width
    c = c.select("idx", F.pow(F.greatest(dot / one(sq(F.col("a"))) / one(sq(F.col("b"))), F.lit(0.0)), 2).alias("w"))
    c = c.withColumn("w", F.col("w") / (F.sum("w").over(_every()) + 1e-10)).where("w > 0.01")
    after = c.select("w", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("h"), (F.col("idx") + width + F.col("h")).alias("idx"))
    got = after.join(s.select("idx", "x"), "idx").groupBy("h").agg(F.sum(F.col("w") * F.col("x")).alias("value"))
    return n.select(F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("h")).join(got, "h", "left").select(
        F.col("h").cast("bigint").alias("h"),
        F.coalesce("value", F.lit(0.0)).alias("value"),
    )


def outliers(s: DataFrame, z: float = 2.5, k: float = 1.5) -> DataFrame:
    """(idx, hour, x, method): hours beyond z standard deviations or k quartile ranges; Z-score+IQR for both."""
    facts = s.agg(F.struct(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"), F.percentile("x", F.array(F.lit(0.25), F.lit(0.75))).alias("q")).alias("f"))
    t = s.withColumn("_f", facts.scalar())
    mean, sd, low, high = F.col("_f.m"), F.col("_f.sd"), F.col("_f.q")[0], F.col("_f.q")[1]
    by_z = (sd > 0) & (F.abs(F.col("x") - mean) > z * sd)
    by_q = (F.col("x") < low - k * (high - low)) | (F.col("x") > high + k * (high - low))
    t = t.withColumn("method", F.when(by_z & by_q, "Z-score+IQR").when(by_z, "Z-score").when(by_q, "IQR"))
    return t.where("method is not null").select("idx", "hour", "x", "method")
