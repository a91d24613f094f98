"""Feature rows of stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.sticky import sliced_lag
from tidewatch.sources.incidents import hour_of

EIGHT = ["total", "variance", "max_hourly", "categories", "ips", "mean_interval_h", "min_interval", "burst_score"]


def _d(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6)


def by_hour(rows: DataFrame) -> DataFrame:
    h = rows.groupBy("store_id", hour_of().alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    night = F.pmod("hour", F.lit(24)).isin(22, 23, 0, 1, 2, 3, 4, 5)
    return h.groupBy("store_id").agg(
        F.var_pop("n").alias("variance"),
        F.max("n").alias("max_hourly"),
        F.min("n").alias("min_hourly"),
        F.sum(F.when(night, F.col("n")).otherwise(0)).alias("night"),
    )


def store_features8(rows: DataFrame, short: int = 3_600, least: int = 3) -> DataFrame:
    """store_id and EIGHT, of stores with at least `least` incidents; burst_score is the share of intervals under `short` seconds."""
    gaps = sliced_lag(
        rows.select("store_id", "sec", "event_id"),
        ["store_id"],
        "sec",
        "event_id",
        {"_b": "sec"},
        86_400,
    ).withColumn("gap", F.col("sec") - F.col("_b"))
    gaps = gaps.groupBy("store_id").agg(
        F.avg("gap").alias("g"),
        F.min("gap").alias("m"),
        F.avg(F.when(F.col("gap").isNotNull(), (F.col("gap") < short).cast("int"))).alias("b"),
    )
    base = rows.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.countDistinct("category").alias("categories"),
        F.countDistinct("ip").alias("ips"),
    ).where(F.col("total") >= least)
    f = base.join(by_hour(rows), "store_id").join(gaps, "store_id")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return f.select(
        "store_id",
        _d("total").alias("total"),
        _d("variance").alias("variance"),
        _d("max_hourly").alias("max_hourly"),
        _d("categories").alias("categories"),
        _d("ips").alias("ips"),
        _d(zero(F.col("g") / 3600)).alias("mean_interval_h"),
        _d(zero(F.col("m").cast("double"))).alias("min_interval"),
        _d(zero(F.col("b"))).alias("burst_score"),
    )


def store_features15(rows: DataFrame, ratios: list[str], least: int = 5) -> DataFrame:
    """The wider matrix: counts, hourly spread, delays (share under 60, mean, spread), night share and shares of the categories in ratios, with the dominant category."""
    share = {f"{c}_ratio": F.avg((F.col("category") == c).cast("int")) for c in ratios}
    base = rows.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("total"), F.countDistinct("category").alias("categories"), F.countDistinct("ip").alias("ips"), F.avg((F.col("delay") < 60).cast("int")).alias("quick"),
        F.avg("delay").alias("delay_mean"), F.stddev_pop("delay").alias("delay_std"), F.mode("category", deterministic=True).alias("dominant"), *[v.alias(k) for k, v in share.items()],
    ).where(F.col("total") >= least)
    f = base.join(by_hour(rows), "store_id").withColumn("night_ratio", F.col("night") / F.col("total"))
    names = ["total", "variance", "max_hourly", "min_hourly", "categories", "ips", "quick", "night_ratio", "delay_mean", "delay_std", *share]
    return f.select("store_id", *[_d(c).alias(c) for c in names], "dominant")


def health_features(rows: DataFrame) -> DataFrame:
    """Of stores: failures, daily mean and sample variance (0 for one day), night and weekend shares, busiest hour, modal machine (least of equal ones)."""
    daily = rows.groupBy("store_id", F.floor(F.col("sec") / 86_400).alias("day")).agg(F.count(F.lit(1)).alias("n")).groupBy("store_id").agg(
        F.avg("n").alias("daily"),
        F.coalesce(F.var_samp("n"), F.lit(0.0)).alias("daily_var"),
    )
    hour, day = F.hour("ts"), F.weekday("ts")
    base = rows.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("failures"),
        F.avg(((hour >= 22) | (hour < 6)).cast("int")).alias("night_ratio"),
        F.avg((day >= 5).cast("int")).alias("weekend_ratio"),
        F.mode("machine", deterministic=True).alias("machine"),
    )
    f = base.join(daily, "store_id").join(by_hour(rows).select("store_id", "max_hourly"), "store_id")
    return f.select(
        "store_id",
        "failures",
        _d("daily").alias("daily"),
        _d("daily_var").alias("daily_var"),
        _d("night_ratio").alias("night_ratio"),
        _d("weekend_ratio").alias("weekend_ratio"),
        "max_hourly",
        "machine",
    )
