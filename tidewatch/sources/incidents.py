"""The incidents view: typed incidents of sites from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.tables import table

#: One text for Spark and DuckDB alike.
INCIDENTS = """SELECT event_id, lpad(CAST(user_id AS {string}), 5, '0') AS store_id, concat('MS', CAST(10000 + user_id % 4 AS {string})) AS server,
concat('RoleGroup', CAST(user_id % 10 AS {string})) AS fed_group, concat('M', CAST(user_id % 7 AS {string})) AS machine, ts, event_type AS category,
CASE event_type WHEN 'error' THEN 'disconnect' WHEN 'signup' THEN 'reconnect' END AS kind, CAST(floor(value) AS INT) AS delay,
concat('10.0.', CAST(user_id % 8 AS {string}), '.', CAST(user_id % 32 AS {string})) AS ip FROM {events}"""


def incidents(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    text = lambda c: c.cast("string")
    u = F.col("user_id")
    return e.select(
        "event_id", F.lpad(text(u), 5, "0").alias("store_id"), F.concat(F.lit("MS"), text(10000 + u % 4)).alias("server"), F.concat(F.lit("RoleGroup"), text(u % 10)).alias("fed_group"),
        F.concat(F.lit("M"), text(u % 7)).alias("machine"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("category"),
        F.when(F.col("event_type") == "error", "disconnect").when(F.col("event_type") == "signup", "reconnect").alias("kind"), F.floor("value").cast("int").alias("delay"),
        F.concat(F.lit("10.0."), text(u % 8), F.lit("."), text(u % 32)).alias("ip"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp"))).cast("bigint").alias("sec"),
    )


def hour_of(column: str = "sec"):
    """Hours since 1970 of seconds since 1970."""
    return F.floor(F.col(column) / 3600).cast("bigint")
