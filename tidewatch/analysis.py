"""Everything on one's own logs: lines in, the battery of results out, each a DataFrame that runs when it is asked for.

    lines = read_logs(spark, "/logs")                # or any DataFrame (server, file, line_no, line)
    found = analyze(incidents_from_lines(lines))     # {"top_stores": DataFrame, ...}
    found["outages"].show()
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.instants import with_instant
from tidewatch.functions.keys import store_key
from tidewatch.operators import features, greedy, learning, outages, outliers, parse, scoring, series, together
from tidewatch.operators.sticky import carry_forward
from tidewatch.sources import sinks
from tidewatch.sources.incidents import hour_of

WINDOWS = {"burst_s": 600, "burst_rows": 5, "cascade_s": 60, "cascade_stores": 5, "near_minutes": 5}


def incidents_from_lines(lines: DataFrame, dedup: str = "file") -> DataFrame:
    """The typed incidents of lines(server, file, line_no, line): those with a time and a category, severity or kind.

    dedup is "file" (equal lines of a file count once), "global" (of all files) or "none". Role group and machine are the
    last seen in the file, in headers too. Times are local, as written; their offsets aren't applied.
    """
    raw = parse.raw_lines(lines)
    t = F.col("text")
    own = parse.parsed(raw).select("file", "line_no", "fed_group", "machine")
    context = carry_forward(own, "file", "line_no", ["fed_group", "machine"])
    if dedup not in ("file", "global", "none"):
        raise ValueError(f"dedup is file, global or none, not {dedup}")
    unique = raw.where(~t.startswith(parse.HEADER)) if dedup == "none" else parse.first_of_each(raw, dedup)
    typed = parse.parsed(unique).drop("fed_group", "machine").withColumn("kind", F.when(F.col("store_id").isNotNull(), parse.connection_kind(t)))
    known = typed.where("ts is not null and coalesce(category, severity, kind) is not null").join(context, ["file", "line_no"], "left")
    sec = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("bigint")
    return known.select(
        F.xxhash64("file", "line_no").alias("event_id"),
        "server",
        "file",
        "line_no",
        "store_id",
        F.coalesce("fed_group", F.lit("Unknown")).alias("fed_group"),
        "machine",
        "ts",
        F.coalesce("category", "severity", "kind").alias("category"),
        "severity",
        "subtype",
        "kind",
        F.col("start_delay").alias("delay"),
        "ip",
        "port",
        "message",
        sec.alias("sec"),
    )


def incidents_from_health(health: DataFrame, zone: str = "UTC", event: str = "Connection failed") -> DataFrame:
    """Incidents of the health sheet's rows (source_entity, event_timestamp, health_event, machine) of the given event, each a disconnect."""
    rows = with_instant(health.where(F.col("health_event") == event).withColumn("_zone", F.lit(zone)), "event_timestamp", "_zone", "_us")
    sec = F.floor(F.col("_us") / 1_000_000).cast("bigint")
    store = store_key(F.col("source_entity"))
    return rows.where("_us is not null").select(
        F.xxhash64("source_entity", "event_timestamp", "machine").alias("event_id"), F.lit("Unknown").alias("server"), store.alias("store_id"), F.lit("Unknown").alias("fed_group"), "machine",
        F.timestamp_seconds(sec).cast("timestamp_ntz").alias("ts"), F.lit("connection_failed").alias("category"), F.lit("disconnect").alias("kind"), F.lit(None).cast("int").alias("delay"), F.lit(None).cast("string").alias("ip"), sec.alias("sec"),
    ).where("store_id is not null")


def store_table(incidents: DataFrame) -> DataFrame:
    """Per server and store: incidents, disconnects and outage lengths in seconds."""
    d = outages.pairs(incidents.where("store_id is not null"), ["server", "store_id"]).groupBy("server", "store_id").agg(
        F.count(F.lit(1)).alias("outages"),
        F.max("duration").alias("longest_s"),
        F.avg("duration").alias("mean_s"),
        F.percentile_approx("duration", 0.5).alias("median_s"),
    )
    per = incidents.where("store_id is not null").groupBy("server", "store_id").agg(
        F.max("fed_group").alias("fed_group"),
        F.count(F.lit(1)).alias("incidents"),
        F.count_if(F.col("kind") == "disconnect").alias("disconnects"),
    )
    return per.join(d, ["server", "store_id"], "left")


def page(
    stores: DataFrame,
    number: int = 1,
    size: int | None = 50,
    by: str = "disconnects",
    server: str | None = None,
    fed_group: str | None = None,
    least: int = 0,
    store: str | None = None,
    ascending: bool = False,
) -> DataFrame:
    """A page of store_table, greatest first unless ascending, by any of its columns, with the usual filters; without a size all rows."""
    rows = stores.where(F.col("disconnects") >= least)
    for column, value in (("server", server), ("fed_group", fed_group)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if store is not None:
        rows = rows.where(F.col("store_id").contains(store))
    if size is None:
        return rows
    order = F.asc_nulls_first(by) if ascending else F.desc_nulls_last(by)
    return rows.orderBy(order, "store_id", "server").offset((number - 1) * size).limit(size)


def analyze(incidents: DataFrame, windows: dict | None = None) -> dict[str, DataFrame]:
    """The battery over incidents, by name. Nothing runs until a result is used."""
    w = WINDOWS | (windows or {})
    known, down = incidents.where("store_id is not null"), incidents.where("kind = 'disconnect' and store_id is not null")
    hours = series.hourly(down, hour_of())
    eight = features.store_features8(known, short=60)
    cascades = greedy.cascades(down, "sec", w["cascade_s"], w["cascade_stores"])
    n, stores = F.count(F.lit(1)).alias("n"), F.countDistinct("store_id").alias("stores")
    minutes = down.withColumn("minute", F.floor(F.col("sec") / 60).cast("bigint"))
    subtypes = incidents.groupBy("subtype").agg(n).where("subtype is not null") if "subtype" in incidents.columns else incidents.groupBy("category").agg(n).limit(0)
    by_kind = [F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("disconnect", "reconnect")]
    machines = incidents.where("machine is not null").select("machine", "store_id")
    categories = incidents.groupBy("category").agg(n)
    return {
        "categories": categories,
        "hour_categories": incidents.groupBy(hour_of().alias("hour"), "category").agg(n),
        "subtypes": subtypes,
        "stores": store_table(incidents),
        "top_stores": page(store_table(incidents), size=20),
        "store_categories": known.groupBy("store_id", "category").agg(n),
        "machines": incidents.groupBy("machine").agg(n, stores),
        "machine_health": scoring.machine_health(machines),
        "root_causes": scoring.root_causes(categories, machines.groupBy("machine").agg(stores)),
        "ips": incidents.where("ip is not null").groupBy("ip").agg(n, stores).orderBy(F.desc("n"), "ip").limit(15),
        "fed_groups": down.groupBy("fed_group").agg(n, stores),
        "servers": incidents.rollup("server").agg(n),
        "outages": outages.pairs(known),
        "outage_buckets": outages.pairs(known).groupBy(outages.bucket(F.col("duration")).alias("bucket")).agg(n),
        "timeline": incidents.where("kind is not null").groupBy(hour_of().alias("hour")).agg(*by_kind, stores),
        "decomposition": series.decompose(hours),
        "forecast": series.forecast(hours),
        "change_points": series.change_points(hours),
        "periodicity": series.periodicity(hours),
        "trend": series.half_trend(hours),
        "hour_outliers": series.outliers(hours),
        "bursts": greedy.bursts(down, "store_id", "sec", w["burst_s"], w["burst_rows"]),
        "cascades": cascades,
        "propagation": greedy.propagation(cascades),
        "cascade_types": cascades.groupBy("dominant").agg(n),
        "co_failures": together.co_failures(minutes, "store_id", "minute", w["near_minutes"]),
        "features": eight,
        "zscores": outliers.zscores(eight, "store_id", features.EIGHT),
        "spread": outliers.spread_scores(eight, "store_id", features.EIGHT),
    }


def analyze_health(incidents: DataFrame, windows: dict | None = None) -> dict[str, DataFrame]:
    """The battery over incidents of health rows: features with bursts, machines, causes, clusters, series, patterns. Clusters fit a
    model, so they run jobs at once."""
    w = WINDOWS | (windows or {})
    down = incidents.where("kind = 'disconnect' and store_id is not null")
    bursts = greedy.bursts(down, "store_id", "sec", w["burst_s"], w["burst_rows"])
    counted = bursts.groupBy("store_id").agg(F.count(F.lit(1)).alias("bursts"))
    rows = features.health_features(down).join(counted, "store_id", "left").withColumn("bursts", F.coalesce("bursts", F.lit(0)))
    names = ["failures", "daily", "daily_var", "night_ratio", "weekend_ratio", "max_hourly", "bursts"]
    clustered = learning.clusters(rows.where("failures >= 5"), "store_id", names, per=20)
    machines = scoring.machine_health(down.where("machine is not null").select("machine", "store_id"), 100.0)
    hours = series.hourly(down, hour_of())
    minutes = down.withColumn("minute", F.floor(F.col("sec") / 60).cast("bigint"))
    return {
        "features": rows,
        "clusters": clustered.select("store_id", "cluster"),
        "cluster_profiles": learning.health_profiles(clustered, names),
        "machine_health": machines,
        "root_causes": scoring.health_root_causes(machines),
        "bursts": bursts,
        "co_failures": together.co_failures(minutes, "store_id", "minute", w["near_minutes"]),
        "decomposition": series.decompose(hours),
        "forecast": series.forecast(hours),
        "change_points": series.change_points(hours),
        "periodicity": series.periodicity(hours),
        "hour_outliers": series.outliers(hours),
    }


def learn(incidents: DataFrame) -> dict[str, DataFrame]:
    """The models over incidents, fitted at once: votes, weighted votes, their agreement, importance of features for the votes,
    recurring days and what followed days like the last one."""
    eight = features.store_features8(incidents.where("store_id is not null"), short=60)
    votes = outliers.ensemble(eight, "store_id", features.EIGHT)
    labelled = eight.join(votes.select("store_id", (F.col("label") == -1).cast("int").alias("label")), "store_id")
    hours = series.hourly(incidents.where("kind = 'disconnect' and store_id is not null"), hour_of())
    return {
        "anomalies": votes,
        "weighted": outliers.weighted_ensemble(eight, "store_id", features.EIGHT),
        "agreement": outliers.agreement(votes),
        "importance": learning.importance(labelled, features.EIGHT, "label"),
        "recurring_patterns": learning.recurring_patterns(series.windows(hours)),
        "analog_forecast": series.analog_forecast(hours),
    }


def report(found: dict[str, DataFrame], rows: int = 20) -> str:
    """The first rows of every result as text, one after the other."""
    return "\n\n".join(sinks.report(df, name.replace("_", " ").capitalize(), rows) for name, df in found.items())


def anomalies(incidents: DataFrame) -> DataFrame:
    """Votes of four methods per store; fits models, so it runs jobs at once."""
    return outliers.ensemble(features.store_features8(incidents.where("store_id is not null"), short=60), "store_id", features.EIGHT)
