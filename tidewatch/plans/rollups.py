"""Queries on incidents: rollups, outages, greedy windows, pairs, serving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import greedy, outages, together
from tidewatch.operators.parse import dominant
from tidewatch.operators.sticky import sliced_lag
from tidewatch.sources.incidents import INCIDENTS, hour_of, incidents

def _n():
    return F.count(F.lit(1)).alias("n")


def _down(spark, folder) -> DataFrame:
    return incidents(spark, folder).where("kind = 'disconnect'")


def top_stores_excl_max(spark, folder):
    """The 20 stores with most disconnects, the very first left out."""
    per = _down(spark, folder).groupBy("store_id", "fed_group").agg(F.count(F.lit(1)).alias("disconnects"))
    top = per.orderBy(F.desc("disconnects"), "store_id").limit(21)
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc("disconnects"), "store_id")) - 1
    return top.withColumn("rank", rank).where("rank > 0")


def category_totals_pct(spark, folder):
    per = incidents(spark, folder).groupBy("category").agg(_n())
    return per.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6))


def hour_category(spark, folder):
    return incidents(spark, folder).groupBy(hour_of().alias("hour"), "category").agg(_n())


def hour_of_day_peak(spark, folder):
    per = incidents(spark, folder).groupBy("category", F.hour("ts").cast("bigint").alias("hour_of_day")).agg(_n())
    return dominant(per, ["category"], "hour_of_day")


def store_summary(spark, folder):
    rows = incidents(spark, folder)
    by_category = rows.groupBy("store_id", "category").agg(_n())
    top = dominant(by_category, ["store_id"], "category").select("store_id", F.col("category").alias("dominant"), F.col("n").alias("dominant_n"))
    per = rows.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.countDistinct("category").alias("categories"),
        F.countDistinct("ip").alias("ips"),
        F.countDistinct(hour_of()).alias("hours"),
        F.sum(F.col("delay").cast("bigint")).alias("delays"),
    )
    return per.join(top, "store_id")


def machine_summary(spark, folder):
    return incidents(spark, folder).groupBy("machine").agg(
        _n(),
        F.countDistinct("store_id").alias("stores"),
        F.count_if(F.col("category") == "error").alias("errors"),
    )


def ip_summary_top15(spark, folder):
    per = incidents(spark, folder).groupBy("ip").agg(_n(), F.countDistinct("store_id").alias("stores"))
    return per.withColumn("per_store", F.round(F.col("n") / F.col("stores"), 6)).orderBy(F.desc("n"), "ip").limit(15)


def timeline_hourly(spark, folder):
    rows = incidents(spark, folder).where("kind is not null")
    return rows.groupBy(hour_of().alias("hour")).agg(
        F.count_if(F.col("kind") == "disconnect").alias("disconnects"),
        F.count_if(F.col("kind") == "reconnect").alias("reconnects"),
        F.countDistinct("store_id").alias("stores"),
    )


def timeline_daily(spark, folder):
    return timeline_hourly(spark, folder).groupBy(F.floor(F.col("hour") / 24).cast("bigint").alias("day")).agg(
        F.sum("disconnects").alias("disconnects"),
        F.sum("reconnects").alias("reconnects"),
        F.max("disconnects").alias("busiest_hour"),
    )


def elevated_hours(spark, folder):
    per = _down(spark, folder).groupBy(hour_of().alias("hour")).agg(_n())
    every = Window.partitionBy()
    return per.withColumn("_m", F.avg("n").over(every)).withColumn("_s", F.stddev_samp("n").over(every)).where("n > _m + 2 * _s or n > 50").select("hour", "n")


def day_hour_heat(spark, folder):
    per = _down(spark, folder).groupBy(F.weekday("ts").cast("bigint").alias("day_of_week"), F.hour("ts").cast("bigint").alias("hour_of_day")).agg(_n())
    share = F.col("n") / F.max("n").over(Window.partitionBy())
    return per.withColumn("heat", F.when(share > 0.75, "####").when(share > 0.5, "###").when(share > 0.25, "##").otherwise("#"))


def fed_group_rollup(spark, folder):
    per = _down(spark, folder).groupBy("fed_group").agg(F.countDistinct("store_id").alias("stores"), F.count(F.lit(1)).alias("disconnects"))
    return per.withColumn("per_store", F.round(F.col("disconnects") / F.col("stores"), 6))


def server_rollup_total(spark, folder):
    return incidents(spark, folder).rollup("server").agg(
        _n(),
        F.count_if(F.col("kind") == "disconnect").alias("disconnects"),
        F.countDistinct("store_id").alias("stores"),
    ).withColumn("server", F.coalesce("server", F.lit("TOTAL")))


def fed_by_server_pivot(spark, folder):
    """Disconnects by role group, a column for each server that there is; servers are few, their names are counted first."""
    counts = _down(spark, folder).groupBy("fed_group", "server").agg(_n())
    return pivoted(counts, "fed_group", "server", "n")


def pivoted(counts: DataFrame, row: str, column: str, n: str) -> DataFrame:
    """counts (row, column, n) with a column for each name in `column`, 0 where there is no row; rows without a name are left out.

    The names become columns, so they must be few: servers, not stores; Spark ends with an error beyond
    spark.sql.pivotMaxValues (10,000) of them.
    """
    wide = counts.where(F.col(column).isNotNull()).groupBy(row).pivot(column).agg(F.sum(n))
    return wide.select(row, *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in wide.columns if c != row])


def outage_pairs(spark, folder):
    return outages.pairs(incidents(spark, folder))


def outage_stats_store(spark, folder):
    d = outages.pairs(incidents(spark, folder))
    per = d.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("outages"),
        F.max("duration").alias("longest"),
        F.round(F.avg("duration"), 6).alias("mean"),
        F.round(F.percentile("duration", 0.5), 6).alias("median"),
    )
    return per.withColumn("longest_text", outages.duration_text(F.col("longest").cast("double")))


def outage_stats_overall(spark, folder):
    d = outages.pairs(incidents(spark, folder))
    return d.agg(
        F.count(F.lit(1)).alias("outages"),
        F.round(F.avg("duration"), 6).alias("mean"),
        F.round(F.stddev_pop("duration"), 6).alias("std"),
        F.min("duration").alias("shortest"),
        F.max("duration").alias("longest"),
        F.round(F.percentile("duration", 0.5), 6).alias("median"),
    )


def outage_buckets(spark, folder):
    d = outages.pairs(incidents(spark, folder)).groupBy(outages.bucket(F.col("duration")).alias("bucket")).agg(_n())
    names = spark.createDataFrame([(b,) for b, _ in (*outages.BUCKETS, (">4h", 0))], "bucket string")
    return names.join(d, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def interarrival_features(spark, folder):
    before = sliced_lag(incidents(spark, folder).select("store_id", "sec", "event_id"), ["store_id"], "sec", "event_id", {"before": "sec"}, 86_400)
    gap = before.withColumn("gap", F.col("sec") - F.col("before"))
    return gap.where("gap is not null").groupBy("store_id").agg(
        F.round(F.avg("gap"), 6).alias("mean_gap"),
        F.min("gap").alias("least_gap"),
        F.round(F.avg((F.col("gap") < 3600).cast("int")), 6).alias("burst_score"),
    )


def bursts(spark, folder):
    return greedy.bursts(_down(spark, folder), "store_id", "sec", 86_400, 3)


def cascades(spark, folder):
    return greedy.cascades(_down(spark, folder), "sec", 3_600, 5)


def cascade_propagation(spark, folder):
    return greedy.propagation(cascades(spark, folder))


def cofailure_pairs(spark, folder):
    """Pairs of the 100 stores with most disconnects, with minutes within a quarter of a day (events are sparse)."""
    down = _down(spark, folder)
    top = down.groupBy("store_id").agg(_n()).orderBy(F.desc("n"), "store_id").limit(100).select("store_id")
    return together.co_failures(
        down.join(F.broadcast(top), "store_id", "left_semi").withColumn("slot", F.floor(F.col("sec") / 3600).cast("bigint")),
        "store_id",
        "slot",
        2,
        0.3,
    )


def cofailure_pairs_all(spark, folder):
    """Pairs of all stores, with minutes within five."""
    return together.co_failures(_down(spark, folder).withColumn("minute", F.floor(F.col("sec") / 60).cast("bigint")), "store_id", "minute")


def _same_machine(pairs, spark, folder):
    machine = incidents(spark, folder).groupBy("store_id").agg(F.min("machine").alias("machine"))
    side = lambda s: machine.select(F.col("store_id").alias(s), F.col("machine").alias(f"machine_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "shared", (F.col("machine_a") == F.col("machine_b")).alias("same_machine"))


def cofailure_same_machine(spark, folder):
    return _same_machine(cofailure_pairs(spark, folder), spark, folder)


def cofailure_same_machine_all(spark, folder):
    return _same_machine(cofailure_pairs_all(spark, folder), spark, folder)


def _pages(spark, folder):
    return _down(spark, folder).groupBy("store_id", "server", "fed_group").agg(F.count(F.lit(1)).alias("disconnects"))


def stores_page(spark, folder, page: int = 2, size: int = 10, server: str = "MS10001", least: int = 2):
    """A page of the stores of a server with at least so many disconnects, and the number of pages."""
    rows = _pages(spark, folder).where((F.col("server") == server) & (F.col("disconnects") >= least))
    return rows.withColumn(
        "pages",
        F.ceil(F.count(F.lit(1)).over(Window.partitionBy()) / size).cast("bigint"),
    ).orderBy(F.desc("disconnects"), "store_id").offset((page - 1) * size).limit(size)


def store_lookup(spark, folder, store: str = "7"):
    return _pages(spark, folder).where(F.col("store_id") == F.lpad(F.lit(store), 5, "0"))


def export_rows(spark, folder):
    """Rows as an export writes them, with durations as texts."""
    d = outages.pairs(incidents(spark, folder), ["server", "store_id"]).groupBy("server", "store_id").agg(F.max("duration").alias("longest"))
    return _pages(spark, folder).join(d, ["server", "store_id"], "left").select(
        "store_id",
        "server",
        "fed_group",
        "disconnects",
        outages.duration_text(F.col("longest").cast("double")).alias("longest"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        top_stores_excl_max, category_totals_pct, hour_category, hour_of_day_peak, store_summary, machine_summary, ip_summary_top15, timeline_hourly, timeline_daily, elevated_hours, day_hour_heat, fed_group_rollup,
        server_rollup_total, fed_by_server_pivot, outage_pairs, outage_stats_store, outage_stats_overall, outage_buckets, interarrival_features, bursts, cascades, cascade_propagation, cofailure_pairs,
        cofailure_same_machine, cofailure_pairs_all, cofailure_same_machine_all, stores_page, store_lookup, export_rows,
    )
}

INC = f"inc AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM ({INCIDENTS.format(string='VARCHAR', events='events')})), down AS (SELECT * FROM inc WHERE kind = 'disconnect')"
_H = "CAST(floor(sec / 3600) AS BIGINT)"
_PAIRS = f"""{INC}, sq AS (SELECT store_id, sec, kind, lag(kind) OVER w AS k, lag(sec) OVER w AS down_at FROM inc WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY store_id ORDER BY sec, event_id)),
op AS (SELECT store_id, down_at AS down, sec AS up, sec - down_at AS duration FROM sq WHERE kind = 'reconnect' AND k = 'disconnect' AND sec > down_at AND sec - down_at < 604800)"""
_TEXT = "CASE WHEN {0} < 60 THEN printf('%.1fs', {0}) WHEN {0} < 3600 THEN printf('%.1fm', {0} / 60) ELSE printf('%.1fh', {0} / 3600) END"
_HOURLY = f"hourly AS (SELECT {_H} AS hour, count(*) FILTER (kind = 'disconnect') AS disconnects, count(*) FILTER (kind = 'reconnect') AS reconnects, count(DISTINCT store_id) AS stores FROM inc WHERE kind IS NOT NULL GROUP BY 1)"
_CASCADE = f"""{INC}, o AS (SELECT *, row_number() OVER (ORDER BY sec, event_id) AS i FROM down),
w AS (SELECT a.i, count(*) AS events, count(DISTINCT b.store_id) AS stores, max(b.i) AS j, max(b.sec) AS "end", a.sec AS start, count(DISTINCT b.machine) AS machines, mode(b.category) AS dominant FROM o a JOIN o b ON b.i >= a.i AND b.sec <= a.sec + 3600 GROUP BY a.i, a.sec),
g AS (SELECT min(i) AS i FROM w WHERE stores >= 5 UNION ALL SELECT (SELECT min(x.i) FROM w x WHERE x.stores >= 5 AND x.i > w.j) FROM g JOIN w USING (i) WHERE (SELECT min(x.i) FROM w x WHERE x.stores >= 5 AND x.i > w.j) IS NOT NULL),
cs AS (SELECT start, "end", stores, events, machines, dominant, machines = 1 AND stores > 10 AS is_server_wide FROM g JOIN w USING (i))"""
_CO = f"""{INC}, top AS (SELECT store_id FROM down GROUP BY 1 ORDER BY count(*) DESC, store_id LIMIT 100), m AS (SELECT DISTINCT store_id AS k, {_H} AS m FROM down WHERE store_id IN (SELECT store_id FROM top)),
nn AS (SELECT k, count(*) AS n FROM m GROUP BY 1), met AS (SELECT a.k AS a, b.k AS b, count(DISTINCT a.m) AS shared FROM m a JOIN m b ON a.k < b.k AND b.m BETWEEN a.m - 2 AND a.m + 2 GROUP BY 1, 2),
co AS (SELECT a, b, shared, round(shared / least(x.n, y.n), 6) AS overlap FROM met JOIN nn x ON x.k = a JOIN nn y ON y.k = b WHERE round(shared / least(x.n, y.n), 6) > 0.3)"""
_CO_ALL = f"""{INC}, m AS (SELECT DISTINCT store_id AS k, CAST(floor(sec / 60) AS BIGINT) AS m FROM down), nn AS (SELECT k, count(*) AS n FROM m GROUP BY 1),
near AS (SELECT k, m, unnest(range(m - 5, m + 6)) AS at FROM m), met AS (SELECT a.k AS a, b.k AS b, count(DISTINCT a.m) AS shared FROM near a JOIN m b ON a.at = b.m AND a.k < b.k GROUP BY 1, 2),
co AS (SELECT a, b, shared, round(shared / least(x.n, y.n), 6) AS overlap FROM met JOIN nn x ON x.k = a JOIN nn y ON y.k = b WHERE round(shared / least(x.n, y.n), 6) > 0.3)"""
_MACHINES = "mc AS (SELECT store_id, min(machine) AS machine FROM inc GROUP BY 1) SELECT a, b, shared, x.machine = y.machine AS same_machine FROM co JOIN mc x ON x.store_id = a JOIN mc y ON y.store_id = b"
_PER = "pg AS (SELECT store_id, server, fed_group, count(*) AS disconnects FROM down GROUP BY 1, 2, 3)"

SQL = {
    "top_stores_excl_max": f"WITH {INC}, c AS (SELECT store_id, fed_group, count(*) AS disconnects FROM down GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (ORDER BY disconnects DESC, store_id) - 1 AS INTEGER) AS rank FROM c QUALIFY rank BETWEEN 1 AND 20",
    "category_totals_pct": f"WITH {INC} SELECT category, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM inc GROUP BY 1",
    "hour_category": f"WITH {INC} SELECT {_H} AS hour, category, count(*) AS n FROM inc GROUP BY 1, 2",
    "hour_of_day_peak": f"WITH {INC} SELECT category, hour(ts) AS hour_of_day, count(*) AS n FROM inc GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, hour_of_day) = 1",
    "store_summary": f"""WITH {INC}, t AS (SELECT store_id, category AS dominant, count(*) AS dominant_n FROM inc GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY dominant_n DESC, dominant) = 1)
SELECT store_id, count(*) AS total, count(DISTINCT category) AS categories, count(DISTINCT ip) AS ips, count(DISTINCT {_H}) AS hours, CAST(sum(delay) AS BIGINT) AS delays, any_value(dominant) AS dominant, any_value(dominant_n) AS dominant_n FROM inc JOIN t USING (store_id) GROUP BY 1""",
    "machine_summary": f"WITH {INC} SELECT machine, count(*) AS n, count(DISTINCT store_id) AS stores, count(*) FILTER (category = 'error') AS errors FROM inc GROUP BY 1",
    "ip_summary_top15": f"WITH {INC} SELECT ip, count(*) AS n, count(DISTINCT store_id) AS stores, round(count(*) / count(DISTINCT store_id), 6) AS per_store FROM inc GROUP BY 1 ORDER BY n DESC, ip LIMIT 15",
    "timeline_hourly": f"WITH {INC}, {_HOURLY} SELECT * FROM hourly",
    "timeline_daily": f"WITH {INC}, {_HOURLY} SELECT CAST(floor(hour / 24) AS BIGINT) AS day, CAST(sum(disconnects) AS BIGINT) AS disconnects, CAST(sum(reconnects) AS BIGINT) AS reconnects, max(disconnects) AS busiest_hour FROM hourly GROUP BY 1",
    "elevated_hours": f"WITH {INC}, c AS (SELECT {_H} AS hour, count(*) AS n FROM down GROUP BY 1) SELECT hour, n FROM c WHERE n > (SELECT avg(n) + 2 * stddev_samp(n) FROM c) OR n > 50",
    "day_hour_heat": f"""WITH {INC}, c AS (SELECT isodow(ts) - 1 AS day_of_week, hour(ts) AS hour_of_day, count(*) AS n FROM down GROUP BY 1, 2)
SELECT *, CASE WHEN n / max(n) OVER () > 0.75 THEN '####' WHEN n / max(n) OVER () > 0.5 THEN '###' WHEN n / max(n) OVER () > 0.25 THEN '##' ELSE '#' END AS heat FROM c""",
    "fed_group_rollup": f"WITH {INC} SELECT fed_group, count(DISTINCT store_id) AS stores, count(*) AS disconnects, round(count(*) / count(DISTINCT store_id), 6) AS per_store FROM down GROUP BY 1",
    "server_rollup_total": f"WITH {INC} SELECT coalesce(server, 'TOTAL') AS server, count(*) AS n, count(*) FILTER (kind = 'disconnect') AS disconnects, count(DISTINCT store_id) AS stores FROM inc GROUP BY ROLLUP (server)",
    "fed_by_server_pivot": f"WITH {INC} SELECT fed_group, " + ", ".join(f"count(*) FILTER (server = 'MS{10000 + k}') AS MS{10000 + k}" for k in range(4)) + " FROM down GROUP BY 1",
    "outage_pairs": f"WITH {_PAIRS} SELECT * FROM op",
    "outage_stats_store": f"WITH {_PAIRS} SELECT store_id, count(*) AS outages, max(duration) AS longest, round(avg(duration), 6) AS mean, round(quantile_cont(duration, 0.5), 6) AS median, {_TEXT.format('CAST(max(duration) AS DOUBLE)')} AS longest_text FROM op GROUP BY 1",
    "outage_stats_overall": f"WITH {_PAIRS} SELECT count(*) AS outages, round(avg(duration), 6) AS mean, round(stddev_pop(duration), 6) AS std, min(duration) AS shortest, max(duration) AS longest, round(quantile_cont(duration, 0.5), 6) AS median FROM op",
    "outage_buckets": f"""WITH {_PAIRS}, b(bucket, low, high) AS (VALUES ('<1m', 0, 60), ('1-5m', 60, 300), ('5-15m', 300, 900), ('15-60m', 900, 3600), ('1-4h', 3600, 14400), ('>4h', 14400, 604800))
SELECT bucket, count(duration) AS n FROM b LEFT JOIN op ON duration >= low AND duration < high GROUP BY 1""",
    "interarrival_features": f"WITH {INC}, g AS (SELECT store_id, sec - lag(sec) OVER (PARTITION BY store_id ORDER BY sec, event_id) AS gap FROM inc) SELECT store_id, round(avg(gap), 6) AS mean_gap, min(gap) AS least_gap, round(avg(CASE WHEN gap < 3600 THEN 1 ELSE 0 END), 6) AS burst_score FROM g WHERE gap IS NOT NULL GROUP BY 1",
    "bursts": f"""WITH RECURSIVE {INC}, o AS (SELECT store_id, sec, row_number() OVER (PARTITION BY store_id ORDER BY sec) AS i FROM down), w AS (SELECT a.store_id, a.i, a.sec AS start, max(b.sec) AS "end", max(b.i) AS j, count(*) AS count FROM o a JOIN o b ON a.store_id = b.store_id AND b.i >= a.i AND b.sec <= a.sec + 86400 GROUP BY 1, 2, 3),
q AS (SELECT * FROM w WHERE count >= 3), g AS (SELECT store_id, min(i) AS i FROM q GROUP BY 1 UNION ALL SELECT store_id, nx FROM (SELECT g.store_id, (SELECT min(x.i) FROM q x WHERE x.store_id = g.store_id AND x.i > q.j) AS nx FROM g JOIN q ON q.store_id = g.store_id AND q.i = g.i) WHERE nx IS NOT NULL)
SELECT store_id, start, "end", count FROM g JOIN q USING (store_id, i)""",
    "cascades": f"WITH RECURSIVE {_CASCADE} SELECT * FROM cs",
    "cascade_propagation": f"WITH RECURSIVE {_CASCADE} SELECT count(*) AS cascades, round(avg(stores), 6) AS avg_stores, max(stores) AS max_stores, count(*) FILTER (is_server_wide) AS server_wide FROM cs",
    "cofailure_pairs": f"WITH {_CO} SELECT * FROM co",
    "cofailure_same_machine": f"WITH {_CO}, mc AS (SELECT store_id, min(machine) AS machine FROM inc GROUP BY 1) SELECT a, b, shared, x.machine = y.machine AS same_machine FROM co JOIN mc x ON x.store_id = a JOIN mc y ON y.store_id = b",
    "cofailure_pairs_all": f"WITH {_CO_ALL} SELECT * FROM co",
    "cofailure_same_machine_all": f"WITH {_CO_ALL}, {_MACHINES}",
    "stores_page": f"WITH {INC}, {_PER}, f AS (SELECT * FROM pg WHERE server = 'MS10001' AND disconnects >= 2) SELECT *, CAST(ceil(count(*) OVER () / 10.0) AS BIGINT) AS pages FROM f ORDER BY disconnects DESC, store_id LIMIT 10 OFFSET 10",
    "store_lookup": f"WITH {INC}, {_PER} SELECT * FROM pg WHERE store_id = '00007'",
    "export_rows": f"WITH {_PAIRS}, {_PER}, l AS (SELECT store_id, CAST(max(duration) AS DOUBLE) AS d FROM op GROUP BY 1) SELECT store_id, server, fed_group, disconnects, {_TEXT.format('d')} AS longest FROM pg LEFT JOIN l USING (store_id)",
}
