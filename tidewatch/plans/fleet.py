"""Queries on the fleet: risks, causes, machines, breakdowns of stores, top lists, variants of the line rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.keys import store_key
from tidewatch.operators import features, greedy, learning, outages, parse, scoring, series
from tidewatch.operators.eager_aggregate import once
from tidewatch.plans import lines, models, rollups
from tidewatch.sources.incidents import hour_of, incidents
from tidewatch.sources.tables import table

SHORT_DELAY_S = 60
SIX = ["tls_handshake_error", "connection_timeout", "connection_refused", "host_unreachable", "socket_exception", "proxy_disconnect"]


def _n():
    return F.count(F.lit(1)).alias("n")


def _down(spark, folder) -> DataFrame:
    return incidents(spark, folder).where("kind = 'disconnect'")


# risks, causes, machines


def failure_probability(spark, folder):
    """Of stores with three incidents or more: errors, spread of the hours, kinds, bursts and trend, as a probability."""
    rows = incidents(spark, folder)
    counted = rollups.bursts(spark, folder).groupBy("store_id").agg(F.count(F.lit(1)).alias("burst_count"))
    f = features.store_features8(rows).select(
        "store_id",
        F.col("total").alias("recent_errors"),
        F.col("variance").alias("error_variance"),
        F.col("categories").alias("error_types"),
    )
    f = f.join(series.trend_by(rows, ["store_id"], hour_of()), "store_id").join(counted, "store_id", "left")
    return scoring.failure_probability(f).select("store_id", F.round("probability", 6).alias("probability"))


def high_risk_stores(spark, folder):
    """The 15 riskiest of stores with ten incidents or more: quick reconnects as bursts, rising if the last hour is above the mean."""
    rows = incidents(spark, folder)
    hours = rows.groupBy("store_id", hour_of().alias("hour")).agg(F.count(F.lit(1)).alias("x"))
    spread = hours.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("hours"),
        F.var_pop("x").alias("error_variance"),
        F.avg("x").alias("mean"),
        F.max_by("x", "hour").alias("last"),
    )
    per = rows.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("recent_errors"), F.countDistinct("category").alias("error_types"), F.count_if(F.col("delay") < SHORT_DELAY_S).alias("burst_count")
    )
    rising = (F.col("hours") > 2) & (F.col("last") > F.col("mean"))
    f = per.where("recent_errors >= 10").join(spread, "store_id").withColumn("trend", F.when(rising, "increasing").otherwise("stable"))
    found = scoring.failure_probability(f).select("store_id", F.round("probability", 6).alias("probability"), "recent_errors")
    return found.where("probability > 0.6").orderBy(F.desc("probability"), "store_id").limit(15)


def machine_health(spark, folder):
    return scoring.machine_health(incidents(spark, folder).where("category = 'error'"))


def health_machines(spark, folder):
    """As machine_health by the rules for health rows, a hundred failures costing a point."""
    return scoring.machine_health(_down(spark, folder), 100.0)


def health_root_causes(spark, folder):
    return scoring.health_root_causes(health_machines(spark, folder))


def _conn(spark, folder, *columns: str) -> DataFrame:
    """Disconnects of conn_events, each event_id once, with store and the columns."""
    rows = table(spark, folder, "conn_events").where("kind = 'disconnect'")
    return once(rows.select("event_id", store_key(F.col("store_id")).alias("store"), *columns), "event_id", "store", *columns)


def root_cause_posterior(spark, folder):
    rows = _conn(spark, folder, "machine", "error_category")
    errors = rows.groupBy(F.col("error_category").alias("category")).agg(_n())
    return scoring.root_causes(errors, rows.where("machine is not null").groupBy("machine").agg(F.countDistinct("store").alias("stores")))


# breakdowns: the maps and sets of a store or machine, as rows


def store_category_counts(spark, folder):
    return incidents(spark, folder).groupBy("store_id", "category").agg(_n())


def store_hour_counts(spark, folder):
    return incidents(spark, folder).groupBy("store_id", hour_of().alias("hour")).agg(_n())


def store_delays(spark, folder):
    """How often each store waited how long to reconnect; counts, as a store's delays are without bound."""
    return incidents(spark, folder).where("delay is not null").groupBy("store_id", "delay").agg(_n())


def store_places(spark, folder):
    """The addresses, role groups and machines of each store, sorted; a row a store, as each is of few."""
    text = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return incidents(spark, folder).groupBy("store_id").agg(text("ip").alias("ips"), text("fed_group").alias("fed_groups"), text("machine").alias("machines"))


def machine_categories(spark, folder):
    return incidents(spark, folder).groupBy("machine", "category").agg(_n(), F.countDistinct("store_id").alias("stores"))


def store_subtype_counts(spark, folder):
    return lines._events(spark, folder).where("subtype is not null and store_id is not null").groupBy("store_id", "subtype").agg(_n())


def category_labels(spark, folder):
    """Categories as words, with their number."""
    known = _conn(spark, folder, "error_category").where("error_category is not null").groupBy("error_category").agg(_n())
    return known.select("error_category", F.initcap(F.replace("error_category", F.lit("_"), F.lit(" "))).alias("label"), "n")


# top lists


def peak_hours_top10(spark, folder):
    """The ten hours with most incidents, with the most frequent category of each."""
    counts = incidents(spark, folder).groupBy(hour_of().alias("hour"), "category").agg(_n())
    top = counts.groupBy("hour").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "hour").limit(10)
    return parse.dominant(counts.join(top, "hour"), ["hour"], "category").select("hour", "total", F.col("category").alias("dominant"))


def longest_outages_top10(spark, folder):
    d = outages.pairs(incidents(spark, folder)).groupBy("store_id").agg(F.max("duration").alias("longest"), _n())
    return d.orderBy(F.desc("longest"), "store_id").limit(10)


def cascades_top10(spark, folder):
    return rollups.cascades(spark, folder).orderBy(F.desc("stores"), "start").limit(10)


def cascade_types(spark, folder):
    """How many cascades each category was the most frequent of."""
    return rollups.cascades(spark, folder).groupBy("dominant").agg(_n())


def bursts_top50(spark, folder):
    return rollups.bursts(spark, folder).orderBy(F.desc("count"), "store_id", "start").limit(50)


def cofailures_top50(spark, folder):
    return rollups.cofailure_pairs_all(spark, folder).orderBy(F.desc("overlap"), F.desc("shared"), "a", "b").limit(50)


def elevated_hours_v3(spark, folder):
    """The 15 busiest of the hours with over twice the mean of disconnects, or over 100."""
    per = _down(spark, folder).groupBy(hour_of().alias("hour")).agg(F.count(F.lit(1)).alias("disconnects"), F.countDistinct("store_id").alias("stores"))
    mean = per.agg(F.avg("disconnects").alias("m"))
    high = per.withColumn("_m", mean.scalar()).where("disconnects > 2 * _m or disconnects > 100").drop("_m")
    return high.orderBy(F.desc("disconnects"), "hour").limit(15)


def recommendations_sorted(spark, folder, priority: int | None = None):
    """Recommendations, each rec_id once, the most urgent first and of these the most certain; of one priority, if given."""
    cols = ["priority", "confidence", "category", "target"]
    rows = once(table(spark, folder, "recommendations").select("rec_id", *cols), "rec_id", *cols)
    rows = rows if priority is None else rows.where(F.col("priority") == priority)
    order = Window.partitionBy("priority").orderBy(F.desc_nulls_last("confidence"), "rec_id")
    return rows.withColumn("place", F.row_number().over(order)).where("place <= 50").orderBy("priority", "place")


# clusters of stores by their errors


def _clustered(spark, folder) -> DataFrame:
    rows = _conn(spark, folder, "error_category", "message").where("store is not null and error_category is not null")
    ip = F.nullif(F.regexp_extract("message", r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}):\d+", 1), F.lit(""))
    shares = [F.avg((F.col("error_category") == c).cast("int")).alias(c) for c in SIX]
    f = rows.groupBy("store").agg(F.count(F.lit(1)).alias("total"), F.countDistinct(ip).alias("ips"), *shares).where("total >= 5")
    return learning.clusters(f, "store", [*SIX, "total", "ips"])


def error_clusters(spark, folder):
    return _clustered(spark, folder).select("store", "cluster", "total")


def error_cluster_profiles(spark, folder):
    """Of each cluster the stores, the errors and the most frequent category over all its stores' errors."""
    c = _clustered(spark, folder).select("store", "cluster")
    rows = _conn(spark, folder, "error_category").where("store is not null and error_category is not null").groupBy("store", "error_category").agg(_n())
    counts = c.join(rows, "store").groupBy("cluster", "error_category").agg(F.sum("n").alias("n"))
    top = parse.dominant(counts, ["cluster"], "error_category").select("cluster", F.col("error_category").alias("dominant"))
    sizes = c.groupBy("cluster").agg(F.count(F.lit(1)).alias("stores"))
    return sizes.join(counts.groupBy("cluster").agg(F.sum("n").alias("errors")), "cluster").join(top, "cluster")


def error_cluster_top5(spark, folder):
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("total"), "store"))
    return error_clusters(spark, folder).withColumn("rank", rank).where("rank <= 5")


# variants of the rules on lines


def _raw(spark, folder) -> DataFrame:
    return parse.first_of_each(lines._raw(spark, folder), "file")


def error_types_by_variant(spark, folder):
    t = F.col("text")
    rows = _raw(spark, folder).select(
        F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), parse.error_type(t, v).alias("error_type")) for v in ("v2", "v3")])).alias("x")
    )
    return rows.select("x.*").where("error_type is not null").groupBy("variant", "error_type").agg(_n())


def error_families_by_variant(spark, folder):
    """Families of errors by the three sets of rules, each of the lines that its own rules call errors."""
    t = F.col("text")
    flags = parse.flags_v1(t)
    is_error = {
        "v1": flags["error"] | flags["warning"] | flags["exception"] | flags["fatal"],
        "v2": parse.error_type(t, "v2").isNotNull(),
        "v3": parse.error_type(t).isNotNull(),
    }
    found = F.array(*[F.struct(F.lit(v).alias("variant"), F.when(is_error[v], parse.error_family(t, v)).alias("family")) for v in is_error])
    return _raw(spark, folder).select(F.explode(found).alias("x")).select("x.*").where("family is not null").groupBy("variant", "family").agg(_n())


def line_endpoints(spark, folder):
    """All addresses with their ports in the lines of each store."""
    t = F.col("text")
    rows = _raw(spark, folder).select(parse.store(t).alias("store_id"), F.explode(parse.endpoints(t)).alias("endpoint"))
    return rows.where("store_id is not null").groupBy("store_id", "endpoint").agg(_n())


def store_line_samples(spark, folder):
    """The first five error lines of each store, 200 characters of each."""
    rows = lines._events(spark, folder).where("store_id is not null and category is not null")
    rank = F.row_number().over(Window.partitionBy("store_id").orderBy("file", "line_no"))
    return rows.withColumn("rank", rank).where("rank <= 5").select("store_id", "rank", "file", "line_no", F.left("text", F.lit(200)).alias("line"))


def error_type_samples(spark, folder):
    """The first hundred lines of each type of error, 500 characters of each. Ranked within files first: no type is one task's."""
    rows = _raw(spark, folder).withColumn("error_type", parse.error_type(F.col("text"))).where("error_type is not null")
    within = F.row_number().over(Window.partitionBy("error_type", "file").orderBy("line_no"))
    some = rows.withColumn("_r", within).where("_r <= 100")
    rank = F.row_number().over(Window.partitionBy("error_type").orderBy("file", "line_no"))
    return some.withColumn("rank", rank).where("rank <= 100").select("error_type", "rank", "file", "line_no", F.left("text", F.lit(500)).alias("line"))


QUERIES = {
    f.__name__: f
    for f in (
        failure_probability, high_risk_stores, machine_health, health_machines, health_root_causes, root_cause_posterior, store_category_counts, store_hour_counts, store_delays, store_places,
        machine_categories, store_subtype_counts, category_labels, peak_hours_top10, longest_outages_top10, cascades_top10, cascade_types, bursts_top50, cofailures_top50, elevated_hours_v3,
        recommendations_sorted, error_clusters, error_cluster_profiles, error_cluster_top5, error_types_by_variant, error_families_by_variant, line_endpoints, store_line_samples, error_type_samples,
    )
}

INC = rollups.INC
_H = "CAST(floor(sec / 3600) AS BIGINT)"
_HH = f"hh AS (SELECT store_id, {_H} AS hour, count(*) AS x FROM inc GROUP BY 1, 2)"
_SIGMOID = "round(1 / (1 + exp(-5 * (({0}) / 100 - 0.5))), 6)"
_MACHINE = """s AS (SELECT *, round(greatest(0.0, 100 - least(100.0, 2 * errors / stores + errors / {per})), 6) AS score FROM m)
SELECT *, CASE WHEN score < 30 THEN 'CRITICAL' WHEN score < 50 THEN 'WARNING' WHEN score < 70 THEN 'FAIR' ELSE 'GOOD' END AS band FROM s"""
_HEALTH = f"WITH {INC}, m AS (SELECT machine, count(*) AS errors, count(DISTINCT store_id) AS stores FROM down GROUP BY 1), {_MACHINE.format(per=100)}"
_NUMBER = "lpad(nullif(regexp_extract(store_id, '(?:^|[^0-9])([0-9]{4,5})(?:$|[^0-9])', 1), ''), 5, '0')"
_D = f"d AS (SELECT event_id, min({_NUMBER}) AS store, min(machine) AS machine, min(error_category) AS c FROM conn_events WHERE kind = 'disconnect' GROUP BY 1)"
_TYPE3 = "CASE WHEN contains(t, 'Exception') THEN 'exception' WHEN contains(t, '(Warning)') THEN 'warning' WHEN contains(t, '(Fatal)') THEN 'fatal' WHEN contains(t, '(Error)') THEN 'error' END"
_TYPE2 = "CASE WHEN contains(t, '(Warning)') THEN 'warning' WHEN contains(t, '(Fatal)') THEN 'fatal' WHEN contains(t, '(Error)') THEN 'error' WHEN contains(t, 'Exception') THEN 'exception' END"
_L = "contains(lower(t), '{0}')"


def _has(*words: str) -> str:
    return "(" + " OR ".join(_L.format(w) for w in words) + ")"


_FAMILY1 = f"""CASE WHEN {_has('connection')} THEN CASE WHEN {_has('timeout', 'timed out')} THEN 'connection_timeout' WHEN {_has('refused')} THEN 'connection_refused' WHEN {_has('failed')} THEN 'connection_failed' ELSE 'connection_issue' END
WHEN {_has('exception')} THEN CASE WHEN {_has('socket')} THEN 'socket_exception' WHEN {_has('tls', 'ssl')} THEN 'tls_ssl_exception' ELSE 'other_exception' END END"""
_FAMILY2 = f"CASE WHEN {_has('timeout', 'timed out')} THEN 'timeout' WHEN {_has('connection attempt failed')} THEN 'conn_failed' WHEN {_has('socket')} THEN 'socket' WHEN {_has('tls', 'ssl')} THEN 'tls_ssl' WHEN {_has('refused')} THEN 'refused' END"
_FAMILY3 = f"CASE WHEN {_has('timeout')} THEN 'timeout' WHEN {_has('connection attempt failed')} THEN 'conn_failed' WHEN {_has('socket')} THEN 'socket' WHEN {_has('tls', 'ssl')} THEN 'tls_ssl' END"
_ERROR1 = "regexp_matches(t, '\\([Ee]rror\\)|\\([Ww]arning\\)|[Ee]xception|\\([Ff]atal\\)|[Ff]atal')"

SQL = {
    "failure_probability": f"""WITH {models._F8}, {_HH}, pl AS (SELECT store_id, x, row_number() OVER (PARTITION BY store_id ORDER BY hour) - 1 AS i, count(*) OVER (PARTITION BY store_id) // 2 AS half FROM hh),
tr AS (SELECT store_id, avg(x) FILTER (i < half) AS a, avg(x) FILTER (i >= half) AS b FROM pl GROUP BY 1), bc AS (SELECT store_id, count(*) AS n FROM ({rollups.SQL['bursts']}) GROUP BY 1)
SELECT store_id, {_SIGMOID.format("least(total / 100, 1) * 30 + least(variance / 50, 1) * 20 + least(categories / 5, 1) * 15 + CASE WHEN b > a * 1.2 THEN 20 WHEN b < a * 0.8 THEN 0 ELSE 5 END + least(coalesce(n, 0) / 10, 1) * 15")} AS probability
FROM f JOIN tr USING (store_id) LEFT JOIN bc USING (store_id)""",
    "high_risk_stores": f"""WITH {INC}, {_HH}, sp AS (SELECT store_id, count(*) AS hours, var_pop(x) AS v, avg(x) AS mean, arg_max(x, hour) AS last FROM hh GROUP BY 1),
pr AS (SELECT store_id, count(*) AS recent_errors, count(DISTINCT category) AS k, count(*) FILTER (delay < 60) AS q FROM inc GROUP BY 1 HAVING count(*) >= 10),
r AS (SELECT store_id, {_SIGMOID.format("least(recent_errors / 100, 1) * 30 + least(v / 50, 1) * 20 + least(k / 5, 1) * 15 + CASE WHEN hours > 2 AND last > mean THEN 20 ELSE 5 END + least(q / 10, 1) * 15")} AS probability, recent_errors FROM pr JOIN sp USING (store_id))
SELECT * FROM r WHERE probability > 0.6 ORDER BY probability DESC, store_id LIMIT 15""",
    "machine_health": f"WITH {INC}, m AS (SELECT machine, count(*) AS errors, count(DISTINCT store_id) AS stores FROM inc WHERE category = 'error' GROUP BY 1), {_MACHINE.format(per=1000)}",
    "health_machines": _HEALTH,
    "health_root_causes": f"""WITH o AS (SELECT CASE WHEN (max(errors) - min(errors)) / max(errors) > 0.5 THEN 1.5 ELSE 1 END AS k FROM ({_HEALTH})),
p AS (SELECT cause, CASE WHEN cause = 'server_overload' THEN prior * k ELSE prior END AS v FROM o, (VALUES ('network_latency', 0.3::DOUBLE), ('server_overload', 0.25), ('store_hardware', 0.2), ('maintenance_window', 0.15), ('external_dependency', 0.1)) x(cause, prior)),
q AS (SELECT cause, round(v / sum(v) OVER (), 6) AS probability FROM p) SELECT * FROM q WHERE probability > 0.1""",
    "root_cause_posterior": f"""WITH {_D}, o AS (SELECT count(c) AS t, count(*) FILTER (c IN ('connection_timeout', 'host_unreachable', 'socket_exception')) / count(c) AS n, count(*) FILTER (c = 'connection_refused') / count(c) AS h,
count(*) FILTER (c IN ('tls_handshake_error', 'certificate_error')) / count(c) AS s, count(*) FILTER (c = 'connection_timeout') AS e1, count(*) FILTER (c = 'connection_refused') AS e2, count(*) FILTER (c = 'tls_handshake_error') AS e3 FROM d),
mm AS (SELECT coalesce(max(k), 0) AS most FROM (SELECT machine, count(DISTINCT store) AS k FROM d WHERE machine IS NOT NULL GROUP BY 1)),
p AS (SELECT 'network_issue' AS cause, 0.3::DOUBLE * (1 + 3 * n) AS v, format('High timeout/socket errors ({{:,}})', e1) AS evidence FROM o UNION ALL SELECT 'store_hardware', 0.25::DOUBLE * (1 + 3 * h), format('Connection refused errors ({{:,}})', e2) FROM o
UNION ALL SELECT 'certificate_expiry', 0.1::DOUBLE * (1 + 5 * s), format('TLS errors ({{:,}})', e3) FROM o UNION ALL SELECT 'server_overload', 0.2::DOUBLE * (CASE WHEN most > 200 THEN 2 ELSE 1 END), 'High store density on federation servers' FROM mm),
q AS (SELECT cause, round(v / sum(v) OVER (), 6) AS probability, evidence FROM p) SELECT * FROM q WHERE probability > 0.1 AND (SELECT t FROM o) > 0""",
    "store_category_counts": f"WITH {INC} SELECT store_id, category, count(*) AS n FROM inc GROUP BY 1, 2",
    "store_hour_counts": f"WITH {INC}, {_HH} SELECT store_id, hour, x AS n FROM hh",
    "store_delays": f"WITH {INC} SELECT store_id, delay, count(*) AS n FROM inc WHERE delay IS NOT NULL GROUP BY 1, 2",
    "store_places": f"WITH {INC} SELECT store_id, array_to_string(list_sort(list_distinct(list(ip))), ',') AS ips, array_to_string(list_sort(list_distinct(list(fed_group))), ',') AS fed_groups, array_to_string(list_sort(list_distinct(list(machine))), ',') AS machines FROM inc GROUP BY 1",
    "machine_categories": f"WITH {INC} SELECT machine, category, count(*) AS n, count(DISTINCT store_id) AS stores FROM inc GROUP BY 1, 2",
    "store_subtype_counts": f"WITH {lines._PARSED} SELECT store_id, subtype, count(*) AS n FROM e WHERE subtype IS NOT NULL AND store_id IS NOT NULL GROUP BY 1, 2",
    "category_labels": f"WITH {_D} SELECT c AS error_category, list_reduce(list_transform(string_split(c, '_'), lambda w: upper(w[1]) || w[2:]), lambda a, b: a || ' ' || b) AS label, count(*) AS n FROM d WHERE c IS NOT NULL GROUP BY 1",
    "peak_hours_top10": f"""WITH {INC}, c AS (SELECT {_H} AS hour, category, count(*) AS n FROM inc GROUP BY 1, 2), t AS (SELECT hour, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY 1 ORDER BY total DESC, hour LIMIT 10)
SELECT hour, total, category AS dominant FROM c JOIN t USING (hour) QUALIFY row_number() OVER (PARTITION BY hour ORDER BY n DESC, category) = 1""",
    "longest_outages_top10": f"WITH {rollups._PAIRS} SELECT store_id, max(duration) AS longest, count(*) AS n FROM op GROUP BY 1 ORDER BY longest DESC, store_id LIMIT 10",
    "cascades_top10": f"SELECT * FROM ({rollups.SQL['cascades']}) ORDER BY stores DESC, start LIMIT 10",
    "cascade_types": f"SELECT dominant, count(*) AS n FROM ({rollups.SQL['cascades']}) GROUP BY 1",
    "bursts_top50": f"SELECT * FROM ({rollups.SQL['bursts']}) ORDER BY count DESC, store_id, start LIMIT 50",
    "cofailures_top50": f"SELECT * FROM ({rollups.SQL['cofailure_pairs_all']}) ORDER BY overlap DESC, shared DESC, a, b LIMIT 50",
    "elevated_hours_v3": f"WITH {INC}, c AS (SELECT {_H} AS hour, count(*) AS disconnects, count(DISTINCT store_id) AS stores FROM down GROUP BY 1) SELECT * FROM c WHERE disconnects > 2 * (SELECT avg(disconnects) FROM c) OR disconnects > 100 ORDER BY disconnects DESC, hour LIMIT 15",
    "recommendations_sorted": """WITH r AS (SELECT DISTINCT ON (rec_id) rec_id, priority, confidence, category, target FROM recommendations ORDER BY rec_id, priority NULLS FIRST, confidence NULLS FIRST, category NULLS FIRST, target NULLS FIRST)
SELECT *, CAST(row_number() OVER (PARTITION BY priority ORDER BY confidence DESC NULLS LAST, rec_id) AS INTEGER) AS place FROM r QUALIFY place <= 50""",
    "error_types_by_variant": f"WITH {lines._RAW}, x AS (SELECT 'v3' AS variant, {_TYPE3} AS error_type FROM uf UNION ALL SELECT 'v2', {_TYPE2} FROM uf) SELECT variant, error_type, count(*) AS n FROM x WHERE error_type IS NOT NULL GROUP BY 1, 2",
    "error_families_by_variant": f"""WITH {lines._RAW}, x AS (SELECT 'v1' AS variant, {_FAMILY1} AS family FROM uf WHERE {_ERROR1} UNION ALL SELECT 'v2', {_FAMILY2} FROM uf WHERE ({_TYPE2}) IS NOT NULL UNION ALL SELECT 'v3', {_FAMILY3} FROM uf WHERE ({_TYPE3}) IS NOT NULL)
SELECT variant, family, count(*) AS n FROM x WHERE family IS NOT NULL GROUP BY 1, 2""",
    "line_endpoints": rf"WITH {lines._RAW}, x AS (SELECT {lines._ST} AS store_id, unnest(regexp_extract_all(t, '\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}:\d+')) AS endpoint FROM uf) SELECT store_id, endpoint, count(*) AS n FROM x WHERE store_id IS NOT NULL GROUP BY 1, 2",
    "store_line_samples": f"WITH {lines._PARSED} SELECT store_id, CAST(row_number() OVER (PARTITION BY store_id ORDER BY file, line_no) AS INTEGER) AS rank, file, line_no, left(t, 200) AS line FROM e WHERE store_id IS NOT NULL AND category IS NOT NULL QUALIFY rank <= 5",
    "error_type_samples": f"WITH {lines._RAW}, x AS (SELECT *, {_TYPE3} AS error_type FROM uf) SELECT error_type, CAST(row_number() OVER (PARTITION BY error_type ORDER BY file, line_no) AS INTEGER) AS rank, file, line_no, left(t, 500) AS line FROM x WHERE error_type IS NOT NULL QUALIFY rank <= 100",
}
