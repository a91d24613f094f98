"""The queries p1_ to p5_ on the whole tables, with their production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.instants import with_instant
from tidewatch.functions.keys import store_key, target_key
from tidewatch.operators import coverage, log_entries
from tidewatch.operators.compaction import compact, copy_pairs
from tidewatch.operators.eager_aggregate import Measure, eager_join_aggregate, hot_keys, once, roll_up
from tidewatch.plans.lines import CATEGORY_SQL as _CATEGORY
from tidewatch.sources.tables import table

HOT_SHARE = 0.02


def _disconnects_by_key(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conn_events").where("kind = 'disconnect'")
    return once(rows.select("event_id", store_key(F.col("store_id")).alias("key")), "event_id", "key")


def _recommendations_by_key(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "recommendations").select(
        "rec_id",
        target_key(F.col("target")).alias("key"),
        "priority",
        F.round("confidence", 3).alias("confidence"),
    )
    return once(rows, "rec_id", "key", "priority", "confidence")


def key_results(spark: SparkSession, folder: str) -> DataFrame:
    """Per key, over disconnects joined with recommendations: rows of both sides, rows of the join and sums over them."""
    recs = _recommendations_by_key(spark, folder)
    urgent = Measure("urgent", "sum", F.when(F.col("priority") == 1, 1).otherwise(0).cast("bigint"))
    milli = Measure("confidence_milli", "sum", F.round(F.coalesce(F.col("confidence"), F.lit(0.0)) * 1000).cast("bigint"))
    return eager_join_aggregate(_disconnects_by_key(spark, folder), recs, ["key"], right_measures=[urgent, milli], how="full")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return hot_keys(key_results(spark, folder), "key", {"store_disconnects": "left_rows", "target": "right_rows"}, HOT_SHARE)


def p1_key_results(spark: SparkSession, folder: str) -> DataFrame:
    return key_results(spark, folder).select("key", "left_rows", "right_rows", "joined_rows", "joined_urgent")


def p1_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """The join's row count and sums by the leading digit of the store, rolled up from the per-key results."""
    group = F.when(F.col("key").rlike("^[0-9]{5}$"), F.left("key", F.lit(1))).otherwise("other").alias("key_group")
    return roll_up(key_results(spark, folder), [group], ["left_rows", "right_rows", "joined_rows", "joined_urgent"])


def _with_zone(df: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    zones = table(spark, folder, "machines").groupBy("machine").agg(F.min("tz_name").alias("_zone"))
    return df.join(zones, "machine", "left")


def conn_instants(spark: SparkSession, folder: str, rows: DataFrame | None = None) -> DataFrame:
    rows = table(spark, folder, "conn_events") if rows is None else rows
    return with_instant(_with_zone(rows, spark, folder), "timestamp_raw", "_zone", "instant_us")


def health_instants(spark: SparkSession, folder: str, rows: DataFrame | None = None) -> DataFrame:
    rows = table(spark, folder, "health_events") if rows is None else rows
    return with_instant(_with_zone(rows, spark, folder), "event_timestamp", "_zone", "instant_us")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    second = F.expr("(instant_us - pmod(instant_us, 1000000)) div 1000000").alias("second")
    health = table(spark, folder, "health_events").where("health_event = 'Connection failed'").select(
        "health_id",
        "server",
        store_key(F.col("source_entity")).alias("store"),
        "machine",
        "event_timestamp",
    )
    events = table(spark, folder, "conn_events").where("kind = 'disconnect'").select(
        "event_id",
        "server",
        store_key(F.col("store_id")).alias("store"),
        "machine",
        "timestamp_raw",
    )
    a = health_instants(spark, folder, health).select("health_id", "server", "store", second)
    b = conn_instants(spark, folder, events).select("event_id", "server", "store", second)
    return a.dropna().join(b.dropna(), ["server", "store", "second"]).select("health_id", "event_id").distinct()


def p2_instants(spark: SparkSession, folder: str) -> DataFrame:
    """Every connection event's instant as a UTC text, null where its text means none; one row per event_id."""
    rows = conn_instants(spark, folder).groupBy("event_id").agg(F.min("instant_us").alias("instant_us"))
    text = F.date_format(F.timestamp_micros("instant_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return rows.select("event_id", "instant_us", text.alias("instant_utc"))


def _outages(spark: SparkSession, folder: str) -> DataFrame:
    """(server, store_id, s, e); an end beyond the calendar's last year, also of an infinite duration, is that year's end."""
    start, back, length = F.unix_micros("store_last_disconnect"), F.unix_micros("reconnect_at"), F.col("store_duration_s")
    far = start.cast("double") + length * 1e6 >= float(coverage.LAST_US)
    lasting = F.when(far, F.lit(coverage.LAST_US)).otherwise(start + F.round(length * 1e6).cast("bigint"))
    end = F.coalesce(back, F.when(~F.isnan(length) & (length > 0), lasting))
    return table(spark, folder, "outage_spans").select("server", store_key(F.col("store_id")).alias("store_id"), start.alias("s"), end.alias("e"))


def _seconds(c: str) -> Column:
    return F.expr(f"({c} - pmod({c}, 1000000)) div 1000000")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    found = coverage.gaps(_outages(spark, folder), ["server", "store_id"], F.col("s"), F.col("e"))
    return found.select("server", "store_id", _seconds("gap_start").alias("gap_start_s"), _seconds("gap_end").alias("gap_end_s"))


def p3_periods(spark: SparkSession, folder: str) -> DataFrame:
    found = coverage.periods(_outages(spark, folder), ["server", "store_id"], F.col("s"), F.col("e"))
    return found.select("server", "store_id", _seconds("period_start").alias("period_start_s"), _seconds("period_end").alias("period_end_s"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    done = compact(table(spark, folder, "log_files").select("file_id", "content"), "file_id", "content")
    return copy_pairs(done.members)


def p4_members(spark: SparkSession, folder: str) -> DataFrame:
    """(file_id, kept_file_id): the class of each file with records, whatever its size."""
    done = compact(table(spark, folder, "log_files").select("file_id", "content"), "file_id", "content")
    return done.members.select("file_id", "kept_file_id")


def p4_records(spark: SparkSession, folder: str) -> DataFrame:
    """The consolidated records with the file each was kept from."""
    return compact(table(spark, folder, "log_files").select("file_id", "content"), "file_id", "content").records


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = log_entries.entries(table(spark, folder, "log_lines"))
    return found.where("level in ('error', 'fatal') and store_id is not null").select("server", "file", "first_line", "last_line", "store_id")


def p5_entries(spark: SparkSession, folder: str) -> DataFrame:
    return log_entries.entries(table(spark, folder, "log_lines"))


def p5_unowned(spark: SparkSession, folder: str) -> DataFrame:
    """Per file the lines that are in no entry."""
    return log_entries.unowned(table(spark, folder, "log_lines"))


QUERIES = {
    f.__name__: f for f in (
        p1_found,
        p1_key_results,
        p1_rollup,
        p2_found,
        p2_instants,
        p3_found,
        p3_periods,
        p4_found,
        p4_members,
        p4_records,
        p5_found,
        p5_entries,
        p5_unowned,
    )
}

_STORE = "lpad(nullif(regexp_extract({0}, '(?:^|[^0-9])([0-9]{{4,5}})(?:$|[^0-9])', 1), ''), 5, '0')"
_CTES = f"""
d AS (SELECT event_id, min({_STORE.format('store_id')}) AS key FROM conn_events WHERE kind = 'disconnect' GROUP BY event_id),
r AS (SELECT rec_id, min(coalesce(lpad(nullif(regexp_extract(target, '(?i)^\\s*(?:store[\\s_]*)?([0-9]{{4,5}})(?:$|[^0-9])', 1), ''), 5, '0'),
  nullif(lower(regexp_replace(target, '^\\s+|\\s+$', '', 'g')), ''))) AS key, min(priority) AS priority FROM recommendations GROUP BY rec_id),
dn AS (SELECT key, count(*) AS n FROM d WHERE key IS NOT NULL GROUP BY key),
rn AS (SELECT key, count(*) AS n, sum(CASE WHEN priority = 1 THEN 1 ELSE 0 END) AS urgent FROM r WHERE key IS NOT NULL GROUP BY key),
k AS (SELECT coalesce(dn.key, rn.key) AS key, coalesce(dn.n, 0) AS l, coalesce(rn.n, 0) AS r, coalesce(rn.urgent, 0) AS u FROM dn FULL JOIN rn ON dn.key = rn.key)"""
_SPANS = f"""
i AS (SELECT DISTINCT server, {_STORE.format('store_id')} AS store_id, epoch_us(store_last_disconnect) AS s,
  coalesce(epoch_us(reconnect_at), CASE WHEN isnan(store_duration_s) OR store_duration_s <= 0 THEN NULL WHEN epoch_us(store_last_disconnect) + store_duration_s * 1e6 >= {coverage.LAST_US} THEN {coverage.LAST_US}
  ELSE epoch_us(store_last_disconnect) + CAST(round(store_duration_s * 1e6) AS BIGINT) END) AS e FROM outage_spans),
v AS (SELECT * FROM i WHERE server IS NOT NULL AND store_id IS NOT NULL AND s IS NOT NULL AND e > s),
b AS (SELECT *, max(e) OVER (PARTITION BY server, store_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM v)"""

_FILES = """
f AS (SELECT file_id, min(list_filter(regexp_split_to_array(regexp_replace(content, '^\ufeff', ''), '\\r\\n|\\n|\\r'), lambda x: regexp_matches(x, '\\S'))) AS r
  FROM log_files WHERE content IS NOT NULL GROUP BY file_id),
g AS (SELECT file_id, r, min(file_id) OVER (PARTITION BY r) AS kept FROM f WHERE len(r) > 0)"""

_HEADS = {  # each program's first line, with its level
    r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\S* \S+ \((\w+)\) ": "lower({x})", r'^\{"time": [^,]+, "level": "(\w+)"': "lower({x})", r"^ts=\S+ lvl=(\w+)": "lower({x})", r"^\d\d:\d\d:\d\d,\d+ \| (\w+) *\|": "lower({x})",
    r"^<(\d+)>[A-Z][a-z]{2} +\d+ \d\d:": "CASE WHEN CAST({x} AS INTEGER) % 8 < 4 THEN 'error' ELSE 'less' END", r"^\[\d\d/[A-Z][a-z]{2}/\d{4}:\S+ \S+ \[\w+\] \[(\w)\]": "CASE WHEN {x} IN ('E', 'F', 'C') THEN 'error' ELSE 'less' END",
}
_ENTRIES = rf"""
l AS (SELECT file, line_no, min(server) AS server, regexp_replace(coalesce(min(line), ''), '^{chr(0xFEFF)}|\r+$', '', 'g') AS t FROM log_lines GROUP BY file, line_no),
h AS (SELECT *, regexp_matches(t, '^\s*\*') AS star, CASE {' '.join(f"WHEN regexp_matches(t, '{k}') THEN " + v.replace("{x}", f"regexp_extract(t, '{k}', 1)") for k, v in _HEADS.items())} END AS lv,
  nullif(regexp_extract(t, '(?:^|[^A-Za-z])[Ss]tore(?:Id)?["''\s_:=-]{{0,6}}([0-9]{{4,5}})(?:[^0-9]|$)', 1), '') AS st FROM l),
o AS (SELECT *, max(CASE WHEN star THEN line_no * 2 WHEN lv IS NOT NULL THEN line_no * 2 + 1 END) OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS c FROM h),
en AS (SELECT file, c // 2 AS first_line, min(server) AS server, max(line_no) FILTER (regexp_matches(t, '\S')) AS last_line, lpad(arg_min(st, line_no) FILTER (st IS NOT NULL), 5, '0') AS store_id, max(CASE WHEN line_no = c // 2 THEN lv END) AS lv FROM o WHERE c % 2 = 1 GROUP BY file, c)"""


_LAYOUTS = {  # each program's first line: time, level, component, message
    "a": r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\S*) (\S+) \((\w+)\) (.*)$",
    "b": r'^\{"time": "?([^",]+)"?, "level": "(\w+)", "component": "(\w+)", "message": "(.*?)"?\}?$',
    "c": r'^ts=(\S+) lvl=(\w+) comp=(\S+) (?:store=\S+ )?msg="(.*?)"?$',
    "d": r"^(\d\d:\d\d:\d\d,\d+) \| (\w+) *\| (\S+) \| (.*)$",
    "e": r"^<(\d+)>([A-Z][a-z]{2} +\d+ \d\d:\d\d:\d\d) \S+ ([^\[:]+)(?:\[\d+\])?: (.*)$",
    "f": r"^\[(\d\d/[A-Z][a-z]{2}/\d{4}:\d\d:\d\d:\d\d [+-]\d{4})\] \[(\w+)\] \[(\w)\] (.*)$",
}
_ORDERS = {"a": "1324", "b": "1234", "c": "1234", "d": "1234", "e": "2134", "f": "1324"}


def _field(k: int) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN regexp_extract(t, '{p}', {_ORDERS[f][k]})" for f, p in _LAYOUTS.items()) + " END"


_RANKS = {
    "trace": "trace",
    "debug": "debug",
    "d": "debug",
    "info": "info",
    "i": "info",
    "warn": "warning",
    "warning": "warning",
    "w": "warning",
    "err": "error",
    "error": "error",
    "e": "error",
    "crit": "fatal",
    "critical": "fatal",
    "fatal": "fatal",
    "f": "fatal",
    "c": "fatal",
}
_LEVELS = "CASE WHEN try_cast(lw AS INTEGER) IS NOT NULL THEN ['fatal', 'fatal', 'fatal', 'error', 'warning', 'info', 'info', 'debug'][try_cast(lw AS INTEGER) % 8 + 1] " + " ".join(
    f"WHEN lower(lw) = '{k}' THEN '{v}'" for k, v in _RANKS.items()
) + " END"
_WALL = "epoch_us(timezone(log_zone, make_timestamptz(w + {0})))"
_FIELDS = rf"""{_ENTRIES},
x0 AS (SELECT file, line_no, t, max(CASE WHEN star AND regexp_matches(t, '[Dd]ate \d{{4}}-\d\d-\d\d') THEN [printf('%012d', line_no), regexp_extract(t, '[Dd]ate (\d{{4}}-\d\d-\d\d)', 1)] END) OVER p AS d,
  max(CASE WHEN star AND contains(t, 'Zone=') THEN [printf('%012d', line_no), regexp_extract(t, 'Zone=(\S+)', 1)] END) OVER p AS z FROM h WINDOW p AS (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
x1 AS (SELECT file, line_no, {_field(0)} AS tt, {_field(1)} AS lw, {_field(2)} AS component, {_field(3)} AS message, coalesce(d[2], nullif(regexp_extract(file, '\d{{4}}-\d\d-\d\d'), '')) AS log_day, z[2] AS log_zone FROM x0),
x2 AS (SELECT *, CASE WHEN regexp_matches(tt, '^\d\d:') THEN log_day || ' ' || tt WHEN regexp_matches(tt, '^[A-Z]') THEN regexp_extract(tt, '(\d+) \d\d:', 1) || '-' || tt[1:3] || '-' || left(log_day, 4) || ' ' || right(tt, 8) ELSE tt END AS time_text FROM x1),
x3 AS (SELECT *, epoch_us(try_strptime(replace(time_text, ',', '.'), ['%Y-%m-%d %H:%M:%S.%f', '%d-%b-%Y %H:%M:%S'])) AS w, coalesce(CASE WHEN regexp_full_match(time_text, '\d{{13}}') THEN CAST(time_text AS BIGINT) * 1000 END,
  CASE WHEN regexp_matches(time_text, '^\d{{4}}-\d\d-\d\dT') THEN epoch_us(try_cast(time_text AS TIMESTAMPTZ)) END, epoch_us(try_strptime(time_text, '%d/%b/%Y:%H:%M:%S %z'))) AS known FROM x2),
x4 AS (SELECT *, w - ({_WALL.format('-86400000000')} - (w - 86400000000)) AS c1, w - ({_WALL.format('86400000000')} - (w + 86400000000)) AS c2 FROM x3),
x5 AS (SELECT *, epoch_us(timezone(log_zone, make_timestamptz(c1))) = w AS ok1, epoch_us(timezone(log_zone, make_timestamptz(c2))) = w AS ok2 FROM x4),
ec AS (SELECT file, c // 2 AS first_line, arg_min(k, line_no) FILTER (k IS NOT NULL) AS error_category FROM (SELECT *, {_CATEGORY} AS k FROM o WHERE c % 2 = 1) GROUP BY 1, 2)"""


def _instants_sql(name: str, table_name: str, text: str, keep: str) -> str:
    """CTEs ending in {name}(keep, us): the instants of a table by DuckDB's own parser and zones."""
    wall = lambda shift: f"epoch_us(timezone(z, make_timestamptz(w + {shift})))"
    stated = {"CET": 60, "CEST": 120, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "EST": -300, "EDT": -240, "CDT": -300}
    cases = " ".join(f"WHEN zn = '{k}' THEN {v}" for k, v in stated.items())
    return rf"""{name}0 AS (SELECT DISTINCT {keep}, trim(t.{text}) AS t, m.tz_name AS own FROM {table_name} t LEFT JOIN machines m USING (machine)),
{name}1 AS (SELECT *, trim(regexp_extract(t, '(Z|[+-]\d{{2}}:?\d{{2}}| [A-Z]{{3,4}}| [A-Za-z]+/[A-Za-z_]+)$', 1)) AS zn FROM {name}0),
{name}2 AS (SELECT *, regexp_replace(trim(left(t, length(t) - length(zn))), '([0-9]),([0-9])', '\1.\2') AS b FROM {name}1),
{name}3 AS (SELECT *, CASE WHEN regexp_full_match(t, '\d{{5}}\.\d+') THEN (CAST(round(CAST(t AS DOUBLE) * 86400000) AS BIGINT) - 2209161600000) * 1000
 ELSE epoch_us(try_strptime(b, ['%Y-%m-%dT%H:%M:%S.%f', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y%m%dT%H%M%S', '%m/%d/%Y %I:%M:%S %p', '%d.%m.%Y %H:%M:%S', '%d-%b-%Y %H:%M:%S', '%a, %d %b %Y %H:%M:%S'])) END AS w,
 CASE WHEN zn IN ('Z', 'UTC', 'GMT') THEN 0 {cases} WHEN zn = 'CST' AND own LIKE 'America/%' THEN -360 WHEN zn = 'IST' AND own = 'Asia/Kolkata' THEN 330 WHEN zn = 'BST' AND own LIKE 'Europe/%' THEN 60
 WHEN regexp_matches(zn, '^[+-]') THEN (CASE WHEN zn[1] = '-' THEN -1 ELSE 1 END) * (CAST(zn[2:3] AS INTEGER) * 60 + CAST(right(zn, 2) AS INTEGER)) END AS off,
 CASE WHEN zn = '' THEN own WHEN contains(zn, '/') THEN zn END AS z, CASE WHEN regexp_full_match(t, '\d{{10}}') THEN CAST(t AS BIGINT) * 1000000 WHEN regexp_full_match(t, '\d{{13}}') THEN CAST(t AS BIGINT) * 1000 END AS e FROM {name}2),
{name}4 AS (SELECT *, w - ({wall(-86_400_000_000)} - (w - 86400000000)) AS c1, w - ({wall(86_400_000_000)} - (w + 86400000000)) AS c2 FROM {name}3),
{name}5 AS (SELECT *, epoch_us(timezone(z, make_timestamptz(c1))) = w AS ok1, epoch_us(timezone(z, make_timestamptz(c2))) = w AS ok2 FROM {name}4),
{name} AS (SELECT {keep}, coalesce(e, w - CAST(off AS BIGINT) * 60000000, CASE WHEN c1 = c2 AND ok1 THEN c1 WHEN c1 <> c2 AND ok1 AND NOT ok2 THEN c1 WHEN c1 <> c2 AND ok2 AND NOT ok1 THEN c2 END) AS us FROM {name}5)"""


_CONN, _HEALTH = _instants_sql("ci", "conn_events", "timestamp_raw", "event_id, server, kind, store_id"), _instants_sql(
    "hi",
    "health_events",
    "event_timestamp",
    "health_id, server, health_event, source_entity",
)

SQL = {
    "p2_instants": f"WITH {_CONN} SELECT event_id, min(us) AS instant_us, strftime(make_timestamp(min(us)), '%Y-%m-%dT%H:%M:%S.%fZ') AS instant_utc FROM ci GROUP BY event_id",
    "p2_found": f"""WITH {_CONN}, {_HEALTH} SELECT DISTINCT health_id, event_id FROM hi JOIN ci ON hi.server = ci.server AND {_STORE.format('hi.source_entity')} = {_STORE.format('ci.store_id')}
AND floor(hi.us / 1000000) = floor(ci.us / 1000000) WHERE health_event = 'Connection failed' AND kind = 'disconnect'""",
    "p5_found": f"WITH {_ENTRIES} SELECT server, file, first_line, last_line, store_id FROM en WHERE lv IN ('error', 'err', 'fatal', 'critical', 'crit') AND store_id IS NOT NULL",
    "p5_entries": f"""WITH {_FIELDS} SELECT en.server, en.file, en.first_line, last_line, time_text, coalesce(known, CASE WHEN c1 = c2 AND ok1 THEN c1 WHEN c1 <> c2 AND ok1 AND NOT ok2 THEN c1 WHEN c1 <> c2 AND ok2 AND NOT ok1 THEN c2 END) AS instant_us,
{_LEVELS} AS level, component, message, store_id, error_category FROM en JOIN x5 ON en.file = x5.file AND x5.line_no = en.first_line JOIN ec ON ec.file = en.file AND ec.first_line = en.first_line""",
    "p5_unowned": f"WITH {_ENTRIES} SELECT file, count(*) AS lines, min(line_no) AS first_line, max(line_no) AS last_line FROM o WHERE NOT star AND regexp_matches(t, '\\S') AND coalesce(c, 0) % 2 = 0 GROUP BY file",
    "p4_found": f"WITH {_FILES} SELECT a.file_id AS file_a, b.file_id AS file_b FROM g a JOIN g b ON a.r = b.r AND a.file_id < b.file_id",
    "p4_members": f"WITH {_FILES} SELECT file_id, kept AS kept_file_id FROM g",
    "p4_records": f"WITH {_FILES} SELECT file_id, CAST(unnest(range(len(r))) AS INTEGER) AS seq, unnest(r) AS record FROM g WHERE file_id = kept",
    "p1_found": f"""WITH {_CTES}
SELECT 'store_disconnects' AS field, key AS hot_key FROM dn WHERE n >= 0.02 * (SELECT sum(n) FROM dn)
UNION ALL SELECT 'target', key FROM rn WHERE n >= 0.02 * (SELECT sum(n) FROM rn)""",
    "p1_key_results": f"WITH {_CTES} SELECT key, CAST(l AS BIGINT) AS left_rows, CAST(r AS BIGINT) AS right_rows, CAST(l * r AS BIGINT) AS joined_rows, CASE WHEN r > 0 THEN CAST(u * l AS BIGINT) END AS joined_urgent FROM k",
    "p1_rollup": f"""WITH {_CTES} SELECT CASE WHEN regexp_matches(key, '^[0-9]{{5}}$') THEN left(key, 1) ELSE 'other' END AS key_group, CAST(sum(l) AS BIGINT) AS left_rows,
CAST(sum(r) AS BIGINT) AS right_rows, CAST(sum(l * r) AS BIGINT) AS joined_rows, CAST(sum(CASE WHEN r > 0 THEN u * l END) AS BIGINT) AS joined_urgent FROM k GROUP BY 1""",
    "p3_found": f"WITH {_SPANS} SELECT server, store_id, CAST(floor(p / 1000000) AS BIGINT) AS gap_start_s, CAST(floor(s / 1000000) AS BIGINT) AS gap_end_s FROM b WHERE s > p",
    "p3_periods": f"""WITH {_SPANS}, c AS (SELECT *, sum(CASE WHEN s <= p THEN 0 ELSE 1 END) OVER (PARTITION BY server, store_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM b)
SELECT server, store_id, CAST(floor(min(s) / 1000000) AS BIGINT) AS period_start_s, CAST(floor(max(e) / 1000000) AS BIGINT) AS period_end_s FROM c GROUP BY server, store_id, g""",
}
