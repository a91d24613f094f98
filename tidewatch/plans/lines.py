"""Queries on raw log lines: parsing, classification, deduplication, context, reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import patterns
from tidewatch.functions.classify import reasons
from tidewatch.operators import parse
from tidewatch.operators.sticky import carry_forward
from tidewatch.sources.tables import table

DIAGNOSES = {  # fixed values: subtypes by diagnosis
    "vNVR Unresponsive": ("empty_redirection", "empty_logon"),
    "Data Prefetch Failures": ("prefetch_base", "prefetch_directory_role", "prefetch_directory_servers"),
    "TLS/Certificate Issues": ("tls_auth_failed", "handshake_error"),
    "Network Transport Issues": ("read_timeout", "transport_read_error"),
    "Sync/Data Issues": ("sync_aborted", "entity_sync_failed", "custom_fields_failed"),
}


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    return parse.raw_lines(table(spark, folder, "log_lines"))


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return parse.parsed(parse.first_of_each(_raw(spark, folder), "file"))


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed lines with a time, a store and a category or severity."""
    return _parsed(spark, folder).where("ts is not null and coalesce(category, severity) is not null")


def parse_lines(spark, folder):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return _parsed(spark, folder).select(
        "file",
        "line_no",
        text.alias("ts"),
        "store_id",
        "ip",
        "port",
        "fed_group",
        "start_delay",
        "message",
        "category",
        "severity",
        "subtype",
    )


def parse_invalid_ts(spark, folder):
    return _raw(spark, folder).groupBy("server").agg(F.count("*").alias("lines"), F.count_if(parse.timestamp(F.col("text")).isNull()).alias("without_ts"))


def _counts(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))


def classify_category(spark, folder):
    return _counts(_events(spark, folder), "category")


def classify_severity(spark, folder):
    return _counts(_events(spark, folder), "severity")


def subtype_totals(spark, folder):
    n = _counts(_events(spark, folder), "subtype")
    return n.select("subtype", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6).alias("pct"))


def diagnosis_groups(spark, folder):
    group = F.create_map(*[F.lit(x) for name, subs in DIAGNOSES.items() for sub in subs for x in (sub, name)])
    n = _counts(_events(spark, folder), "subtype").withColumn("diagnosis", group[F.col("subtype")])
    return n.where("diagnosis is not null").groupBy("diagnosis").agg(F.sum("n").alias("n"))


def store_dominant_subtype(spark, folder):
    n = _events(spark, folder).where("subtype is not null and store_id is not null").groupBy("store_id", "subtype").agg(F.count("*").alias("n"))
    totals = n.groupBy("store_id").agg(F.sum("n").alias("total"))
    return parse.dominant(n, ["store_id"], "subtype").join(totals, "store_id").select("store_id", "subtype", "n", "total")


def event_flags_v1(spark, folder):
    raw = parse.first_of_each(_raw(spark, folder), "global")
    flags = parse.flags_v1(F.col("text"))
    labels = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]), lambda x: x.isNotNull())
    return raw.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def conn_kind(spark, folder):
    t = F.col("text")
    raw = parse.first_of_each(_raw(spark, folder), "file").select(
        parse.store(t).alias("store_id"),
        parse.connection_kind(t).alias("kind"),
        parse.connection_kind(t, broad=True).alias("broad_kind"),
    )
    return raw.where("store_id is not null").groupBy(
        F.coalesce("kind", F.lit("none")).alias("kind"),
        F.coalesce("broad_kind", F.lit("none")).alias("broad_kind"),
    ).agg(F.count("*").alias("n"))


def error_family(spark, folder):
    t = F.col("text")
    raw = parse.first_of_each(_raw(spark, folder), "file").select(
        parse.error_type(t).alias("error_type"),
        F.coalesce(parse.error_family(t), F.lit("other")).alias("family"),
    )
    return raw.where("error_type is not null").groupBy("error_type", "family").agg(F.count("*").alias("n"))


def dedup_lines_file(spark, folder):
    return parse.first_of_each(_raw(spark, folder), "file").groupBy("file").agg(
        F.count("*").alias("n"),
        F.min("line_no").alias("first_line"),
        F.max("line_no").alias("last_line"),
    )


def dedup_lines_global(spark, folder):
    return parse.first_of_each(_raw(spark, folder), "global").groupBy("server").agg(F.count("*").alias("n"))


def _with_context(spark, folder):
    t = F.col("text")
    group, machine = F.nullif(F.regexp_extract(t, patterns.ROLE_GROUP, 1), F.lit("")), F.nullif(F.regexp_extract(t, patterns.MACHINE, 1), F.lit(""))
    raw = _raw(spark, folder).select(
        "file",
        "line_no",
        t,
        parse.store(t).alias("store_id"),
        group.alias("own"),
        group.alias("fed_group"),
        F.when(t.startswith("*"), machine).alias("machine"),
    )
    return carry_forward(raw, "file", "line_no", ["fed_group", "machine"])


def sticky_context(spark, folder):
    return _with_context(spark, folder).where("text not like '*%' and store_id is not null").select("file", "line_no", "store_id", "fed_group", "machine")


def store_group_attribution(spark, folder):
    return parse.store_groups(_with_context(spark, folder).where("text not like '*%'").withColumnRenamed("fed_group", "above"))


def _reasons(spark, folder):
    t = F.col("text")
    raw = parse.first_of_each(_raw(spark, folder), "global").select(parse.store(t).alias("store_id"), F.explode(reasons(t)).alias("reason"))
    return raw.where("store_id is not null")


def reason_totals(spark, folder):
    return _counts(_reasons(spark, folder), "reason")


def store_reason_dominant(spark, folder):
    return parse.dominant(_reasons(spark, folder).groupBy("store_id", "reason").agg(F.count("*").alias("n")), ["store_id"], "reason")


def reason_top_stores(spark, folder):
    n = _reasons(spark, folder).groupBy("reason", "store_id").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("reason").orderBy(F.desc("n"), "store_id"))
    return n.withColumn("rank", rank).where("rank <= 10")


def dataset_summary(spark, folder):
    return _parsed(spark, folder).agg(
        F.count("*").alias("unique_lines"), F.countDistinct("file").alias("files"), F.countDistinct("store_id").alias("stores"), F.count_if(F.col("ts").isNotNull() & F.coalesce("category", "severity").isNotNull()).alias("events"),
        F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_ts"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_ts"),
    )


def first_n_samples(spark, folder):
    """The first five lines of each category."""
    rank = F.row_number().over(Window.partitionBy("category").orderBy("file", "line_no"))
    return _events(spark, folder).where("category is not null").withColumn("rank", rank).where("rank <= 5").select("category", "rank", "file", "line_no")


QUERIES = {
    f.__name__: f
    for f in (
        parse_lines, parse_invalid_ts, classify_category, classify_severity, subtype_totals, diagnosis_groups, store_dominant_subtype, event_flags_v1, conn_kind, error_family, dedup_lines_file,
        dedup_lines_global, sticky_context, store_group_attribution, reason_totals, store_reason_dominant, reason_top_stores, dataset_summary, first_n_samples,
    )
}


def _contains(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


CATEGORY_SQL = "CASE " + " ".join(f"WHEN {_contains('lower(t)', [w.lower() for w in ws])} THEN '{k}'" for k, ws in patterns.CATEGORIES.items()) + " END"
_SEVERITY = "CASE " + " ".join(f"WHEN contains(lower(t), '{w}') THEN '{k}'" for k, w in patterns.SEVERITIES.items()) + " END"
_SUBTYPE = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{k}'" for k, p in patterns.SUBTYPES.items()) + " END"
_REASON_ROWS = " UNION ALL ".join(f"SELECT store_id, '{k}' AS reason FROM rs WHERE regexp_matches(t, '(?i){p}')" for k, p in patterns.REASONS.items())
_TS = "CASE WHEN length(t) >= 20 AND t[5] = '-' THEN try_strptime(left(t, 19), '%Y-%m-%dT%H:%M:%S') END"
_ST = r"lpad(nullif(regexp_extract(t, 'Store[\s_](\d{4,5})', 1), ''), 5, '0')"
_RAW = r"""raw AS (SELECT * FROM (SELECT file, line_no, min(server) AS server, regexp_replace(min(line), '^[\s﻿]+|\s+$', '', 'g') AS t FROM log_lines GROUP BY file, line_no) WHERE t <> ''),
uf AS (SELECT * FROM raw WHERE t NOT LIKE '*%' QUALIFY row_number() OVER (PARTITION BY file, t ORDER BY line_no) = 1),
ug AS (SELECT * FROM raw WHERE t NOT LIKE '*%' QUALIFY row_number() OVER (PARTITION BY t ORDER BY file, line_no) = 1)"""
_PARSED = rf"""{_RAW}, p0 AS (SELECT *, {_TS} AS ts, {_ST} AS store_id, {CATEGORY_SQL} AS category, {_SEVERITY} AS severity FROM uf),
p AS (SELECT *, CASE WHEN category LIKE 'internal_error%' THEN {_SUBTYPE} END AS subtype FROM p0),
e AS (SELECT * FROM p WHERE ts IS NOT NULL AND coalesce(category, severity) IS NOT NULL)"""
_CONTEXT = rf"""{_RAW}, c0 AS (SELECT file, line_no, t, {_ST} AS store_id, nullif(regexp_extract(t, '(SBUXSCRoleGroup\d+)', 1), '') AS own, CASE WHEN t LIKE '*%' THEN nullif(regexp_extract(t, 'MachineName=(\S+)', 1), '') END AS m FROM raw),
c AS (SELECT file, line_no, t, store_id, own, last_value(own IGNORE NULLS) OVER w AS fed_group, last_value(m IGNORE NULLS) OVER w AS machine FROM c0 WINDOW w AS (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING))"""
_REASONS = f"{_RAW}, rs AS (SELECT t, {_ST} AS store_id FROM ug WHERE {_contains('lower(t)', patterns.REASON_KEYWORDS)}), r AS (SELECT * FROM ({_REASON_ROWS}) WHERE store_id IS NOT NULL)"
_FLAGS = {
    "error": ("(Error)", "(error)"), "warning": ("(Warning)", "(warning)"), "exception": ("Exception", "exception"), "fatal": ("(Fatal)", "(fatal)", "Fatal", "fatal"),
    "connection": ("connection", "disconnect", "reconnect", "logged off", "logon", "logoff"),
}
_NARROW = f"""CASE WHEN {_contains('lower(t)', ('initial sync context is null', 'logged off', 'disconnect', 'offline', 'connection failed', 'connection attempt failed'))} THEN 'disconnect'
WHEN {_contains('lower(t)', ('logon', 'sync complete', 'connected successfully', 'scheduling reconnection'))} THEN 'reconnect' ELSE 'none' END"""
_BROAD = f"""CASE WHEN contains(t, 'Initial sync context is null') OR {_contains('lower(t)', ('logged off', 'disconnect', 'offline'))} OR (contains(lower(t), 'connection') AND contains(lower(t), 'fail')) THEN 'disconnect'
WHEN {_contains('lower(t)', ('reconnect', 'logon', 'online', 'connected', 'sync complete', 'primary sync'))} THEN 'reconnect' ELSE 'none' END"""
_TOP = "QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY n DESC, {v}) = 1"

SQL = {
    "parse_lines": rf"""WITH {_PARSED} SELECT file, line_no, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, store_id, nullif(regexp_extract(t, '(\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}):(\d+)', 1), '') AS ip,
nullif(regexp_extract(t, '(\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}):(\d+)', 2), '') AS port, nullif(regexp_extract(t, '(SBUXSCRoleGroup\d+)', 1), '') AS fed_group,
try_cast(nullif(regexp_extract(t, 'startDelay\s*=\s*(\d+)', 1), '') AS INTEGER) AS start_delay, left(t, 300) AS message, category, severity, subtype FROM p""",
    "parse_invalid_ts": f"WITH {_RAW} SELECT server, count(*) AS lines, count(*) FILTER (({_TS}) IS NULL) AS without_ts FROM raw GROUP BY server",
    "classify_category": f"WITH {_PARSED} SELECT category, count(*) AS n FROM e WHERE category IS NOT NULL GROUP BY 1",
    "classify_severity": f"WITH {_PARSED} SELECT severity, count(*) AS n FROM e WHERE severity IS NOT NULL GROUP BY 1",
    "subtype_totals": f"WITH {_PARSED} SELECT subtype, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM e WHERE subtype IS NOT NULL GROUP BY 1",
    "diagnosis_groups": f"WITH {_PARSED}, d(diagnosis, subtype) AS (VALUES {', '.join(f"('{k}', '{s}')" for k, ss in DIAGNOSES.items() for s in ss)}) SELECT diagnosis, count(*) AS n FROM e JOIN d USING (subtype) GROUP BY 1",
    "store_dominant_subtype": f"""WITH {_PARSED}, n AS (SELECT store_id, subtype, count(*) AS n FROM e WHERE subtype IS NOT NULL AND store_id IS NOT NULL GROUP BY 1, 2)
SELECT store_id, subtype, n, CAST(sum(n) OVER (PARTITION BY store_id) AS BIGINT) AS total FROM n {_TOP.format(k='store_id', v='subtype')}""",
    "event_flags_v1": f"WITH {_RAW} " + " UNION ALL ".join(f"SELECT '{k}' AS label, count(*) AS n FROM ug WHERE {_contains('t', ws)} HAVING count(*) > 0" for k, ws in _FLAGS.items()),
    "conn_kind": f"WITH {_RAW} SELECT {_NARROW} AS kind, {_BROAD} AS broad_kind, count(*) AS n FROM uf WHERE {_ST} IS NOT NULL GROUP BY 1, 2",
    "error_family": f"""WITH {_RAW} SELECT CASE WHEN contains(t, 'Exception') THEN 'exception' WHEN contains(t, '(Warning)') THEN 'warning' WHEN contains(t, '(Fatal)') THEN 'fatal' WHEN contains(t, '(Error)') THEN 'error' END AS error_type,
CASE WHEN contains(lower(t), 'timeout') THEN 'timeout' WHEN contains(lower(t), 'connection attempt failed') THEN 'conn_failed' WHEN contains(lower(t), 'socket') THEN 'socket' WHEN contains(lower(t), 'tls') OR contains(lower(t), 'ssl') THEN 'tls_ssl' ELSE 'other' END AS family,
count(*) AS n FROM uf GROUP BY 1, 2 HAVING error_type IS NOT NULL""",
    "dedup_lines_file": f"WITH {_RAW} SELECT file, count(*) AS n, min(line_no) AS first_line, max(line_no) AS last_line FROM uf GROUP BY 1",
    "dedup_lines_global": f"WITH {_RAW} SELECT server, count(*) AS n FROM ug GROUP BY 1",
    "sticky_context": f"WITH {_CONTEXT} SELECT file, line_no, store_id, fed_group, machine FROM c WHERE t NOT LIKE '*%' AND store_id IS NOT NULL",
    "store_group_attribution": f"""WITH {_CONTEXT}, s AS (SELECT * FROM c WHERE t NOT LIKE '*%' AND store_id IS NOT NULL),
o AS (SELECT store_id, own FROM s WHERE own IS NOT NULL QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY file DESC, line_no DESC) = 1),
a AS (SELECT store_id, fed_group FROM s WHERE fed_group IS NOT NULL QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY file, line_no) = 1)
SELECT k.store_id, coalesce(o.own, a.fed_group, 'Unknown') AS fed_group FROM (SELECT DISTINCT store_id FROM s) k LEFT JOIN o USING (store_id) LEFT JOIN a USING (store_id)""",
    "reason_totals": f"WITH {_REASONS} SELECT reason, count(*) AS n FROM r GROUP BY 1",
    "store_reason_dominant": f"WITH {_REASONS} SELECT store_id, reason, count(*) AS n FROM r GROUP BY 1, 2 {_TOP.format(k='store_id', v='reason')}",
    "reason_top_stores": f"WITH {_REASONS}, n AS (SELECT reason, store_id, count(*) AS n FROM r GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY reason ORDER BY n DESC, store_id) AS INTEGER) AS rank FROM n QUALIFY rank <= 10",
    "dataset_summary": f"""WITH {_PARSED} SELECT count(*) AS unique_lines, count(DISTINCT file) AS files, count(DISTINCT store_id) AS stores, count(*) FILTER (ts IS NOT NULL AND coalesce(category, severity) IS NOT NULL) AS events,
strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM p""",
    "first_n_samples": f"WITH {_PARSED} SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY file, line_no) AS INTEGER) AS rank, file, line_no FROM e WHERE category IS NOT NULL QUALIFY rank <= 5",
}
