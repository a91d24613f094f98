"""Typed columns from raw log lines, all native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import patterns
from tidewatch.functions.classify import error_category, internal_subtype, severity

HEADER = "*"


def _has(text: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def raw_lines(lines: DataFrame) -> DataFrame:
    """(server, file, line_no, text): each (file, line_no) once, white space and byte order marks at the ends off, blank lines out."""
    one = lines.groupBy("file", "line_no").agg(F.min("server").alias("server"), F.min("line").alias("line"))
    text = F.regexp_replace("line", "^[\\s﻿]+|\\s+$", "")
    # explode keeps later filters from spelling the replacement out wherever they name the text
    return one.select("server", "file", "line_no", F.explode(F.array(text)).alias("text")).where("text <> ''")


def timestamp(text: Column) -> Column:
    """The local date and time of the first 19 characters of a line of at least 20; null where they aren't one."""
    return F.when((F.length(text) >= 20) & (F.substring(text, 5, 1) == "-"), F.try_to_timestamp(F.left(text, F.lit(19)), F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def store(text: Column) -> Column:
    return F.lpad(_found(text, patterns.STORE), 5, "0")


def parsed(raw: DataFrame, width: int = 300) -> DataFrame:
    """raw_lines with ts, store_id, ip, port, fed_group, machine, start_delay, message (the
    first `width` characters), category, severity and subtype."""
    t, low = F.col("text"), F.col("_low")
    ip = patterns.IP_PORT
    first = raw.withColumn("_low", F.lower(t)).select(
        *raw.columns, timestamp(t).alias("ts"), store(t).alias("store_id"), _found(t, ip).alias("ip"), _found(t, ip, 2).alias("port"), _found(t, patterns.ROLE_GROUP).alias("fed_group"),
        F.when(t.startswith(HEADER), _found(t, patterns.MACHINE)).alias("machine"), _found(t, patterns.START_DELAY).try_cast("int").alias("start_delay"),
        F.left(t, F.lit(width)).alias("message"), error_category(t, low).alias("category"), severity(t, low).alias("severity"),
    )
    return first.select("*", internal_subtype(t, F.col("category")).alias("subtype"))


def first_of_each(raw: DataFrame, scope: str) -> DataFrame:
    """The first of equal lines, of a file (scope "file") or of all files ("global"); headers are kept.

    Equal lines meet as one minimum, combined before the shuffle, so a line that makes up a third of all rows isn't one task.
    """
    keys = ["file", "text"] if scope == "file" else ["text"]
    lines = raw.where(~F.col("text").startswith(HEADER))
    first = lines.groupBy(*keys).agg(F.min(F.struct("file", "line_no", "server")).alias("_first"))
    return first.select(F.col("_first.server").alias("server"), F.col("_first.file").alias("file"), F.col("_first.line_no").alias("line_no"), "text")


def flags_v1(text: Column) -> dict[str, Column]:
    """Case-sensitive labels, several of which a line may have."""
    return {name: _has(text, *words) for name, words in patterns.FLAGS.items()}


def connection_kind(text: Column, broad: bool = False) -> Column:
    """disconnect, reconnect or null. The narrow rules are the default; broad ones also take any failing connection and any "connected"."""
    low = F.lower(text)
    # the broad rules take this phrase only as it is written, the narrow ones in any case
    null_sync = text.contains(patterns.NULL_SYNC) if broad else low.contains(patterns.NULL_SYNC.lower())
    if broad:
        down = null_sync | _has(low, *patterns.LOST_BROAD) | (low.contains("connection") & low.contains("fail"))
        up = ~null_sync & _has(low, *patterns.BACK_BROAD)
    else:
        down, up = null_sync | _has(low, *patterns.LOST), ~null_sync & _has(low, *patterns.BACK)
    return F.when(down, "disconnect").when(up, "reconnect")


def error_type(text: Column, variant: str = "v3") -> Column:
    """warning over fatal over error, and exception over all of them (v3) or after them (v2); null for none."""
    said = F.when(text.contains("(Warning)"), "warning").when(text.contains("(Fatal)"), "fatal").when(text.contains("(Error)"), "error")
    exception = F.when(text.contains("Exception"), "exception")
    return F.coalesce(exception, said) if variant == "v3" else F.coalesce(said, exception)


def error_family(text: Column, variant: str = "v3") -> Column:
    """The family of an error's line by one of three sets of rules; null for none."""
    low = F.lower(text)
    timeout = _has(low, "timeout", "timed out")
    if variant == "v1":
        failed = F.when(timeout, "connection_timeout").when(low.contains("refused"), "connection_refused").when(low.contains("failed"), "connection_failed")
        thrown = F.when(low.contains("socket"), "socket_exception").when(_has(low, "tls", "ssl"), "tls_ssl_exception").otherwise("other_exception")
        return F.when(low.contains("connection"), failed.otherwise("connection_issue")).when(low.contains("exception"), thrown)
    attempt, socket, tls = low.contains("connection attempt failed"), low.contains("socket"), _has(low, "tls", "ssl")
    if variant == "v2":
        return F.when(timeout, "timeout").when(attempt, "conn_failed").when(socket, "socket").when(tls, "tls_ssl").when(low.contains("refused"), "refused")
    return F.when(low.contains("timeout"), "timeout").when(attempt, "conn_failed").when(socket, "socket").when(tls, "tls_ssl")


def endpoints(text: Column) -> Column:
    """All ip:port pairs of a line, as texts, in their order."""
    return F.regexp_extract_all(text, F.lit(patterns.ENDPOINT), F.lit(1))


def store_groups(lines: DataFrame) -> DataFrame:
    """(store_id, fed_group): the last role group named on one of the store's lines, else the first that stood above them.

    lines: file, line_no, store_id, own (the group on the line itself) and above (the last group seen in the file).
    """
    at = F.struct("file", "line_no")
    found = lines.where("store_id is not null").groupBy("store_id").agg(
        F.max_by("own", F.when(F.col("own").isNotNull(), at)).alias("own"), F.min_by("above", F.when(F.col("above").isNotNull(), at)).alias("above")
    )
    return found.select("store_id", F.coalesce("own", "above", F.lit("Unknown")).alias("fed_group"))


def dominant(counts: DataFrame, keys: list[str], name: str, n: str = "n") -> DataFrame:
    """Of counts(keys, name, n) the name with the greatest n for each key, the least name of equal ones."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(n), F.asc(name)))
    return counts.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
