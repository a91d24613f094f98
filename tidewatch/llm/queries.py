"""The queries p6_ to p9_ on the whole tables, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.keys import store_key
from tidewatch.llm import quantiles
from tidewatch.llm.encode import token_ids
from tidewatch.llm.mixing import choose, shares
from tidewatch.llm.splitting import pieces
from tidewatch.operators.eager_aggregate import once
from tidewatch.session import written
from tidewatch.sources.tables import table

LIMITS = {50: (0.5, 3_600.0), 95: (0.95, 21_600.0)}
LEAST_DURATIONS = 20


def _durations(spark: SparkSession, folder: str) -> DataFrame:
    """(store_id, server, day, duration_s) of usable durations, each span_id once; those without one stay."""
    rows = table(spark, folder, "outage_spans").where("store_duration_s > 0 and store_duration_s < 604800")
    rows = rows.select(
        "span_id",
        "server",
        store_key(F.col("store_id")).alias("store_id"),
        F.to_date("store_last_disconnect").alias("day"),
        F.col("store_duration_s").alias("duration_s"),
    )
    return once(rows.where("store_id is not null"), "span_id", "server", "store_id", "day", "duration_s").drop("span_id")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """From the merged states; stores whose bounds lie on both sides of a limit, if there are any, are settled by an exact check."""
    rows = _durations(spark, folder)
    states = quantiles.merged(quantiles.states(rows, ["store_id"], "duration_s"), ["store_id"])
    wanted = {f"p{pct}": p for pct, (p, _) in LIMITS.items()}
    found = written(quantiles.quantiles(states, ["store_id"], wanted).where(F.col("n") >= LEAST_DURATIONS), "percentiles")
    each = F.array(
        *[
            F.struct(
                F.lit(pct).alias("pct"),
                F.lit(p).alias("p"),
                F.lit(limit).alias("limit"),
                F.col(f"p{pct}_low").alias("low"),
                F.col(f"p{pct}_high").alias("high"),
            ) for pct, (p, limit) in LIMITS.items()
        ]
    )
    long = found.select("store_id", F.explode(each).alias("x")).select("store_id", "x.*")
    sure = long.where("low > limit").select("store_id", "pct")
    undecided = long.where("low <= limit and high > limit").select("store_id", "pct", "p", "limit")
    if undecided.isEmpty():
        return sure
    return sure.unionByName(quantiles.exceeds(rows.join(undecided, "store_id"), ["store_id", "pct"], "duration_s", "p", "limit"))


def p6_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles by store and server from the states of single days, with their error in ranks."""
    days = quantiles.states(_durations(spark, folder), ["store_id", "server", "day"], "duration_s")
    return quantiles.quantiles(quantiles.merged(days, ["store_id", "server"]), ["store_id", "server"], {"p50": 0.5, "p95": 0.95})


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return token_ids(table(spark, folder, "documents"), "doc_id", "text")


def p8_mix_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of each wanted source in each mix, beside its target."""
    chosen, plan = choose(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))
    return shares(chosen, plan)


def p8_mix_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of each mix and how often each is repeated."""
    chosen, _ = choose(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))
    return chosen.groupBy("mix", "source", "doc_id").agg(F.count(F.lit(1)).alias("times"))


def p8_bytes_shares(spark: SparkSession, folder: str) -> DataFrame:
    """As p8_mix_shares, of sizes in bytes, which SQL can count too."""
    chosen, plan = choose(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), size=F.octet_length("text"))
    return shares(chosen, plan).withColumn("target_share", F.round("target_share", 9)).withColumn("actual_share", F.round("actual_share", 9))


def p8_bytes_documents(spark: SparkSession, folder: str) -> DataFrame:
    """As p8_mix_documents, of sizes in bytes."""
    chosen, _ = choose(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), size=F.octet_length("text"))
    return chosen.groupBy("mix", "source", "doc_id").agg(F.count(F.lit(1)).alias("times"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    found = pieces(table(spark, folder, "documents"), "doc_id", "text", "cell_starts", with_text=False)
    return found.where("piece_no = 1").select("doc_id")


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces(table(spark, folder, "documents"), "doc_id", "text", "cell_starts")


QUERIES = {f.__name__: f for f in (p6_found, p6_percentiles, p7_ids, p8_mix_shares, p8_mix_documents, p8_bytes_shares, p8_bytes_documents, p9_found, p9_pieces)}

_STORE = "lpad(nullif(regexp_extract(store_id, '(?:^|[^0-9])([0-9]{4,5})(?:$|[^0-9])', 1), ''), 5, '0')"
_MIX = r"""
s AS (SELECT doc_id, nullif(lower(regexp_replace(source, '[\W_]+', '', 'g')), '') AS source, coalesce(strlen(text), 0) AS n FROM documents),
t AS (SELECT mix_name AS mix, source AS name, nullif(lower(regexp_replace(source, '[\W_]+', '', 'g')), '') AS source, target_weight, max_repeats, size_ratio FROM mix_targets),
b AS (SELECT mix, CAST(floor(greatest(coalesce(max(CASE WHEN isnan(size_ratio) THEN 0 ELSE size_ratio END), 0), 0) * CAST((SELECT sum(n) FROM s) AS DOUBLE)) AS BIGINT) AS budget FROM t GROUP BY 1),
w AS (SELECT mix, source, min(name) AS name, max(target_weight) AS weight, max(max_repeats) AS repeats FROM t WHERE source IS NOT NULL AND target_weight > 0 AND NOT isnan(target_weight) AND max_repeats > 0 GROUP BY 1, 2),
d AS (SELECT source, doc_id, n, md5(doc_id || ':7') AS o, sum(n) OVER (PARTITION BY source) AS tokens, sum(n) OVER (PARTITION BY source ORDER BY md5(doc_id || ':7'), doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM s WHERE n > 0 AND source IS NOT NULL),
r AS (SELECT mix, source, doc_id, n, o, tokens, upto, weight, budget, unnest(range(repeats)) AS k FROM d JOIN w USING (source) JOIN b USING (mix)),
q AS (SELECT *, sum(n) OVER (PARTITION BY mix ORDER BY CAST(k * tokens + upto AS DOUBLE) / weight, o, doc_id, k ROWS UNBOUNDED PRECEDING) AS total FROM r),
c AS (SELECT mix, source, doc_id, count(*) AS times, sum(n) AS n FROM q WHERE total <= budget GROUP BY 1, 2, 3)"""
SQL: dict[str, str] = {
    "p6_found": f"""WITH u AS (SELECT span_id, min({_STORE}) AS store_id, min(store_duration_s) AS v FROM outage_spans WHERE store_duration_s > 0 AND store_duration_s < 604800 GROUP BY span_id),
q AS (SELECT store_id, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.95) AS p95 FROM u WHERE store_id IS NOT NULL GROUP BY store_id HAVING count(*) >= 20)
SELECT store_id, 50 AS pct FROM q WHERE p50 > 3600 UNION ALL SELECT store_id, 95 FROM q WHERE p95 > 21600""",
    "p8_bytes_documents": f"WITH {_MIX} SELECT mix, source, doc_id, times FROM c",
    "p8_bytes_shares": f"""WITH {_MIX}, g AS (SELECT mix, source, CAST(sum(n) AS BIGINT) AS chosen_tokens, count(*) AS chosen_docs, max(times) AS most_times FROM c GROUP BY 1, 2)
SELECT mix, name AS source, round(weight / sum(weight) OVER (PARTITION BY mix), 9) AS target_share, CAST(repeats AS BIGINT) AS max_repeats, budget, coalesce(chosen_tokens, 0) AS chosen_tokens, coalesce(chosen_docs, 0) AS chosen_docs,
coalesce(most_times, 0) AS most_times, coalesce(round(chosen_tokens / sum(chosen_tokens) OVER (PARTITION BY mix), 9), 0.0) AS actual_share FROM w JOIN b USING (mix) LEFT JOIN g USING (mix, source)""",
}
