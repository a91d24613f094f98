"""Queries on the hourly series of disconnects."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import series
from tidewatch.plans.rollups import INC
from tidewatch.sources.incidents import hour_of, incidents


def _series(spark, folder):
    return series.hourly(incidents(spark, folder).where("kind = 'disconnect'"), hour_of())


def _rounded(df, *keep):
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in keep or df.columns])


def moving_avg24(spark, folder):
    return _rounded(series.moving_average(_series(spark, folder)), "idx", "trend")


def decompose24(spark, folder):
    return _rounded(series.decompose(_series(spark, folder)), "idx", "trend", "seasonal", "residual")


def forecast24(spark, folder):
    return _rounded(series.forecast(_series(spark, folder)))


def cusum_scores(spark, folder):
    return _rounded(series.cusum(_series(spark, folder)), "idx", "up", "down")


def change_points(spark, folder):
    return series.change_points(_series(spark, folder))


def trend_half(spark, folder):
    return _rounded(series.half_trend(_series(spark, folder)))


def autocorr48(spark, folder):
    return _rounded(series.autocorrelation(_series(spark, folder)))


def periodicity(spark, folder):
    return _rounded(series.periodicity(_series(spark, folder), least=0.05))


def seq_windows24(spark, folder):
    w = series.windows(_series(spark, folder))
    return w.select(
        "idx",
        F.aggregate("seq", F.lit(0.0), lambda a, b: a + b).alias("total"),
        F.array_max("seq").alias("most"),
        F.array_join(F.transform("seq", lambda x: x.cast("int").cast("string")), ",").alias("seq"),
    )


def analog_forecast(spark, folder):
    return _rounded(series.analog_forecast(_series(spark, folder)))


def hour_outliers(spark, folder):
    return series.outliers(_series(spark, folder))


def filled_series_days(spark, folder):
    """Days of the series with hours without disconnects as 0."""
    s = series.hourly(incidents(spark, folder).where("kind = 'disconnect'"), hour_of(), gaps_as_zero=True)
    return s.groupBy(F.floor(F.col("hour") / 24).cast("bigint").alias("day")).agg(
        F.count("*").alias("hours"),
        F.sum("x").alias("x"),
        F.count_if(F.col("x") == 0).alias("quiet"),
    )


QUERIES = {
    f.__name__: f for f in (
        moving_avg24,
        decompose24,
        forecast24,
        cusum_scores,
        change_points,
        trend_half,
        autocorr48,
        periodicity,
        seq_windows24,
        analog_forecast,
        hour_outliers,
        filled_series_days,
    )
}

_S = f"{INC}, s AS (SELECT row_number() OVER (ORDER BY hour) - 1 AS idx, hour, x FROM (SELECT CAST(floor(sec / 3600) AS BIGINT) AS hour, CAST(count(*) AS DOUBLE) AS x FROM down GROUP BY 1))"
_M = f"""{_S}, k AS (SELECT count(*) AS n, arg_min(x, idx) AS a, arg_max(x, idx) AS z FROM s), pad AS (SELECT s.idx, o.o, coalesce(b.x, CASE WHEN s.idx + o.o < 0 THEN k.a ELSE k.z END) AS v FROM s CROSS JOIN range(-12, 12) o(o) CROSS JOIN k LEFT JOIN s b ON b.idx = s.idx + o.o),
tr AS (SELECT idx, avg(v) AS trend FROM pad GROUP BY 1)"""
_D = f"""{_M}, d0 AS (SELECT idx, x, trend, avg(x - trend) OVER (PARTITION BY idx % 24) AS seasonal FROM s JOIN tr USING (idx)), d AS (SELECT *, x - trend - seasonal AS residual FROM d0)"""
_C = f"""{_S}, z AS (SELECT idx, CASE WHEN idx = 0 THEN 0 ELSE z END AS z, CASE WHEN idx = 0 THEN 0 ELSE 0.5 END AS dr FROM (SELECT idx, (x - avg(x) OVER ()) / CASE WHEN stddev_pop(x) OVER () = 0 THEN 1 ELSE stddev_pop(x) OVER () END AS z FROM s)),
cu AS (SELECT 0::BIGINT AS idx, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down UNION ALL SELECT z.idx, greatest(0.0, cu.up + z.z - z.dr), greatest(0.0, cu.down - z.z - z.dr) FROM cu JOIN z ON z.idx = cu.idx + 1)"""
_AC = f"""{_S}, f AS (SELECT idx, x - avg(x) OVER () AS c, count(*) OVER () AS n, var_pop(x) OVER () AS v FROM s), ac AS (SELECT CAST(l AS INTEGER) AS lag, sum(a.c * b.c) / max(a.n * a.v) AS r FROM range(1, 49) r(l) JOIN f a ON l <= a.n // 2 - 1 JOIN f b ON b.idx = a.idx + l GROUP BY 1)"""
_R = "round({0}, 6) AS {0}"

SQL = {
    "moving_avg24": f"WITH {_M} SELECT idx, round(trend, 6) AS trend FROM tr",
    "decompose24": f"WITH {_D} SELECT idx, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(residual, 6) AS residual FROM d",
    "forecast24": f"""WITH {_D}, k2 AS (SELECT count(*) AS n, arg_min(trend, idx) AS a, arg_max(trend, idx) AS z, stddev_pop(residual) AS sd FROM d), se AS (SELECT idx % 24 AS at, any_value(seasonal) AS s FROM d GROUP BY 1),
v AS (SELECT h, greatest(0.0, z + (z - a) / n * h + s) AS value, 1.959964 * sd * sqrt(h) AS w FROM range(1, 25) r(h) CROSS JOIN k2 JOIN se ON se.at = (n + h - 1) % 24) SELECT h, round(value, 6) AS value, round(greatest(0.0, value - w), 6) AS low, round(value + w, 6) AS high FROM v""",
    "cusum_scores": f"WITH RECURSIVE {_C} SELECT idx, round(up, 6) AS up, round(down, 6) AS down FROM cu",
    "change_points": f"""WITH RECURSIVE {_C}, over AS (SELECT idx FROM cu WHERE up > 2 OR down > 2), kept AS (SELECT min(idx) AS idx FROM over UNION ALL SELECT (SELECT min(o.idx) FROM over o WHERE o.idx > kept.idx + 3) FROM kept WHERE (SELECT min(o.idx) FROM over o WHERE o.idx > kept.idx + 3) IS NOT NULL) SELECT idx FROM kept""",
    "trend_half": f"""WITH {_S}, h AS (SELECT avg(x) FILTER (idx < n // 2) AS first, avg(x) FILTER (idx >= n // 2) AS second FROM (SELECT *, count(*) OVER () AS n FROM s))
SELECT round(first, 6) AS first, round(second, 6) AS second, CASE WHEN second > first * 1.2 THEN 'increasing' WHEN second < first * 0.8 THEN 'decreasing' ELSE 'stable' END AS trend FROM h""",
    "autocorr48": f"WITH {_AC} SELECT lag, round(r, 6) AS r FROM ac",
    "periodicity": f"""WITH {_AC}, p AS (SELECT *, lag(r) OVER (ORDER BY lag) AS b, lead(r) OVER (ORDER BY lag) AS a FROM ac) SELECT lag, round(r, 6) AS r FROM p
WHERE (r > b AND r > a AND r >= 0.05) OR (lag = 24 AND r > 0.05) ORDER BY CASE WHEN r > b AND r > a AND r >= 0.05 THEN lag ELSE lag + 1000 END LIMIT 1""",
    "seq_windows24": f"WITH {_S} SELECT a.idx, sum(b.x) AS total, max(b.x) AS most, string_agg(CAST(CAST(b.x AS INTEGER) AS VARCHAR), ',' ORDER BY b.idx) AS seq FROM s a JOIN s b ON b.idx BETWEEN a.idx AND a.idx + 23 WHERE a.idx < (SELECT count(*) FROM s) - 24 GROUP BY 1",
    "analog_forecast": f"""WITH {_S}, k AS (SELECT count(*) AS n FROM s), m AS (SELECT a.idx, b.idx - a.idx AS o, b.x AS v, l.x AS w FROM s a CROSS JOIN k JOIN s b ON b.idx BETWEEN a.idx AND a.idx + 23 JOIN s l ON l.idx = k.n - 24 + b.idx - a.idx WHERE a.idx < k.n - 48),
c AS (SELECT idx, (avg(v * w) - avg(v) * avg(w)) / CASE WHEN stddev_pop(v) = 0 THEN 1 ELSE stddev_pop(v) END / CASE WHEN stddev_pop(w) = 0 THEN 1 ELSE stddev_pop(w) END AS r FROM m GROUP BY 1),
wt AS (SELECT idx, pow(greatest(r, 0.0), 2) / (sum(pow(greatest(r, 0.0), 2)) OVER () + 1e-10) AS w FROM c)
SELECT h, round(coalesce(sum(w * s.x), 0.0), 6) AS value FROM range(0, 24) r(h) LEFT JOIN (SELECT * FROM wt WHERE w > 0.01) wt ON true LEFT JOIN s ON s.idx = wt.idx + 24 + h GROUP BY 1""",
    "hour_outliers": f"""WITH {_S}, k AS (SELECT avg(x) AS m, stddev_pop(x) AS sd, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM s), f AS (SELECT idx, hour, x, abs(x - m) > 2.5 * sd AS z, x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a) AS q FROM s CROSS JOIN k)
SELECT idx, hour, x, CASE WHEN z AND q THEN 'Z-score+IQR' WHEN z THEN 'Z-score' ELSE 'IQR' END AS method FROM f WHERE z OR q""",
    "filled_series_days": f"""WITH {_S}, g AS (SELECT unnest(range((SELECT min(hour) FROM s), (SELECT max(hour) FROM s) + 1)) AS hour) SELECT CAST(floor(g.hour / 24) AS BIGINT) AS day, count(*) AS hours, sum(coalesce(x, 0.0)) AS x, count(*) FILTER (coalesce(x, 0) = 0) AS quiet FROM g LEFT JOIN s USING (hour) GROUP BY 1""",
}
