"""Queries on features: outliers, clusters, models, scores, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import features, greedy, learning, outliers, parse, series
from tidewatch.plans.lines import _PARSED, _events
from tidewatch.plans.rollups import INC
from tidewatch.session import written
from tidewatch.sources.incidents import hour_of, incidents
from tidewatch.sources.profile import analyzer_for, profile_files
from tidewatch.sources.tables import table

RATIOS = ["error", "signup", "click", "view", "purchase"]


def _eight(spark, folder):
    return features.store_features8(incidents(spark, folder))


def store_features8(spark, folder):
    return _eight(spark, folder)


def store_features15(spark, folder):
    return features.store_features15(incidents(spark, folder), RATIOS)


def health_features8(spark, folder):
    return features.health_features(incidents(spark, folder).where("kind = 'disconnect'"))


def zscore_outliers(spark, folder):
    return outliers.zscores(_eight(spark, folder), "store_id", features.EIGHT, 2.0).withColumn("max_z", F.round("max_z", 6))


def iqr_mad_scores(spark, folder):
    return outliers.spread_scores(_eight(spark, folder), "store_id", features.EIGHT)


def minmax_scores(spark, folder):
    return outliers.min_max(_eight(spark, folder), "store_id", "total")


def dbscan_noise(spark, folder):
    return outliers.dbscan_noise(_eight(spark, folder), "store_id", features.EIGHT)


def iforest_votes(spark, folder):
    return outliers.isolation_forest(_eight(spark, folder), "store_id", features.EIGHT)


def lof_votes(spark, folder):
    return outliers.local_outlier_factor(_eight(spark, folder), "store_id", features.EIGHT).withColumn("score", F.round("score", 6))


def ocsvm_votes(spark, folder):
    return outliers.one_class_svm(_eight(spark, folder), "store_id", features.EIGHT)


def ensemble_votes(spark, folder):
    return outliers.ensemble(_eight(spark, folder), "store_id", features.EIGHT)


def weighted_ensemble(spark, folder):
    return outliers.weighted_ensemble(_eight(spark, folder), "store_id", features.EIGHT)


def feature_corr(spark, folder):
    """Correlations of feature pairs; 0 for a constant feature."""
    f = _eight(spark, folder)
    names = features.EIGHT
    sd = {c: F.stddev_pop(c) for c in names}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    one = f.agg(*[F.coalesce(F.round(F.try_divide(F.covar_pop(a, b), sd[a] * sd[b]), 6), F.lit(0.0)).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs]))
    return one.select(rows.alias("p")).select("p.*")


HEALTH = ["failures", "daily", "daily_var", "night_ratio", "weekend_ratio", "max_hourly", "bursts"]


def _health(spark, folder):
    """Features of stores with at least five failures, with their bursts, which are counted first."""
    down = incidents(spark, folder).where("kind = 'disconnect'")
    found = greedy.bursts(down, "store_id", "sec", 86_400, 3).groupBy("store_id").agg(F.count("*").alias("bursts"))
    rows = features.health_features(down).where("failures >= 5").join(found, "store_id", "left")
    return rows.withColumn("bursts", F.coalesce("bursts", F.lit(0))), HEALTH


def kmeans_stores(spark, folder):
    return learning.clusters(_eight(spark, folder), "store_id", features.EIGHT).select("store_id", "cluster")


def cluster_profiles(spark, folder):
    """The clusters' sizes, centers and what these look like."""
    f, cols = _health(spark, folder)
    return learning.health_profiles(learning.clusters(f, "store_id", cols, per=20), cols)


def cluster_silhouette(spark, folder):
    """One row: how well the stores' clusters are apart."""
    f = learning.clusters(_eight(spark, folder), "store_id", features.EIGHT)
    return spark.createDataFrame([(f.select("cluster").distinct().count(), learning.silhouette(f, features.EIGHT))], "clusters bigint, silhouette double")


def rf_importance(spark, folder):
    f, cols = _health(spark, folder)
    labelled = f.withColumn("label", (F.col("failures") > 14).cast("int"))
    return learning.importance(labelled, cols[1:], "label").withColumn("importance", F.round("importance", 6))


def risk_classifier(spark, folder):
    cols = ["total", "variance", "max_hourly", "min_hourly", "categories", "ips", "quick", "night_ratio", "delay_mean", "delay_std", *[f"{c}_ratio" for c in RATIOS]]
    return learning.risk(features.store_features15(incidents(spark, folder), RATIOS), "store_id", cols, "dominant")


def recurring_patterns(spark, folder):
    return learning.recurring_patterns(series.windows(series.hourly(incidents(spark, folder).where("kind = 'disconnect'"), hour_of())))


def granger_r2(spark, folder):
    """Whether reconnects explain disconnects beyond their own past, by hours with zeros."""
    rows = incidents(spark, folder)
    down, up = (rows.where(f"kind = '{k}'") for k in ("disconnect", "reconnect"))
    a, b = series.hourly(down, hour_of(), gaps_as_zero=True), series.hourly(up, hour_of(), gaps_as_zero=True)
    return learning.granger(a, a.select("hour", "idx").join(b.select("hour", "x"), "hour").select("idx", "x"))


def risk_validation(spark, folder):
    """Accuracy and balanced accuracy of the risk forest on held-out folds."""
    cols = ["total", "variance", "max_hourly", "min_hourly", "categories", "ips", "quick", "night_ratio", "delay_mean", "delay_std", *[f"{c}_ratio" for c in RATIOS]]
    return learning.risk_validation(features.store_features15(incidents(spark, folder), RATIOS), "store_id", cols, "dominant")


def ensemble_agreement(spark, folder):
    return outliers.agreement(ensemble_votes(spark, folder))


def top_anomalies(spark, folder):
    """The 20 anomalous stores of the weighted ensemble, by confidence, then incidents."""
    found = weighted_ensemble(spark, folder).where("label = -1").join(_eight(spark, folder).select("store_id", "total"), "store_id")
    return found.orderBy(F.desc("confidence"), F.desc("total"), "store_id").limit(20)


def eval_anomalies(spark, folder):
    """The weighted ensemble against stores with a z-score above 2."""
    flags = zscore_outliers(spark, folder)
    truth = flags.select("store_id", F.when(F.col("flag"), -1).otherwise(1).alias("label"))
    return learning.anomaly_scores(weighted_ensemble(spark, folder), truth, "store_id")


def _messages(spark, folder):
    """The whole lines; parse_lines alone shortens them."""
    return _events(spark, folder).where("category is not null").select(F.xxhash64("file", "line_no").alias("id"), F.col("text").alias("message"), "category")


def tfidf_terms(spark, folder):
    return learning.term_frequencies(_messages(spark, folder), "message").where("documents >= 2")


def tfidf_norms(spark, folder):
    """The number of terms and the squared norm of each message's vector, a check of the features."""
    from pyspark.ml.functions import vector_to_array

    f, _ = learning.text_features(_messages(spark, folder), "message")
    a = vector_to_array("tfidf")
    return f.select("id", F.size(F.filter(a, lambda x: x > 0)).alias("terms"), F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))


def _features(spark, folder):
    """(id, category, tfidf) of the messages, written once."""
    f, _ = learning.text_features(written(_messages(spark, folder), "messages"), "message")
    return written(f.select("id", "category", "tfidf"), "tfidf")


def svd_components(spark, folder):
    return learning.components(_features(spark, folder), "tfidf")


def mlp_labels(spark, folder):
    f, size = learning.reduced(_features(spark, folder), "tfidf")
    return learning.perceptron(written(f, "reduced"), "id", "tfidf", "category", size)


def mlp_validation(spark, folder):
    f, size = learning.reduced(_features(spark, folder), "tfidf")
    return learning.perceptron_validation(f, "id", "tfidf", "category", size)


def mlp_importance(spark, folder):
    f, size = learning.reduced(_features(spark, folder), "tfidf")
    return learning.permutation_importance(written(f, "reduced"), "id", "tfidf", "category", size)


def eval_weighted(spark, folder):
    """The weighted means of eval_prf over the categories."""
    return learning.weighted_scores(eval_prf(spark, folder))


def eval_prf(spark, folder):
    """Precision and recall of the category against the severity's usual category, on all messages."""
    e = _events(spark, folder).where("category is not null and severity is not null").select("category", "severity")
    usual = parse.dominant(
        e.groupBy("severity", "category").agg(F.count("*").alias("n")),
        ["severity"],
        "category",
    ).select("severity", F.col("category").alias("said"))
    return learning.scores(e.join(usual, "severity"), "category", "said")


def dataset_profile(spark, folder):
    return profile_files(table(spark, folder, "log_files"))


def analyzer_choice(spark, folder):
    """The reference sizes at which another way of analysing is chosen."""
    cases = [
        (0.5, 100, 1.0, 8.0),
        (3.0, 600, 6.0, 32.0),
        (3.0, 600, 9.0, 1.0),
        (12.0, 900, 20.0, 64.0),
        (1.0, 20_000, 3.0, 64.0),
        (60.0, 10, 60.0, 64.0),
        (0.5, 100, 20.0, 4.0),
    ]
    rows = spark.createDataFrame(cases, "size_gb double, files int, unpacked_gb double, memory_gb double")
    return rows.withColumn("choice", analyzer_for(F.col("size_gb"), F.col("files"), F.col("unpacked_gb"), F.col("memory_gb")))


QUERIES = {
    f.__name__: f
    for f in (
        store_features8, store_features15, health_features8, zscore_outliers, iqr_mad_scores, minmax_scores, dbscan_noise, iforest_votes, lof_votes, ocsvm_votes, ensemble_votes, weighted_ensemble, feature_corr,
        kmeans_stores, cluster_profiles, cluster_silhouette, rf_importance, risk_classifier, recurring_patterns, granger_r2, tfidf_terms, tfidf_norms, svd_components, mlp_labels, mlp_validation, mlp_importance, eval_prf, eval_weighted, risk_validation, ensemble_agreement, top_anomalies, eval_anomalies,
        dataset_profile, analyzer_choice,
    )
}

_H = "CAST(floor(sec / 3600) AS BIGINT)"
_BYH = f"bh AS (SELECT store_id, var_pop(n) AS variance, max(n) AS max_hourly, min(n) AS min_hourly, sum(CASE WHEN hour % 24 >= 22 OR hour % 24 < 6 THEN n ELSE 0 END) AS night FROM (SELECT store_id, {_H} AS hour, count(*) AS n FROM {{rows}} GROUP BY 1, 2) GROUP BY 1)"
_F8 = f"""{INC}, {_BYH.format(rows='inc')}, gp AS (SELECT store_id, avg(gap) AS g, min(gap) AS m, avg(CASE WHEN gap < 3600 THEN 1.0 WHEN gap IS NOT NULL THEN 0.0 END) AS b FROM (SELECT store_id, sec - lag(sec) OVER (PARTITION BY store_id ORDER BY sec, event_id) AS gap FROM inc) GROUP BY 1),
f AS (SELECT store_id, CAST(t.total AS DOUBLE) AS total, round(variance, 6) AS variance, CAST(max_hourly AS DOUBLE) AS max_hourly, CAST(categories AS DOUBLE) AS categories, CAST(ips AS DOUBLE) AS ips, round(coalesce(g / 3600, 0.0), 6) AS mean_interval_h, CAST(coalesce(m, 0) AS DOUBLE) AS min_interval, round(coalesce(b, 0.0), 6) AS burst_score
FROM (SELECT store_id, count(*) AS total, count(DISTINCT category) AS categories, count(DISTINCT ip) AS ips FROM inc GROUP BY 1 HAVING count(*) >= 3) t JOIN bh USING (store_id) JOIN gp USING (store_id))"""
_LONG = f"{_F8}, l AS (" + " UNION ALL ".join(
    f"SELECT store_id, '{c}' AS c, {c} AS x FROM f" for c in features.EIGHT
) + "), st AS (SELECT c, avg(x) AS m, stddev_pop(x) AS sd, quantile_cont(x, 0.25) AS lo, quantile_cont(x, 0.5) AS mid, quantile_cont(x, 0.75) AS hi FROM l GROUP BY 1)"
_SCALED = f"{_LONG}, s AS (SELECT store_id, c, (x - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS x FROM l JOIN st USING (c)), ds AS (SELECT a.store_id AS a, b.store_id AS b, round(sqrt(sum((a.x - b.x) * (a.x - b.x))), 6) AS d FROM s a JOIN s b USING (c) GROUP BY 1, 2)"

SQL = {
    "store_features8": f"WITH {_F8} SELECT * FROM f",
    "store_features15": f"""WITH {INC}, {_BYH.format(rows='inc')}, dm AS (SELECT store_id, category AS dominant FROM inc GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY count(*) DESC, category) = 1),
t AS (SELECT store_id, count(*) AS total, count(DISTINCT category) AS categories, count(DISTINCT ip) AS ips, avg(CASE WHEN delay < 60 THEN 1 ELSE 0 END) AS quick, avg(delay) AS delay_mean, stddev_pop(delay) AS delay_std, {', '.join(f"avg(CASE WHEN category = '{c}' THEN 1 ELSE 0 END) AS {c}_ratio" for c in RATIOS)} FROM inc GROUP BY 1 HAVING count(*) >= 5)
SELECT store_id, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in ['total', 'variance', 'max_hourly', 'min_hourly', 'categories', 'ips', 'quick', 'delay_mean', 'delay_std', *[f'{c}_ratio' for c in RATIOS]])}, round(night / total, 6) AS night_ratio, dominant FROM t JOIN bh USING (store_id) JOIN dm USING (store_id)""",
    "health_features8": f"""WITH {INC}, {_BYH.format(rows='down')}, dd AS (SELECT store_id, avg(n) AS daily, coalesce(var_samp(n), 0) AS daily_var FROM (SELECT store_id, floor(sec / 86400) AS day, count(*) AS n FROM down GROUP BY 1, 2) GROUP BY 1),
mm AS (SELECT store_id, machine FROM down GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY count(*) DESC, machine) = 1),
t AS (SELECT store_id, count(*) AS failures, avg(CASE WHEN hour(ts) >= 22 OR hour(ts) < 6 THEN 1 ELSE 0 END) AS night_ratio, avg(CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END) AS weekend_ratio FROM down GROUP BY 1)
SELECT store_id, failures, round(daily, 6) AS daily, round(daily_var, 6) AS daily_var, round(night_ratio, 6) AS night_ratio, round(weekend_ratio, 6) AS weekend_ratio, max_hourly, machine FROM t JOIN dd USING (store_id) JOIN mm USING (store_id) JOIN bh USING (store_id)""",
    "zscore_outliers": f"WITH {_LONG} SELECT store_id, round(CASE WHEN min(sd) > 0 THEN max(abs(x - m) / sd) END, 6) AS max_z, coalesce(CASE WHEN min(sd) > 0 THEN max(abs(x - m) / sd) END > 2, false) AS flag FROM l JOIN st USING (c) GROUP BY 1",
    "iqr_mad_scores": f"""WITH {_LONG}, md AS (SELECT c, quantile_cont(abs(x - mid), 0.5) AS mad FROM l JOIN st USING (c) GROUP BY 1)
SELECT store_id, round(CASE WHEN min(sd) > 0 AND max(abs(x - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END) > 3 THEN 0.4 ELSE 0.0 END + sum(CASE WHEN x < lo - 1.5 * (hi - lo) OR x > hi + 1.5 * (hi - lo) THEN 0.3 / 8 ELSE 0 END) + sum(CASE WHEN mad > 0 AND abs(0.6745 * (x - mid)) > 3.5 * mad THEN 0.3 / 8 ELSE 0 END), 6)::DOUBLE AS score
FROM l JOIN st USING (c) JOIN md USING (c) GROUP BY 1""",
    "minmax_scores": f"WITH {_F8} SELECT store_id, CASE WHEN max(total) OVER () > min(total) OVER () THEN round((total - min(total) OVER ()) / (max(total) OVER () - min(total) OVER ()), 6) ELSE 0.0 END AS scaled FROM f",
    "dbscan_noise": f"""WITH {_SCALED}, nn AS (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d) AS r FROM ds), ep AS (SELECT quantile_cont(d, 0.9) AS eps FROM nn WHERE r = 5),
co AS (SELECT a FROM ds, ep WHERE d <= eps GROUP BY 1 HAVING count(*) >= 3) SELECT a AS store_id, count(*) FILTER (d <= eps AND b IN (SELECT a FROM co)) = 0 AS flag FROM ds, ep GROUP BY 1""",
    "lof_votes": f"""WITH {_LONG}, s AS (SELECT store_id, c, (x - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS x FROM l JOIN st USING (c)), d AS (SELECT a.store_id AS a, b.store_id AS b, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS d FROM s a JOIN s b ON a.c = b.c AND a.store_id <> b.store_id GROUP BY 1, 2),
k AS (SELECT least(20, count(DISTINCT a) - 1) AS k FROM d), nb AS (SELECT a, b, d FROM d, k QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= k.k), kd AS (SELECT a, max(d) AS kd FROM nb GROUP BY 1),
de AS (SELECT nb.a, 1 / (avg(greatest(nb.d, kd.kd)) + 1e-10) AS den FROM nb JOIN kd ON kd.a = nb.b GROUP BY 1), lf AS (SELECT nb.a AS store_id, avg(o.den) / any_value(me.den) AS f FROM nb JOIN de o ON o.a = nb.b JOIN de me ON me.a = nb.a GROUP BY 1)
SELECT store_id, round(f, 6) AS score, f > (SELECT quantile_cont(f, 0.9) FROM lf) AS flag FROM lf""",
    "feature_corr": f"WITH {_F8} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, coalesce(round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 6), 0.0) AS r FROM f" for i, a in enumerate(features.EIGHT) for b in features.EIGHT[i + 1 :]),
    "dataset_profile": """WITH f AS (SELECT DISTINCT ON (file_id) * FROM log_files ORDER BY file_id) SELECT server, CAST(sum(n_bytes) AS BIGINT) AS total_size_bytes, count(*) + count(DISTINCT container) AS total_files, count(*) FILTER (path LIKE '%.log') AS log_files,
count(DISTINCT regexp_replace(container, '!/.*$', '')) AS zip_files, count(DISTINCT CASE WHEN contains(container, '!/') THEN container END) AS nested_zip_files, count(*) FILTER (content IS NULL) AS unreadable FROM f GROUP BY 1""",
}
_MSG = f"{_PARSED}, ms AS (SELECT t AS message, category, severity FROM e WHERE category IS NOT NULL)"
SQL["tfidf_terms"] = f"WITH {_MSG}, w AS (SELECT rowid_, unnest(list_distinct(list_filter(regexp_split_to_array(lower(message), '[^a-z0-9_]+'), lambda x: x <> ''))) AS term FROM (SELECT *, row_number() OVER () AS rowid_ FROM ms)) SELECT term, count(*) AS documents FROM w GROUP BY 1 HAVING count(*) >= 2"
SQL["eval_prf"] = f"""WITH {_MSG}, b AS (SELECT * FROM ms WHERE severity IS NOT NULL), u AS (SELECT severity, category AS said FROM b GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY severity ORDER BY count(*) DESC, category) = 1),
j AS (SELECT category, said FROM b JOIN u USING (severity)), t AS (SELECT category AS label, count(*) AS support, count(*) FILTER (category = said) AS hit FROM j GROUP BY 1), pr AS (SELECT said AS label, count(*) AS said FROM j GROUP BY 1),
m AS (SELECT label, support, coalesce(hit / nullif(said, 0), 0.0) AS precision, hit / support AS recall FROM t LEFT JOIN pr USING (label))
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0), 6) AS f1, support FROM m"""
SQL["analyzer_choice"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({a}::DOUBLE, {b}::INTEGER, {c}::DOUBLE, {d}::DOUBLE, '{e}')" for a, b, c, d, e in (
        (0.5, 100, 1.0, 8.0, "full"),
        (3.0, 600, 6.0, 32.0, "full"),
        (3.0, 600, 9.0, 1.0, "streaming"),
        (12.0, 900, 20.0, 64.0, "streaming"),
        (1.0, 20_000, 3.0, 64.0, "streaming"),
        (60.0, 10, 60.0, 64.0, "streaming"),
        (0.5, 100, 20.0, 4.0, "streaming"),
    )
) + ") v(size_gb, files, unpacked_gb, memory_gb, choice)"
SQL["eval_weighted"] = f"""SELECT round(sum(precision * support) / sum(support), 5) AS precision, round(sum(recall * support) / sum(support), 5) AS recall, round(sum(f1 * support) / sum(support), 5) AS f1,
CAST(sum(support) AS BIGINT) AS rows FROM ({SQL["eval_prf"]})"""
