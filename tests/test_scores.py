"""Scores and models: worked by hand from the rules, or against brute force."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidewatch.operators import learning, outages, outliers, parse, scoring, series
from tidewatch.plans.rollups import pivoted


def test_failure_probability(spark):
    cols = "recent_errors int, error_variance double, error_types int, trend string, burst_count int"
    rows = [(100, 50.0, 5, "increasing", 10), (900, 500.0, 50, "increasing", 100), (0, 0.0, 0, "decreasing", 0), (50, 25.0, 1, "stable", 5), (None, None, None, None, None)]
    got = [r.probability for r in scoring.failure_probability(spark.createDataFrame(rows, cols)).collect()]
    sigma = lambda x: 1 / (1 + math.exp(-5 * (x - 0.5)))
    assert got == pytest.approx([sigma(1), sigma(1), sigma(0), sigma((15 + 10 + 3 + 5 + 7.5) / 100), sigma(0)])
    assert round(got[0], 6) == 0.924142
    some = spark.createDataFrame([(50, 2)], "recent_errors int, error_types int")
    assert scoring.failure_probability(some).first().probability == pytest.approx(sigma((15 + 6) / 45))
    assert scoring.failure_probability(spark.createDataFrame([(1,)], "x int")).first().probability == 0.5


def test_root_causes(spark):
    errors = spark.createDataFrame([("connection_timeout", 10), (None, 99)], "category string, n bigint")
    machines = spark.createDataFrame([("m", 200)], "machine string, stores bigint")
    got = {r.cause: (r.probability, r.evidence) for r in scoring.root_causes(errors, machines.limit(0)).collect()}
    assert {k: v for k, (v, _) in got.items()} == {"network_issue": 0.685714, "store_hardware": 0.142857, "server_overload": 0.114286}
    assert got["network_issue"][1] == "High timeout/socket errors (10)"
    assert scoring.root_causes(errors, machines).count() == 3  # 200 stores are no overload
    crowded = {r.cause: r.probability for r in scoring.root_causes(errors, spark.createDataFrame([("m", 201), ("k", 1)], "machine string, stores bigint")).collect()}
    assert crowded["server_overload"] == round(0.4 / 1.95, 6) and crowded["network_issue"] == round(1.2 / 1.95, 6)
    assert scoring.root_causes(errors.limit(0), machines).count() == 0 == scoring.root_causes(errors.where("category is null"), machines).count()


def test_machines(spark):
    rows = [("a", f"s{i % 10}") for i in range(100)] + [("b", None)] * 4 + [("c", f"t{i % 50}") for i in range(5_000)]
    df = spark.createDataFrame(rows, "machine string, store_id string")
    assert {r.machine: (r.score, r.band) for r in scoring.machine_health(df).collect()} == {"a": (79.9, "GOOD"), "b": (99.996, "GOOD"), "c": (0.0, "CRITICAL")}
    assert {r.machine: r.score for r in scoring.machine_health(df, 100.0).collect()}["a"] == 79.0
    uneven = {r.cause: r.probability for r in scoring.health_root_causes(scoring.machine_health(df)).collect()}
    assert uneven["server_overload"] == round(0.375 / 1.125, 6) and "external_dependency" not in uneven
    even = scoring.health_root_causes(scoring.machine_health(df.where("machine = 'a'")))
    assert {r.cause: r.probability for r in even.collect()}["server_overload"] == 0.25
    assert scoring.health_root_causes(scoring.machine_health(df.limit(0))).count() == 0


def test_trends_of_keys(spark):
    rows = [("up", h) for h in range(4) for _ in range(1 + 3 * (h > 1))] + [("down", h) for h in range(4) for _ in range(4 - 3 * (h > 1))] + [("one", 5)] * 3
    df = spark.createDataFrame(rows, "k string, h bigint")
    assert {r.k: r.trend for r in series.trend_by(df, ["k"], F.col("h")).collect()} == {"up": "increasing", "down": "decreasing", "one": "stable"}


def test_outages_of_servers_stay_apart(spark):
    df = spark.createDataFrame([("A", "7", 0, 0, "disconnect"), ("B", "7", 5, 1, "disconnect"), ("B", "7", 9, 2, "reconnect")], "server string, store_id string, sec bigint, event_id bigint, kind string")
    assert [tuple(r) for r in outages.pairs(df, ["server", "store_id"]).collect()] == [("B", "7", 5, 9, 4)]


def test_variants_of_rules(spark):
    df = spark.createDataFrame([("(Warning) Exception: connection timed out",), ("(Error) connection refused",), ("SSL exception",), ("plain",)], "t string")
    t = F.col("t")
    assert [tuple(r) for r in df.select(parse.error_type(t, "v2"), parse.error_type(t)).collect()] == [("warning", "exception"), ("error", "error"), (None, None), (None, None)]
    got = [tuple(r) for r in df.select(*[parse.error_family(t, v) for v in ("v1", "v2", "v3")]).collect()]
    assert got == [("connection_timeout", "timeout", None), ("connection_refused", "refused", None), ("tls_ssl_exception", "tls_ssl", "tls_ssl"), (None, None, None)]
    kinds = spark.createDataFrame([("initial sync context is null, online",), ("Initial sync context is null, online",)], "t string")
    assert [tuple(r) for r in kinds.select(parse.connection_kind(t), parse.connection_kind(t, broad=True)).collect()] == [("disconnect", "reconnect"), ("disconnect", "disconnect")]
    ips = spark.createDataFrame([("10.0.0.1:80 then 10.0.0.2:443",), ("none",)], "t string")
    assert [r[0] for r in ips.select(parse.endpoints(t)).collect()] == [["10.0.0.1:80", "10.0.0.2:443"], []]


def test_pivot_takes_every_name(spark):
    counts = spark.createDataFrame([(g, f"MS{s}", s) for g in "ab" for s in range(1, 6)] + [("a", None, 9), ("c", None, 1)], "g string, s string, n bigint")
    wide = pivoted(counts, "g", "s", "n")
    assert wide.columns == ["g", "MS1", "MS2", "MS3", "MS4", "MS5"] and sorted(map(tuple, wide.collect())) == [("a", 1, 2, 3, 4, 5), ("b", 1, 2, 3, 4, 5)]


def test_isolation_forest_and_svm_find_what_stands_apart(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(180, 3)), rng.normal(size=(20, 3)) * 0.2 + 9])
    df = spark.createDataFrame([(f"{i:03d}", *map(float, r)) for i, r in enumerate(x)], "k string, a double, b double, c double")
    scaled = outliers.scaled_rows(df, "k", ["a", "b", "c"])
    forest = {r.k: r for r in outliers.isolation_forest(df, "k", ["a", "b", "c"], scaled=scaled).collect()}
    ids, ref, _, _ = scaled
    # brute force: mean depth at which each row is alone in the same trees
    rng2, m = np.random.default_rng(42), 200
    trees = [outliers._isolation_tree(ref[rng2.choice(len(ref), m, replace=False)], 8, rng2) for _ in range(100)]

    def depth(tree, row):
        return tree if not isinstance(tree, tuple) else 1 + depth(tree[2] if row[tree[0]] < tree[1] else tree[3], row)

    usual = 2 * (math.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m
    for i in range(0, 200, 17):
        want = 2 ** (-np.mean([depth(t, ref[i]) for t in trees]) / usual)
        assert forest[ids[i]].score == pytest.approx(want, abs=1e-6)
    assert sum(r.flag for r in forest.values()) == 20
    svm = {r.k: r.flag for r in outliers.one_class_svm(df, "k", ["a", "b", "c"], steps=100_000).collect()}
    assert 10 <= sum(svm.values()) <= 30  # about nu of the rows
    alone = spark.createDataFrame([("x", 1.0)], "k string, a double")
    assert outliers.isolation_forest(alone, "k", ["a"]).count() == outliers.one_class_svm(alone, "k", ["a"]).count() == 1


def test_granger(spark):
    """One series drives the other three hours later; R² as from least squares on the same lags."""
    rng = np.random.default_rng(4)
    b = rng.normal(size=400)
    a = np.concatenate([rng.normal(size=3), 0.8 * b[:-3]]) + rng.normal(size=400) * 0.3
    frame = lambda v: spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "idx bigint, x double")
    got = learning.granger(frame(a), frame(b)).first()
    lagged = lambda v: np.stack([v[5 - k : len(v) - k] for k in range(1, 6)], axis=1)

    def r2(x):
        x = np.hstack([np.ones((len(x), 1)), x])
        rest = a[5:] - x @ np.linalg.lstsq(x, a[5:], rcond=None)[0]
        return 1 - rest.var() / a[5:].var()

    assert got.r2_own == pytest.approx(r2(lagged(a)), abs=1e-5) and got.r2_both == pytest.approx(r2(np.hstack([lagged(a), lagged(b)])), abs=1e-5)
    assert got.causes and not learning.granger(frame(b), frame(a)).first().causes


def test_clusters_and_their_profiles(spark):
    rng = np.random.default_rng(1)
    kinds = {"n": (200, 1, 1, 0.6, 0.1, 3, 1), "c": (150, 1, 1, 0.1, 0.1, 3, 1), "i": (40, 2, 80, 0.1, 0.1, 3, 0), "w": (30, 2, 2, 0.1, 0.8, 2, 0), "q": (9, 1, 1, 0.1, 0.1, 1, 0)}
    names = ["failures", "daily", "daily_var", "night_ratio", "weekend_ratio", "max_hourly", "bursts"]
    rows = [(f"{k}{i:02d}", *[float(v) * (1 + 0.01 * rng.normal()) for v in kinds[k]]) for k in kinds for i in range(40)]
    df = spark.createDataFrame(rows, "store_id string, " + ", ".join(f"{c} double" for c in names))
    found = learning.clusters(df, "store_id", names, per=20)
    got = {r.store_id: r.cluster for r in found.collect()}
    assert len({got[s] for s in got}) == 5 and all(len({got[f"{k}{i:02d}"] for i in range(40)}) == 1 for k in kinds)
    texts = {got[f"{k}00"]: k for k in kinds}
    said = {texts[r.cluster]: r.description for r in learning.health_profiles(found, names).collect()}
    assert said == {"n": "High-failure nocturnal pattern", "c": "Consistently problematic", "i": "Intermittent issues", "w": "Weekend-heavy failures", "q": "Normal/stable pattern"}
    assert learning.silhouette(found, names) > 0.9
    assert {r.cluster for r in learning.clusters(df.limit(5), "store_id", names).collect()} == {0}
    x = np.array([r[1:] for r in rows])
    v = np.array([r.v.toArray() for r in learning.standardised(df.orderBy("store_id"), names, "v").orderBy("store_id").collect()])
    order = np.argsort([r[0] for r in rows])
    assert np.allclose(v, ((x - x.mean(0)) / x.std(0))[order])


def test_axes_stay_those_of_all_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.random((200, 12)) * (rng.random((200, 12)) > 0.6)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, a array<double>").select("id", array_to_vector("a").alias("v"))
    values, axes = learning.principal_axes(df, "v", 5)
    assert np.allclose(values, np.linalg.svd(x, compute_uv=False)[:5])
    out, size = learning.reduced(df, "v", 5)
    got = np.array([r.v.toArray() for r in out.orderBy("id").collect()])
    assert size == 5 and np.allclose(got, x @ axes, atol=1e-5)


def _labelled(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "ab"[i % 2], *map(float, rng.normal(size=3) + [4 * (i % 2), 0, 0])) for i in range(300)]
    return spark.createDataFrame(rows, "id bigint, label string, x double, y double, z double")


def test_validation_and_importance(spark):
    df = _labelled(spark)
    got = learning.risk_validation(df, "id", ["x", "y", "z"], "label").collect()
    assert sorted(r.fold for r in got) == [0, 1, 2] and sum(r.rows for r in got) == 300 and all(r.accuracy > 0.9 and r.balanced_accuracy > 0.9 for r in got)
    vectors = df.select("id", "label", array_to_vector(F.array("x", "y", "z")).alias("v"))
    folds = learning.perceptron_validation(vectors, "id", "v", "label", 3).collect()
    assert sum(r.rows for r in folds) == 300 and all(r.accuracy > 0.9 for r in folds)
    weight = {r.feature: r.importance for r in learning.permutation_importance(vectors, "id", "v", "label", 3).collect()}
    assert set(weight) == {0, 1, 2} and weight[0] > 0.2 > max(abs(weight[1]), abs(weight[2]))


def test_scores_of_anomalies_and_labels(spark):
    found = spark.createDataFrame([("a", -1, 0.9), ("b", -1, 0.5), ("c", 1, 0.1), ("d", 1, 0.0)], "k string, label int, confidence double")
    truth = spark.createDataFrame([("a", -1), ("c", -1), ("b", 1)], "k string, label int")
    assert tuple(learning.anomaly_scores(found, truth, "k").first()) == (2, 0.5, 0.7, 0.5, 0.5, 0.5)
    assert tuple(learning.anomaly_scores(found.where("label = 1"), truth.limit(0), "k").first()) == (0, 0.0, 0.0, 0.0, 0.0, 0.0)
    per = learning.scores(spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y"), ("y", "y")], "t string, p string"), "t", "p")
    assert tuple(learning.weighted_scores(per).first()) == (0.83333, 0.75, 0.73333, 4)
    votes = spark.createDataFrame([("a", 1, 1, 0, 0, -1), ("b", 0, 1, 0, 0, 1)], "k string, iforest int, lof int, dbscan int, zscore int, label int")
    assert {r.method: r.flagged for r in outliers.agreement(votes).collect()} == {"iforest": 1, "lof": 2, "dbscan": 0, "zscore": 0, "ensemble": 1}
