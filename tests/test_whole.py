"""That operators do the whole job where a part once did: brute force over more rows than a former cap."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewatch import analysis
from tidewatch.operators import learning, outliers, together
from tidewatch.plans import models

DATA = "/root/testdata/sf0.1"


def brute(x):
    return np.array([np.sqrt(((x - r) ** 2).sum(1)) for r in x])


def test_neighbours_are_of_all_rows(spark):
    rng = np.random.default_rng(5)
    trio = np.array([[30.0, 30.0], [30.001, 30.0], [30.0, 30.001]])
    x = np.vstack([rng.normal(size=(5_400, 2)), trio])
    df = spark.createDataFrame([(f"{i:05d}", float(a), float(b)) for i, (a, b) in enumerate(x)], "k string, a double, b double").repartition(3)
    z = (x - x.mean(0)) / x.std(0)
    d = brute(z)
    r = np.round(d, 6)
    eps = np.percentile(np.sort(r, axis=1)[:, 4], 90)
    core = (r <= eps).sum(1) >= 3
    noise = ~core & ~(r[:, core] <= eps).any(1)
    assert core[-3:].all() and noise.any()
    assert [g.flag for g in outliers.dbscan_noise(df, "k", ["a", "b"]).orderBy("k").collect()] == noise.tolist()
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :20]
    dist = np.take_along_axis(d, near, 1)
    density = 1 / (np.maximum(dist[near, -1], dist).mean(1) + 1e-10)
    got = outliers.local_outlier_factor(df, "k", ["a", "b"]).orderBy("k").collect()
    assert np.allclose([g.score for g in got], density[near].mean(1) / density, atol=1e-6)
    assert sum(g.flag for g in got) == 541


def test_co_failures_of_small_stores(spark):
    rows = [(1_000_000 + 9_000 * s + 700_000 * k, f"{10_000 + s}", "disconnect") for s in range(120) for k in range(5)]
    rows += [(77_000_000, "99998", "disconnect"), (77_000_060, "99999", "disconnect")]
    inc = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id bigint, sec bigint, store_id string, kind string")
    for c in ("server", "fed_group", "machine", "category", "ip", "ts", "delay"):
        inc = inc.withColumn(c, F.timestamp_seconds("sec").cast("timestamp_ntz") if c == "ts" else F.lit(None).cast("int" if c == "delay" else "string"))
    got = analysis.analyze(inc)["co_failures"].where("b = '99999'").collect()
    assert [tuple(r) for r in got] == [("99998", "99999", 1, 1.0)]


@pytest.mark.parametrize("name", ["cofailure_pairs_all", "cofailure_same_machine_all"])
def test_pairs_of_all_stores_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    con.execute(f"create view events as select * from read_parquet('{DATA}/events.parquet')")
    df = entry.queries()[name](spark, DATA)
    want = con.execute(f"select {', '.join(df.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert want and sorted(map(tuple, df.collect())) == sorted(want)


def _logs(tmp_path, spark, texts):
    rows = [("s", "f", i, f"2024-01-04T21:{i % 60:02d}:15.123-08:00 Federation (Error) Store {10_000 + i} {t}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "server string, file string, line_no bigint, line string").write.parquet(str(tmp_path / "log_lines.parquet"))
    return str(tmp_path)


def test_text_features_are_not_cut(spark, tmp_path):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(400)]
    folder = _logs(tmp_path, spark, [f"connection attempt failed {words[i]} {words[(i * 7 + 3) % 400]}" for i in range(400)] + [f"SocketException {words[i]}" for i in range(400)])
    values = [r.singular_value for r in models.svd_components(spark, folder).orderBy("component").collect()]
    assert len(values) == 50 and values == sorted(values, reverse=True) and values[-1] > 0
    f, terms = learning.text_features(models._messages(spark, folder), "message")
    a = np.array([r.tfidf.toArray() for r in f.select("tfidf").collect()])
    assert len(terms) > 200 and np.allclose(values, np.linalg.svd(a, compute_uv=False)[:50], atol=1e-5)
    got = models.mlp_labels(spark, folder).collect()
    assert len(got) == 800 and {r.predicted for r in got} == {r.category for r in got}


def test_terms_of_long_lines(spark, tmp_path):
    folder = _logs(tmp_path, spark, ["connection attempt failed " + "x" * 300 + " tail"] * 3)
    assert {r.term: r.documents for r in models.tfidf_terms(spark, folder).collect()}["tail"] == 3


def test_elbow_and_shares_of_rows(spark):
    assert outliers._elbow(np.array([1.0, 1, 1, 1, 1, 1, 1, 9])) == 9.0 and outliers._elbow(np.array([0.01, 0.01])) == 0.1
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(900, 2)), [[9.0, 9.0]] * 5])  # five equal rows: core for three, not for a hundredth of 905
    df = spark.createDataFrame([(f"{i:05d}", float(a), float(b)) for i, (a, b) in enumerate(x)], "k string, a double, b double")
    got = {r.k: r.weight for r in outliers.weighted_ensemble(df, "k", ["a", "b"]).collect()}
    z = (x - x.mean(0)) / x.std(0)
    d = np.round(brute(z), 6)
    eps = outliers._elbow(np.sort(d, axis=1)[:, 9])
    core = (d <= eps).sum(1) >= 9
    noise = ~core & ~(d[:, core] <= eps).any(1)
    assert noise[-5:].all() and all(got[f"{i:05d}"] >= 0.8 for i in np.flatnonzero(noise))
    parts = {"iforest": outliers.isolation_forest(df, "k", ["a", "b"], bootstrap=True), "lof": outliers.local_outlier_factor(df, "k", ["a", "b"], 45), "svm": outliers.one_class_svm(df, "k", ["a", "b"])}
    flags = {n: {r.k: r.flag for r in p.select("k", "flag").collect()} for n, p in parts.items()}
    spread = {r.k: r.score > 0.5 for r in outliers.spread_scores(df, "k", ["a", "b"]).collect()}
    for i, k in enumerate(sorted(got)):
        assert abs(got[k] - 1.5 * flags["iforest"][k] - 1.2 * flags["lof"][k] - flags["svm"][k] - 0.8 * noise[i] - spread[k]) < 1e-6


def test_all_classes_of_copies_have_members(spark, tmp_path):
    spark.createDataFrame([(i, "a\nb") for i in range(80)] + [(80, "c"), (81, None)], "file_id bigint, content string").write.parquet(str(tmp_path / "log_files.parquet"))
    got = sorted(map(tuple, entry.queries()["p4_members"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"create view log_files as select * from read_parquet('{tmp_path}/log_files.parquet/*.parquet')")
    assert got == [(i, 0) for i in range(80)] + [(80, 80)] == sorted(con.execute(entry.oracle_sql()["p4_members"]).fetchall())


@pytest.mark.parametrize(("keys", "dense"), [(30, 0), (30, 10**9), (4, 100)])
def test_co_failures_equal_all_comparisons(spark, monkeypatch, keys, dense):
    """Many keys in one minute, minutes at the edges of slices, listed and multiplied: as from comparing every pair's minutes."""
    monkeypatch.setattr(together, "DENSE", dense)
    monkeypatch.setattr(together, "CELLS", 50)
    rng = np.random.default_rng(keys)
    rows = {(f"k{rng.integers(keys):02d}", int(t)) for t in rng.integers(-200, 200, 300)} | {(f"k{k:02d}", 39) for k in range(keys)}
    near = {(a, b): 0 for a in {k for k, _ in rows} for b in {k for k, _ in rows} if a < b}
    of = {k: [t for x, t in rows if x == k] for k, _ in rows}
    for a, b in near:
        near[a, b] = sum(any(abs(t - u) <= 3 for u in of[b]) for t in of[a])
    want = sorted((a, b, n, round(n / min(len(of[a]), len(of[b])), 6)) for (a, b), n in near.items() if round(n / min(len(of[a]), len(of[b])), 6) > 0.3)
    df = spark.createDataFrame([*rows, *list(rows)[:20], (None, 3), ("k00", None)], "k string, m bigint")
    assert sorted(map(tuple, together.co_failures(df, "k", "m", near=3, width=40).collect())) == want
    assert together.co_failures(df.limit(0), "k", "m").count() == 0


def test_a_minute_of_all_stores_is_few_rows(spark):
    """3,000 stores that fail in the same ten minutes: the counts of their 4.5 million pairs come from a product."""
    store = np.repeat(np.arange(3_000), 10)
    pair, count = together.near_counts(store, np.tile(np.arange(10) * 20, 3_000), store, np.tile(np.arange(10) * 20, 3_000), 3_000, 5)
    assert len(pair) == 3_000 * 2_999 // 2 and set(count.tolist()) == {10}
