"""Outlier votes over feature rows.

z-scores, quartiles and median deviations are aggregates. LOF and DBSCAN noise compare every row with every other, and an isolation
forest draws its samples from all rows: the driver holds the standardised rows (8 bytes a feature) and tasks take blocks of
distances. Only the one-class SVM is fitted on a reference, of at most SVM_REFERENCE rows, the least by hash of the id, which
is all rows up to that number; every row is then scored where it lies against the fitted model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import written

SVM_REFERENCE = 2_000
#: Distances that a task holds at once, and those it computes in all.
BLOCK, PER_TASK = 2_000_000, 50_000_000


def zscores(df: DataFrame, key: str, features: Sequence[str], limit: float = 3.0) -> DataFrame:
    """(key, max_z, flag): the greatest |z| of a row, population deviation; null, and no flag, if any feature is constant."""
    facts = df.agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("sd")).alias(f"f{i}") for i, c in enumerate(features)]).alias("f"))
    t = df.select(key, *features).withColumn("_f", facts.scalar())
    z = [F.try_divide(F.abs(F.col(c) - F.col(f"_f.f{i}.m")), F.col(f"_f.f{i}.sd")) for i, c in enumerate(features)]
    t = t.select(key, *[x.alias(f"_z{i}") for i, x in enumerate(z)])
    whole = reduce(lambda a, b: a & b, [F.col(f"_z{i}").isNotNull() for i in range(len(z))])
    most = F.greatest(*[F.col(f"_z{i}") for i in range(len(z))]) if len(z) > 1 else F.col("_z0")
    t = t.select(key, F.when(whole, most).alias("max_z"))
    return t.select(key, "max_z", F.coalesce(F.col("max_z") > limit, F.lit(False)).alias("flag"))


def spread_scores(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """(key, score): 0.4 for a |z| over 3, 0.3 by the share of features beyond 1.5 quartile ranges, 0.3 by the share with a
    modified z over 3.5 (features whose median deviation is 0 count none)."""
    q = df.agg(F.struct(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c) for c in features]).alias("q"))
    t = df.withColumn("_q", q.scalar())
    mad = t.agg(F.struct(*[F.percentile(F.abs(F.col(c) - F.col(f"_q.{c}")[1]), 0.5).alias(c) for c in features]).alias("m"))
    t = t.withColumn("_m", mad.scalar())
    n, total = len(features), F.lit(0.0)
    for c in features:
        x, lo, mid, hi, m = F.col(c), F.col(f"_q.{c}")[0], F.col(f"_q.{c}")[1], F.col(f"_q.{c}")[2], F.col(f"_m.{c}")
        total = total + F.when((x < lo - 1.5 * (hi - lo)) | (x > hi + 1.5 * (hi - lo)), 0.3 / n).otherwise(0.0)
        total = total + F.when((m > 0) & (F.abs(0.6745 * (x - mid)) > 3.5 * m), 0.3 / n).otherwise(0.0)
    t = t.select(key, total.alias("_s"))
    return zscores(df, key, features).join(t, key).select(
        key,
        F.round(F.col("_s") + F.when(F.coalesce("max_z", F.lit(0.0)) > 3, 0.4).otherwise(0.0), 6).alias("score"),
    )


def min_max(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, scaled): the column between its least (0) and greatest value (1); 0 for a constant one."""
    ends = df.agg(F.struct(F.min(column).alias("low"), F.max(column).alias("high")).alias("e"))
    low, high = F.col("_e.low"), F.col("_e.high")
    scaled = F.when(high > low, F.round((F.col(column) - low) / (high - low), 6)).otherwise(0.0)
    return df.select(key, column).withColumn("_e", ends.scalar()).select(key, scaled.alias("scaled"))


Scaled = tuple[list, np.ndarray, np.ndarray, np.ndarray]


def scaled_rows(df: DataFrame, key: str, features: Sequence[str]) -> Scaled:
    """Ids and standardised rows of all rows, in the order of the ids' hash, and the means and deviations; what the methods below
    need, to be made once where several of them follow."""
    facts = df.agg(*[F.avg(c) for c in features], *[F.stddev_pop(c) for c in features]).first()
    mean = np.array([x or 0.0 for x in facts[: len(features)]])
    sd = np.array([x or 1.0 for x in facts[len(features) :]])
    rows = df.select(key, *features).orderBy(F.xxhash64(key), key).toPandas()
    return rows[key].tolist(), (rows[list(features)].to_numpy(float) - mean) / sd, mean, sd


def _score_all(df: DataFrame, key: str, features: Sequence[str], mean, sd, score: Callable[[np.ndarray, list], np.ndarray]) -> DataFrame:
    names = list(features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({key: b[key], "score": score((b[names].to_numpy(float) - mean) / sd, b[key].tolist())})

    return df.select(key, *names).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, score double")


def _top(df: DataFrame, key: str, share: float) -> DataFrame:
    """Flags the share of rows with the greatest scores."""
    cut = df.agg(F.percentile("score", 1 - share).alias("_cut"))
    return df.select(key, F.round("score", 9).alias("score"), (F.col("score") > cut.scalar()).alias("flag"))


def _over_blocks(df: DataFrame, x: np.ndarray, block: Callable[[np.ndarray, np.ndarray], np.ndarray], to: np.ndarray | None = None) -> np.ndarray:
    """block(distances to all rows of `to`, the rows' numbers), a value a row of x, in the order of x."""
    to = x if to is None else to
    size = max(1, BLOCK // max(len(to), 1))
    tasks = min(len(x), max(1, len(x) * len(to) // PER_TASK))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            every = b["id"].to_numpy()
            for i in range(0, len(every), size):
                rows = every[i : i + size]
                yield pd.DataFrame({"id": rows, "value": block(_exact_distances(x[rows], to), rows)})

    got = df.sparkSession.range(0, len(x), 1, tasks).mapInPandas(run, "id bigint, value double").toPandas()
    return got.sort_values("id")["value"].to_numpy(float)


def _exact_distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """By differences, so that equal rows are 0 apart and a distance is the same in any block."""
    out = np.zeros((len(x), len(to)))
    for c in range(x.shape[1]):
        d = x[:, c, None] - to[None, :, c]
        d *= d
        out += d
    return np.sqrt(out, out=out)


def _with_values(df: DataFrame, key: str, ids: list, values: np.ndarray) -> DataFrame:
    pdf = pd.DataFrame({key: pd.Series(ids, dtype=object), "score": values})
    return df.sparkSession.createDataFrame(pdf, f"{key} {dict(df.dtypes)[key]}, score double")


def _distances(x: np.ndarray, ref: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (ref**2).sum(1)[None] - 2 * x @ ref.T, 0))


def _isolation_tree(x: np.ndarray, depth: int, rng: np.random.Generator):
    if depth == 0 or len(x) <= 1 or (x == x[0]).all():
        n = len(x)
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
    c = rng.choice(np.flatnonzero(x.max(0) > x.min(0)))
    at = rng.uniform(x[:, c].min(), x[:, c].max())
    left = x[:, c] < at
    return c, at, _isolation_tree(x[left], depth - 1, rng), _isolation_tree(x[~left], depth - 1, rng)


def _depths(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    c, at, a, b = tree
    left = x[:, c] < at
    out = np.empty(len(x))
    out[left], out[~left] = 1 + _depths(a, x[left]), 1 + _depths(b, x[~left])
    return out


def isolation_forest(df: DataFrame, key: str, features: Sequence[str], trees: int = 100, sample: int = 256, share: float = 0.1, seed: int = 42, bootstrap: bool = False, scaled: Scaled | None = None) -> DataFrame:
    """(key, score, flag) of an isolation forest: the shallower a row is isolated, the greater its score."""
    ids, ref, mean, sd = scaled or scaled_rows(df, key, features)
    if not ids:
        return df.select(key, F.lit(0.0).alias("score"), F.lit(False).alias("flag"))
    rng, m = np.random.default_rng(seed), min(sample, len(ref))
    forest = [_isolation_tree(ref[rng.choice(len(ref), m, replace=bootstrap)], int(np.ceil(np.log2(max(m, 2)))), rng) for _ in range(trees)]
    usual = max(1e-9, 2 * (np.log(max(m - 1, 1)) + 0.5772156649) - 2 * (m - 1) / m)
    return _top(_score_all(df, key, features, mean, sd, lambda x, _: 2 ** (-np.mean([_depths(t, x) for t in forest], axis=0) / usual)), key, share)


def local_outlier_factor(df: DataFrame, key: str, features: Sequence[str], neighbours: int = 20, share: float = 0.1, scaled: Scaled | None = None) -> DataFrame:
    """(key, score, flag): the factor by the `neighbours` nearest of all other rows; of rows equally far the first by hash count."""
    ids, x, _, _ = scaled or scaled_rows(df, key, features)
    if len(ids) < 2:
        return df.select(key, F.lit(0.0).alias("score"), F.lit(False).alias("flag"))
    k = min(neighbours, len(ids) - 1)

    def others(d: np.ndarray, rows: np.ndarray) -> np.ndarray:
        d[np.arange(len(rows)), rows] = np.inf
        return d

    def near(d: np.ndarray, rows: np.ndarray) -> np.ndarray:
        last = kth[rows, None]
        less, tied = d < last, d == last
        return less | (tied & (np.cumsum(tied, axis=1) <= k - less.sum(1)[:, None]))

    kth = _over_blocks(df, x, lambda d, rows: np.partition(others(d, rows), k - 1, axis=1)[:, k - 1])
    reach = _over_blocks(df, x, lambda d, rows: np.where(near(others(d, rows), rows), np.maximum(kth[None], d), 0).sum(1) / k)
    density = 1 / (reach + 1e-10)
    around = _over_blocks(df, x, lambda d, rows: np.where(near(others(d, rows), rows), density[None], 0).sum(1) / k)
    return _top(_with_values(df, key, ids, around / density), key, share)


def _elbow(distances: np.ndarray, least: float = 0.1) -> float:
    """The first of the sorted distances where they rise by more than the mean and a deviation of all rises."""
    d = np.sort(distances)
    if len(d) < 2:
        return least
    rise = np.gradient(d)
    return max(float(d[np.argmax(rise > rise.mean() + rise.std())]), least)


def dbscan_noise(df: DataFrame, key: str, features: Sequence[str], least: int = 3, nth: int = 5, at: float | None = 0.9, scaled: Scaled | None = None) -> DataFrame:
    """(key, flag): rows that are neither core (at least `least` of all rows within eps, itself counted) nor within eps of a core row.
    eps is the percentile `at` of the distances to the nth nearest row, itself counted; without `at` their elbow, 0.1 at least."""
    ids, x, _, _ = scaled or scaled_rows(df, key, features)
    if not ids:
        return df.select(key, F.lit(False).alias("flag"))
    k = min(nth, len(ids))
    nearest = _over_blocks(df, x, lambda d, _: np.partition(np.round(d, 6), k - 1, axis=1)[:, k - 1])
    eps = _elbow(nearest) if at is None else float(np.percentile(nearest, at * 100))
    core = _over_blocks(df, x, lambda d, _: (np.round(d, 6) <= eps).sum(1)) >= least
    noise = ~core
    if core.any() and noise.any():
        noise[noise] = _over_blocks(df, x[noise], lambda d, _: (np.round(d, 6) > eps).all(1), x[core]) > 0
    return _with_values(df, key, ids, noise.astype(float)).select(key, (F.col("score") > 0).alias("flag"))


def one_class_svm(df: DataFrame, key: str, features: Sequence[str], nu: float = 0.1, steps: int = 3_000, scaled: Scaled | None = None) -> DataFrame:
    """(key, score, flag): a one-class SVM with a Gaussian kernel, its dual solved by pairwise steps; flagged below the boundary."""
    ids, ref, mean, sd = scaled or scaled_rows(df, key, features)
    ref = ref[:SVM_REFERENCE]
    if not ids:
        return df.select(key, F.lit(0.0).alias("score"), F.lit(False).alias("flag"))
    n, gamma = len(ref), 1 / (ref.shape[1] * max(float(ref.var()), 1e-9))
    kernel = np.exp(-gamma * _distances(ref, ref) ** 2)
    most = 1 / max(nu * n, 1)
    alpha = np.full(n, 1 / n)
    grad = kernel @ alpha
    for _ in range(steps):
        i = int(np.argmin(np.where(alpha < most - 1e-12, grad, np.inf)))
        j = int(np.argmax(np.where(alpha > 1e-12, grad, -np.inf)))
        step = min((grad[j] - grad[i]) / max(kernel[i, i] + kernel[j, j] - 2 * kernel[i, j], 1e-12), most - alpha[i], alpha[j])
        if grad[j] - grad[i] < 1e-6 or step <= 0:
            break
        alpha[i] += step
        alpha[j] -= step
        grad += step * (kernel[:, i] - kernel[:, j])
    free = (alpha > 1e-9) & (alpha < most - 1e-9)
    rho = float(grad[free].mean()) if free.any() else float(grad.mean())
    some = alpha > 1e-9
    support, weight = ref[some], alpha[some]
    found = _score_all(df, key, features, mean, sd, lambda x, _: rho - np.exp(-gamma * _distances(x, support) ** 2) @ weight)
    return found.select(key, F.round("score", 9).alias("score"), (F.col("score") > 1e-6).alias("flag"))


METHODS = ("iforest", "lof", "dbscan", "zscore")
WEIGHTS = {"iforest": 1.5, "lof": 1.2, "svm": 1.0, "dbscan": 0.8, "spread": 1.0}  # fixed values


def ensemble(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """(key, iforest, lof, dbscan, zscore, votes, label): label -1 for at least two of the four votes, else 1; 1 for all below 10 rows."""
    df = written(df.select(key, *features), "features")
    x = scaled_rows(df, key, features)
    parts = {
        "iforest": isolation_forest(df, key, features, scaled=x),
        "lof": local_outlier_factor(df, key, features, scaled=x),
        "dbscan": dbscan_noise(df, key, features, scaled=x),
        "zscore": zscores(df, key, features),
    }
    out = df.select(key)
    for name, p in parts.items():
        out = out.join(p.select(key, F.col("flag").cast("int").alias(name)), key)
    votes = reduce(lambda a, b: a + b, [F.col(x) for x in parts])
    return out.withColumn("votes", votes).withColumn("label", F.when((F.col("votes") >= 2) & F.lit(len(x[0]) >= 10), -1).otherwise(1))


def agreement(votes: DataFrame, methods: Sequence[str] = METHODS) -> DataFrame:
    """(method, flagged): how many rows each method of an ensemble flagged, and the ensemble itself."""
    sums = [F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in methods] + [F.count_if(F.col("label") == -1).alias("ensemble")]
    rows = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).cast("bigint").alias("flagged")) for m in (*methods, "ensemble")])
    return votes.agg(*sums).select(F.explode(rows).alias("r")).select("r.*")


def weighted_ensemble(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """(key, weight, label, confidence, score): five methods, weighted; -1 from two fifths of the total weight. The forest's samples
    are drawn with replacement, LOF has a twentieth of the rows as neighbours, DBSCAN's core rows a hundredth within the elbow of
    the 10th distances. score is the mean over the methods of their scores between 0 and 1; DBSCAN has none and adds 0."""
    df = written(df.select(key, *features), "features")
    x = scaled_rows(df, key, features)
    n = len(x[0])
    spread = spread_scores(df, key, features)
    found = {
        "iforest": written(isolation_forest(df, key, features, bootstrap=True, scaled=x), "iforest"),
        "lof": local_outlier_factor(df, key, features, max(20, n // 20), scaled=x),
        "svm": written(one_class_svm(df, key, features, scaled=x), "svm"),
        "dbscan": dbscan_noise(df, key, features, max(3, n // 100), min(10, max(n - 1, 1)), None, scaled=x),
        "spread": spread.withColumn("flag", F.col("score") > 0.5),
    }
    out = df.select(key)
    for name, p in found.items():
        out = out.join(p.select(key, (F.col("flag").cast("int") * WEIGHTS[name]).alias(name)), key)
    for name in ("iforest", "lof", "svm"):
        out = out.join(min_max(found[name], key, "score").withColumnRenamed("scaled", f"_{name}"), key)
    out = out.join(spread.withColumnRenamed("score", "_spread"), key)
    total = sum(WEIGHTS.values())
    got = reduce(lambda a, b: a + b, [F.col(x) for x in WEIGHTS])
    score = F.round((F.col("_iforest") + F.col("_lof") + F.col("_svm") + F.col("_spread")) / len(WEIGHTS), 6)
    return out.select(
        key, F.round(got, 6).alias("weight"), F.when(got >= 0.4 * total, -1).otherwise(1).alias("label"), F.round(got / total, 6).alias("confidence"), score.alias("score")
    )
