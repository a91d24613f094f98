"""Clustering, classification and text features with Spark ML."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, PCA, CountVectorizer, MinMaxScaler, NGram, Normalizer, RegexTokenizer, StopWordsRemover, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import written

SEED = 42


def standardised(df: DataFrame, features: Sequence[str], out: str = "_v") -> DataFrame:
    """df with the vector out of the features less their mean, over their population deviation; a constant one is 0."""
    facts = df.agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("sd")).alias(f"f{i}") for i, c in enumerate(features)]).alias("f"))
    t = df.withColumn("_f", facts.scalar())
    names = [f"_s{i}" for i in range(len(features))]
    for i, c in enumerate(features):
        t = t.withColumn(names[i], F.coalesce(F.try_divide(F.col(c) - F.col(f"_f.f{i}.m"), F.col(f"_f.f{i}.sd")), F.lit(0.0)))
    return VectorAssembler(inputCols=names, outputCol=out).transform(t).drop("_f", *names)


def clusters(df: DataFrame, key: str, features: Sequence[str], per: int = 50, most: int = 5, least: int = 20) -> DataFrame:
    """df with cluster, by k-means over standardised features, k = rows / per between 2 and most; cluster 0 for fewer than `least` rows."""
    n = df.count()
    if n < least:
        return df.withColumn("cluster", F.lit(0))
    k = min(most, max(2, n // per))
    data = standardised(df, features)
    return KMeans(k=k, seed=SEED, featuresCol="_v", predictionCol="cluster").fit(data).transform(data).drop("_v")


# What a cluster of stores looks like by its center, the first that holds; over 100 failures by the first three.
MANY = (("night_ratio", 0.4, "High-failure nocturnal pattern"), ("bursts", 5, "High-failure bursty pattern"), (None, None, "Consistently problematic"))
FEW = (("daily_var", 50, "Intermittent issues"), ("weekend_ratio", 0.4, "Weekend-heavy failures"), (None, None, "Normal/stable pattern"))


def health_profiles(df: DataFrame, features: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """(cluster, stores, failures, mean_<feature> of each, description) of clustered health features: sizes and centers, and a text."""

    def described(rules: tuple) -> Column:
        out = F.lit(rules[-1][2])
        for name, over, text in reversed(rules[:-1]):
            out = F.when(F.col(f"mean_{name}") > over, text).otherwise(out)
        return out

    per = df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("stores"),
        F.sum("failures").alias("failures"),
        *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in features],
    )
    return per.withColumn("description", F.when(F.col("mean_failures") > 100, described(MANY)).otherwise(described(FEW)))


def silhouette(df: DataFrame, features: Sequence[str], cluster: str = "cluster") -> float:
    """The mean silhouette by squared distance of standardised features, over all rows; NaN for fewer than two clusters."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    if df.select(cluster).distinct().count() < 2:
        return float("nan")
    return ClusteringEvaluator(featuresCol="_v", predictionCol=cluster).evaluate(standardised(df, features))


def importance(df: DataFrame, features: Sequence[str], label: str, trees: int = 100, depth: int = 10) -> DataFrame:
    """(feature, importance) of a random forest for the numeric label; the features in order of importance."""
    data = VectorAssembler(inputCols=list(features), outputCol="_v").transform(df.withColumn(label, F.col(label).cast("double")))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featuresCol="_v", labelCol=label).fit(data)
    rows = [(f, float(x)) for f, x in zip(features, model.featureImportances.toArray(), strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def _balanced(df: DataFrame, label: str) -> DataFrame:
    """The rows with a label, with the weight _w that makes all labels count alike. The labels' counts, a row a label, are joined."""
    known = df.where(F.col(label).isNotNull())
    counts = known.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = known.agg(F.count(F.lit(1)))
    return known.join(counts, label).withColumn("_w", total.scalar() / F.col("_n")).drop("_n")


def _forest(data: DataFrame) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=50, maxDepth=10, seed=SEED, featuresCol="_v", labelCol="_y", weightCol="_w").fit(data)


def risk(df: DataFrame, key: str, features: Sequence[str], label: str) -> DataFrame:
    """(key, label, predicted, risk): a balanced random forest for the text label; risk is one less its greatest probability."""
    weighted = _balanced(df, label)
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(weighted)
    data = VectorAssembler(inputCols=list(features), outputCol="_v").transform(index.transform(weighted))
    out = _forest(data).transform(data)
    names = F.array(*[F.lit(x) for x in index.labels])
    return out.select(
        key,
        label,
        F.get(names, F.col("prediction").cast("int")).alias("predicted"),
        F.round(1 - F.array_max(vector_to_array("probability")), 6).alias("risk"),
    )


def fold_of(key: str, folds: int) -> Column:
    """The fold of a row, by the hash of its key: labels are spread over the folds as the hash spreads rows, not exactly alike."""
    return F.pmod(F.xxhash64(F.lit("fold"), key), F.lit(folds))


def risk_validation(df: DataFrame, key: str, features: Sequence[str], label: str, folds: int = 3) -> DataFrame:
    """(fold, rows, accuracy, balanced_accuracy) of the forest of `risk`, each fold predicted by a forest of the others;
    balanced accuracy is the mean over the labels of the share that is predicted right."""
    data = VectorAssembler(inputCols=list(features), outputCol="_v").transform(_balanced(df, label))
    data = written(
        StringIndexer(
            inputCol=label,
            outputCol="_y",
            stringOrderType="alphabetAsc",
        ).fit(data).transform(data).select("_v", "_y", "_w", fold_of(key, folds).alias("fold")),
        "folds",
    )
    out = None
    for k in range(folds):
        part = _forest(data.where(F.col("fold") != k)).transform(data.where(F.col("fold") == k)).select("fold", "_y", "prediction")
        out = part if out is None else out.unionByName(part)
    right = F.avg((F.col("_y") == F.col("prediction")).cast("int")).alias("recall")
    per = out.groupBy("fold", "_y").agg(F.count(F.lit(1)).alias("n"), right)
    mean = F.sum(F.col("n") * F.col("recall")) / F.sum("n")
    return per.groupBy("fold").agg(F.sum("n").alias("rows"), F.round(mean, 6).alias("accuracy"), F.round(F.avg("recall"), 6).alias("balanced_accuracy"))


def text_features(df: DataFrame, text: str, terms: int = 1_000, least: int = 2, most: float = 0.95) -> tuple[DataFrame, list[str]]:
    """df with tfidf (1- to 3-grams without stop words, normalised), and the terms in their order."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_t", pattern=r"[^\p{L}\p{N}_]+"),
        StopWordsRemover(inputCol="_t", outputCol="_1"),
        NGram(n=2, inputCol="_1", outputCol="_2"),
        NGram(n=3, inputCol="_1", outputCol="_3"),
    ]
    grams = Pipeline(stages=stages).fit(df).transform(df).withColumn("_g", F.concat("_1", "_2", "_3"))
    count = CountVectorizer(inputCol="_g", outputCol="_c", vocabSize=terms, minDF=least, maxDF=most).fit(grams)
    counted = count.transform(grams)
    weighed = Normalizer(inputCol="_i", outputCol="tfidf").transform(IDF(inputCol="_c", outputCol="_i").fit(counted).transform(counted))
    return weighed.drop("_t", "_1", "_2", "_3", "_g", "_c", "_i"), count.vocabulary


def term_frequencies(df: DataFrame, text: str) -> DataFrame:
    """(term, documents): in how many rows each word occurs."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9_]+"), lambda x: x != ""))
    return df.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("documents"))


def principal_axes(df: DataFrame, vector: str, k: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """The up to k leading singular values, fewer than rows and columns, and their axes, one a column; rows stay in the JVM.

    The products of columns, 8 MB for 1,000 terms, follow from what a full principal component analysis sums up: covariances and means.
    """
    n, width = df.count(), len(df.select(vector).first()[0])
    k = max(1, min(k, width - 1, n - 1))
    summary = df.select(Summarizer.metrics("mean", "variance").summary(F.col(vector)).alias("s")).first()["s"]
    mean, variance = summary["mean"].toArray(), summary["variance"].toArray().sum()
    model = PCA(k=width, inputCol=vector, outputCol="_p").fit(df)
    axes, shares = model.pc.toArray(), model.explainedVariance.toArray()
    products = (n - 1) * variance * (axes * shares) @ axes.T + n * np.outer(mean, mean)
    squares, axes = np.linalg.eigh(products)
    squares, axes = squares[::-1][:k], axes[:, ::-1][:, :k]
    signs = np.sign(axes[np.abs(axes).argmax(0), np.arange(k)])
    return np.sqrt(np.maximum(squares, 0)), axes * signs


def components(df: DataFrame, vector: str, k: int = 50) -> DataFrame:
    """(component, singular_value) of the leading ones, up to k."""
    s, _ = principal_axes(df, vector, k)
    return df.sparkSession.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(s)], "component int, singular_value double")


def reduced(df: DataFrame, vector: str, k: int = 50) -> tuple[DataFrame, int]:
    """df with its vectors on the up to k leading axes, and the number of these."""
    _, axes = principal_axes(df, vector, k)

    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(v.to_list()) @ axes) if len(v) else [], dtype=object)

    return df.withColumn(vector, array_to_vector(project(vector_to_array(vector, "float32")))), axes.shape[1]


def _perceptron(train: DataFrame, vector: str, size: int, labels: int, seed: int):
    return MultilayerPerceptronClassifier(layers=[size, 64, 32, labels], maxIter=60, seed=seed, featuresCol=vector, labelCol="_y").fit(train)


def perceptron(df: DataFrame, key: str, vector: str, label: str, size: int, seed: int = SEED) -> DataFrame:
    """(key, label, predicted): a perceptron with layers of 64 and 32, trained on rows of four of five hash buckets, over all rows."""
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(df)
    data = index.transform(df)
    model = _perceptron(data.where(F.pmod(F.xxhash64(key), F.lit(5)) > 0), vector, size, len(index.labels), seed)
    names = F.array(*[F.lit(x) for x in index.labels])
    out = model.transform(data)
    return out.select(key, label, F.get(names, F.col("prediction").cast("int")).alias("predicted"), (F.pmod(F.xxhash64(key), F.lit(5)) == 0).alias("held_out"))


def perceptron_validation(df: DataFrame, key: str, vector: str, label: str, size: int, folds: int = 3, seed: int = SEED) -> DataFrame:
    """(fold, rows, accuracy): each fold predicted by a perceptron of the others."""
    data = written(
        StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(df).transform(df).select(vector, "_y", fold_of(key, folds).alias("fold")),
        "folds",
    )
    labels = int(data.agg(F.max("_y")).first()[0]) + 1
    out = None
    for k in range(folds):
        part = _perceptron(data.where(F.col("fold") != k), vector, size, labels, seed).transform(data.where(F.col("fold") == k))
        part = part.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg((F.col("_y") == F.col("prediction")).cast("int")), 6).alias("accuracy"))
        out = part if out is None else out.unionByName(part)
    return out


def permutation_importance(df: DataFrame, key: str, vector: str, label: str, size: int, most: int = 20, seed: int = SEED) -> DataFrame:
    """(feature, importance): by how much the accuracy of the perceptron over all rows falls when one of its `most` first features is
    that of another row. Rows change places within batches of the rows in the order of their hash."""
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(df)
    data = index.transform(df).select(key, vector, "_y")
    model = _perceptron(data, vector, size, len(index.labels), seed)
    features = min(most, size)
    mixed = data.repartition(key).sortWithinPartitions(F.xxhash64(key), key).select("_y", vector_to_array(vector).alias("v"))

    def shuffled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(seed)
        for batch in batches:
            x = np.stack(batch["v"].to_list()) if len(batch) else np.empty((0, size))
            for feature in range(-1, features):
                other = x.copy()
                if feature >= 0:
                    other[:, feature] = x[rng.permutation(len(x)), feature]
                yield pd.DataFrame({"feature": feature, "_y": batch["_y"], "v": list(other)})

    every = mixed.mapInPandas(shuffled, "feature int, _y double, v array<double>").select("feature", "_y", array_to_vector("v").alias(vector))
    right = model.transform(every).groupBy("feature").agg(F.avg((F.col("_y") == F.col("prediction")).cast("int")).alias("right"))
    base = right.where("feature = -1").select("right")
    return right.where("feature >= 0").select("feature", F.round(base.scalar() - F.col("right"), 6).alias("importance"))


def recurring_patterns(seqs: DataFrame, k: int = 5) -> DataFrame:
    """(pattern, windows): k-means over min-max scaled runs (idx, seq)."""
    data = seqs.select("idx", array_to_vector("seq").alias("_raw"))
    stages = [MinMaxScaler(inputCol="_raw", outputCol="_v"), KMeans(k=k, seed=SEED, featuresCol="_v", predictionCol="pattern")]
    return Pipeline(stages=stages).fit(data).transform(data).groupBy("pattern").agg(F.count(F.lit(1)).alias("windows"))


def granger(a: DataFrame, b: DataFrame, lags: int = 5, over: float = 0.05) -> DataFrame:
    """(r2_own, r2_both, causes): whether b's past explains a (both idx, x) beyond a's own past, by more than `over` of R²."""
    order = Window.partitionBy().orderBy("idx")
    t = a.join(b.select("idx", F.col("x").alias("y")), "idx")
    t = t.select(
        "x",
        *[F.lag("x", k).over(order).alias(f"x{k}") for k in range(1, lags + 1)],
        *[F.lag("y", k).over(order).alias(f"y{k}") for k in range(1, lags + 1)],
    ).dropna()

    def r2(cols: list[str]) -> float:
        return LinearRegression(featuresCol="_v", labelCol="x").fit(VectorAssembler(inputCols=cols, outputCol="_v").transform(t)).summary.r2

    own = r2([f"x{k}" for k in range(1, lags + 1)])
    both = r2([f"{c}{k}" for c in "xy" for k in range(1, lags + 1)])
    return a.sparkSession.createDataFrame([(round(own, 6), round(both, 6), both - own > over)], "r2_own double, r2_both double, causes boolean")


def scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, precision, recall, f1, support) of text labels; 0 where a denominator is 0."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    pairs = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    t = pairs.groupBy(F.col(truth).alias("label")).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)).alias("hit"),
    )
    p = pairs.groupBy(F.col(predicted).alias("label")).agg(F.sum("n").alias("said"))
    m = t.join(p, "label", "left").withColumn("precision", ratio(F.col("hit"), F.col("said"))).withColumn("recall", ratio(F.col("hit"), F.col("support")))
    return m.select(
        "label",
        F.round("precision", 6).alias("precision"),
        F.round("recall", 6).alias("recall"),
        F.round(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), 6).alias("f1"),
        "support",
    )


def weighted_scores(per_label: DataFrame) -> DataFrame:
    """(precision, recall, f1, rows): the means of `scores` over its labels, each by its support."""
    mean = lambda c: F.coalesce(F.round(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), 5), F.lit(0.0)).alias(c)
    return per_label.agg(mean("precision"), mean("recall"), mean("f1"), F.coalesce(F.sum("support"), F.lit(0)).alias("rows"))


def anomaly_scores(found: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """One row on found (key, label, confidence), -1 for an anomaly, against truth (key, label): anomalies, their ratio and mean
    confidence, precision, recall and f1; 0 where a denominator is 0. Rows without a truth count as usual ones."""
    both = found.join(truth.select(key, F.col("label").alias("_t")), key, "left")
    said, is_ = F.col("label") == -1, F.coalesce(F.col("_t") == -1, F.lit(False))
    one = both.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(said).alias("anomalies"),
        F.count_if(said & is_).alias("hit"),
        F.count_if(is_).alias("true"),
        F.avg(F.when(said, F.col("confidence"))).alias("confidence"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    one = one.withColumn("precision", ratio(F.col("hit"), F.col("anomalies"))).withColumn("recall", ratio(F.col("hit"), F.col("true")))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    rounded = {
        "ratio": ratio(F.col("anomalies"), F.col("n")),
        "avg_confidence": F.coalesce("confidence", F.lit(0.0)),
        "precision": F.col("precision"),
        "recall": F.col("recall"),
        "f1": f1,
    }
    return one.select("anomalies", *[F.round(v, 6).alias(k) for k, v in rounded.items()])
