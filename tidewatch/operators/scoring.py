"""Scores from aggregates: failure probability, health of machines, root causes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Of each feature of a store's failure probability the value that counts in full, and its weight.
FAILURE_WEIGHTS = {"recent_errors": (100, 30), "error_variance": (50, 20), "error_types": (5, 15), "burst_count": (10, 15)}
TREND_WEIGHTS, TREND_MOST = {"increasing": 20, "stable": 5}, 20
# Prior probabilities of causes, and of their categories of errors with the weight of their share.
PRIORS = {"network_issue": 0.3, "store_hardware": 0.25, "server_overload": 0.2, "certificate_expiry": 0.1}
EVIDENCE = {
    "network_issue": (3, ("connection_timeout", "host_unreachable", "socket_exception")),
    "store_hardware": (3, ("connection_refused",)),
    "certificate_expiry": (5, ("tls_handshake_error", "certificate_error")),
}
OVERLOAD_STORES, OVERLOAD_WEIGHT, OVERLOAD_EVIDENCE = 200, 2, 0.5
HEALTH_PRIORS = {"network_latency": 0.3, "server_overload": 0.25, "store_hardware": 0.2, "maintenance_window": 0.15, "external_dependency": 0.1}
HEALTH_IMBALANCE, HEALTH_OVERLOAD = 0.5, 1.5
REPORTED = 0.1  # causes of a greater probability are named
# What speaks for a cause; {} is the number of errors of the category behind it.
EVIDENCE_TEXTS = {
    "network_issue": ("High timeout/socket errors (%s)", "connection_timeout"),
    "store_hardware": ("Connection refused errors (%s)", "connection_refused"),
    "certificate_expiry": ("TLS errors (%s)", "tls_handshake_error"),
    "server_overload": ("High store density on federation servers", None),
}
# Bands of a machine's score, each with the score below which it holds.
BANDS = (("CRITICAL", 30), ("WARNING", 50), ("FAIR", 70))


def failure_probability(df: DataFrame) -> DataFrame:
    """df with probability, σ(5(risk − 0.5)), from those of recent_errors, error_variance, error_types, burst_count (numbers) and
    trend (increasing, stable or decreasing) that it has; 0.5 where it has none. Nulls count as 0."""
    points, most = F.lit(0.0), 0
    for name, (full, weight) in FAILURE_WEIGHTS.items():
        if name in df.columns:
            points, most = points + F.least(F.coalesce(F.col(name), F.lit(0)) / full, F.lit(1.0)) * weight, most + weight
    if "trend" in df.columns:
        known = F.create_map(*[F.lit(x) for kv in TREND_WEIGHTS.items() for x in kv])
        points, most = points + F.coalesce(known[F.col("trend")], F.lit(0)), most + TREND_MOST
    risk = points / most if most else F.lit(0.5)
    return df.withColumn("probability", 1 / (1 + F.exp(-5 * (risk - 0.5))))


def band(score: Column) -> Column:
    """The status of a score."""
    out = F.when(score < BANDS[0][1], BANDS[0][0])
    for name, below in BANDS[1:]:
        out = out.when(score < below, name)
    return out.otherwise("GOOD")


def machine_health(df: DataFrame, per_error: float = 1_000.0) -> DataFrame:
    """(machine, errors, stores, score, band) of df (machine, store_id), a row an error: 100 less twice the errors a store and less the
    errors by per_error (1,000; of health rows 100), 0 at least. A machine without stores has 0 errors a store."""
    per = df.groupBy("machine").agg(F.count(F.lit(1)).alias("errors"), F.countDistinct("store_id").alias("stores"))
    lost = 2 * F.coalesce(F.try_divide("errors", "stores"), F.lit(0.0)) + F.col("errors") / per_error
    score = F.round(F.greatest(F.lit(0.0), 100 - F.least(F.lit(100.0), lost)), 6)
    return per.withColumn("score", score).withColumn("band", band(F.col("score")))


def root_causes(errors: DataFrame, machines: DataFrame) -> DataFrame:
    """(cause, probability, evidence) of errors (category, n) and machines (machine, stores): priors raised by the shares of their
    categories, server_overload where a machine has more than OVERLOAD_STORES stores; normalised over the four, those above REPORTED.
    No errors, no causes. Errors without a category count for none."""
    known = errors.where("category is not null")
    of = lambda names: F.coalesce(F.sum(F.when(F.col("category").isin(*names), F.col("n"))), F.lit(0))
    sums = [of(names).alias(f"_{cause}") for cause, (_, names) in EVIDENCE.items()]
    texts = [of([c]).alias(f"n_{c}") for _, c in EVIDENCE_TEXTS.values() if c]
    one = known.agg(F.sum("n").alias("total"), *sums, *texts).where("total > 0")
    crowd = machines.agg(F.max("stores").alias("most"))
    one = one.withColumn("_most", crowd.scalar())
    raised = {cause: PRIORS[cause] * (1 + weight * F.col(f"_{cause}") / F.col("total")) for cause, (weight, _) in EVIDENCE.items()}
    evidence = F.when(F.col("_most") > OVERLOAD_STORES, OVERLOAD_EVIDENCE).otherwise(0.0)
    raised["server_overload"] = PRIORS["server_overload"] * (1 + OVERLOAD_WEIGHT * evidence)
    total = sum(raised.values(), F.lit(0.0))
    said = {k: F.format_string(t, F.format_number(f"n_{c}", 0)) if c else F.lit(t) for k, (t, c) in EVIDENCE_TEXTS.items()}
    rows = [F.struct(F.lit(k).alias("cause"), F.round(v / total, 6).alias("probability"), said[k].alias("evidence")) for k, v in raised.items()]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where(F.col("probability") > REPORTED)


def health_root_causes(machines: DataFrame) -> DataFrame:
    """(cause, probability) of machines (machine, errors): the priors of health rows, server_overload raised where the least loaded
    machine has less than half of the failures of the most loaded; normalised, those above REPORTED. No machines, no causes."""
    one = machines.agg(F.max("errors").alias("most"), F.min("errors").alias("least")).where("most is not null")
    uneven = F.coalesce(F.try_divide(F.col("most") - F.col("least"), F.col("most")), F.lit(0.0)) > HEALTH_IMBALANCE
    raised = {k: F.lit(v) * F.when(uneven, HEALTH_OVERLOAD).otherwise(1.0) if k == "server_overload" else F.lit(v) for k, v in HEALTH_PRIORS.items()}
    total = sum(raised.values(), F.lit(0.0))
    rows = [F.struct(F.lit(k).alias("cause"), F.round(v / total, 6).alias("probability")) for k, v in raised.items()]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where(F.col("probability") > REPORTED)
