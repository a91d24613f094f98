"""Mixing sources to target weights by weighted fair queueing.

Every document of a source, in shuffled order and round after round of repeats, gets a virtual finish time: the source's
tokens up to and with it, divided by the source's weight. In the order of these times each source has its share at every
point, so the mix is the longest beginning of that order that fits the total budget; a source that has run out of repeats
leaves its share to the others.

All sums are in two levels, so neither a source with a third of all documents nor a whole mix is one task: a source's
running sum by slices of the shuffled order, the mix's running total by ranges of virtual time, of which only the one at
the cut is ordered exactly. A document has at least one token, so in a range as wide as TOKENS_A_RANGE tokens at the weights
of the sources that still give lie at most so many documents and one a source: the cut range is bounded whatever the budget.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.bpe import VOCABULARY
from tidewatch.llm.encode import token_counts
from tidewatch.session import written

SLICE_DIGITS = 3  # of the shuffled order, hexadecimal
LEAST_RANGES, TOKENS_A_RANGE = 1024, 1 << 22
PLANS_BROADCAST = 10_000


def source_key(source: Column) -> Column:
    """A source's name without case, blanks and marks, so that its spellings agree; null where nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(source, r"(?U)[\W_]+", "")), F.lit(""))


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one mix: the virtual time at which the budget is met if documents were divisible, the number of ranges up to then, and
    the rounds each source may need. Nothing for a mix without a budget.

    At a time v a source has given more than weight * v less its longest document, or all it has; where that is beyond the
    budget for all sources together, the cut lies before v.
    """
    has = pdf[(pdf["tokens"] > 0) & (pdf["repeats"] > 0) & (pdf["budget"] > 0)].copy()
    most = has["tokens"] * has["repeats"]
    budget, time = float(pdf["budget"].iloc[0]), 0.0
    if len(has):
        ends = sorted(most / has["weight"])
        given = lambda v: float((has["weight"] * v).clip(upper=most).sum())
        low = 0.0
        time = ends[-1]
        for end in ends:
            if given(end) >= budget:
                rate = float(has["weight"][most / has["weight"] > low].sum())
                time = low + (budget - given(low)) / rate
                break
            low = end
    has["at"] = time
    surely = lambda v: float((has["weight"] * v - has["longest"]).clip(lower=0, upper=most).sum())
    late, end = 2 * time, float(((most + has["longest"]) / has["weight"]).max()) if len(has) else 0.0
    while 0 < late < end and surely(late) <= budget:
        late *= 2
    needed = (late * has["weight"] / has["tokens"]).apply(lambda x: int(x) + 2)
    fitting = (has["budget"] // has["tokens"]) + 1  # no more can begin within the budget
    has["rounds"] = pd.concat([needed, fitting, has["repeats"]], axis=1).min(axis=1)
    has["ranges"] = max(LEAST_RANGES, int(min(budget, float(most.sum())) // TOKENS_A_RANGE) + 1) if len(has) else LEAST_RANGES
    return has[["mix", "source", "weight", "budget", "tokens", "at", "ranges", "rounds"]]


_PLAN = "mix string, source string, weight double, budget bigint, tokens bigint, at double, ranges bigint, rounds bigint"


def choose(documents: DataFrame, targets: DataFrame, seed: int = 7, vocabulary: str = VOCABULARY, size: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen, plan). chosen: mix, source, doc_id, round (from 0), n_tokens; plan: one row per wanted mix and source.

    documents has doc_id, source and text; targets has mix_name, source, target_weight, max_repeats, size_ratio. Spellings
    of sources agree by source_key. Sources with a null, NaN or non-positive weight, without name, repeats or documents
    aren't chosen from; the share that can't be had goes to the others in proportion. The budget of a mix is size_ratio of
    the corpus's tokens, all sources counted; nothing is chosen for a mix whose size_ratio is null, NaN or not positive, while
    its rows stay in the plan. Documents without tokens (null and empty texts) are in no mix. Rows of targets for the same mix
    and source count once, the greatest weight; rows of documents with the same doc_id are documents of their own. With size, a column of documents, documents count as large as it says instead
    of by their tokens. The shuffled order is that of the MD5 of doc_id and seed.
    """
    spark = documents.sparkSession
    named = documents.withColumn("source", source_key(F.col("source")))
    if size is None:
        sized = token_counts(named.select("doc_id", "source", "text"), "text", ["doc_id", "source"], vocabulary)
    else:
        sized = documents.select("doc_id", source_key(F.col("source")).alias("source"), F.coalesce(size.cast("bigint"), F.lit(0)).alias("n_tokens"))
    sized = written(sized, "sizes")
    rows, plan = _wanted(sized, targets)
    small = plan.count() <= PLANS_BROADCAST  # a row per mix and source, checked
    offered = _running(sized, seed).join(F.broadcast(plan) if small else plan, "source")
    offered = offered.withColumn("round", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rounds") - 1)))
    finish = (F.col("round") * F.col("tokens") + F.col("upto")) / F.col("weight")
    timed = offered.withColumn("finish", finish).withColumn("range", F.floor(F.col("finish") / F.col("at") * F.col("ranges")))
    timed = timed.select("mix", "source", "doc_id", "round", "n_tokens", "budget", "finish", "order", "range")
    totals = timed.groupBy("mix", "range").agg(F.sum("n_tokens").alias("_t"), F.max("budget").alias("_b"))
    earlier = Window.partitionBy("mix").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    running = written(totals.withColumn("_before", F.coalesce(F.sum("_t").over(earlier), F.lit(0))), "ranges")
    whole = running.where("_before + _t <= _b").groupBy("mix").agg(F.max("range").alias("_last"))
    cut = running.where("_before <= _b and _before + _t > _b").select("mix", "range", "_before")
    # a row a mix each; no more of them than rows of the plan
    taken = timed.join(F.broadcast(whole) if small else whole, "mix").where("range <= _last")
    exact = Window.partitionBy("mix").orderBy("finish", "order", "doc_id", "round").rowsBetween(Window.unboundedPreceding, 0)
    last = timed.join(F.broadcast(cut) if small else cut, ["mix", "range"])
    last = last.withColumn("_sum", F.sum("n_tokens").over(exact) + F.col("_before")).where("_sum <= budget")
    cols = ["mix", "source", "doc_id", "round", "n_tokens"]
    return taken.select(*cols).unionByName(last.select(*cols)), rows


def _wanted(sized: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The wanted mixes and sources with their budget, and the plan of those that can give something."""
    corpus = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("corpus")).first()["corpus"]  # one number
    by_source = sized.where("source is not null and n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest"))
    wanted = targets.select(
        F.col("mix_name").alias("mix"),
        F.col("source").alias("name"),
        source_key(F.col("source")).alias("source"),
        F.col("target_weight").alias("weight"),
        F.col("max_repeats").cast("bigint").alias("repeats"),
        F.coalesce(F.nanvl("size_ratio", F.lit(0.0)), F.lit(0.0)).alias("size_ratio"),
    )
    ratios = wanted.groupBy("mix").agg(F.max("size_ratio").alias("size_ratio"))
    wanted = wanted.where("mix is not null and source is not null and weight > 0 and not isnan(weight) and repeats > 0")
    wanted = wanted.groupBy("mix", "source").agg(F.min("name").alias("name"), F.max("weight").alias("weight"), F.max("repeats").alias("repeats"))
    rows = wanted.join(ratios, "mix").join(by_source, "source", "left")
    zero = [F.coalesce(x, F.lit(0)).alias(x) for x in ("tokens", "longest")]
    budget = F.floor(F.greatest(F.col("size_ratio"), F.lit(0.0)) * F.lit(float(corpus))).alias("budget")
    share = (F.col("weight") / F.sum("weight").over(Window.partitionBy("mix"))).alias("target_share")
    rows = written(rows.select("mix", "source", "name", "weight", "repeats", *zero, budget, share), "targets")
    return rows, written(rows.groupBy("mix").applyInPandas(_plan, _PLAN), "plan")


def _running(sized: DataFrame, seed: int) -> DataFrame:
    """(source, doc_id, order, n_tokens, upto): the tokens of a source up to and with each document in the shuffled order."""
    order = F.md5(F.concat_ws(":", "doc_id", F.lit(seed)))
    docs = sized.where("source is not null and n_tokens > 0").withColumn("order", order).withColumn("slice", F.left("order", F.lit(SLICE_DIGITS)))
    within = Window.partitionBy("source", "slice").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = docs.groupBy("source", "slice").agg(F.sum("n_tokens").alias("_t"))
    slices = slices.select("source", "slice", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before"))
    summed = docs.withColumn("_in", F.sum("n_tokens").over(within)).join(slices, ["source", "slice"])
    return summed.select("source", "doc_id", "order", "n_tokens", (F.col("_in") + F.col("_before")).alias("upto"))


def shares(chosen: DataFrame, plan: DataFrame) -> DataFrame:
    """Per mix and wanted source: target_share, the tokens and documents chosen, the most times a document was, and the
    actual share, 0 for a source without documents."""
    times = chosen.groupBy("mix", "source", "doc_id").agg(F.count(F.lit(1)).alias("times"), F.sum("n_tokens").alias("tokens"))
    got = times.groupBy("mix", "source").agg(F.sum("tokens").alias("chosen_tokens"), F.count(F.lit(1)).alias("chosen_docs"), F.max("times").alias("most_times"))
    zero = [F.coalesce(x, F.lit(0)).alias(x) for x in ("chosen_tokens", "chosen_docs", "most_times")]
    both = plan.join(got, ["mix", "source"], "left").select(
        "mix",
        F.col("name").alias("source"),
        "target_share",
        F.col("repeats").alias("max_repeats"),
        "budget",
        *zero,
    )
    return both.withColumn("actual_share", F.coalesce(F.try_divide("chosen_tokens", F.sum("chosen_tokens").over(Window.partitionBy("mix"))), F.lit(0.0)))
