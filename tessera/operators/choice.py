"""Choice among generated candidates: scores, noise for differential privacy, second attempts."""

from __future__ import annotations

from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import hash_gaussian

#: Confidence from which a label counts.
MIN_CONFIDENCE = 0.55


def sigma(rows: int, epsilon: float | None) -> float:
    """Scale of the noise for a number of rows; 0 without a finite positive epsilon."""
    if epsilon is None or epsilon <= 0 or epsilon == float("inf"):
        return 0.0
    n = max(rows, 2)
    delta = 1 / (n * max(log(n), 1.0))
    return sqrt(2 * log(1.25 / max(delta, 1e-12))) / max(epsilon, 1e-12)


def agreement(label: Column, target: Column) -> Column:
    """1 if labels agree, 0 if not, a half without a target."""
    return F.when(target.isNull(), 0.5).otherwise((label == target).cast("double"))


def score(similarity: Column, agree: Column, target: Column, alpha: float = 0.75, penalty: float = 0.15) -> Column:
    base = alpha * similarity + (1 - alpha) * agree
    return F.when(target.isNull(), base).otherwise(base - penalty * (1 - agree))


def chosen(candidates: DataFrame, key: str, noise: float = 0.0, seed: int = 42) -> DataFrame:
    """Of each key's candidates (cand, similarity, label, confidence, target) the best, with its score.

    Candidates with the wanted label and enough confidence go first, if there are any. With noise,
    scores are spread to [0, 1] and noise is added to each before the greatest is taken; equal ones
    are ordered by number.
    """
    agree = agreement(F.col("label"), F.col("target"))
    rated = candidates.withColumn("agree", agree).withColumn("score", F.round(score(F.col("similarity"), F.col("agree"), F.col("target")), 9))
    rated = rated.withColumn("valid", (F.col("agree") == 1) & (F.col("confidence") >= MIN_CONFIDENCE))
    # a few candidates to the key
    sets = rated.groupBy(key).agg(F.collect_list(F.struct(*(c for c in rated.columns if c != key))).alias("all"))
    pool = F.when(F.exists("all", lambda x: x["valid"]), F.filter("all", lambda x: x["valid"])).otherwise(F.col("all"))
    sets = sets.select(key, pool.alias("pool")).withColumns({"lo": F.array_min(F.transform("pool", lambda x: x["score"])), "hi": F.array_max(F.transform("pool", lambda x: x["score"]))})
    each = sets.select(key, "lo", "hi", F.explode("pool").alias("c")).select(key, "lo", "hi", "c.*")
    rank = F.col("score")
    if noise > 0:
        spread = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
        rank = spread + noise * hash_gaussian(seed, F.concat_ws("|", F.col(key).cast("string"), F.col("cand").cast("string")))
    best = F.max_by(F.struct(*(c for c in each.columns if c not in (key, "lo", "hi"))), F.struct(rank, -F.col("cand")))
    return each.groupBy(key).agg(best.alias("best")).select(key, "best.*")


def second_attempt(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The first choice, or the second if the first misses its target and the second is better.

    Better: it has the wanted label with no less confidence, or it is more similar.
    """
    names = [c for c in first.columns if c != key]
    both = first.join(second.select(key, *(F.col(c).alias(f"b_{c}") for c in names)), key)
    retry = F.col("target").isNotNull() & ~((F.col("agree") == 1) & (F.col("confidence") >= MIN_CONFIDENCE))
    better = ((F.col("b_agree") == 1) & (F.col("b_confidence") >= F.col("confidence"))) | (F.col("b_similarity") > F.col("similarity"))
    take = retry & better
    return both.select(key, *(F.when(take, F.col(f"b_{c}")).otherwise(F.col(c)).alias(c) for c in names), F.when(take, 2).otherwise(1).alias("attempt"))
