"""Refinement of generated texts: redact, then drop the tail whose likelihood is like that of no private text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.redact import redacted
from tessera.operators.likelihood import equal_depth_bins, mean_nll, representatives, unigram_counts
from tessera.operators.ranking import percentile, ranked


def redacted_texts(texts: DataFrame, column: str = "text") -> DataFrame:
    """Rows as they are, with the text redacted where there is one."""
    return texts.withColumn(column, F.when(F.col(column).isNotNull(), redacted(F.col(column))))


def farthest_likelihood(scores: DataFrame, chosen: DataFrame) -> DataFrame:
    """`scores` with score: the greatest distance of nll to that of any chosen row.

    The greatest distance is to the least or to the greatest one, so no pairs are made.
    """
    ends = chosen.agg(F.min("nll").alias("lo"), F.max("nll").alias("hi"))
    return scores.join(F.broadcast(ends)).withColumn("score", F.round(F.greatest(F.abs(F.col("nll") - F.col("lo")), F.abs(F.col("nll") - F.col("hi"))), 6)).drop("lo", "hi")


def refinement_filter(private: DataFrame, synthetic: DataFrame, bins: int = 250, cut: float = 0.1, key: str = "doc_id") -> DataFrame:
    """key, nll and score of the synthetic texts that stay: those not below the `cut` percentile of score."""
    counts = unigram_counts(synthetic)
    chosen = representatives(equal_depth_bins(mean_nll(private, counts, key), "nll", key, bins), "nll")
    scores = farthest_likelihood(mean_nll(synthetic, counts, key), chosen).select(key, "nll", "score")
    ranks = ranked(scores, "score", key)
    least = percentile(ranks, "score", cut)
    return ranks.drop("pos") if least is None else ranks.where(F.col("score") >= least - 1e-9).drop("pos")
