"""Labels of texts from the labels of their chunks, and comparison of labels in pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import char_chunks, hash_uniform
from tessera.operators.ranking import ranked

ERROR = "ERROR"


def stand_in_label(text: Column, salt: str = "label") -> Column:
    """A sentiment for a chunk from its hash: a deterministic stand-in for a classifier."""
    u = hash_uniform(F.lit(salt), text)
    return F.when(u < 0.45, "NEGATIVE").when(u < 0.9, "POSITIVE").when(u < 0.97, "NEUTRAL").otherwise(ERROR)


def chunk_labels(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, chunk_no, label and score (in whole millionths) of each chunk of characters."""
    chunks = texts.select(key, F.posexplode(char_chunks(F.col("text"))).alias("chunk_no", "chunk"))
    return chunks.select(key, "chunk_no", stand_in_label(F.col("chunk")).alias("label"), ((500_000 + F.floor(hash_uniform(F.lit("score"), F.col("chunk")) * 500_000)) / 1e6).alias("score"))


def majority(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and label: the most common one; if the two most common tie, that of the last chunk; errors don't vote."""
    votes = labels.groupBy(key, "label").agg(F.count("*").alias("n"), F.max("chunk_no").alias("last"))
    valid = F.col("label") != ERROR
    best = votes.groupBy(key).agg(
        F.sort_array(F.collect_list(F.when(valid, F.struct("n", "last", "label"))), asc=False).alias("all"),
        F.max_by(F.when(valid, F.col("label")), F.when(valid, F.col("last"))).alias("final"),
    )
    tie = (F.size("all") > 1) & (F.get("all", F.lit(0))["n"] == F.get("all", F.lit(1))["n"])
    return best.select(key, F.coalesce(F.when(tie, F.col("final")).otherwise(F.get("all", F.lit(0))["label"]), F.lit(ERROR)).alias("label"))


def confident(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, label and confidence: most chunks, then the greatest mean score, then the label of the earliest chunk."""
    # whole millionths add up the same in any order
    mean = F.sum(F.round(F.col("score") * 1e6).cast("long")) / (F.count("*") * 1e6)
    votes = labels.where(F.col("label") != ERROR).groupBy(key, "label").agg(F.count("*").alias("n"), mean.alias("confidence"), F.min("chunk_no").alias("first"))
    return votes.groupBy(key).agg(F.max_by(F.struct("label", "confidence"), F.struct("n", "confidence", -F.col("first"))).alias("best")).select(key, "best.*")


def paired(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of both tables with the same place in the order of their keys: pos, and both sides' columns as a_ and b_."""
    left, right = (ranked(df, key).select("pos", *(F.col(c).alias(f"{side}_{c}") for c in df.columns)) for side, df in (("a", a), ("b", b)))
    return left.join(right, "pos")


def match_rate(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """total_pairs (without errors on either side), match_count and match_rate in per cent."""
    valid = (F.col(a) != ERROR) & (F.col(b) != ERROR)
    found = pairs.agg(F.count_if(valid).alias("total_pairs"), F.count_if(valid & (F.col(a) == F.col(b))).alias("match_count"))
    return found.withColumn("match_rate", F.when(F.col("total_pairs") > 0, F.bround(100 * F.col("match_count") / F.col("total_pairs"), 2)).otherwise(0.0))
