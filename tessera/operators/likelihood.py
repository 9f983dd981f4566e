"""A unigram language model as a stand-in for likelihood scores, and equal-depth bins of scores."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import words
from tessera.operators.ranking import ranked
from tessera.storage import written

#: The most common words, which every task holds.
COMMON = 100_000


def unigram_counts(texts: DataFrame) -> DataFrame:
    """word and n over all texts; written, as it is read several times."""
    return written(texts.select(F.explode(words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "unigrams")


def mean_nll(texts: DataFrame, counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_words and nll: the mean negative log likelihood of a word, six decimals; texts without words are left out.

    The `COMMON` most common words are looked up where the text is; of the others a text sends one row
    each to meet its count, and they are rare, so no key of that join is hot.
    """
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    size = max(1, total + kinds)
    # COMMON rows at most
    common = counts.orderBy(F.desc("n"), "word").limit(COMMON).toArrow()
    least = min(common["n"].to_pylist(), default=0)
    shared = texts.sparkSession.sparkContext.broadcast({w.encode(): -log((n + 1) / size) for w, n in zip(common["word"].to_pylist(), common["n"].to_pylist(), strict=True)})
    # with all words at hand, others have no count
    unseen = -log(1 / size) if common.num_rows == kinds else None

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            at, word, times, loss = [], [], [], []
            for row, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                found, sum_of = 0, 0.0
                # white space of bytes is that of words()
                for w, n in Counter((text or b"").split()).items():
                    own = held.get(w, unseen)
                    if own is None:
                        at.append(row), word.append(w), times.append(n), loss.append(None)
                    else:
                        found += n
                        sum_of += n * own
                if found:
                    # no word has a space
                    at.append(row), word.append(b" %d" % row), times.append(found), loss.append(sum_of)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(word, pa.binary()).cast(pa.string()), pa.array(times, pa.int64()), pa.array(loss, pa.float64())], [key, "word", "times", "loss"])

    own = texts.select(key, "text")
    parts = own.mapInArrow(add, f"`{key}` {own.schema[key].dataType.simpleString()}, word string, times long, loss double")
    loss = F.col("loss")
    if unseen is None:
        parts = parts.join(counts.where(F.col("n") <= least), "word", "left")
        loss = F.coalesce(loss, F.col("times") * -F.log((F.coalesce("n", F.lit(0)) + 1) / F.lit(size)))
    return parts.groupBy(key).agg(F.sum("times").alias("n_words"), F.round(F.sum(loss) / F.sum("times"), 6).alias("nll"))


def equal_depth_bins(scores: DataFrame, value: str, key: str, bins: int = 250) -> DataFrame:
    """`scores` with pos and bin: bins of floor(n / bins) rows by rising value; the last takes the rest."""
    ranks = ranked(scores, value, key)
    n = ranks.count()
    number = max(1, min(bins, n))
    size = max(1, n // number)
    return ranks.withColumn("bin", F.least(F.floor((F.col("pos") - 1) / size), F.lit(number - 1)).cast("long"))


def representatives(binned: DataFrame, value: str) -> DataFrame:
    """Of each bin the row nearest the mean, the first of equals; with bin_mean."""
    mean = binned.groupBy("bin").agg(F.avg(value).alias("bin_mean"))
    # as many rows as bins
    apart = binned.join(F.broadcast(mean), "bin")
    row = F.struct(*binned.columns, "bin_mean")
    return apart.groupBy("bin").agg(F.min_by(row, F.struct(F.round(F.abs(F.col(value) - F.col("bin_mean")), 9), F.col("pos"))).alias("r")).select("r.*")
