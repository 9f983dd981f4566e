"""A training-data pipeline over the table `documents`, made of the operators in tessera.llm.

Each stage takes (spark, docs, sf_dir), works on all rows of `docs` and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All stages but the last return the
columns of `documents`, and any others that the table has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontaminate import contaminated
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.line_quality import line_quality
from tessera.llm.near_dup import near_duplicates
from tessera.llm.piece_codec import piece_codec
from tessera.llm.queries import fold
from tessera.llm.shared import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier doesn't reject; empty texts are scored as any other."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = line_quality(docs, labels, fold(5, 0), carry=True).where("predicted = 1")
    return kept.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that others share; one may be left without text."""
    found = dedup_lines(docs, carry=True)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return found.select(*((new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns))


def _without(docs: DataFrame, ids: DataFrame, nulls: bool) -> DataFrame:
    """`docs` without the rows whose doc_id is in the one column of `ids`; a null there counts if `nulls`."""
    name = "gone"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    ids = ids.toDF(name).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col(name)) if nulls else F.col("doc_id") == F.col(name), "left_anti")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id.

    Groups are those of op3: pairs of words, a similarity of 0.8. Texts without a word and rows
    without an id all stay, and so does every row whose id is its group's smallest.
    """
    return _without(docs, near_duplicates(docs, shingle_words=2).where("not kept").select("doc_id"), False)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; rows without an id stay or go together."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, contaminated(docs, items).select("doc_id"), True)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded (text) of each document."""
    import public_tokenizers

    coded = piece_codec(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("benchmark", benchmark), ("pieces", pieces)]
#: SQL can't express the classifier, nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = written(docs, name)
    return docs
