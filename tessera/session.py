"""Session settings and the input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def spark_session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with adaptive execution, for local use and tests; a cluster brings its own."""
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false"}
    return SparkSession.builder.master(master).config(map=base | conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _label(column: str, yes: str, no: str) -> Column:
    return F.when(F.col(column) == 1, yes).when(F.col(column) == 0, no).otherwise("unknown")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample table: doc_id, text, label1 (sentiment) and label2, which are `unknown` without a label."""
    labels = table(spark, sf_dir, "labels").select("doc_id", _label("quality", "positive", "negative").alias("label1"), _label("toxic", "toxic", "plain").alias("label2"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(labels, "doc_id", "left").fillna("unknown", ["label1", "label2"])


def private(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """The half of a table that stands for private rows."""
    return df.where(F.col(key) % 2 == 0)


def synthetic(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """The half of a table that stands for generated rows."""
    return df.where(F.col(key) % 2 == 1)
