"""The bounded sample of labelled rows that classifiers are fitted on."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, rows: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[int]]:
    """Texts and 0/1 labels of at most `rows` labelled documents outside the held-out fold.

    The ids with the least hashes are taken, so any run takes the same ones. A document with several
    labels has the greatest; null labels and ids are left out.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~F.coalesce(held_out, F.lit(False)))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # at most `rows` rows are broadcast
    got: pa.Table = texts.join(F.broadcast(known), "doc_id").select("doc_id", "text", "label").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return [x or "" for x in got.column("text").to_pylist()], got.column("label").to_pylist()
