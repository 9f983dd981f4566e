"""The whole course: synthesis in steps, refinement, evaluation; each result is a table under one folder."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.models import embedded
from tessera.plans import evaluate, generate, refine
from tessera.sources.files import append_metrics, last_step, once


def schedule(text: str, epochs: int) -> list[float]:
    """Numbers that commas separate; a single one holds for all epochs and the start."""
    parts = [float(x) if "." in x else int(x) for x in text.split(",")]
    parts = parts * (epochs + 1) if len(parts) == 1 else parts
    if len(parts) != epochs + 1:
        raise ValueError(f"{text}: {epochs + 1} numbers are needed")
    return parts


@dataclass
class Settings:
    """Parameters of a run."""

    samples: list[int] = field(default_factory=lambda: [100, 100])
    copies: int = 2
    model: str = "echo"
    bins: int = 250
    cut: float = 0.1
    metric_size: int = 5000
    distance: float = 0.07
    runs: int = 1


def synthesise(private: DataFrame, folder: str, settings: Settings) -> DataFrame:
    """Step 0 makes variations of seeds with quotas by class; each later step varies what the last one made.

    A finished step is read again after a restart. All rows have row_id, label1 and text.
    """
    spark, steps = private.sparkSession, len(settings.samples)
    done = last_step(spark, folder, steps)
    for k in range(0 if done is None else done, steps):

        def make(k=k):
            if k == 0:
                made = generate.synthesis(private, settings.samples[0], settings.model, settings.copies)
            else:
                before = spark.read.parquet(f"{folder}/{k - 1}").withColumnRenamed("row_id", "doc_id")
                made = generate.synthesis(before, settings.samples[k], settings.model, settings.copies)
            return made.select(F.xxhash64(F.lit(k), "doc_id", "var_idx").alias("row_id"), "label1", "text")

        once(spark, f"{folder}/{k}", make)
    return spark.read.parquet(f"{folder}/{steps - 1}")


def run(private: DataFrame, folder: str, settings: Settings | None = None) -> DataFrame:
    """private: doc_id, text and label1. Returns the rows of metrics with their average."""
    settings = settings or Settings()
    spark = private.sparkSession
    made = synthesise(private, folder, settings).withColumnRenamed("row_id", "doc_id")
    clean = once(spark, f"{folder}/redacted", lambda: refine.redacted_texts(made))
    kept = once(spark, f"{folder}/filtered", lambda: clean.join(refine.refinement_filter(private, clean, settings.bins, settings.cut).select("doc_id"), "doc_id", "left_semi"))
    p, q = (once(spark, f"{folder}/vectors-{name}", lambda df=df: embedded(df.select(F.col("doc_id").alias("id"), "text")).select("id", "vector")) for name, df in (("private", private), ("made", kept)))
    for number in range(settings.runs):
        append_metrics(evaluate.metric_run(p, q, number, settings.metric_size, settings.distance), f"{folder}/metrics")
    return evaluate.averaged(spark.read.parquet(f"{folder}/metrics"))
