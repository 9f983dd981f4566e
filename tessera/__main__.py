"""python -m tessera {synthesise,refine,run}: the plans over CSV or Parquet files."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import pipeline, refine
from tessera.session import spark_session
from tessera.sources.files import read_csv


def str2bool(value: str | bool) -> bool:
    """The usual spellings of yes and no."""
    low = str(value).strip().lower()
    if low in ("yes", "true", "t", "y", "1"):
        return True
    if low in ("no", "false", "f", "n", "0"):
        return False
    raise argparse.ArgumentTypeError(f"{value!r} is neither yes nor no")


def _table(spark: SparkSession, path: str) -> DataFrame:
    rows = read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)
    if "doc_id" not in rows.columns:
        rows = rows.withColumn("doc_id", F.monotonically_increasing_id())
    return rows if "label1" in rows.columns else rows.withColumn("label1", F.lit("unknown"))


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    parser.add_argument("command", choices=("synthesise", "refine", "run"))
    parser.add_argument("--private", required=True)
    parser.add_argument("--synthetic", help="for refine")
    parser.add_argument("--out", required=True)
    parser.add_argument("--samples", default="100", help="of each step, separated by commas, or one number for all")
    parser.add_argument("--epochs", type=int, default=1)
    parser.add_argument("--copies", type=int, default=2)
    parser.add_argument("--model", default="echo")
    parser.add_argument("--runs", type=int, default=1)
    parser.add_argument("--show", type=str2bool, default=True, help="print the metrics of a run")
    given = parser.parse_args(args)
    spark = spark_session()
    settings = pipeline.Settings([int(x) for x in pipeline.schedule(given.samples, given.epochs)], given.copies, given.model, runs=given.runs)
    private = _table(spark, given.private).select("doc_id", "text", "label1")
    if given.command == "synthesise":
        pipeline.synthesise(private, given.out, settings)
    elif given.command == "run":
        found = pipeline.run(private, given.out, settings)
        if given.show:
            found.show(truncate=False)
    else:
        if not given.synthetic:
            parser.error("refine needs --synthetic")
        made = refine.redacted_texts(_table(spark, given.synthetic))
        made.join(refine.refinement_filter(private, made).select("doc_id"), "doc_id", "left_semi").write.mode("overwrite").parquet(given.out)


if __name__ == "__main__":
    main()
