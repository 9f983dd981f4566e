"""Readers and writers of texts, labels, embeddings and metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import normalised
from tessera.operators.ranking import ranked


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, quotes doubled inside quoted cells, line breaks allowed in them; columns are strings, empty cells null."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)


def read_generated_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of generated text: without quoting and with backslashes before commas, if all its rows fit the header; else as read_csv."""
    lines = spark.read.text(path)
    header = next((r[0] for r in lines.limit(1).collect()), "")
    names = header.split(",")
    fields = F.split("value", r"(?<!\\),")
    bad = lines.where((F.size(fields) != len(names)) | F.exists(fields, lambda f: f.startswith('"')))
    if bad.limit(1).count():
        return read_csv(spark, path)
    plain = lambda k: F.nullif(F.regexp_replace(F.get(fields, F.lit(k)), r"\\(.)", "$1"), F.lit(""))
    return lines.where(F.col("value") != header).select(*(plain(k).alias(n) for k, n in enumerate(names)))


def _text_column(df: DataFrame, column: str = "text") -> Column:
    name = column if column in df.columns else df.columns[0]
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).alias("text")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Only the column text (or the first one) of a csv, tsv, json, jsonl or txt file; null is empty."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind in ("csv", "tsv"):
        return (lambda df: df.select(_text_column(df)))(spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', sep="\t" if kind == "tsv" else ","))
    if kind in ("json", "jsonl"):
        lines = spark.read.option("mode", "PERMISSIVE").json(path)
        if lines.columns == ["_corrupt_record"] or "_corrupt_record" in lines.columns:
            # not one object a line: a list of objects, or one object
            lines = spark.read.json(path, multiLine=True)
        return _from_json(lines)
    if kind == "txt":
        return spark.read.text(path).select(F.coalesce("value", F.lit("")).alias("text"))
    raise ValueError(f"{path}: none of csv, tsv, json, jsonl, txt")


def _from_json(df: DataFrame) -> DataFrame:
    name = "text" if "text" in df.columns else df.columns[0]
    if df.schema[name].dataType.typeName() == "array":
        # one object with lists
        return df.select(F.explode(name).alias("text")).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return df.select(_text_column(df))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """number (from 0, without gaps) and value of each line of a list that isn't blank; a lookup table."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.trim("value").alias("value")).where("value <> ''")
    return ranked(lines, "line").select((F.col("pos") - 1).alias("number"), "value")


def sample_rows(rows: DataFrame) -> DataFrame:
    """Rows (text, label) as samples are stored: empty texts dropped, white space as single spaces, the label split at tabs.

    Two labels give label1 and label2, one gives label, none is kept: by the number of fields that
    labels have at most.
    """
    clean = rows.select(normalised(F.col("text")).alias("text"), F.coalesce("label", F.lit("")).alias("label")).where("text <> ''")
    fields = clean.select(F.max(F.size(F.split("label", "\t")))).first()[0] or 0
    named = clean.where("label <> ''").limit(1).count() > 0
    if fields >= 2:
        part = F.split("label", "\t")
        return clean.select("text", F.get(part, F.lit(0)).alias("label1"), F.get(part, F.lit(1)).alias("label2"))
    return clean if named else clean.select("text")


def write_samples(rows: DataFrame, path: str) -> None:
    """sample_rows as CSV with a header."""
    sample_rows(rows).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_jsonl(rows: DataFrame, path: str, **names: str) -> None:
    """Columns as JSON lines, under other names if given: name of the field = column."""
    chosen = rows.select(*(F.col(c).alias(n) for n, c in names.items())) if names else rows
    chosen.write.mode("overwrite").json(path)


def write_embeddings(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_metrics(rows: DataFrame, path: str) -> None:
    """Adds rows of metrics to a table; makes it if there is none."""
    rows.write.mode("append").parquet(path)


def append_summary(rows: DataFrame, path: str) -> None:
    """Adds rows to a CSV of summaries, whose columns need not be the same; makes it if there is none.

    The table is small: it is read whole, and the new one is complete before it takes the place of the old one.
    """
    spark = rows.sparkSession
    text = rows.select(*(F.col(c).cast("string").alias(c) for c in rows.columns))
    if not exists(spark, path):
        return text.coalesce(1).write.csv(path, header=True, quote='"', escape='"')
    read_csv(spark, path).unionByName(text, allowMissingColumns=True).coalesce(1).write.csv(f"{path}.new", header=True, quote='"', escape='"')
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    old, new = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new"))
    store = old.getFileSystem(conf)
    store.delete(old, True)
    store.rename(new, old)


def write_word_counts(rows: DataFrame, path: str) -> None:
    """CSV rows target, gen and diff of the columns target and made, and a second folder with means and deviations of diff."""
    counts = rows.select("target", F.col("made").alias("gen"), (F.col("made") - F.col("target")).alias("diff"))
    counts.write.mode("overwrite").csv(path, header=True)
    ends = [f(x).alias(f"{name}_{what}") for x, what in ((F.abs("diff"), "abs"), (F.col("diff"), "diff")) for f, name in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    counts.agg(*ends).write.mode("overwrite").csv(f"{path}.summary", header=True)


def write_counts(votes: DataFrame, path: str) -> None:
    """CSV of a histogram: slot and votes, in order of slots."""
    votes.select("slot", "votes").orderBy("slot").write.mode("overwrite").csv(path, header=True)


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at `path`, made and written if it isn't there: a step that was done is not done again.

    A table counts as there when its writer has finished, so that an interrupted one is made anew.
    """
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def last_step(spark: SparkSession, folder: str, steps: int) -> int | None:
    """The greatest number below `steps` under whose name a finished table lies in `folder`."""
    return next((k for k in range(steps - 1, -1, -1) if exists(spark, f"{folder}/{k}/_SUCCESS")), None)
