"""Folder for intermediate tables and other small helpers."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Text sent to a Python worker at a time.
ARROW_BYTES = 8 << 20
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []
_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not _own:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        holder = tempfile.TemporaryDirectory(prefix="tessera-")
        atexit.register(holder.cleanup)
        _own.append(f"file://{holder.name}")
    return _own[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # nothing but this write reads its shuffles: they go as soon as it ends
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    _made.update(name.rsplit("/", 1)[0] for name in out.inputFiles()[:1])
    return out


def freed(*tables: DataFrame, shuffles: bool = True) -> None:
    """Deletes written tables that nothing reads any more, and lets Spark drop the shuffles behind them."""
    for table in tables:
        jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
        # only folders that `written` made are ever deleted
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()} & _made:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
            _made.discard(folder)
    if tables and shuffles:
        swept(tables[0].sparkSession)


def swept(spark: SparkSession) -> None:
    """Lets Spark drop the shuffles of plans that nothing holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sized(spark: SparkSession) -> None:
    """Bounds what a Python worker receives at once, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
