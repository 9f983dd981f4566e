"""Global order without one task that sees all rows: ranks, order statistics and smallest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.storage import written

#: Rows up to which a bounded selection goes through one ordered limit.
SMALL = 10_000


def ranked(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """`df` with each row's place (from 1) in the order, which must be total.

    Rows are dealt to ranges and sorted there; the ranges' sizes, one row per partition, then give
    each range its first place. Written once, so that both passes see the same ranges.
    """
    sort = [F.col(c) for c in order]
    dealt = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    dealt = written(dealt.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranked")
    sizes = sorted((r["_range"], r["n"], r["first"]) for r in dealt.groupBy("_range").agg(F.count("*").alias("n"), F.min("_at").alias("first")).collect())
    starts, before = [], 0
    for number, n, first in sizes:
        starts.append((number, before - first + 1))
        before += n
    if not starts:
        return dealt.drop("_range", "_at").withColumn(name, F.lit(0).cast("long"))
    # one row per partition
    table = df.sparkSession.createDataFrame(starts, "_range int, _shift long")
    return dealt.join(F.broadcast(table), "_range").withColumn(name, F.col("_at") + F.col("_shift")).drop("_range", "_at", "_shift")


def at_positions(df: DataFrame, positions: DataFrame, *order: str) -> DataFrame:
    """Rows of `df` whose places in the order (from 0) are in the column pos of `positions`, with pos; places outside are ignored."""
    places = ranked(df, *order).withColumn("pos", F.col("pos") - 1)
    return places.join(positions.select(F.col("pos").cast("long").alias("pos")).distinct(), "pos")


def percentile(ranks: DataFrame, value: str, share: float, pos: str = "pos") -> float | None:
    """The linearly interpolated percentile of a column by which `ranks` is ranked; None without rows."""
    n = ranks.count()
    if not n:
        return None
    at = 1 + share * (n - 1)
    low = int(at)
    found = {r[0]: r[1] for r in ranks.where(F.col(pos).isin(low, min(low + 1, n))).select(pos, value).collect()}
    return float(found[low] + (found[min(low + 1, n)] - found[low]) * (at - low))


def smallest(df: DataFrame, count: int, order: Column, key: str) -> DataFrame:
    """The `count` rows of least `order` (hexadecimal text, evenly spread), then key.

    Many rows are cut by the first four digits: whole groups of digits below the cut, and an
    ordered part of the one group at the cut, which holds one row in 65,536 on average.
    """
    df = df.withColumn("_order", order)
    if count <= SMALL:
        return df.orderBy("_order", key).limit(max(0, count)).drop("_order")
    df = df.withColumn("_digits", F.substring("_order", 1, 4))
    below = 0
    for digits, n in sorted(df.groupBy("_digits").count().collect()):
        if below + n > count:
            rest = df.where(F.col("_digits") == digits).orderBy("_order", key).limit(count - below)
            return df.where(F.col("_digits") < digits).union(rest).drop("_order", "_digits")
        below += n
    return df.drop("_order", "_digits")
