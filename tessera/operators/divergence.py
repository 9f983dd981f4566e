"""Divergences between two histograms over clusters; a histogram has one row per cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import written


def histogram(p: DataFrame, q: DataFrame, bins: int, label: str = "label") -> DataFrame:
    """bin, p and q: shares of both sides in each of `bins` clusters, 0 where a side has none."""
    every = p.sparkSession.range(bins).select(F.col("id").alias("bin"))
    side = lambda df, name: df.groupBy(F.col(label).cast("long").alias("bin")).agg(F.count("*").alias(name))
    both = every.join(side(p, "n_p"), "bin", "left").join(side(q, "n_q"), "bin", "left").fillna(0)
    # one row per cluster
    total = both.agg(F.sum("n_p").alias("t_p"), F.sum("n_q").alias("t_q"))
    shares = both.join(F.broadcast(total)).select("bin", (F.col("n_p") / F.col("t_p")).alias("p"), (F.col("n_q") / F.col("t_q")).alias("q"))
    # small, and read several times
    return written(shares, "histogram")


def _filled(name: str) -> Column:
    return F.when(F.col(name) == 0, 1e-8).otherwise(F.col(name))


def kl_tv_w1(hist: DataFrame) -> DataFrame:
    """kl, tv and wass, with empty bins at 1e-8. wass compares the sorted shares, not the bins' places."""
    h = hist.select("bin", _filled("p").alias("p"), _filled("q").alias("q"))
    sums = h.agg(F.sum(F.expr("p * ln(p / q) - p + q")).alias("kl"), (F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("tv"))
    one = lambda c: h.agg(F.sort_array(F.collect_list(c)).alias(c))
    wass = one("p").join(one("q")).select(F.expr("aggregate(zip_with(p, q, (x, y) -> abs(x - y)), 0D, (a, x) -> a + x) / size(p)").alias("wass"))
    return sums.join(wass)


def frontier_integral(hist: DataFrame, scale: float = 2.0) -> DataFrame:
    """The area under the divergence frontier in closed form."""
    part = "case when p = 0 and q = 0 then 0D when p = 0 then q / 4 when q = 0 then p / 4 when abs(p - q) > 1e-8 then 0.25 * (p + q) - 0.5 * (p * q * (ln(p) - ln(q)) / (p - q)) else 0D end"
    return hist.agg((F.sum(F.expr(part)) * scale).alias("frontier"))


def divergence_curve(hist: DataFrame, points: int = 25, scale: float = 5.0) -> DataFrame:
    """step, x and y: exp(-scale * KL) of both sides against mixtures of them, and the two extreme points."""
    spark = hist.sparkSession
    weight = spark.range(points).select((F.col("id") + 1).alias("step"), (F.lit(1e-6) + F.col("id") * ((1 - 2e-6) / (points - 1))).alias("w"))
    mixed = hist.join(F.broadcast(weight)).withColumn("r", F.expr("w * p + (1 - w) * q"))
    kl = lambda a: F.when(F.max(F.expr(f"{a} != 0 and r = 0")), float("inf")).otherwise(F.sum(F.expr(f"case when {a} != 0 then {a} * ln({a} / r) else 0D end")))
    curve = mixed.groupBy("step").agg(F.exp(-scale * kl("q")).alias("x"), F.exp(-scale * kl("p")).alias("y"))
    ends = spark.createDataFrame([(0, 1.0, 0.0), (points + 1, 0.0, 1.0)], "step long, x double, y double")
    return curve.unionByName(ends)


def mauve(curve: DataFrame) -> DataFrame:
    """The mean of the areas under a curve, taken along x and along y; one row per point of the curve."""

    def area(a: str, b: str, name: str) -> DataFrame:
        order = Window.orderBy(F.col(a), F.col("step") if a == "y" else -F.col("step"))
        part = (F.col(a) - F.lag(a).over(order)) * (F.col(b) + F.lag(b).over(order)) / 2
        return curve.select(part.alias("part")).agg(F.sum("part").alias(name))

    return area("x", "y", "ax").join(area("y", "x", "ay")).select(((F.col("ax") + F.col("ay")) / 2).alias("mauve"))
