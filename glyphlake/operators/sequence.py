"""Order-dependent operators: islands, overlaps, longest runs, odd gaps, running bests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: Sequence[str], at: str, gap: float) -> DataFrame:
    """Runs of positions at most `gap` apart: keys, start, end, n."""
    order = Window.partitionBy(*keys).orderBy(at)
    fresh = F.coalesce((F.col(at) - F.lag(at).over(order) > gap).cast("int"), F.lit(1))
    rows = df.withColumn("__f", fresh).withColumn("__run", F.sum("__f").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "__run").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n")).drop("__run")


def overlap_rows(df: DataFrame, keys: Sequence[str], top: str, bottom: str, tie: str) -> DataFrame:
    """Rows of boxes: a new one begins where a top is at or below all bottoms before it. Adds row, from 0."""
    order = Window.partitionBy(*keys).orderBy(top, tie)
    before = F.max(bottom).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col(top) >= before).cast("int"), F.lit(0))
    return df.withColumn("__f", fresh).withColumn("row", F.sum("__f").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__f")


def headline(rows: DataFrame, keys: Sequence[str], size: str, tie: str) -> DataFrame:
    """The largest of the boxes that are alone in their row; the first wins ties."""
    alone = rows.withColumn("__n", F.count("*").over(Window.partitionBy(*keys, "row"))).where("__n = 1").drop("__n")
    best = Window.partitionBy(*keys).orderBy(F.desc(size), tie)
    return alone.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")


def longest_run(df: DataFrame, keys: Sequence[str], at: str, gap: float) -> DataFrame:
    """The longest island when up to `gap` misses are tolerated; the first wins ties."""
    best = Window.partitionBy(*keys).orderBy(F.desc(F.col("end") - F.col("start")), "start")
    return islands(df, keys, at, gap + 1).withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")


def odd_gap_split(df: DataFrame, keys: Sequence[str], at: str, gap: int, factor: float = 2.0) -> DataFrame:
    """Islands with a fine gap of max(2, gap // 4), split again only where a space stands out: at max(gap, factor times
    the second largest space)."""
    fine = islands(df, keys, at, max(2, gap // 4))
    order = Window.partitionBy(*keys).orderBy("start")
    spaced = fine.withColumn("space", F.col("start") - F.lag("end").over(order))
    by_size = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("space"))
    second = spaced.withColumn("__k", F.row_number().over(by_size)).groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("__k") == 2, F.col("space"))), F.lit(0)).alias("__second"))
    limit = F.greatest(F.lit(gap), F.bround(F.col("__second") * factor))
    rows = spaced.join(second, list(keys)).withColumn("__f", F.coalesce((F.col("space") > limit).cast("int"), F.lit(1)))
    rows = rows.withColumn("__run", F.sum("__f").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("__run")


def running_best(df: DataFrame, keys: Sequence[str], at: str, value: str, tolerance: float = 1.05) -> DataFrame:
    """Adds best (least so far, before this row) and slower (over tolerance times it)."""
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("best", F.min(value).over(before)).withColumn("slower", F.coalesce(F.col(value) > F.col("best") * tolerance, F.lit(False)))


def cumulative(df: DataFrame, keys: Sequence[str], at: str, weight: str) -> DataFrame:
    """Adds lo and hi: the running sum of weights before and after each row."""
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("hi", F.sum(weight).over(w)).withColumn("lo", F.col("hi") - F.col(weight))


def schedule(step, warmup: int, total: int):
    """Learning-rate factor of a step column: linear warm-up, then half a cosine."""
    done = F.least(F.lit(1.0), (step - warmup) / max(1, total - warmup))
    return F.when(step < warmup, step / max(1, warmup)).otherwise(0.5 * (1 + F.cos(F.lit(3.141592653589793) * done)))
