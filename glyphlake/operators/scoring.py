"""Scores of reads against truths: pairs by place, hit rates, photos' cards, the lines that are read at all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .reading import EDGE


def unsure(trust: Column, edge: float = EDGE) -> Column:
    """Below the edge; null and -1 are unmeasured and aren't."""
    return F.coalesce((trust >= 0) & (trust < edge), F.lit(False))


def zipped(reads: DataFrame, truths: DataFrame, keys: Sequence[str], at: str, text: str) -> DataFrame:
    """The i-th read of a key by the i-th truth, from 0: keys, pos, read, truth. What one side has more is left out."""
    def placed(rows, name):
        return rows.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy(at)) - 1).alias("pos"), F.col(text).alias(name))

    return placed(reads, "read").join(placed(truths, "truth"), [*keys, "pos"])


def hit_rates(pairs: DataFrame, keys: Sequence[str], read: str = "read", truth: str = "truth") -> DataFrame:
    """lines, letters of the truths, hits (letters met at their place), letter_rate over all lines together and line_rate;
    null counts as empty."""
    a, b = T.chars(F.coalesce(read, F.lit(""))), T.chars(F.coalesce(truth, F.lit("")))
    hits = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))
    rows = pairs.select(*keys, hits.alias("__h"), F.size(b).alias("__n"), F.coalesce(F.col(read), F.lit("")).eqNullSafe(F.coalesce(F.col(truth), F.lit(""))).cast("int").alias("__s"))
    told = rows.groupBy(*keys).agg(F.count("*").alias("lines"), F.sum("__n").alias("letters"), F.sum("__h").alias("hits"), F.avg("__s").alias("line_rate"))
    return told.withColumn("letter_rate", F.col("hits") / F.greatest("letters", F.lit(1)))


def photo_card(lines: DataFrame, keys: Sequence[str], photo: str, score: str, trust: str, gauge: str, goal: float = 95.0) -> DataFrame:
    """One row a key. Every photo has one vote, the mean of its lines: photos, mean, low, reached (photos at the goal or
    above), worst (the photo of the lowest mean, then of the smallest name), unsure lines, gated (the mean if unsure lines
    count 0). Photos that are only gauged are told apart, as gauge_photos and gauge_mean, and are in no other figure."""
    blank = unsure(F.col(trust))
    photos = lines.groupBy(*keys, photo, gauge).agg(F.avg(score).alias("m"), F.avg(F.when(blank, 0.0).otherwise(F.col(score))).alias("g"), F.sum(blank.cast("long")).alias("u"))
    real = ~F.coalesce(F.col(gauge), F.lit(False))
    of = lambda c: F.when(real, c)
    worst = F.min(of(F.struct(F.round("m", 6).alias("m"), F.col(photo).alias("name"))))
    return photos.groupBy(*keys).agg(
        F.count(of(F.lit(1))).alias("photos"), F.avg(of(F.col("m"))).alias("mean"), F.min(of(F.col("m"))).alias("low"), F.count(F.when(real & (F.col("m") >= goal), 1)).alias("reached"), worst["name"].alias("worst"),
        F.coalesce(F.sum(of(F.col("u"))), F.lit(0)).alias("unsure"), F.avg(of(F.col("g"))).alias("gated"), F.count(F.when(~real, 1)).alias("gauge_photos"), F.avg(F.when(~real, F.col("m"))).alias("gauge_mean"),
    )


def first_lines(boxes: DataFrame, keys: Sequence[str], cut: str, top: str, most: int) -> DataFrame:
    """The first `most` boxes of a key in the order they were cut, with `place` (from 0) by top; the order of cutting wins ties."""
    kept = boxes.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(cut))).where(F.col("__r") <= most)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(top, "__r")) - 1).drop("__r")
