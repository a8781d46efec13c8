"""Measures of cells given as pixel rows (cell, y, x, v): ink, darkness, margins, blobs and strokes, by aggregates and windows.

A cell's pixels are spread over rows, so no cell is gathered; windows run over a cell's 256 grey values or its columns.
Nulls and empties: a cell without ink has an ink share of 0 and nulls elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequence import islands

#: Ink is darker than EDGE; pale pixels up to PALE count as fringe; darkness needs LEAST inked pixels.
EDGE, PALE, LEAST = 200, 236, 40


def facts(pixels: DataFrame, edge: int = EDGE, pale: int = PALE, least: int = LEAST) -> DataFrame:
    """cell -> ink (share of all pixels), density (share of the box around ink), dark10 and mid (grey value at which a tenth
    and half of the ink is reached), fringe (pale pixels for each inked one), and the box."""
    inked = F.col("v") < edge
    box = [f(F.when(inked, F.col(c))).alias(n) for f, c, n in ((F.min, "x", "left"), (F.min, "y", "top"), (F.max, "x", "right"), (F.max, "y", "bottom"))]
    sums = pixels.groupBy("cell").agg(F.count("*").alias("total"), F.count(F.when(inked, 1)).alias("inked"), F.count(F.when((F.col("v") >= edge) & (F.col("v") < pale), 1)).alias("pale"), *box)
    steps = pixels.where(inked).groupBy("cell", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("cell").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    all_ = F.sum("n").over(Window.partitionBy("cell"))
    dark = steps.withColumn("upto", upto).withColumn("all", all_).groupBy("cell").agg(*[F.min(F.when(F.col("upto") >= F.col("all") * share, F.col("v"))).alias(name) for share, name in ((0.1, "dark10"), (0.5, "mid"))])
    enough = F.col("inked") >= least
    area = (F.col("right") - F.col("left") + 1) * (F.col("bottom") - F.col("top") + 1)
    return sums.join(dark, "cell", "left").select(
        "cell", (F.col("inked") / F.col("total")).alias("ink"), (F.col("inked") / area).alias("density"),
        F.when(enough, F.col("dark10")).alias("dark10"), F.when(enough, F.col("mid")).alias("mid"), F.when(enough, F.col("pale") / F.col("inked")).alias("fringe"), "left", "top", "right", "bottom",
    )


def margins(pixels: DataFrame, edge: int = EDGE) -> DataFrame:
    """cell -> edge_up, edge_side: mean blank above and below, and left and right, over the ink's height."""
    inked = F.col("v") < edge
    box = pixels.groupBy("cell").agg(F.min(F.when(inked, F.col("y"))).alias("t"), F.max(F.when(inked, F.col("y"))).alias("b"), F.min(F.when(inked, F.col("x"))).alias("l"), F.max(F.when(inked, F.col("x"))).alias("r"), (F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")).where("t IS NOT NULL")
    tall = F.col("b") + 1 - F.col("t")
    return box.select("cell", ((F.col("t") + F.col("h") - F.col("b") - 1) / 2 / tall).alias("edge_up"), ((F.col("l") + F.col("w") - F.col("r") - 1) / 2 / tall).alias("edge_side"))


def blobs(pixels: DataFrame, edge: int = EDGE, least: int = 8) -> DataFrame:
    """cell -> blob: upper median of the widths of runs of inked columns, over the ink's height; 0 if that is under `least`."""
    inked = pixels.where(F.col("v") < edge)
    tall = inked.groupBy("cell").agg((F.max("y") - F.min("y") + 1).alias("tall"))
    runs = islands(inked.select("cell", "x").distinct(), ["cell"], "x", 1).withColumn("wide", F.col("end") - F.col("start") + 1)
    order = Window.partitionBy("cell").orderBy("wide", "start")
    middle = runs.withColumn("r", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy("cell"))).where(F.col("r") == F.floor(F.col("n") / 2))
    return middle.join(tall, "cell").select("cell", F.when(F.col("tall") < least, 0.0).otherwise(F.col("wide") / F.col("tall")).alias("blob"))


def strokes(pixels: DataFrame, edge: int = 128) -> DataFrame:
    """cell -> stroke: twice the ink's area over what one pixel of erosion takes from it, over the ink's height. A pixel stays
    if every neighbour inside the cell is inked."""
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    blank = pixels.where(F.col("v") >= edge).select("cell", F.explode(offsets).alias("o"), "y", "x").select("cell", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).distinct()
    inked = pixels.where(F.col("v") < edge).select("cell", "y", "x")
    eaten = inked.join(blank, ["cell", "y", "x"], "left_semi").groupBy("cell").agg(F.count("*").alias("eaten"))
    whole = inked.groupBy("cell").agg(F.count("*").alias("area"), (F.max("y") - F.min("y") + 1).alias("tall"))
    return whole.join(eaten, "cell", "left").select("cell", F.coalesce(2 * F.col("area") / F.col("eaten") / F.col("tall"), F.lit(0.0)).alias("stroke"))
