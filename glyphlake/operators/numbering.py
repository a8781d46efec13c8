"""Gapless numbers in a global order, and batches of a fixed size, without a window over all rows.

Rows are dealt by ranges of the order's columns and sorted inside each; a row's number is its place in its range plus the rows
of the ranges before, of which there are as many as partitions. Nulls come first where the order is ascending. Rows that are
equal in all of the order's columns get numbers in any order, fixed once they are stored; end the order with a unique column,
which also lets a value that many rows hold be split over ranges. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

_PLACE = (1 << 33) - 1


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "n", parts: int | None = None) -> DataFrame:
    """Adds `name`: 0, 1, ... in that order."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the id's upper bits are the partition, the lower 33 the place in it
    placed = stored(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__id", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("c"))
    # one row a partition
    starts, total = [], 0
    for r in counts.orderBy("__part").collect():
        starts.append((r["__part"], total))
        total += r["c"]
    firsts = spark.createDataFrame(starts, "__part long, __first long")
    return placed.join(F.broadcast(firsts), part == F.col("__part")).withColumn(name, F.col("__first") + F.col("__id").bitwiseAND(F.lit(_PLACE))).drop("__id", "__part", "__first")


def batched(df: DataFrame, order: Sequence[str | Column], size: int = 40) -> DataFrame:
    """Adds batch and place: runs of `size` rows in that order, the last one shorter."""
    rows = numbered(df, order, "__n")
    return rows.withColumn("batch", F.floor(F.col("__n") / size)).withColumn("place", (F.col("__n") % size).cast("int")).drop("__n")
