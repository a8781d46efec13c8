"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, root): root is the smallest node of the component. Nodes without an edge don't appear.

    Every step moves nodes to smaller neighbours, so the number of steps grows with the logarithm of a component's size;
    a step joins each edge with the minimum around one end, so no neighbourhood is gathered in one place. Each step is
    written to the shared folder. Edges of a node to itself are ignored.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(least, F.col("a") == F.col("k")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        seen = Observation()
        star = small.unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct()
        now = written(star.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")), "edges")
        # the same edges again: every node points at its root
        was, mark = mark, (seen.get["n"], seen.get["x"])
        if was == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
