"""Twins of bitmaps: pictures that overlap too much to be different designs.

Pictures are packed to 64 pixels a long. Each distinct picture is compared with each distinct test picture whose count of inked
pixels can give the ratio: rows are spread by their pixels and sorted, so copies lie side by side and are compared once, and
travel in packs of an Arrow batch, as do the test pictures, of which every part gets all packs. A pack of pictures meets one
pack of test pictures at a time: test pictures are sorted by their count, and of one count only the largest overlap matters.
A pack's best are reduced where they are found, so what is shuffled grows with the pictures and not with the pairs.

That is quadratic in distinct pictures, at a bit count a pair, and bounded in memory by two packs. A picture without ink has no
twin. Equal test pictures are one, named by the first of them. Null pictures are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: from here on two designs count as one.
TWIN = 0.7
#: Parts of the pictures for each shuffle partition.
PARTS = 4
#: Most pictures of a pack, and overlaps counted at once.
PACK, AT_ONCE = 8192, 1 << 17


def packed(flags: Column) -> Column:
    """An array of booleans as longs of 64 bits, the first flag lowest."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    words = F.sequence(F.lit(0), F.floor((F.size(flags) - 1) / 64).cast("int"))
    bits = lambda w: F.transform(F.slice(flags, w * 64 + 1, 64), lambda f, i: F.when(f, F.call_function("shiftleft", one, i)).otherwise(zero))
    return F.when(F.size(flags) > 0, F.transform(words, lambda w: F.aggregate(bits(w), zero, lambda s, x: s.bitwiseOR(x)))).otherwise(F.array().cast("array<long>"))


def _words(pictures: pa.ListArray) -> np.ndarray:
    """Lists of longs as rows of words, as wide as the widest."""
    size = np.diff(np.asarray(pictures.offsets))
    out = np.zeros((len(size), max(1, int(size.max(initial=0)))), np.uint64)
    out[np.arange(out.shape[1]) < size[:, None]] = np.asarray(pictures.flatten()).view(np.uint64)
    return out


def _packs(df: DataFrame, kind: str, by: str) -> DataFrame:
    """df(by, named, bits) -> by, named array, wide, bits binary: packs of rows with the same `by`, in their order."""

    def each(batches):
        for batch in batches:
            part = np.asarray(batch.column(0))
            edges = np.flatnonzero(np.diff(part)) + 1
            for begin, end in zip(np.r_[0, edges], np.r_[edges, len(part)], strict=True):
                for at in range(int(begin), int(end), PACK):
                    b = batch.slice(at, min(PACK, int(end) - at))
                    words = _words(b.column(2))
                    named = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(1))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(0, 1), named, pa.array([words.shape[1]], pa.int32()), pa.array([words.tobytes()], pa.binary())], names=["part", "named", "wide", "bits"])

    return df.select(by, "named", "bits").mapInArrow(each, f"part int, named array<{kind}>, wide int, bits binary")


def nearest(a: np.ndarray, b: np.ndarray, least: float):
    """(row of a, row of b, shared, united) of each row's largest overlap with a row of b, from `least` up; of equal ones the
    first row of b with each count of pixels. Rows of words; none is without ink."""
    wide = min(a.shape[1], b.shape[1])
    ones, n = (np.bitwise_count(x).sum(1, dtype=np.int64) for x in (a, b))
    rows, order = np.argsort(ones, kind="stable"), np.argsort(n, kind="stable")
    b, n = b[order, :wide].T.copy(), n[order]
    step = max(1, AT_ONCE // len(n))
    for at in range(0, len(rows), step):
        some = rows[at : at + step]
        # a hair wider, so that rounding doesn't part a pair at the very ratio
        lo, hi = np.searchsorted(n, ones[some[0]] * least * (1 - 1e-9)), np.searchsorted(n, ones[some[-1]] / least * (1 + 1e-9), side="right")
        if lo == hi:
            continue
        shared = np.bitwise_count(a[some, 0][:, None] & b[0, lo:hi])
        for k in range(1, wide):
            shared = shared.astype(np.int32, copy=False) + np.bitwise_count(a[some, k][:, None] & b[k, lo:hi])
        heads = np.flatnonzero(np.diff(n[lo:hi], prepend=-1))
        most = np.maximum.reduceat(shared, heads, axis=1).astype(np.int64)
        united = ones[some][:, None] + n[lo + heads] - most
        iou = most / united
        top = iou.max(1)
        ends = np.r_[heads[1:], hi - lo]
        for i, g in zip(*np.nonzero((iou == top[:, None]) & (top >= least)[:, None]), strict=True):
            yield some[i], order[lo + heads[g] + np.argmax(shared[i, heads[g] : ends[g]])], most[i, g], united[i, g]


def twins(items: DataFrame, tests: DataFrame, least: float = TWIN) -> DataFrame:
    """items(id, bits), tests(id, place, bits) -> id, twin, shared, united, iou: each item's test picture with the largest
    overlap, from `least` up; of equal ones the first by place."""
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inky = F.exists("bits", lambda x: x != 0)
    kind, name, place = (df.schema[c].dataType.simpleString() for df, c in ((items, "id"), (tests, "id"), (tests, "place")))
    t = f"struct<place:{place},id:{name}>"
    # spread by a number of parts that is kept: a few bytes a row would be one task's
    rows = items.where(inky).select(F.pmod(F.xxhash64("bits"), F.lit(PARTS * tasks)).cast("int").alias("part"), F.col("id").alias("named"), "bits")
    left = _packs(rows.repartition(tasks, "part").sortWithinPartitions("part", "bits"), kind, "part").repartition(tasks, "part")
    first = tests.where(inky).groupBy("bits").agg(F.min(F.struct("place", "id")).alias("named"))
    right = _packs(first.select(F.lit(0).alias("none"), "named", "bits").sortWithinPartitions("named"), t, "none")
    right = right.select(F.explode(F.sequence(F.lit(0), F.lit(PARTS * tasks - 1))).alias("part"), F.col("named").alias("t"), F.col("wide").alias("w"), F.col("bits").alias("b")).repartition(tasks, "part")

    def each(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                named, wide, bits, t, w, b = (batch.column(j)[k] for j in range(6))
                pictures, copy = np.unique(np.frombuffer(bits.as_py(), np.uint64).reshape(-1, wide.as_py()), axis=0, return_inverse=True)
                found = list(nearest(pictures, np.frombuffer(b.as_py(), np.uint64).reshape(-1, w.as_py()), least))
                if not found:
                    continue
                which, other, shared, united = (np.array(c, np.int64) for c in zip(*found, strict=True))
                by = np.argsort(which, kind="stable")
                # rows of copies take what their picture found
                begin, end = (np.searchsorted(which[by], copy.reshape(-1), side=s) for s in ("left", "right"))
                row = np.repeat(np.arange(len(begin)), end - begin)
                at = by[np.arange(len(row)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin) + np.repeat(begin, end - begin)]
                yield pa.RecordBatch.from_arrays([named.values.take(pa.array(row)), t.values.take(pa.array(other[at])), pa.array(shared[at].astype(np.int32)), pa.array(united[at].astype(np.int32))], names=["id", "t", "shared", "united"])

    met = left.join(right.hint("merge"), "part").select("named", "wide", "bits", "t", "w", "b")
    pairs = met.mapInArrow(each, f"id {kind}, t {t}, shared int, united int")
    # the largest overlap, then the first place
    best = F.min_by(F.struct("t", "shared", "united"), F.struct((-F.col("shared") / F.col("united")).alias("iou"), "t")).alias("best")
    found = pairs.groupBy("id").agg(best)
    return found.select("id", F.col("best.t.id").alias("twin"), F.col("best.shared").alias("shared"), F.col("best.united").alias("united"), (F.col("best.shared") / F.col("best.united")).alias("iou"))
