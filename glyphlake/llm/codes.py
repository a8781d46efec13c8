"""Vector codes: vectors cut into equal parts, each part replaced by the index of the nearest entry of its codebook.

All arithmetic is on integers: a component x becomes floor(256 x). Codebooks start as the parts of the first vectors and are
moved to the floor of their parts' means, round by round; a task sends sums and counts of its parts for each entry, so what is
added up is as large as the codebooks, not the vectors. Codebooks (parts x entries x width integers) travel with the tasks.

The nearest entry comes from a partial-distance search: a part's dimensions are taken in descending variance of its codebook;
distances of a block of rows to a run of entries grow dimension by dimension, and a mask drops each entry of each row once its
sum so far strictly exceeds the row's best complete distance. Entries that equal the best stay, so ties go to the lower index.

Nulls, empties, ties: vectors that are null or hold a null or non-finite component are left out; shorter vectors count as
followed by zeros, up to the least multiple of the number of parts that holds the longest; a null vec_id comes after the
others, equal vec_ids go by their vectors; with fewer vectors than entries the codebooks are that small. Repeated rows each
keep a row. Null labels are one label. Extra columns aren't read. An empty table gives an empty result. Components beyond
2^19 in size raise a ValueError: sums of squares would leave 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows searched at once, entries tried before the best is brought up to date, largest component.
BLOCK, RUN, LARGEST = 2048, 16, 1 << 27
#: A label's rows meet its sum in this many tasks.
SALTS = 16


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, label, embedding) -> vec_id, label, q: kept vectors as integers."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    q = F.transform(x, lambda v: F.floor(v * SCALE))
    far = F.exists(x, lambda v: F.abs(v) >= LARGEST / SCALE)
    checked = F.when(far, F.raise_error(F.lit(f"a component of {LARGEST // SCALE} or more"))).otherwise(q)
    return vectors.where(F.col("embedding").isNotNull() & sound).select("vec_id", "label", checked.alias("q"))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of book (entries, width) for each row of x (rows, width), and its squared distance."""
    order = np.argsort(-book.astype(float).var(axis=0), kind="stable")
    x, book = x[:, order], book[:, order]
    n, width = x.shape
    at = np.zeros(n, np.int64)
    if not width:
        return at, at.copy()
    # a first complete distance: to the entry that is nearest in the leading dimension
    start = np.abs(x[:, :1] - book[None, :, 0]).argmin(axis=1)
    best = ((x - book[start]) ** 2).sum(axis=1)
    at[:] = len(book)
    for low in range(0, len(book), RUN):
        part = (x[:, :1] - book[None, low : low + RUN, 0]) ** 2
        row, entry = np.nonzero(part <= best[:, None])
        sums = part[row, entry]
        entry = entry + low
        for k in range(1, width):
            sums = sums + (x[row, k] - book[entry, k]) ** 2
            alive = sums <= best[row]
            row, entry, sums = row[alive], entry[alive], sums[alive]
        if not len(row):
            continue
        first = np.lexsort((entry, sums, row))
        row, entry, sums = row[first], entry[first], sums[first]
        lead = np.flatnonzero(np.diff(row, prepend=-1))
        row, entry, sums = row[lead], entry[lead], sums[lead]
        better = (sums < best[row]) | (at[row] == len(book))
        best[row[better]], at[row[better]] = sums[better], entry[better]
    return at, best


def parts_of(column: pa.Array, width: int) -> np.ndarray:
    """(rows, PARTS, width) integers of a list column, shorter ones followed by zeros."""
    at = np.asarray(column.offsets).astype(np.int64)
    out = np.zeros((len(column), PARTS * width), np.int64)
    values = np.asarray(column.values)
    size = np.diff(at)
    if len(size) and (size == PARTS * width).all():
        out[:] = values[at[0] : at[-1]].reshape(out.shape)
    else:
        for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            out[i, : b - a] = values[a:b]
    return out.reshape(len(column), PARTS, width)


def _cut(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def moved(numbers: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (parts, entries, width) after one round: each entry at the floor of the mean of its parts."""
    count, entries, width = books.shape

    def each(batches):
        n, sums = np.zeros((count, entries), np.int64), np.zeros((count, entries, width), np.int64)
        for b in _cut(batches):
            x = parts_of(b.column(0), width)
            for p in range(count):
                at, _ = nearest(x[:, p], books[p])
                n[p] += np.bincount(at, minlength=entries)
                np.add.at(sums[p], at, x[:, p])
        p, e = np.nonzero(n)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))], names=["p", "e", "n", "sums"])

    told = numbers.select("q").mapInArrow(each, "p int, e int, n long, sums array<long>")
    told = told.groupBy("p", "e").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)])
    out = books.copy()
    # parts x entries rows at most
    for r in told.collect():
        out[r["p"], r["e"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
    return out


def trained(numbers: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks (parts, entries, width) of whole_numbers(); none for an empty table."""
    size = numbers.agg(F.max(F.size("q")).alias("m")).first()["m"]
    width = -(-(size or 0) // PARTS)
    # a bounded number of rows
    first = numbers.select("vec_id", "q").orderBy(F.asc_nulls_last("vec_id"), "q").limit(entries).collect()
    books = np.zeros((PARTS, len(first), width), np.int64)
    for i, r in enumerate(first):
        row = np.zeros(PARTS * width, np.int64)
        row[: len(r["q"])] = r["q"]
        books[:, i] = row.reshape(PARTS, width)
    for _ in range(rounds if first else 0):
        books = moved(numbers, books)
    return books


def encoded(numbers: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distances summed over parts)."""
    count, _, width = books.shape
    kinds = ", ".join(f"{c} {numbers.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))

    def each(batches):
        for b in _cut(batches):
            x = parts_of(b.column(2), width)
            code, error = np.zeros((len(x), count), np.uint8), np.zeros(len(x), np.int64)
            for p in range(count):
                at, far = nearest(x[:, p], books[p])
                code[:, p] = at
                error += far
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return numbers.select("vec_id", "label", "q").mapInArrow(each, f"{kinds}, code string, error long")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, label, embedding) -> vec_id, code, error, label_error, codebooks_sha256."""
    numbers = written(whole_numbers(vectors), "numbers")
    books = trained(numbers)
    rows = written(encoded(numbers, books), "codes")
    # a label may hold most rows: its sum is sent to SALTS tasks
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")
    both = rows.withColumn("salt", salt).join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("turn")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in 16 parts of 64 entries, two rounds."""
    return compressed(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))


def _assigned(name: str, books: str) -> str:
    """SQL of the nearest entry of each part."""
    return f"{name} AS (SELECT vec_id, p, v, e, d FROM (SELECT x.vec_id, x.p, x.v, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d, row_number() OVER (PARTITION BY x.vec_id, x.p ORDER BY d, b.e) AS k FROM x JOIN {books} b ON x.p = b.p) WHERE k = 1)"


def _moved(name: str, assigned: str, books: str) -> str:
    mean = f"(SELECT p, e, list(m ORDER BY i) AS v FROM (SELECT p, e, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS m FROM {assigned} CROSS JOIN (SELECT unnest(range(1, (SELECT any_value(len(v)) + 1 FROM x))) AS i) GROUP BY p, e, i) GROUP BY p, e)"
    return f"{name} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM {books} b LEFT JOIN {mean} m USING (p, e))"


ORACLE_OP12 = f"""WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT vec_id, p, q[p * len(q) // {PARTS} + 1:(p + 1) * len(q) // {PARTS}] AS v FROM n CROSS JOIN (SELECT unnest(range({PARTS})) AS p)),
b0 AS (SELECT p, e, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM n ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id)),
{_assigned('a0', 'b0')}, {_moved('b1', 'a0', 'b0')}, {_assigned('a1', 'b1')}, {_moved('b2', 'a1', 'b1')}, {_assigned('a2', 'b2')},
s AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2),
c AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN n USING (vec_id) CROSS JOIN s"""
