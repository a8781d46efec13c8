"""Nearest neighbours by cosine: one vantage-point tree for each shard of the vectors.

On unit vectors cosine order is distance order, and distance obeys the triangle inequality: a branch whose points lie at
distances [lo, hi] from its vantage point can't hold a point nearer than max(d - hi, lo - d) to a query at distance d. A
branch is skipped if that bound times `factor` is beyond the k-th best so far. Factor 1 gives exact search; a larger one
skips more and may miss neighbours.

Each shard's tree is built by one task from a bounded number of rows and stored in the shared folder; queries travel to
every shard in blocks. In a shard a query first finds its k-th best distance and then every row within rounding of it; those
rows get exact scores, and the shard's best k by score and vec_id come back. Scores are cosines in double precision of the
original vectors, summed in component order.

vec_id is an integer. Nulls, empties, ties: vectors that are null, empty, zero or hold a null or non-finite component take no part, as queries or
candidates; a vector only meets vectors of its own length; equal scores go to the smaller vec_id; a null vec_id takes no
part; rows that repeat a vec_id with the same vector count once, and none is its own neighbour. An empty table, or one
without queries, gives an empty result. Equal vectors are stored once with their ids, so a vector that a third of all rows
hold is compared once.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

K = 5
EVERY = 50
FACTOR = 1.0
#: Rows of a shard, and queries of a block.
SHARD_ROWS = 16384
BLOCK_ROWS = 1024
LEAF = 256
#: Squared distances of unit vectors that rounding can't tell apart.
ROUNDING = 1e-12


def usable(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, v (array of double), dim; one row for each distinct one."""
    v = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.size("embedding").alias("dim")).distinct()


class Tree:
    """Vantage-point tree over unit rows x. A node is (vantage row, near child, far child, near bounds, far bounds) or a
    leaf's row numbers."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, seed: int = 7):
        self.x, self.leaf = x, leaf
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(x)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        at = int(rows[self.rng.integers(len(rows))])
        d = distances(self.x[rows], self.x[at][None])[:, 0]
        middle = np.median(d)
        near = d <= middle
        if near.all():
            # at least half of the rows at one distance: halve by place instead; the bounds still hold
            near = np.arange(len(rows)) < len(rows) // 2
        bound = lambda side: (float(d[side].min()), float(d[side].max()))
        return at, self._build(rows[near]), self._build(rows[~near]), bound(near), bound(~near)

    def search(self, q: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray, int]:
        """For each unit row of q the k nearest rows: (distances, row numbers, -1 where fewer), and how many distances
        were computed."""
        best, rows = np.full((len(q), k), np.inf), np.full((len(q), k), -1)
        seen = 0

        def visit(node, active):
            nonlocal seen
            if not len(active):
                return
            if isinstance(node, np.ndarray):
                seen += len(active) * len(node)
                d = np.concatenate((best[active], distances(q[active], self.x[node])), axis=1)
                r = np.concatenate((rows[active], np.broadcast_to(node, (len(active), len(node)))), axis=1)
                top = np.argpartition(d, k - 1, axis=1)[:, :k]
                best[active], rows[active] = np.take_along_axis(d, top, 1), np.take_along_axis(r, top, 1)
                return
            at, near, far, in_near, in_far = node
            seen += len(active)
            d = distances(q[active], self.x[at][None])[:, 0]
            sides = [(near, in_near), (far, in_far)]
            if (d > in_near[1]).mean() > 0.5:
                sides.reverse()
            for child, (lo, hi) in sides:
                least = np.maximum(d - hi, lo - d) - 1e-7
                visit(child, active[least * factor <= best[active].max(axis=1)])

        visit(self.root, np.arange(len(q)))
        return best, rows, seen

    def within(self, q: np.ndarray, far: np.ndarray, factor: float = 1.0):
        """Yields (query numbers, row numbers) of all rows at squared distance `far` or less, a value for each query."""

        def visit(node, active):
            if not len(active):
                return
            if isinstance(node, np.ndarray):
                a, b = np.nonzero(distances(q[active], self.x[node]) ** 2 <= far[active][:, None])
                yield active[a], node[b]
                return
            at, near, far_child, in_near, in_far = node
            d = distances(q[active], self.x[at][None])[:, 0]
            for child, (lo, hi) in ((near, in_near), (far_child, in_far)):
                least = np.maximum(np.maximum(d - hi, lo - d) - 1e-6, 0) * factor
                yield from visit(child, active[least**2 <= far[active]])

        yield from visit(self.root, np.arange(len(q)))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def in_order(p: np.ndarray) -> np.ndarray:
    """Row sums, added in component order."""
    return np.cumsum(p, axis=1)[:, -1]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return in_order(a * b) / (np.sqrt(in_order(a * a)) * np.sqrt(in_order(b * b)))


def _gathered(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = np.asarray(t.column("vec_id").combine_chunks())
    flat = np.asarray(t.column("v").combine_chunks().flatten(), dtype=float)
    return ids, flat.reshape(len(ids), -1)


def index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """usable vectors -> (dim, shard, tree): a pickled (distinct vectors, ids of each, Tree). A shard has about shard_rows
    rows, whatever the table's size."""
    n = vectors.count()
    shards = max(1, -(-n // shard_rows))

    def build(key, t):
        ids, x = _gathered(t)
        distinct, place = np.unique(x, axis=0, return_inverse=True)
        order = np.lexsort((ids, place.reshape(-1)))
        cut = np.searchsorted(place.reshape(-1)[order], np.arange(len(distinct) + 1))
        blob = pickle.dumps((distinct, ids[order], cut, Tree(unit(distinct))))
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "tree": pa.array([blob], pa.binary())})

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, tree binary")


def search(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest usable vectors of each usable query, as (query_id, rank, vec_id, score)."""
    trees = written(index(vectors, shard_rows), "trees")
    blocks = max(1, -(-queries.count() // block_rows))

    def gather(key, t):
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "queries": pa.array([pickle.dumps(_gathered(t))], pa.binary())})

    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).groupBy("dim", "block").applyInArrow(gather, "dim int, queries binary")
    # each block of queries goes to every shard of its dimension; shard keys are few and small
    shards = trees.groupBy("dim").agg(F.collect_list("shard").alias("shards"))
    sent = asked.join(shards, "dim").withColumn("shard", F.explode("shards")).drop("shards")

    def answer(batches):
        for b in batches:
            for tree, queries in zip(b.column(0), b.column(1), strict=True):
                distinct, ids, cut, vp = pickle.loads(tree.as_py())
                q_ids, q = pickle.loads(queries.as_py())
                asked, out = unit(q), []
                best, _, _ = vp.search(asked, k + 1, factor)
                found = list(vp.within(asked, best.max(axis=1) ** 2 + ROUNDING, factor))
                who, row = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
                order = np.argsort(who, kind="stable")
                who, row = who[order], row[order]
                for w in range(len(q)):
                    a, b = np.searchsorted(who, [w, w + 1])
                    mine, own = row[a:b], q_ids[w]
                    score = cosine(q[w][None], distinct[mine]) if len(mine) else np.zeros(0)
                    # the first ids of each distinct vector
                    at = np.concatenate([np.arange(cut[r], min(cut[r] + k + 1, cut[r + 1])) for r in mine.tolist()]) if len(mine) else np.zeros(0, np.int64)
                    score = np.repeat(score, np.minimum(cut[mine + 1] - cut[mine], k + 1))
                    score, at = score[ids[at] != own], at[ids[at] != own]
                    top = np.lexsort((ids[at], -score))[:k]
                    out += [(own, i, s) for i, s in zip(ids[at[top]].tolist(), score[top].tolist(), strict=True)]
                columns = list(zip(*out, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

    near = sent.join(trees, ["dim", "shard"]).select("tree", "queries").mapInArrow(answer, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_vantage_point_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of all embeddings for those whose vec_id is divisible by 50."""
    vectors = written(usable(table(spark, sf_dir, "embeddings")), "vectors")
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


ORACLE_OP7 = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, v, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b)) AS size FROM e),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda a, b: a + b) / (q.size * c.size) AS score
  FROM n q JOIN n c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 5
"""
