"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

1. Statistics of whole texts, computed inside Arrow batches (features_of).
2. Means and deviations over all labelled rows used for fitting, by Spark aggregates.
3. Random Fourier features sqrt(2/D) cos(Wx + b), W ~ Normal(0, 1/width), approximate a Gaussian kernel. Each partition
   sums its X'X and X'y; the sums (D x D numbers, a size fixed by parameters) are added up and solved on the driver.
4. Raw scores of the fitting rows are counted in BINS equal-width bins by a Spark aggregate, and pool-adjacent-violators
   on the bins gives a monotone calibration, interpolated between blocks and kept in [0, 1].

Every labelled row outside the held-out part is used; the pipeline's stage uses those of about STAGE_LABELS ids.
Nulls, empties, ties: a null text counts as an empty one, and an empty text is scored like any other; a null doc_id has checksum 0; rows labelled null, or not 0 or 1, aren't fitted;
repeated rows count as often as they occur; an id with two labels is fitted with each. With no labelled row every score is
0.5. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, crc_of_id, split_words, table, written

D = 192
WIDTH = 4.0
RIDGE = 1e-3
SEED = 8
BINS = 512

#: Fixed value: classes of bytes. Counts of each in a text make shares.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "line": b"\n",
    "space": b" \t\r\x0b\x0c",
    "stop": b".?;:",
    "comma": b",",
    "bang": b"!",
    "pipe": b"|",
    "symbol": b"#$%&*+/<=>@[\\]^_`{}~",
    "quote": b"'\"()-",
    "wide": bytes(range(128, 256)),
}
NAMES = ["log_bytes", *CLASSES, "log_words", "word_bytes", "word_spread", "distinct", "top_word", "twice", "capital", "symbol_end", "line_words", "distinct_lines", "stop_words"]
_CLASS = np.full(256, len(CLASSES), np.uint8)
for _k, _bytes in enumerate(CLASSES.values()):
    _CLASS[list(_bytes)] = _k


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]]."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[first[1:]] - total[first[:-1]]


def _distinct(codes: np.ndarray, first: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each range of codes: how many distinct ones, and how often the commonest occurs."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    pairs, counts = np.unique(row * np.int64(max(kinds, 1)) + codes, return_counts=True)
    owner = pairs // max(kinds, 1)
    top = np.zeros(n)
    np.maximum.at(top, owner, counts)
    return np.bincount(owner, minlength=n).astype(float), top


def features_of(texts: pa.Array) -> np.ndarray:
    """(texts, len(NAMES)) statistics; all finite, zero for what an empty text lacks."""
    texts = pc.fill_null(texts, "")
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    n = len(texts)
    size = np.asarray(pc.binary_length(texts)).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(size)))
    joined = pc.binary_join_element_wise(texts.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()), pa.scalar(b"", pa.large_binary())).buffers()[2]
    raw = np.frombuffer(joined, np.uint8)[: first[-1]] if joined is not None else np.zeros(0, np.uint8)
    kind = _CLASS[raw]
    per = np.maximum(size, 1)
    shares = [_sums(kind == k, first) / per for k in range(len(CLASSES))]
    flat, at = split_words(texts)
    length = np.asarray(pc.binary_length(flat)).astype(float)
    words = np.diff(at).astype(float)
    some = np.maximum(words, 1)
    coded = flat.dictionary_encode()
    codes = np.asarray(coded.indices).astype(np.int64)
    distinct, top = _distinct(codes, at, len(coded.dictionary))
    same = np.concatenate(([False], codes[1:] == codes[:-1])) if len(codes) else np.zeros(0, bool)
    if len(codes):
        same[at[:-1][at[:-1] < len(codes)]] = False
    mean = _sums(length, at) / some
    spread = np.sqrt(np.maximum(_sums(length**2, at) / some - mean**2, 0))
    ends = np.asarray(pc.match_substring_regex(coded.dictionary, r"[!-+/<-@\[-`{-~]$")) if len(coded.dictionary) else np.zeros(0, bool)
    full = np.asarray(pc.match_substring_regex(coded.dictionary, r"[.]$")) if len(coded.dictionary) else np.zeros(0, bool)
    lines = pc.split_pattern(texts, "\n")
    line_at = np.asarray(lines.offsets).astype(np.int64)
    line_at = line_at - line_at[0]
    n_lines = np.maximum(np.diff(line_at), 1)
    line_codes = lines.flatten().dictionary_encode()
    line_kinds, _ = _distinct(np.asarray(line_codes.indices).astype(np.int64), line_at, len(line_codes.dictionary))
    capital = np.concatenate(([True], kind[:-1] >= 3)) & (kind == 0) if len(kind) else np.zeros(0, bool)
    columns = [np.log1p(size), *shares, np.log1p(words), mean, spread, distinct / some, top / some, _sums(same, at) / some, _sums(capital, first) / some, _sums(ends[codes], at) / some, np.log1p(words / n_lines), line_kinds / n_lines, _sums(full[codes], at) / some]
    return np.stack(columns, axis=1) if n else np.zeros((0, len(NAMES)))


def statistics(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, f (array of statistics)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches):
        for b in blocks(batches, "text"):
            x = features_of(b.column(1))
            f = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), f], names=["doc_id", "f"])

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, f array<double>")


def _matrix(column) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, len(NAMES)))


class Model:
    """Scores of statistics: raw(x) by ridge over random Fourier features, score(x) calibrated."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, d: int = D, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.w, self.b = rng.standard_normal((len(mean), d)) / width, rng.uniform(0, 2 * np.pi, d)
        self.beta = np.zeros(d + 1)
        self.knots = (np.array([0.0, 1.0]), np.array([0.5, 0.5]))

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -6, 6)
        return np.concatenate((np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))), axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.map(x) @ self.beta, -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.knots), 0.0, 1.0)


def isotonic(at: np.ndarray, good: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (mean raw score, calibrated share) of points with `good` of `count` at each raw score."""
    blocks_: list[list[float]] = []
    for x, g, c in zip(at.tolist(), good.tolist(), count.tolist(), strict=True):
        blocks_.append([x * c, g, c])
        while len(blocks_) > 1 and blocks_[-2][1] * blocks_[-1][2] >= blocks_[-1][1] * blocks_[-2][2]:
            last = blocks_.pop()
            blocks_[-1] = [a + b for a, b in zip(blocks_[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks_]), np.array([b[1] / b[2] for b in blocks_])


def fit(labelled: DataFrame, d: int = D, width: float = WIDTH, ridge: float = RIDGE, seed: int = SEED, bins: int = BINS) -> Model:
    """labelled(f, y) -> Model. Everything that reaches the driver has a size fixed by the parameters."""

    def moments(batches):
        n, s, q = 0, np.zeros(len(NAMES)), np.zeros(len(NAMES))
        for b in batches:
            x = _matrix(b.column(0))
            n, s, q = n + len(x), s + x.sum(axis=0), q + (x**2).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([q.tolist()])], names=["n", "s", "q"])

    parts = labelled.select("f", "y").mapInArrow(moments, "n long, s array<double>, q array<double>").select("n", F.posexplode("s").alias("k", "s"), "q")
    sums = parts.groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.element_at("q", F.col("k") + 1)).alias("q")).orderBy("k").collect()
    if not sums or not sums[0]["n"]:
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)), d, width, seed)
    n, s, q = sums[0]["n"], np.array([r["s"] for r in sums]), np.array([r["q"] for r in sums])
    model = Model(s / n, np.sqrt(np.maximum(q / n - (s / n) ** 2, 0)), d, width, seed)
    m = d + 1

    def normal(batches):
        xx, xy = np.zeros((m, m)), np.zeros(m)
        for b in batches:
            z, y = model.map(_matrix(b.column(0))), np.asarray(b.column(1), dtype=float)
            xx, xy = xx + z.T @ z, xy + z.T @ y
        rows = np.concatenate((xx, xy[:, None]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m)), pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, m + 1), pa.int32()), pa.array(rows.reshape(-1)))], names=["i", "row"])

    # d + 1 rows a partition meet by row number
    added = labelled.select("f", "y").mapInArrow(normal, "i long, row array<double>").groupBy("i").agg(*[F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(m + 1)]).orderBy("i").collect()
    rows = np.array([list(r)[1:] for r in added])
    model.beta = np.linalg.solve(rows[:, :m] + ridge * n * np.eye(m) / m, rows[:, m])

    def raw(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(b.column(0)))), b.column(1)], names=["raw", "y"])

    counted = labelled.select("f", "y").mapInArrow(raw, "raw double, y double").groupBy(F.floor((F.col("raw") + 0.5) * (bins / 2)).alias("bin")).agg(F.avg("raw").alias("at"), F.sum("y").alias("good"), F.count("*").alias("n")).orderBy("bin").collect()
    model.knots = isotonic(*(np.array([r[k] for r in counted], dtype=float) for k in ("at", "good", "n")))
    return model


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """stats(doc_id, f, ...) -> doc_id, score, predicted."""
    held = stats.sparkSession.sparkContext.broadcast(model)
    kind = stats.schema["doc_id"].dataType.simpleString()

    def each(batches):
        for b in batches:
            score = held.value.score(_matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return stats.select("doc_id", "f").mapInArrow(each, f"doc_id {kind}, score double, predicted int")


def train(stats: DataFrame, labels: DataFrame) -> Model:
    """Fits on every labelled row whose crc32(doc_id) mod 3 isn't 1."""
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("__id"), F.col("quality").cast("double").alias("y"))
    rows = stats.join(known, F.col("doc_id") == F.col("__id")).where(crc_of_id(F.col("doc_id")) % 3 != 1).select("f", "y")
    return fit(written(rows, "labelled"))


def op8_quality_rff_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document."""
    stats = written(statistics(table(spark, sf_dir, "documents")), "statistics")
    model = train(stats, table(spark, sf_dir, "labels"))
    return scored(stats, model).select("doc_id", (crc_of_id(F.col("doc_id")) % 3 == 1).alias("held_out"), "score", "predicted")


#: Labelled ids that the pipeline's stage fits on, about: of more, so many are drawn by a hash of the id.
STAGE_LABELS = 1 << 17


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents -> documents predicted to be of quality 1. Fits on the labelled ones among docs, outside the held-out part:
    on about STAGE_LABELS ids if labels has more, so that ids are broadcast with a bound and texts aren't shuffled."""
    labels = table(spark, sf_dir, "labels").where("quality in (0, 1)").where(crc_of_id(F.col("doc_id")) % 3 != 1).select("doc_id", "quality")
    ids = labels.select("doc_id").distinct()
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(max(ids.count(), STAGE_LABELS))) < STAGE_LABELS
    wanted = docs.join(F.broadcast(ids.where(drawn)), "doc_id", "left_semi").select("doc_id", "text")
    held = spark.sparkContext.broadcast(train(statistics(wanted), labels.where(drawn)))
    place = docs.columns.index("text")

    def good(batches):
        for b in blocks(batches, "text"):
            yield b.filter(pa.array(held.value.score(features_of(b.column(place))) >= 0.5))

    return docs.mapInArrow(good, docs.schema)
