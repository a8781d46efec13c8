"""Roll-ups, quantiles, sweeps, fits and drift."""

from __future__ import annotations

import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

QUANTILES = (0.015, 0.10, 0.25, 0.50, 0.75, 0.90, 0.985)
EDGES = (0, 50, 60, 70, 80, 85, 90, 95, 101)
GRID = (0.0, 0.50, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95)


def marks(pairs: DataFrame, read: str = "read", truth: str = "text") -> DataFrame:
    """A line's mark: edits, chars, exact."""
    a, b = T.tight(F.col(read)), T.tight(F.col(truth))
    return pairs.withColumns({"edits": F.levenshtein(a, b), "chars": F.length(b), "exact": ((a == b) & (b != "")).cast("int")})


def rolled() -> list[Column]:
    """Aggregates of marks: CER is of all characters together, exact a mean over lines."""
    return [F.count("*").alias("lines"), F.sum("chars").alias("chars"), F.round(100.0 * F.sum("edits") / F.greatest(F.sum("chars"), F.lit(1)), 6).alias("cer"), F.round(100.0 * F.avg("exact"), 6).alias("exact")]


def roll_by(marked: DataFrame, sets: Sequence[Sequence[str]], aggregates: Sequence[Column] | None = None) -> DataFrame:
    """One pass over several groupings and, for the empty one, the pooled total."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    return marked.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names]).agg(*(aggregates or rolled()))


#: Entries of the sketch that brackets a wanted rank; the exact value is then looked for between two of them.
SKETCH = 1000


def at_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: Sequence[tuple[float, Column]]) -> DataFrame:
    """For each key and (label q, rank from 0 as an expression of n) the value of that rank: keys, q, n, value.

    A quantile sketch brackets each rank; rows below the bracket are counted and only those inside it are grouped by value
    and summed up in order, so no window holds more than a few thousandths of a group. A value that fills a bracket (a
    common one) is one row.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"), F.percentile_approx("__v", [k / SKETCH for k in range(1, SKETCH)], 10 * SKETCH).alias("__s"))
    asked = n.withColumn("a", F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.least(F.col("n") - 1, r).cast("long").alias("rank")) for q, r in ranks])))
    # two entries to either side of the rank
    at = F.floor(F.col("a.rank") / F.col("n") * SKETCH).cast("int")
    lo = F.when(at - 2 < 1, F.col("__min")).otherwise(F.element_at("__s", F.greatest(at - 2, F.lit(1))))
    hi = F.when(at + 3 >= SKETCH, F.col("__max")).otherwise(F.element_at("__s", F.least(at + 3, F.lit(SKETCH - 1))))
    asked = asked.select(*[F.col(k).alias(f"__k{j}") for j, k in enumerate(keys)], F.col("a.q").alias("q"), "n", F.col("a.rank").alias("rank"), lo.alias("lo"), hi.alias("hi"))
    same = F.lit(True)
    for j, k in enumerate(keys):
        same = same & rows[k].eqNullSafe(F.col(f"__k{j}"))
    # one row a group, with a bracket for each rank
    bands = asked.groupBy(*[f"__k{j}" for j in range(len(keys))], "n").agg(F.array_sort(F.collect_list(F.struct("q", "rank", "lo", "hi"))).alias("__a"))
    both = rows.join(bands, same) if keys else rows.join(F.broadcast(bands))
    band = F.col("__a")
    under = [F.struct(band[j]["q"].alias("q"), band[j]["rank"].alias("rank"), F.sum((F.col("__v") < band[j]["lo"]).cast("long")).alias("c")) for j in range(len(ranks))]
    # counted inside the row: no row is multiplied by the ranks
    first = both.groupBy(*keys, "n", "__a").agg(F.array(*under).alias("__u")).select(*keys, "n", F.inline("__u")).withColumn("value", F.lit(None).cast(rows.schema["__v"].dataType))
    held = both.select(*keys, "n", F.col("__v").alias("value"), F.explode(F.filter(band, lambda x: (x["lo"] <= F.col("__v")) & (F.col("__v") <= x["hi"]))).alias("b"))
    inside = held.groupBy(*keys, "n", F.col("b.q").alias("q"), F.col("b.rank").alias("rank"), "value").agg(F.count("*").alias("c"))
    counted = first.unionByName(inside)
    upto = F.sum("c").over(Window.partitionBy(*keys, "q").orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("upto", upto).where(F.col("value").isNotNull() & (F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank"))).select(*keys, "q", "n", "value")


def ranked_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float] = QUANTILES) -> DataFrame:
    """For each key the value of rank min(n - 1, int(n q)) from 0, long form."""
    return at_ranks(df, keys, value, [(q, F.floor(F.col("n") * q)) for q in qs])


def histogram(df: DataFrame, keys: Sequence[str], value: str, edges: Sequence[float] = EDGES) -> DataFrame:
    """Counts in half-open bins; empty bins are kept."""
    spark = df.sparkSession
    bins = spark.createDataFrame([(float(a), float(b)) for a, b in zip(edges, edges[1:], strict=False)], "lo double, hi double")
    lo = F.array_max(F.filter(F.array(*[F.lit(float(e)) for e in edges[:-1]]), lambda e: e <= F.col(value)))
    counted = df.where((F.col(value) >= edges[0]) & (F.col(value) < edges[-1])).groupBy(*keys, lo.alias("lo")).agg(F.count("*").alias("n"))
    # groups x bins rows; the bins are a fixed list
    every = df.select(*keys).distinct().join(F.broadcast(bins)) if keys else bins
    return every.join(counted, [*keys, "lo"], "left").select(*keys, "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def sweep(rows: DataFrame, keys: Sequence[str], grid: Sequence[float] = GRID, good: float = 0.95) -> DataFrame:
    """rows(keys, trust, close) under each threshold: what is held back of good and bad reads, what leaks."""
    edges = F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("edge")
    gone = F.col("trust").isNotNull() & (F.col("trust") >= 0) & (F.col("trust") < F.col("edge"))
    fine = F.col("close") >= good
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return rows.select(*keys, "trust", "close", edges).groupBy(*keys, "edge").agg(n(gone & fine).alias("miss"), n(gone & ~fine).alias("block"), n(~gone & ~fine).alias("leak"), F.round(F.avg(F.when(gone, 0.0).otherwise(F.col("close"))), 6).alias("accuracy"))


def safe_edge(swept: DataFrame, keys: Sequence[str]) -> DataFrame:
    return swept.where("miss = 0").groupBy(*keys).agg(F.max("edge").alias("edge"))


def loglog(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """y = a x^p by least squares on logs, and the spread of residuals at ranks n // 10 and 9 n // 10; fewer than 3: zeros."""
    rows = df.where((F.col(x) > 0) & (F.col(y) > 0)).withColumns({"__x": F.ln(x), "__y": F.ln(y)})
    fit = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("__y", "__x").alias("p"), F.regr_intercept("__y", "__x").alias("i"))
    off = rows.join(fit, list(keys)).withColumn("off", F.col("__y") - F.col("i") - F.col("p") * F.col("__x"))
    found = at_ranks(off.select(*keys, "off"), keys, "off", [(0.1, F.floor(F.col("n") / 10)), (0.9, F.floor(9 * F.col("n") / 10))])
    ends = found.groupBy(*keys).agg(*[F.max(F.when(F.col("q") == q, F.exp("value"))).alias(name) for q, name in ((0.1, "low"), (0.9, "high"))])
    few = F.col("n") < 3
    zero = lambda c, k: F.when(few, 0.0).otherwise(F.round(c, k))
    return fit.join(ends, list(keys)).select(*keys, "n", zero(F.exp("i"), 3).alias("a"), zero(F.col("p"), 3).alias("p"), zero(F.col("low"), 2).alias("low"), zero(F.col("high"), 2).alias("high"))


def drift(quantiles: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean absolute difference of quantiles (keys, q, value) from wanted (q, value), over the wanted span."""
    w = wanted.agg(F.max_by("value", "q").alias("last"), F.min_by("value", "q").alias("first"), F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("mid"))
    span = F.greatest(F.col("last") - F.col("first"), F.abs("mid") * 0.2, F.lit(1e-6))
    # wanted and its span are one row for each of a fixed list of q
    rows = quantiles.join(F.broadcast(wanted.select("q", F.col("value").alias("want"))), "q").join(F.broadcast(w))
    return rows.groupBy(*keys).agg(F.round(F.sum(F.abs(F.col("value") - F.col("want"))) / F.count("*") / F.max(span), 6).alias("gap"))


def medoid(reads: DataFrame, key: str, pos: str, text: str, score) -> DataFrame:
    """The read most like the others of its group, and its mean score; the first wins ties; a lone read has trust 1.
    Equal texts of a group are scored once and counted, so a group's pairs are those of its different texts (an ensemble's
    members are few)."""
    rows = reads.where(F.col(text) != "").groupBy(F.col(key).alias("key"), F.col(text).alias("text")).agg(F.min(pos).alias("pos"), F.count("*").alias("times"))
    pairs = rows.alias("a").join(rows.alias("b"), F.col("a.key") == F.col("b.key"), "left")
    # a text meets its own other copies, not itself
    weight = F.col("b.times") - (F.col("a.pos") == F.col("b.pos")).cast("int")
    one = F.when(weight > 0, score(F.col("a.text"), F.col("b.text")) * weight)
    mean = pairs.groupBy("a.key", "a.pos", "a.text").agg((F.sum(one) / F.nullif(F.sum(weight), F.lit(0))).alias("trust"))
    best = Window.partitionBy("key").orderBy(F.round(F.coalesce("trust", F.lit(1.0)), 12).desc(), "pos")
    return mean.withColumn("r", F.row_number().over(best)).where("r = 1").select("key", "text", F.coalesce("trust", F.lit(1.0)).alias("trust"))


def bootstrap(df: DataFrame, keys: Sequence[str], value: str, draws: int = 400, seed: int = 7) -> DataFrame:
    """Half-width of the middle 95 % of resampled means, with the generator's exact draws; a group's values must fit a task."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        values, rng = pdf[value].sort_values().tolist(), random.Random(seed)
        n = len(values)
        means = sorted(sum(rng.choices(values, k=n)) / n for _ in range(draws))
        band = 0.0 if n < 2 else (means[int(0.975 * (draws - 1))] - means[int(0.025 * (draws - 1))]) / 2
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "n": [n], "band": [band]})

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.groupBy(*keys).applyInPandas(each, f"{kinds}, n long, band double")


#: A prime modulus of integer hashes that any SQL engine can repeat.
PRIME = 2147483647


def mixed(row: Column, *more) -> Column:
    """A hash of integer columns into [0, PRIME) by integer arithmetic alone; `row` may have any size."""
    x = F.pmod(row.cast("long"), F.lit(PRIME)) + 1
    for m in more:
        m = m if isinstance(m, Column) else F.lit(m)
        x = (x * 48271 + m * 69621 + F.shiftright(x, 12)) % PRIME
    for _ in range(3):
        x = (x * 16807 + F.shiftright(x, 16)) % PRIME
    return x


def hashes(row: Column, n: int) -> Column:
    """mixed(row, 0), ..., mixed(row, n - 1) as one array. Steps are lambdas, so an expression isn't written out again for
    each use of its value."""
    start = F.pmod(row.cast("long"), F.lit(PRIME)) + 1
    out = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda k: (start * 48271 + k * 69621 + F.shiftright(start, 12)) % PRIME)
    for _ in range(3):
        out = F.transform(out, lambda x: (x * 16807 + F.shiftright(x, 16)) % PRIME)
    return out


def poisson_edges(most: int = 7) -> list[int]:
    """Hash values above which a Poisson(1) count is more than 0, 1, ..."""
    edges, mass, total = [], 0.36787944117144233, 0.0
    for k in range(1, most + 1):
        total += mass
        edges.append(int(total * PRIME))
        mass /= k
    return edges


def poisson_band(df: DataFrame, keys: Sequence[str], value: str, row: str, draws: int = 40) -> DataFrame:
    """Half-width of the middle 95 % of bootstrapped means for groups of any size: each row counts Poisson(1) times in each
    of `draws` replicas, by a hash of row and replica. Replicas are sums side by side in one row a key, added up map-side."""
    times = F.transform(hashes(F.col("__r"), draws), lambda h: sum([(h > e).cast("long") for e in poisson_edges()], F.lit(0).cast("long")))
    # exploded from one value, so that a row's counts are made once
    rows = df.select(*keys, F.col(value).alias("__v"), F.col(row).alias("__r")).select(*keys, "__v", F.explode(F.array(times)).alias("__t"))
    t = F.col("__t")
    means = F.array(*[F.sum(F.col("__v") * t[k]) / F.greatest(F.sum(t[k]), F.lit(1)) for k in range(draws)])
    at = lambda q: F.element_at("__m", int(q * (draws - 1)) + 1)
    return rows.groupBy(*keys).agg(F.array_sort(means).alias("__m")).select(*keys, ((at(0.975) - at(0.025)) / 2).alias("band"))


def summary(scores: DataFrame, keys: Sequence[str], name: str, score: str, show: int = 5) -> DataFrame:
    """One row a key: n, lowest, tenth (the value at rank n // 10), middle, mean, and the `show` lowest names with their scores,
    ties by name. Null scores are left out; a key without a score has no row."""
    rows = scores.where(F.col(score).isNotNull())
    told = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(score).alias("lowest"), F.percentile(score, 0.5).alias("middle"), F.avg(score).alias("mean"))
    tenth = ranked_quantiles(rows, list(keys), score, [0.1]).select(*keys, F.col("value").alias("tenth"))
    order = Window.partitionBy(*keys).orderBy(score, name)
    low = rows.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= show)
    named = low.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", F.col(name).alias("name"), F.col(score).alias("score")))), lambda x: F.struct(x["name"].alias("name"), x["score"].alias("score"))).alias("worst"))
    return told.join(tenth, list(keys)).join(named, list(keys))
