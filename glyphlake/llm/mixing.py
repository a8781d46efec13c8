"""Mixing sources to target weights by Pareto order sampling [DataFrame functions only].

A source's target T is spread over its documents at rates min(most, level x weight): a document's weight grows with the
logarithm of its size, so longer documents are likelier, and the level makes the rates times sizes add up to T. floor(rate)
whole copies are certain; the rest p = rate - floor(rate) is an inclusion probability, unequal inside a source. A document's
rank is its random odds u / (1 - u) divided by its inclusion odds p / (1 - p). The smallest ranks are taken until their
words fill what remains of the target (a sample of fixed size, counted in words: it misses the target by at most half of the
document on the edge).

What is decided is a rate for each (source, weight) and a cut for each source, two small tables; only ids, sizes and sources
are aggregated and sorted to find them, and no text takes part in a shuffle unless Spark finds those tables too large to
broadcast.

Nulls, empties, ties: a null text has size 0 and is taken 0 words; a null source is a source of its own, last in order; a
null doc_id hashes as a value of its own, together with the size; repeated rows each count, but have one rank: those on the
edge are taken in about the share that is needed. An empty table gives an empty result. A source without words has target 0
and none of its documents is taken. Columns of the input are kept; the added names replace clashing ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, word_count, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Bands of rank in which a source's words are summed before the edge is looked for.
BANDS = 4096
#: Steps of a document's weight: powers of 2^(1/8).
STEPS = 8


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes(source, source_size) -> with target. Sources by code point (null last) weigh `weights`, repeating, and share
    `share` of all words; a target stops at `most` times its source's size and the excess is shared anew by weight.

    Raising a common level until every source is at level x weight or at its cap: sources in order of cap / weight, the
    first ones capped. It is a running sum over one row for each source. A corpus has few sources; their rows are small.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    levels = sizes.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    levels = levels.withColumn("__cap", F.col("source_size") * F.lit(most)).withColumn("__turn", F.col("__cap") / F.col("__w"))
    every = Window.partitionBy()
    before = Window.orderBy("__turn", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    # level at which this source would stop if those before it are at their caps and the rest share what is left
    left = F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    open_weight = F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    level = F.when(left / open_weight <= F.col("__turn"), left / open_weight)
    levels = levels.withColumn("__level", F.max(level).over(every))
    return levels.withColumn("target", F.when(F.col("__level").isNull(), F.col("__cap")).otherwise(F.least("__cap", F.col("__level") * F.col("__w")))).select("source", "source_size", "target")


def step_of(size: Column) -> Column:
    """A document's weight 2^(step / STEPS): the natural logarithm of e + size, in steps."""
    return F.round(F.log2(F.log(F.lit(2.718281828459045) + size)) * STEPS).cast("int")


def rates(sizes: DataFrame, most: float = MOST) -> DataFrame:
    """sizes(source, step, words, source_size, target) -> with rate = min(most, level x weight), so that a source's rates
    times words add up to its target: the heaviest steps reach `most` first. A source has a few dozen steps."""
    weight = F.pow(F.lit(2.0), F.col("step") / STEPS)
    down = Window.partitionBy("source").orderBy(F.desc("step"))
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    after = down.rowsBetween(0, Window.unboundedFollowing)
    rows = sizes.withColumn("weight", weight)
    level = (F.col("target") - most * F.coalesce(F.sum("words").over(before), F.lit(0))) / F.sum(F.col("words") * F.col("weight")).over(after)
    rows = rows.withColumn("level", F.when((F.col("words") > 0) & (level * F.col("weight") <= most), level))
    rate = F.least(F.lit(most), F.col("top") * F.col("weight"))
    rows = rows.withColumn("top", F.max("level").over(Window.partitionBy("source")))
    return rows.withColumn("rate", F.when(F.col("source_size") <= 0, 0.0).otherwise(F.coalesce(rate, F.lit(most)))).drop("weight", "level", "top")


def _ranked(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """rows(source, step, u, ...) with the planned rate, p and rank of each (source, step)."""
    p = F.col("rate") - F.floor("rate")
    rows = rows.join(planned.select(F.col("source").alias("of"), F.col("step").alias("at"), "rate"), F.col("source").eqNullSafe(F.col("of")) & (F.col("step") == F.col("at")), "left").drop("of", "at")
    return rows.withColumn("rank", F.when(p > 0, (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 20, bands: int = BANDS) -> DataFrame:
    """docs(doc_id, source, size, ...) -> with source_size, target, copies, taken."""
    docs = docs.drop("source_size", "target", "copies", "taken")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00null")), "size"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    keyed = docs.select("source", "size", step_of(F.col("size")).alias("step"), u.alias("u"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    slim = written(keyed.select("source", "size", "step", "u"), "sizes")
    sums = slim.groupBy("source", "step").agg(F.sum("size").cast("long").alias("words"))
    sizes = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    goals = targets(sizes, weights, share, most).withColumnRenamed("source", "of")
    planned = written(rates(sums.join(goals, F.col("source").eqNullSafe(F.col("of"))).drop("of"), most), "rates")
    want = planned.groupBy("source").agg((F.first("target") - F.sum(F.floor("rate") * F.col("words"))).alias("want"))
    ranked = _ranked(slim, planned).where("rank IS NOT NULL")
    band = F.floor(F.col("rank") / (1 + F.col("rank")) * bands).cast("int")
    # words in each band of a source: sources x bands rows, however many documents there are
    summed = ranked.groupBy("source", band.alias("band")).agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    summed = summed.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))).join(want.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    edge = written(summed.where("before < want AND before + words >= want").select(F.col("source").alias("of"), F.col("band").alias("edge_band"), "before", "want"), "edge")
    # the documents of the edge's band, by rank
    inside = ranked.join(edge, F.col("source").eqNullSafe(F.col("of")) & (band == F.col("edge_band"))).groupBy("source", "rank").agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.first("before").alias("before"), F.first("want").alias("want"))
    upto = Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(upto), F.lit(0)))
    part = F.when(F.col("n") == 1, (F.col("before") + F.col("words") / 2 <= F.col("want")).cast("double")).otherwise((F.col("want") - F.col("before")) / F.col("words"))
    last = inside.where("before < want AND before + words >= want").groupBy("source").agg(F.min(F.struct("rank", part.alias("part"))).alias("cut"))
    cuts = want.join(last.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left")
    # a source whose ranks don't reach its target takes them all
    none = F.when(F.col("want") > 0, F.struct(F.lit(float("inf")).alias("rank"), F.lit(1.0).alias("part"))).otherwise(F.struct(F.lit(-1.0).alias("rank"), F.lit(0.0).alias("part")))
    cuts = cuts.select(F.col("source").alias("of"), F.coalesce("cut", none).alias("cut"))
    plan = written(planned.join(cuts, F.col("source").eqNullSafe(F.col("of"))).drop("of", "words"), "plan")
    plan = plan.select(F.col("source").alias("of"), F.col("step").alias("at"), "source_size", "target", "rate", "cut")
    rows = keyed.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("step") == F.col("at")), "left")
    p = F.col("rate") - F.floor("rate")
    rank = F.when(p > 0, (F.col("u") / (1 - F.col("u"))) / (p / (1 - p)))
    over = F.coalesce((rank < F.col("cut.rank")) | ((rank == F.col("cut.rank")) & (F.col("cut.part") >= 1)), F.lit(False))
    edge = F.coalesce((rank == F.col("cut.rank")) & (F.col("cut.part") > 0) & (F.col("cut.part") < 1), F.lit(False))
    ready = rows.withColumns({"base": F.floor("rate").cast("long"), "over": over, "edge": edge})
    plain = ready.where("NOT edge").select("row", "source_size", "target", "size", (F.col("base") + F.col("over").cast("int")).cast("long").alias("copies"))
    return plain.unionByName(_shared_out(ready.where("edge"), docs)).select("row.*", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


#: Equal rows that one task puts out again.
RUN = 1 << 16


def _shared_out(edge: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of one rank at a source's edge, of which a part gets one copy more: row, source_size, target, size, copies.

    They are copies of one document, so rows that are equal in all columns are counted and put out again, some with one copy
    more; different rows go by a hash of what they hold. So partitions play no part, and no task gets a source's copies.
    """
    names = [F.col(f"row.`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    # nulls don't change a hash, so their places are hashed too
    held = [x for c in names for x in (c, c.isNull())]
    name = F.struct(F.xxhash64(*held).alias("a"), F.xxhash64(F.lit(1), *held).alias("b"))
    kept = ["source_size", "target", "size", "base", "cut"]
    each = edge.groupBy("source", name.alias("name")).agg(F.count("*").alias("n"), F.first("row").alias("row"), *[F.first(c).alias(c) for c in kept])
    order = Window.partitionBy("source").orderBy("name")
    upto = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("n").over(Window.partitionBy("source"))
    each = each.withColumns({"before": upto, "wanted": F.round(whole * F.col("cut.part")).cast("long")})
    more = F.greatest(F.lit(0), F.least(F.col("n"), F.col("wanted") - F.col("before")))
    runs = each.withColumn("more", more).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))))
    runs = runs.repartition("name", "at")
    out = runs.withColumn("i", F.explode(F.sequence(F.col("at"), F.least(F.col("n"), F.col("at") + RUN) - 1)))
    return out.select("row", "source_size", "target", "size", (F.col("base") + (F.col("i") < F.col("more")).cast("int")).cast("long").alias("copies"))


def op10_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: one row a document with the words taken of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents -> documents of the mix: a row for each copy taken, none for those not taken.

    Needs doc_id, source and text; nulls, empties and ties as in the module. All columns keep their values, whatever their
    names. An empty table gives an empty result.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    chosen = mix(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row.alias("whole")))
    return chosen.where("copies > 0").select("whole", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("whole.*")
