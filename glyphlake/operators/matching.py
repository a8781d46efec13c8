"""Joins: greedy pairing, leaks, rosters, prefixes, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import stored


#: A key's reads meet its truths in this many tasks.
SALTS = 8


def greedy_pairs(reads: DataFrame, truths: DataFrame, key: str, score=T.ratio) -> DataFrame:
    """Best-pair matching inside each key: the best pair by (score, read, truth) is taken, then the best of what is free, and
    so on; unmatched truths have a null read. key, truth_pos, truth, read_pos, read, score.

    reads and truths have key, pos and text; null texts count as empty. A round takes every pair that is the best of both its
    read and its truth: greedy would take it too, as nothing better touches either. What a round takes leaves with all its
    pairs; rounds end when no pair is left, so no key is gathered in a task. A key's pairs are reads x truths in number, since
    each has a score: a key is a page, and its reads are salted over tasks.
    """
    text = lambda df, name: df.select(F.col(key).alias("__k"), F.col("pos").alias(f"{name}_pos"), F.coalesce("text", F.lit("")).alias(name))
    left = text(reads, "read").withColumn("__s", F.pmod(F.xxhash64("read_pos"), F.lit(SALTS)).cast("int"))
    right = text(truths, "truth")
    salted = right.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # nothing is read of equal keys but null ones, which are no page
    pairs = stored(left.join(salted, ["__k", "__s"]).select("__k", "read_pos", "truth_pos", score(F.col("read"), F.col("truth")).cast("double").alias("score")), "pairs")
    order = F.struct("score", "read_pos", "truth_pos")
    taken = None
    while not pairs.isEmpty():
        by_read = pairs.groupBy("__k", "read_pos").agg(F.max(order).alias("b")).select("__k", "read_pos", F.col("b.truth_pos").alias("truth_pos"), F.col("b.score").alias("score"))
        by_truth = pairs.groupBy("__k", "truth_pos").agg(F.max(order).alias("b")).select("__k", F.col("b.read_pos").alias("read_pos"), "truth_pos")
        both = stored(by_read.join(by_truth, ["__k", "read_pos", "truth_pos"]), "matched")
        taken = both if taken is None else taken.unionByName(both)
        pairs = stored(pairs.join(both.select("__k", "read_pos"), ["__k", "read_pos"], "left_anti").join(both.select("__k", "truth_pos"), ["__k", "truth_pos"], "left_anti"), "pairs")
    if taken is None:
        taken = pairs
    out = right.join(taken.join(left.drop("__s"), ["__k", "read_pos"]), ["__k", "truth_pos"], "left")
    return out.select(F.col("__k").alias(key), "truth_pos", "truth", "read_pos", F.coalesce("read", F.lit("")).alias("read"), F.coalesce("score", F.lit(0.0)).alias("score"))


def leaks(items: DataFrame, tests: DataFrame, shingle: int = 5) -> DataFrame:
    """items(id, text) that hold shingles of tests(id, text): shared distinct shingles and Jaccard similarity of each pair
    that shares any. A row's distinct shingles are found and counted inside the row."""

    def held(c):
        # behind a generator, so that the optimizer doesn't put the expression where its name stands: that would split the
        # whole text again for every shingle
        return F.explode(F.array(c))

    def cut(df, name):
        words = F.filter(F.split(F.lower("text"), r"[ \n]+"), lambda x: x != "")
        rows = df.select(F.col("id").alias(name), held(words).alias("w")).where(F.size("w") >= shingle)
        each = F.transform(F.sequence(F.lit(1), F.size("w") - shingle + 1), lambda i: F.array_join(F.slice("w", i, shingle), " "))
        rows = rows.select(name, held(F.array_distinct(each)).alias("s"))
        return rows.select(name, F.size("s").alias(f"n_{name}"), F.explode("s").alias("s"))

    both = cut(items, "item").join(cut(tests, "test"), "s")
    shared = both.groupBy("item", "test").agg(F.count("*").alias("shared"), F.first("n_item").alias("a"), F.first("n_test").alias("b"))
    return shared.select("item", "test", "shared", F.round(F.col("shared") / (F.col("a") + F.col("b") - F.col("shared")), 6).alias("jaccard"))


def roster(reads: DataFrame, options: DataFrame, text: str = "text", option: str = "option") -> tuple[DataFrame, DataFrame]:
    """(hits, rest): reads whose trimmed text is an option, and the others for the costly path."""
    keyed = reads.withColumn("__k", F.trim(text))
    known = options.select(F.trim(option).alias("__k")).distinct()
    return keyed.join(known, "__k", "left_semi").drop("__k"), keyed.join(known, "__k", "left_anti").drop("__k")


def prefixes(options: DataFrame, tokens: str, end: str = "<end>") -> DataFrame:
    """Prefix tree as a table: prefix (tokens joined by a space) and the tokens that may follow it."""
    at = F.explode(F.sequence(F.lit(0), F.size(tokens)))
    rows = options.select(tokens, at.alias("i")).select(F.array_join(F.slice(tokens, 1, F.col("i")), " ").alias("prefix"), F.coalesce(F.try_element_at(tokens, (F.col("i") + 1).cast("int")), F.lit(end)).alias("next"))
    return rows.distinct()


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """new rows, and old rows whose key wasn't measured again."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def stale(rows: DataFrame, cache: DataFrame, key: str, stamp: str) -> DataFrame:
    """Rows whose stamp isn't the cached one: those to measure again."""
    return rows.join(cache.select(key, stamp), [key, stamp], "left_anti")


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
