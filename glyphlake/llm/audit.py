"""How text filters overlap: what each removes, alone and after the others, by packed bitmaps.

A task turns its rows into bitsets, rows of one part side by side: one set for each filter (the rows that fail it), one for
each label. For every set of filters the rows that pass them all are the part's rows AND NOT each filter's set; popcounts give
kept, good and toxic rows. These counts add up over tasks, and everything asked follows from them: a filter after a set S
removes kept(S) - kept(S + filter), whatever the order inside S, so 2^n sets answer for n! orders.

The filters of the query: A few words, B repeated words, C many capitals, D markup characters, E an exact copy. Copies are
found by SHA-256 of whole texts: only digests, ids and filter bits are shuffled, and a group of copies is met by (digest,
first id), so no task gets the whole group.

Nulls, empties, ties: a null text is empty; an empty text has no word (fails A only, and E after the first); a null source is
the part of the empty string. A null doc_id fails E never and makes no other row fail it; rows that repeat a doc_id and its
text are no copies of each other. Several labels of a document count as one, which is good or toxic if any says so; null
labels say nothing. Extra columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, table, written

FILTERS = "ABCDE"
#: Of the query's filters: least words, least share of different words and largest share of capitals (of 100), markup.
WORDS, DIFFERENT, CAPITALS, MARKUP = 200, 50, 2, "[#$%&*|]"
#: Rows packed at once; a task adds up this many parts before it sends them on.
ROWS, PARTS = 1 << 18, 1 << 12


def failing(texts: pa.Array) -> np.ndarray:
    """Bits of the filters A to D (bit 0: A) that each text fails."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(texts)
    words, first = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    first = first - first[0]
    codes = np.asarray(words.dictionary_encode().indices).astype(np.int64)
    real = np.asarray(pc.binary_length(words)) > 0
    owner = np.repeat(np.arange(len(texts)), np.diff(first))[real]
    count = np.bincount(owner, minlength=len(texts))
    pairs = np.unique(owner * (int(codes.max(initial=0)) + 1) + codes[real])
    different = np.bincount(pairs // (int(codes.max(initial=0)) + 1), minlength=len(texts))
    capitals = np.asarray(pc.count_substring_regex(texts, "[A-Z]"))
    points = np.asarray(pc.utf8_length(texts))
    markup = np.asarray(pc.match_substring_regex(texts, MARKUP).cast(pa.uint8()))
    fails = (count < WORDS, 100 * different < DIFFERENT * count, 100 * capitals > CAPITALS * points, markup > 0)
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def marked(docs: DataFrame, part: str = "source") -> DataFrame:
    """docs(doc_id, text, part) -> doc_id, part, digest, fails."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches):
        for b in blocks(batches, "text"):
            digests = [hashlib.sha256((t or "").encode()).digest() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array(failing(b.column(2)), pa.int32())], names=["doc_id", "part", "digest", "fails"])

    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("text"))
    return rows.mapInArrow(each, f"doc_id {kind}, part string, digest binary, fails int")


def counts(rows: DataFrame, filters: int) -> DataFrame:
    """rows(part, fails int of that many bits, good boolean, toxic boolean) -> part, passed, kept, good, toxic: for each set of
    filters (bits of `passed`) the rows that pass them all."""
    sets = 1 << filters

    def tally(part, fails, good, toxic):
        """(parts, longs of parts x sets x 3) of rows sorted by part."""
        parts, code = np.unique(part, return_inverse=True)
        code = code.reshape(-1)
        order = np.argsort(code, kind="stable")
        n = np.bincount(code, minlength=len(parts))
        # each part's rows start at a word of 64 bits
        size = (n + 63) // 64
        begin = np.concatenate(([0], np.cumsum(size)))
        place = np.repeat(begin[:-1] * 64 - (np.cumsum(n) - n), n) + np.arange(len(order))

        def bitset(flags):
            bits = np.zeros(int(begin[-1]) * 64, np.uint8)
            bits[place] = flags[order]
            return np.packbits(bits, bitorder="little").view(np.uint64)

        everyone = bitset(np.ones(len(order), np.uint8))
        failed = [bitset(fails >> k & 1) for k in range(filters)]
        labels = [everyone, bitset(good), bitset(toxic)]
        out = np.zeros((len(parts), sets, len(labels)), np.int64)
        for s in range(sets):
            passed = everyone
            for k in range(filters):
                if s >> k & 1:
                    passed = passed & ~failed[k]
            for j, label in enumerate(labels):
                out[:, s, j] = np.add.reduceat(np.bitwise_count(passed & label).astype(np.int64), begin[:-1])
        return parts.tolist(), out

    def sent(total):
        names = list(total)
        flat = np.concatenate([total[p] for p in names])
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(np.repeat(np.arange(len(names)), sets))), pa.array(np.tile(np.arange(sets, dtype=np.int32), len(names))), *(pa.array(flat[:, j]) for j in range(3))], names=["part", "passed", "kept", "good", "toxic"])

    def each(batches):
        total = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                columns = [np.asarray(b.column(0).to_pylist(), object), np.asarray(b.column(1)), *(np.asarray(b.column(j).cast(pa.uint8())) for j in (2, 3))]
                for part, t in zip(*tally(*columns), strict=True):
                    total[part] = total[part] + t if part in total else t
                if len(total) >= PARTS:
                    yield sent(total)
                    total = {}
        if total:
            yield sent(total)

    found = rows.select("part", "fails", "good", "toxic").mapInArrow(each, "part string, passed int, kept long, good long, toxic long")
    return found.groupBy("part", "passed").agg(*[F.sum(c).alias(c) for c in ("kept", "good", "toxic")])


def interactions(rows: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """rows(part, fails, good, toxic) -> a row for each part, filter_order and step, as the query returns them. Filters are
    named by one letter each, that of bit 0 first."""
    n = len(filters)
    everything = (1 << n) - 1
    weights = [math.factorial(k) * math.factorial(n - 1 - k) for k in range(n)]
    packed = counts(rows, n).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("passed", "kept", "good", "toxic"))).alias("c"))
    steps = []
    for order in itertools.permutations(range(n)):
        before = 0
        for step, k in enumerate(order, 1):
            steps.append(("".join(filters[i] for i in order), step, before, k))
            before |= 1 << k
    # n! x n rows, whatever the input
    plan = rows.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, k int")
    at = lambda what, s: F.element_at("c", s + 1)[what]
    gone = lambda what, s, bit: at(what, s) - at(what, s.bitwiseOR(bit))
    one = F.lit
    worth = []
    for k in range(n):
        terms = [one(weights[s.bit_count()]) * (at("kept", one(s)) - at("kept", one(s | 1 << k))) for s in range(1 << n) if not s >> k & 1]
        worth.append(sum(terms[1:], terms[0]).cast("long"))
    alone = [(at("kept", one(everything ^ 1 << k)) - at("kept", one(everything))).alias(f"u{k}") for k in range(n)]
    packed = packed.select("part", "c", F.array(*alone).alias("alone"), F.array(*worth).alias("worth"))
    s, bit = F.col("before"), F.expr("shiftleft(1, k)")
    fails = at("kept", F.lit(0)) - at("kept", bit)
    return packed.join(F.broadcast(plan)).select(
        "part", "filter_order", "step",
        at("kept", s.bitwiseOR(bit)).alias("kept"),
        gone("kept", s, bit).alias("removed"),
        (fails - gone("kept", s, bit)).alias("redundant"),
        F.element_at("alone", F.col("k") + 1).alias("unique_fails"),
        gone("good", s, bit).alias("good_lost"),
        gone("toxic", s, bit).alias("toxic_lost"),
        F.element_at("worth", F.col("k") + 1).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """docs(doc_id, text, part), labels(doc_id, quality, toxic) -> the interactions of filters A to E."""
    rows = written(marked(docs, part), "marked")
    # of each text the smallest id passes E, and so does a null id
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first")).select(F.col("digest").alias("d"), "first")
    said = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(firsts, (F.col("doc_id") == F.col("first")) & (F.col("digest") == F.col("d")), "left")
    copy = (F.col("doc_id").isNotNull() & F.col("first").isNull()).cast("int")
    rows = rows.select("doc_id", "part", F.col("fails").bitwiseOR(F.shiftleft(copy, 4)).alias("fails"))
    rows = rows.join(said, F.col("doc_id") == F.col("labelled"), "left")
    yes = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return interactions(rows.select("part", "fails", yes("good"), yes("toxic")))


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters on all documents by source: a row for each part, order and step."""
    return audit(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


_ORDERS = ", ".join(f"'{''.join(p)}'" for p in itertools.permutations(FILTERS))
ORACLE_OP11 = rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
f AS (SELECT doc_id, part, [len(w) < {WORDS}, 100 * len(list_distinct(w)) < {DIFFERENT} * len(w), 100 * len(regexp_extract_all(text, '[A-Z]')) > {CAPITALS} * length(text), regexp_matches(text, '{MARKUP}'), coalesce(doc_id > first, false)] AS f FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
r AS (SELECT part, f[1]::INT AS a, f[2]::INT AS b, f[3]::INT AS c, f[4]::INT AS d, f[5]::INT AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
g AS (SELECT part, [a, b, c, d, e] AS f, count(*) AS n, sum(good::INT) AS good, sum(toxic::INT) AS toxic FROM r GROUP BY ALL),
o AS (SELECT filter_order, step, instr('{FILTERS}', filter_order[step]) AS k, list_transform(list_filter(string_split(filter_order[1:step - 1], ''), lambda x: x <> ''), lambda x: instr('{FILTERS}', x)) AS before FROM (SELECT unnest([{_ORDERS}]) AS filter_order) CROSS JOIN (SELECT unnest(range(1, 6)) AS step)),
x AS (SELECT part, filter_order, step, k, n, good, toxic, f[k] = 1 AS fails, len(list_filter(before, lambda i: f[i] = 1)) = 0 AS here, list_sum(f) AS all_fails FROM g CROSS JOIN o),
s AS (SELECT part, filter_order, step, k, coalesce(sum(n) FILTER (WHERE here AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE here AND fails), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (WHERE fails AND NOT here), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE fails AND all_fails = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE here AND fails), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE here AND fails), 0)::BIGINT AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM s"""
