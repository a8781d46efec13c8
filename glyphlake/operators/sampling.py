"""Splits, error-weighted picks and generated forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregate import at_ranks, hashes
from .sequence import cumulative


def error_weights(scores: DataFrame, name: str, score: str, share: float = 0.5) -> DataFrame:
    """p = (1 - share) / n + share err / sum(err), err = max(0, 100 - score); a missing score has the upper median error."""
    err = F.greatest(F.lit(0.0), 100.0 - F.col(score))
    known = scores.where(F.col(score).isNotNull()).select(err.alias("err"))
    # always one row
    mid = at_ranks(known, [], "err", [(0.5, F.floor(F.col("n") / 2))]).agg(F.max("value").alias("mid"))
    rows = scores.join(F.broadcast(mid)).withColumn("err", F.coalesce(err, F.col("mid"), F.lit(0.0))).drop("mid")
    total = rows.agg(F.sum("err").alias("__s"), F.count("*").alias("__n"))
    # one row
    rows = rows.join(F.broadcast(total))
    return rows.withColumn("p", (1 - share) / F.col("__n") + share * F.col("err") / F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0)).drop("__s", "__n")


def inverse_cdf(draws: DataFrame, weights: DataFrame, at: str, weight: str, u: str = "u", step: float = 0.001) -> DataFrame:
    """Each draw's row of weights: the one whose [lo, hi) holds u times the total. Both sides meet in buckets of width
    `step` of the total, so it is an equi-join."""
    lines = cumulative(weights, [], at, weight)
    lines = lines.join(F.broadcast(lines.agg(F.max("hi").alias("__t"))))
    lines = lines.withColumn("__b", F.explode(F.sequence(F.floor(F.col("lo") / F.col("__t") / step), F.floor(F.col("hi") / F.col("__t") / step))))
    asked = draws.withColumn("__db", F.floor(F.col(u) / step))
    return asked.join(lines, (F.col("__db") == F.col("__b")) & (F.col(u) * F.col("__t") >= F.col("lo")) & (F.col(u) * F.col("__t") < F.col("hi"))).drop("__b", "__db", "__t")


def herds(items: DataFrame, key: str, test: DataFrame, wide: DataFrame) -> DataFrame:
    """Adds herd: held out, broad or trained, by membership of key."""
    t, w = test.select(F.col(key).alias("__t")).distinct(), wide.select(F.col(key).alias("__w")).distinct()
    rows = items.join(t, F.col(key) == F.col("__t"), "left").join(w, F.col(key) == F.col("__w"), "left")
    return rows.withColumn("herd", F.when(F.col("__t").isNotNull(), "held out").when(F.col("__w").isNotNull(), "broad").otherwise("trained")).drop("__t", "__w")


def uniform(seed: int, *parts) -> Column:
    """A uniform of (0, 1) from a seed and columns or constants; the same in every run."""
    keys = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) + 0.5) / float(1 << 53)


def pick(options: Sequence, u: Column, weights: Sequence[float] | None = None) -> Column:
    """One of the options by a uniform."""
    weights = weights or [1.0] * len(options)
    total, edge = sum(weights), 0.0
    out = None
    for o, w in zip(options[:-1], weights, strict=False):
        edge += w / total
        value = o if isinstance(o, Column) else F.lit(o)
        out = F.when(u < edge, value) if out is None else out.when(u < edge, value)
    last = options[-1] if isinstance(options[-1], Column) else F.lit(options[-1])
    return last if out is None else out.otherwise(last)


#: Invented words for generated forms; every choice is a hash of the line's number, so any engine can repeat it.
HEADS = ("바", "도", "라", "미", "소", "하", "온", "별")
TAILS = ("람", "담", "솔", "진", "울", "빛", "나", "결")
LATIN = ("Ald", "Bex", "Cor", "Dun", "Elm", "Fyn", "Gor", "Hax")
ENDS = ("er", "on", "ia", "um", "ex", "is", "or", "al")
UNITS = ("팀", "부", "국", "실", "반")
PAPERS = ("목록", "보고서", "신청서", "계획", "대장")
FIELDS = ("이름", "부서", "날짜", "번호", "제목", "담당")
BETWEEN = (" : ", ": ", " ", " - ")
#: Kinds of a form's value, and how they are shared out of 16.
VALUES = ("name", "name", "name", "org", "org", "org", "doc", "doc", "doc", "date", "date", "slot", "latin", "latin", "sentence", "sentence")
CHOICES = 16


def forms(keys: DataFrame, key: str) -> DataFrame:
    """A generated line (pos, kind, text) for each integer key: a field, a separator and a value (a made name, a unit, a paper with its number, a
    date, a time slot, a latin word or a long sentence), some of them in brackets or with a mark. The words hold no undrawable
    character."""
    # exploded, so that the hashes are computed once and not inside every choice
    rows = keys.select(F.col(key).alias("pos"), F.explode(F.array(hashes(F.col(key), CHOICES))).alias("h"))
    n = lambda k, top: (F.element_at("h", k + 1) % top).cast("int")
    one = lambda options, k: F.element_at(F.array(*[F.lit(o) for o in options]), n(k, len(options)) + 1)
    made = F.concat(one(HEADS, 2), one(TAILS, 3))
    number = lambda k, lo, hi, width: F.lpad((n(k, hi - lo + 1) + lo).cast("string"), width, "0")
    values = {
        "name": F.concat(one(HEADS, 2), one(TAILS, 3), one(TAILS, 4)),
        "org": F.concat(made, one(UNITS, 4)),
        "doc": F.concat(one(PAPERS, 4), F.lit(" "), number(5, 1, 9999, 4), F.lit("-"), number(6, 1, 99, 2)),
        "date": F.concat(number(4, 2001, 2030, 4), F.lit("-"), number(5, 1, 12, 2), F.lit("-"), number(6, 1, 28, 2)),
        "slot": F.concat(number(4, 0, 23, 2), F.lit(":"), number(5, 0, 59, 2), F.lit("~"), number(6, 0, 23, 2), F.lit(":"), number(7, 0, 59, 2)),
        "latin": F.concat(one(LATIN, 4), one(ENDS, 5), F.lit(" "), number(6, 1, 99, 2)),
        "sentence": F.concat(made, F.lit("에서 "), one(HEADS, 4), one(TAILS, 5), F.lit("과 "), one(HEADS, 6), one(TAILS, 7), F.lit(" "), one(PAPERS, 8), F.lit("를 함께 읽는다.")),
    }
    rows = rows.withColumn("kind", one(VALUES, 1))
    value = None
    for k, v in values.items():
        value = F.when(F.col("kind") == k, v) if value is None else value.when(F.col("kind") == k, v)
    line = F.when(F.col("kind") == "sentence", value).otherwise(F.concat(one(FIELDS, 9), one(BETWEEN, 10), value))
    # a step of its own: the line isn't built again for each mark
    rows = rows.select("pos", "kind", n(11, 16).alias("mark"), F.explode(F.array(line)).alias("line"))
    line, mark = F.col("line"), F.col("mark")
    text = F.when(mark == 0, F.concat(F.lit("("), line, F.lit(")"))).when(mark == 1, F.concat(line, F.lit("!"))).when(mark == 2, F.concat(F.lit("- "), line)).otherwise(line)
    return rows.select("pos", "kind", text.alias("text"))


def covered_pick(lines: DataFrame, fonts: DataFrame, tries: int = 6) -> DataFrame:
    """lines(pos, chars array) x fonts(font, glyphs array, full boolean) -> pos, font, covered. Up to `tries` uniform picks
    by hash, the first that covers the line is taken; else a uniform one of the full fonts that cover it (all fonts if none
    is full), or of those fonts if none does. Fonts are a short list, whose size is checked by whoever makes it."""
    listed = fonts.agg(F.array_sort(F.collect_list(F.struct("font", "glyphs", "full"))).alias("fonts"))
    rows = lines.join(F.broadcast(listed)).withColumn("h", F.explode(F.array(hashes(F.col("pos"), tries + 1))))
    covers = lambda f: F.size(F.array_except(F.col("chars"), f["glyphs"])) == 0
    at = lambda a, h: F.element_at(a, (h % F.size(a)).cast("int") + 1)
    tried = F.filter(F.transform(F.slice("h", 1, tries), lambda x: at(F.col("fonts"), x)), covers)
    full = F.filter("fonts", lambda f: f["full"])
    rows = rows.withColumn("tried", tried).withColumn("base", F.when(F.size(full) > 0, full).otherwise(F.col("fonts")))
    rows = rows.withColumn("able", F.filter("base", covers))
    last = at(F.when(F.size("able") > 0, F.col("able")).otherwise(F.col("base")), F.element_at("h", tries + 1))
    chosen = F.when(F.size("tried") > 0, F.try_element_at("tried", F.lit(1))).otherwise(last)
    return rows.withColumn("f", chosen).select("pos", F.col("f.font").alias("font"), covers(F.col("f")).alias("covered"))
