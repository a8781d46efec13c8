"""Small decisions on rows: names, masks, batches, rankings, overrides. All of it stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def short_name(name: Column, suffix: str = ".ttf") -> Column:
    """The second word and the last one's part before a dash, of names of three words or more."""
    bits = F.filter(F.split(F.replace(name, F.lit(suffix), F.lit("")), " "), lambda b: b != "")
    return F.when(F.size(bits) >= 3, F.concat(F.try_element_at(bits, F.lit(2)), F.lit(" ("), F.substring_index(F.element_at(bits, -1), "-", 1), F.lit(")"))).otherwise(name)


def parted(text: Column, at: str = " ") -> Column:
    """struct(head, rest): before and after the first `at`; no `at`: all is head."""
    place = F.instr(text, at)
    return F.struct(F.when(place > 0, F.substring_index(text, at, 1)).otherwise(text).alias("head"), F.when(place > 0, F.substring(text, place + F.lit(len(at)), F.length(text))).otherwise(F.lit("")).alias("rest"))


#: Fixed value: characters of an address that stay as they are.
SAFE = r"[A-Za-z0-9_.~:/@%?=&-]"


def quoted(url: Column) -> Column:
    """An address with every other character as the %XX of its UTF-8 bytes."""
    def one(c):
        return F.when(c.rlike(f"^{SAFE}$"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))

    return F.array_join(F.transform(F.filter(F.split(url, ""), lambda c: c != ""), one), "")


def unquoted(url: Column) -> Column:
    """The characters of an address; a plus sign stays one."""
    return F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B")))


def allowed(vocabulary: Column, banned: Column, step: Column, start: int) -> Column:
    """Token ids that may follow: at the first step only `start`, then all that aren't banned."""
    return F.when(step == 1, F.array(F.lit(start))).otherwise(F.array_sort(F.array_except(vocabulary, banned)))


def masked(scores: Column, keep: Column) -> Column:
    """Scores of tokens (ids from 0) that aren't kept become -infinity."""
    return F.transform(scores, lambda s, i: F.when(F.array_contains(keep, i), s).otherwise(F.lit(float("-inf"))))


def has_bit(cover: Column, at: Column) -> Column:
    """Whether bit `at` of a bitmap (binary) is set; false beyond its end."""
    octet = F.conv(F.hex(F.substring(cover, F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.floor(octet / F.pow(F.lit(2), at % 8)) % 2 == 1, F.lit(False))


def fits(ids: Column, letters: int) -> Column:
    return F.size(ids) <= letters


def capped(ids: Column, limit: int, end: int) -> Column:
    """Cut off by the limit: as long as allowed, and without the end token."""
    return (F.size(ids) >= limit) & ~F.array_contains(ids, end)


def blurred(inputs: Column, roll: Column, other: Column, share: float, pad: int) -> Column:
    """Decoder inputs of which a share is replaced by other tokens; the first and padding stay. roll and other are arrays."""
    return F.transform(F.arrays_zip(inputs.alias("t"), roll.alias("u"), other.alias("o")), lambda z, i: F.when((i > 0) & (z["t"] != pad) & (z["u"] < share), z["o"]).otherwise(z["t"]))


def parameter_group(name: Column, dims: Column) -> Column:
    """Which optimiser group a parameter belongs to: its half of the model, and whether its weights decay."""
    thin = (dims <= 1) | name.endswith(".bias") | F.lower(name).contains("layernorm")
    return F.concat(F.when(name.startswith("encoder."), "encoder").otherwise("decoder"), F.when(thin, "/plain").otherwise("/decay"))


def aspect(letters: Column, noise: Column, sigma: float, most: float = 7.6) -> Column:
    """Wanted width over height of a line of so many letters."""
    return F.least(F.lit(most), 1.35 * F.pow(letters.cast("double"), F.lit(0.613)) * F.exp(sigma * noise))


def worth_reading(box_tall: Column, box_wide: Column, density: Column, page_tall: Column) -> Column:
    """Whether a box holds writing: tall and wide enough, neither pale nor solid."""
    return (box_tall * box_wide > 0) & (box_tall >= 0.018 * page_tall) & (box_tall <= 0.30 * page_tall) & (box_wide >= 0.5 * box_tall) & (density >= 0.015) & (density <= 0.25)


def cheapest(rows: DataFrame, keys: Sequence[str], batch: str, cost: str, spilled: str) -> DataFrame:
    """The measured batch with the least cost among those that didn't spill; the smaller batch wins ties."""
    fine = rows.where(F.col(cost).isNotNull() & (F.col(cost) > 0) & ~F.col(spilled))
    return fine.groupBy(*keys).agg(F.min(F.struct(F.col(cost), F.col(batch))).alias("b")).select(*keys, F.col(f"b.{batch}").alias(batch), F.col(f"b.{cost}").alias(cost))


def spills(rows: DataFrame, keys: Sequence[str], batch: str, peak: str, held: Column, total: Column) -> DataFrame:
    """Adds guess (what the batch would take, doubling what the one before took beyond `held`) and skip (over 90 % of total)."""
    last = F.lag(peak).over(Window.partitionBy(*keys).orderBy(batch))
    guess = held + 2 * F.greatest(F.lit(0.0), last - held)
    return rows.withColumn("guess", guess).withColumn("skip", F.coalesce((last > 0) & (guess > 0.90 * total), F.lit(False)))


def lowest(rows: DataFrame, k: int, *order) -> DataFrame:
    """The k least rows, in order."""
    return rows.orderBy(*order).limit(k)


def declared(rows: DataFrame, name: str, order: Sequence[str], unknown: int = 99) -> DataFrame:
    """Adds `place`: the index of a name in a declared list, `unknown` for others."""
    at = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(name)) - 1
    return rows.withColumn("place", F.when(at < 0, F.lit(unknown)).otherwise(at).cast("int"))


def leftovers(reads: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reads that no truth took."""
    return reads.join(chosen.select(*keys).distinct(), list(keys), "left_anti")


def reordered(cells: DataFrame, turns: DataFrame, truths: DataFrame, key: str, pos: str) -> DataFrame:
    """cells with `place`: where another reading order is declared for a key (turns: key, pos, place) and the key has as many
    cells as truths, the declared place; else the own one."""
    n = cells.groupBy(key).agg(F.count("*").alias("__c")).join(truths.groupBy(key).agg(F.count("*").alias("__t")), key).where("__c = __t").select(key)
    valid = turns.join(n, key, "left_semi").select(key, pos, F.col("place").alias("__p"))
    return cells.join(valid, [key, pos], "left").withColumn("place", F.coalesce("__p", pos)).drop("__p")


def teams(rows: DataFrame, members: str, at: str) -> DataFrame:
    """Rows whose set of members came first; the same members in another order are the same team."""
    same = F.concat_ws("\x01", F.array_sort(members))
    first = Window.partitionBy("__team").orderBy(at)
    return rows.withColumn("__team", same).withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__team", "__r")


def weighed(rows: DataFrame, keys: Sequence[str], photo: str, value: str) -> DataFrame:
    """by_line: the mean over lines; by_photo: the mean of the photos' means."""
    photos = rows.groupBy(*keys, photo).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    return photos.groupBy(*keys).agg((F.sum("s") / F.sum("n")).alias("by_line"), F.avg(F.col("s") / F.col("n")).alias("by_photo"))


def fruitless(rows: DataFrame, keys: Sequence[str], at: str, hit: Column, most: int) -> DataFrame:
    """Adds misses (draws in a row without a hit, up to this one) and stop (more than `most`)."""
    order = Window.partitionBy(*keys).orderBy(at)
    run = F.sum(hit.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__run", run).withColumn("__hit", hit)
    inside = Window.partitionBy(*keys, "__run").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("misses", F.sum((~F.col("__hit")).cast("int")).over(inside)).withColumn("stop", F.col("misses") > most).drop("__run", "__hit")
