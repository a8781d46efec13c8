"""Which fonts draw a line: an inverted index of glyphs to bitmaps of fonts.

Fonts are numbered and a glyph's fonts are bits of longs, 64 a long, so the index has glyphs x fonts / 64 rows at most. A line's
letters are joined with it and their bitmaps are ANDed a long at a time: fonts aren't collected, however many there are. A
long in which a letter has no row has no font for the line. White space needs no glyph; a line without letters is drawn by
every font; a line none draws keeps its row. A font without glyphs draws only such lines. Null lines are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .numbering import numbered


def index(covers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """covers(font, glyph) -> (fonts(font, number), index(glyph, word, bits)). A font may have a null glyph for none."""
    fonts = numbered(covers.select("font").distinct(), ["font"], "number")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("number") % 64).cast("int"))
    rows = covers.where("glyph IS NOT NULL").join(fonts, "font")
    words = rows.groupBy("glyph", F.floor(F.col("number") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))
    return fonts, words


def drawing(lines: DataFrame, covers: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """lines(key..., text) -> key..., letters, fonts (how many draw all letters), drawable."""
    fonts, words = index(covers)
    count = fonts.agg(F.count("*").alias("every"))
    letters = F.array_distinct(F.filter(T.chars(F.coalesce(F.col(text), F.lit(""))), lambda c: ~c.rlike(r"(?U)^\s$")))
    rows = lines.select(*key, F.explode(F.array(letters)).alias("letters"))
    each = rows.select(*key, F.size("letters").alias("n"), F.explode("letters").alias("glyph"))
    # a bit survives a long only if every letter has a row there
    able = each.join(words, "glyph").groupBy(*key, "word").agg(F.bit_and("bits").alias("bits"), F.count("*").alias("met"), F.first("n").alias("n"))
    able = able.where("met = n").groupBy(*key).agg(F.sum(F.bit_count("bits")).alias("fonts"))
    # one row
    whole = rows.join(F.broadcast(count)).join(able, key, "left")
    drawn = F.when(F.size("letters") == 0, F.col("every")).otherwise(F.coalesce("fonts", F.lit(0))).cast("long")
    return whole.select(*key, F.size("letters").alias("letters"), drawn.alias("fonts"), (drawn > 0).alias("drawable"))
