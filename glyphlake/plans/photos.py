"""Registered queries from drawn photos: shadows, two columns, lines that touch; rectangles and texts, with SQL for the same."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import reading, segment
from ..session import dealt, table
from ..sources import pictures
from .catalog import query

#: Of a drawn page: size, first line, lines' distance and height, where columns begin, strokes' distance, rows between twins.
HIGH, WIDE, FIRST, APART, TALL, COLUMNS, STROKE, GAP = 400, 320, 20, 60, 12, (10, 180), 5, 4

_CELLS = f"""c AS (SELECT c_custkey // 12 AS page, c_custkey % 12 // 2 AS r, c_custkey % 2 AS side, 12 + floor(abs(c_acctbal))::BIGINT % 16 AS n FROM customer),
b AS (SELECT page, side, n, {FIRST} + r * {APART} AS top, {FIRST} + r * {APART} + {TALL} AS bottom FROM c UNION ALL SELECT page, side, n, {FIRST} + r * {APART} + {TALL}, {FIRST} + r * {APART} + {2 * TALL + GAP} FROM c WHERE (page + r) % 3 = 0),
l AS (SELECT page, n, top, bottom, {COLUMNS[0]} + side * {COLUMNS[1] - COLUMNS[0]} AS x0, dense_rank() OVER (PARTITION BY page ORDER BY top) - 1 AS rw, row_number() OVER (PARTITION BY page ORDER BY top, side) - 1 AS pos FROM b)"""


def drawn(page: int, lines: list) -> np.ndarray:
    """A page whose light falls off to the right; a line is a row of strokes, and some lines have a twin right below that
    touches it."""
    out = np.repeat((255 - np.arange(WIDE) * 0.3).astype(np.uint8)[None], HIGH, axis=0)
    for x in lines:
        top, left = FIRST + x["r"] * APART, COLUMNS[x["side"]]
        at = left + STROKE * np.arange(x["n"])
        out[top : top + TALL, at] = 0
        if (page + x["r"]) % 3 == 0:
            out[top + TALL : top + TALL + GAP, at[:4]] = 0
            out[top + TALL + GAP : top + 2 * TALL + GAP, at] = 0
    return out


def _photos(spark, d):
    """PNGs of the drawn pages, each on its side in one of eight ways: (page, content)."""
    line = F.struct((F.floor(F.col("c_custkey") % 12 / 2)).cast("int").alias("r"), (F.col("c_custkey") % 2).cast("int").alias("side"), (12 + F.floor(F.abs("c_acctbal")).cast("long") % 16).cast("int").alias("n"))
    pages = table(spark, d, "customer").groupBy(F.floor(F.col("c_custkey") / 12).alias("page")).agg(F.collect_list(line).alias("lines"))
    back = {k: turn for k, turn in pictures.UPRIGHT.items()} | {6: pictures.UPRIGHT[8], 8: pictures.UPRIGHT[6]}

    def photo(parts):
        for p in parts:
            for page, lines in zip(p["page"], p["lines"], strict=True):
                turn = int(page % 8 + 1)
                yield pd.DataFrame({"page": [page], "content": [pictures.encoded(back[turn](drawn(page, lines)), turn)]})

    return dealt(pages, "page").mapInPandas(photo, "page long, content binary")


@query(f"""WITH {_CELLS} SELECT page::BIGINT AS page, pos::INT AS pos, rw::INT AS "row", x0::INT AS "left", top::INT AS top, (x0 + {STROKE} * (n - 1) + 1)::INT AS "right", bottom::INT AS bottom FROM l""")
def photo_lines(spark, d):
    """Lines of writing of photos that lie on their side, with a shadow, two columns and lines that touch."""
    return reading.lined(_photos(spark, d), segment.flattened, None, 0, cropped=False)


def strokes(cells: list[bytes]) -> list[str]:
    """A stand-in reader: how many strokes the last row of a line has."""
    out = []
    for data in cells:
        row = pictures.decoded(data)[-1] < segment.INK
        out.append(str(int((row & ~np.concatenate(([False], row[:-1]))).sum())))
    return out


@query(f"""WITH {_CELLS}, r AS (SELECT page, rw, string_agg(n::VARCHAR, ' ' ORDER BY pos) AS t FROM l GROUP BY page, rw) SELECT page::BIGINT AS page, string_agg(t, chr(10) ORDER BY rw) AS text FROM r GROUP BY page""")
def photo_text(spark, d):
    """Photos read as texts: a line's text is the number of its strokes."""
    return reading.photographed(_photos(spark, d), strokes, segment.flattened, None, 0)
