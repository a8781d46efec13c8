"""Readers as a plug-in: anything with read(images) -> texts; ensembles vote by medoid."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import pictures
from . import segment
from .aggregate import medoid

Reader = Callable[[list[bytes]], list[str]]
#: Below this trust a read is unsure; -1 means unmeasured and is not.
EDGE = 0.80
#: Lines of writing in one Arrow batch.
LINES = 256


def read(cells: DataFrame, readers: dict[str, Reader]) -> DataFrame:
    """cells(cell, pix) -> (cell, pos, reader, text), each reader over Arrow batches."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for k, (name, reader) in enumerate(sorted(readers.items())):
                yield pd.DataFrame({"cell": p["cell"], "pos": k, "reader": name, "text": reader(list(p["pix"]))})

    kind = cells.schema["cell"].dataType.simpleString()
    return cells.select("cell", "pix").mapInPandas(each, f"cell {kind}, pos int, reader string, text string")


def trusted(reads: DataFrame, score: Callable[[Column, Column], Column]) -> DataFrame:
    """The medoid of each cell's reads with its trust and whether it is unsure; one reader alone has trust -1."""
    members = reads.groupBy("cell").agg(F.count("*").alias("members"))
    best = medoid(reads, "cell", "pos", "text", score).withColumnRenamed("key", "cell")
    out = members.join(best, "cell", "left").select("cell", F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("members") == 1, -1.0).otherwise(F.coalesce("trust", F.lit(0.0))).alias("trust"))
    return out.withColumn("unsure", (F.col("trust") >= 0) & (F.col("trust") < EDGE))


def lined(files: DataFrame, how=None, most: int | None = 12, pad: int = 6, cropped: bool = True) -> DataFrame:
    """files(page, content) -> page, pos, row, left, top, right, bottom of each line of writing and, if `cropped`, its PNG
    (content). A picture goes from its bytes to its lines before the next is opened, so pixels of one page at a time are held
    and none travel. A picture that can't be read has no lines."""
    how = how or segment.prepared
    names = ["page", "pos", "row", "left", "top", "right", "bottom"] + ["content"] * cropped

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for page, data in zip(p["page"], p["content"], strict=True):
                try:
                    _, grey = pictures.upright(data)
                except pictures.FAULTS:
                    continue
                grey = how(np.ascontiguousarray(grey))
                for k, (r, b) in enumerate(segment.found(grey, most, pad)):
                    rows.append((page, k, r, *b, *([pictures.encoded(grey[b.top : b.bottom, b.left : b.right])] if cropped else [])))
                if len(rows) >= LINES:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    kind = files.schema["page"].dataType.simpleString()
    return files.select("page", "content").mapInPandas(each, f"page {kind}, pos int, row int, left int, top int, right int, bottom int" + ", content binary" * cropped)


def photographed(files: DataFrame, reader: Reader, how=None, most: int | None = 12, pad: int = 6) -> DataFrame:
    """files(page, content) -> page, text: pictures turned upright, made ready, cut into lines of writing, each line read as a
    PNG of its own, lines of a row joined by a space and rows by \\n. A picture that can't be read or holds no writing has the
    empty text."""
    kind = files.schema["page"].dataType
    told = read(lined(files, how, most, pad).select(F.struct("page", "row", "pos").alias("cell"), F.col("content").alias("pix")), {"reader": reader})
    rows = told.groupBy(F.col("cell.page").alias("page"), F.col("cell.row").alias("row")).agg(F.array_sort(F.collect_list(F.struct("cell.pos", "text"))).alias("t"))
    rows = rows.select("page", "row", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))
    # a page has `most` lines
    whole = rows.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return files.select(F.col("page").cast(kind)).join(whole, "page", "left").select("page", F.coalesce("text", F.lit("")).alias("text"))
