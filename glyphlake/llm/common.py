"""What the corpus operators share: the shared folder, written tables, Arrow word splitting."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only for a local master without that setting."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _local[app] = tempfile.mkdtemp(prefix="glyphlake-")
    return _local[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """df stored as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Whether the shuffle files of a query go when it ends, instead of when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, name: str) -> DataFrame:
    """`written`, after which nothing reads the shuffle files of that job: they are removed."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return written(df, name)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of WORD runs; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_of_id(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0))


def blocks(batches, column: str, most: int = 12 << 20):
    """Record batches cut so that one block has about `most` bytes of `column`; a longer single row is a block of its own."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)).cumsum()
        while at < n:
            base = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, base + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of ASCII-lower-cased texts, flat, and for each text its first word's place (one more entry than texts). Null: no words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    # lowered before any cast: pyarrow lowers a slice that was cast wrongly
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, first = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    first = first - first[0]
    keep = np.asarray(pc.binary_length(flat)) > 0
    if not keep.all():
        first = np.concatenate(([0], np.cumsum(keep)))[first]
        flat = flat.filter(pa.array(keep))
    return flat, first
