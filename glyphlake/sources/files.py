"""Files and tables: images by glob, JSON, resumable and merging sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matching import upsert


def images(spark: SparkSession, path: str, glob: str = "*.jpg") -> DataFrame:
    """path, content of files whose name fits, in name order."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content").orderBy("path")


def json_card(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def truth(spark: SparkSession, path: str) -> DataFrame:
    """A truth file {photo: {lines, ...}} as photo, pos, text, gauge."""
    kind = "map<string, struct<lines:array<string>, person:string, org:string, gauge:boolean>>"
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("photo", "t"))
    return whole.select("photo", F.posexplode("t.lines").alias("pos", "text"), F.coalesce("t.gauge", F.lit(False)).alias("gauge"))


def resume(planned: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is planned and not done yet."""
    return planned.join(done.select(*keys).distinct(), list(keys), "left_anti")


def json_store(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, non-ASCII as it is; the committer makes the folder's files visible at once."""
    rows.write.mode("overwrite").json(path)


def _swap(spark: SparkSession, fresh: str, path: str) -> None:
    """Puts the folder `fresh` in the place of `path` by renames in its file system; the old one goes when the new one stands."""
    jvm = spark.sparkContext._jvm
    new, old, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (fresh, path, f"{path}-old"))
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(aside, True)
    if fs.exists(old):
        fs.rename(old, aside)
    if not fs.rename(new, old):
        raise OSError(f"cannot put {fresh} in place of {path}")
    fs.delete(aside, True)


def atomic_write(rows: DataFrame, path: str) -> DataFrame:
    """Parquet written beside `path` and then renamed to it: readers see the old table or the new one. rows may be read from
    `path` itself. A write that fails leaves the old table."""
    rows.write.mode("overwrite").parquet(f"{path}-part")
    _swap(rows.sparkSession, f"{path}-part", path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def merge_into(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keeps old rows not measured again, adds the new ones, and puts the result in the table's place."""
    return atomic_write(upsert(spark.read.parquet(path), new, keys), path)


def checkpointed(planned: DataFrame, path: str, side: str, measure) -> DataFrame:
    """Measures a side at a time, each into a partition of its own of `path`-partial; sides already there are skipped, and
    when all are there the table is put in place. planned has the column `side`, of which there are few."""
    spark = planned.sparkSession
    partial = f"{path}-partial"
    for (name,) in planned.select(side).distinct().orderBy(side).collect():
        at = f"{partial}/{side}={name}"
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
        if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            measure(planned.where(F.col(side) == name)).drop(side).write.mode("overwrite").parquet(at)
    _swap(spark, partial, path)
    return spark.read.parquet(path)


def zip_members(archives: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """archives(path, content) -> path, name, content of members with a suffix; resource forks are left out."""
    import io
    import zipfile

    import pandas as pd

    def each(parts):
        for p in parts:
            rows = []
            for x in p.itertuples():
                with zipfile.ZipFile(io.BytesIO(x.content)) as z:
                    rows += [(x.path, n, z.read(n)) for n in z.namelist() if n.lower().endswith(tuple(suffixes)) and not n.split("/")[-1].startswith("._")]
            yield pd.DataFrame(rows, columns=["path", "name", "content"])

    return archives.select("path", "content").mapInPandas(each, "path string, name string, content binary")
