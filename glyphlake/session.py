"""Session builder and table loader."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "glyphlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow on; further settings by keyword, dots as underscores doubled."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df over as many tasks as the session shuffles into, for rows that are small and cost much. By a hash of the key: a
    shuffle by the key itself is dropped where df is spread by it already, and rows then stay in as few tasks as their bytes need."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(key))


_local: dict[str, str] = {}


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only for a local master without that setting."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _local[app] = tempfile.mkdtemp(prefix="glyphlake-")
    return _local[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of the shared folder: its lineage ends there, and a lost executor doesn't change it."""
    path = f"{shared(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
