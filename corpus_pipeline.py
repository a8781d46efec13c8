"""The corpus pipeline: documents through five stages of glyphlake.llm, each written as Parquet and read by the next.

quality (rejected documents go) -> SimHash near-dedup (one of each group stays) -> benchmark decontamination -> mixing to
target weights -> sharding. All but the last return the columns of documents.

Nulls, empties, ties: each stage states its own. An empty documents table gives an empty result; null and empty texts are
scored like any other, count as one group of near copies, hold no benchmark passage and have no words to mix. Columns of
documents keep their names and values through all stages; the last adds shard and slot.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from glyphlake.llm import decontaminate, mixing, quality, sharding, simhash
from glyphlake.llm.common import shared_dir

STAGES = [
    ("quality classifier", quality.stage),
    ("simhash near-dedup", simhash.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("mixing sources", mixing.stage),
    ("sharding", sharding.stage),
]

#: A trained classifier and hashed sampling: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{where}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{where}/{k}")
    return docs
