"""Weighted rendezvous hashing of stable record keys over shards [DataFrame functions only].

Every (key, shard) pair has a score -weight / ln(u), u a uniform made from their hash; a key lives on the shard with the
highest score. A score doesn't depend on the other shards, so one more shard takes rows only into itself, and a shard's
weight changes only its own share.

Nulls, empty and repeated rows: a null key hashes like any other value (all null keys share a shard); rows with equal keys
share a shard; an empty table gives an empty result. Columns of the input are kept; names the operator adds replace the
input's columns of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SHARDS = 16
#: Parts in which each shard is numbered, so that no task sorts a whole shard.
PARTS = 256


def rendezvous(key: Column, weights: Sequence[float], salt: str = "glyphlake") -> Column:
    """The shard (0..) of a key, for shards of the given positive weights."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    text = F.coalesce(key.cast("string"), F.lit("\x00null"))
    scores = []
    for shard, weight in enumerate(weights):
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(f"{salt}/{shard}"), text), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        scores.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("shard")))
    return (-F.array_max(F.array(*scores))["shard"] if len(scores) > 1 else F.lit(0)).cast("int")


def place(records: DataFrame, key: str, weights: Sequence[float], shard: str = "shard") -> DataFrame:
    """records with the column `shard`; narrow, no shuffle."""
    return records.withColumn(shard, rendezvous(F.col(key), weights))


def numbered(placed: DataFrame, order: Sequence[str], shard: str = "shard", slot: str = "slot", parts: int = PARTS) -> DataFrame:
    """placed with `slot`: gapless from 0 in each shard. A shard is numbered in `parts` hash parts side by side; only their
    sizes (shards x parts rows) are summed in one place. Rows equal in all of `order` are interchangeable."""
    whole = F.struct(*[F.col(f"`{c}`") for c in placed.columns if c != slot])
    keys = [F.col(f"`{c}`").alias(f"o{k}") for k, c in enumerate(order)]
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in order]), F.lit(parts)).cast("int")
    rows = placed.select(whole.alias("row"), F.col(f"`{shard}`").alias("shard"), part.alias("part"), *keys)
    sizes = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "part").orderBy(*[f"o{k}" for k in range(len(keys))])
    # starts has at most shards x parts rows, a size fixed by parameters
    joined = rows.withColumn("k", F.row_number().over(inside) - 1).join(F.broadcast(starts), ["shard", "part"])
    return joined.select("row.*", (F.col("start") + F.col("k")).cast("long").alias(slot))


def op2_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 equal shards by doc_id (law `key`). A null text has size 1 and checksum 0."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = place(place(docs, "doc_id", [1.0] * SHARDS), "doc_id", [1.0] * (SHARDS + 1), "grown_shard")
    return numbered(placed, ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents -> documents with shard and slot. Rows repeated by the mix share their document's shard.

    Needs doc_id only. A null doc_id is a key like any other; columns named shard or slot are replaced, all others keep
    their values, whatever their names. An empty table gives an empty result.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    return numbered(place(docs.select(*kept), "doc_id", [1.0] * SHARDS), ["doc_id"])
