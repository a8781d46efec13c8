"""Versions of a table kept apart: a log of snapshots with retention, and writes that are checked before they are seen.

A snapshot is a folder `v=<number>` below the log, written beside it and renamed into place, so a reader sees whole snapshots
only. A version that is written again replaces itself: a repeated micro-batch changes nothing. The newest `keep` versions stay,
and every `every`-th for good. Reading as of a version takes the newest that isn't newer; an empty log raises.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .files import _swap


class Refused(ValueError):
    """A write whose rows break a rule; nothing of it is visible."""


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def checked_write(rows: DataFrame, path: str, rules: Mapping[str, Column], least: int = 0) -> DataFrame:
    """Parquet put in the place of `path` unless a row breaks a rule (a condition that must be true; null breaks it) or there
    are fewer than `least` rows. The counts are observed while the rows are written, beside `path`, in one pass; a refused
    write raises `Refused` with them and leaves the old table."""
    seen = Observation()
    broken = [F.count(F.when(~F.coalesce(rule, F.lit(False)), 1)).alias(f"r{k}") for k, rule in enumerate(rules.values())]
    rows.observe(seen, F.count("*").alias("rows"), *broken).write.mode("overwrite").parquet(f"{path}-part")
    got = seen.get
    faults = {name: got[f"r{k}"] for k, name in enumerate(rules) if got[f"r{k}"]}
    if got["rows"] < least:
        faults["rows"] = got["rows"]
    if faults:
        fs, part = _fs(rows.sparkSession, f"{path}-part")
        fs.delete(part, True)
        raise Refused(f"{faults} of {got['rows']} rows")
    _swap(rows.sparkSession, f"{path}-part", path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def versions(spark: SparkSession, log: str) -> list[int]:
    """Versions there are, ascending."""
    fs, at = _fs(spark, log)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())


def commit(rows: DataFrame, log: str, version: int, keep: int = 3, every: int | None = None) -> None:
    """Puts a version in the log and lets the older ones go."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{log}/.part-{version}")
    _swap(spark, f"{log}/.part-{version}", f"{log}/v={version}")
    for old in versions(spark, log)[:-keep]:
        if not (every and old % every == 0):
            fs, at = _fs(spark, f"{log}/v={old}")
            fs.delete(at, True)


def as_of(spark: SparkSession, log: str, version: int | None = None) -> DataFrame:
    """The newest snapshot, or the newest up to a version."""
    there = [v for v in versions(spark, log) if version is None or v <= version]
    if not there:
        raise LookupError(f"no snapshot in {log}" + ("" if version is None else f" up to {version}"))
    return spark.read.parquet(f"{log}/v={there[-1]}")


def sink(log: str, keep: int = 3, every: int | None = None, whole: Callable[[DataFrame | None, DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch is a version named by its id. `whole(last, batch)` makes the snapshot of the one
    before and the batch; without it a snapshot is the batch."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        there = [v for v in versions(spark, log) if v < number]
        last = spark.read.parquet(f"{log}/v={there[-1]}") if there else None
        commit(whole(last, batch) if whole else batch, log, number, keep, every)

    return put
