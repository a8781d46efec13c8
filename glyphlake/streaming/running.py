"""A running state for each key on a stream: a moving average with warm-up, rows seen, the best value and rows since it.

The state lives in the stream's state store, so a restart from the checkpoint goes on where it stopped. A micro-batch's rows
of a key are taken in the order of the columns `at`; micro-batches in the order in which they come. So a stream whose files come in order
gives what `folded` gives over the whole table. A null value counts as seen and changes nothing else; null keys are a key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "seen long, k long, held double, best double, misses long"
#: The store that keeps typed states.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def step(state: tuple, value: float | None, decay: float) -> tuple:
    """(seen, updates, held, best, misses) after one more value."""
    seen, k, held, best, misses = state
    if value is None or value != value:
        return seen + 1, k, held, best, misses
    rate = min(decay, k / (9.0 + k))
    held = value if held is None else rate * held + (1 - rate) * value
    better = best is None or value > best
    return seen + 1, k + 1, held, value if better else best, 0 if better else misses + 1


class Running(StatefulProcessor):
    def __init__(self, decay: float):
        self.decay = decay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("running", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows))
        got = got.sort_values([c for c in got.columns if c.startswith("at")], kind="stable")
        state = tuple(self.state.get()) if self.state.exists() else (0, 0, None, None, 0)
        for value in got["value"].tolist():
            state = step(state, value, self.decay)
        self.state.update(state)
        yield pd.DataFrame({"key": [key[0]], **{c.split()[0]: pd.Series([v], dtype=object) for c, v in zip(STATE.split(", "), state, strict=True)}})

    def close(self) -> None:
        pass


def running(stream: DataFrame, key: str, at: Sequence[str], value: str, decay: float = 0.9) -> DataFrame:
    """A stream -> key, seen, k, held, best, misses after each micro-batch, for the keys in it (output mode Update)."""
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(F.col(key).alias("key"), *[F.col(c).alias(f"at{k}") for k, c in enumerate(at)], F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").transformWithStateInPandas(Running(decay), f"key {kind}, {STATE}", "Update", "None")


def folded(df: DataFrame, key: str, at: Sequence[str], value: str, decay: float = 0.9) -> DataFrame:
    """The same over a whole table, a key's rows sorted and folded in one array."""
    values = F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"at{k}") for k, c in enumerate(at)], F.col(value).cast("double").alias("value")))), lambda s: s["value"])
    none = F.lit(None).cast("double")
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("k"), none.alias("held"), none.alias("best"), F.lit(0).cast("long").alias("misses"))

    def one(s, v):
        rate = F.least(F.lit(decay), s["k"] / (9.0 + s["k"]))
        better = s["best"].isNull() | (v > s["best"])
        after = F.struct((s["seen"] + 1).alias("seen"), (s["k"] + 1).alias("k"), F.coalesce(rate * s["held"] + (1 - rate) * v, v).alias("held"), F.when(better, v).otherwise(s["best"]).alias("best"), F.when(better, F.lit(0).cast("long")).otherwise(s["misses"] + 1).alias("misses"))
        same = F.struct((s["seen"] + 1).alias("seen"), s["k"].alias("k"), s["held"].alias("held"), s["best"].alias("best"), s["misses"].alias("misses"))
        return F.when(v.isNull() | F.isnan(v), same).otherwise(after)

    return df.groupBy(F.col(key).alias("key")).agg(F.aggregate(values, start, one).alias("s")).select("key", "s.*")
