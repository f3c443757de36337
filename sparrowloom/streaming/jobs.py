"""Streaming twins of the incremental operators.

Each takes a streaming DataFrame and returns one; state is kept per key by
Spark, so a restart from the checkpoint goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def noop_filter(events: DataFrame, key: str, order: str, norm: str, grip: str, threshold: float) -> DataFrame:
    """(key, order, dropped): a row without motion and of the last kept grip is dropped; state is (moved, last grip).

    Rows of a key must arrive in order from batch to batch; within one they are sorted here.
    """

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order)
        moved, last = state.get if state.exists else (False, None)
        small, grips = (rows[norm] < threshold).to_numpy(), rows[grip].to_numpy()
        # As in the batch: a dropped row carries the grip of the last kept one, so the row before is what counts.
        before = np.logical_or.accumulate(np.concatenate([[moved], ~small]))[:-1]
        same = grips == np.concatenate([np.array([last], dtype=object), grips[:-1].astype(object)])
        state.update((bool(moved or (~small).any()), grips[-1]))
        yield pd.DataFrame({key: rows[key], order: rows[order], "dropped": small & (~before | same)})

    fields = {f.name: f.dataType.simpleString() for f in events.schema}
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {fields[key]}, {order} {fields[order]}, dropped boolean", f"moved boolean, last {fields[grip]}", "append", GroupStateTimeout.NoTimeout)


def plan_steps(requests: DataFrame, key: str, order: str, horizon: int) -> DataFrame:
    """(key, order, plan, step): a queue of horizon actions is refilled when it is empty; state is the steps taken."""

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order)
        (taken,) = state.get if state.exists else (0,)
        n = np.arange(taken, taken + len(rows))
        state.update((taken + len(rows),))
        yield pd.DataFrame({key: rows[key], order: rows[order], "plan": n // horizon, "step": n % horizon})

    fields = {f.name: f.dataType.simpleString() for f in requests.schema}
    return requests.groupBy(key).applyInPandasWithState(step, f"{key} {fields[key]}, {order} {fields[order]}, plan bigint, step bigint", "taken bigint", "append", GroupStateTimeout.NoTimeout)


def log_windows(events: DataFrame, step: str, value: str, every: int) -> DataFrame:
    """(window, avg, n) over each `every` steps; built-in aggregation state, complete or update mode."""
    return events.groupBy(F.floor(F.col(step) / every).alias("window")).agg(F.avg(value).alias("avg"), F.count("*").alias("n"))


def late_windows(events: DataFrame, time: str, key: str, width: str, lateness: str) -> DataFrame:
    """Counts in event-time windows; rows later than lateness no longer count."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def interleave(streams: dict[str, DataFrame]) -> DataFrame:
    """All streams as one, each row with its source's name."""
    out = None
    for name, stream in streams.items():
        tagged = stream.withColumn("loader", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def drain(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run all that is there into an in-memory table; for tests and small results."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def store(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run all that is there into Parquet files; a run with the same checkpoint goes on where the last one stopped."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
