"""Keyed matching over streams: buffers live in the state store between micro-batches.

Within a micro-batch records are ordered by `seq`; across micro-batches, arrival rules. Unmatched records and
incomplete batches stay in state. Keys and values may be of any type that Arrow carries. Each micro-batch is a completion:
what arrives after one is handled at a later one, as a separate emission.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _ordered(batches: Iterator[pd.DataFrame], kind: str | None = None) -> list[tuple]:
    """(seq, kind, value) of a micro-batch's rows, by seq and kind."""
    found = [x for b in batches for x in zip(b["seq"].tolist(), b[kind].tolist() if kind else [0] * len(b), b["value"].tolist())]
    return sorted(found, key=lambda x: x[:2])


def stream_zip(rows: DataFrame, kinds: int) -> DataFrame:
    """key, value_0 .. of rows (key, kind int, seq, value): the i-th values of all kinds of a key."""
    of_key, of_value = (rows.schema[c].dataType.simpleString() for c in ("key", "value"))
    names = [f"value_{k}" for k in range(kinds)]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [list(x) for x in state.get] if state.exists else [[] for _ in range(kinds)]
        for _, kind, value in _ordered(batches, "kind"):
            held[int(kind)].append(value)
        n = min(map(len, held))
        yield pd.DataFrame({"key": [key[0]] * n, **{c: h[:n] for c, h in zip(names, held)}})
        left = [h[n:] for h in held]
        if any(left):
            state.update(tuple(left))
        elif state.exists:
            state.remove()

    output = f"key {of_key}, " + ", ".join(f"{c} {of_value}" for c in names)
    stored = ", ".join(f"k{k} array<{of_value}>" for k in range(kinds))
    return rows.groupBy("key").applyInPandasWithState(step, output, stored, "append", GroupStateTimeout.NoTimeout)


def stream_batches(rows: DataFrame, size: int) -> DataFrame:
    """key, values of rows (key, seq, value): every `size` values of a key."""
    of_key, of_value = (rows.schema[c].dataType.simpleString() for c in ("key", "value"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        held += [v for _, _, v in _ordered(batches)]
        full = len(held) // size
        yield pd.DataFrame({"key": [key[0]] * full, "values": [held[i * size : (i + 1) * size] for i in range(full)]})
        if held[full * size :]:
            state.update((held[full * size :],))
        elif state.exists:
            state.remove()

    return rows.groupBy("key").applyInPandasWithState(step, f"key {of_key}, values array<{of_value}>", f"held array<{of_value}>", "append", GroupStateTimeout.NoTimeout)


def stream_sessions(rows: DataFrame, ts: str, gap: str, late: str) -> DataFrame:
    """key, start, n, total: sums over a key's sessions, which a pause of `gap` ends; later than `late` is dropped."""
    return rows.withWatermark(ts, late).groupBy("key", F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("key", F.col("w.start").alias("start"), "n", "total")


def stream_fold(rows: DataFrame, ts: str, late: str, window: str, *aggregates: Column) -> DataFrame:
    """key, start and the aggregates of each window of time; in update mode a late value emits its window's new state."""
    return rows.withWatermark(ts, late).groupBy("key", F.window(ts, window).alias("w")).agg(*aggregates).select("key", F.col("w.start").alias("start"), *[F.col(c) for c in _names(rows, aggregates)])


def _names(rows: DataFrame, aggregates) -> list[str]:
    return rows.sparkSession.createDataFrame([], rows.schema).agg(*aggregates).columns


def completions(rows: DataFrame, reduction: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """A started query that reduces what has arrived since the last completion, each time by itself, and writes the result
    with `completion`, its number, as Parquet under `path`: a folder for each, so that a repeated one replaces itself."""

    def complete(batch: DataFrame, number: int) -> None:
        reduction(batch).withColumn("completion", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(complete).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
