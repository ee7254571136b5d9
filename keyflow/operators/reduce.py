"""Keyed reductions: list to list, list to one value, chained, final, sorted and debounced."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import fresh

#: Results that are written at a time.
_BATCH = 10_000


def fold(rows: DataFrame, *aggregates: Column, least: int | None = None) -> DataFrame:
    """One row for each key by built-in aggregates, which combine before the shuffle; `least`: keys with fewer values are left out."""
    if least is None:
        return rows.groupBy("key").agg(*aggregates)
    return rows.groupBy("key").agg(*aggregates, F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")


def reduce(rows: DataFrame, functions: Sequence[Callable], value_type: T.DataType, least: int = 0, chunk: int | None = None, run: int | str | None = None) -> DataFrame:
    """key, idx, value: what each of the functions (key, values) -> values in turn makes of a key's ordered values.

    An empty list ends a key's chain. Functions that Python alone can express run over rows in the order of keys, many keys
    in an Arrow batch; built-in aggregates (`fold`) are the better way for all others. With `chunk`, at most so many values of
    a key, next to each other, are reduced by themselves first, and then their results together: right for functions that may
    be applied in parts and to their own results, as a reduction's may. Rows are then dealt by ranges of key and order, so
    that a task holds a chunk or the results alone, not a whole key; `run`, which numbered them once, is no longer needed.
    """
    rows = rows.select("key", "seq", "value")
    schema = T.StructType([rows.schema["key"], T.StructField("idx", T.IntegerType()), T.StructField("value", value_type)])
    if chunk is None:
        return rows.repartition("key").sortWithinPartitions("key", "seq").select("key", "value").mapInArrow(_chained(rows, functions, schema, least=least), schema)
    if least > 1:
        enough = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(F.col("key").alias("enough"))
        rows = rows.join(enough, F.col("key").eqNullSafe(F.col("enough")), "left_semi")
    parts = T.StructType([*schema.fields, T.StructField("chunk", T.LongType())])
    dealt = rows.repartitionByRange("key", "seq").sortWithinPartitions("key", "seq").select("key", "value")
    reduced = dealt.mapInArrow(_chained(rows, functions, parts, most=chunk), parts)
    results = reduced.repartition("key").sortWithinPartitions("key", "chunk", "idx").select("key", "value")
    return results.mapInArrow(_chained(rows, functions, schema), schema)


def _chained(rows: DataFrame, functions: Sequence[Callable], schema: T.StructType, least: int = 0, most: int | None = None) -> Callable:
    """The functions over rows (key, value) in the order of keys, with at most `most` values of a key at a time."""
    names, types = schema.names, list(rows.sparkSession.createDataFrame([], schema).toArrow().schema.types)

    def column(values: list, kind):
        import pandas as pd
        import pyarrow as pa

        if pa.types.is_timestamp(kind) and kind.tz:
            values = pd.Series([None if v is None else pd.Timestamp(v) for v in values], dtype="datetime64[us]").dt.tz_localize(kind.tz, ambiguous=False)
        elif pa.types.is_integer(kind):
            values = [int(v) if isinstance(v, float) and v.is_integer() else v for v in values]
        return pa.array(values, kind, from_pandas=True)

    def reduced(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        number, keys, found, out = TaskContext.get().partitionId() << 40, [], [], []
        held: list = []  # the slices of values that belong to `key`

        def close(key) -> None:
            nonlocal number
            values = pa.chunked_array(held).to_pandas()  # by itself: nulls of other keys don't change its type
            if getattr(values.dtype, "tz", None):
                values = values.dt.tz_localize(None)
            held.clear()
            values = list(values) if len(values) >= least else []
            for f in functions:
                if not values:
                    break
                values = list(f(key, values))
            keys.extend([key] * len(values))
            found.extend(values)
            out.extend((idx, number) for idx in range(len(values)))
            number += 1

        def emit():
            rest = list(zip(*out)) or [(), ()]
            columns = [pa.array(keys, types[0]), pa.array(rest[0], pa.int32()), column(found, types[2]), pa.array(rest[1], pa.int64())]
            batch = pa.RecordBatch.from_arrays(columns[: len(names)], names=names)
            keys.clear(), found.clear(), out.clear()
            return batch

        key, size = None, 0
        for batch in batches:
            own, values, start = batch.column(0).to_pylist(), batch.column(1), 0
            while start < len(own):
                if size and (size == most or not _same(key, own[start])):
                    close(key)
                    size = 0
                if not size:
                    key = own[start]
                limit = len(own) if most is None else min(len(own), start + most - size)
                end = start + 1
                while end < limit and (own[end] == key or _same(own[end], key)):
                    end += 1
                held.append(values.slice(start, end - start))
                size, start = size + end - start, end
                if len(found) >= _BATCH:
                    yield emit()
        if size:
            close(key)
        yield emit()

    return reduced


def _same(a, b) -> bool:
    """Whether two keys are equal, as Spark has it: NaN equals NaN."""
    return a == b or a is not None and b is not None and repr(a) == repr(b)


def fold_python(rows: DataFrame, function: Callable, value_type: T.DataType) -> DataFrame:
    """key, value by a Python function of a key's ordered values."""
    return reduce(rows, [lambda key, values: [function(key, values)]], value_type).drop("idx")


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """key, idx, value: a key's first n values, as a reduction to a list; each task keeps n of a key before the shuffle."""
    place = F.row_number().over(Window.partitionBy("key").orderBy(*order))
    return rows.withColumn("idx", place).where(F.col("idx") <= n).select("key", "idx", "value")


def first_only(rows: DataFrame) -> DataFrame:
    """key, value: the first of a key's reduced list."""
    return rows.groupBy("key").agg(F.min_by("value", "seq").alias("value"))


def canonical(rows: DataFrame, key: Column, *aggregates: Column) -> DataFrame:
    """Keys that a comparator calls equal, as one group by their canonical form; `key` is the first one seen."""
    return rows.groupBy(key.alias("_canonical")).agg(F.min_by("key", "seq").alias("key"), *aggregates).drop("_canonical")


def ordered_emit(rows: DataFrame, part: Column) -> DataFrame:
    """part, key, rank: the keys of each partition in order."""
    keys = rows.select(part.alias("part"), "key").distinct()
    return keys.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("key")))


def debounced(rows: DataFrame, ts: str, gap_seconds: int, run_buckets: int = 1 << 16) -> DataFrame:
    """Add `gap`: the number of pauses longer than `gap_seconds` before a row, over all keys (a global timer). Rows
    without a time have none.

    Within a bucket of time as long as the gap there is no pause; so rows are first reduced to their buckets, with the
    first and last time of each. Pauses are found and numbered over the buckets, in runs of `run_buckets`, and joined back.
    """
    at, bucket, other, first, last, gap = fresh(rows, "at", "bucket", "of_bucket", "first", "last", "gap")
    rows = rows.withColumn(at, F.unix_micros(F.col(ts).cast("timestamp"))).withColumn(bucket, F.floor(F.col(at) / (gap_seconds * 1_000_000)))
    ends = rows.where(F.col(bucket).isNotNull()).groupBy(F.col(bucket).alias(other)).agg(F.min(at).alias(first), F.max(at).alias(last))
    ends = ends.withColumn("run", F.floor(F.col(other) / run_buckets))
    runs = ends.groupBy("run").agg(F.max(last).alias("end"))
    runs = runs.select("run", F.lag("end").over(Window.orderBy("run")).alias("previous"))
    order = Window.partitionBy("run").orderBy(other)
    pause = F.col(first) - F.coalesce(F.lag(last).over(order), F.col("previous")) > gap_seconds * 1_000_000
    ends = ends.join(runs, "run").withColumn("new", F.coalesce(pause.cast("long"), F.lit(0)))
    sums = ends.groupBy("run").agg(F.sum("new").alias("n"))
    sums = sums.select("run", F.coalesce(F.sum("n").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    numbers = ends.join(sums, "run").select(other, (F.col("earlier") + F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias(gap))
    return rows.join(numbers, F.col(bucket) == F.col(other), "left").drop(at, bucket, other)
