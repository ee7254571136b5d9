"""Statistics of keyed buffers, and range split points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import RUN_ROWS, numbered, ranked_run


def key_stats(df: DataFrame) -> DataFrame:
    """part, value_size, leaf_size (keys), largest: of rows (part, key)."""
    sizes = df.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("part").agg(F.sum("n").alias("value_size"), F.count(F.lit(1)).alias("leaf_size"), F.max("n").alias("largest"))


def split_point(counts: DataFrame, run_keys: int = RUN_ROWS) -> DataFrame:
    """split: the key that halves rows (key, n) of integer keys: between the last key under half of all and the next.

    Keys are cut into runs by rank, MAX_RUNS at most; sums are taken within runs and then over the few runs.
    """
    rows = counts.withColumn("run", ranked_run(counts, "key", run_keys))
    ordered = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("run").agg(F.sum("n").alias("n_run"))
    runs = runs.select("run", F.coalesce(F.sum("n_run").over(ordered), F.lit(0)).alias("before"), F.expr("sum(n_run) OVER () div 2").alias("half"))
    within = F.sum("n").over(Window.partitionBy("run").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("within", within).join(F.broadcast(runs), "run").withColumn("cum", F.col("before") + F.col("within"))
    ends = placed.agg(F.max(F.when(F.col("cum") < F.col("half"), F.col("key"))).alias("l"), F.min(F.when(F.col("cum") >= F.col("half"), F.col("key"))).alias("r"))
    return ends.select(F.expr("CASE WHEN l IS NULL THEN r ELSE greatest(1, (r - l) div 2) + l END").alias("split"))


def merged_trees(a: DataFrame, b: DataFrame, run: int | str | None = None) -> DataFrame:
    """key, pos, value of two ordered buffers of rows (key, seq, value): under each key, those of `a` before those of `b`."""
    rows = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
    placed = numbered(rows, ["key", "side"], ["seq"], name="own", run=run)
    sizes = a.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select(F.col("key").alias("of_key"), "n")
    placed = placed.join(sizes, F.col("key").eqNullSafe(F.col("of_key")), "left")
    return placed.select("key", (F.col("own") + F.when(F.col("side") == 1, F.coalesce("n", F.lit(0))).otherwise(0)).cast("int").alias("pos"), "value")
