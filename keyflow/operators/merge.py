"""The state merge algebra: one value from the partitions' states, by operator and type.

Operators: none, add, multiply, mean, max, min. States are rows (part, column); a partition without a row has no state.
As the algebra has it, a value that a map or array lacks counts as zero (`absent="zero"`): the product or the maximum
of something that one partition lacks is taken with 0. `absent="skip"` leaves lacking values out.
Maps and arrays are merged as rows: map keys and positions become columns, nested ones further columns. An array is
merged by position, or as a list, end to end, where the caller says so. Results keep the states' types; whole numbers
that don't fit them are an error, as Spark's casts have it. Means of whole numbers are cut at each node of the merge tree.
Partial sums run before the shuffle; only per-partition states, which are few, are spread over the partition grid.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMERIC = (*WHOLE, T.FloatType, T.DoubleType)


class UnsupportedMerge(TypeError):
    pass


def scalar(op: str, column: str, kind: T.DataType) -> Column:
    """The aggregate of a scalar column, of its own type (means: double)."""
    c = F.col(column)
    if op == "none":
        return F.min_by(c, F.when(c.isNotNull(), F.col("part")))
    if isinstance(kind, T.BooleanType):
        found = {"add": F.bool_or(c), "multiply": F.bool_and(c), "max": F.max(c), "min": F.min(c)}
    elif isinstance(kind, WHOLE):
        # as many factors as there are partitions; a product of doubles wouldn't be exact
        product = F.aggregate(F.collect_list(c), F.lit(1).cast("long"), lambda x, y: x * y)
        found = {"add": F.sum(c).cast(kind), "multiply": F.when(F.count(c) > 0, product).cast(kind), "mean": F.avg(c), "max": F.max(c), "min": F.min(c)}
    elif isinstance(kind, NUMERIC):
        found = {"add": F.sum(c).cast(kind), "multiply": F.product(c).cast(kind), "mean": F.avg(c), "max": F.max(c), "min": F.min(c)}
    else:
        found = {"max": F.max(c), "min": F.min(c)}
    if op not in found:
        raise UnsupportedMerge(f"{op} of {kind.simpleString()}")
    return found[op]


def tree_mean(values: list[Column]) -> Column:
    """The mean of whole numbers, one for each partition, cut at each node of the merge tree."""

    def merge(a: tuple[Column, int], b: tuple[Column, int]) -> tuple[Column, int]:
        n = a[1] + b[1]
        return (a[0] * F.lit(a[1] / n) + b[0] * F.lit(b[1] / n)).cast("long"), n

    return tree([(v, 1) for v in values], merge)[0]


def _filled(op: str, kind: T.DataType, parts: int, absent: str) -> Column:
    """The aggregate of `value` over the partitions that have one, then with zeros for those of `parts` that lack it."""
    value, zero, n_parts = F.col("value"), F.lit(False) if isinstance(kind, T.BooleanType) else F.lit(0).cast(kind), F.lit(parts)
    if op == "mean" and isinstance(kind, WHOLE) and absent != "skip":
        of = F.map_from_entries(F.collect_list(F.struct("part", "value")))
        return tree_mean([F.coalesce(of[F.lit(p)], F.lit(0)).cast("long") for p in range(parts)]).cast(kind)
    plain = scalar(op, "value", kind)
    if absent == "skip" or op in ("none", "add"):
        return plain
    lacking = F.count(value) < n_parts
    if op == "multiply":
        return F.when(lacking, zero).otherwise(plain)
    if op == "mean":
        return F.sum(value) / n_parts
    return F.when(lacking, F.greatest(plain, zero) if op == "max" else F.least(plain, zero)).otherwise(plain)


def merged(states: DataFrame, column: str, op: str, parts: int, absent: str = "zero") -> DataFrame:
    """Maps and arrays of any nesting: key or pos (then key_2, pos_2 ...), value: merged by map key and position."""
    kind, items, path = states.schema[column].dataType, states.select("part", F.col(column).alias("value")), []
    while isinstance(kind, (T.MapType, T.ArrayType)):
        is_map = isinstance(kind, T.MapType)
        name = ("key" if is_map else "pos") + (f"_{len(path) + 1}" if path else "")
        inner = F.explode("value").alias(name, "value") if is_map else F.posexplode("value").alias(name, "value")
        items, path = items.select("part", *path, inner), [*path, name]
        kind = kind.valueType if is_map else kind.elementType
    if not path:
        raise UnsupportedMerge(f"{kind.simpleString()} is neither a map nor an array")
    return items.groupBy(*path).agg(_filled(op, kind, parts, absent).alias("value"))


def arrays(states: DataFrame, column: str, op: str, parts: int, absent: str = "zero") -> DataFrame:
    """pos, value: the arrays merged by position."""
    return merged(states, column, op, parts, absent)


def maps(states: DataFrame, column: str, op: str, parts: int, absent: str = "zero") -> DataFrame:
    """key, value: the maps merged by key; what their values hold, likewise."""
    return merged(states, column, op, parts, absent)


def lists(states: DataFrame, column: str) -> DataFrame:
    """seq (a partition and a place), value: the lists end to end, in the order of partitions, a row for each member."""
    return states.select("part", F.posexplode(column).alias("at", "value")).select(F.struct("part", "at").alias("seq"), "value")


def map_lists(states: DataFrame, column: str) -> DataFrame:
    """key, seq, value: of maps of lists, the lists of each key end to end, a row for each member."""
    return states.select("part", F.explode(column).alias("key", "items")).select("key", "part", F.posexplode("items").alias("at", "value")).select("key", F.struct("part", "at").alias("seq"), "value")


def sets(states: DataFrame, column: str) -> DataFrame:
    """value: the members of the sets, each once, as rows."""
    return states.select(F.explode(column).alias("value")).distinct()


def tree(values: list, merge: Callable):
    """values merged in a balanced tree: halves first, the left one smaller."""
    if len(values) == 1:
        return values[0]
    half = len(values) // 2
    return merge(tree(values[:half], merge), tree(values[half:], merge))


def custom(states: DataFrame, columns: list[str], merge: Callable[[dict, dict], dict], schema: str) -> DataFrame:
    """One row by a function of two states, over the partitions' states in order: one small row for each partition."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("part")[columns].to_dict("records")
        return pd.DataFrame([tree(rows, merge)] if rows else [])

    return states.select("part", *columns, F.lit(0).alias("_all")).groupBy("_all").applyInPandas(run, schema)


def whole_mean(states: DataFrame, column: str) -> DataFrame:
    """value: the mean of integer states, cut to a whole number at each node of the merge tree."""

    def merge(a: dict, b: dict) -> dict:
        n = a["n"] + b["n"]
        return {"value": int(a["value"] * (a["n"] / n) + b["value"] * (b["n"] / n)), "n": n}

    rows = states.select("part", F.col(column).cast("long").alias("value"), F.lit(1).cast("long").alias("n"))
    return custom(rows, ["value", "n"], merge, "value long, n long").select("value")


def merge_count(states: DataFrame) -> DataFrame:
    """merged_count and the merged partitions, in order."""
    return states.agg(F.count(F.lit(1)).alias("merged_count"), F.array_sort(F.collect_set("part")).alias("merged_parts"))


def every_part(states: DataFrame, parts: int, **initial) -> DataFrame:
    """The states of all partitions: those without a row have the initial values."""
    grid = states.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"))
    joined = grid.join(states, "part", "left")
    return joined.select("part", *[F.coalesce(c, F.lit(initial[c])).alias(c) if c in initial else F.col(c) for c in states.columns if c != "part"])


def copies(spark, parts: int, copied: dict, merge_only: dict | None = None, restored: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A state for each partition: `copied` from the original, `merge_only` fields as they are at first (they are merged,
    but not copied), and then what the hook `restored` makes of them."""
    grid = spark.range(parts).select(F.col("id").cast("int").alias("part"), *[F.lit(v).alias(k) for k, v in {**copied, **(merge_only or {})}.items()])
    return restored(grid) if restored else grid
