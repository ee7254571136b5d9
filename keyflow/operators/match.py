"""Typed matching and keyed matching of records.

Records carry a key and an explicit order. Positional matching pairs the i-th record of each input under a key, uses
each record at most once and leaves the surplus of the longer inputs unmatched: all inputs' records are numbered in one
union and grouped by (key, i), which spreads a key with many records over the tasks.

Null keys match nothing. Records of an input that are equal in order are taken in an arbitrary one; those of different
inputs in the inputs'.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce as fold_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import numbered


def typed_match(df: DataFrame, branches: Sequence[tuple[str, Column]], otherwise: str | None = None, column: str = "branch") -> DataFrame:
    """Add the first branch whose predicate holds; null, or `otherwise` as the catch-all, for rows that none handles.

    A catch-all declared in the list (predicate `lit(True)`) takes all rows that the branches before it leave.
    """
    chosen = F.lit(otherwise)
    for name, predicate in reversed(list(branches)):
        chosen = F.when(predicate, F.lit(name)).otherwise(chosen)
    return df.withColumn(column, chosen)


def with_sender(df: DataFrame, sender: Column, column: str = "sender") -> DataFrame:
    """Add who sent a record, for branches and handlers that ask for it; null where nobody is named."""
    return df.withColumn(column, sender)


def handled(df: DataFrame, column: str = "branch") -> DataFrame:
    return df.where(F.col(column).isNotNull())


def unhandled(df: DataFrame, column: str = "branch", strict: bool = False) -> DataFrame:
    """Rows that no branch handles; with `strict`, evaluating one is an error."""
    rows = df.where(F.col(column).isNull())
    return rows.withColumn(column, F.raise_error(F.lit("unhandled record")).cast("string")) if strict else rows


@dataclass(frozen=True)
class KeyedInput:
    """An input of a keyed match: what gives its key, its order and its value."""

    df: DataFrame
    key: Column
    value: Column
    seq: Column

    def rows(self) -> DataFrame:
        """key, seq, value; records with a null key match nothing."""
        return self.df.select(self.key.alias("key"), self.seq.alias("seq"), self.value.alias("value")).where("key IS NOT NULL")


def key_each(source: KeyedInput) -> DataFrame:
    return source.rows()


def key_union(sources: Sequence[KeyedInput]) -> DataFrame:
    """key, kind (the input's number), seq, value of all inputs' records, one at a time."""
    parts = [s.rows().withColumn("kind", F.lit(k)) for k, s in enumerate(sources)]
    return fold_left(DataFrame.unionByName, parts).select("key", "kind", "seq", "value")


def zip_match(sources: Sequence[KeyedInput], run: int | str | None = None) -> DataFrame:
    """key, pos and value_0 .. value_n-1: the i-th records of all inputs under each key (two to four inputs)."""
    if not 2 <= len(sources) <= 4:
        raise ValueError("tuples have two to four inputs; use key_union with lists or batches beyond")
    sides = [s.rows().withColumnRenamed("value", f"value_{k}").withColumn("kind", F.lit(k)) for k, s in enumerate(sources)]
    rows = fold_left(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides)
    # without runs a key is one task's: dealing by key once serves both the numbering and the grouping
    placed = numbered(rows if run else rows.repartition("key"), ["key", "kind"], ["seq"], run=run)
    values = [_only(rows, k) for k in range(len(sources))]
    tuples = placed.groupBy("key", "pos").agg(F.count(F.lit(1)).alias("kinds"), *values).where(F.col("kinds") == len(sources))
    return tuples.select("key", "pos", *[F.col(f"value_{k}") for k in range(len(sources))])


def _only(rows: DataFrame, kind: int) -> Column:
    """The value of the one row of a kind; an aggregate that hashes where the type allows it."""
    name = f"value_{kind}"
    if isinstance(rows.schema[name].dataType, T.AtomicType):
        return F.max(name).alias(name)  # null in the other kinds' rows
    return F.first(F.when(F.col("kind") == kind, F.struct(name)), ignorenulls=True)[name].alias(name)


def zip_leftover(sources: Sequence[KeyedInput]) -> DataFrame:
    """key, kind, leftover: how many records of each input stay unmatched under each key."""
    counts = key_union(sources).groupBy("key").pivot("kind", list(range(len(sources)))).agg(F.count(F.lit(1)))
    counts = counts.select("key", *[F.coalesce(F.col(str(k)), F.lit(0)).alias(f"n{k}") for k in range(len(sources))])
    least = F.least(*[F.col(f"n{k}") for k in range(len(sources))])
    return counts.select("key", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), (F.col(f"n{k}") - least).alias("leftover")) for k in range(len(sources))])).alias("x")).select("key", "x.kind", "x.leftover").where("leftover > 0")


def key_batches(rows: DataFrame, size: int, run: int | str | None = None, tails: bool = False, order: Sequence[str] = ("seq",)) -> DataFrame:
    """key, batch, values: every `size` values of a key in order; without `tails`, an incomplete last batch is left out."""
    placed = numbered(rows, ["key"], list(order), run=run).withColumn("batch", F.expr(f"(pos - 1) div {size}"))
    grouped = placed.groupBy("key", "batch").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("x"))
    grouped = grouped if tails else grouped.where(F.size("x") == size)
    return grouped.select("key", "batch", F.transform("x", lambda e: e["value"]).alias("values"))


def key_chunks(rows: DataFrame, size: int, run: int | str | None = None, order: Sequence[str] = ("seq",)) -> DataFrame:
    """key, batch, values: a key's whole list, in order, as rows of `size` values each, the last of fewer."""
    return key_batches(rows, size, run, tails=True, order=order)


def key_lists(rows: DataFrame, most: int = 1 << 20) -> DataFrame:
    """key, values: a key's values in order, in one row; keys of over `most` values are refused (`key_chunks` takes any)."""
    grouped = rows.groupBy("key").agg(F.collect_list(F.struct("seq", "value")).alias("x"))
    checked = F.when(F.size("x") <= most, F.col("x")).otherwise(F.raise_error(F.lit(f"a key has over {most} values: use key_chunks")))
    return grouped.select("key", F.transform(F.array_sort(checked), lambda e: e["value"]).alias("values"))
