"""Routing of records to logical partitions, as a `part` column that doesn't depend on Spark's own partitions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import folded_part, fraction, hashed_part, poisson
from .ordering import fresh


def hash_part(key: Column, parts: int, exact: bool = False) -> Column:
    """`exact`: the folded number of an integer key; else Spark's hash of any key."""
    return folded_part(key, parts) if exact else hashed_part(parts, key)


def all_parts(parts: int) -> Column:
    return F.sequence(F.lit(0), F.lit(parts - 1))


def random_part(parts: int, seed: int, *identity: Column) -> Column:
    return F.floor(fraction(seed, *identity) * parts).cast("int")


def bagged_parts(parts: int, seed: int, *identity: Column) -> Column:
    """Each partition independently, with probability 1 - 1/e (so perhaps none)."""
    return F.filter(all_parts(parts), lambda p: fraction(seed, p, *identity) > math.exp(-1))


def to_hash(df: DataFrame, key: Column, parts: int, exact: bool = False) -> DataFrame:
    return df.withColumn("part", hash_part(key, parts, exact))


def to_single(df: DataFrame) -> DataFrame:
    """All records to one partition."""
    return df.withColumn("part", F.lit(0))


def to_all(df: DataFrame, parts: int) -> DataFrame:
    """Each record to every partition."""
    return df.withColumn("part", F.explode(all_parts(parts)))


def to_random_one(df: DataFrame, parts: int, seed: int, *identity: Column) -> DataFrame:
    return df.withColumn("part", random_part(parts, seed, *identity))


def to_bagged(df: DataFrame, parts: int, seed: int, *identity: Column) -> DataFrame:
    return df.withColumn("part", F.explode(bagged_parts(parts, seed, *identity)))


def to_poisson(df: DataFrame, parts: int, mean: float, seed: int, *identity: Column) -> DataFrame:
    """Each record to each partition a Poisson number of times, as `times` (those with 0 are left out)."""
    (u,) = fresh(df, "u")
    drawn = to_all(df, parts).withColumn(u, fraction(seed, F.col("part"), *identity))
    drawn = drawn.withColumn("times", poisson(mean, F.col(u)))
    # none is the first step, told by a comparison alone, so that the number isn't worked out twice
    return drawn.where(F.col(u) >= math.exp(-mean) if mean < 100 else F.col("times") > 0).drop(u)


def selective(df: DataFrame, rules: Sequence[tuple[Column, Column]], otherwise: Column) -> DataFrame:
    """Each record by the first rule (predicate, partition or array of them) whose predicate holds, else by `otherwise`:
    one pass over the records, whatever the number of rules."""
    columns = [c for _, c in rules] + [otherwise]
    kinds = df.select(*[c.alias(str(k)) for k, c in enumerate(columns)]).schema
    lists = [(c if f.dataType.typeName() == "array" else F.array(c)).cast("array<int>") for c, f in zip(columns, kinds)]
    chosen = lists[-1]
    for (predicate, _), found in reversed(list(zip(rules, lists))):
        chosen = F.when(predicate, found).otherwise(chosen)
    return df.withColumn("part", F.explode(chosen))


def custom(df: DataFrame, part: Column) -> DataFrame:
    """By an expression: a partition, or an array of them."""
    return selective(df, [], part)


def for_each_part(spark, parts: int, *columns: Column) -> DataFrame:
    """A row for each partition."""
    return spark.range(parts).select(F.col("id").cast("int").alias("part"), *columns)
