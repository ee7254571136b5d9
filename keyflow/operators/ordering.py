"""Positions of rows within their key, in an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a run by rank is to have, and the most runs.
RUN_ROWS, MAX_RUNS = 1 << 16, 1000


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of `df` has."""
    out = []
    for name in names:
        while name in df.columns or name in out:
            name = f"_{name}"
        out.append(name)
    return out


def ranked_run(df: DataFrame, column: str, rows: int = RUN_ROWS) -> Column:
    """The run of a number, date or time by its rank: runs have about as many rows each, however the values lie. The
    bounds, MAX_RUNS at most, come from one pass over the column; null comes first, as in sorting."""
    n, kind = df.count(), df.schema[column].dataType
    runs = min(MAX_RUNS, n // rows + 1)
    if runs == 1:
        return F.lit(0)
    shares = [k / runs for k in range(1, runs)]
    bounds = df.agg(F.percentile_approx(F.col(column), F.array(*map(F.lit, shares)), F.lit(10_000)).alias("b")).first().b
    array = F.array(*[F.lit(b).cast(kind) for b in sorted(set(bounds or []))])
    return F.when(F.col(column).isNull(), -1).otherwise(F.size(F.filter(array, lambda b: b <= F.col(column))))


def numbered(df: DataFrame, keys: list[str], seq: list[str], name: str = "pos", run: int | str | None = None) -> DataFrame:
    """Add `name`, 1 for a key's first row by `seq`. Rows whose key or order is null are numbered like any other, null first.

    With `run`, rows are cut by the first `seq` column into runs, numbered within (key, run), and the runs' counts are
    summed before: no task then holds a whole key, however many rows it has. `run` is the length of runs of an integer
    column, or "ranked" for runs by rank (`ranked_run`), which suit any numbers or times.
    """
    if run is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*seq)))
    r, n, before, within = fresh(df, "run", "n", "before", "within")
    rows = df.withColumn(r, (ranked_run(df, seq[0]) if run == "ranked" else F.coalesce(F.floor(F.col(seq[0]) / run), F.lit(-(1 << 62)))).cast("long"))
    counts = rows.groupBy(*keys, r).agg(F.count(F.lit(1)).alias(n))
    earlier = Window.partitionBy(*keys).orderBy(r).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0)))
    other = [f"{r}_{k}" for k in range(len(keys) + 1)]
    counts = counts.select(*[F.col(c).alias(o) for c, o in zip([*keys, r], other)], before)
    same = F.lit(True)
    for c, o in zip([*keys, r], other):
        same = same & F.col(c).eqNullSafe(F.col(o))
    rows = rows.withColumn(within, F.row_number().over(Window.partitionBy(*keys, r).orderBy(*seq)))
    return rows.join(counts, same).withColumn(name, (F.col(before) + F.col(within)).cast("int")).drop(r, before, within, *other)
