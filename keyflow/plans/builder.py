"""A fluent builder over the operators: typed inputs, keys, settings in any order, then one terminal operation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import match, reduce, routing
from ..operators.match import KeyedInput
from ..sources.config import FlowConfig


@dataclass(frozen=True)
class KeyMatch:
    """Inputs that share a key. `dispatch` and `canonical_key` hold whatever the order of the calls."""

    inputs: tuple[KeyedInput, ...]
    router: Callable[[DataFrame], DataFrame] | None = None
    canonical: Callable[[Column], Column] | None = None
    run: int | str | None = None

    def or_(self, df: DataFrame, key: Column, seq: Column, value: Column | None = None) -> "KeyMatch":
        """One more input; without `value`, the record itself."""
        return replace(self, inputs=(*self.inputs, keyed(df, key, seq, value)))

    def dispatch(self, router: Callable[[DataFrame], DataFrame]) -> "KeyMatch":
        return replace(self, router=router)

    def sort(self, canonical: Callable[[Column], Column]) -> "KeyMatch":
        """Keys with the same canonical form are one key."""
        return replace(self, canonical=canonical)

    def in_runs(self, run: int | str = "ranked") -> "KeyMatch":
        """Number the records of a key in runs of the order column, for keys with very many: of a length, or by rank."""
        return replace(self, run=run)

    def _inputs(self) -> tuple[KeyedInput, ...]:
        return tuple(replace(i, key=self.canonical(i.key)) for i in self.inputs) if self.canonical else self.inputs

    def _routed(self, df: DataFrame) -> DataFrame:
        return self.router(df) if self.router else df

    def _rows(self) -> DataFrame:
        return match.key_union(self._inputs())

    def for_each(self) -> DataFrame:
        return self._routed(self._rows())

    def for_each_tuple(self) -> DataFrame:
        return self._routed(match.zip_match(self._inputs(), run=self.run))

    def for_each_list(self, size: int | None = None) -> DataFrame:
        """A key's values in order, those of equal order by input: whole, or every `size`."""
        rows = self._rows()
        if size is None:
            return self._routed(match.key_lists(rows.withColumn("seq", F.struct("seq", "kind"))))
        return self._routed(match.key_batches(rows, size, run=self.run, order=("seq", "kind")))

    def for_each_chunk(self, size: int) -> DataFrame:
        """A key's whole list in rows of `size` values."""
        return self._routed(match.key_chunks(self._rows(), size, run=self.run, order=("seq", "kind")))

    def fold(self, *aggregates: Column, least: int | None = None) -> DataFrame:
        return self._routed(reduce.fold(self._rows(), *aggregates, least=least))

    def reduce(self, *functions: Callable, value_type, least: int = 0, chunk: int | None = None) -> DataFrame:
        return self._routed(reduce.reduce(self._rows(), functions, value_type, least, chunk, self.run))


def keyed(df: DataFrame, key: Column, seq: Column, value: Column | None = None) -> KeyedInput:
    return KeyedInput(df, key, F.struct(*[df[c] for c in df.columns]) if value is None else value, seq)


def configured(found: KeyMatch, config: FlowConfig) -> KeyMatch:
    """By the settings: keys go to `partitions` partitions by hash, and are numbered in runs of `batch_run`."""
    return found.dispatch(by_hash(config.partitions)).in_runs(config.batch_run)


def match_key(df: DataFrame, key: Column, seq: Column, value: Column | None = None) -> KeyMatch:
    return KeyMatch((keyed(df, key, seq, value),))


def by_hash(parts: int, exact: bool = False) -> Callable[[DataFrame], DataFrame]:
    return lambda df: routing.to_hash(df, F.col("key"), parts, exact)
