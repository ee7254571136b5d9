"""Stages: connected transformations with a completion barrier, and states that partitions share."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import DEFAULT_PARTITIONS
from ..sources.lines import read_lines
from ..sources.shared import shared_dir
from . import merge, routing


@dataclass
class Stage:
    """A transformation and what follows it. Connecting runs nothing; `sync` is the barrier.

    With a `key`, records get a partition of `parts` by it before the transformation; a `unit` is one copy, whose
    records are all in partition 0. `restored` is a hook on what the stage before gives. Names are unique in a pipeline.
    """

    transform: Callable[[DataFrame], DataFrame]
    name: str = "stage"
    handlers: list[Callable[[DataFrame], None]] = field(default_factory=list)
    following: list["Stage"] = field(default_factory=list)
    key: Column | None = None
    parts: int = DEFAULT_PARTITIONS
    unit: bool = False
    restored: Callable[[DataFrame], DataFrame] | None = None
    started: float | None = None
    elapsed: float | None = None

    def connects(self, other: "Stage") -> "Stage":
        self.following.append(other)
        return other

    def with_handler(self, handler: Callable[[DataFrame], None]) -> "Stage":
        self.handlers.append(handler)
        return self

    def result(self, df: DataFrame) -> DataFrame:
        """What this stage makes of its input."""
        df = self.restored(df) if self.restored else df
        if self.unit:
            df = routing.to_single(df)
        elif self.key is not None:
            df = routing.to_hash(df, self.key, self.parts)
        return self.transform(df)

    def walk(self):
        yield self
        for s in self.following:
            yield from s.walk()

    def _named(self) -> None:
        names = [s.name for s in self.walk()]
        if repeated := {n for n in names if names.count(n) > 1}:
            raise ValueError(f"stages share a name: {', '.join(sorted(repeated))}")

    def plan(self, df: DataFrame) -> dict[str, DataFrame]:
        """The result of each last stage, by name, as plans."""
        self._named()

        def ends(stage: Stage, df: DataFrame) -> dict[str, DataFrame]:
            out = stage.result(df)
            return {k: v for s in stage.following for k, v in ends(s, out).items()} if stage.following else {stage.name: out}

        return ends(self, df)

    def sync(self, df: DataFrame, path: str | None = None) -> dict[str, DataFrame]:
        """Run all stages to their end, then the handlers, each with its own stage's result; the last stages' results.

        Results that are asked for more than once, by followers, a handler or the caller, are written as Parquet, under
        `path` or the shared folder, and computed once.
        """
        self._named()
        self.started, base = time.time(), path or f"{shared_dir(df.sparkSession)}/stages-{uuid.uuid4().hex}"
        begin, found, ends = time.monotonic(), {}, {}

        def run(stage: Stage, df: DataFrame) -> None:
            out = stage.result(df)
            if stage.handlers or len(stage.following) != 1:
                out.write.parquet(f"{base}/{stage.name}")
                out = found[stage.name] = df.sparkSession.read.parquet(f"{base}/{stage.name}")
            if not stage.following:
                ends[stage.name] = out
            for s in stage.following:
                run(s, out)

        run(self, df)
        self.elapsed = time.monotonic() - begin
        for stage in self.walk():
            for handler in stage.handlers:
                handler(found[stage.name])
        return ends

    def start_reading(self, spark, path: str, target: str | None = None, **options) -> dict[str, DataFrame]:
        """`sync` over the lines of text files (`read_lines` has the options); results are written under `target`."""
        return self.sync(read_lines(spark, path, **options), target)


def single(transform: Callable[[DataFrame], DataFrame], name: str = "single") -> Stage:
    """A stage of one copy, which isn't spread over partitions."""
    return Stage(transform, name, unit=True)


def collect_states(df: DataFrame, *aggregates: Column) -> DataFrame:
    """A row for each partition, in order when collected by `part`."""
    return df.groupBy("part").agg(*aggregates)


def merged_state(df: DataFrame, *aggregates: Column) -> DataFrame:
    return df.agg(*aggregates)


def merged_by(states: DataFrame, function: Callable[[dict, dict], dict], schema: str) -> DataFrame:
    """One row by a function of two states, over the partitions' states as a tree; `schema` names the states' columns."""
    return merge.custom(states, [x.split()[0] for x in schema.split(", ")], function, schema)


def share_state(states: DataFrame, merge: Callable[[DataFrame], DataFrame], step: Callable[[DataFrame, DataFrame], DataFrame], rounds: int) -> DataFrame:
    """Rounds of: merge the partitions' states, give all of them the merged one (one row), and let each take its step.

    Each round's states are written to the shared folder, which cuts the lineage.
    """
    shared_dir(states.sparkSession)
    for _ in range(rounds):
        states = step(states, merge(states)).checkpoint()
    return states


def one_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Every row of `df` beside the one row of `row`, which is broadcast."""
    return df.crossJoin(F.broadcast(row))
